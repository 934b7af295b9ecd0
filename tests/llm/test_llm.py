"""Operators of the llm folder: brute force, round trips, held-out accuracy, and odd inputs."""

import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import ann, decontaminate, dedup, htmltext, licences, mixing, pii, quality, sharding, tokenorder

DIR = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, n int, rank int, key string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, "s" if i is not None and i % 2 else None, None, 1, 2, "x") for i, t in rows], DOC)


ODD = [(1, None), (2, ""), (3, "one"), (3, "one"), (4, "word " * 60_000), (5, "a b c d e f"), (6, "a b c d e f"), (None, "a b c d e f"), (7, " \n\t ")]


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(i), find(j)
                top[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = list(rng.choice(words, 60))
        for c in range(14):  # from equal to far: edits spread around the threshold
            t = list(base)
            for _ in range(rng.integers(0, 9)):
                t[rng.integers(len(t))] = str(rng.choice(words))
            if c % 5 == 0:
                t = t[: len(t) - rng.integers(0, 6)]
            rows.append((g * 100 + c, " ".join(t)))
    want = brute_components(rows, 2, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in dedup.near_duplicates(docs(spark, rows), k=2).collect()}
    assert got == want


def test_dedup_odd_rows(spark):
    got = dedup.near_duplicates(docs(spark, ODD), k=2).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.n_shingles, r.component_id, r.kept))
    assert len(got) == len(ODD) and by[1] == [(0, 1, True)] and by[2] == [(0, 2, True)] and by[7] == [(0, 7, True)]
    assert by[5] == [(5, 5, True)] and by[6] == [(5, 5, False)]
    assert by[None] == [(5, None, False)]
    assert dedup.near_duplicates(docs(spark, [])).count() == 0


def base_spans(t):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        found.append((m.start(), 0, f"email:{m.start()}:{m.end()}"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, f"ip:{m.start()}:{m.end()}"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            found.append((m.start(), 2, f"card:{m.start()}:{m.end()}"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, f"phone:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(found))


def test_pii_base_equals_plain_patterns():
    rng = np.random.default_rng(5)
    alphabet = list("ab1234567890.@+- ()_%é")
    for _ in range(3000):
        t = "".join(rng.choice(alphabet, rng.integers(1, 60)))
        assert pii.joined(sorted(pii.plain(t), key=lambda s: (s[1], pii.KINDS.index(s[0])))) == base_spans(t), t


@pytest.mark.parametrize(
    "text,kind,part",
    [
        ("write to john dot doe at mail dot example dot com today", "email", "john dot doe at mail dot example dot com"),
        ("joe [at] host [dot] org!", "email", "joe [at] host [dot] org"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("call plus one five five five one two three four five six seven now", "phone", "plus one five five five one two three four five six seven"),
        ("host 10 dot 0 dot 0 dot 1 is up", "ip", "10 dot 0 dot 0 dot 1"),
        ("１２７.0.0.1", "ip", "１２７.0.0.1"),
    ],
)
def test_pii_disguises_keep_source_offsets(text, kind, part):
    base, full = pii.find(text)
    assert [(k, text[a:b]) for k, a, b in full if (k, a, b) not in base] == [(kind, part)]


def test_pii_leaves_prose_alone():
    for t in ("we met at home. dot com is at rest", "one two three go", "he looked at point. five of six", "a@b c", "1.2.3"):
        assert pii.find(t)[1] == []


def test_pii_rows(spark):
    got = pii.find_pii(docs(spark, [*ODD, (9, "x a@b.com y")])).collect()
    assert len(got) == len(ODD) + 1 and [r.spans for r in got if r.doc_id == 9] == ["email:2:9"] and got[0].base == ""
    assert hashlib.sha256(b"").hexdigest() == [r.h for r in pii.find_pii(docs(spark, [(1, None)])).select(F.sha2("base", 256).alias("h")).collect()][0]


PAGE = "<html><head><title>t</title><script>var t='</p>';</script></head><body><div class='cookie-notice'>We use cookies</div><nav><a href=x>Home</a></nav><main><h1>Head &amp; line</h1><p>One  <b>bold</b>\ntext<br>more<p>Two<div class=ad>Buy</div><form>Mail <input></form></main><div id=comments><p>First!</p></div><aside>side</aside><footer>f</footer></body></html>"


def test_html_text(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.replace("Two", f"Two {i}")) for i in range(5)] + [(90, None, None), (91, "http://x.example", ""), (92, "http://y.example", "<p>plain</p>tail")]
    got = {r.page_id: r for r in htmltext.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3].text == "Head & line\n\nOne bold text more\n\nTwo 3" and got[3].n_chars == len(got[3].text)
    assert got[90].text == "" and got[91].text == "" and got[92].text == "plain\n\ntail"
    assert htmltext.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_shards(spark):
    rows = [(i, "copy" if i % 3 == 0 else f"text {i} " * (i % 17)) for i in range(2000)] + [(5001, None), (5002, "")]
    got = sharding.assign_shards(docs(spark, rows), shards=24, ranges_per_shard=4).collect()
    assert len(got) == len(rows)
    size = collections.Counter()
    slots = collections.defaultdict(list)
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    biggest = max(r.size for r in got)
    assert max(size.values()) - min(size.values()) <= 2 * biggest and set(size) == set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign_shards(docs(spark, [])).count() == 0


def test_licences(spark):
    text = "Intro.\nLicensed under the Apache License, Version 2.0.\nbody. " + ". ".join(licences.SENTENCES[i] for i in licences.RULES[2][2]) + ".\nReleased under the  MIT license!"
    got = {(r.rule, r.n_times) for r in licences.scan_licences(docs(spark, [(1, text), *ODD])).collect()}
    assert got == {("apache-2.0-reference", 1), ("mit-text", 1), ("mit-reference", 1)}


def test_ann_recall_and_ties(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 32))
    x[10:60] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5050, [0.0] * 32), (5100, [float("nan")] * 32), (5150, [None] * 32)]
    got = collections.defaultdict(dict)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hit = 0
    for q in range(0, 3000, 50):
        s = unit @ unit[q]
        s[q] = -9
        want = sorted(range(3000), key=lambda i: (-round(s[i], 12), i))[:5]
        hit += len({v for v, _ in got[q].values()} & set(want))
    assert set(got) == set(range(0, 3000, 50)) and hit / 300 >= 0.9
    assert [got[0][r][0] for r in range(1, 6)] == [10, 11, 12, 13, 14]
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_lcs():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(1, 90)).tolist(), rng.integers(0, 6, rng.integers(0, 90)).tolist()
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        assert decontaminate.lcs_length(decontaminate.lcs_masks(a), len(a), b) == row[-1]


def test_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        assert sorted(tokenorder.permute(np.arange(n), n, 9).tolist()) == list(range(n))
    assert (tokenorder.permute(np.arange(1000), 1000, 1) != tokenorder.permute(np.arange(1000), 1000, 2)).any()


def test_batch_encoding_equals_whole():
    import pyarrow as pa

    from corpusloom.llm import textbytes as tb

    e = tokenorder.Encoder(tokenorder.TOKENIZER)
    texts = ["a  b", "  lead", "tab\tx", "x\n\ny", "x \n y", "end  ", "\n", "", "a \n\n  b\t\tc", "é  ü", "don't  stop'll", "12 34", "a\r\nb", "x\n \ny z", "the the the"]
    for a, _, data, offsets in tb.slices(pa.array(texts)):
        ids, cuts = e.encode(data, offsets)
        for i in range(len(offsets) - 1):
            assert ids[cuts[i] : cuts[i + 1]].tolist() == e.bpe.encode_ordinary(texts[a + i])


def test_quality_held_out(spark):
    d, lab = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.score_quality(d.select("doc_id", "text"), lab).join(lab, "doc_id").where("held_out").collect()
    assert len(got) > 50 and sum(r.predicted == r.quality for r in got) / len(got) >= 0.95


def test_quality_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.score_quality(docs(spark, ODD), none).collect()
    assert len(got) == len(ODD) and {r.score for r in got} == {0.5} and got[0].key == "x"
    some = spark.createDataFrame([(5, 1), (4, 0), (None, 1), (3, None)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality.score_quality(docs(spark, ODD), some).collect())


def test_pipeline_dedup_loses_no_text(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(None, "null id one " + long[::-1]), (None, "other null"), (3, "three first"), (3, "quite other text"), (3, "three first"), (4, long), (5, long), (3, long)]
    got = corpus_pipeline.dedup_stage(spark, docs(spark, rows), DIR).collect()
    assert sorted(r.text for r in got) == sorted({t for _, t in rows})


APACHE = """
Copyright 2020 The Authors

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by the Free Software Foundation,
either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""


def test_licences_wrapped(spark):
    import textwrap

    mit = "\n\n".join(textwrap.fill(licences.SENTENCES[i] + (":" if i == "mit-grant" else "."), 70) for i in licences.RULES[2][2])
    bsd = textwrap.fill(licences.SENTENCES["bsd-grant"] + ":", 60) + "\n\n" + "\n".join(textwrap.fill(f"{n}. {licences.SENTENCES[i]}.", 60) for n, i in enumerate(("bsd-source", "bsd-binary", "bsd-names"), 1))
    slashes = lambda t: "".join(f"// {x}\r\n" for x in t.splitlines())
    stars = lambda t: "/*\n" + "".join(f" * {x}\n" for x in t.splitlines()) + " */\nint x;\n"
    parted = licences.SENTENCES["cc0"].replace(" has waived", "\n\nhas waived")
    rows = [(1, APACHE), (2, stars(APACHE)), (3, slashes(APACHE)), (4, mit), (5, stars(mit)), (6, bsd), (7, slashes(GPL3)), (8, textwrap.fill(licences.SENTENCES["isc-grant"], 40)), (9, parted)]
    got = sorted((r.doc_id, r.rule, r.n_times, r.first_sentence) for r in licences.scan_licences(docs(spark, rows)).collect())
    ids = [(i, r, n) for i, r, n, _ in got]
    assert ids == [(1, "apache-2.0-header", 1), (2, "apache-2.0-header", 1), (3, "apache-2.0-header", 1), (4, "mit-text", 1), (5, "mit-text", 1), (6, "bsd-3-text", 1), (7, "gpl-3-notice", 1), (8, "isc-text", 1)]
    assert [f for *_, f in got][:2] == [2, 4] and got[3][3] == 0


LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.
"""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
"""
ZLIB = """  This software is provided 'as-is', without any express or implied
  warranty.  In no event will the authors be held liable for any damages
  arising from the use of this software.

  Permission is granted to anyone to use this software for any purpose,
  including commercial applications, and to alter it and redistribute it
  freely, subject to the following restrictions:
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
"""


def test_more_published_licences(spark):
    hashes = lambda t: "".join(f"# {x}\n" for x in t.splitlines())
    agpl = GPL3.replace("GNU General", "GNU Affero General")
    rows = [(1, LGPL), (2, hashes(LGPL)), (3, MPL), (4, ZLIB), (5, UNLICENSE), (6, agpl), (7, GPL3.replace("GNU General", "GNU Lesser General")), (8, UNLICENSE.splitlines()[0])]
    got = sorted((r.doc_id, r.rule) for r in licences.scan_licences(docs(spark, rows)).collect())
    assert got == [(1, "lgpl-2.1-notice"), (2, "lgpl-2.1-notice"), (3, "mpl-2.0-header"), (4, "zlib-text"), (5, "unlicense-text"), (6, "agpl-3-notice"), (7, "lgpl-3-notice")]
    assert len({i for i in licences.SENTENCES} & {i for _, _, ids in licences.RULES for i in ids}) == len(licences.SENTENCES)
    assert licences.scan_licences(docs(spark, [])).count() == 0


def test_licences_equal_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DIR}/documents.parquet'")
    want = sorted(con.sql(licences.oracle()).fetchall())
    assert want and sorted(tuple(r) for r in licences.scan_licences(spark.read.parquet(f"{DIR}/documents.parquet")).collect()) == want


def test_licence_tags_and_one_line_references(spark):
    rows = ["// SPDX-License-Identifier: MIT", "SPDX-License-Identifier: Apache-2.0\ncode", "Distributed under the MIT License.", "Licensed under the Apache License 2.0", "# SPDX-License-Identifier: BSD-3-Clause\n#\n# more", "MIT"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {(r.doc_id, r.licence) for r in licences.scan_licences(df).collect()}
    assert got == {(0, "MIT"), (1, "Apache-2.0"), (2, "MIT"), (3, "Apache-2.0"), (4, "BSD-3-Clause")}


def test_licence_plan_normalises_a_text_once(spark):
    plan = licences.scan_licences(spark.createDataFrame([(1, "x", "y")], "doc_id long, text string, ids string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 12 and licences.scan_licences(spark.createDataFrame([], "doc_id long, text string")).count() == 0
