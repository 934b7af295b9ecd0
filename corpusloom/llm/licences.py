"""Licence scans by sentence rules, by DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Known sentences of licences, as they are written, by identifier.
SENTENCES = {
    "apache-ref": "Licensed under the Apache License, Version 2.0",
    "apache-may-not": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License",
    "mit-ref": "Released under the MIT License",
    "mit-ref-2": "Licensed under the MIT License",
    "mit-ref-3": "This project is licensed under the MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3",
    "gpl-free": "This program is free software",
    "gpl-3-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-2-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl-2-later": "either version 2 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl-warranty": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-details": "See the GNU General Public License for more details",
    "mpl-ref": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc-by": "Licensed under CC BY 4.0",
    "cc-by-sa": "Licensed under CC BY-SA 4.0",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nd-work": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "cc-by-nc-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc-by-nc-sa-work": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "cc-by-nc-nd-work": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
    "bsd-warranty": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',
    "isc-warranty": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS',
    "lgpl-free": "This library is free software",
    "lgpl-terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "lgpl-2.1-later": "either version 2.1 of the License, or (at your option) any later version",
    "lgpl-3-terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "lgpl-details": "See the GNU Lesser General Public License for more details",
    "agpl-3-terms": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl-details": "See the GNU Affero General Public License for more details",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "unlicense-free": "This is free and unencumbered software released into the public domain",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "apache-ref-2": "Licensed under the Apache License 2.0",
    "mit-ref-4": "Distributed under the MIT License",
    "spdx": "SPDX-License-Identifier",
    "boost-ref": "Distributed under the Boost Software License, Version 1.0",
    "boost-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following',
}
# Ordered rules. A rule that another match contains gives way to it.
RULES = [
    ("apache-2.0-header", "Apache-2.0", ["apache-ref", "apache-may-not", "apache-copy", "apache-as-is", "apache-see"]),
    ("apache-2.0-reference", "Apache-2.0", ["apache-ref"]),
    ("mit-text", "MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("mit-reference", "MIT", ["mit-ref"]),
    ("mit-reference-2", "MIT", ["mit-ref-2"]),
    ("mit-reference-3", "MIT", ["mit-ref-3"]),
    ("bsd-3-text", "BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("bsd-2-text", "BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("isc-text", "ISC", ["isc-grant"]),
    ("gpl-3-notice", "GPL-3.0-or-later", ["gpl-free", "gpl-3-terms", "gpl-hope", "gpl-warranty", "gpl-details"]),
    ("gpl-2-notice", "GPL-2.0-or-later", ["gpl-free", "gpl-2-terms", "gpl-2-later", "gpl-hope", "gpl-warranty", "gpl-details"]),
    ("gpl-3-reference", "GPL-3.0-only", ["gpl3-work"]),
    ("mpl-2.0-reference", "MPL-2.0", ["mpl-ref"]),
    ("cc-by-nc-4.0-reference", "CC-BY-NC-4.0", ["cc-by-nc"]),
    ("cc-by-4.0-reference", "CC-BY-4.0", ["cc-by"]),
    ("cc-by-4.0-work", "CC-BY-4.0", ["cc-by-work"]),
    ("cc-by-sa-4.0-reference", "CC-BY-SA-4.0", ["cc-by-sa"]),
    ("cc0-waiver", "CC0-1.0", ["cc0"]),
    ("cc-by-sa-4.0-work", "CC-BY-SA-4.0", ["cc-by-sa-work"]),
    ("cc-by-nd-4.0-work", "CC-BY-ND-4.0", ["cc-by-nd-work"]),
    ("cc-by-nc-4.0-work", "CC-BY-NC-4.0", ["cc-by-nc-work"]),
    ("cc-by-nc-sa-4.0-work", "CC-BY-NC-SA-4.0", ["cc-by-nc-sa-work"]),
    ("cc-by-nc-nd-4.0-work", "CC-BY-NC-ND-4.0", ["cc-by-nc-nd-work"]),
    ("bsd-3-text-full", "BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-warranty"]),
    ("bsd-2-text-full", "BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty"]),
    ("isc-text-full", "ISC", ["isc-grant", "isc-warranty"]),
    ("lgpl-2.1-notice", "LGPL-2.1-or-later", ["lgpl-free", "lgpl-terms", "lgpl-2.1-later", "lgpl-hope", "gpl-warranty", "lgpl-details"]),
    ("lgpl-3-notice", "LGPL-3.0-or-later", ["gpl-free", "lgpl-3-terms", "gpl-hope", "gpl-warranty", "lgpl-details"]),
    ("agpl-3-notice", "AGPL-3.0-or-later", ["gpl-free", "agpl-3-terms", "gpl-hope", "gpl-warranty", "agpl-details"]),
    ("mpl-2.0-header", "MPL-2.0", ["mpl-ref", "mpl-copy"]),
    ("unlicense-text", "Unlicense", ["unlicense-free", "unlicense-anyone"]),
    ("zlib-text", "Zlib", ["zlib-as-is", "zlib-grant"]),
    ("apache-2.0-reference-2", "Apache-2.0", ["apache-ref-2"]),
    ("mit-reference-4", "MIT", ["mit-ref-4"]),
    ("boost-reference", "BSL-1.0", ["boost-ref"]),
    ("boost-text", "BSL-1.0", ["boost-grant"]),
]
# Short identifiers that follow the tag "SPDX-License-Identifier:".
SPDX = "MIT Apache-2.0 BSD-2-Clause BSD-3-Clause ISC GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-or-later LGPL-3.0-or-later AGPL-3.0-or-later MPL-2.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 Unlicense Zlib BSL-1.0".split()
SENTENCES |= {f"spdx-{x.lower()}": x for x in SPDX}
RULES += [(f"spdx-{x.lower()}-tag", x, ["spdx", f"spdx-{x.lower()}"]) for x in SPDX]
# A sentence ends at a line's end, or at . ! ? ; : before white space. Both
# engines (here and the SQL oracle) read these patterns alike; here a known sentence may also run over single line ends.
ENDS = r"[.!?;:]+(?:[ \t\r\n]+|$)|[\r\n]+"
NOISE = r"[^a-z0-9]+"
#: Sentences as published that the SQL's table lacks, by the same identifiers.
PUBLISHED = {"apache-ref": 'Licensed under the Apache License, Version 2.0 (the "License")'}
#: Marks for an end of ENDS: HARD, or SOFT where it is a single line break, which a wrapped sentence may hold.
HARD, SOFT = "\x01", "\x02"
#: A hint that a sentence of every rule has, so a text without any matches no rule.
HINT = r"(?i)licen|permission|redistribut|copyright|warrant|unencumbered"


def normal(sentence: str) -> str:
    return re.sub(NOISE, " ", sentence.lower()).strip()


def known() -> list[tuple[str, str]]:
    """(normalised sentence, identifier)."""
    return [(normal(text), i) for i, text in SENTENCES.items()]


def _marked(text: F.Column) -> F.Column:
    """Normalised text with a mark for each match of ENDS (as many, in the same places)."""
    out = F.translate(F.lower(text), HARD + SOFT, "  ")
    out = F.regexp_replace(out, r"[.!?;:]+(?:[ \t\r\n]+|$)", HARD)
    out = F.regexp_replace(out, r"(?<![\r\n])(?:\r\n|[\r\n])(?![\r\n])", SOFT)
    out = F.regexp_replace(out, r"[\r\n]+", HARD)
    out = F.regexp_replace(out, f"[^a-z0-9{HARD}{SOFT}]+", " ")
    return F.trim(F.regexp_replace(out, f" ?([{HARD}{SOFT}]) ?", "$1"))


def _wrapped(sentence: str) -> str:
    """Pattern of a normalised sentence from a mark to a mark, each of its spaces perhaps a single line break."""
    return f"(?<![^{HARD}{SOFT}])" + sentence.replace(" ", f"[ {SOFT}]") + f"(?![^{HARD}{SOFT}])"


def _sequence(rule: list[str]) -> str:
    return "".join(f"<{i}>" for i in rule)


def _once(df: DataFrame, **columns: F.Column) -> DataFrame:
    """``df`` with columns that are worked out once a row: the optimiser does not write a generator's result out for each use, in filters and lambdas above all."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def scan_licences(docs: DataFrame) -> DataFrame:
    """doc_id, licence, rule, n_times, first_sentence: each rule that a text of ``docs`` matches.

    A text is normalised to lower-case ASCII letters and digits, so comment
    marks go too. A known sentence is read where it fills the text between two
    ends (ENDS); single line breaks inside it, as in wrapped text, do not
    count, while blank lines part. Of known sentences that overlap the longest
    is read. They become identifiers, others are left out; a rule matches
    where its identifiers follow one another in that sequence.
    ``first_sentence`` is the number of ends before the first known sentence.
    Null and empty texts match nothing; rows that repeat a doc_id are read one
    by one; other columns are ignored.
    """
    sentences = sorted([*known(), *((normal(text), i) for i, text in PUBLISHED.items())], key=lambda k: -len(k[0]))
    table = F.array(*[F.struct(F.lit(s).alias("sentence"), F.lit(_wrapped(s)).alias("pattern"), F.lit(f"<{i}>").alias("id")) for s, i in sentences])
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(n).alias("licence"), F.lit(_sequence(s)).alias("ids")) for r, n, s in RULES])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").rlike(HINT))
    marked = _once(rows, marked=_marked(F.col("text"))).select("doc_id", "marked")
    flat = _once(marked, flat=F.translate("marked", SOFT, " "))
    held = _once(flat, held=F.filter(table, lambda k: F.contains(F.col("flat"), k["sentence"]))).where(F.size("held") > 0)
    named = _once(held, named=F.aggregate("held", F.col("marked"), lambda t, k: F.regexp_replace(t, k["pattern"], k["id"]))).select("doc_id", "named")
    before = F.substring_index("named", "<", 1)
    text = named.where(F.contains("named", F.lit("<"))).select(
        "doc_id",
        F.array_join(F.regexp_extract_all("named", F.lit("<[^>]*>"), F.lit(0)), "").alias("ids"),
        F.length(F.regexp_replace(before, f"[^{HARD}{SOFT}]", "")).cast("long").alias("first_sentence"),
    )
    hits = _once(text, hits=F.filter(rules, lambda r: F.contains(F.col("ids"), r["ids"])))
    best = hits.withColumn("hits", F.filter("hits", lambda r: ~F.exists("hits", lambda o: (o["ids"] != r["ids"]) & F.contains(o["ids"], r["ids"]))))
    each = best.select("doc_id", "ids", "first_sentence", F.explode("hits").alias("r"))
    times = (F.length("ids") - F.length(F.replace(F.col("ids"), F.col("r")["ids"], F.lit("")))) / F.length(F.col("r")["ids"])
    return each.select("doc_id", F.col("r")["licence"].alias("licence"), F.col("r")["rule"].alias("rule"), times.cast("long").alias("n_times"), "first_sentence")


def oracle() -> str:
    """The same as DuckDB SQL over ``documents``."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    table = ", ".join(f"({q(s)}, {q(i)})" for s, i in known())
    rules = ", ".join(f"({q(r)}, {q(n)}, {q(_sequence(s))})" for r, n, s in RULES)
    return rf"""
with known(sentence, id) as (values {table}), rules(rule, licence, ids) as (values {rules}),
parts as (select doc_id, regexp_split_to_array(text, {q(ENDS)}) as p from documents where text is not null),
lines as (select doc_id, unnest(p) as s, generate_subscripts(p, 1) - 1 as pos from parts),
named as (select l.doc_id, l.pos, k.id from (select doc_id, pos, trim(regexp_replace(lower(s), {q(NOISE)}, ' ', 'g')) as sentence from lines) l join known k using (sentence)),
texts as (select doc_id, string_agg('<' || id || '>', '' order by pos) as ids, min(pos) as first_sentence from named group by doc_id),
hits as (select t.doc_id, t.ids as seq, t.first_sentence, r.* from texts t join rules r on contains(t.ids, r.ids))
select h.doc_id, h.licence, h.rule, cast((length(h.seq) - length(replace(h.seq, h.ids, ''))) / length(h.ids) as bigint) as n_times, cast(h.first_sentence as bigint) as first_sentence
from hits h where not exists (select 1 from hits o where o.doc_id = h.doc_id and o.ids <> h.ids and contains(o.ids, h.ids))
"""
