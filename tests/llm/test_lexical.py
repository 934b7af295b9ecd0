"""Ranked search: brute force over plain texts, the skipping alone, and odd inputs."""

import collections
import math
import re

import numpy as np
import pytest

from corpusloom.llm import lexical

DOC = "doc_id long, text string, term string, seg int, item_id long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], DOC)


def items(spark, rows):
    return spark.createDataFrame([(i, t, 7) for i, t in rows], "item_id long, text string, doc_id int")


def terms(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(lexical.TERM, low)


def brute(rows, asked, k=50):
    each = [(i, collections.Counter(terms(t))) for i, t in rows]
    each = [(i, c, sum(c.values())) for i, c in each if c]
    N, L = len(each), sum(n for _, _, n in each)
    df = collections.Counter(t for _, c, _ in each for t in c)
    wants = collections.defaultdict(set)
    for i, t in asked:
        wants[i] |= set(terms(t))
    out = []
    for i, ts in wants.items():
        got = []
        for d, c, n in each:
            m = 50 + (50 * n * N) // L
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if s > 0:
                got.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(got)[:k])]
    return sorted(out, key=str)


def found(index, asked, **options):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in lexical.top_documents(index, asked, **options).collect()), key=str)


def corpus(rng, n, vocabulary=80):
    p = 1 / np.arange(1, vocabulary + 1)
    return [(i * 3, " ".join(f"W{w}" for w in rng.choice(vocabulary, rng.integers(0, 30), p=p / p.sum()))) for i in range(n)]


def test_search_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = corpus(rng, 400)
    rows += rows[:60] + [(None, "w1 w2 w70"), (None, "w1 w2 w70"), (9_000, "w1\x00w2-W3'w4_w5 É é"), (9_001, "日本 w1")]
    asked = [(i, t) for i, t in corpus(rng, 12)] + [(100, "É 日本"), (101, "zzz"), (102, None), (103, "w1 W1"), (103, "w2")]
    index = lexical.build_index(docs(spark, rows).repartition(3))
    assert found(index, items(spark, asked), k=20) == brute(rows, asked, 20)
    monkeypatch.setattr(lexical, "PAIRS", 20)  # many blocks
    assert found(index, items(spark, asked), k=20) == brute(rows, asked, 20)


def test_segments_are_cut_and_join_again(spark):
    rows = corpus(np.random.default_rng(2), 300)
    from corpusloom.llm.lexical import _LISTS

    import pyarrow as pa

    ids, text = pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])
    held = lexical._Segment()
    for a, b, sizes, names, row, code, tf in lexical.counted(text):
        held.add(ids.slice(a, b - a), sizes, names, row, code, tf)
    batch = held.batch(5)
    assert batch.schema == _LISTS
    got = {(r["term"], batch["ids"][len(batch) - 1].as_py()[p]): f for r in batch.to_pylist() if r["term"] for p, f in zip(r["at"], r["tf"])}
    assert got == {(t, i): n for i, x in rows for t, n in collections.Counter(terms(x)).items()}


@pytest.mark.parametrize("window,short", [(16, 2), (64, 32), (7, 1000)])
def test_skipping_loses_nothing(monkeypatch, window, short):
    monkeypatch.setattr(lexical, "WINDOW", window)
    rng = np.random.default_rng(window)
    for _ in range(60):
        size, k = int(rng.integers(1, 400)), int(rng.integers(1, 12))
        sums, lists = np.zeros(size, np.int64), []
        for _ in range(rng.integers(1, 9)):
            at = np.sort(rng.choice(size, rng.integers(1, size + 1), replace=False))
            score = rng.integers(0, 6, len(at)) * int(rng.integers(1, 9))
            lists.append(lexical.Postings(at, score, -(-size // window)))
            sums[at] += score
        place = rng.permutation(size)
        want = sorted(((-s, place[i]) for i, s in enumerate(sums) if s > 0))[:k]
        at, score = lexical.best_of_segment(lists, size, place, k, short)
        assert sorted((-s, place[i]) for i, s in zip(at, score)) == want


def test_search_odd_inputs(spark):
    odd = [(1, None), (2, ""), (3, " -- "), (4, "deep " * 300_000 + "end"), (5, "end"), (5, "end"), (None, "end")]
    got = found(lexical.build_index(docs(spark, odd)), items(spark, [(0, "end deep"), (1, ""), (None, "deep")]))
    assert got == brute(odd, [(0, "end deep"), (None, "deep")])
    assert found(lexical.build_index(docs(spark, [])), items(spark, [(0, "a")])) == []
    assert found(lexical.build_index(docs(spark, [(1, "a")])), items(spark, [])) == []
