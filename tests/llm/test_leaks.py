"""Decontamination: exact, reworded, short and long items are found, and the latent space finds them for its own reason."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate as dc

DIR = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, key string, leaks string, body string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "k", "l", "b") for i, t in rows], DOC)


ODD = [(1, None), (2, ""), (3, "one"), (3, "one"), (4, "word " * 60_000), (5, "a b c d e f"), (None, "a b c d e f"), (7, " \n\t ")]


@pytest.fixture(scope="module")
def given(spark):
    d = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    b = spark.read.parquet(f"{DIR}/benchmark.parquet")
    return d, b, dc.latent_space(d)


def brute(texts, items, share=0.6, sure=0.75):
    """Pairs whose common subsequence in some stretch of the text is long enough, by plain dynamic programming over all stretches."""
    out = set()
    low = {k: dc._hashes(x) for k, x in items.items()}
    tails = {k: dc._hashes([s for s in x.replace("!", ".").replace("?", ".").replace("\n", ".").split(".") if dc._hashes(s)][-1]) for k, x in items.items()}
    for i, t in texts.items():
        h = dc._hashes(t or "")
        for k, x in low.items():
            if not len(set(x) & set(h)) >= share * len(set(x)) * 0.5:
                continue
            m = len(x)
            for a in range(0, max(1, len(h)), dc.HALF):
                near = h[max(0, a - dc.HALF - m // 2) : a + 2 * dc.HALF + m + m // 2]
                n = dc.lcs_length(dc.lcs_masks(x), m, near)
                if n >= share * m and (n >= sure * m or dc.lcs_length(dc.lcs_masks(tails[k]), len(tails[k]), near) >= sure * len(tails[k])):
                    out.add((i, k))
                    break
    return out


def test_equals_brute_force_on_the_given_rows(spark, given):
    """The same checks over all pairs, without the candidate search: it loses nothing here."""
    d, b, space = given
    texts, items = {r.doc_id: r.text for r in d.collect()}, {r.item_id: r.text for r in b.collect()}
    got = {(r.doc_id, x.item_id) for r in dc.find_leaks(d, b, space=space).collect() for x in r.leaks}
    exact = {(i, k) for i, t in texts.items() for k, x in items.items() if x in (t or "")}
    assert exact and exact <= got
    assert got == brute(texts, items)


def test_reworded_items(spark, given):
    """Every sixth word replaced, or every fourth followed by another: found. The same words in another order: not."""
    d, b, space = given
    items = [(r.item_id, r.text) for r in b.orderBy("item_id").limit(40).collect()]
    rng = np.random.default_rng(4)
    filler = [r.text for r in d.where("length(text) between 300 and 2000").orderBy("doc_id").limit(40).collect()]
    rows = []
    for i, (k, x) in enumerate(items):
        w = x.split()
        swapped = [v if (j + i) % 6 else "other" for j, v in enumerate(w)]
        added = [z for j, v in enumerate(w) for z in ((v, "indeed") if j % 4 == 0 else (v,))]
        around = filler[i % len(filler)]
        for c, t in enumerate((" ".join(v.upper() if v.isascii() else v for v in swapped), " ".join(added))):
            rows.append((i * 10 + c, around[:200] + " . " + t + " . " + around[200:]))
        rows.append((i * 10 + 5, " ".join(rng.permutation(w))))
    found = {r.doc_id: {x.item_id for x in r.leaks} for r in dc.find_leaks(docs(spark, rows), b, space=space).collect()}
    hit = [k in found[i * 10 + c] for i, (k, _) in enumerate(items) for c in (0, 1)]
    assert np.mean(hit) >= 0.97
    assert sum(k in found[i * 10 + 5] for i, (k, _) in enumerate(items)) <= 2


def test_words_that_share_passages_are_near(spark):
    """Two words that never meet but have the same neighbours: near in the latent space, though they share no word."""
    rng = np.random.default_rng(6)
    topics = [[f"t{i}w{j}" for j in range(30)] for i in range(20)]
    rows = []
    for n in range(3000):
        i = n % 20
        own = list(rng.choice(topics[i], 40)) + [f"car{i}" if n % 40 < 20 else f"auto{i}"] * 2
        rows.append((n, " ".join(rng.permutation(own))))
    space = dc.latent_space(docs(spark, rows), rank=20)
    at = lambda w: dc._unit(space.place(np.array(dc._hashes(w), np.uint64), np.zeros(1, np.int64), 1, 48))[0]
    near = [float(at(f"car{i}") @ at(f"auto{i}")) for i in range(20)]
    far = [float(at(f"car{i}") @ at(f"auto{(i + 1) % 20}")) for i in range(20)]
    assert np.median(near) > 0.8 and np.median(np.abs(far)) < 0.3


def test_space_approximates_the_leading_singular_vectors(spark):
    """On a small matrix with few topics, V spans what a full decomposition does."""
    rng = np.random.default_rng(7)
    topics = [[f"t{i}w{j}" for j in range(12)] for i in range(6)]
    rows = [(n, " ".join(rng.choice(topics[n % 6], 48))) for n in range(400)]
    df = docs(spark, rows)
    space = dc.latent_space(df, rank=6)
    h = [np.array(dc._hashes(t), np.uint64) for _, t in rows]
    a = np.zeros((len(rows), dc.COLUMNS))
    for r, x in enumerate(h):
        np.add.at(a[r], dc._column(x), space.idf[dc._bucket(x)])
        y = dc.sketch(x, space.idf, np.zeros(len(x), np.int64), 1)
        a[r] /= np.linalg.norm(y)
    _, s, v = np.linalg.svd(a, full_matrices=False)
    own = np.linalg.qr(space.vectors.astype(float))[0]
    # sines of the angles between the two leading spaces
    assert np.linalg.svd(own.T @ v[:6].T)[1].min() > 0.9


def test_short_items(spark):
    b = spark.createDataFrame([(1, "What is it?"), (2, "the quick brown fox jumps"), (3, "word"), (4, "..."), (5, "a b c d")], "item_id long, text string")
    rows = [(1, "so what is it then"), (2, "What is it"), (3, "see The quick, brown fox jumps over"), (4, "the quick red brown fox jumps"), (5, "word"), (6, "a word"), (7, "a b c d e f"), (8, "...")]
    got = {r.doc_id: [x.item_id for x in r.leaks] for r in dc.find_leaks(docs(spark, rows), b).collect()}
    assert got == {1: [], 2: [1], 3: [2], 4: [], 5: [3], 6: [], 7: [5], 8: []}


def test_odd_rows_blocks_and_clashing_names(spark, given):
    d, b, space = given
    item = b.orderBy("item_id").first()
    rows = [*ODD, (9, item.text), (9, item.text), (10, "word " * 30_000 + item.text + " word" * 30_000)]
    got = dc.find_leaks(docs(spark, rows), b, space=space)
    assert got.columns == ["doc_id", "text", "key", "body", "leaks"]
    found = got.collect()
    assert len(found) == len(rows) and sorted(r.doc_id for r in found if r.leaks) == [9, 9, 10] and {r.key for r in found} == {"k"}
    same = lambda n: sorted((r.doc_id or 0, sorted(x.item_id for x in r.leaks)) for r in dc.find_leaks(d, b, space=space, item_block=n).collect())
    assert same(17) == same(10_000)
    assert dc.find_leaks(docs(spark, []), b).count() == 0
    none = dc.find_leaks(docs(spark, rows), b.limit(0)).collect()
    assert len(none) == len(rows) and not any(r.leaks for r in none)
    odd = spark.createDataFrame([(None, "x y z"), (1, None), (2, "")], "item_id long, text string")
    assert dc.find_leaks(docs(spark, rows), odd).where(F.size("leaks") > 0).count() == 0


def test_runs():
    h = np.arange(10, dtype=np.uint64)
    assert len(dc._runs(h, 3)) == 8 and len(set(dc._runs(h, 3).tolist())) == 8 and pa.array(dc._runs(h, 10)).null_count == 0


@pytest.mark.parametrize(("words", "groups", "often"), [(0, 1, 24), (5000, 3, 24), (60000, 2500, 24), (60000, 2500, 10**9), (9000, 4100, 1)])
def test_products_of_common_and_rare_columns(words, groups, often, monkeypatch):
    monkeypatch.setattr(dc, "OFTEN", often)
    rng = np.random.default_rng(words)
    column = np.minimum(rng.geometric(0.002, words) * 7, dc.COLUMNS - 1)
    group, weight, q = np.sort(rng.integers(0, groups, words)), rng.random(words), rng.standard_normal((groups, 5)).astype(np.float32)
    want = np.zeros((dc.COLUMNS, 5))
    np.add.at(want, column, q[group] * weight[:, None])
    out = np.ones((5, dc.COLUMNS), np.float32)
    dc._add_product(out, q, column, weight, group)
    assert np.allclose(out - 1, want.T, atol=2e-3)


def test_items_are_not_ruled_out_by_their_repeats():
    space = dc.Space(np.ones(dc.BUCKETS), np.ones((dc.COLUMNS, 2)))
    items = dc.Items([(1, "ho ho ho ho ho ho ho the end is near", None), (2, "a b c d e f g h i j", None)], space)
    assert items.repeats == [6, 0] and [len(x) for x in items.words] == [5, 10]


def test_no_stretch_is_ruled_out_that_holds_enough_words():
    rng = np.random.default_rng(5)
    space = dc.Space(np.ones(dc.BUCKETS), np.ones((dc.COLUMNS, 2)))
    vocabulary = [f"w{i}" for i in range(400)]
    items = dc.Items([(i, " ".join(rng.choice(vocabulary, 12)), None) for i in range(20)], space)
    blocks = [dc._hashes(" ".join(rng.choice(vocabulary, dc.HALF))) for _ in range(60)]
    seen = np.stack([np.bitwise_or.reduce(dc._marks(np.array(b, np.uint64))) for b in blocks] + [np.zeros(4, np.uint64)])
    lo, item = np.repeat(np.arange(58), 20), np.tile(np.arange(20), 58)
    held = np.array([sum(items.counts[i][x] for x in items.words[i].intersection(blocks[a] + blocks[a + 1] + blocks[a + 2])) for a, i in zip(lo, item)])
    for least in (1, 2, 3):
        ok = items.possible(seen, lo, lo + 3, item, np.full(len(lo), float(least)))
        assert set(np.flatnonzero(held >= least)) <= set(ok) and len(ok) < len(lo)
    assert not len(items.possible(seen, lo[:0], lo[:0], item[:0], np.zeros(0)))
