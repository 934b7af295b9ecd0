"""Rules and degenerate cases on hand-made rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions.access import most_restrictive
from corpusloom.operators import corpus as C
from corpusloom.operators import graph as G
from corpusloom.operators import rows as R
from corpusloom.operators.components import connected_components
from corpusloom.operators.identity import batch_upsert
from corpusloom.operators.joins import acronyms, similar_labels
from corpusloom.plans.ranks import numbered, spread_rank


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "source long, target long")


def nodes(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "node long")


def test_components_of_path_and_star(spark):
    path = [(i, i + 1) for i in range(1, 12)]
    star = [(100, i) for i in range(101, 110)]
    got = {r.node: r.component for r in connected_components(edges(spark, path + star + [(7, 7)])).collect()}
    assert all(got[i] == 1 for i in range(1, 13)) and all(got[i] == 100 for i in range(100, 110))


def test_components_of_nothing(spark):
    assert connected_components(edges(spark, [])).count() == 0


def test_betweenness_of_path_star_and_no_edges(spark):
    b = {r.node: r.betweenness for r in G.betweenness(edges(spark, [(1, 2), (2, 3), (3, 4)]), nodes(spark, [1, 2, 3, 4])).collect()}
    assert b[1] == b[4] == 0 and b[2] == pytest.approx(2 / 3) and b[3] == pytest.approx(2 / 3)
    s = {r.node: r.betweenness for r in G.betweenness(edges(spark, [(0, i) for i in range(1, 5)]), nodes(spark, range(5))).collect()}
    assert s[0] == pytest.approx(1.0) and s[1] == 0
    assert [r.betweenness for r in G.betweenness(edges(spark, []), nodes(spark, [1, 2])).collect()] == [0.0, 0.0]


def test_communities_split_two_cliques(spark):
    clique = lambda a: [(a + i, a + j) for i in range(5) for j in range(i + 1, 5)]
    e, n = edges(spark, clique(0) + clique(10) + [(0, 10)]), nodes(spark, [*range(5), *range(10, 15), 99])
    once = {r.node: r.community for r in G.communities(e, n).collect()}
    assert len({once[i] for i in range(5)}) == 1 and len({once[i] for i in range(10, 15)}) == 1
    assert once[0] != once[10] and once[99] not in (once[0], once[10])
    q = G.modularity(e, spark.createDataFrame(list(once.items()), "node long, community long")).first()[0]
    assert q > 0.3


def test_sampled_betweenness_keeps_within_its_error(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 40, (90, 2))] + [(i, 0) for i in range(0, 40, 3)]
    e, n = edges(spark, pairs), nodes(spark, range(40))
    exact = {r.node: r.betweenness for r in G.betweenness(e, n).collect()}
    k = G.sources_needed(40, 0.35)
    assert k < 40 and G.sources_needed(40, 0.1) > 40
    some = {r.node: r.betweenness for r in G.betweenness(e, n, error=0.35).collect()}
    assert max(abs(some[v] - exact[v]) for v in exact) <= 0.35 and some != exact
    assert {r.node: r.betweenness for r in G.betweenness(e, n, error=0.1).collect()} == pytest.approx(exact)


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1009).alias("k"))
    got = sorted((r.k, r.i) for r in numbered(df, "k", "i").collect())
    assert [i for _, i in got] == list(range(1000))


def test_spread_rank_counts_a_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("g"), (F.abs(F.xxhash64("id")) % (1 << 60)).alias("k"), "id")
    got = spread_rank(df, ["g"], "k", rows_per_range=100).where("g = 0").orderBy("k").collect()
    assert [r["rank"] for r in got] == list(range(len(got)))


def test_first_and_last_wins(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, at long")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 1), (3, "e", 2)], "k long, v string, at long")
    last = {r.k: r.v for r in R.upsert_last_wins(old, new, ["k"], "at").collect()}
    first = {r.k: r.v for r in R.insert_first_wins(old, new, ["k"], "at").collect()}
    assert last == {1: "a", 2: "c", 3: "e"} and first == {1: "a", 2: "b", 3: "d"}
    again = R.replace_by_document(R.replace_by_document(old, new, "k"), new, "k")
    assert sorted(r.v for r in again.collect()) == ["a", "c", "d", "e"]


def test_access_lattice(spark):
    df = spark.createDataFrame([("x", "open_access"), ("x", None), ("y", "odd"), ("z", None), ("w", "metadata_only"), ("w", "unknown")], "k string, c string")
    got = {r.k: r.a for r in df.groupBy("k").agg(most_restrictive("c").alias("a")).collect()}
    assert got == {"x": "open_access", "y": "user_supplied_private", "z": "user_supplied_private", "w": "unknown"}


def test_ids_and_titles(spark):
    df = spark.createDataFrame([("https://doi.org/10.48550/arXiv.2101.00001v2", None, "Crème  Brûlée — Straße"), (" doi:10.1/AB ", "arXiv:2101.00001v3", "ﬁne été")], "doi string, arxiv string, t string")
    r = df.select(X.canonical_key({"doi": "doi", "arxiv": "arxiv"}).alias("k"), X.normalize_title("t").alias("t"), X.merge_key("t").alias("m")).collect()
    assert r[0].k == "arxiv:2101.00001" and r[1].k == "doi:10.1/ab"
    assert r[0].t == "creme brulee stra e" and r[1].t == "fine ete"


def test_sections_tile_the_text(spark):
    text = "pre\n# A\nx\n## B ##\ny\n### 2. References\nz\n# C\n#no"
    docs = spark.createDataFrame([(1, text), (2, "   "), (3, "only")], "work_id long, text string")
    rows = C.sections(docs).orderBy("work_id", "ordinal").collect()
    one = [r for r in rows if r.work_id == 1]
    assert [r.level for r in one] == [0, 1, 2, 3, 1] and one[3].path == "A > B > 2. References" and one[3].kind == "references" and one[4].parent is None
    assert "".join(text[r.start_char : r.end_char] for r in one) == text
    assert [r.work_id for r in rows if r.work_id != 1] == [3]


def test_paragraphs_are_verbatim(spark):
    text = "\n\n a b\nc  \n\n \n\td\n"
    rows = C.paragraph_spans(spark.createDataFrame([(1, text)], "work_id long, text string")).orderBy("start_char").collect()
    assert [r.exact_quote for r in rows] == ["a b\nc", "d"] and all(text[r.start_char : r.end_char] == r.exact_quote for r in rows)


def test_unique_offset(spark):
    df = spark.createDataFrame([("abcabc", "abc"), ("xaaax", "aa"), ("héllo 😀z", "z"), ("a", "b")], "t string, q string")
    assert [r[0] for r in df.select(X.unique_offset(F.col("t"), F.col("q"))).collect()] == [None, None, 7, None]


def test_chunks_cover_units(spark):
    units = spark.createDataFrame([(1, i * 100, i * 100 + 100) for i in range(10)] + [(1, 1000, 5000), (1, 5000, 5040)], "d long, start_char long, end_char long")
    rows = C.chunk_plan(units, "d", 60, 5).orderBy("chunk").collect()
    assert [r.oversize for r in rows] == [False] * 5 + [True, False] and rows[1].start_char == 180 and rows[-1].end_char == 5040


def test_label_joins(spark):
    labels = spark.createDataFrame([("a", "masked language model"), ("b", "language model masked"), ("c", "mlm"), ("d", "other thing"), ("e", "x")], "k string, t string").withColumn("g", F.lit(1))
    assert [(r.a, r.b) for r in similar_labels(labels, "k", "t", ["g"], 0.6).collect()] == [("a", "b")]
    assert [(r.a, r.b) for r in acronyms(labels, "k", "t", ["g"]).collect()] == [("c", "a")]


def test_batch_upsert(spark):
    rec = spark.createDataFrame([(1, ["x", "y"], "t"), (2, ["y"], "t"), (3, ["k1"], "u"), (4, ["k1", "k2"], "v"), (5, ["q"], "t")], "rec long, ids array<string>, title string")
    known = spark.createDataFrame([("k1", 10), ("k2", 20)], "id string, work_id long")
    got = {r.rec: (r.work, r.decision, r.title_collision) for r in batch_upsert(rec, "rec", F.col("ids"), known, "title").collect()}
    assert got[1] == ("new:1", "create", True) and got[2][:2] == ("new:1", "merge") and got[3][1] == got[4][1] == "duplicate_candidate" and got[5][2]


def test_composing_holds_few_texts_of_a_batch_at_a_time():
    import tracemalloc

    import pyarrow as pa

    texts = pa.array(["é " * 20_000, None, "", "Å"] * 200)
    tracemalloc.start()
    try:
        got = X.nfc.func(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got.slice(0, 4).to_pylist() == ["é " * 20_000, None, "", "Å"] and got.slice(4).equals(got.slice(0, 796)) and X.nfc.func(texts.slice(0, 0)).to_pylist() == []
    assert peak < 8 << 20 < texts.nbytes
