"""Lists of places are made inside a text's row, not by a shuffle of its words."""

from pyspark.sql import functions as F

from corpusloom.operators.textindex import _vocabulary, list_rows, posting_rows, spread
from corpusloom.plans.scalars import f24_inverted_abstract


def test_lists_are_the_places(spark):
    texts = ["a b a c b a", "", None, "x", "Über über ÜBER", "é e\n\nE 1 1"]
    d = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    lists = list_rows(d, "k", "text")
    want = sorted(map(tuple, posting_rows(d, "k", "text").select("k", "token", "pos", "size").collect()))
    assert sorted(map(tuple, spread(lists).select("k", "token", "pos", "size").collect())) == want and len(want) == 15
    assert all(r.at == sorted(r.at) for r in lists.collect()) and lists.groupBy("k", "token").count().where("count > 1").isEmpty()
    plan = _vocabulary(lists.withColumn("bucket", F.lit(0)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # partial counts by token; no row for each text and token


def test_inverted_abstract_needs_no_shuffle(spark, tmp_path):
    texts = ["a b a", "", None, " x  y "]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    from corpusloom.registry import Tables

    got = f24_inverted_abstract(Tables(spark, str(tmp_path)))
    assert {r.doc_id: r.abstract for r in got.collect()} == dict(enumerate(texts))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_best_of_copies_equals_bm25_over_all_rows(spark):
    from corpusloom.operators import search as S
    from corpusloom.operators.textindex import index_texts

    texts = ["red bolt", "red bolt bolt", "blue anvil", "bolt", None, "", "red red bolt here"]
    docs = spark.createDataFrame([(i, texts[i * i % 7]) for i in range(60)], "id long, t string")
    units = spark.createDataFrame([(1, "red bolt"), (1, "anvil"), (2, "bolt"), (3, "nothing")], "question long, unit string")
    plain = S.best_items(S.bm25(index_texts(docs, "id", "t"), units).withColumnRenamed("id", "item_id"), 5, "x")
    got = S.best_of_copies(docs, "id", "t", units, 5, "x")
    row = lambda r: (r.question, r.item_id, r.kind, round(r.score, 9))
    assert sorted(map(row, got.collect())) == sorted(map(row, plain.collect())) != []


def test_questions_alike_in_what_texts_hold_are_scored_once(spark):
    from corpusloom.operators import search as S
    from corpusloom.operators.textindex import index_texts

    texts = ["red bolt", "red bolt bolt", "blue anvil", "bolt", None, "", "red red bolt here"]
    index = index_texts(spark.createDataFrame([(i, texts[i * i % 7]) for i in range(60)], "id long, t string"), "id", "t")
    asked = [(q, u) for q in range(30) for u in ("red bolt" if q % 2 else "bolt", "anvil", f"lost {q}")]
    units = spark.createDataFrame([*asked, (99, "nothing")], "question long, unit string")
    plain = S.best_items(S.bm25(index, units).withColumnRenamed("id", "item_id"), 5, "x")
    shares = S._shares(index, units)
    alike = S._alike(shares, units)
    assert {(r.question, r["first"]) for r in alike.collect()} == {(q, q % 2) for q in range(30)}
    assert {r.question for r in S._scores(shares, S._of_firsts(alike, units), "id").collect()} == {0, 1}
    row = lambda r: (r.question, r.item_id, r.kind, round(r.score, 9))
    got = sorted(map(row, S.best_matches(index, units, 5, "x").collect()))
    assert got == sorted(map(row, plain.collect())) and len(got) == 150


def test_first_items_of_groups_are_cut_before_the_shuffle(spark):
    from corpusloom.operators.search import first_of_groups

    rows = [(g, f"{(i * 7) % 50:02}") for g in ("a", "b") for i in range(50) for _ in range(3)] + [("c", "x")]
    got = first_of_groups(spark.createDataFrame(rows, "g string, i string").repartition(3), "g", "i", 20)
    assert sorted((r.g, r.i) for r in got.collect()) == sorted([(g, f"{i:02}") for g in ("a", "b") for i in range(20)] + [("c", "x")])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan[plan.index("WindowGroupLimit") :]


def test_merged_search_shuffles_no_row_for_each_question_and_claim(spark):
    from corpusloom import registry

    plan = registry.queries()["r9_merged"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "dense_rank" in plan and plan.count("l_orderkey") > 0  # claims of concepts are cut to twenty a concept before questions meet them
