"""Tables kept by document, and the index kept so: replacement, replay, failures, odd rows."""

import collections
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import corpus as C
from corpusloom.operators import search as S
from corpusloom.operators.kept import Kept, exists, names
from corpusloom.operators.textindex import index_texts, kept_index, open_index, posting_rows
from corpusloom.streaming import events as E

DOC = "work_id long, text string, seen int, bucketed string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, v, "x") for i, t, v in rows], DOC)


def as_set(df):
    return collections.Counter(tuple(str(x) for x in r) for r in df.collect())


def parts(mark):
    return lambda d: d.select("work_id", F.explode(F.split("text", mark)).alias("part")).where("part <> ''")


LIGHT = {"lines": parts("\n"), "words": parts(" ")}


def kept(tmp_path, builds=LIGHT, version="seen"):
    return Kept(str(tmp_path / "kept"), "work_id", "text", builds, version=version, buckets=3)


FIRST = [(1, "# A\n\none", 1), (2, "two\n\nthree", 1), (3, "# C\n\n## D\n\nfour", 1), (4, "gone soon", 1), (5, None, 1), (None, "no key", 1)]
SECOND = [(2, "# New\n\nsecond", 2), (4, "", 2), (6, "fresh", 2), (6, "older fresh", 1), (1, "stale", 0)]
NOW = [(1, "# A\n\none", 1), (2, "# New\n\nsecond", 2), (3, "# C\n\n## D\n\nfour", 1), (6, "fresh", 2)]


def test_replaced_documents_equal_a_rebuild(spark, tmp_path):
    k, some = kept(tmp_path, {"sections": C.sections, "spans": C.paragraph_spans}), docs(spark, [])
    k.apply(docs(spark, FIRST), 0)
    k.apply(docs(spark, SECOND), 1)
    for table, build in k.builds.items():
        want = as_set(build(docs(spark, NOW)))
        assert want and as_set(k.read(some, table).drop("bucket")) == want
    k.apply(docs(spark, SECOND), 1)  # the same batch again
    k.apply(docs(spark, SECOND), 2)  # the same content again
    k.apply(docs(spark, FIRST), 3)  # older versions
    k.apply(some, 4)
    for table, build in k.builds.items():
        assert as_set(k.read(some, table).drop("bucket")) == as_set(build(docs(spark, NOW)))
    assert {(r.work_id, r.version) for r in k.read(some, "documents").collect()} == {(1, 1), (2, 2), (3, 1), (4, 2), (5, 1), (6, 2)}


@pytest.mark.parametrize("at", ["lines", "documents"])
@pytest.mark.parametrize("half", [False, True])
def test_a_failed_batch_is_made_good_when_run_again(spark, tmp_path, monkeypatch, at, half):
    k, some = kept(tmp_path), docs(spark, [])
    k.apply(docs(spark, FIRST), 0)
    whole = Kept._written

    def fails(self, rows, table, path):
        if table == at and ("/_batch=" in path) != half:
            if half:  # the overwrite breaks off: one touched bucket is gone
                from corpusloom.operators.kept import remove

                remove(spark, f"{path}/{[n for n in names(spark, path) if n.startswith('bucket=')][0]}")
            raise RuntimeError("lost")
        whole(self, rows, table, path)

    monkeypatch.setattr(Kept, "_written", fails)
    everything = SECOND + [(i, t, 3) for i, t, _ in NOW if i in (1, 3)]
    with pytest.raises(RuntimeError):
        k.apply(docs(spark, everything), 1)
    monkeypatch.setattr(Kept, "_written", whole)
    k.apply(docs(spark, everything), 1)
    for table, build in k.builds.items():
        assert as_set(k.read(some, table).drop("bucket")) == as_set(build(docs(spark, NOW)))


def test_without_a_version_the_last_to_arrive_stays(spark, tmp_path):
    k, some = kept(tmp_path, version=None), docs(spark, [])
    for i, text in enumerate(["a", "b", "a"]):
        k.apply(docs(spark, [(1, text, 0)]), i)
    assert [r.part for r in k.read(some, "lines").collect()] == ["a"]


def test_streams_replace_documents(spark, tmp_path):
    k = kept(tmp_path)
    schema = docs(spark, []).schema
    for i, rows in enumerate([FIRST, SECOND]):
        docs(spark, rows).write.parquet(str(tmp_path / f"in{i}"))
        E.maintain(spark.readStream.schema(schema).parquet(str(tmp_path / f"in{i}")), k, str(tmp_path / f"state{i}"), first=10 * i).awaitTermination()
    assert as_set(k.read(docs(spark, []), "words").drop("bucket")) == as_set(LIGHT["words"](docs(spark, NOW)))
    assert not exists(spark, f"{k.base}/_batch=0")


def words(t):
    return [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]


def test_kept_index_equals_an_index_of_the_present_texts(spark, tmp_path):
    k, some = kept_index(str(tmp_path / "index"), "work_id", "text", version="seen", buckets=3), docs(spark, [])
    k.apply(docs(spark, FIRST), 0)
    k.apply(docs(spark, SECOND), 1)
    assert as_set(k.read(some, "postings").select("work_id", "size", "pos", "token")) == as_set(posting_rows(docs(spark, NOW), "work_id", "text").select("work_id", "size", "pos", "token"))
    vocabulary = {r.token: (r.df, r.n, r.most) for r in k.read(some, "vocabulary").groupBy("token").agg(F.sum("df").alias("df"), F.sum("n").alias("n"), F.max("most").alias("most")).collect()}
    each = [collections.Counter(words(t)) for _, t, _ in NOW]
    assert vocabulary == {w: (sum(w in c for c in each), sum(c[w] for c in each), max(c[w] for c in each)) for c in each for w in c}
    totals = k.read(some, "totals").agg(F.sum("docs"), F.sum("words")).first()
    assert tuple(totals) == (4, sum(sum(c.values()) for c in each))


def test_phrases_equal_brute_force(spark, tmp_path):
    texts = {1: "a b a b a b c", 2: "x a b c d e", 3: "a-b, C d? e", 4: "ba b c", 5: "", 6: None, 7: "ha ha ha ha", 8: "c d e a b"}
    asked = ["a b", "a b c d e", "ha ha", "ha ha ha", "b", "zz b", "c zz d", "A  B!", "", "e", "a b a b"]
    rows, units = docs(spark, [(i, t, 0) for i, t in texts.items()]), spark.createDataFrame([(u,) for u in asked], "unit string")
    k = kept_index(str(tmp_path / "index"), "work_id", "text", buckets=2)
    k.apply(rows, 0)

    def count(t, u):
        t, u = words(t), words(u)
        return sum(t[i : i + len(u)] == u for i in range(len(t) - len(u) + 1)) if u else 0

    want = {(u, i): n for u in asked for i, t in texts.items() if (n := count(t, u))}
    for index in (open_index(k, rows), index_texts(rows, "work_id", "text")):
        got = {(r.unit, r.work_id): r.tf for r in S.match_counts(index, units).collect()}
        assert got == want
        few = {(r.unit, r.work_id): r.tf for r in S.match_counts(index.where("work_id > 2"), units).collect()}
        assert few == {k: n for k, n in want.items() if k[1] > 2}


def test_best_of_a_question_are_cut_before_the_shuffle(spark):
    found = spark.range(100).selectExpr("id % 3 as question", "id as item_id", "cast(id % 7 as double) as score")
    plan = S.best_items(found, 4, "span")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial") and plan.count("WindowGroupLimit") == 2
    for q in range(3):
        want = sorted((i % 7, i) for i in range(100) if i % 3 == q)[:4]
        assert sorted((r.score, r.item_id) for r in S.best_items(found, 4, "span").where(f"question = {q}").collect()) == want


def test_copies_of_a_batch_go_with_it(spark, tmp_path):
    """A batch's copies are as large as what it yields; none is left behind, or lies beside the next table's."""
    k = Kept(str(tmp_path / "kept"), "doc_id", "text", {"words": lambda d: d.selectExpr("doc_id", "explode(split(text, ' ')) as word")}, {"counts": ("words", lambda w: w.groupBy("bucket", "word").count())})
    for i, texts in enumerate((["a b", "c"], ["a b b", "c c"], ["a b b", "c c"])):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        k.apply(docs, i)
        assert not [n for n in names(spark, f"{k.base}/_batch={i}") if n != "changed" or i < 2]
        assert {"counts", "documents", "words"} <= set(names(spark, k.base))
    assert sorted((r.word, r["count"]) for r in k.read(docs, "counts").collect()) == [("a", 1), ("b", 2), ("c", 2)]
