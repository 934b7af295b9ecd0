"""Integrity checks, retrieval metrics and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def foreign_keys(rows: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(check, broken): for each declared (name, child, column, parent, key), how many distinct child keys the parent lacks."""
    out = [c.select(F.col(k).alias("k")).where("k is not null").distinct().join(p.select(F.col(pk).alias("k")), "k", "left_anti").agg(F.count(F.lit(1)).alias("broken")).select(F.lit(name).alias("check"), "broken") for name, c, k, p, pk in rows]
    return reduce(DataFrame.unionByName, out)


def ranking_metrics(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Per question: recall at k, precision at k, reciprocal rank of (question, item, place) against (question, item)."""
    want = gold.select("question", "item").distinct()
    total = want.groupBy("question").agg(F.count(F.lit(1)).alias("relevant"))
    hit = ranked.join(want, ["question", "item"]).groupBy("question").agg(F.count_if(F.col("place") <= k).alias("hits"), F.min("place").alias("first"))
    got = total.join(hit, "question", "left")
    return got.select("question", F.round(F.coalesce("hits", F.lit(0)) / F.col("relevant"), 6).alias("recall"), F.round(F.coalesce("hits", F.lit(0)) / k, 6).alias("precision"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"))


def rate(df: DataFrame, name: str, condition: Column, empty: float = 0.0) -> DataFrame:
    """(metric, value): the share of rows that meet the condition, ``empty`` if there are none."""
    n = F.count(F.lit(1))
    return df.agg(F.when(n > 0, F.count_if(condition) / n).otherwise(F.lit(empty)).alias("value")).select(F.lit(name).alias("metric"), F.round("value", 6).alias("value"))


def report(*metrics: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, metrics)


def boundary_leaks(shared: DataFrame, private: DataFrame, key: str) -> DataFrame:
    """Ids in shareable output that are private."""
    return shared.select(key).distinct().join(private.select(key), key, "left_semi")


def gold_failures(expected: DataFrame, present: DataFrame, keys: list[str], what: str) -> DataFrame:
    """Expected rows that are missing, named."""
    return expected.select(*keys).distinct().join(present.select(*keys).distinct(), keys, "left_anti").select(F.lit(what).alias("failure"), F.concat_ws(">", *[F.col(k).cast("string") for k in keys]).alias("subject"))


def first_verdicts(verdicts: DataFrame, key: str, at: str) -> DataFrame:
    """The first resolution of each item stays."""
    rest = [c for c in verdicts.columns if c != key]
    got = verdicts.groupBy(key).agg(F.min_by(F.struct(*rest), at).alias("v"))
    return got.select(key, *[F.col("v")[c].alias(c) for c in rest])


def bibliography_overlap(found: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    n = expected.select(*keys).distinct()
    hit = n.join(found.select(*keys).distinct(), keys, "left_semi").agg(F.count(F.lit(1)).alias("hit"))
    return n.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(hit)).select(F.round(F.coalesce(F.try_divide("hit", "n"), F.lit(0.0)), 6).alias("overlap"))  # one row each


#: Shares of wrongly joined and of missed merges beyond which a report says so.
NOISE_TOLERANCE = {"over_merge": 0.15, "under_merge": 0.25}


def merge_noise(verdicts: DataFrame) -> DataFrame:
    """(metric, value, beyond) of graded merges (verdict): shares of over- and under-merges, and whether they pass the tolerance."""
    rates = [rate(verdicts, f"{v}_rate", F.col("verdict") == v).withColumn("beyond", F.lit(False)) for v in NOISE_TOLERANCE]
    n = F.count(F.lit(1))
    exact = [verdicts.agg((F.count_if(F.col("verdict") == v) > n * limit).alias("beyond")) for v, limit in NOISE_TOLERANCE.items()]
    return report(*[r.drop("beyond").join(F.broadcast(e)) for r, e in zip(rates, exact)])  # one row each


def faithful(cited: DataFrame, retrieved: DataFrame, project: DataFrame) -> DataFrame:
    """(answer, cited, unfaithful, faithful): cited works (answer, work_id) that were not retrieved for the answer or are not in the project."""
    mark = lambda df, name: df.withColumn(name, F.lit(True))
    got = cited.select("answer", "work_id").distinct().join(mark(retrieved.select("answer", "work_id").distinct(), "_r"), ["answer", "work_id"], "left").join(mark(project.select("work_id").distinct(), "_p"), "work_id", "left")
    bad = F.count_if(F.col("_r").isNull() | F.col("_p").isNull())
    return got.groupBy("answer").agg(F.count(F.lit(1)).alias("cited"), bad.alias("unfaithful"), (bad == 0).alias("faithful"))
