"""Ranked lists, seeded samples and ordered unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.operators.rows import top_k, top_k_by


def read_next(scores: DataFrame, read: DataFrame, score: str, k: int) -> DataFrame:
    """The best-scored works that are not read yet."""
    return top_k(scores.join(read, "work_id", "left_anti"), k, F.desc(score), "work_id")


def worklist(works: DataFrame, edges: DataFrame, gate: DataFrame, k: int) -> DataFrame:
    """Works by how many works cite them, of those that pass the gate; the gate comes before the cut."""
    cited = edges.groupBy(F.col("target").alias("work_id")).agg(F.countDistinct("source").alias("cited_by"))
    got = works.join(gate, "work_id", "left_semi").join(cited, "work_id", "left").withColumn("cited_by", F.coalesce("cited_by", F.lit(0)))
    return top_k(got.select("work_id", "cited_by"), k, F.desc("cited_by"), "work_id")


def label_cutoff(degrees: DataFrame, enough: int = 30, wide: int = 50) -> DataFrame:
    """The largest degree that at least ``enough`` concepts reach; one more if that is over ``wide``; 1 if none."""
    h = degrees.groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    # one row for each degree that occurs
    c = h.withColumn("at_least", F.sum("n").over(W.orderBy(F.desc("degree")).rowsBetween(W.unboundedPreceding, 0)))
    m = c.where(F.col("at_least") >= enough).agg(F.max("degree").alias("d"))
    return m.select(F.when(F.col("d").isNull(), 1).when(F.col("d") > wide, F.col("d") + 1).otherwise(F.col("d")).cast("long").alias("cutoff"))


def seeded_sample(rows: DataFrame, kind: str, key: str, seed: int, size: int) -> DataFrame:
    """``size`` rows of each kind (all if fewer), the same for the same seed."""
    return top_k_by(rows, [kind], size, F.md5(F.concat(F.lit(f"{seed}:"), F.col(key))), F.col(key))


def priority_union(branches: list[DataFrame], key: str, k: int) -> DataFrame:
    """Each key once, from the first branch that has it, the first ``k``."""
    rows = reduce(DataFrame.unionByName, [b.select(key, F.lit(i).alias("branch")) for i, b in enumerate(branches)])
    return top_k(rows.groupBy(key).agg(F.min("branch").alias("branch")), k, "branch", key)
