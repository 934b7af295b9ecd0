"""Row numbers and top-k without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.plans.lineage import stored


def spread_rank(df: DataFrame, group: list[str], order: str, rows_per_range: int = 50_000, ties: list[str] | None = None, few: bool = False) -> DataFrame:
    """Adds ``rank`` (from 0) of each row in its group by ascending ``order``.

    ``order`` is a column of uniformly spread non-negative longs below 2**60
    (a hash). Each group is cut into ranges of ``order``, as many as its rows
    need, so a group with a third of all rows is ranked by many tasks; rows
    that tie on ``order`` stay in one range and tie-break on ``ties`` (all
    columns left, if not given).

    ``few`` says that the caller bounds the groups and ranges (of which there
    is one for each ``rows_per_range`` rows, and one more a group): their sizes
    are then broadcast, and rows are shuffled once, for the numbering.
    """
    sent = F.broadcast if few else (lambda x: x)
    ties = [c for c in df.columns if c not in group and c != order] if ties is None else ties
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.ceil(F.col("_n") / rows_per_range).alias("_parts"))
    match = F.lit(True)
    for i, c in enumerate(group):
        match = match & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    cut = df.join(sent(sizes), match).drop(*[f"_g{i}" for i in range(len(group))])
    cut = cut.withColumn("_range", (F.col(order) / F.lit(float(1 << 60)) * F.col("_parts")).cast("long")).drop("_parts")
    counts = cut.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    starts = starts.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_range").alias("_r"), "_start")
    inside = W.partitionBy(*group, "_range").orderBy(order, *ties)
    numbered = cut.withColumn("_i", F.row_number().over(inside) - 1)
    return (
        numbered.join(sent(starts), match & (F.col("_range") == F.col("_r")))
        .withColumn("rank", (F.col("_start") + F.col("_i")).cast("long"))
        .drop("_start", "_i", "_range", "_r", *[f"_g{i}" for i in range(len(group))])
    )


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """``df`` with the number (from 0) of each row in ascending ``order``, whose values differ: sorted by range, each range numbered by itself behind the rows before it."""
    laid = stored(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    starts = laid.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    at = F.row_number().over(W.partitionBy("_part").orderBy(order)) - 1
    return laid.withColumn("_i", at).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_i")).drop("_part", "_i", "_start")


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the first in ``order`` (min_by on a struct, so it combines map-side)."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])
