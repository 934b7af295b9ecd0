"""Currency, first and last wins, top-k: which of several rows stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The row of each key that is greatest in ``order``, by a map-side combined max."""
    rest = [c for c in df.columns if c not in keys]
    got = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return got.select(*[c if c in keys else F.col("_r")[c].alias(c) for c in df.columns])


def earliest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The row of each key that is least in ``order``."""
    rest = [c for c in df.columns if c not in keys]
    got = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return got.select(*[c if c in keys else F.col("_r")[c].alias(c) for c in df.columns])


def top_k(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The first ``k`` rows in ``order`` (a TakeOrdered: no full sort)."""
    return df.orderBy(*order).limit(k)


def top_k_by(df: DataFrame, keys: list[str], k: int, *order: Column, name: str = "place") -> DataFrame:
    """The first ``k`` rows of each key, numbered from 1."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def insert_first_wins(old: DataFrame, new: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """``old`` and those rows of ``new`` whose key it lacks, the first of each key."""
    fresh = earliest(new, keys, *order) if order else new.dropDuplicates(keys)
    return old.unionByName(fresh.join(old.select(*keys).distinct(), keys, "left_anti").select(*old.columns))


def upsert_last_wins(old: DataFrame, new: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Both tables with one row a key, the greatest in ``order``; a tie goes to ``new``."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, keys, *order, "_new").drop("_new")


def replace_by_document(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` without the documents that ``new`` has, and ``new``: the same again when repeated."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)
