"""Windows: prefixes under a budget, latches, offsets, islands, carried values, outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def budget_prefix(df: DataFrame, keys: list[str], order: list[Column], tokens: str, cap: int) -> DataFrame:
    """Ranked rows of each key while their running tokens stay within ``cap``; the first stays always."""
    w = W.partitionBy(*keys).orderBy(*order)
    run = F.sum(tokens).over(w.rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("place", F.row_number().over(w)).withColumn("running", run).where((F.col("running") <= cap) | (F.col("place") == 1))


def dispositions(df: DataFrame, keys: list[str], order: list[Column], tokens: str, cap: int, most: int) -> DataFrame:
    """shown, cut_budget or cut_rank for each ranked candidate."""
    w = W.partitionBy(*keys).orderBy(*order)
    place, run = F.row_number().over(w), F.sum(tokens).over(w.rowsBetween(W.unboundedPreceding, 0))
    d = df.withColumn("place", place).withColumn("_run", run)
    what = F.when(F.col("place") > most, "cut_rank").when((F.col("_run") <= cap) | (F.col("place") == 1), "shown").otherwise("cut_budget")
    return d.withColumn("disposition", what).drop("_run")


def spend_latch(usage: DataFrame, keys: list[str], order: list[str], cost: str, limit: float) -> DataFrame:
    """Running spend of each key; ``stopped`` is set for every row after the limit is reached."""
    w = W.partitionBy(*keys).orderBy(*order)
    d = usage.withColumn("running", F.sum(F.coalesce(F.col(cost), F.lit(0.0))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    before = F.coalesce(F.max("running").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return d.withColumn("stopped", before >= limit)


def line_rows(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, line, body, start, end): lines at \\n, offsets in code points; the break belongs to no line.

    Offsets are a running sum inside the split array, so no shuffle is needed.
    """
    parts = F.split(text, "\n")
    starts = F.aggregate(parts, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(x) + 1)))
    d = docs.select(doc, parts.alias("_p"), starts.alias("_s"))
    e = d.select(doc, F.posexplode(F.arrays_zip(F.col("_p"), F.slice(F.col("_s"), F.lit(1), F.size("_p")))).alias("line", "_z"))
    return e.select(doc, "line", F.col("_z._p").alias("body"), F.col("_z.1").alias("start")).withColumn("end", F.col("start") + F.length("body"))


def islands(df: DataFrame, keys: list[str], order: str, starts: Column, name: str = "island") -> DataFrame:
    """Numbers stretches of rows: one begins where ``starts`` holds."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(starts.cast("int")).over(w))


def carry(df: DataFrame, keys: list[str], order: str, value: Column, name: str) -> DataFrame:
    """The last non-null ``value`` up to each row."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, True).over(w))


def monotone_runs(df: DataFrame, keys: list[str], order: str, number: str, least: int = 3, share: float = 0.8) -> DataFrame:
    """Keys whose numbers are an enumeration: ``least`` of them and ``share`` of the steps upward."""
    w = W.partitionBy(*keys).orderBy(order)
    steps = df.where(F.col(number).isNotNull()).withColumn("_up", (F.col(number) > F.lag(number).over(w)).cast("double"))
    got = steps.groupBy(*keys).agg(F.count(F.lit(1)).alias("numbers"), F.avg("_up").alias("upward"))
    return got.select(*keys, "numbers", F.round(F.coalesce("upward", F.lit(0.0)), 6).alias("upward"), ((F.col("numbers") >= least) & (F.coalesce("upward", F.lit(0.0)) >= share)).alias("enumerated"))


def with_enumerated(df: DataFrame, keys: list[str], order: str, number: str, least: int = 3, share: float = 0.8) -> DataFrame:
    """``df`` with ``enumerated``: whether a row's key is one of ``monotone_runs``, told by windows over the rows as they lie, which are read once."""
    w, whole = W.partitionBy(*keys).orderBy(order), W.partitionBy(*keys)
    d = df.withColumn("_up", (F.col(number) > F.last(number, True).over(w.rowsBetween(W.unboundedPreceding, -1))).cast("double"))
    return d.withColumn("enumerated", (F.count(number).over(whole) >= least) & (F.coalesce(F.avg("_up").over(whole), F.lit(0.0)) >= share)).drop("_up")


def outline(headings: DataFrame, doc: str, order: str, level: str, deepest: int = 6) -> DataFrame:
    """``parent``: the nearest earlier heading of a smaller level.

    Equal to a stack: a heading's parent is the latest of the last headings of
    each smaller level.
    """
    w = W.partitionBy(doc).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    last = [F.last(F.when(F.col(level) == j, F.col(order)), True).over(w) for j in range(1, deepest)]
    d = headings.select("*", *[x.alias(f"_l{j}") for j, x in enumerate(last, 1)])
    options = [F.when(F.col(level) > j, F.col(f"_l{j}")) for j in range(1, deepest)]
    return d.withColumn("parent", F.greatest(*options)).drop(*[f"_l{j}" for j in range(1, deepest)])
