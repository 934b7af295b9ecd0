"""Sharding by sampled splitters: range partitions of near equal bytes, by DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.plans.lineage import stored

_SPACE = float(1 << 60)


def hash60(column: str) -> F.Column:
    """A 60-bit hash as a non-negative long (the first 15 hex digits of md5)."""
    return F.conv(F.substring(F.md5(F.col(column).cast("string")), 1, 15), 16, 10).cast("long")


def _splitters(sample: DataFrame, ranges: int) -> DataFrame:
    """(range, low, high) of the sample's quantile boundaries, half-open, over all keys."""
    at = [i / ranges for i in range(1, ranges)]
    edges = sample.agg(F.percentile_approx("k", at, 100 * ranges).alias("e"))
    # a key that is several quantiles at once gets a range of its own
    edges = edges.select(F.coalesce("e", F.array().cast("array<bigint>")).alias("e"))
    often = F.transform(F.filter("e", lambda x, i: (i > 0) & (F.get("e", i - 1) == x)), lambda x: x + 1)
    edges = edges.select(F.array_sort(F.concat(F.array(F.lit(0).cast("long")), "e", often, F.array(F.lit(1 << 60).cast("long")))).alias("e"))
    edges = edges.select(F.array_distinct("e").alias("e"))
    return edges.select(F.posexplode(F.slice("e", 1, F.size("e") - 1)).alias("range", "low"), "e").select(
        F.col("range").cast("long").alias("range"), "low", F.element_at("e", F.col("range") + 2).alias("high")
    )


def assign_shards(docs: DataFrame, shards: int = 24, ranges_per_shard: int = 64, per_range: int = 20, rows_per_range: int = 1_000_000) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of ``docs`` (doc_id, text).

    Size is the UTF-8 length of the text plus 8. Rows are ordered by (hash of
    text, hash of doc_id, doc_id), so copies of a text lie together, and shard
    ``s`` takes the stretch of that order whose bytes start in its ``1/shards``
    of the total: shard sizes differ by less than one record.

    A sample weighted by size (``per_range`` keys a range, chosen by hash of
    doc_id) gives quantile splitters; every record gets its range from them;
    ranges that hold more than twice their share, as a text copied very often
    makes, are subdivided by the hash of doc_id. Exact bytes and rows of each
    subrange, summed in order, place it; inside it a window places the rows.
    No window holds more than one subrange, and nothing is dropped.

    A null text has size 8 and the crc32 of an empty one. Rows that repeat
    get a slot each. An empty table gives no rows. Other columns are ignored.
    """
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("text")).select(
        "doc_id",
        (F.octet_length("text") + 8).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).cast("long").alias("text_crc32"),
        hash60("text").alias("k"),
        F.coalesce(hash60("doc_id"), F.lit(0)).cast("long").alias("h"),
    )
    rows = stored(rows, "shard-keys")
    total = rows.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    per_shard = F.greatest(F.lit(ranges_per_shard), F.ceil(F.col("n") / (shards * rows_per_range)))
    goal = total.select("bytes", "n", (per_shard * shards).alias("ranges"))
    got = goal.first()
    if not got["n"]:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    ranges, whole = int(got["ranges"]), int(got["bytes"])
    chance = ranges * per_range / whole
    sample = rows.where((F.xxhash64(F.lit("sample"), "doc_id").bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))) < F.col("size") * chance).select("k")

    # a range meets few of the equal-width bins, so each key meets few ranges
    bins = 2 * ranges
    bin_of = lambda c: (F.col(c) / F.lit(_SPACE) * bins).cast("long")
    splitters = _splitters(sample, ranges)
    binned = splitters.withColumn("bin", F.explode(F.sequence(bin_of("low"), F.least(bin_of("high"), F.lit(bins).cast("long")))))
    placed = rows.withColumn("bin", bin_of("k")).join(F.broadcast(binned), "bin").where("k >= low and k < high").drop("bin", "low", "high")
    loads = placed.groupBy("range").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("c"), (F.min("k") == F.max("k")).alias("single"))
    # an overfull range is that of one key, so its order by h is the order asked for
    need = F.greatest(F.ceil(F.col("b") * ranges / whole / 2), F.ceil(F.col("c") * ranges / got["n"] / 2))
    parts = loads.select("range", F.when(F.col("single"), F.greatest(F.lit(1), need)).otherwise(F.lit(1)).alias("parts"))
    # one row a range: bounded by ``ranges``
    cut = placed.join(F.broadcast(parts), "range").withColumn("sub", (F.col("h") / F.lit(_SPACE) * F.col("parts")).cast("long"))
    cut = cut.withColumn("sub", F.when(F.col("parts") > 1, F.col("sub")).otherwise(F.lit(0).cast("long"))).drop("parts")
    sums = cut.groupBy("range", "sub").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("c"))
    before = W.orderBy("range", "sub").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("range", "sub", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"))
    inside = W.partitionBy("range", "sub").orderBy("k", "h", "doc_id")
    spot = cut.withColumn("b1", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")).withColumn("c1", F.row_number().over(inside) - 1)
    spot = spot.join(F.broadcast(starts), ["range", "sub"])
    spot = spot.withColumn("shard", F.expr(f"cast(((b0 + b1) * {shards}) div {whole} as int)")).withColumn("at", (F.col("c0") + F.col("c1")).cast("long"))
    first = spot.groupBy("shard").agg(F.min("at").alias("first"))
    return spot.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("at") - F.col("first")).alias("slot"))
