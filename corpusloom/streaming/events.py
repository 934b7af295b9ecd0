"""Event logs of runs, in batch and as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.kept import Kept
from corpusloom.operators.rows import latest
from corpusloom.plans.lineage import shared_dir

def tail(spark: SparkSession, path: str, schema: str | object) -> DataFrame:
    """The event log as a stream of Parquet files; the checkpoint keeps the offset."""
    return spark.readStream.schema(schema).parquet(path)


def daily_spend(usage: DataFrame, limit: float, late: str = "1 day") -> DataFrame:
    """Spend and a latch for each day and provider; events later than ``late`` are dropped."""
    got = usage.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "provider").agg(F.sum(F.coalesce("cost", F.lit(0.0))).alias("spend"))
    return got.select(F.col("w.start").alias("day"), "provider", F.round("spend", 4).alias("spend"), (F.col("spend") >= limit).alias("stopped"))


def fresh_responses(cache: DataFrame, keys: list[str], ttl: str) -> DataFrame:
    """The first response of each key within the TTL; repeats are dropped while the state lives."""
    return cache.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(keys)


def step_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("run_id", F.window("ts", "1 day").alias("w"), "event").agg(F.count(F.lit(1)).alias("n")).select("run_id", F.col("w.start").alias("day"), "event", "n")


def drained(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over all that is there and gives the result as a table in the shared folder.

    Appended rows go through the file sink, which writes each once. Updates are
    written a folder a batch, so a batch run again overwrites its own, and the
    last row of each of ``keys`` counts. Neither mode keeps what the watermark
    has passed. The checkpoint lies beside the table.
    """
    spark, base = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    spark.createDataFrame([], stream.schema).write.parquet(f"{base}/out/batch=-1" if mode == "update" else f"{base}/out")
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        w.format("parquet").option("path", f"{base}/out").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out")
    w.foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{base}/out/batch={i}")).start().awaitTermination()
    updates = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{base}/out")
    return latest(updates, keys, "batch").drop("batch")


def maintain(docs: DataFrame, kept: Kept, checkpoint: str, first: int = 0):
    """Takes each batch of a stream of documents into the kept tables; a batch run again after a failure gives the same tables.

    ``first`` is the number of the stream's first batch; a stream that follows
    another on the same tables starts above its numbers.
    """
    return docs.writeStream.foreachBatch(lambda batch, i: kept.apply(batch, first + i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
