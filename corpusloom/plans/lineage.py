"""Cutting lineage in a way that survives a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session has none (tests, a laptop) a temporary one is set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df``: replicated by the shared store, lineage gone."""
    spark = df.sparkSession
    base = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again (columns can be pruned)."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
