"""Tables kept by document: what a document yields is replaced when the document comes again.

A kept table is Parquet in hash buckets of the document's key. A batch of
documents touches the buckets of its documents only: their rows are read, those
of the batch's documents are left out, the new ones are added, and the buckets
are put in place by a dynamic partition overwrite. The new content of a bucket
is written beside the table first, under the batch's number. A batch that is
run again after a failure uses what it finds there whole, so a half-replaced
bucket is never read, and the outcome is the same.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.rows import latest

Build = Callable[[DataFrame], DataFrame]


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def _discard(spark: SparkSession, path: str) -> None:
    """Removes a table whose _SUCCESS tells that it is whole: that first, so what a failure leaves of it does not count."""
    remove(spark, f"{path}/_SUCCESS")
    remove(spark, path)


def stamp(spark: SparkSession, path: str) -> tuple:
    """Names, lengths and times of a table's files: another stamp, another content."""
    fs, at = _fs(spark, path)
    return tuple(sorted((x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in fs.listStatus(at)))


def names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


@dataclass
class Kept:
    """Kept tables of documents (``key``, ``text``, and the column ``version``, if named) below ``base``.

    ``builds`` makes the rows of each table from documents; they hold ``key``.
    ``summaries`` makes one row or more a bucket and group from the rows of
    another table, given with its ``bucket``; they are made anew for touched
    buckets. ``views`` are made from another table as they are read, and not
    kept. ``sorts`` orders the rows inside files. The number of buckets is
    fixed with the first batch.
    """

    base: str
    key: str
    text: str
    builds: dict[str, Build]
    summaries: dict[str, tuple[str, Build]] = field(default_factory=dict)
    sorts: dict[str, list[str]] = field(default_factory=dict)
    version: str | None = None
    buckets: int = 16
    views: dict[str, tuple[str, Build]] = field(default_factory=dict)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket")

    def path(self, table: str) -> str:
        return f"{self.base}/{table}"

    def _like(self, docs: DataFrame, table: str) -> DataFrame:
        """A table without rows, as its build gives it."""
        none = docs.where("false")
        if table in self.summaries:
            source, build = self.summaries[table]
            return build(self._like(docs, source))
        build = self._states if table == "documents" else self.builds[table]
        rows = build(none)
        return rows.withColumn("bucket", self.bucket())

    def _states(self, docs: DataFrame) -> DataFrame:
        version = F.col(self.version) if self.version else F.lit(0)
        return docs.select(self.key, version.alias("version"), F.sha2(F.coalesce(F.col(self.text), F.lit("")), 256).alias("digest"))

    def read(self, docs: DataFrame, table: str) -> DataFrame:
        """A table as it stands, with its ``bucket``; ``docs`` tells the columns of documents only."""
        if table in self.views:
            source, build = self.views[table]
            return build(self.read(docs, source))
        spark, like = docs.sparkSession, self._like(docs, table)
        if not any(n.startswith("bucket=") for n in names(spark, self.path(table))):
            return like
        return spark.read.schema(like.schema).parquet(self.path(table))

    def _written(self, rows: DataFrame, table: str, path: str) -> None:
        """Rows by bucket and order. A batch is laid by bucket before it is built on, so what documents yield is not shuffled."""
        laid = rows.sortWithinPartitions("bucket", *self.sorts.get(table, []))
        laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)

    def _replace(self, table: str, rows: Callable[[], DataFrame], touched: list[int], batch: int) -> None:
        """Puts ``rows`` in place of the touched buckets. Their copy goes as soon as they are there: run again, it is made of them anew."""
        spark, path = SparkSession.active(), self.path(table)
        if not exists(spark, path):
            self._written(rows(), table, path)
            return
        stage = f"{self.base}/_batch={batch}/{table}"
        if not exists(spark, f"{stage}/_SUCCESS"):
            remove(spark, stage)
            self._written(rows(), table, stage)
        full = {n for n in names(spark, stage) if n.startswith("bucket=")}
        if full:
            staged = spark.read.parquet(stage)
            self._written(staged, table, path)
        for b in touched:  # a bucket that lost its last row
            if f"bucket={b}" not in full:
                remove(spark, f"{path}/bucket={b}")
        _discard(spark, stage)

    def apply(self, docs: DataFrame, batch: int) -> None:
        """Takes a batch of documents into all tables.

        A document's newest version counts, by ``version`` if named, then by
        digest; one that is older than what is kept, or equal to it, changes
        nothing. A document that yields no rows any more loses those it had.
        Rows without a key are left out. Batch numbers must rise; the same
        number again is the same batch.
        """
        spark = docs.sparkSession
        for n in names(spark, self.base):
            if n.startswith("_batch=") and int(n.split("=")[1]) < batch:
                remove(spark, f"{self.base}/{n}")
        stage = f"{self.base}/_batch={batch}/changed"
        if not exists(spark, f"{stage}/_SUCCESS"):
            given = docs.where(F.col(self.key).isNotNull())
            marked = given.withColumn("_v", F.col(self.version) if self.version else F.lit(0)).withColumn("_d", F.sha2(F.coalesce(F.col(self.text), F.lit("")), 256))
            newest = latest(marked, [self.key], "_v", "_d")
            kept = self.read(docs, "documents").select(F.col(self.key).alias("_k"), "version", "digest")
            met = newest.join(kept, F.col(self.key) == F.col("_k"), "left")
            news = F.col("_k").isNull() | ((F.col("_d") != F.col("digest")) & (F.col("_v") >= F.col("version"))) | (F.col("_v") > F.col("version"))
            laid = met.where(news).select(*docs.columns).withColumn("bucket", self.bucket()).hint("rebalance", "bucket")  # large buckets become several tasks, small ones share one
            laid.write.mode("overwrite").parquet(stage)
        changed = spark.read.parquet(stage)
        touched = sorted(r.bucket for r in changed.select("bucket").distinct().collect())  # at most the number of buckets
        if not touched:
            return
        news, gone = changed.drop("bucket"), changed.select(self.key).distinct()

        def rows(table: str, build: Build) -> DataFrame:
            old = self.read(docs, table).where(F.col("bucket").isin(touched)).join(gone, self.key, "left_anti")
            return old.unionByName(build(news).withColumn("bucket", self.bucket()))

        def summary(source: str, build: Build) -> DataFrame:
            return build(self.read(docs, source).where(F.col("bucket").isin(touched))).hint("rebalance", "bucket")

        for table, build in self.builds.items():
            self._replace(table, lambda t=table, b=build: rows(t, b), touched, batch)
        for table, (source, build) in self.summaries.items():
            self._replace(table, lambda s=source, b=build: summary(s, b), touched, batch)
        self._replace("documents", lambda: rows("documents", self._states), touched, batch)  # last: until then the batch counts as new
        _discard(spark, stage)
