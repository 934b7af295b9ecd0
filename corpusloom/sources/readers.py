"""Scans of documents, caches, record files and folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.access import ACCESS, access_rank, most_restrictive, named
from corpusloom.operators.rows import latest


def verified_documents(rows: DataFrame, text: str = "text", digest: str = "hash") -> DataFrame:
    """Drops rows whose hash is not that of their text."""
    return rows.where(F.sha2(text, 256) == F.col(digest))


def ingest(files: DataFrame, key: str, text: str = "text", access: str = "access_class") -> DataFrame:
    """Identical bytes are one row: the first key, all sightings, the most restrictive class."""
    return files.groupBy(F.sha2(text, 256).alias("file_hash")).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("sightings"), most_restrictive(access).alias("access_class"))


def provider_cache(cache: DataFrame, now: str, keys: list[str]) -> DataFrame:
    """The newest unexpired response of each key; a stored miss is a row with no response."""
    live = cache.where(F.lit(now).cast("timestamp") < F.col("fetched_at") + F.make_dt_interval(secs=F.col("ttl_seconds").cast("decimal(18,6)")))
    return latest(live, keys, "fetched_at")


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of text files, numbered from 1 in their file.

    A file is read in blocks by many tasks: lines are numbered inside a block,
    and blocks follow one another by the counts of those before.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"))
    inside = rows.withColumn("_n", F.row_number().over(W.partitionBy("file", "_at").orderBy("_id")))
    sizes = inside.groupBy("file", "_at").agg(F.count(F.lit(1)).alias("_c"))
    before = sizes.select("file", "_at", F.coalesce(F.sum("_c").over(W.partitionBy("file").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return inside.join(before, ["file", "_at"]).select("file", (F.col("_before") + F.col("_n")).alias("line"), "value")


def json_records(lines: DataFrame, value: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(good, bad) lines: good ones are objects of exactly the required keys, bad ones carry their ``problem``. Blank lines are neither."""
    keys = F.coalesce(F.json_object_keys(value), F.array())
    want = F.array(*[F.lit(k) for k in required])
    named = lambda c: F.array_join(F.array_sort(c), ",")
    wrong = F.concat(F.lit("missing="), named(F.array_except(want, keys)), F.lit(" extra="), named(F.array_except(keys, want)))
    problem = F.when(F.try_parse_json(value).isNull(), "invalid JSON").when(F.json_object_keys(value).isNull(), "not an object").when(F.size(F.array_except(want, keys)) + F.size(F.array_except(keys, want)) > 0, wrong)
    d = lines.where(F.trim(F.col(value)) != "").withColumn("problem", problem)
    return d.where("problem is null").drop("problem"), d.where("problem is not null")


def checklists(lines: DataFrame, value: str, items: list[str], priority: list[str], key: str = "work_id") -> tuple[DataFrame, DataFrame]:
    """(good, bad) lines of booleans by item: good ones as (key, item columns, priority), bad ones with their ``problem``.

    A key that is no item, ``key`` or ``priority`` is refused, and so is an item
    that is not true or false. A priority that is not given is true if any item
    of ``priority`` is.
    """
    keys = F.json_object_keys(value)
    allowed = F.array(*[F.lit(x) for x in [*items, key, "priority"]])
    kind = lambda x: F.schema_of_variant(F.try_variant_get(F.try_parse_json(value), f"$.{x}", "variant"))
    flag = lambda x: F.try_variant_get(F.try_parse_json(value), f"$.{x}", "boolean")
    odd = F.filter(F.array(*[F.when(F.array_contains(keys, x) & (F.coalesce(kind(x), F.lit("VOID")) != "BOOLEAN"), F.lit(x)) for x in items]), lambda x: x.isNotNull())
    unknown = F.array_sort(F.array_except(keys, allowed))
    problem = F.when(keys.isNull(), "not an object").when(F.size(unknown) > 0, F.concat(F.lit("unknown item "), unknown[0])).when(F.size(odd) > 0, F.concat(F.lit("not a boolean: "), odd[0]))
    d = lines.where(F.trim(F.col(value)) != "").withColumn("problem", problem)
    first = F.greatest(*[F.coalesce(flag(x), F.lit(False)) for x in priority], F.lit(False))
    good = d.where("problem is null").select(F.get_json_object(value, f"$.{key}").alias(key), *[flag(x).alias(x) for x in items], F.coalesce(flag("priority"), first).alias("priority"))
    return good, d.where("problem is not null")


def folder_outcomes(files: DataFrame, pending: DataFrame) -> DataFrame:
    """(path, outcome) of files (path, text): empty, or unmatched, matched or ambiguous by how many pending works (title_hash) their first line titles."""
    title = F.sha1(F.element_at(F.split("text", "\n"), 1))
    n = pending.groupBy("title_hash").agg(F.count(F.lit(1)).alias("_n"))
    blank = F.trim(F.regexp_replace("text", r"\s+", " ")) == ""
    got = files.select("path", title.alias("title_hash"), blank.alias("_blank")).join(n, "title_hash", "left")
    outcome = F.when(F.col("_blank"), "empty").when(F.col("_n").isNull(), "unmatched").when(F.col("_n") == 1, "matched").otherwise("ambiguous")
    return got.select("path", outcome.alias("outcome"))


def folder(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """path, text of every file under a folder. A file of no bytes has no row, as Spark plans no split for it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("content").cast("string").alias("text"))


def packed_folder(spark: SparkSession, path: str) -> DataFrame:
    """path, text of every file that ``sinks.pack_folder`` packed under a folder, at any depth. A pack is read in blocks by many tasks."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    return lines.select(F.from_json("value", "path string, text string").alias("f")).select("f.path", "f.text")


def events_after(events: DataFrame, after: int) -> DataFrame:
    return events.where(F.col("seq") > after)


def tightest(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(named(F.max(access_rank("access_class")), ACCESS).alias("access_class"))
