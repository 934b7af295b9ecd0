"""From raw documents to training shards, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's result as Parquet in the shared folder and reads it again as the
next one's docs, so a lost executor costs no more than part of a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, dedup, mixing, quality, tokenorder
from corpusloom.plans.lineage import stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (10) accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.score_quality(docs, labels).where("predicted = 1").select(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (2): five-word shingles, similarity 0.8.

    A row's node is a hash of its id and text, so a row without an id takes
    part, and rows that share an id but not the text are told apart. Only rows
    equal in both are one.
    """
    noded = docs.withColumn("_node", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    kept = dedup.near_duplicates(noded.select(F.col("_node").alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias("_node")).distinct()
    return noded.join(kept, "_node", "left_semi").dropDuplicates(["_node"]).select(*docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (3)."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.find_leaks(docs, benchmark).where(F.size("leaks") == 0).select(*docs.columns)


#: What the mixture says of a row's source: its target weight.
SHARE = "mix_share"


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture (8), each with its source's target (``SHARE``): part files follow one another, rows in each are sorted.

    The last stage does not rest on that order, which a scan need not keep: it
    deals its slots by the targets that come with the rows. Rows pass through
    the mixture whole, so rows that share a doc_id, or have none, stay as they are.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    targets = {s: n**0.5 for s, n in mixing.source_counts(docs).items()}
    share = spark.createDataFrame(list(targets.items()), f"source string, {SHARE} double")
    mixed = mixing.mix_sources(docs, targets).join(F.broadcast(share), "source")  # one row a source, at most MAX_SOURCES
    return mixing.in_order(mixed, docs.count(), parts).select("row.*", SHARE)


def order_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences in training order (1), slots dealt to sources by the targets of the mix stage; one permutation over all where rows have none.

    The rows are read from the shards that the stage writes to the shared folder.
    """
    targets = None
    if SHARE in docs.columns:
        shares = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).agg(F.max(SHARE).alias("share")).limit(mixing.MAX_SOURCES + 1).collect()
        targets = {r["source"]: r["share"] for r in shares}
    return tokenorder.training_order(docs, label="pipeline-shards", targets=targets)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
    ("token_order", order_stage),
]

#: The classifier, signatures and latent space have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
