"""Aggregates over edges, claims, notes, usage and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.access import EPISTEMIC, PROVENANCE, most_restrictive, named, rank_in
from corpusloom.operators.rows import latest


def usage_rollup(usage: DataFrame, by: str, month: str | None = None) -> DataFrame:
    """Calls and cost for each value of ``by``, and a TOTAL row (grouping sets)."""
    if month:
        usage = usage.where(F.col("ym") == month)
    got = usage.select(F.col(by).cast("string").alias("key"), "cost").rollup("key").agg(F.grouping("key").alias("g"), F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"))
    return got.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("key")).alias("k"), "calls", F.round("cost", 4).alias("cost"))


def monthly_spend(usage: DataFrame) -> DataFrame:
    return usage.groupBy("ym").agg(F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 4).alias("spend"))


def cocitation(edges: DataFrame) -> DataFrame:
    """Distinct citing works of each target."""
    return edges.groupBy("target").agg(F.countDistinct("source").alias("citers"))


def edge_disagreements(edges: DataFrame) -> DataFrame:
    """Pairs of a run that more than one provenance claims, with the set and the one that wins."""
    got = edges.groupBy("source", "target", "run_id").agg(F.sort_array(F.collect_set("provenance")).alias("p"), F.max(rank_in("provenance", PROVENANCE, 0)).alias("r"))
    return got.where(F.size("p") > 1).select("source", "target", "run_id", F.array_join("p", ",").alias("provenances"), named(F.col("r"), PROVENANCE).alias("winner"))


def authoritative_edges(edges: DataFrame) -> DataFrame:
    """One edge for each pair and run: the provenance of most authority, then the highest confidence."""
    ranked = edges.withColumn("_rank", rank_in("provenance", PROVENANCE, 0))
    return latest(ranked, ["source", "target", "run_id"], "_rank", "confidence").drop("_rank")


def co_occurrence(links: DataFrame, least: int = 2) -> DataFrame:
    """Concept pairs that share works: count, Jaccard of their works, the more restrictive access class.

    The self-join is on the work, whose concepts are few; pairs are counted map-side.
    """
    one = links.select("work_id", "concept_id").distinct()
    sizes = one.groupBy("concept_id").agg(F.count(F.lit(1)).alias("n"))
    pairs = one.alias("a").join(one.alias("b"), (F.col("a.work_id") == F.col("b.work_id")) & (F.col("a.concept_id") < F.col("b.concept_id")))
    shared = pairs.groupBy(F.col("a.concept_id").alias("concept_a"), F.col("b.concept_id").alias("concept_b")).agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)
    access = links.groupBy("concept_id").agg(most_restrictive("access_class").alias("access"))
    side = lambda c: sizes.join(access, "concept_id").select(F.col("concept_id").alias(f"concept_{c}"), F.col("n").alias(f"n_{c}"), F.col("access").alias(f"access_{c}"))
    full = shared.join(side("a"), "concept_a").join(side("b"), "concept_b")
    worst = F.when(rank_access("access_a") >= rank_access("access_b"), F.col("access_a")).otherwise(F.col("access_b"))
    return full.select("concept_a", "concept_b", "shared", F.round(F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared")), 6).alias("jaccard"), worst.alias("access_class"))


def rank_access(c: str) -> Column:
    from corpusloom.functions.access import access_rank

    return access_rank(c)


def idf_weights(links: DataFrame) -> DataFrame:
    """ln(N / pf) of each concept, N the works that have claims; 0 where either is 0."""
    n = links.agg(F.countDistinct("work_id").alias("n"))
    pf = links.groupBy("concept_id").agg(F.countDistinct("work_id").alias("paper_frequency"))
    weight = F.when((F.col("n") > 0) & (F.col("paper_frequency") > 0), F.log(F.col("n") / F.col("paper_frequency"))).otherwise(0.0)
    return pf.crossJoin(F.broadcast(n)).select("concept_id", "paper_frequency", F.round(weight, 6).alias("weight"))  # n is one row


def paper_frequency(links: DataFrame) -> DataFrame:
    return links.groupBy("concept_id").agg(F.countDistinct("work_id").alias("paper_frequency"))


def gather_labels(links: DataFrame, key: Column) -> DataFrame:
    """For each normalised label: claims, works, surface forms, the majority type (ties by name) and the longest surface."""
    # surface forms are few: counted first, so that claims are gone through for their own and their works' numbers only
    forms = links.groupBy("label", "concept_type").agg(F.count(F.lit(1)).alias("n")).withColumn("label_key", key)
    types = forms.groupBy("label_key", "concept_type").agg(F.sum("n").alias("n"))
    majority = types.groupBy("label_key").agg(F.min_by("concept_type", F.struct((-F.col("n")).alias("n"), F.col("concept_type"))).alias("majority_type"))
    shown = forms.groupBy("label_key").agg(F.countDistinct("label").alias("surfaces"), F.min_by("label", F.struct((-F.length("label")).alias("l"), F.col("label"))).alias("canonical"))
    main = links.withColumn("label_key", key).groupBy("label_key").agg(F.countDistinct("claim_id").alias("claims"), F.countDistinct("work_id").alias("works"))
    return main.join(shown, "label_key").join(majority, "label_key")


def pick_label(labels: DataFrame, key: str, label: str, kind: str, generic: list[str]) -> DataFrame:
    """The surface form of each key: of a specific type if any, the longest, then the smallest."""
    order = F.struct(F.coalesce(F.col(kind).isin(*generic), F.lit(True)).alias("g"), (-F.length(label)).alias("l"), F.col(label))
    return labels.groupBy(key).agg(F.min_by(label, order).alias("picked"))


def discusses(links: DataFrame) -> DataFrame:
    """One edge for each work and concept: strongest epistemic type, most restrictive class."""
    return links.groupBy("work_id", "concept_id").agg(named(F.max(rank_in("epistemic_type", EPISTEMIC, 0)), EPISTEMIC).alias("epistemic_type"), most_restrictive("access_class").alias("access_class"))


def provenance_counts(links: DataFrame, ids: DataFrame) -> DataFrame:
    """Distinct works, claims and spans of each requested concept; 0 where it has none."""
    got = links.groupBy("concept_id").agg(F.countDistinct("work_id").alias("works"), F.countDistinct("claim_id").alias("claims"), F.countDistinct("span_id").alias("spans"))
    return ids.join(got, "concept_id", "left").select("concept_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("works", "claims", "spans")])


def orientation(links: DataFrame, per_type: int = 3, background: int = 5) -> DataFrame:
    """The most frequent concepts as background; of the rest the top of each type, and how many more the type has."""
    from pyspark.sql import Window as W

    pf = links.groupBy("concept_type", "concept_id").agg(F.countDistinct("work_id").alias("pf"))
    ground = pf.groupBy("concept_id").agg(F.sum("pf").alias("pf")).orderBy(F.desc("pf"), "concept_id").limit(background)
    rest = pf.join(ground.select("concept_id"), "concept_id", "left_anti")
    w = W.partitionBy("concept_type").orderBy(F.desc("pf"), "concept_id")
    top = rest.withColumn("place", F.row_number().over(w)).withColumn("more", F.greatest(F.count(F.lit(1)).over(W.partitionBy("concept_type")) - per_type, F.lit(0))).where(F.col("place") <= per_type)
    return ground.select(F.lit("background").alias("concept_type"), "concept_id", "pf", F.row_number().over(W.orderBy(F.desc("pf"), "concept_id")).alias("place"), F.lit(0).cast("long").alias("more")).unionByName(
        top.select("concept_type", "concept_id", "pf", "place", F.col("more").cast("long").alias("more"))
    )


def dashboard(works: DataFrame, covered: DataFrame, key: str = "work_id") -> DataFrame:
    """One row: works by status, how many are covered, the share."""
    flags = works.join(covered.select(F.col(key), F.lit(True).alias("has")).distinct(), key, "left")
    return flags.agg(
        F.count(F.lit(1)).alias("works"), F.count_if(F.col("status") == "included").alias("included"), F.count_if(F.col("status") == "metadata_only").alias("metadata_only"),
        F.count_if(F.col("status") == "excluded").alias("excluded"), F.count_if("has").alias("covered"), F.round(100.0 * F.count_if("has") / F.count(F.lit(1)), 4).alias("coverage"),
    )


def set_hash(pairs: DataFrame, *cols: str) -> DataFrame:
    """sha256 of the sorted distinct rows as JSON: the same set gives the same hash.

    Rows are sorted in one task, as a hash of a whole set in order must be; a
    concept set is small beside its corpus.
    """
    got = pairs.select(*cols).distinct().agg(F.sort_array(F.collect_list(F.array(*[F.col(c) for c in cols]))).alias("a"))
    return got.select(F.sha2(F.to_json("a"), 256).alias("set_hash"), F.size("a").cast("long").alias("n"))
