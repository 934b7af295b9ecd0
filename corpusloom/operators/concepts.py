"""Concepts: clusters, folds, guardrails, proposals, verdicts and build comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.components import connected_components
from corpusloom.operators.joins import acronyms, similar_labels


def candidate_clusters(labels: DataFrame, key: str, text: str, within: list[str], tau: float) -> DataFrame:
    """(key, cluster): components of labels alike by tokens or acronym within a group; cluster is the smallest key."""
    alike = similar_labels(labels, key, text, within, tau).select("a", "b").union(acronyms(labels, key, text, within).select("a", "b"))
    comp = connected_components(alike, "a", "b")
    return labels.select(key).join(comp.select(F.col("node").alias(key), "component"), key, "left").select(key, F.coalesce("component", key).alias("cluster"))


def fold_groups(labels: DataFrame, key: str, text: str, within: list[str], must: DataFrame, cannot: DataFrame) -> DataFrame:
    """(key, cluster) of labels that fold into one concept.

    Edges are acronyms within a group and must-pairs, without cannot-pairs;
    shared tokens alone fold nothing. A cannot-pair takes away its own edge,
    not a path through a third label.
    """
    pair = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = pair(acronyms(labels, key, text, within)).union(pair(must)).distinct().join(pair(cannot), ["a", "b"], "left_anti")
    comp = connected_components(edges, "a", "b")
    return labels.select(key).distinct().join(comp.select(F.col("node").alias(key), "component"), key, "left").select(key, F.coalesce("component", key).alias("cluster"))


def fold_veto(canonical: Column, member: Column, present_canonical: Column, present_member: Column, tau: float = 0.6) -> Column:
    """Why a member must not fold under a canonical label, or null: not observed, tokens that keep apart, or too little alike."""
    c, m = X.tokens(canonical), X.tokens(member)
    alike = (X.jaccard(c, m) >= tau) | X.is_acronym(member, canonical) | X.is_acronym(canonical, member)
    return F.when(~(present_canonical & present_member), "not_observed").when(X.discriminating_conflict(c, m), "discriminating_token").when(~alike, "low_overlap")


def no_proposals(spark: SparkSession) -> DataFrame:
    """Proposals of nobody: with them ``review_pairs`` gives no rows."""
    return spark.createDataFrame([], "proposal_id string, a string, b string")


def similar_proposals(labels: DataFrame, key: str, text: str, within: list[str], tau: float) -> DataFrame:
    """Proposals (proposal_id, a, b) of labels of a group that share most of their words, in place of a proposer's table."""
    return similar_labels(labels, key, text, within, tau).select(F.concat_ws("~", "a", "b").alias("proposal_id"), "a", "b")


def review_pairs(proposals: DataFrame, must: DataFrame, cannot: DataFrame, folded: DataFrame) -> DataFrame:
    """Proposed pairs with the reason to skip each: cannot, must, folded or duplicate; null ones go to review."""
    p = proposals.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "proposal_id")
    flag = lambda df, name: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn(name, F.lit(True))
    first = p.groupBy("a", "b").agg(F.min("proposal_id").alias("first"))
    got = p.join(flag(cannot, "c"), ["a", "b"], "left").join(flag(must, "m"), ["a", "b"], "left").join(flag(folded, "f"), ["a", "b"], "left").join(first, ["a", "b"])
    why = F.when(F.col("c"), "cannot").when(F.col("m"), "must").when(F.col("f"), "folded").when(F.col("proposal_id") != F.col("first"), "duplicate")
    return got.select("proposal_id", "a", "b", why.alias("skip"))


def pick_canonical(members: DataFrame, cluster: str, label: str, kind: str, user: str, generic: list[str]) -> DataFrame:
    """A label the user set stays; else the longest of a specific type, then the smallest."""
    order = F.struct((~F.coalesce(F.col(user), F.lit(False))).alias("u"), F.coalesce(F.col(kind).isin(*generic), F.lit(True)).alias("g"), (-F.length(label)).alias("l"), F.col(label))
    return members.groupBy(cluster).agg(F.min_by(label, order).alias("canonical"))


def diff_builds(earlier: DataFrame, later: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Clusters whose decision differs between two builds: added, removed, or flipped with the fields."""
    e = earlier.select(key, *[F.col(c).alias(f"e_{c}") for c in fields], F.lit(True).alias("_e"))
    n = later.select(key, *[F.col(c).alias(f"n_{c}") for c in fields], F.lit(True).alias("_n"))
    got = e.join(n, key, "full")
    changed = F.filter(F.array(*[F.when(~F.col(f"e_{c}").eqNullSafe(F.col(f"n_{c}")), F.lit(c)) for c in fields]), lambda x: x.isNotNull())
    what = F.when(F.col("_e").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.size(changed) > 0, "flipped")
    return got.select(key, what.alias("change"), F.when(F.col("_e") & F.col("_n"), F.array_join(changed, ",")).alias("fields")).where("change is not null")


def apply_verdicts(constraints: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Constraints (kind, a, b) after review verdicts (a, b, action): accept makes must, reject makes cannot, undo takes away."""
    v = verdicts.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "action", "at")
    last = v.groupBy("a", "b").agg(F.max_by("action", "at").alias("action"))
    old = constraints.select("kind", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).join(last, ["a", "b"], "left_anti")
    new = last.where("action <> 'undo'").select(F.when(F.col("action") == "accept", "must").otherwise("cannot").alias("kind"), "a", "b")
    return old.unionByName(new)
