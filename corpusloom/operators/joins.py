"""Joins between works, claims, spans, sections, references and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def exists_flag(df: DataFrame, other: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with a boolean: does ``other`` have the key."""
    return df.join(other.select(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def with_defaults(df: DataFrame, other: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Left join that fills the named columns where there is no match."""
    got = df.join(other.select(key, *defaults), key, "left")
    return got.select(*[c for c in got.columns if c not in defaults], *[F.coalesce(c, F.lit(v)).alias(c) for c, v in defaults.items()])


def acquisition_state(works: DataFrame, labels: DataFrame) -> DataFrame:
    got = works.join(labels, "work_id", "left")
    state = (
        F.when(F.col("status") == "excluded", "excluded")
        .when(F.col("quality") == 0, "needs_review")
        .when(F.col("quality").isNotNull(), "acquired")
        .when(F.col("access_class") == "open_access", "available")
        .otherwise("missing")
    )
    return got.select("work_id", state.alias("state"))


def provenance_chain(concepts: DataFrame, links: DataFrame, claims: DataFrame, spans: DataFrame, keep_bare: bool = False) -> DataFrame:
    """concept -> claim -> span; claims without a span stay if asked."""
    got = concepts.join(links, "concept_id").join(claims, "claim_id")
    return got.join(spans, "span_id", "left" if keep_bare else "inner")


def best_span(links: DataFrame) -> DataFrame:
    """The span of lowest rank of each claim (ties by span)."""
    return links.groupBy("claim_id").agg(F.min_by("span_id", F.struct("rank", "span_id")).alias("span_id"))


def containing(texts: DataFrame, key: str, text: str, tokens: DataFrame, token: str) -> DataFrame:
    """Rows of ``texts`` (one a ``key``) with each token that stands anywhere in them, letter case aside; empty tokens stand nowhere.

    A text that holds a token holds its first three characters (or all, if
    fewer): keys are looked up by these, each distinct start of a token once,
    and the whole token is then confirmed in the text of the keys met.
    """
    low = F.lower(text)

    def grams(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length(low) - n + 1), lambda i: F.substring(low, i, F.lit(n)))
        return F.when(F.length(low) >= n, every).otherwise(F.array().cast("array<string>"))

    asked = tokens.where(F.length(token) > 0).withColumn("_g", F.lower(F.substring(token, 1, 3)))
    held = texts.select(key, F.explode(F.array_distinct(F.concat(grams(1), grams(2), grams(3)))).alias("_g"))
    met = held.join(asked.select("_g").distinct(), "_g", "left_semi").join(asked, "_g").drop("_g")
    return met.join(texts, key).where(F.contains(low, F.lower(token)))


def section_at(points: DataFrame, sections: DataFrame, doc: str = "work_id") -> DataFrame:
    """Each point (doc, offset) with the deepest section that contains it; of equals the later."""
    s = sections.select(F.col(doc).alias("_d"), "start_char", "end_char", "level", "ordinal", "section_id")
    hit = points.join(s, (F.col(doc) == F.col("_d")) & (F.col("offset") >= F.col("start_char")) & (F.col("offset") < F.col("end_char")), "left")
    return hit.groupBy(doc, "offset").agg(F.max_by("section_id", F.struct("level", "ordinal")).alias("section_id"))


def as_of(points: DataFrame, steps: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Each point with the value of the last step at or before it: one sort of the union, no range join."""
    both = points.select(*keys, at, F.lit(None).cast(steps.schema[value].dataType).alias(value), F.lit(1).alias("_p")).unionByName(steps.select(*keys, at, value, F.lit(0).alias("_p")))
    w = W.partitionBy(*keys).orderBy(at, "_p").rowsBetween(W.unboundedPreceding, W.currentRow)
    return both.withColumn(value, F.last(value, True).over(w)).where("_p = 1").drop("_p")


def resolve_by_ids(records: DataFrame, record: str, ids: Column, known: DataFrame) -> DataFrame:
    """(record, work_id): the work of the first of the record's ids, in its order, that ``known`` (id, work_id) has.

    ``ids`` is an array in order of precedence.
    """
    long = records.select(record, F.posexplode(ids).alias("_p", "id")).where("id is not null")
    return long.join(known, "id").groupBy(record).agg(F.min_by("work_id", F.struct("_p", "work_id")).alias("work_id"))


def matched_works(records: DataFrame, record: str, ids: Column, known: DataFrame) -> DataFrame:
    """(record, works): all works that any of the record's ids reaches."""
    long = records.select(record, F.explode_outer(ids).alias("id"))
    return long.join(known, "id", "left").groupBy(record).agg(F.sort_array(F.collect_set("work_id")).alias("works"))


def similar_labels(labels: DataFrame, key: str, text: str, within: list[str], tau: float) -> DataFrame:
    """Pairs (a, b, jaccard), a < b, of labels of a group whose token sets have Jaccard >= tau.

    Exact: for tau > 0 a pair shares a token of both prefixes, where a label's
    prefix is its first n - ceil(tau * n) + 1 tokens, rarest first. Frequent
    tokens so make few candidates.
    """
    toks = labels.select(*within, key, F.array_distinct(F.filter(F.split(F.trim(F.col(text)), r"\s+"), lambda x: x != "")).alias("_t")).where(F.size("_t") > 0)
    each = toks.select(*within, key, F.explode("_t").alias("_w"))
    freq = each.groupBy(*within, "_w").agg(F.count(F.lit(1)).alias("_f"))
    ranked = each.join(freq, [*within, "_w"]).groupBy(*within, key).agg(F.array_sort(F.collect_list(F.struct("_f", "_w"))).alias("_s"))
    n = F.size("_s")
    ranked = ranked.withColumn("_prefix", F.slice("_s", F.lit(1), (n - F.ceil(F.lit(tau - 1e-9) * n) + 1).cast("int"))).withColumn("_all", F.transform("_s", lambda x: x["_w"]))
    pre = ranked.select(*within, key, "_all", F.explode("_prefix").alias("_p")).select(*within, key, "_all", F.col("_p._w").alias("_w"))
    a, b = pre.alias("a"), pre.alias("b")
    same = F.lit(True)
    for c in [*within, "_w"]:
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    pairs = a.join(b, same & (F.col(f"a.{key}") < F.col(f"b.{key}"))).select(F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"), F.col("a._all").alias("_x"), F.col("b._all").alias("_y")).distinct()
    j = F.size(F.array_intersect("_x", "_y")) / F.size(F.array_union("_x", "_y"))
    return pairs.withColumn("jaccard", j).where(F.col("jaccard") >= tau - 1e-12).select("a", "b", "jaccard")


def acronyms(labels: DataFrame, key: str, text: str, within: list[str]) -> DataFrame:
    """Pairs (a short, b long): a is one token of two letters or more that spells the initials of b's tokens."""
    toks = F.filter(F.split(F.trim(F.col(text)), r"\s+"), lambda x: x != "")
    rows = labels.select(*within, key, toks.alias("_t"))
    short = rows.where((F.size("_t") == 1) & (F.length(F.col("_t")[0]) >= 2)).select(*within, F.col(key).alias("a"), F.col("_t")[0].alias("_i"))
    long = rows.where(F.size(F.array_distinct("_t")) >= 2).select(*within, F.col(key).alias("b"), F.array_join(F.transform("_t", lambda x: F.substring(x, 1, 1)), "").alias("_i"))
    return short.join(long, [*within, "_i"]).select(*within, "a", "b")
