"""Filters, projections and masks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.access import shareable
from corpusloom.operators.windows import line_rows


def corpus_works(works: DataFrame, statuses: list[str]) -> DataFrame:
    return works.where(F.col("status").isin(*statuses))


def not_excluded(df: DataFrame, members: DataFrame, key: str = "work_id") -> DataFrame:
    """Drops works marked excluded; those without membership pass."""
    return df.join(members.where("status = 'excluded'").select(key), key, "left_anti")


def allowlisted(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if c in names])


def redacted(df: DataFrame, access: str, texts: list[str]) -> DataFrame:
    """Text columns withheld where the row is not shareable; ids stay."""
    return df.select(*[F.when(shareable(access), F.col(c)).alias(c) if c in texts else F.col(c) for c in df.columns])


def anchor_match(docs: DataFrame, doc: str, text: str, anchors: list[str], negative: list[str]) -> DataFrame:
    """For each document the first anchor in list order, and the first line that holds it and no negative one; else not_found."""
    lines = line_rows(docs, doc, text).withColumn("_b", F.lower("body"))
    bad = F.lit(False)
    for n in negative:
        bad = bad | F.contains("_b", F.lit(n.lower()))
    which = F.filter(F.array(*[F.when(F.contains(F.col("_b"), F.lit(a.lower())), F.lit(i)) for i, a in enumerate(anchors)]), lambda x: x.isNotNull())
    hit = lines.where(~bad).select(doc, "line", F.explode(which).alias("anchor"))
    best = hit.groupBy(doc).agg(F.min(F.struct("anchor", "line")).alias("m"))
    names = F.array(*[F.lit(a) for a in anchors])
    return docs.select(doc).join(best, doc, "left").select(doc, F.when(F.col("m").isNull(), "not_found").otherwise("found").alias("status"), F.try_element_at(names, F.col("m.anchor") + 1).alias("anchor"), F.col("m.line").alias("line"))


def record_issues(value: dict[str, Column], required: list[str], allowed: dict[str, list[str]]) -> Column:
    """Array of what is wrong with a record: a missing field, or a value outside its list."""
    missing = [F.when(value[c].isNull(), F.lit(f"missing:{c}")) for c in required]
    outside = [F.when(value[c].isNotNull() & ~value[c].isin(*words), F.lit(f"value:{c}")) for c, words in allowed.items()]
    return F.filter(F.array(*missing, *outside), lambda x: x.isNotNull())


# Declared types of a record's field, and the kinds of JSON value each takes.
FIELD_TYPES = {"string": "STRING|CHAR.*", "string_or_null": "STRING|CHAR.*", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "integer": "BIGINT", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*"}


def record_status(record: Column | str, rules: dict[str, dict], need_span: bool = True, explain_inferred: bool = True) -> Column:
    """struct(status, issues) of a record (JSON text), by the rules of a user.

    ``rules`` gives for a field what it must be: ``type`` (of FIELD_TYPES;
    others take any value), ``required``, ``allowed`` (values; those of an
    array singly). A field that is null is missing. Any issue (missing:f,
    type:f, value:f), or text that is no JSON object, is extraction_failed.
    Else not_found and not_applicable stay as they are; an inferred record
    without notes is extraction_failed, and one without evidence span is
    ambiguous, if these are asked for; the rest is found.
    """
    v = F.try_parse_json(F.col(record) if isinstance(record, str) else record)
    kind = F.schema_of_variant(v)
    at = lambda f, t="variant": F.try_variant_get(v, f"$['{f}']", t)
    text = lambda f: F.when(F.schema_of_variant(at(f)).rlike(f"^(?:{FIELD_TYPES['string']})$"), at(f, "string"))
    issues = []
    for f, rule in rules.items():
        held = F.schema_of_variant(at(f))
        there = F.coalesce(held != "VOID", F.lit(False))
        fits = held.rlike(f"^(?:{FIELD_TYPES[rule['type']]})$") if rule.get("type") in FIELD_TYPES else F.lit(True)
        if rule.get("required"):
            issues.append(F.when(~there, f"missing:{f}"))
        issues.append(F.when(there & ~fits, f"type:{f}"))
        if rule.get("allowed") is not None:
            words = F.array(*[F.lit(json.dumps(w, ensure_ascii=False)) for w in rule["allowed"]]).cast("array<string>")
            own = F.when(held.startswith("ARRAY"), F.transform(at(f, "array<variant>"), lambda x: F.to_json(x))).otherwise(F.array(F.to_json(at(f))))
            issues.append(F.when(there & fits & (F.size(F.array_except(own, words)) > 0), f"value:{f}"))
    issues.append(F.when(~F.coalesce(kind.startswith("OBJECT"), F.lit(False)), "record"))
    wrong = F.filter(F.array(*issues), lambda x: x.isNotNull())
    declared = F.coalesce(F.when(text("status") != "", text("status")), F.lit("found"))
    said = F.coalesce(F.when(text("stated_or_inferred") != "", text("stated_or_inferred")), text("assertion_status"))
    spans = F.filter(F.coalesce(at("evidence_span_ids", "array<string>"), F.array().cast("array<string>")), lambda x: x != "")
    bare = F.coalesce(F.trim(text("notes")), F.lit("")) == ""
    inferred = F.lit(explain_inferred) & F.coalesce(said == "inferred", F.lit(False)) & bare
    status = (
        F.when(F.size(wrong) > 0, "extraction_failed")
        .when(declared.isin("not_found", "not_applicable"), declared)
        .when(inferred, "extraction_failed")
        .when(F.lit(need_span) & (F.size(spans) == 0), "ambiguous")
        .otherwise("found")
    )
    more = F.when(status == "ambiguous", F.array(F.lit("no span"))).when((F.size(wrong) == 0) & (status == "extraction_failed"), F.array(F.lit("no notes"))).otherwise(wrong)
    return F.struct(status.alias("status"), more.alias("issues"))


def pages_of(docs: DataFrame, doc: str, text: str, size: int) -> DataFrame:
    """Windows of ``size`` code points."""
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / size)).cast("int")
    p = docs.select(doc, text, F.explode(F.sequence(F.lit(0), n - 1)).alias("page"))
    return p.select(doc, "page", F.substring(F.col(text), F.col("page") * size + 1, F.lit(size)).alias("body"))


def expand_context(spans: DataFrame, docs: DataFrame, doc: str, window: int) -> DataFrame:
    """The span with ``window`` code points on both sides; the stored quote where the text is no longer that of ``text_hash`` (sha2)."""
    got = spans.join(docs.select(doc, F.col("text").alias("_t")), doc, "left")
    live = F.sha2(F.col("_t"), 256) == F.col("text_hash")
    a = F.greatest(F.col("start_char") - window, F.lit(0))
    wide = F.substring(F.col("_t"), (a + 1).cast("int"), (F.col("end_char") + window - a).cast("int"))
    return got.select(doc, "start_char", F.when(F.coalesce(live, F.lit(False)), wide).otherwise(F.col("exact_quote")).alias("context"))


def without_sections(docs: DataFrame, sections: DataFrame, doc: str, kind: str, marker: str) -> DataFrame:
    """Texts rebuilt from their sections without those of a kind, a marker in their place; unchanged if nothing else remains."""
    s = sections.join(docs.select(doc, "text"), doc)
    body = F.when(F.col("kind") == kind, F.lit(marker)).otherwise(F.substring(F.col("text"), (F.col("start_char") + 1).cast("int"), (F.col("end_char") - F.col("start_char")).cast("int")))
    got = s.select(doc, "ordinal", body.alias("b"), (F.col("kind") == kind).alias("gone")).groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "b"))), lambda x: x["b"]), "").alias("new"), F.min("gone").alias("all_gone"))
    return docs.select(doc, "text").join(got, doc, "left").select(doc, F.when(F.coalesce("all_gone", F.lit(True)), F.col("text")).otherwise(F.col("new")).alias("text"))
