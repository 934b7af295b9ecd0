"""Queries of the P family."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import corpus as C
from corpusloom.operators import graph as G
from corpusloom.operators import select as P
from corpusloom.operators.rows import upsert_last_wins
from corpusloom.registry import Tables, query

_SH = "coalesce(access_class in ('open_access', 'metadata_only'), false)"


@query("select work_id, year, status from {v_works} where status in ('included', 'metadata_only')")
def p1_corpus_works(t: Tables) -> DataFrame:
    return P.corpus_works(t.v_works, ["included", "metadata_only"]).select("work_id", "year", "status")


@query("select l_orderkey as work_id, count(*) as n from {lineitem} where l_orderkey not in (select work_id from {v_works} where status = 'excluded') group by 1")
def p2_not_excluded(t: Tables) -> DataFrame:
    return P.not_excluded(t.lineitem.select(F.col("l_orderkey").alias("work_id")), t.v_works).groupBy("work_id").agg(F.count(F.lit(1)).alias("n"))


@query("select page_id, url from {pages}")
def p3_allowlist(t: Tables) -> DataFrame:
    return P.allowlisted(t.pages, ["page_id", "url", "title"])


def _graph(t: Tables) -> tuple[DataFrame, DataFrame]:
    works = t.supplier.select(F.col("s_suppkey").alias("node"), F.lit("work").alias("kind"), F.lit(None).cast("string").alias("access_class"), F.col("s_name").alias("definition"))
    concepts = t.part.select((F.col("p_partkey") + 1000000).alias("node"), F.lit("concept").alias("kind"), F.when(F.col("p_size") % 2 == 0, "open_access").otherwise("unknown").alias("access_class"), F.col("p_name").alias("definition"))
    edges = t.lineitem.select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") + 1000000).alias("target"), F.when(F.col("l_linestatus") == "O", "open_access").otherwise("licensed_future").alias("access_class"))
    return works.union(concepts), edges


@query("select count(*) as edges, count(distinct l_partkey) as concepts from {lineitem} join {part} on p_partkey = l_partkey where l_linestatus = 'O' and p_size % 2 = 0")
def p4_export_gate(t: Tables) -> DataFrame:
    _, edges = G.export_gate(*_graph(t))
    return edges.agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("target").alias("concepts"))


@query("select source, target, provenance from {v_edges} where provenance <> 'parsed_bibliography'")
def p5_shareable_edges(t: Tables) -> DataFrame:
    return t.v_edges.where(F.col("provenance").isin("manual_override", "provider_reference")).select("source", "target", "provenance")


@query(f"select work_id, case when {_SH} then title end as title, case when {_SH} then text end as text from {{v_works}}")
def p6_redaction(t: Tables) -> DataFrame:
    return P.redacted(t.v_works.select("work_id", "title", "text", "access_class"), "access_class", ["title", "text"]).drop("access_class")


@query("select p_partkey, p_name, p_retailprice from {part} where p_type = 'PROMO' and p_size > 25 order by p_retailprice desc, p_partkey limit 50")
def p7_concept_list(t: Tables) -> DataFrame:
    return t.part.where("p_type = 'PROMO' and p_size > 25").select("p_partkey", "p_name", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(50)


@query("""with ln as (select doc_id, unnest(string_split(text, chr(10))) as b, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line from {documents}), h as (select doc_id, line, unnest(list_filter([case when contains(lower(b), 'license') then 0 end, case when contains(lower(b), 'thou') then 1 end], lambda x: x is not null)) as anchor from ln where not contains(lower(b), 'mit')),
m as (select doc_id, anchor, line from (select *, row_number() over (partition by doc_id order by anchor, line) as r from h) x where r = 1) select d.doc_id, case when m.doc_id is null then 'not_found' else 'found' end as status, case anchor when 0 then 'license' when 1 then 'thou' end as anchor, line from {documents} d left join m using (doc_id)""")
def p8_anchor_match(t: Tables) -> DataFrame:
    return P.anchor_match(t.documents, "doc_id", "text", ["license", "thou"], ["MIT"])


@query("select event_id, concat_ws(',', case when value < 5 then 'missing:value' end, case when event_type not in ('view', 'click') then 'value:event_type' end) as issues from {events}")
def p9_record_validation(t: Tables) -> DataFrame:
    v = {"value": F.when(F.col("value") >= 5, F.col("value")), "event_type": F.col("event_type")}
    return t.events.select("event_id", F.array_join(P.record_issues(v, ["value"], {"event_type": ["view", "click"]}), ",").alias("issues"))


_RECORD = """select event_id, '{"kind": "' || event_type || '"' || case event_id % 5 when 0 then '' when 1 then ', "value": "high"' when 2 then ', "value": null' else ', "value": ' || cast(user_id as varchar(20)) end || case event_id % 4 when 0 then ', "tags": ["a", "b"]' when 1 then ', "tags": ["a", "z"]' else '' end
|| case event_id % 7 when 0 then ', "status": "not_found"' when 1 then ', "status": ""' else '' end || case event_id % 3 when 0 then ', "stated_or_inferred": "inferred"' else '' end || case event_id % 6 when 0 then ', "notes": " "' when 3 then ', "notes": "seen"' else '' end || case event_id % 2 when 0 then ', "evidence_span_ids": ["", "s1"]' else ', "evidence_span_ids": [""]' end || case when event_id % 50 = 49 then '' else '}' end as record from {events}"""


@query("""with i as (select *, concat_ws(',', case when event_id % 50 = 49 then 'missing:kind' when event_type = 'error' then 'value:kind' end, case when event_id % 50 = 49 or event_id % 5 in (0, 2) then 'missing:value' when event_id % 5 = 1 then 'type:value' end, case when event_id % 4 = 1 and event_id % 50 <> 49 then 'value:tags' end, case when event_id % 50 = 49 then 'record' end) as wrong from {events})
select event_id, case when wrong <> '' then 'extraction_failed' when event_id % 7 = 0 then 'not_found' when event_id % 6 = 0 then 'extraction_failed' when event_id % 2 = 1 then 'ambiguous' else 'found' end as status,
case when wrong <> '' then wrong when event_id % 7 = 0 then '' when event_id % 6 = 0 then 'no notes' when event_id % 2 = 1 then 'no span' else '' end as issues from i""")
def x4_record_rules(t: Tables) -> DataFrame:
    """Records by a user's own rules: types, required fields, allowed values, then the rules of evidence."""
    rules = {"kind": {"type": "string", "required": True, "allowed": ["view", "click", "purchase", "signup"]}, "value": {"type": "integer", "required": True}, "tags": {"type": "array", "allowed": ["a", "b"]}}
    records = t.spark.sql(_RECORD.replace("{events}", "{e}").replace('{"kind"', '{{"kind"').replace("else '}' end", "else '}}' end"), e=t.events)
    got = records.select("event_id", P.record_status("record", rules).alias("r"))
    return got.select("event_id", "r.status", F.array_join("r.issues", ",").alias("issues"))


@query("select work_id, page, substr(text, page * 500 + 1, 500) as body from (select work_id, text, unnest(range(greatest(1, ceil(length(text) / 500)::int))) as page from {v_docs}) x")
def p10_paged_read(t: Tables) -> DataFrame:
    return P.pages_of(t.v_docs, "work_id", "text", 500)


@query("with s as (select doc_id, text, 50 as a, 80 as b from {documents} where length(text) > 100) select doc_id, a as start_char, case when doc_id % 3 = 0 then substr(text, 51, 30) else substr(text, 1, 280) end as context from s".replace("substr(text, 1, 280)", "substr(text, 1, 280)"))
def p11_context(t: Tables) -> DataFrame:
    d = t.documents.where("length(text) > 100")
    spans = d.select("doc_id", F.lit(50).alias("start_char"), F.lit(80).alias("end_char"), F.substring("text", 51, 30).alias("exact_quote"), F.sha2("text", 256).alias("text_hash"))
    now = d.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("changed "), F.col("text"))).otherwise(F.col("text")))
    return P.expand_context(spans, now, "doc_id", 200)


@query("select work_id, 'kept' as state from {v_docs}")
def p12_strip_sections(t: Tables) -> DataFrame:
    docs = t.v_docs
    got = P.without_sections(docs, C.sections(docs), "work_id", "references", "[references removed]")
    return got.join(docs.select("work_id", F.col("text").alias("old")), "work_id").select("work_id", F.when(F.col("text") == F.col("old"), "kept").otherwise("changed").alias("state"))


@query("select user_id as work_id, event_type as status, event_id as at from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from {events}) x where r = 1")
def p14_membership(t: Tables) -> DataFrame:
    log = t.events.select(F.col("user_id").alias("work_id"), F.col("event_type").alias("status"), "ts", F.col("event_id").alias("at"))
    return upsert_last_wins(log.where("at % 2 = 0"), log.where("at % 2 = 1"), ["work_id"], "ts", "at").select("work_id", "status", "at")


@query("select work_id, lang, status, coalesce(quality, -1) as quality from {v_works} left join {labels} on doc_id = work_id where status <> 'excluded'")
def p15_document_list(t: Tables) -> DataFrame:
    got = t.v_works.where("status <> 'excluded'").join(t.labels.select(F.col("doc_id").alias("work_id"), "quality"), "work_id", "left")
    return got.select("work_id", "lang", "status", F.coalesce("quality", F.lit(-1)).alias("quality"))


