"""Adapter views: the library's tables (works, documents, edges, claims, runs, gold) over the test tables.

One text serves both engines: ``{name}`` is a base table or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_EDGE = """
select a.{key} as source, b.{key} as target,
  case b.l_returnflag when 'A' then 'manual_override' when 'N' then 'parsed_bibliography' else 'provider_reference' end as provenance,
  cast(round(1 - b.l_discount, 2) as double) as confidence, cast(year(b.l_shipdate) as int) as run_id
from {{lineitem}} a join {{lineitem}} b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1
where a.{key} <> b.{key}"""

VIEWS: dict[str, str] = {
    "v_works": """
select doc_id as work_id, split_part(text, chr(10), 1) as title, cast(1990 + doc_id % 30 as int) as year,
  case when doc_id % 10 = 0 then 'excluded' when doc_id % 10 < 3 then 'metadata_only' else 'included' end as status,
  case doc_id % 6 when 0 then 'open_access' when 1 then 'metadata_only' when 2 then 'licensed_future' when 3 then 'unknown' when 4 then null else 'user_supplied_private' end as access_class,
  text, source, lang
from {documents}""",
    "v_docs": """
select conv_id as work_id, {agg} as text from {conversations} group by conv_id""",
    "v_edges": _EDGE.format(key="l_suppkey"),
    "v_part_edges": _EDGE.format(key="l_partkey"),
    "v_small_edges": """
select source, target from (
  select source, target, row_number() over (partition by source order by n desc, target) as r
  from (select source, target, count(*) as n from {v_edges} group by source, target) c) x
where r <= 2""",
    "v_claim_concepts": """
select concat_ws('-', cast(l.l_orderkey as varchar(20)), cast(l.l_linenumber as varchar(20)), cast(l.l_partkey as varchar(20)),
    cast(l.l_suppkey as varchar(20)), cast(cast(l.l_quantity as int) as varchar(20)), cast(cast(l.l_shipdate as date) as varchar(20))) as claim_id,
  l.l_orderkey as work_id, concat('concept::', p.p_name) as concept_id, p.p_name as label, p.p_type as concept_type,
  l.l_suppkey as span_id, l.l_linenumber as rank,
  case l.l_returnflag when 'A' then 'user_validated' when 'N' then 'llm_extracted' else 'llm_inferred' end as epistemic_type,
  case l.l_linestatus when 'O' then 'open_access' else 'licensed_future' end as access_class
from {lineitem} l join {part} p on p.p_partkey = l.l_partkey""",
    "v_runs": """
select user_id as run_id, row_number() over (partition by user_id order by ts, event_id) as seq, event_type as event, ts, value
from {events}""",
    "v_notes": """
select event_id as note_id, user_id as work_id, event_type as schema_id, ts as created_at from {events}""",
    "v_usage": """
select event_id, event_type as task, user_id % 4 as provider, substr(cast(ts as varchar(30)), 1, 7) as ym, value as cost, ts from {events}""",
    "v_questions": """
select item_id as question, case when item_id % 2 = 0 then concat('Where is "', text, '" said?') else text end as text from {benchmark}""",
    "v_ask": """
select b.item_id as question, concat('Show me "', b.text, '" or "', p.p_name, '" or "', case b.item_id % 3 when 0 then 'purchase note' when 1 then 'view' else 'click' end, '"') as text
from {benchmark} b join {part} p on p.p_partkey = b.item_id + 1""",
    "v_claims": """
select claim_id, min(work_id) as work_id, min(label) as label, min(span_id) as span_id, min(access_class) as access_class, min(epistemic_type) as epistemic_type from {v_claim_concepts} group by claim_id""",
    "v_note_texts": """
select note_id, work_id, schema_id, created_at, concat('A ', schema_id, ' note on work ', cast(work_id as varchar(20))) as text from {v_notes}""",
    "v_gold": """
select b.item_id, d.doc_id from {benchmark} b join {documents} d on contains(d.text, b.text)""",
}
_SPARK_AGG = "listagg(concat('## ', role, ' ', turn, chr(10), chr(10), text), concat(chr(10), chr(10))) within group (order by turn)"
_DUCK_AGG = "string_agg(concat('## ', role, ' ', turn, chr(10), chr(10), text), concat(chr(10), chr(10)) order by turn)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_texts(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id) of items whose whole text stands in a document.

    A document that holds an item has each word inside it, between two spaces,
    as a word of its own. The longest is looked up by an equi-join and the
    whole is then confirmed; an item without such a word is compared with all.
    """
    word = F.slice(F.split("text", " "), 2, F.greatest(F.lit(0), F.size(F.split("text", " ")) - 2))
    asked = items.select("item_id", F.col("text").alias("item"), F.array_max(F.transform(word, lambda x: F.struct(F.length(x).alias("n"), x.alias("w"))))["w"].alias("word"))
    keyed = asked.where("word <> ''")
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("word")).join(F.broadcast(keyed.select("word").distinct()), "word", "left_semi")
    met = words.join(keyed, "word").select("doc_id", "item_id", "item").join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", "item"))
    rest = asked.where("word is null or word = ''").join(docs.select("doc_id", "text"), F.contains("text", "item"))
    return met.select("item_id", "doc_id").unionByName(rest.select("item_id", "doc_id"))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return table(spark, sf_dir, name)
    if name == "v_gold":
        return held_texts(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))
    text = VIEWS[name].replace("{agg}", _SPARK_AGG)
    return spark.sql(text, **{x: view(spark, sf_dir, x) for x in set(re.findall(r"\{(\w+)\}", text))})


def duck(text: str) -> str:
    """``text`` with each {view} it needs put before it as a common table expression."""
    need: list[str] = []

    def visit(sql: str) -> None:
        for x in re.findall(r"\{(\w+)\}", sql):
            if x in VIEWS and x not in need:
                visit(VIEWS[x].replace("{agg}", _DUCK_AGG))
                need.append(x)

    visit(text)
    fill = lambda s: re.sub(r"\{(\w+)\}", r"\1", s.replace("{agg}", _DUCK_AGG))
    parts = [f"{x} as ({fill(VIEWS[x])})" for x in need]
    body = fill(text).strip()
    if not parts:
        return body
    if m := re.match(r"(?i)with\s+(recursive\s+)?", body):
        return f"with {m[1] or ''}{', '.join(parts)}, {body[m.end():]}"
    return f"with {', '.join(parts)} {body}"
