"""Queries of the A family."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.access import most_restrictive
from corpusloom.operators import rollups as R
from corpusloom.operators.rows import latest
from corpusloom.registry import Tables, query

_AR = "case {c} when 'open_access' then 1 when 'metadata_only' then 2 when 'licensed_future' then 3 when 'unknown' then 4 else 5 end"
_NAME = "case coalesce({r}, 5) when 1 then 'open_access' when 2 then 'metadata_only' when 3 then 'licensed_future' when 4 then 'unknown' else 'user_supplied_private' end"
_PR = "case provenance when 'manual_override' then 3 when 'parsed_bibliography' then 2 else 1 end"


@query("select coalesce(task, 'TOTAL') as k, count(*) as calls, round(coalesce(sum(cost), 0), 4) as cost from {v_usage} group by grouping sets ((task), ())")
def a1_usage_rollup(t: Tables) -> DataFrame:
    return R.usage_rollup(t.v_usage, "task")


@query("select ym, round(coalesce(sum(cost), 0), 4) as spend from {v_usage} group by ym")
def a2_monthly_spend(t: Tables) -> DataFrame:
    return R.monthly_spend(t.v_usage)


@query("select target, count(distinct source) as citers from {v_edges} group by target")
def a3_cocitation(t: Tables) -> DataFrame:
    return R.cocitation(t.v_edges)


@query(f"""select source, target, run_id, string_agg(distinct provenance, ',' order by provenance) as provenances,
  case max({_PR}) when 3 then 'manual_override' when 2 then 'parsed_bibliography' else 'provider_reference' end as winner
from {{v_edges}} group by source, target, run_id having count(distinct provenance) > 1""")
def a4_edge_disagreements(t: Tables) -> DataFrame:
    return R.edge_disagreements(t.v_edges)


@query(f"""select source, target, run_id, provenance, confidence from (select *, row_number() over (partition by source, target, run_id order by {_PR} desc, confidence desc) as r from {{v_edges}}) x where r = 1""")
def a5_authoritative_edges(t: Tables) -> DataFrame:
    return R.authoritative_edges(t.v_edges)


@query(f"""with one as (select distinct work_id, concept_id from {{v_claim_concepts}}), n as (select concept_id, count(*) as n from one group by 1),
acc as (select concept_id, max({_AR.format(c="access_class")}) as r from {{v_claim_concepts}} group by 1),
s as (select a.concept_id as concept_a, b.concept_id as concept_b, count(*) as shared from one a join one b on a.work_id = b.work_id and a.concept_id < b.concept_id group by 1, 2 having count(*) >= 2)
select concept_a, concept_b, shared, round(shared / (na.n + nb.n - shared), 6) as jaccard, {_NAME.format(r="greatest(ra.r, rb.r)")} as access_class
from s join n na on na.concept_id = concept_a join n nb on nb.concept_id = concept_b join acc ra on ra.concept_id = concept_a join acc rb on rb.concept_id = concept_b""")
def a6_co_occurrence(t: Tables) -> DataFrame:
    return R.co_occurrence(t.v_claim_concepts)


@query("""select concept_id, count(distinct work_id) as paper_frequency, round(ln((select count(distinct work_id) from {v_claim_concepts}) / count(distinct work_id)), 6) as weight
from {v_claim_concepts} group by concept_id""")
def a7_idf_weights(t: Tables) -> DataFrame:
    return R.idf_weights(t.v_claim_concepts)


@query("select concept_id, count(distinct work_id) as paper_frequency from {v_claim_concepts} group by concept_id")
def a8_paper_frequency(t: Tables) -> DataFrame:
    return R.paper_frequency(t.v_claim_concepts)


_KEY = "trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""with r as (select *, {_KEY} as label_key from {{v_claim_concepts}}), ty as (select label_key, concept_type, count(*) as n from r group by 1, 2),
m as (select label_key, concept_type as majority_type from (select *, row_number() over (partition by label_key order by n desc, concept_type) as k from ty) x where k = 1)
select label_key, count(distinct claim_id) as claims, count(distinct work_id) as works, count(distinct label) as surfaces, first(label order by length(label) desc, label) as canonical, any_value(majority_type) as majority_type
from r join m using (label_key) group by label_key""")
def a9_gather_labels(t: Tables) -> DataFrame:
    return R.gather_labels(t.v_claim_concepts, F.trim(F.regexp_replace(F.lower("label"), "[^a-z0-9]+", " ")))


@query("""select p_type as label_key, first(p_name order by (p_brand = 'Brand#1'), length(p_name) desc, p_name) as picked from {part} group by p_type""")
def a10_pick_label(t: Tables) -> DataFrame:
    return R.pick_label(t.part.withColumn("label_key", F.col("p_type")), "label_key", "p_name", "p_brand", ["Brand#1"])


_EP = "case epistemic_type when 'user_validated' then 6 when 'llm_extracted' then 2 else 1 end"


@query(f"""select work_id, concept_id, case max({_EP}) when 6 then 'user_validated' when 2 then 'llm_extracted' else 'llm_inferred' end as epistemic_type,
  {_NAME.format(r=f"max({_AR.format(c='access_class')})")} as access_class from {{v_claim_concepts}} group by 1, 2""")
def a11_discusses(t: Tables) -> DataFrame:
    return R.discusses(t.v_claim_concepts)


@query("""with ids as (select distinct concept_id from {v_claim_concepts} union all select 'concept::none'), g as (select concept_id, count(distinct work_id) as works, count(distinct claim_id) as claims, count(distinct span_id) as spans from {v_claim_concepts} group by 1)
select concept_id, coalesce(works, 0) as works, coalesce(claims, 0) as claims, coalesce(spans, 0) as spans from ids left join g using (concept_id)""")
def a12_provenance_counts(t: Tables) -> DataFrame:
    ids = t.v_claim_concepts.select("concept_id").distinct().union(t.spark.createDataFrame([("concept::none",)], "concept_id string"))
    return R.provenance_counts(t.v_claim_concepts, ids)


@query("""with pf as (select concept_type, concept_id, count(distinct work_id) as pf from {v_claim_concepts} group by 1, 2),
bg as (select concept_id, sum(pf)::bigint as pf from pf group by 1 order by 2 desc, 1 limit 5),
top as (select concept_type, concept_id, pf, row_number() over (partition by concept_type order by pf desc, concept_id) as place, greatest(count(*) over (partition by concept_type) - 3, 0) as more from pf where concept_id not in (select concept_id from bg))
select 'background' as concept_type, concept_id, pf, row_number() over (order by pf desc, concept_id) as place, 0 as more from bg union all select * from top where place <= 3""")
def a13_orientation(t: Tables) -> DataFrame:
    return R.orientation(t.v_claim_concepts)


@query("""select count(*) as works, count(*) filter (status = 'included') as included, count(*) filter (status = 'metadata_only') as metadata_only, count(*) filter (status = 'excluded') as excluded,
  count(l.doc_id) as covered, round(100.0 * count(l.doc_id) / count(*), 4) as coverage from {v_works} w left join (select distinct doc_id from {labels}) l on l.doc_id = w.work_id""")
def a14_dashboard(t: Tables) -> DataFrame:
    return R.dashboard(t.v_works, t.labels.select(F.col("doc_id").alias("work_id")))


@query("""select w.work_id, w.status, exists (select 1 from {v_gold} g where g.doc_id = w.work_id) as cited, exists (select 1 from {labels} l where l.doc_id = w.work_id) as labelled, w.text is not null as has_text from {v_works} w""")
def a15_corpus_flags(t: Tables) -> DataFrame:
    from corpusloom.operators.joins import exists_flag

    rows = exists_flag(t.v_works, t.v_gold.select(F.col("doc_id").alias("work_id")), "work_id", "cited")
    rows = exists_flag(rows, t.labels.select(F.col("doc_id").alias("work_id")), "work_id", "labelled")
    return rows.select("work_id", "status", "cited", "labelled", F.col("text").isNotNull().alias("has_text"))


@query("""select w.work_id, case when w.status = 'excluded' then 'excluded' when l.doc_id is not null and l.quality = 0 then 'needs_review' when l.doc_id is not null then 'acquired' when w.access_class = 'open_access' then 'available' else 'missing' end as state
from {v_works} w left join {labels} l on l.doc_id = w.work_id""")
def a16_acquisition_state(t: Tables) -> DataFrame:
    from corpusloom.operators.joins import acquisition_state

    return acquisition_state(t.v_works, t.labels.select(F.col("doc_id").alias("work_id"), "quality"))


@query("""select source as lens, count(*) filter (contains(lower(text), 'the ')) as found, count(*) filter (not contains(lower(text), 'the ')) as not_found, count(*) as total, round(count(*) filter (contains(lower(text), 'the ')) / count(*), 6) as coverage from {documents} group by 1""")
def a17_lens_coverage(t: Tables) -> DataFrame:
    hit = F.contains(F.lower("text"), F.lit("the "))
    return t.documents.groupBy(F.col("source").alias("lens")).agg(
        F.count_if(hit).alias("found"), F.count_if(~hit).alias("not_found"), F.count(F.lit(1)).alias("total"), F.round(F.count_if(hit) / F.count(F.lit(1)), 6).alias("coverage")
    )


@query(f"""select source, {_NAME.format(r=f"max(case when access_class is null then null else {_AR.format(c='access_class')} end)")} as ignoring_null,
 {_NAME.format(r="max(case when access_class is null or access_class in ('', 'unknown') then 5 else " + _AR.format(c="access_class") + " end)")} as null_private from {{v_works}} group by source""")
def a18_access_fold(t: Tables) -> DataFrame:
    return t.v_works.groupBy("source").agg(most_restrictive("access_class").alias("ignoring_null"), most_restrictive("access_class", True).alias("null_private"))


@query("select event as status, count(*) as runs from (select run_id, event, row_number() over (partition by run_id order by seq desc) as r from {v_runs}) x where r = 1 group by 1")
def a19_status_tally(t: Tables) -> DataFrame:
    return latest(t.v_runs.select("run_id", "seq", "event"), ["run_id"], "seq").groupBy(F.col("event").alias("status")).agg(F.count(F.lit(1)).alias("runs"))


@query("select target, count(distinct source) as votes from {v_edges} where source <= 20 and target > 20 group by target")
def a20_frontier_counts(t: Tables) -> DataFrame:
    return R.cocitation(t.v_edges.where("source <= 20 and target > 20")).withColumnRenamed("citers", "votes")


@query("""with p as (select distinct p_type, p_name from {part}) select sha256('[' || string_agg('["' || p_type || '","' || p_name || '"]', ',' order by p_type, p_name) || ']') as set_hash, count(*) as n from p""")
def a21_set_hash(t: Tables) -> DataFrame:
    return R.set_hash(t.part, "p_type", "p_name")


@query("select lang, count(*) as rows, coalesce(sum(strlen(text)), 0)::bigint as bytes from {documents} group by lang")
def a22_size_stats(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long").alias("bytes"))


@query("select run_id, event as last_event, seq as events from (select run_id, event, seq, row_number() over (partition by run_id order by seq desc) as r from {v_runs}) x where r = 1")
def a23_run_inventory(t: Tables) -> DataFrame:
    return latest(t.v_runs.select("run_id", "seq", "event"), ["run_id"], "seq").select("run_id", F.col("event").alias("last_event"), F.col("seq").alias("events"))
