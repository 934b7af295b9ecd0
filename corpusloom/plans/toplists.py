"""Queries of the O and U families."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.operators import rows as R
from corpusloom.operators import toplists as L
from corpusloom.registry import Tables, query


@query("select target, count(*) as score from {v_part_edges} group by 1 order by score desc, target limit 25")
def o1_top_k(t: Tables) -> DataFrame:
    return R.top_k(t.v_part_edges.groupBy("target").agg(F.count(F.lit(1)).alias("score")), 25, F.desc("score"), "target")


@query("""with d as (select target as work_id, count(distinct source) as n from {v_edges} group by 1) select work_id, n, case when n >= 90 then 'central' else 'related' end as hint from d where work_id not in (select l_suppkey from {lineitem} where l_orderkey % 1500 = 0) order by n desc, work_id limit 10""")
def o2_read_next(t: Tables) -> DataFrame:
    score = t.v_edges.groupBy(F.col("target").alias("work_id")).agg(F.countDistinct("source").alias("n"))
    read = t.lineitem.where("l_orderkey % 1500 = 0").select(F.col("l_suppkey").alias("work_id"))
    return L.read_next(score, read, "n", 10).select("work_id", "n", F.when(F.col("n") >= 90, "central").otherwise("related").alias("hint"))


@query("""select s_suppkey as work_id, coalesce(n, 0) as cited_by from {supplier} left join (select target, count(distinct source) as n from {v_edges} group by 1) e on target = s_suppkey where s_suppkey in (select c_nationkey from {customer}) order by cited_by desc, work_id limit 15""")
def o3_worklist(t: Tables) -> DataFrame:
    works = t.supplier.select(F.col("s_suppkey").alias("work_id"))
    return L.worklist(works, t.v_edges, t.customer.select(F.col("c_nationkey").alias("work_id")), 15)


@query("select p_type, p_partkey, place from (select p_type, p_partkey, row_number() over (partition by p_type order by p_retailprice desc, p_partkey) as place from {part}) x where place <= 4")
def o4_top_k_per_group(t: Tables) -> DataFrame:
    return R.top_k_by(t.part, ["p_type"], 4, F.desc("p_retailprice"), F.asc("p_partkey")).select("p_type", "p_partkey", "place")


@query("""with c as (select page_id, regexp_replace(lower(url), '^https?://|[/#?].*$', '', 'g') as host, case when url like 'https:%' then 0 else 1 end as tier from {pages}),
u as (select *, row_number() over (partition by host order by tier, page_id) as r from c) select page_id, host, tier, row_number() over (order by tier, page_id) as place from u where r = 1 order by tier, page_id limit 5""")
def o5_candidate_ranking(t: Tables) -> DataFrame:
    c = t.pages.select("page_id", F.regexp_replace(F.lower("url"), "^https?://|[/#?].*$", "").alias("host"), F.when(F.col("url").startswith("https:"), 0).otherwise(1).alias("tier"))
    one = R.earliest(c, ["host"], "tier", "page_id")
    return R.top_k(one, 5, "tier", "page_id").withColumn("place", F.row_number().over(W.orderBy("tier", "page_id")))


@query("""with d as (select concept_id, count(distinct work_id) as degree from {v_claim_concepts} group by 1), h as (select degree, count(*) as n from d group by 1), c as (select degree, sum(n) over (order by degree desc) as at_least from h), m as (select max(degree) as degree from c where at_least >= 30)
select (case when degree is null then 1 when degree > 50 then degree + 1 else degree end)::bigint as cutoff from m""")
def o6_label_cutoff(t: Tables) -> DataFrame:
    return L.label_cutoff(t.v_claim_concepts.groupBy("concept_id").agg(F.countDistinct("work_id").alias("degree")))


_KINDS = "select 'work' as kind, cast(doc_id as varchar) as id from {documents} union all select 'part', cast(p_partkey as varchar) from {part} union all select 'supplier', cast(s_suppkey as varchar) from {supplier}"


@query(f"select kind, id, place from (select kind, id, row_number() over (partition by kind order by md5('7:' || id), id) as place from ({_KINDS}) k) x where place <= 10")
def o7_audit_sample(t: Tables) -> DataFrame:
    ids = lambda kind, df, c: df.select(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("id"))
    return L.seeded_sample(ids("work", t.documents, "doc_id").union(ids("part", t.part, "p_partkey")).union(ids("supplier", t.supplier, "s_suppkey")), "kind", "id", 7, 10)


@query("select work_id, title from {v_works} where status = 'metadata_only' and work_id not in (select doc_id from {labels}) and work_id not in (select doc_id from {v_gold}) order by work_id limit 5")
def o8_recommendations(t: Tables) -> DataFrame:
    bare = t.v_works.where("status = 'metadata_only'").join(t.labels.select(F.col("doc_id").alias("work_id")), "work_id", "left_anti").join(t.v_gold.select(F.col("doc_id").alias("work_id")), "work_id", "left_anti")
    return R.top_k(bare.select("work_id", "title"), 5, "work_id")


@query("""select s_suppkey as work_id, s_suppkey % 10 = 0 as is_seed, coalesce(n, 0) as n from {supplier} left join (select target, count(*) as n from {v_edges} group by 1) e on target = s_suppkey order by is_seed desc, n desc, work_id limit 20""")
def o9_acquisition_order(t: Tables) -> DataFrame:
    works = t.supplier.select(F.col("s_suppkey").alias("work_id"), (F.col("s_suppkey") % 10 == 0).alias("is_seed"))
    counts = t.v_edges.groupBy(F.col("target").alias("work_id")).agg(F.count(F.lit(1)).alias("n"))
    return R.top_k(works.join(counts, "work_id", "left").withColumn("n", F.coalesce("n", F.lit(0))), 20, F.desc("is_seed"), F.desc("n"), "work_id")


_BRANCH = "select 0 as branch, work_id from {v_works} where status = 'included' and year >= 2010 union all select 1, work_id from {v_works} where length(text) > 2000 union all select 2, doc_id from {v_gold}"


@query(f"select work_id, min(branch) as branch from ({_BRANCH}) b group by 1 order by branch, work_id limit 300")
def u1_priority_union(t: Tables) -> DataFrame:
    w = t.v_works
    return L.priority_union([w.where("status = 'included' and year >= 2010").select("work_id"), w.where("length(text) > 2000").select("work_id"), t.v_gold.select(F.col("doc_id").alias("work_id"))], "work_id", 300)


@query("select source, target, provenance, run_id from {v_edges} union select source, target, provenance, run_id from {v_part_edges}")
def u2_edge_union(t: Tables) -> DataFrame:
    key = ["source", "target", "provenance", "run_id"]
    return t.v_edges.select(*key).unionByName(t.v_part_edges.select(*key)).dropDuplicates(key)


@query("select p_name as a, p_type as b from {part} where p_partkey % 2 = 0 intersect select p_name, p_type from {part} where p_partkey % 2 = 1")
def u3_contradictions(t: Tables) -> DataFrame:
    pair = lambda df: df.select(F.col("p_name").alias("a"), F.col("p_type").alias("b"))
    return pair(t.part.where("p_partkey % 2 = 0")).intersect(pair(t.part.where("p_partkey % 2 = 1")))


@query("select distinct conv_id * 3 as ref from {conversations} except select distinct conv_id from {conversations}")
def u4_missing_refs(t: Tables) -> DataFrame:
    refs = t.conversations.select((F.col("conv_id") * 3).alias("ref")).distinct()
    return refs.join(t.conversations.select(F.col("conv_id").alias("ref")), "ref", "left_anti")


@query("select distinct conv_id from {conversations} where conv_id in (select doc_id from {labels}) or conv_id in (select p_partkey from {part} where p_partkey % 2 = 0) or conv_id in (select user_id from {events} where value > 400)")
def u5_existence_probe(t: Tables) -> DataFrame:
    homes = t.labels.select(F.col("doc_id").alias("conv_id")).union(t.part.where("p_partkey % 2 = 0").select("p_partkey")).union(t.events.where("value > 400").select("user_id"))
    return t.conversations.select("conv_id").distinct().join(homes, "conv_id", "left_semi")


@query("""select host, page_id, provider from (select *, row_number() over (partition by host order by provider, page_id) as r from (select page_id, page_id % 3 as provider, regexp_replace(lower(url), '^https?://|[/#?].*$', '', 'g') as host from {pages}) c) x where r = 1""")
def u6_provider_merge(t: Tables) -> DataFrame:
    c = t.pages.select("page_id", (F.col("page_id") % 3).alias("provider"), F.regexp_replace(F.lower("url"), "^https?://|[/#?].*$", "").alias("host"))
    return R.earliest(c, ["host"], "provider", "page_id")


@query("select user_id, event_type as response, p as provider from (select user_id, event_type, event_id % 4 as p, row_number() over (partition by user_id order by event_id % 4, event_id) as r from {events} where value > 50) x where r = 1")
def u7_first_response(t: Tables) -> DataFrame:
    e = t.events.where("value > 50").select("user_id", F.col("event_type").alias("response"), (F.col("event_id") % 4).alias("provider"), "event_id")
    return R.earliest(e, ["user_id"], "provider", "event_id").drop("event_id")
