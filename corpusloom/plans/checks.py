"""Queries of the Q family."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import checks as Q
from corpusloom.operators import corpus as C
from corpusloom.operators.joins import exists_flag
from corpusloom.operators.rollups import edge_disagreements
from corpusloom.registry import Tables, query


@query("""select 'dangling' as finding, count(*) as n from (select distinct target from {v_edges} where target % 4 = 0) x union all select 'orphan', count(*) from (select distinct p_name from {part}) p where p_name not in (select label from {v_claim_concepts} where work_id % 97 = 1)""")
def q1_dangling_and_orphans(t: Tables) -> DataFrame:
    dangling = t.v_edges.select("target").distinct().join(t.supplier.where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("target")), "target", "left_anti")
    orphan = t.part.select(F.col("p_name").alias("label")).distinct().join(t.v_claim_concepts.where("work_id % 97 = 1"), "label", "left_anti")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("finding"), "n")
    return n(dangling, "dangling").union(n(orphan, "orphan"))


@query("select doc_id, case when doc_id % 5 = 0 then 'missing' when doc_id % 3 = 0 then 'stale' else 'ok' end as anchor from {documents}")
def q2_reference_anchors(t: Tables) -> DataFrame:
    now = t.documents.where("doc_id % 5 <> 0").select("doc_id", F.sha2("text", 256).alias("now"))
    refs = t.documents.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "old").otherwise(F.sha2("text", 256)).alias("then"))
    return refs.join(now, "doc_id", "left").select("doc_id", F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("then"), "stale").otherwise("ok").alias("anchor"))


@query("select 2 * count(*) as total, 2 * count(*) filter (conv_id % 5 = 1) as stale, 2 * count(*) filter (conv_id % 5 = 0) as orphaned from {conversations}")
def q3_span_report(t: Tables) -> DataFrame:
    docs = t.v_docs
    now = docs.where("work_id % 5 <> 0").withColumn("text", F.when(F.col("work_id") % 5 == 1, F.concat(F.lit("~~~~"), F.col("text"))).otherwise(F.col("text")))
    got = C.verify_spans(C.paragraph_spans(docs), now)
    return got.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "stale").alias("stale"), F.count_if(F.col("status") == "orphaned").alias("orphaned"))


@query("""select 'lineitem.order' as "check", count(distinct l_orderkey) as broken from {lineitem} where l_orderkey not in (select o_orderkey from {orders} where o_orderkey % 100 <> 0) union all select 'nation.region', count(distinct n_regionkey) from {nation} where n_regionkey not in (select r_regionkey from {region})""")
def q4_foreign_keys(t: Tables) -> DataFrame:
    return Q.foreign_keys([("lineitem.order", t.lineitem, "l_orderkey", t.orders.where("o_orderkey % 100 <> 0"), "o_orderkey"), ("nation.region", t.nation, "n_regionkey", t.region, "r_regionkey")])


@query("select distinct 'source' as side, source as work_id from {v_edges} where source % 17 = 0 union all select distinct 'target', target from {v_edges} where target % 17 = 0")
def q5_merged_away_refs(t: Tables) -> DataFrame:
    alive = t.supplier.where("s_suppkey % 17 <> 0").select(F.col("s_suppkey").alias("work_id"))
    refs = t.v_edges.select(F.lit("source").alias("side"), F.col("source").alias("work_id")).union(t.v_edges.select(F.lit("target").alias("side"), F.col("target").alias("work_id"))).distinct()
    return refs.join(alive, "work_id", "left_anti").select("side", "work_id")


@query("select distinct source as work_id from {v_edges} where provenance <> 'parsed_bibliography' and source % 6 in (3, 5)")
def q6_boundary(t: Tables) -> DataFrame:
    shared = t.v_edges.where("provenance <> 'parsed_bibliography'").select(F.col("source").alias("work_id"))
    return Q.boundary_leaks(shared, t.supplier.where("s_suppkey % 6 in (3, 5)").select(F.col("s_suppkey").alias("work_id")), "work_id")


_RK = "rk as (select item_id as question, doc_id as item, row_number() over (partition by item_id order by md5(doc_id::varchar)) as place from (select b.item_id, d.doc_id from (select item_id from {benchmark}) b join {v_gold} d on d.doc_id % 3 = b.item_id % 3) x)"


@query(f"""with {_RK}, g as (select distinct item_id as question, doc_id as item from {{v_gold}}) select g.question, round(count(*) filter (place <= 5) / (select count(*) from g h where h.question = g.question), 6)::double as recall, round(count(*) filter (place <= 5) / 5, 6)::double as "precision", round(coalesce(1.0 / min(place), 0), 6)::double as reciprocal_rank from g left join rk using (question, item) group by g.question""")
def q7_ranking_metrics(t: Tables) -> DataFrame:
    from pyspark.sql import Window as W

    pool = t.v_gold.select(F.col("doc_id").alias("item"), (F.col("doc_id") % 3).alias("m"))
    rk = t.benchmark.select(F.col("item_id").alias("question"), (F.col("item_id") % 3).alias("m")).join(pool, "m")
    rk = rk.withColumn("place", F.row_number().over(W.partitionBy("question").orderBy(F.md5(F.col("item").cast("string")))))
    return Q.ranking_metrics(rk, t.v_gold.select(F.col("item_id").alias("question"), F.col("doc_id").alias("item")), 5)


@query("select round(count(distinct doc_id) / (select count(*) from {documents}), 6) as value, 'coverage' as metric from {v_gold}")
def q8_coverage(t: Tables) -> DataFrame:
    flags = exists_flag(t.documents.select("doc_id"), t.v_gold, "doc_id", "hit")
    return Q.rate(flags, "coverage", F.col("hit"))


@query("select 'span_quality' as metric, round(count(*) filter (conv_id % 5 > 1) / count(*), 6) as value from {conversations}")
def q9_span_quality(t: Tables) -> DataFrame:
    docs = t.v_docs
    now = docs.where("work_id % 5 <> 0").withColumn("text", F.when(F.col("work_id") % 5 == 1, F.concat(F.lit("~~~~"), F.col("text"))).otherwise(F.col("text")))
    return Q.rate(C.verify_spans(C.paragraph_spans(docs), now), "span_quality", F.col("status") == "anchored")


@query("""select 'unsupported' as metric, round(count(*) filter (event_type = 'view') / count(*), 6) as value from {events} union all select 'abstention', 1.0 union all select 'correction', round(count(*) filter (quality = 0) / count(*), 6) from {labels} union all select 'note_coverage', round(count(*) filter (doc_id in (select doc_id from {labels})) / count(*), 6) from {documents} where length(text) <= 20000 union all select 'unresolved', round(count(*) filter (target % 7 = 0) / count(*), 6) from {v_edges}""")
def q10_q12_rates(t: Tables) -> DataFrame:
    covered = exists_flag(t.documents.where("length(text) <= 20000").select("doc_id"), t.labels, "doc_id", "has")
    return Q.report(
        Q.rate(t.events, "unsupported", F.col("event_type") == "view"), Q.rate(t.events.where("false"), "abstention", F.lit(True), 1.0), Q.rate(t.labels, "correction", F.col("quality") == 0),
        Q.rate(covered, "note_coverage", F.col("has")), Q.rate(t.v_edges, "unresolved", F.col("target") % 7 == 0),
    )


@query("select source, target, run_id, case when count(distinct provenance) = 3 then 'high' else 'low' end as severity from {v_edges} group by 1, 2, 3 having count(distinct provenance) > 1")
def q13_disagreement_audits(t: Tables) -> DataFrame:
    d = edge_disagreements(t.v_edges)
    return d.select("source", "target", "run_id", F.when(F.size(F.split("provenances", ",")) == 3, "high").otherwise("low").alias("severity"))


@query("select event_type as audit_type, count(*) as opened from {events} where event_type in ('view', 'click') group by 1")
def q14_audit_openers(t: Tables) -> DataFrame:
    return t.events.where(F.col("event_type").isin("view", "click")).groupBy(F.col("event_type").alias("audit_type")).agg(F.count(F.lit(1)).alias("opened"))


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts, event_id) as r from {events}) x where r = 1")
def q15_first_verdicts(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("at"))
    return Q.first_verdicts(e, "user_id", "at").select("user_id", "event_id", "event_type")


@query("select 'edge' as failure, source || '>' || (source + 1) as subject from (select distinct source from {v_edges}) s where not exists (select 1 from {v_edges} e where e.source = s.source and e.target = s.source + 1)")
def q16_gold_corpus(t: Tables) -> DataFrame:
    want = t.v_edges.select("source", (F.col("source") + 1).alias("target")).distinct()
    return Q.gold_failures(want, t.v_edges, ["source", "target"], "edge")


@query("select 'runs' as metric, count(distinct user_id)::double as value from {events} union all select 'edges', count(*)::double from {v_edges} union all select 'documents', count(*)::double from {documents}")
def q18_report(t: Tables) -> DataFrame:
    n = lambda df, name: df.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(name).alias("metric"), "value")
    return Q.report(n(t.events.select("user_id").distinct(), "runs"), n(t.v_edges, "edges"), n(t.documents, "documents"))


@query("select status as task, count(*) as works, sum(greatest(1, length(text) // 4))::bigint as tokens, count(*) filter (length(text) // 4 > 4000) as oversize from {v_works} where work_id not in (select doc_id from {labels}) group by 1")
def q19_job_plan(t: Tables) -> DataFrame:
    todo = t.v_works.join(t.labels.select(F.col("doc_id").alias("work_id")), "work_id", "left_anti").withColumn("tokens", X.estimate_tokens("text"))
    return todo.groupBy(F.col("status").alias("task")).agg(F.count(F.lit(1)).alias("works"), F.sum("tokens").alias("tokens"), F.count_if(F.col("tokens") > 4000).alias("oversize"))


@query("select w.work_id, coalesce(quality, -1) as quality from (select work_id from {v_works} where status = 'included' order by work_id limit 20) w left join {labels} on doc_id = w.work_id")
def q20_calibration_sample(t: Tables) -> DataFrame:
    first = t.v_works.where("status = 'included'").select("work_id").orderBy("work_id").limit(20)
    return first.join(t.labels.select(F.col("doc_id").alias("work_id"), "quality"), "work_id", "left").select("work_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("""select 'over_merge_rate' as metric, round(count(*) filter (quality = 1 and toxic = 1) / count(*), 6) as value, count(*) filter (quality = 1 and toxic = 1) > 0.15 * count(*) as beyond from {labels} union all select 'under_merge_rate', round(count(*) filter (quality = 0) / count(*), 6), count(*) filter (quality = 0) > 0.25 * count(*) from {labels}""")
def q11_merge_noise(t: Tables) -> DataFrame:
    verdicts = t.labels.select(F.when(F.col("quality") == 0, "under_merge").when(F.col("toxic") == 1, "over_merge").otherwise("correct").alias("verdict"))
    return Q.merge_noise(verdicts)


@query("""with c as (select distinct user_id as answer, event_id % 10 as work_id from {events}) select answer, count(*) as cited, count(*) filter (work_id % 2 <> 0 or work_id = 4) as unfaithful, count(*) filter (work_id % 2 <> 0 or work_id = 4) = 0 as faithful from c group by 1""")
def q10_faithful(t: Tables) -> DataFrame:
    """Answers that cite only what was retrieved and belongs to the project."""
    cited = t.events.select(F.col("user_id").alias("answer"), (F.col("event_id") % 10).alias("work_id")).distinct()
    return Q.faithful(cited, cited.where("work_id % 2 = 0"), cited.where("work_id <> 4").select("work_id").distinct())


@query("""with want as (select distinct l_orderkey, l_partkey from {lineitem}), found as (select distinct l_orderkey, l_partkey from {lineitem} where l_returnflag <> 'A') select round((select count(*) from want join found using (l_orderkey, l_partkey)) / (select count(*) from want), 6) as overlap""")
def q17_bibliography_overlap(t: Tables) -> DataFrame:
    return Q.bibliography_overlap(t.lineitem.where("l_returnflag <> 'A'"), t.lineitem, ["l_orderkey", "l_partkey"])
