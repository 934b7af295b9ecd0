"""Queries of the J family."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import joins as J
from corpusloom.operators.rollups import authoritative_edges
from corpusloom.operators.rows import latest
from corpusloom.registry import Tables, query


def _chain(t: Tables, bare: bool) -> DataFrame:
    concepts = t.part.select(F.col("p_partkey").alias("concept_id"), "p_type")
    links = t.lineitem.select(F.col("l_partkey").alias("concept_id"), F.col("l_orderkey").alias("claim_id"), F.col("l_suppkey").alias("span_id"), "l_quantity")
    claims = t.orders.select(F.col("o_orderkey").alias("claim_id"), "o_orderpriority")
    spans = t.supplier.where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("span_id"), F.col("s_name").alias("quote"))
    got = J.provenance_chain(concepts, links, claims, spans, bare)
    return got.groupBy("p_type", "o_orderpriority", "quote").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity").cast("double"), 4).alias("q"))


_CHAIN = """select p_type, o_orderpriority, s_name as quote, count(*) as n, round(sum(l_quantity)::double, 4) as q from {part} join {lineitem} on l_partkey = p_partkey join {orders} on o_orderkey = l_orderkey
 @ join (select * from {supplier} where s_suppkey % 3 <> 0) s on s_suppkey = l_suppkey group by 1, 2, 3"""


@query(_CHAIN.replace("@", ""))
def j1_provenance_chain(t: Tables) -> DataFrame:
    return _chain(t, False)


@query(_CHAIN.replace("@", "left"))
def j2_provenance_chain_left(t: Tables) -> DataFrame:
    return _chain(t, True)


@query("select work_id, year, status, coalesce(quality, -1) as quality, coalesce(toxic, 0) as toxic from {v_works} left join {labels} on doc_id = work_id")
def j3_left_with_defaults(t: Tables) -> DataFrame:
    got = J.with_defaults(t.v_works, t.labels.select(F.col("doc_id").alias("work_id"), "quality", "toxic"), "work_id", {"quality": -1, "toxic": 0})
    return got.select("work_id", "year", "status", "quality", "toxic")


@query("""with cur as (select note_id from (select *, row_number() over (partition by work_id, schema_id order by created_at desc, note_id desc) as r from {v_notes}) x where r = 1)
select l_orderkey as note_id, count(*) as claims from {lineitem} where l_orderkey in (select note_id from cur) group by 1""")
def j4_current_claims(t: Tables) -> DataFrame:
    current = latest(t.v_notes, ["work_id", "schema_id"], "created_at", "note_id")
    claims = t.lineitem.select(F.col("l_orderkey").alias("note_id"))
    return claims.join(current.select("note_id"), "note_id", "left_semi").groupBy("note_id").agg(F.count(F.lit(1)).alias("claims"))


@query("select work_id, length(text) as size from {v_works} where length(text) > 5000 and work_id not in (select doc_id from {labels})")
def j5_oversize_without_note(t: Tables) -> DataFrame:
    return t.v_works.where("length(text) > 5000").join(t.labels.select(F.col("doc_id").alias("work_id")), "work_id", "left_anti").select("work_id", F.length("text").cast("long").alias("size"))


@query("select claim_id, span_id from (select claim_id, span_id, row_number() over (partition by claim_id order by rank, span_id) as r from {v_claim_concepts}) x where r = 1")
def j6_best_span(t: Tables) -> DataFrame:
    return J.best_span(t.v_claim_concepts)


@query("select work_id, exists (select 1 from {labels} l where l.doc_id = work_id and l.toxic = 1) as flagged from {v_works}")
def j7_exists_flag(t: Tables) -> DataFrame:
    return J.exists_flag(t.v_works, t.labels.where("toxic = 1").select(F.col("doc_id").alias("work_id")), "work_id", "flagged").select("work_id", "flagged")


@query("""with tok as (select distinct substr(lower(p_name), 3, 4) as token from {part} where p_partkey % 7 = 0 union select distinct substr(lower(p_name), 1, 2) from {part})
select p_partkey, token from {part} join tok on contains(lower(p_name), token)""")
def j8_token_containment(t: Tables) -> DataFrame:
    tokens = t.part.where("p_partkey % 7 = 0").select(F.substring(F.lower("p_name"), 3, 4).alias("token")).union(t.part.select(F.substring(F.lower("p_name"), 1, 2))).distinct()
    return J.containing(t.part.select("p_partkey", "p_name"), "p_partkey", "p_name", tokens, "token").select("p_partkey", "token")


@query("""with lines as (select conv_id, turn, sum(length(text) + 2) over (partition by conv_id order by turn) as e, length(text) + 2 as n from {conversations}),
sec as (select conv_id, turn, e - n as s, e, turn % 3 as level from lines), p as (select conv_id, 10 * i as offset from (select distinct conv_id from {conversations}) c, range(0, 30) r(i))
select conv_id, "offset", turn as section_id from (select p.conv_id, p."offset", s.turn, row_number() over (partition by p.conv_id, p."offset" order by s.level desc, s.turn desc) as r from p left join sec s on s.conv_id = p.conv_id and p."offset" >= s.s and p."offset" < s.e) x where r = 1""")
def j9_section_at_offset(t: Tables) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy("conv_id").orderBy("turn")
    sections = t.conversations.select("conv_id", F.col("turn").alias("section_id"), F.col("turn").alias("ordinal"), (F.col("turn") % 3).alias("level"), F.sum(F.length("text") + 2).over(w).alias("end_char"), (F.length("text") + 2).alias("n"))
    sections = sections.withColumn("start_char", F.col("end_char") - F.col("n"))
    points = t.conversations.select("conv_id").distinct().select("conv_id", F.explode(F.sequence(F.lit(0), F.lit(290), F.lit(10))).alias("offset")).withColumn("offset", F.col("offset").cast("long"))
    return J.section_at(points, sections, "conv_id")


@query("""select e.event_id, (select max(s.event_id) from {events} s where s.user_id = e.user_id and s.event_type = 'purchase' and s.ts <= e.ts and s.ts = (select max(s2.ts) from {events} s2 where s2.user_id = e.user_id and s2.event_type = 'purchase' and s2.ts <= e.ts)) as last_step from {events} e where e.event_type = 'view'""")
def j10_as_of(t: Tables) -> DataFrame:
    steps = t.events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("last_step"))
    points = t.events.where("event_type = 'view'").select("user_id", "ts", "event_id")
    got = J.as_of(points.select("user_id", "ts").distinct(), steps, ["user_id"], "ts", "last_step")
    return points.join(got, ["user_id", "ts"]).select("event_id", "last_step")


_IDS = """select c_custkey as rec, 'phone:' || c_phone as id, 0 as p from {customer} where c_custkey % 2 = 0 union all select c_custkey, 'nation:' || c_nationkey, 1 from {customer} union all select c_custkey, 'seg:' || c_mktsegment, 2 from {customer}"""
_KNOWN = """select 'nation:' || s_nationkey as id, min(s_suppkey) as work_id from {supplier} group by 1 union all select 'seg:BUILDING', 0"""


@query(f"""with i as ({_IDS}), k as ({_KNOWN}) select rec, work_id::bigint as work_id from (select rec, work_id, row_number() over (partition by rec order by p, work_id) as r from i join k using (id)) x where r = 1""".replace("c_phone", "c_mktsegment || c_custkey"))
def j11_resolve_by_ids(t: Tables) -> DataFrame:
    customers = t.customer.withColumn("rec", F.col("c_custkey"))
    ids = F.array(
        F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("phone:"), F.col("c_mktsegment"), F.col("c_custkey"))), F.concat(F.lit("nation:"), F.col("c_nationkey")), F.concat(F.lit("seg:"), F.col("c_mktsegment"))
    )
    known = t.supplier.groupBy(F.concat(F.lit("nation:"), F.col("s_nationkey")).alias("id")).agg(F.min("s_suppkey").cast("long").alias("work_id"))
    known = known.union(t.spark.createDataFrame([("seg:BUILDING", 0)], "id string, work_id long"))
    return J.resolve_by_ids(customers, "rec", ids, known)


@query("""with r as (select distinct l_orderkey as source, l_partkey as ref from {lineitem}), k as (select p_partkey from {part} where p_partkey % 5 <> 0)
select source, ref as target, true as resolved from r where ref in (select * from k) union all select distinct null, ref, false from r where ref not in (select * from k)""")
def j12_reference_projection(t: Tables) -> DataFrame:
    refs = t.lineitem.select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target")).distinct()
    known = t.part.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("target"))
    hit = refs.join(known, "target", "left_semi").select("source", "target", F.lit(True).alias("resolved"))
    miss = refs.join(known, "target", "left_anti").select("target").distinct().select(F.lit(None).cast(hit.schema["source"].dataType).alias("source"), "target", F.lit(False).alias("resolved"))
    return hit.union(miss)


@query("""with e as (select 'Work' as ty, source as id from {v_edges} union select 'Work', target from {v_edges} union select 'Concept', l_partkey from {lineitem} where l_partkey % 10 = 0 union select 'Claim', o_orderkey + 1 from {orders} where o_orderkey % 50 = 0)
select ty as node_type, id as node_id from e where not ((ty = 'Work' and id in (select s_suppkey from {supplier} where s_suppkey % 4 <> 0)) or (ty = 'Concept' and id in (select p_partkey from {part} where p_partkey % 20 <> 0)) or (ty = 'Claim' and id in (select o_orderkey from {orders})))""")
def j13_endpoint_check(t: Tables) -> DataFrame:
    node = lambda df, kind, c: df.select(F.lit(kind).alias("node_type"), F.expr(c).cast("long").alias("node_id"))
    ends = node(t.v_edges, "Work", "source").union(node(t.v_edges, "Work", "target")).union(node(t.lineitem.where("l_partkey % 10 = 0"), "Concept", "l_partkey")).union(node(t.orders.where("o_orderkey % 50 = 0"), "Claim", "o_orderkey + 1")).distinct()
    homes = node(t.supplier.where("s_suppkey % 4 <> 0"), "Work", "s_suppkey").union(node(t.part.where("p_partkey % 20 <> 0"), "Concept", "p_partkey")).union(node(t.orders, "Claim", "o_orderkey"))
    return ends.join(homes, ["node_type", "node_id"], "left_anti")


_TOK = "list_distinct(list_filter(string_split(p_name, ' '), lambda x: x <> ''))"


@query(f"""with l as (select distinct p_type, p_name, {_TOK} as t from {{part}}) select a.p_type, a.p_name as a, b.p_name as b, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) as jaccard
from l a join l b on a.p_type = b.p_type and a.p_name < b.p_name where len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) >= 1.0 / 3 - 1e-12""")
def j14_similar_labels(t: Tables) -> DataFrame:
    labels = t.part.select("p_type", "p_name").distinct()
    got = J.similar_labels(labels.withColumn("key", F.concat_ws("|", "p_type", "p_name")), "key", "p_name", ["p_type"], 1 / 3)
    cut = lambda c: F.element_at(F.split(c, r"\|"), 2)
    return got.select(F.element_at(F.split("a", r"\|"), 1).alias("p_type"), cut("a").alias("a"), cut("b").alias("b"), F.round("jaccard", 6).alias("jaccard"))


@query("""with l as (select distinct p_name as lab from {part} union select distinct array_to_string(list_transform(string_split(p_name, ' '), lambda x: x[1]), '') from {part}), t as (select lab, string_split(lab, ' ') as t from l)
select a.lab as a, b.lab as b from t a join t b on len(a.t) = 1 and length(a.lab) >= 2 and len(list_distinct(b.t)) >= 2 and a.lab = array_to_string(list_transform(b.t, lambda x: x[1]), '')""")
def j15_acronyms(t: Tables) -> DataFrame:
    names = t.part.select("p_name").distinct()
    short = names.select(F.array_join(F.transform(F.split("p_name", " "), lambda x: F.substring(x, 1, 1)), "").alias("p_name"))
    labels = names.union(short).distinct().select(F.col("p_name").alias("key"), "p_name", F.lit(0).alias("g"))
    return J.acronyms(labels, "key", "p_name", ["g"]).select("a", "b")


_W16 = "select work_id, year, list_distinct(list_filter(string_split(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')) as t from {v_works} where work_id < 300"


@query(f"""with w as ({_W16}) select a.work_id as a, b.work_id as b, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) as jaccard from w a join w b on a.work_id < b.work_id
where abs(a.year - b.year) <= 1 and len(a.t) > 0 and len(b.t) > 0 and len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) >= 0.5 - 1e-12""".replace("where work_id < 300", ""))
def j16_title_match(t: Tables) -> DataFrame:
    from corpusloom.operators.identity import title_matches

    w = t.v_works.select("work_id", "year", F.regexp_replace(F.lower("title"), "[^a-z0-9]+", " ").alias("title"))
    return title_matches(w, 0.5).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query("select a.concept_id as a, b.concept_id as b, count(*) as n from (select distinct work_id, concept_id from {v_claim_concepts}) a join (select distinct work_id, concept_id from {v_claim_concepts}) b on a.work_id = b.work_id and a.concept_id < b.concept_id group by 1, 2")
def j17_pairs_in_group(t: Tables) -> DataFrame:
    one = t.v_claim_concepts.select("work_id", "concept_id").distinct()
    a, b = one.alias("a"), one.alias("b")
    return a.join(b, (F.col("a.work_id") == F.col("b.work_id")) & (F.col("a.concept_id") < F.col("b.concept_id"))).groupBy(F.col("a.concept_id").alias("a"), F.col("b.concept_id").alias("b")).agg(F.count(F.lit(1)).alias("n"))


@query("""select doc_id, sha256(text) as h, exists (select 1 from {documents} o where o.doc_id % 2 = 0 and o.source = d.source and o.text = d.text) as proven from {documents} d where doc_id % 2 = 1""")
def j18_lineage_proof(t: Tables) -> DataFrame:
    runs = t.documents.where("doc_id % 2 = 0").select("source", F.sha2("text", 256).alias("h")).distinct().withColumn("p", F.lit(True))
    asked = t.documents.where("doc_id % 2 = 1").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    return asked.join(runs, ["source", "h"], "left").select("doc_id", "h", F.coalesce("p", F.lit(False)).alias("proven"))


@query("""with f as (select sha256(text) as h, min(doc_id) as source_file_id from {documents} group by 1) select w.work_id, f.source_file_id, case when l.doc_id is not null then f.h end as markdown_hash from {v_works} w join f on f.h = sha256(w.text) left join (select distinct doc_id from {labels}) l on l.doc_id = w.work_id""")
def j19_work_source_text(t: Tables) -> DataFrame:
    files = t.documents.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("source_file_id"))
    has = t.labels.select(F.col("doc_id").alias("work_id"), F.lit(True).alias("has")).distinct()
    return t.v_works.withColumn("h", F.sha2("text", 256)).join(files, "h").join(has, "work_id", "left").select("work_id", "source_file_id", F.when(F.col("has"), F.col("h")).alias("markdown_hash"))


@query("""select 'work-work' as kind, cast(source as varchar) as a, cast(target as varchar) as b, count(*) as n from {v_edges} group by 1, 2, 3
union all select 'concept-work', concept_id, cast(work_id as varchar), count(distinct claim_id) from {v_claim_concepts} group by 1, 2, 3""")
def j20_edge_evidence(t: Tables) -> DataFrame:
    works = t.v_edges.groupBy(F.col("source").cast("string").alias("a"), F.col("target").cast("string").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    concepts = t.v_claim_concepts.groupBy(F.col("concept_id").alias("a"), F.col("work_id").cast("string").alias("b")).agg(F.countDistinct("claim_id").alias("n"))
    return works.select(F.lit("work-work").alias("kind"), "a", "b", "n").unionByName(concepts.select(F.lit("concept-work").alias("kind"), "a", "b", "n"))


@query("select work_id, access_class, length(text) > 0 as has_text, exists (select 1 from {v_gold} g where g.doc_id = work_id) as has_source from {v_works}")
def j21_document_links(t: Tables) -> DataFrame:
    got = J.exists_flag(t.v_works, t.v_gold.select(F.col("doc_id").alias("work_id")), "work_id", "has_source")
    return got.select("work_id", "access_class", (F.length("text") > 0).alias("has_text"), "has_source")


@query("""with a as (select source, target, run_id, provenance, confidence from (select *, row_number() over (partition by source, target, run_id order by case provenance when 'manual_override' then 3 when 'parsed_bibliography' then 2 else 1 end desc, confidence desc) as r from {v_edges}) x where r = 1)
select a.source, a.target, a.run_id, a.provenance, s.s_name as source_title, d.s_name as target_title from a join {supplier} s on s.s_suppkey = a.source join {supplier} d on d.s_suppkey = a.target""")
def j22_citation_matrix(t: Tables) -> DataFrame:
    names = t.supplier
    e = authoritative_edges(t.v_edges)
    e = e.join(names.select(F.col("s_suppkey").alias("source"), F.col("s_name").alias("source_title")), "source")
    return e.join(names.select(F.col("s_suppkey").alias("target"), F.col("s_name").alias("target_title")), "target").select("source", "target", "run_id", "provenance", "source_title", "target_title")
