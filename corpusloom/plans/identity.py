"""Queries of the E family."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import concepts as C
from corpusloom.operators import identity as I
from corpusloom.operators.joins import matched_works
from corpusloom.operators.rollups import idf_weights
from corpusloom.plans.lineage import stored
from corpusloom.registry import Tables, query

_IDS = "select c_custkey as rec, 'nation:' || c_nationkey as id from {customer} union all select c_custkey, 'seg:' || c_mktsegment || c_custkey % 7 from {customer}"
_KNOWN = "select 'nation:' || s_nationkey as id, min(s_suppkey) as work_id from {supplier} where s_nationkey % 2 = 0 group by 1 union all select 'seg:' || c_mktsegment || (c_custkey % 7), min(c_custkey) + 100000 from {customer} where c_custkey % 7 < 3 group by 1"


def _matches(t: Tables) -> DataFrame:
    ids = F.array(F.concat(F.lit("nation:"), F.col("c_nationkey")), F.concat(F.lit("seg:"), F.col("c_mktsegment"), F.col("c_custkey") % 7))
    known = t.spark.sql(_KNOWN, supplier=t.supplier, customer=t.customer)
    return matched_works(t.customer.withColumn("rec", F.col("c_custkey")), "rec", ids, known)


@query(f"with i as ({_IDS}), k as ({_KNOWN}) select rec, coalesce(string_agg(distinct work_id::varchar, ',' order by work_id::varchar), '') as works from i left join k using (id) group by 1")
def e1_match_works(t: Tables) -> DataFrame:
    return _matches(t).select("rec", F.array_join(F.array_sort(F.transform("works", lambda x: x.cast("string"))), ",").alias("works"))


@query(f"with i as ({_IDS}), k as ({_KNOWN}) select rec, case count(distinct work_id) when 0 then 'create' when 1 then 'merge' else 'duplicate_candidate' end as decision from i left join k using (id) group by 1")
def e2_merge_decision(t: Tables) -> DataFrame:
    return I.decide(_matches(t)).select("rec", "decision")


@query("""select c_custkey as rec, case when c_custkey % 3 = 0 and c_custkey % 2 <> c_nationkey % 2 then 'id_disagreement' when c_custkey % 3 <> 0 and c_custkey % 5 = 0 and c_nationkey % 4 = 1 then 'weak_id_title_conflict' end as veto from {customer}""")
def e3_merge_veto(t: Tables) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    pairs = t.customer.select(
        k.alias("rec"), F.when(k % 3 == 0, k % 2).alias("r_doi"), F.when(k % 3 == 0, n % 2).alias("w_doi"), F.when(k % 5 == 0, F.lit("s")).alias("r_ssrn"), F.when((k % 5 == 0) & (k % 3 != 0), F.lit("s")).alias("w_ssrn"),
        F.lit("t1").alias("r_title_hash"), F.when(n % 4 == 1, "t2").otherwise("t1").alias("w_title_hash"),
    )
    return I.merge_veto(pairs, ["doi"], ["ssrn"]).select("rec", "veto")


@query()
def e4_batch_upsert(t: Tables) -> DataFrame:
    ids = F.array(F.concat(F.lit("seg:"), F.col("c_mktsegment"), F.col("c_custkey") % 7), F.concat(F.lit("own:"), F.col("c_custkey")))
    known = t.customer.where("c_custkey % 7 < 3").groupBy(F.concat(F.lit("seg:"), F.col("c_mktsegment"), F.col("c_custkey") % 7).alias("id")).agg(F.min("c_custkey").alias("work_id"))
    return I.batch_upsert(t.customer.withColumn("rec", F.col("c_custkey")), "rec", ids, known, "c_name")


@query("""with e as (select doc_id as entry_id, case when doc_id % 4 = 0 then doc_id end as doi, case when doc_id % 5 = 0 then doc_id end as arxiv, split_part(text, ' ', 1) as k from {documents}),
ti as (select split_part(text, ' ', 1) as k, count(*) as hits, min(doc_id) as w, bool_or(doc_id % 2 = 0) as has_id, max(doc_id % 4) as shared from {documents} where doc_id % 3 = 0 group by 1)
select entry_id, case when doi is not null and doi % 8 = 0 then doi when (doi is null or doi % 8 <> 0) and (arxiv is not null or (hits = 1 and has_id and shared >= 2)) then w end as work_id,
 case when coalesce(doi % 8 = 0, false) or arxiv is not null then 'resolved' when hits > 1 then 'ambiguous' when hits = 1 and has_id and shared >= 2 then 'resolved' when hits = 1 then 'suspect' else 'unresolved' end as status,
 case when coalesce(doi % 8 = 0, false) or arxiv is not null then 1.0::double when coalesce(hits, 0) = 1 and has_id and shared >= 2 then 0.8::double end as confidence from e left join ti using (k)""")
def e5_resolve_references(t: Tables) -> DataFrame:
    first = F.split_part("text", F.lit(" "), F.lit(1))
    entries = t.documents.select(F.col("doc_id").alias("entry_id"), F.when(F.col("doc_id") % 4 == 0, F.col("doc_id")).alias("doi"), F.when(F.col("doc_id") % 5 == 0, F.col("doc_id")).alias("arxiv"), first.alias("title_key"))
    by_doi = t.documents.where("doc_id % 8 = 0").select(F.col("doc_id").alias("doi"), F.col("doc_id").alias("work_id"))
    by_title = t.documents.where("doc_id % 3 = 0").select(first.alias("title_key"), F.col("doc_id").alias("work_id"), (F.col("doc_id") % 2 == 0).alias("has_id"), (F.col("doc_id") % 4).alias("shared"))
    return I.resolve_references(entries, by_doi, by_title)


_T6 = "select work_id, year, list_distinct(list_filter(string_split(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')) as t from {v_works}"


@query(f"""with w as ({_T6}), p as (select a.work_id as rec, b.work_id as cand, len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) as j from w a join w b on a.work_id % 2 = 0 and b.work_id % 2 = 1 and abs(a.year - b.year) <= 1 and len(a.t) > 0 and len(b.t) > 0),
best as (select rec, cand, j, row_number() over (partition by rec order by j desc, cand) as r from p where j >= 0.65 - 1e-12)
select w.work_id as rec, cand, case when j >= 0.9 then 'resolved' when j is not null then 'review' else 'unresolved' end as outcome from (select work_id from w where work_id % 2 = 0) w left join best on rec = w.work_id and r = 1""")
def e6_corpus_resolution(t: Tables) -> DataFrame:
    w = t.v_works.select("work_id", "year", F.regexp_replace(F.lower("title"), "[^a-z0-9]+", " ").alias("title"))
    best = I.best_title_matches(w.withColumn("asks", F.col("work_id") % 2 == 0), 0.65, "asks")
    got = w.where("work_id % 2 = 0").select(F.col("work_id").alias("rec")).join(best, "rec", "left")
    return got.select("rec", "cand", F.when(F.col("jaccard") >= 0.9, "resolved").when(F.col("jaccard").isNotNull(), "review").otherwise("unresolved").alias("outcome"))


@query("""with p as (select sha1(title) as h, work_id from {v_works} where status = 'metadata_only') select w.work_id as rec, case when count(p.work_id) = 0 then 'unmatched' when count(p.work_id) = 1 then 'matched' else 'ambiguous' end as outcome from {v_works} w left join p on p.h = sha1(w.title) and p.work_id <> w.work_id where w.status = 'included' group by 1""")
def e7_pending_match(t: Tables) -> DataFrame:
    pending = t.v_works.where("status = 'metadata_only'").select(F.sha1("title").alias("h"), F.col("work_id").alias("w"))
    got = t.v_works.where("status = 'included'").select(F.col("work_id").alias("rec"), F.sha1("title").alias("h")).join(pending, "h", "left").groupBy("rec").agg(F.collect_set("w").alias("works"))
    return I.decide(got).select("rec", F.when(F.col("decision") == "create", "unmatched").when(F.col("decision") == "merge", "matched").otherwise("ambiguous").alias("outcome"))


@query("""with m as (select source - source % 3 + 1 as s, target - target % 3 + 1 as d, provenance, run_id from {v_edges}) select distinct s as source, d as target, provenance, run_id from m where s <> d""")
def e8_collapse_works(t: Tables) -> DataFrame:
    merged = t.supplier.select(F.col("s_suppkey").alias("victim"), (F.col("s_suppkey") - F.col("s_suppkey") % 3 + 1).alias("survivor")).union(t.supplier.select((-1 - F.col("s_suppkey")).alias("victim"), F.col("s_suppkey").alias("survivor")))
    return I.collapse_works(t.v_edges.select("source", "target", "provenance", "run_id"), merged, ["source", "target", "provenance", "run_id"])


_LAB = "l as (select distinct p_type, p_name, list_distinct(string_split(p_name, ' ')) as t from {part}), e as (select a.p_type, a.p_name as a, b.p_name as b from l a join l b on a.p_type = b.p_type and len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) >= 0.6)"


@query(f"with recursive {_LAB}, r(p_type, a, b) as (select p_type, a, b from e union select r.p_type, r.a, e.b from r join e on e.p_type = r.p_type and e.a = r.b) select p_type, a as p_name, min(b) as cluster from r group by 1, 2")
def e9_candidate_clusters(t: Tables) -> DataFrame:
    labels = t.part.select("p_type", "p_name").distinct().withColumn("key", F.concat_ws("|", "p_type", "p_name"))
    got = C.candidate_clusters(labels, "key", "p_name", ["p_type"], 0.6)
    part = lambda c, i: F.element_at(F.split(c, r"\|"), i)
    return got.select(part("key", 1).alias("p_type"), part("key", 2).alias("p_name"), part("cluster", 2).alias("cluster"))


_FOLD = """l as (select distinct p_name as lab from {part} union select distinct array_to_string(list_transform(string_split(p_name, ' '), lambda x: x[1]), '') from {part}),
acr as (select a.lab as a, b.lab as b from l a join l b on not contains(a.lab, ' ') and length(a.lab) >= 2 and len(list_distinct(string_split(b.lab, ' '))) >= 2 and a.lab = array_to_string(list_transform(string_split(b.lab, ' '), lambda x: x[1]), '')),
ed as (select least(a, b) as a, greatest(a, b) as b from acr union select 'blue anvil', 'red bolt'), ok as (select * from ed where not (a like 'b%' and b like 'c%')),
e as (select a, b from ok union select b, a from ok union select lab, lab from l)"""


@query(f"with recursive {_FOLD}, r(a, b) as (select a, b from e union select r.a, e.b from r join e on e.a = r.b) select a as lab, min(b) as cluster from r where a in (select lab from l) group by 1")
def e10_fold_groups(t: Tables) -> DataFrame:
    names = t.part.select("p_name").distinct()
    labels = names.union(names.select(X.initials("p_name"))).distinct().select(F.col("p_name").alias("lab"), F.lit(0).alias("g"))
    must = t.spark.createDataFrame([("blue anvil", "red bolt")], "a string, b string")
    pairs = labels.select(F.col("lab").alias("a")).where("a like 'b%'").join(labels.select(F.col("lab").alias("b")).where("b like 'c%'"), F.substring("a", 1, 1) != F.substring("b", 1, 1))
    return C.fold_groups(labels, "lab", "lab", ["g"], must, pairs)


@query("""with l as (select distinct p_name as n, list_distinct(string_split(p_name, ' ')) as t from {part}), p as (select a.n as canonical, b.n as member, a.t as ta, b.t as tb from l a join l b on split_part(a.n, ' ', 1) = split_part(b.n, ' ', 1) and a.n <> b.n)
select canonical, member, case when member like '%gear' then 'not_observed' when list_contains(ta, 'small') <> list_contains(tb, 'small') or list_contains(ta, 'large') <> list_contains(tb, 'large') then 'discriminating_token' when len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))) < 0.6 then 'low_overlap' end as veto from p""")
def e11_fold_veto(t: Tables) -> DataFrame:
    n = t.part.select("p_name").distinct()
    a, b = n.select(F.col("p_name").alias("canonical")), n.select(F.col("p_name").alias("member"))
    p = a.join(b, (F.split_part("canonical", F.lit(" "), F.lit(1)) == F.split_part("member", F.lit(" "), F.lit(1))) & (F.col("canonical") != F.col("member")))
    return p.select("canonical", "member", C.fold_veto(F.col("canonical"), F.col("member"), F.lit(True), ~F.col("member").like("%gear")).alias("veto"))


@query("""with p as (select p_partkey as proposal_id, least(p_type, p_brand) as a, greatest(p_type, p_brand) as b from {part}), f as (select a, b, min(proposal_id) as first from p group by 1, 2)
select proposal_id, a, b, case when a like 'Brand#1%' and b like 'ECONOMY%' then 'cannot' when a like 'Brand#2%' then 'must' when a like 'Brand#3%' then 'folded' when proposal_id <> first then 'duplicate' end as skip from p join f using (a, b)""")
def e12_review_pairs(t: Tables) -> DataFrame:
    p = t.part.select(F.col("p_type").alias("a"), F.col("p_brand").alias("b"), F.col("p_partkey").alias("proposal_id"))
    d = p.select("a", "b").distinct()
    return C.review_pairs(p, d.where("b like 'Brand#2%'"), d.where("b like 'Brand#1%' and a like 'ECONOMY%'"), d.where("b like 'Brand#3%'"))


@query("select p_type as cluster, first(p_name order by (p_partkey % 50 <> 0), (p_brand = 'Brand#1'), length(p_name) desc, p_name) as canonical from {part} group by 1")
def e13_pick_canonical(t: Tables) -> DataFrame:
    m = t.part.select(F.col("p_type").alias("cluster"), "p_name", "p_brand", (F.col("p_partkey") % 50 == 0).alias("user"))
    return C.pick_canonical(m, "cluster", "p_name", "p_brand", "user", ["Brand#1"])


@query("""with k as (select *, trim(regexp_replace(lower(label), '[^a-z0-9 ]+', ' ', 'g')) as k from {v_claim_concepts}) select 'concept::' || k as concept_id, count(distinct label) as aliases, count(distinct claim_id) as claims, count(distinct work_id) as paper_frequency, round(ln((select count(distinct work_id) from k) / count(distinct work_id)), 6) as weight from k group by k""")
def e14_materialise_concepts(t: Tables) -> DataFrame:
    rows = t.v_claim_concepts.withColumn("concept_id", F.concat(F.lit("concept::"), X.merge_key("label")))
    counts = rows.groupBy("concept_id").agg(F.countDistinct("label").alias("aliases"), F.countDistinct("claim_id").alias("claims"))
    return counts.join(idf_weights(rows), "concept_id")


@query("""with e as (select p_type || p_size as k, max(p_name) as canonical, count(*) as members from {part} where p_partkey % 10 <> 0 group by 1), n as (select p_type || p_size as k, max(p_name) as canonical, count(*) as members from {part} where p_partkey % 9 <> 0 group by 1)
select k as cluster, case when e.members is null then 'added' when n.members is null then 'removed' else 'flipped' end as change, case when e.members is not null and n.members is not null then concat_ws(',', case when e.canonical <> n.canonical then 'canonical' end, case when e.members <> n.members then 'members' end) end as fields from e full join n using (k) where e.members is null or n.members is null or e.canonical <> n.canonical or e.members <> n.members""")
def e15_diff_builds(t: Tables) -> DataFrame:
    build = lambda cut: t.part.where(cut).groupBy(F.concat("p_type", "p_size").alias("cluster")).agg(F.max("p_name").alias("canonical"), F.count(F.lit(1)).alias("members"))
    return C.diff_builds(build("p_partkey % 10 <> 0"), build("p_partkey % 9 <> 0"), "cluster", ["canonical", "members"])


@query("""with v as (select least(p_type, p_brand) as a, greatest(p_type, p_brand) as b, case p_partkey % 3 when 0 then 'accept' when 1 then 'reject' else 'undo' end as action, row_number() over (partition by p_type, p_brand order by p_partkey desc) as r from {part}), l as (select a, b, action from v where r = 1)
select case action when 'accept' then 'must' else 'cannot' end as kind, a, b from l where action <> 'undo' union all select 'must', 'x', 'y'""")
def e16_apply_verdicts(t: Tables) -> DataFrame:
    v = t.part.select(F.col("p_type").alias("a"), F.col("p_brand").alias("b"), F.element_at(F.array(F.lit("accept"), F.lit("reject"), F.lit("undo")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("action"), F.col("p_partkey").alias("at"))
    old = v.select(F.lit("cannot").alias("kind"), "a", "b").distinct().union(t.spark.createDataFrame([("must", "y", "x")], "kind string, a string, b string"))
    return C.apply_verdicts(old, v)


@query("select event_id as item_id, event_type || ' of ' || coalesce(c_name, 'unknown work') as label from {events} left join {customer} on c_custkey = user_id * 20 where event_type <> 'view'")
def e17_review_rows(t: Tables) -> DataFrame:
    names = t.customer.select(F.col("c_custkey").alias("k"), "c_name")
    rows = t.events.where("event_type <> 'view'").withColumn("k", F.col("user_id") * 20).join(names, "k", "left")
    return rows.select(F.col("event_id").alias("item_id"), F.format_string("%s of %s", F.col("event_type"), F.coalesce("c_name", F.lit("unknown work"))).alias("label"))


@query(f"""with {_LAB.replace(">= 0.6", ">= 0.3")}, p as (select a || '~' || b as proposal_id, a, b from (select p_type || '|' || a as a, p_type || '|' || b as b from e where a < b) x)
select proposal_id, a, b, case when a like '%|blue%' then 'cannot' when a like '%|red%' then 'must' when b like '%gear' then 'folded' end as skip from p""")
def x1_proposals(t: Tables) -> DataFrame:
    """A table of proposals in place of a proposer, with the reasons not to review some; nobody's proposals add nothing."""
    labels = t.part.select("p_type", "p_name").distinct().withColumn("key", F.concat_ws("|", "p_type", "p_name"))
    proposals = stored(C.similar_proposals(labels, "key", "p_name", ["p_type"], 0.3).unionByName(C.no_proposals(t.spark)), "proposals")
    return C.review_pairs(proposals, proposals.where("a like '%|red%'"), proposals.where("a like '%|blue%'"), proposals.where("b like '%gear'"))


_PROVIDED = "select p_partkey as record, case p_partkey % 3 when 0 then 'https://doi.org/10.1000/P' || (p_partkey - p_partkey % 6) when 1 then ' ' end as doi, case p_partkey % 4 when 0 then 'https://openalex.org/w' || p_partkey end as openalex_id, case p_partkey % 8 when 1 then 's' || p_partkey end as s2_id, case p_partkey % 8 when 1 then 'other' when 2 then 't' || p_partkey end as s2, p_name || ' ' || p_brand || case when p_partkey % 2 = 0 then ' ' || p_partkey else '' end as title from {part}"
_CITED = "select o_orderkey as entry_id, case o_orderkey % 4 when 0 then 'doi:10.1000/p' || p_partkey end as doi, case o_orderkey % 10 when 1 then 'arXiv:2101.' || (10000 + p_partkey) || 'v2' end as arxiv, upper(p_name) || ', ' || p_brand || case when p_partkey % 2 = 0 then ' (' || p_partkey || ')' else '' end as title from {orders} join {part} on p_partkey = o_custkey"


@query(f"""with r as ({_PROVIDED}), c as ({_CITED}), n as (select record, case when doi like 'https%' then lower(substr(doi, 17)) end as doi, doi like 'https%' or openalex_id is not null or s2_id is not null or s2 is not null as has_id, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) as k, len(list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z]+'), lambda x: length(x) > 1))) as shared from r),
d as (select doi, min(record) as w from n where doi is not null group by 1), ti as (select k, count(*) as hits, min(record) as w, bool_or(coalesce(has_id, false)) as has_id, max(shared) as shared from n group by 1),
e as (select entry_id, substr(doi, 5) as doi, arxiv, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) as k from c),
s as (select entry_id, d.w as dw, ti.w as tw, case when d.w is not null or arxiv is not null then 'resolved' when hits > 1 then 'ambiguous' when hits = 1 and has_id and shared >= 2 then 'resolved' when hits = 1 then 'suspect' else 'unresolved' end as status, d.w is not null or arxiv is not null as sure from e left join d on d.doi = e.doi left join ti using (k))
select entry_id, coalesce(dw, case when status = 'resolved' then tw end) as work_id, status, case when sure then 1.0::double when status = 'resolved' then 0.8::double end as confidence from s""")
def x2_provider_records(t: Tables) -> DataFrame:
    """References resolved against a table of provider records, whose ids have several names and shapes."""
    records = t.spark.sql(_PROVIDED, part=t.part)
    return I.resolve_by_records(t.spark.sql(_CITED, orders=t.orders, part=t.part), I.provider_identities(records, "record"), "record")
