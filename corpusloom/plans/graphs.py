"""Queries of the G family."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import graph as G
from corpusloom.operators.rollups import authoritative_edges, cocitation
from corpusloom.plans.lineage import stored
from corpusloom.registry import Tables, query

_PR = "case provenance when 'manual_override' then 3 when 'parsed_bibliography' then 2 else 1 end"
_AUTH = f"auth as (select source, target, run_id, provenance, confidence from (select *, row_number() over (partition by source, target, run_id order by {_PR} desc, confidence desc) as r from {{v_edges}}) x where r = 1)"
_PAIRS = "pr as (select distinct least(source, target) as a, greatest(source, target) as b from {v_edges} where source <> target), nb as (select a as x, b as y from pr union all select b, a from pr)"


def _nodes(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").alias("node"))


def _labels(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").alias("node"), (F.col("s_nationkey") % 4).cast("long").alias("community"))


@query(f"with {_AUTH} select source, target, provenance, confidence from auth where run_id = 1995 and source % 3 <> 0 and target % 3 <> 0")
def g1_closed_world(t: Tables) -> DataFrame:
    e = authoritative_edges(t.v_edges.where("run_id = 1995"))
    return G.induced(e, _nodes(t).where("node % 3 <> 0")).select("source", "target", "provenance", "confidence")


@query("""select 'cites' as family, cast(source as varchar) as source, cast(target as varchar) as target, provenance as trust from {v_edges} where source in (select s_suppkey from {supplier}) union select 'discusses', cast(work_id as varchar), concept_id, epistemic_type from {v_claim_concepts} where concept_id not like '%gear'""")
def g2_full_graph(t: Tables) -> DataFrame:
    text = lambda c: F.col(c).cast("string").alias(c)
    cites = t.v_edges.join(_nodes(t).withColumnRenamed("node", "source"), "source", "left_semi").select(F.lit("cites").alias("family"), text("source"), text("target"), F.col("provenance").alias("trust"))
    about = t.v_claim_concepts.where("concept_id not like '%gear'").select(F.lit("discusses").alias("family"), F.col("work_id").cast("string").alias("source"), F.col("concept_id").alias("target"), F.col("epistemic_type").alias("trust"))
    return cites.union(about).distinct()


@query("""with recursive e as (select distinct source as a, target as b from {v_part_edges} union select target, source from {v_part_edges}),
r(node, component) using key (node) as (select distinct a, a from e union select e.a, min(r.component) from r join e on e.b = r.node join recurring.r as c on c.node = e.a where r.component < c.component group by e.a)
select node, component from r""")
def g3_components(t: Tables) -> DataFrame:
    return G.connected_components(t.v_part_edges)


@query(f"with {_PAIRS} select s_suppkey as node, count(y) as degree, round(count(y) / ((select count(*) from {{supplier}}) - 1), 6) as centrality from {{supplier}} left join nb on x = s_suppkey group by 1")
def g4_degree(t: Tables) -> DataFrame:
    return G.degree_centrality(t.v_edges, _nodes(t)).select("node", "degree", F.round("centrality", 6).alias("centrality"))


@query()
def g5_betweenness(t: Tables) -> DataFrame:
    """Exact, from all sources."""
    return G.betweenness(t.v_edges, _nodes(t)).select("node", F.round("betweenness", 6).alias("betweenness"))


@query("""with g0 as (select s_suppkey as node from {supplier} where s_suppkey <= 3), v1 as (select target as node, count(distinct source) as votes from {v_edges} where source in (select * from g0) and target not in (select * from g0) group by 1),
f1 as (select node from v1 order by votes desc, node limit 4), v2 as (select target as node, count(distinct source) as votes from {v_edges} where source in (select * from f1) and target not in (select * from g0) and target not in (select node from v1) group by 1), f2 as (select node from v2 order by votes desc, node limit 4)
select node, 0 as generation, 0 as votes, true as expanded from g0 union all select node, 1, votes, node in (select node from f1) from v1 union all select node, 2, votes, node in (select node from f2) from v2""")
def g6_walk(t: Tables) -> DataFrame:
    return G.walk(t.v_edges, _nodes(t).where("node <= 3"), 2, 4)


@query(f"""with {_PAIRS}, d0 as (select distinct x as node from nb where x in (5, 50)), d1 as (select distinct y as node from nb where x in (select node from d0) and y not in (select node from d0)),
d2 as (select distinct y as node from nb where x in (select node from d1) and y not in (select node from d0) and y not in (select node from d1)) select node, 0 as distance from d0 union all select node, 1 from d1 union all select node, 2 from d2""")
def g7_neighborhood(t: Tables) -> DataFrame:
    return G.neighborhood(t.v_edges, _nodes(t).where("node in (5, 50)"), 2)


@query("select distinct 'cites' as side, target as work_id from {v_edges} where source = 7 union all select distinct 'cited_by', source from {v_edges} where target = 7")
def g8_cites(t: Tables) -> DataFrame:
    out = t.v_edges.where("source = 7").select(F.lit("cites").alias("side"), F.col("target").alias("work_id"))
    return out.union(t.v_edges.where("target = 7").select(F.lit("cited_by").alias("side"), F.col("source").alias("work_id"))).distinct()


@query()
def g9_communities(t: Tables) -> DataFrame:
    return G.communities(t.v_edges, _nodes(t))


@query(f"""with {_PAIRS}, lab as (select s_suppkey as node, s_nationkey % 4 as c from {{supplier}}), m as (select count(*) as m from pr),
l as (select la.c, count(*) as l from pr join lab la on la.node = a join lab lb on lb.node = b where la.c = lb.c group by 1), d as (select lab.c, count(*) as d from nb join lab on lab.node = x group by 1)
select round(sum(coalesce(l, 0) / m - (d / (2.0 * m)) ** 2), 6)::double as modularity from d left join l using (c), m""")
def g10_modularity(t: Tables) -> DataFrame:
    return G.modularity(t.v_edges, _labels(t)).select(F.round("modularity", 6).alias("modularity"))


@query(f"with {_PAIRS}, lab as (select s_suppkey as node, s_nationkey % 4 as c from {{supplier}}) select a, b from pr join lab la on la.node = a join lab lb on lb.node = b where la.c <> lb.c and (a % 2 = 0 or b % 2 = 0)")
def g11_bridges(t: Tables) -> DataFrame:
    scores = _nodes(t).withColumn("betweenness", F.when(F.col("node") % 2 == 0, 1.0).otherwise(0.0))
    return G.bridges(t.v_edges, _labels(t), scores)


@query(f"with {_PAIRS}, lab as (select s_suppkey as node, s_nationkey % 4 as c from {{supplier}}) select a, b, la.c <> lb.c as is_bridge, a % 5 = 0 as stored from pr join lab la on la.node = a join lab lb on lb.node = b where (la.c <> lb.c) <> (a % 5 = 0)")
def g12_bridge_recheck(t: Tables) -> DataFrame:
    stored = G.undirected(t.v_edges).withColumn("stored", F.col("a") % 5 == 0)
    real = G.bridges(t.v_edges, _labels(t)).withColumn("r", F.lit(True))
    return stored.join(real, ["a", "b"], "left").select("a", "b", F.coalesce("r", F.lit(False)).alias("is_bridge"), "stored").where("is_bridge <> stored")


@query()
def g13_god_nodes(t: Tables) -> DataFrame:
    pairs = stored(G.undirected(t.v_edges), "pairs")
    return G.god_nodes(G.degrees_of_pairs(pairs, _nodes(t)), G.betweenness_of_pairs(pairs, _nodes(t))).select("node", F.round("score", 6).alias("score"))


@query(f"with {_PAIRS}, lab as (select s_suppkey as node, s_nationkey % 4 as c from {{supplier}}), br as (select distinct x as node from nb join lab la on la.node = x join lab lb on lb.node = y where la.c <> lb.c) select s_suppkey as node, case when s_suppkey % 10 <> 0 then s_nationkey % 4 end as community, s_suppkey in (select node from br) as is_bridge from {{supplier}}")
def g14_annotate(t: Tables) -> DataFrame:
    ends = G.bridges(t.v_edges, _labels(t))
    ends = ends.select(F.col("a").alias("node")).union(ends.select(F.col("b").alias("node"))).distinct().withColumn("is_bridge", F.lit(True))
    got = _labels(t).join(ends, "node", "left")
    return got.select("node", F.when(F.col("node") % 10 != 0, F.col("community")).alias("community"), F.coalesce("is_bridge", F.lit(False)).alias("is_bridge"))


@query(f"with {_PAIRS}, lab as (select s_suppkey as node, s_nationkey % 4 as c from {{supplier}}) select c as community, count(*) as nodes, sum((select count(*) from nb where x = node))::bigint as links from lab group by 1")
def g15_summary(t: Tables) -> DataFrame:
    d = G.degree_centrality(t.v_edges, _nodes(t))
    return _labels(t).join(d, "node").groupBy("community").agg(F.count(F.lit(1)).alias("nodes"), F.sum("degree").alias("links"))


@query("""select work_id, case when status = 'excluded' then false when status = 'metadata_only' then true else not exists (select 1 from {v_gold} g where g.doc_id = work_id) end as unread from {v_works}""")
def g16_unread(t: Tables) -> DataFrame:
    spans = t.v_gold.groupBy(F.col("doc_id").alias("work_id")).agg(F.count(F.lit(1)).alias("n"))
    got = t.v_works.join(spans, "work_id", "left")
    return got.select("work_id", F.when(F.col("status") == "excluded", False).when(F.col("status") == "metadata_only", True).otherwise(F.coalesce("n", F.lit(0)) == 0).alias("unread"))


@query("select target, count(distinct source) as citers from {v_edges} where target not in (select l_suppkey from {lineitem} where l_orderkey % 500 = 0) group by 1")
def g17_gaps(t: Tables) -> DataFrame:
    have = t.lineitem.where("l_orderkey % 500 = 0").select(F.col("l_suppkey").alias("target"))
    return cocitation(t.v_edges).join(have, "target", "left_anti")


@query(f"""with {_PAIRS}, d as (select x as node, count(*) as n from nb group by 1) select a, b, case when a % 2 = 0 and b % 2 = 0 then 'work-work' when a % 2 = 1 and b % 2 = 1 then 'concept-concept' else 'work-concept' end as kind, round(case when a % 2 = 0 and b % 2 = 0 then 1.0 / least(da.n, db.n) else 0.03 end, 6)::double as strength from pr join d da on da.node = a join d db on db.node = b""")
def g18_link_classes(t: Tables) -> DataFrame:
    pairs = G.undirected(t.v_edges)
    deg = G.both_ways(pairs).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    got = pairs.join(deg.select(F.col("x").alias("a"), F.col("n").alias("na")), "a").join(deg.select(F.col("x").alias("b"), F.col("n").alias("nb")), "b")
    works = (F.col("a") % 2 == 0).cast("int") + (F.col("b") % 2 == 0).cast("int")
    kind = F.when(works == 2, "work-work").when(works == 0, "concept-concept").otherwise("work-concept")
    return got.select("a", "b", kind.alias("kind"), F.round(F.when(works == 2, 1.0 / F.least("na", "nb")).otherwise(0.03), 6).alias("strength"))


@query("""with p as (select distinct p_type as source, p_brand as target, p_size % 3 as run from {part}) select source, target, run, case when source < 'M' and target <> 'Brand#5' then 'open_access' else 'licensed_future' end as access_class from p where target <> 'Brand#1'""")
def g19_proposal_edges(t: Tables) -> DataFrame:
    p = t.part.select(F.col("p_type").alias("source"), F.col("p_brand").alias("target"), (F.col("p_size") % 3).alias("run"))
    homes = t.part.where("p_brand <> 'Brand#1'").select(F.col("p_brand").alias("target")).distinct()
    access = F.when((F.col("source") < "M") & (F.col("target") != "Brand#5"), "open_access").otherwise("licensed_future")
    return p.join(homes, "target", "left_semi").dropDuplicates(["source", "target", "run"]).select("source", "target", "run", access.alias("access_class"))


@query(f"with {_PAIRS}, s as (select s_suppkey as node from {{supplier}} where s_acctbal >= 0) select a as source, b as target, a % 6 = 0 or b % 6 = 0 as recommended from pr where a in (select node from s) and b in (select node from s)")
def g20_trace_subgraph(t: Tables) -> DataFrame:
    """The graph of the works of a trace (suppliers with no debt)."""
    e = G.undirected(G.induced(t.v_edges, t.supplier.where("s_acctbal >= 0").select(F.col("s_suppkey").alias("node"))))
    return e.select(F.col("a").alias("source"), F.col("b").alias("target"), ((F.col("a") % 6 == 0) | (F.col("b") % 6 == 0)).alias("recommended"))
