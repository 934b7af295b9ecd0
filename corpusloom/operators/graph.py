"""Citation and concept graphs: views, walks, centrality, communities, bridges, export gates."""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.access import shareable
from corpusloom.operators.components import connected_components
from corpusloom.operators.kept import remove
from corpusloom.operators.paths import component_shares
from corpusloom.plans.lineage import cut, shared_dir, stored
from corpusloom.plans.ranks import numbered

__all__ = ["connected_components"]


def induced(edges: DataFrame, nodes: DataFrame, key: str = "node") -> DataFrame:
    """Edges whose both ends are among the nodes."""
    s, d = nodes.select(F.col(key).alias("source")), nodes.select(F.col(key).alias("target"))
    return edges.join(s, "source", "left_semi").join(d, "target", "left_semi")


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct unordered pairs (a < b), no self-loops."""
    return edges.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).union(pairs.select(F.col("b").alias("x"), F.col("a").alias("y")))


def degree_centrality(edges: DataFrame, nodes: DataFrame, key: str = "node") -> DataFrame:
    """Neighbours of each node over n - 1; 1 for a lone node's graph stays 0 neighbours."""
    return degrees_of_pairs(undirected(edges), nodes, key)


def degrees_of_pairs(pairs: DataFrame, nodes: DataFrame, key: str = "node") -> DataFrame:
    """``degree_centrality`` of ``undirected`` edges."""
    deg = both_ways(pairs).groupBy(F.col("x").alias(key)).agg(F.count(F.lit(1)).alias("degree"))
    n = nodes.select(key).distinct().agg(F.count(F.lit(1)).alias("n"))
    got = nodes.select(key).distinct().join(deg, key, "left").crossJoin(F.broadcast(n))  # n is one row
    return got.select(key, F.coalesce("degree", F.lit(0)).alias("degree"), F.when(F.col("n") > 1, F.coalesce("degree", F.lit(0)) / (F.col("n") - 1)).otherwise(0.0).alias("centrality"))


def sources_needed(nodes: int, error: float, risk: float = 0.05) -> int:
    """How many sources keep every node's sampled betweenness within ``error`` of the exact one, but for a chance of ``risk``.

    Of one source each node gets a share of 0 to 1, and the mean over all
    sources is the betweenness; so by Hoeffding's bound, over all nodes at once.
    """
    return math.ceil(math.log(2 * max(nodes, 1) / risk) / (2 * error * error))


def betweenness(edges: DataFrame, nodes: DataFrame, key: str = "node", sources: int | None = None, seed: int = 1, error: float | None = None) -> DataFrame:
    """Share of shortest paths through each node, undirected, over (n-1)(n-2)/2.

    Exact: in components of no more than ``held`` links tasks walk from all
    sources (``paths``), in larger ones levels are joined (``_flows``) for a
    few sources at a time, whose tables then go. ``sources`` takes that many by
    hash and scales up, and ``error`` as many as keep within it
    (``sources_needed``); all, where that is fewer. No query samples.
    """
    return betweenness_of_pairs(stored(undirected(edges), "betweenness"), nodes, key, sources, seed, error)


def betweenness_of_pairs(pairs: DataFrame, nodes: DataFrame, key: str = "node", sources: int | None = None, seed: int = 1, error: float | None = None, held: int = 1 << 26, rows: int = 1 << 27) -> DataFrame:
    """``betweenness`` of ``undirected`` edges, which are read several times: a stored table."""
    all_nodes = nodes.select(F.col(key).alias("v")).distinct()
    n = all_nodes.count()
    if error is not None:
        sources = sources_needed(n, error)
    if sources is None or sources >= n:
        picked, score = n, _exact_shares(pairs, all_nodes, held, rows)
    else:
        nb = stored(both_ways(pairs), "betweenness")
        linked = stored(nb.select(F.col("x").alias("v")).distinct(), "betweenness")
        roots = stored(all_nodes.orderBy(F.xxhash64("v", F.lit(seed)), "v").limit(sources).select(F.col("v").alias("s")), "betweenness")
        picked, score = sources, _flows(nb, linked, roots, "betweenness")
    scale = 1.0 / ((n - 1) * (n - 2)) * (n / max(picked, 1)) if n > 2 else 0.0
    return all_nodes.join(score, "v", "left").select(F.col("v").alias(key), (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))


def _exact_shares(pairs: DataFrame, nodes: DataFrame, held: int, rows: int) -> DataFrame:
    """(v, b) of linked nodes: dependencies of all ``nodes`` on them, summed."""
    _table = lambda df: stored(df, "betweenness")
    known = _components(pairs).join(nodes.select("v", F.lit(True).alias("asked")), "v", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    ids = _table(numbered(known.withColumn("o", F.struct("c", ~F.col("asked"), "v")), "o", "i").drop("o"))  # of a component together, its sources first
    sizes = ids.groupBy("c").agg(F.min("i").alias("start"), F.count(F.lit(1)).alias("n"), F.count_if("asked").alias("asked"))
    ids = _table(ids.drop("asked").join(sizes, "c").withColumn("at", (F.col("i") - F.col("start")).cast("int")))
    links = pairs.join(ids.select(F.col("v").alias("a"), "start"), "a").groupBy("start").agg(F.count(F.lit(1)).alias("pairs"))
    parts = _table(ids.select("start", "n", "asked").distinct().join(links, "start"))
    small, large = parts.where(F.col("pairs") * 2 <= held), parts.where(F.col("pairs") * 2 > held)
    side = lambda c, to: ids.select(F.col("v").alias(c), F.col("at").alias(to))
    laid = pairs.join(ids.select(F.col("v").alias("a"), "start", F.col("at").alias("x")), "a").join(side("b", "y"), "b")
    score = component_shares(laid, small).join(ids.select("v", "i"), "i").select("v", "b")
    if large.isEmpty():
        return score
    spark = pairs.sparkSession
    linked = _table(ids.join(large.select("start"), "start", "left_semi").select("v"))
    nb = _table(both_ways(pairs.join(linked.withColumnRenamed("v", "a"), "a", "left_semi").select("a", "b")))
    roots = linked.join(nodes, "v", "left_semi").select(F.col("v").alias("s"))
    batches = math.ceil(roots.count() * linked.count() / rows)
    for k in range(batches):
        folder = f"betweenness-{uuid.uuid4().hex}"
        some = stored(roots.where(F.pmod(F.xxhash64("s"), F.lit(batches)) == k), f"{folder}/roots")
        part = _table(_flows(nb, linked, some, f"{folder}/level"))
        remove(spark, f"{shared_dir(spark)}/{folder}")
        score = score.union(part)
    return score.groupBy("v").agg(F.sum("b").alias("b"))


def _components(pairs: DataFrame) -> DataFrame:
    """(v, c) of ``connected_components``, first of each node's least neighbour alone: few pairs are left between those."""
    least = both_ways(pairs).groupBy("x").agg(F.min("y").alias("y"))
    first = stored(connected_components(least, "x", "y").select(F.col("node").alias("v"), F.col("component").alias("c")), "betweenness")
    side = lambda c: first.select(F.col("v").alias(c), F.col("c").alias(f"c_{c}"))
    across = pairs.join(side("a"), "a").join(side("b"), "b").where("c_a <> c_b").select("c_a", "c_b").distinct()
    then = connected_components(across, "c_a", "c_b").select(F.col("node").alias("c"), "component")
    return first.join(then, "c", "left").select("v", F.coalesce("component", "c").alias("c"))


def _flows(nb: DataFrame, linked: DataFrame, roots: DataFrame, label: str) -> DataFrame:
    """(v, b): dependencies of the roots (s) on each node, summed (Brandes).

    Level by level for all roots at once: rows (source, node) with distance
    and number of shortest paths go forward, then dependencies flow back from
    the deepest level. Between two levels rows start from the smaller: in a
    graph of few steps the last level's neighbours are nearly all pairs of
    sources and edges, while few nodes are left to ask for them. Each level is
    a table of its own.
    """
    _table = lambda df: stored(df, label)
    levels = [_table(roots.select("s", F.col("s").alias("v"), F.lit(1.0).alias("sigma")))]
    sizes = [levels[0].count()]
    pairs = sizes[0] * linked.count()
    while sizes[-1] and sum(sizes) < pairs:
        front = levels[-1]
        if pairs - sum(sizes) < sizes[-1]:
            left = _table(_rest(roots.crossJoin(linked), levels))
            asked = left.join(nb, F.col("v") == F.col("x")).select("s", F.col("v").alias("to"), F.col("y").alias("v"))
            fresh = asked.join(front, ["s", "v"]).groupBy("s", F.col("to").alias("v")).agg(F.sum("sigma").alias("sigma"))
        else:
            step = front.join(nb, F.col("v") == F.col("x")).groupBy("s", F.col("y").alias("v")).agg(F.sum("sigma").alias("sigma"))
            fresh = _rest(step, levels[-2:])  # neighbours lie a level back, on the same, or the next
        levels.append(_table(fresh))
        sizes.append(levels[-1].count())
    deltas, last = [], len(levels) - 1
    for d in range(last, 1, -1):
        low, up = levels[d].withColumn("delta", F.lit(0.0)), levels[d - 1].select("s", F.col("v").alias("u"), F.col("sigma").alias("sigma_u"))
        if deltas:
            low = levels[d].join(deltas[-1], ["s", "v"], "left").select("s", "v", "sigma", F.coalesce("delta", F.lit(0.0)).alias("delta"))
        low = low.select("s", "v", ((1.0 + F.col("delta")) / F.col("sigma")).alias("p"))
        if sizes[d - 1] < sizes[d]:
            part = up.join(nb, F.col("u") == F.col("x")).select("s", "u", F.col("y").alias("v"), "sigma_u").join(low, ["s", "v"])
            flow = part.groupBy("s", "u", "sigma_u").agg(F.sum("p").alias("p"))
        else:
            flow = low.join(nb, F.col("v") == F.col("x")).groupBy("s", F.col("y").alias("u")).agg(F.sum("p").alias("p")).join(up, ["s", "u"])
        deltas.append(_table(flow.select("s", F.col("u").alias("v"), (F.col("sigma_u") * F.col("p")).alias("delta"))))
    none = linked.where("false").withColumn("b", F.lit(0.0))
    return reduce(DataFrame.union, deltas).groupBy("v").agg(F.sum("delta").alias("b")) if deltas else none


def _rest(rows: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Rows (s, v) that are in none of the levels."""
    return rows.join(reduce(DataFrame.union, [x.select("s", "v") for x in levels]), ["s", "v"], "left_anti")


def neighborhood(edges: DataFrame, seeds: DataFrame, depth: int, key: str = "node") -> DataFrame:
    """Nodes within ``depth`` undirected steps of the seeds, with their distance."""
    nb = cut(both_ways(undirected(edges)))
    known = nb.select(F.col("x").alias(key)).distinct()
    seen = cut(seeds.select(key).distinct().join(known, key, "left_semi").withColumn("distance", F.lit(0)))
    front = seen
    for d in range(1, depth + 1):
        step = front.join(nb, F.col(key) == F.col("x")).select(F.col("y").alias(key)).distinct()
        front = cut(step.join(seen, key, "left_anti").withColumn("distance", F.lit(d)))
        seen = seen.union(front)
    return seen


def walk(edges: DataFrame, seeds: DataFrame, depth: int, cap: int, key: str = "node") -> DataFrame:
    """Outbound walk by generation: targets of the frontier by votes, the first ``cap`` go on; every target is a node."""
    seen = cut(seeds.select(key).distinct().select(key, F.lit(0).alias("generation"), F.lit(0).cast("long").alias("votes"), F.lit(True).alias("expanded")))
    front = seen.select(key)
    for g in range(1, depth + 1):
        votes = edges.join(front.withColumnRenamed(key, "source"), "source", "left_semi").groupBy(F.col("target").alias(key)).agg(F.countDistinct("source").alias("votes"))
        fresh = cut(votes.join(seen, key, "left_anti"))
        top = fresh.orderBy(F.desc("votes"), key).limit(cap).select(key)
        front = cut(top)
        flagged = fresh.join(front.withColumn("expanded", F.lit(True)), key, "left").select(key, F.lit(g).alias("generation"), "votes", F.coalesce("expanded", F.lit(False)).alias("expanded"))
        seen = cut(seen.union(flagged))
    return seen


def modularity(edges: DataFrame, labels: DataFrame, key: str = "node") -> DataFrame:
    """One row: the modularity of a partition of the undirected graph."""
    pairs = undirected(edges)
    m = pairs.agg(F.count(F.lit(1)).alias("m"))
    side = lambda c: labels.select(F.col(key).alias(c), F.col("community").alias(f"c_{c}"))
    inside = pairs.join(side("a"), "a").join(side("b"), "b").where("c_a = c_b").groupBy(F.col("c_a").alias("c")).agg(F.count(F.lit(1)).alias("l"))
    deg = both_ways(pairs).join(labels.withColumnRenamed(key, "x"), "x").groupBy(F.col("community").alias("c")).agg(F.count(F.lit(1)).alias("d"))
    got = deg.join(inside, "c", "left").crossJoin(F.broadcast(m))  # m is one row
    return got.agg(F.coalesce(F.sum(F.coalesce("l", F.lit(0)) / F.col("m") - F.pow(F.col("d") / (2.0 * F.col("m")), 2)), F.lit(0.0)).alias("modularity"))


def communities(edges: DataFrame, nodes: DataFrame, key: str = "node", rounds: int = 5, levels: int = 2) -> DataFrame:
    """(node, community): modularity local moving in parallel rounds, then the same on the contracted graph.

    In a round half of the nodes (by a hash of node and round) may move to the
    neighbouring community of greatest gain (ties to the smallest label), so
    pairs do not swap for ever and the result is the same each time. After each
    level, communities that fell apart are split into their connected parts, so
    every community is connected. Nodes without an edge are communities of their own; labels are numbered in order
    of their smallest node.
    """
    # Tables, not checkpoints: those hand the constraints of their plan on, which double with each round.
    _table = lambda df: stored(df, "communities")
    w = _table(undirected(edges).select("a", "b", F.lit(1.0).alias("w")))  # read by each step below; the edges may be a join of large tables
    total = w.agg(F.sum("w")).first()[0] or 0.0
    member = _table(nodes.select(F.col(key).alias("v")).distinct().select("v", F.col("v").alias("c")))
    if total:
        for _ in range(levels):
            graph = _table(w.where("a <> b").select(F.col("a").alias("x"), F.col("b").alias("y"), "w").union(w.where("a <> b").select(F.col("b").alias("x"), F.col("a").alias("y"), "w")))
            loops = w.where("a = b").select(F.col("a").alias("x"), (2 * F.col("w")).alias("w"))
            deg = _table(graph.select("x", "w").union(loops).groupBy("x").agg(F.sum("w").alias("k")))
            label = _table(deg.select(F.col("x").alias("v"), F.col("x").alias("c")))
            for r in range(rounds):
                sizes = label.join(deg, F.col("v") == F.col("x")).groupBy("c").agg(F.sum("k").alias("tot"))
                links = graph.where(F.pmod(F.xxhash64("x", F.lit(r)), F.lit(2)) == 0)  # of the nodes that may move; in the first round each neighbour is a community
                links = links.select("x", F.col("y").alias("c"), "w") if r == 0 else links.join(label.select(F.col("v").alias("y"), "c"), "y").groupBy("x", "c").agg(F.sum("w").alias("w"))
                now = label.join(deg, F.col("v") == F.col("x")).select("v", F.col("c").alias("own"), "k")
                opts = links.join(now, F.col("x") == F.col("v")).join(sizes, "c")
                gain = F.col("w") - F.col("k") * (F.col("tot") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)) / (2 * total)
                best = opts.select("v", "own", "c", gain.alias("g")).groupBy("v", "own").agg(F.min_by(F.struct("c", "g"), F.struct((-F.round("g", 9)).alias("n"), F.col("c"))).alias("t"), F.max(F.when(F.col("c") == F.col("own"), F.col("g"))).alias("stay"))
                stay = F.coalesce("stay", F.lit(0.0))
                moves = best.where(F.col("t.g") > stay + 1e-9).select("v", F.col("t.c").alias("to"))
                label = _table(label.join(moves, "v", "left").select("v", F.coalesce("to", "c").alias("c")))
            label = _table(_connected(label, w))
            up = label.select(F.col("v").alias("c"), F.col("c").alias("_to"))
            member = _table(member.join(up, "c", "left").select("v", F.coalesce("_to", "c").alias("c")))
            a, b = label.select(F.col("v").alias("a"), F.col("c").alias("ca")), label.select(F.col("v").alias("b"), F.col("c").alias("cb"))
            w = _table(w.join(a, "a").join(b, "b").groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("w").alias("w")))
    first = member.groupBy("c").agg(F.min("v").alias("first"))
    return member.join(numbered(first, "first", "community"), "c").select(F.col("v").alias(key), "community")


def _connected(label: DataFrame, pairs: DataFrame) -> DataFrame:
    """(v, c) with each community cut into its connected parts, named by their least node."""
    side = lambda c: label.select(F.col("v").alias(c), F.col("c").alias(f"c_{c}"))
    inside = pairs.where("a <> b").join(side("a"), "a").join(side("b"), "b").where("c_a = c_b").select(F.col("a").alias("source"), F.col("b").alias("target"))
    parts = connected_components(inside).select(F.col("node").alias("v"), "component")
    return label.join(parts, "v", "left").select("v", F.coalesce("component", "v").alias("c"))


def bridges(edges: DataFrame, labels: DataFrame, scores: DataFrame | None = None, key: str = "node") -> DataFrame:
    """Pairs between communities; if ``scores`` (node, betweenness) is given and some end is positive, only such pairs."""
    side = lambda c: labels.select(F.col(key).alias(c), F.col("community").alias(f"c_{c}"))
    got = undirected(edges).join(side("a"), "a").join(side("b"), "b").where("c_a <> c_b").select("a", "b")
    if scores is None:
        return got
    s = lambda c: scores.select(F.col(key).alias(c), F.col("betweenness").alias(f"s_{c}"))
    m = got.join(s("a"), "a", "left").join(s("b"), "b", "left").withColumn("pos", (F.coalesce("s_a", F.lit(0.0)) > 0) | (F.coalesce("s_b", F.lit(0.0)) > 0))
    some = m.agg(F.coalesce(F.max("pos"), F.lit(False)).alias("some"))
    return m.crossJoin(F.broadcast(some)).where("pos or not some").select("a", "b")  # one row


def god_nodes(degree: DataFrame, between: DataFrame, k: int = 5, key: str = "node") -> DataFrame:
    got = degree.join(between, key).select(key, (0.5 * F.col("centrality") + 0.5 * F.col("betweenness")).alias("score"))
    return got.orderBy(F.desc(F.round("score", 9)), key).limit(k)


def export_gate(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that may leave: works always, concepts if shareable, edges of a shareable class whose both ends stay."""
    ok = nodes.where((F.col("kind") == "work") | shareable("access_class")).withColumn("definition", F.when(shareable("access_class"), F.col("definition")))
    return ok, induced(edges.where(shareable("access_class")), ok)
