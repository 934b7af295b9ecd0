"""Betweenness in graphs of few steps and many edges."""

import numpy as np
import pytest

from corpusloom.operators import graph as G


def brandes(pairs, n):
    near = {v: set() for v in range(n)}
    for a, b in pairs:
        if a != b:
            near[a].add(b), near[b].add(a)
    got = dict.fromkeys(range(n), 0.0)
    for s in range(n):
        dist, sigma, order, delta = {s: 0}, {s: 1.0}, [s], dict.fromkeys(range(n), 0.0)
        for v in order:
            for w in near[v]:
                if w not in dist:
                    dist[w], sigma[w] = dist[v] + 1, 0.0
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
        for w in reversed(order):
            for v in near[w]:
                if dist[v] == dist[w] - 1:
                    delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                got[w] += delta[w]
    return {v: x / ((n - 1) * (n - 2)) for v, x in got.items()}


@pytest.mark.parametrize(("n", "m", "tail"), [(30, 150, 0), (30, 200, 4), (24, 20, 0)])
def test_betweenness_of_dense_tailed_and_broken_graphs(spark, n, m, tail):
    rng = np.random.default_rng(n + m)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2))] + [(n - 1 + i, n + i) for i in range(tail)]
    e, v = spark.createDataFrame(pairs, "source long, target long"), spark.createDataFrame([(i,) for i in range(n + tail + 2)], "node long")
    got = {r.node: r.betweenness for r in G.betweenness(e, v).collect()}
    assert got == pytest.approx(brandes(pairs, n + tail + 2))


def test_dense_levels_do_not_multiply(spark, monkeypatch):
    """Rows (source, node) times neighbours: no level goes out from nearly all pairs where few are left."""
    n, kept = 60, []
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if (i * 7 + j * 3) % 3 > 0]
    e, v = spark.createDataFrame(pairs, "source long, target long"), spark.createDataFrame([(i,) for i in range(n)], "node long")
    monkeypatch.setattr(G, "cut", lambda df: kept.append(df.count()) or df.localCheckpoint())
    G.betweenness(e, v)
    assert max(kept, default=0) < n * n  # all pairs seen were written again with each level


def test_communities_read_their_edges_once(spark):
    read = spark.sparkContext.accumulator(0)
    pairs = [(g * 10 + a, g * 10 + b) for g in range(3) for a in range(5) for b in range(a)] + [(0, 10), (10, 20)]

    def seen(e):
        read.add(1)
        return e

    edges = spark.createDataFrame(spark.sparkContext.parallelize(pairs, 2).map(seen), "source long, target long")
    nodes = spark.createDataFrame([(v,) for v in {x for p in pairs for x in p} | {99}], "node long")
    got = {r.node: r.community for r in G.communities(edges, nodes).collect()}
    assert read.value == len(pairs)
    assert got == {v: {0: 0, 1: 1, 2: 2, 9: 3}[v // 10] for v in got} and len(got) == 16


def test_betweenness_queries_walk_from_all_sources(spark, tmp_path):
    """Of more nodes than a sample took, each is a source; so too in components too large for a task, a few sources at a time."""
    from corpusloom import registry

    rng = np.random.default_rng(11)
    n = 150
    assert G.sources_needed(n, 0.2) < n
    pairs = sorted({(min(a, b), max(a, b)) for a, b in rng.integers(0, n, (230, 2)).tolist() if a != b})
    df = spark.createDataFrame([(k, i, v) for k, p in enumerate(pairs) for i, v in enumerate(p)], "l_orderkey long, l_linenumber int, l_suppkey long")
    df.selectExpr("*", "'A' as l_returnflag", "0.1D as l_discount", "timestamp'1995-01-01' as l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i,) for i in range(n)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    want = brandes(pairs, n)
    got = {r.node: r.betweenness for r in registry.queries()["g5_betweenness"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want, abs=1e-6)
    deg = {v: sum(v in p for p in pairs) / (n - 1) for v in range(n)}
    best = sorted(want, key=lambda v: (-round(0.5 * deg[v] + 0.5 * want[v], 9), v))[:5]
    assert {r.node: r.score for r in registry.queries()["g13_god_nodes"](spark, str(tmp_path)).collect()} == pytest.approx({v: 0.5 * deg[v] + 0.5 * want[v] for v in best}, abs=1e-6)
    tail = [(a, b) for a, b in pairs if a < 30 and b < 30] + [(200, 201), (201, 202)]  # 202 is no node that is asked for, so no source
    e, v = spark.createDataFrame(tail, "a long, b long"), spark.createDataFrame([(i,) for i in [*range(30), 200, 201]], "node long")
    some = {r.node: r.betweenness for r in G.betweenness_of_pairs(e, v, held=20, rows=200).collect()}
    assert some == pytest.approx({r.node: r.betweenness for r in G.betweenness_of_pairs(e, v).collect()})
    assert some[201] == pytest.approx(1 / (31 * 30))


def test_walks_in_pieces_equal_walks_at_once(monkeypatch):
    from corpusloom.operators import paths as P

    rng = np.random.default_rng(4)
    for n, m in ((30, 60), (40, 300), (25, 24)):
        pairs = {(min(a, b), max(a, b)) for a, b in rng.integers(0, n, (m, 2)).tolist() + [[i, i + 1] for i in range(n - 1)] if a != b}
        x, y = (np.array(z, np.int32) for z in zip(*pairs))
        want = [v * (n - 1) * (n - 2) for v in brandes(pairs, n).values()]
        for square, step in ((2048, 1 << 22), (0, 1 << 22), (0, 64), (2048, 64)):
            monkeypatch.setattr(P, "SQUARE", square), monkeypatch.setattr(P, "STEP", step)
            assert P._Walks(n, x, y).shares(np.arange(n)) == pytest.approx(want)


def test_god_nodes_make_their_edges_once(spark, monkeypatch):
    from corpusloom import registry

    made, undirected = [], G.undirected
    monkeypatch.setattr(G, "undirected", lambda e: made.append(e) or undirected(e))
    assert registry.queries()["g13_god_nodes"](spark, "/root/testdata/sf0.001").count() == 5
    assert len(made) == 1
