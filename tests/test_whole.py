"""Queries over whole tables against brute force."""

from collections import Counter, defaultdict

import duckdb
import pytest

from weftline import registry
from weftline.operators import graph as G
from weftline.operators import small_graphs as S

SF = "/root/testdata/sf0.001"


def lines():
    return duckdb.sql(f"select o_custkey, l_suppkey from '{SF}/lineitem.parquet' join '{SF}/orders.parquet' on l_orderkey = o_orderkey").fetchall()


@pytest.mark.parametrize("per_value", [False, True])
def test_threshold_joins_take_all_customers(spark, per_value):
    by_value = defaultdict(Counter)
    for c, v in lines():
        by_value[v][c] += 1
    want = Counter()
    for v, n in by_value.items():
        for a, x in n.items():
            for b, y in n.items():
                want[(a, b, v) if per_value else (a, b)] += x * y
    want = {k: n for k, n in want.items() if n >= (12 if per_value else 60)}
    got = registry.queries()["join_threshold_per_key_all" if per_value else "join_threshold_all"](spark, SF).collect()
    assert {((r.key1, r.key2, r.value) if per_value else (r.key1, r.key2)): r.matches for r in got} == want and len(got) == len(want)
    assert any(k[0] % 7 for k in want)


def test_knn_takes_all_sources(spark):
    out = defaultdict(set)
    for c, v in lines():
        out[c].add(v)
    want = set()
    for a in out:
        near = sorted((-len(out[a] & out[b]) / len(out[a] | out[b]), b) for b in out if b != a and out[a] & out[b])[:3]
        want |= {(a, b, round(-s, 6)) for s, b in near}
    got = {(r.a, r.b, r.similarity) for r in registry.queries()["knn_jaccard_all"](spark, SF).collect()}
    assert got == want and any(a % 5 for a, _, _ in got)


def test_graph_queries_take_all_pairs(spark):
    q = registry.queries()
    e = {(r.src, r.dst) for r in registry._graph(spark, SF).collect()}
    adj = defaultdict(set)
    for a, b in e:
        adj[a].add(b)
        adj[b].add(a)
    triangles = sum(1 for a in adj for b in adj[a] for c in adj[b] & adj[a] if a < b < c)
    assert q["triangle_count_all"](spark, SF).first().triangles == triangles
    closed = {a: sum(1 for b in adj[a] for c in adj[b] & adj[a] if b < c) for a in adj}
    got = {r.id: (r.closed, r.open) for r in q["node_triads_all"](spark, SF).collect()}
    assert got == {a: (closed[a], len(adj[a]) * (len(adj[a]) - 1) // 2 - closed[a]) for a in adj}
    assert {r.id: r.root for r in q["wcc_all"](spark, SF).collect()} == {u: min(p) for p in S._split(adj) for u in p}
    # Also those without SQL.
    stats = {r.statistic: r.value for r in q["graph_statistics"](spark, SF).collect()}
    assert (stats["directed"], stats["triangles"], stats["nodes"]) == (len(e), triangles, len(adj))
    dist, queue = {1: 0}, [1]
    for u in queue:
        for v in sorted(b for a, b in e if a == u and b not in dist):
            dist[v] = dist[u] + 1
            queue.append(v)
    assert {r.id: r.dist for r in q["bfs_distance_all"](spark, SF).collect()} == dist


def test_loops_raise_at_their_caps(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(6)], "src long, dst long")
    start = spark.createDataFrame([(0,)], "id long")
    for run in (lambda: G.bfs(path, start, most=2), lambda: G.weak_components(path, most=1), lambda: G.strong_components(path, most=1)):
        with pytest.raises(RuntimeError, match="did not end"):
            run()
    assert G.bfs(path, start, hops=2).count() == 3 and G.nodes_at(path, 0, 2).count() == 1
