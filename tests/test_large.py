"""Queries over more rows or larger groups than the tables of the other tests have."""

import math
import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from weftline import registry
from weftline.llm import ngram_join
from weftline.llm.scratch import durable
from weftline.operators import graph as G
from weftline.operators import pair_sums
from weftline.operators import relational as R
from weftline.operators import small_graphs as S
from weftline.operators.shared_graph import shared


def test_random_subgraphs_take_all_edges(spark, tmp_path):
    # More pairs than 1 << 20.
    duckdb.sql(f"copy (select i as event_id, timestamp '2024-01-01' + to_seconds(i % 2000000) as ts, (hash(i) % 300000)::bigint as user_id from range(1100000) r(i)) to '{tmp_path}/events.parquet' (format parquet)")
    row = registry.queries()["random_subgraphs"](spark, str(tmp_path)).first()
    want = duckdb.sql(registry.oracle_sql()["random_subgraphs"].replace("from events", f"from '{tmp_path}/events.parquet'")).fetchall()
    assert [tuple(row)] == want and row.edges > 1 << 20


def some_edges(spark, nodes, n, seed=0):
    r = random.Random(seed)
    rows = [(r.randrange(nodes), r.randrange(nodes)) for _ in range(n)] + [(nodes + 5, nodes + 5), (nodes + 7, nodes + 8)]
    return spark.createDataFrame(rows, "src long, dst long"), rows


@pytest.mark.parametrize("directed", [False, True])
@pytest.mark.parametrize("nodes, n", [(40, 90), (400, 500), (150, 2000)])
def test_distances_of_all_pairs(spark, nodes, n, directed, monkeypatch):
    monkeypatch.setattr(G, "bfs", None)  # no table of all pairs
    e, rows = some_edges(spark, nodes, n)
    e = e.withColumn("w", (F.col("dst") % 3 + 1).cast("double"))
    out = defaultdict(set)
    for a, b in rows:
        out[a].add(b)
        out[b].update([] if directed else [a])
    want, far = Counter(), {}
    for s in out.keys() | {b for _, b in rows}:
        dist, queue = {s: 0}, [s]
        for u in queue:
            for v in out[u] - dist.keys():
                dist[v] = dist[u] + 1
                queue.append(v)
        want.update((s, d) for d in dist.values())
        far[s] = max(dist.values())
    assert Counter({(r.source, r.dist): r.n for r in G.distance_counts(e, directed).collect()}) == want
    assert {r.id: r.eccentricity for r in G.eccentricity(e, directed).collect()} == far
    total = Counter()
    for (_, d), k in want.items():
        total[d] += k
    assert {r.dist: r.n for r in G.distance_distribution(e, directed=directed).collect()} == total


def test_weighted_distances_of_all_pairs(spark):
    e, rows = some_edges(spark, 60, 150, 1)
    weight = {(a, b): (0.1, 0.2, 0.7, 0.0)[(a + 2 * b) % 4] for a, b in rows}
    nodes = sorted({x for r in rows for x in r})
    want = {}
    for s in nodes:
        dist = {s: 0.0}
        for _ in nodes:
            for (a, b), w in weight.items():
                if a in dist and dist[a] + w < dist.get(b, math.inf):
                    dist[b] = dist[a] + w
        k = len(dist)
        want[s] = sum(dist.values()) / (k - 1) * (len(nodes) - 1) / (k - 1) if k > 1 else 0.0
    w = spark.createDataFrame([(a, b, x) for (a, b), x in weight.items()] + [(*rows[0], 5.0)], "src long, dst long, w double")
    got = {r.id: r.farness for r in G.weighted_closeness(w, "w").collect()}
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x]) for x in want)
    assert shared(w.withColumn("w", F.rand(1)), True, "w") is None  # left to the joins


def test_large_or_other_graphs_are_left_to_joins(spark):
    e, rows = some_edges(spark, 30, 60)
    assert shared(e, limit=10) is None and shared(e.selectExpr("string(src) as src", "dst")) is None
    assert shared(e.union(spark.createDataFrame([(None, 1)], "src long, dst long")), False) is None


def test_betweenness_of_more_edges(spark, monkeypatch):
    monkeypatch.setattr(S, "MAX_EDGES", 100)
    monkeypatch.setattr(S.adjacency, "__defaults__", (False, 100))
    e, rows = some_edges(spark, 120, 700)
    adj = defaultdict(set)
    for a, b in rows:
        adj[a] |= {b} - {a}
        adj[b] |= {a} - {b}
    want, _ = S.betweenness(adj)
    got = {r.id: r.betweenness for r in S.betweenness_table(e, 16).collect()}
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x]) for x in want)


def test_neighbourhood_function_is_exact_over_thousands_of_nodes(spark):
    e, rows = some_edges(spark, 3000, 4000, 2)
    adj = defaultdict(set)
    for a, b in rows:
        adj[a].add(b)
        adj[b].add(a)
    reach, want = {x: {x} for x in adj}, []
    for _ in range(4):
        want.append(sum(map(len, reach.values())))
        reach = {x: reach[x].union(*[reach[y] for y in adj[x]]) for x in adj}
    got = {r.hop: r.pairs for r in G.neighbourhood_function(e, directed=False, hops=3, growth=0.0).collect()}
    assert got == dict(enumerate(want))


def test_network_constraint_joins_no_paths(spark, monkeypatch):
    monkeypatch.setattr(G, "symmetric", None)  # the table that the paths of two edges are joined from
    e, rows = some_edges(spark, 50, 300, 3)
    adj = defaultdict(set)
    for a, b in rows:
        if a != b:
            adj[a].add(b)
            adj[b].add(a)
    p = {a: 1 / len(adj[a]) for a in adj}
    want = {i: sum((p[i] + sum(p[i] * p[q] for q in adj[i] & adj[j])) ** 2 for j in adj[i]) for i in adj}
    got = {r.id: r.constraint for r in G.network_constraint(e).collect()}
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x]) for x in want)


def test_haversine_takes_each_distance_once(spark, monkeypatch):
    # 300 rows at each of 6 places, two of them next to each other: distances of places, not of rows.
    taken = spark.sparkContext.accumulator(0)

    def side(i):
        return spark.range(1800).selectExpr(f"id as {'ab'[i - 1]}", f"double(if(id % 6 = 5, 0.5, id % 6 * 20)) as lat{i}", f"0.0D as lon{i}")

    monkeypatch.setattr(R, "haversine", lambda *c, real=R.haversine: F.udf(lambda d: taken.add(1) or d, "double")(real(*c)))
    n = R.sim_join_haversine(side(1), side(2), "lat1", "lon1", "lat2", "lon2", 100.0).where("a >= 0 and b >= 0").count()
    assert n == 300 * 300 * 8 and taken.value < 1000


@pytest.mark.parametrize("run, gathered", [(128, 100_000), (40, 90)])
def test_haversine_pairs_of_one_place_are_made_in_all_tasks(spark, monkeypatch, run, gathered):
    monkeypatch.setattr(R, "_RUN", run)
    monkeypatch.setattr(R, "_GATHERED", gathered)
    # 600 and 700 rows at a place, with equal ones and nulls among them, and its other zero; a few next to it and elsewhere.
    place = "if(id < 600, double(-(id % 2)) * 0.0D, id % 3 * 0.5D)"
    side = lambda i, n: spark.range(n).selectExpr(f"if(id % 5 = 0, null, id div 2) as {'ab'[i - 1]}", f"if(id % 7 = 0, null, {place}) as lat{i}", f"if(id % 11 = 0, null, 10.0D) as lon{i}")
    one, two = side(1, 620), side(2, 700)
    pairs = R.sim_join_haversine(one, two, "lat1", "lon1", "lat2", "lon2", 60.0)
    got = pairs.withColumn("task", F.spark_partition_id()).collect()
    rows = [[r for r in x.collect() if r[1] is not None and r[2] is not None] for x in (one, two)]
    want = Counter((x[0], y[0], x[1], y[1]) for x in rows[0] for y in rows[1] if abs(x[1] - y[1]) <= 0.5)
    assert pairs.columns == ["a", "lat1", "lon1", "b", "lat2", "lon2", "distance"]
    assert Counter((r.a, r.b, r.lat1, r.lat2) for r in got) == want
    per_task = Counter(r.task for r in got)
    assert len(per_task) == 4 and max(per_task.values()) < 0.4 * len(got)


@pytest.mark.parametrize("blocks, chunk", [(1, 1 << 22), (4, 50)])
def test_threshold_join_in_blocks(spark, monkeypatch, blocks, chunk):
    monkeypatch.setattr(R, "blocks_for", lambda n: blocks)
    monkeypatch.setattr(pair_sums, "_CHUNK", chunk)
    r = random.Random(4)
    side = lambda n: [(f"k{min(r.randrange(30), r.randrange(30))}", r.choice([None, *range(12)])) for _ in range(n)]
    x, y = side(300) + [(None, 3)] * 9, side(200)
    a, b = (spark.createDataFrame(rows, "k string, v long") for rows in (x, y))
    for least in (0, 9, 10**6):
        want = Counter((k, m) for k, v in x for m, w in y if v == w is not None)
        want = {p: n for p, n in want.items() if n >= least}
        out = R.threshold_join(a, "k", "v", b, "k", "v", least)
        assert {(t.key1, t.key2): t.matches for t in out.collect()} == want
    # No join makes a row for each pair of keys and value.
    plan = out._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan


@pytest.mark.parametrize("blocks, chunk", [(1, 1 << 22), (4, 50)])
def test_knn_in_blocks(spark, monkeypatch, blocks, chunk):
    monkeypatch.setattr(G, "blocks_for", lambda n: blocks)
    monkeypatch.setattr(pair_sums, "_CHUNK", chunk)
    r = random.Random(5)
    rows = [(r.randrange(60), 1000 + r.randrange(25)) for _ in range(400)] + [(2000, 3), (77, 2001)]
    out = defaultdict(set)
    for a, b in rows:
        out[a].add(b)
    out.pop(3)
    want = set()
    for a in out:
        near = sorted((-len(out[a] & out[b]) / len(out[a] | out[b]), b) for b in out if b != a and out[a] & out[b])[:3]
        want |= {(a, b, -s, i + 1) for i, (s, b) in enumerate(near)}
    found = G.knn_jaccard(spark.createDataFrame(rows, "src long, dst long"), 3)
    assert {tuple(x) for x in found.collect()} == want and found.count() == len(want)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()


def test_documents_that_stay_apart_make_no_pairs(spark, monkeypatch):
    # 96 common shingles and 13 own ones each: a similarity of 96 / 122, which the signatures leave possible.
    counts, real = [], ngram_join._between_components

    def seen(*args):
        out = durable(real(*args))
        counts.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "_between_components", seen)
    base = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(d, base + "".join(f" own{d}x{i}" for i in range(13))) for d in range(60)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()}
    assert got == {d: d for d in range(60)} and counts == [0]
