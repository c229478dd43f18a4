import pytest
from pyspark.sql import functions as F

from weftline.functions import columns as C
from weftline.operators import buckets as B
from weftline.operators import graph as G
from weftline.operators import relational as R
from weftline.operators import small_graphs as S
from weftline.sources import edges as E


def test_predicates_and_labels(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "b"), (3, None)], "a int, s string")
    assert [r.a for r in R.select(df, ("or", ("s", "substr", "b"), ("a", ">=", 3))).orderBy("a").collect()] == [1, 2, 3]
    assert [r.label for r in R.classify(df, ("not", ("a", "=", 2)), "label").orderBy("a").collect()] == [1, 0, 1]
    with pytest.raises(ValueError):
        R.compare("a", "~", 1)


def test_aggregates_keep_rows_and_null_groups(spark):
    df = spark.createDataFrame([(None, 1, 0), (None, 2, 1), ("x", 7, 2)], "g string, v int, o int")
    assert [(r.g, r.m) for r in R.aggregate(df, ["g"], "mean", "v", "m").orderBy("o").collect()] == [(None, 1), (None, 1), ("x", 7)]
    assert [r.m for r in R.aggregate(df, ["g"], "median", "v", "m").orderBy("o").collect()] == [2, 2, 7]


def test_bags_and_ranks(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int"), spark.createDataFrame([(1,), (1,), (3,), (None,)], "k int")
    assert sorted(str(r.k) for r in R.intersection(a, b).collect()) == ["1", "1", "None"]
    assert [r.k for r in R.minus(a, b).collect()] == [2]
    ranked = R.rank(b.where("k is not null").withColumn("t", F.monotonically_increasing_id()), ["k"], "t", coarse=F.floor(F.col("k") / 2))
    assert sorted((r.k, r["rank"]) for r in ranked.collect()) == [(1, 0), (1, 1), (3, 2)]


def test_sim_join_matches_all_pairs(spark):
    pts = [(i, (i * 37 % 11) / 3, (i * 53 % 7) / 2) for i in range(30)]
    a = spark.createDataFrame(pts, "i int, x double, y double")
    got = {(r.i_1, r.i_2) for r in R.sim_join_l2(a, a, ["x", "y"], ["x", "y"], 0.7).collect()}
    assert got == {(p[0], q[0]) for p in pts for q in pts if ((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2) ** 0.5 <= 0.7}


def test_buckets(spark):
    df = spark.createDataFrame([(x,) for x in range(10)], "t long")
    assert B.sliding(df, "t", 0, 9, 4, 2).where("t = 5").count() == 2
    assert B.expanding(df, "t", 0, 9, 5).groupBy("bucket").count().orderBy("bucket").collect()[1]["count"] == 10
    assert df.select(B.unit_start(F.lit(4 * 86400), "week").alias("w")).first().w == 3 * 86400


def test_readers(spark, tmp_path):
    p = tmp_path / "e.txt"
    p.write_text("# c\n1 2 5\n3 3 6\n2 1 4\n")
    assert E.read_temporal_edges(spark, str(p)).count() == 2
    assert E.count_self_loops(spark, str(p)) == 1
    (tmp_path / "bad.txt").write_text("1 2\n")
    with pytest.raises(Exception, match="3 fields"):
        E.read_temporal_edges(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "names.txt").write_text("b a\na c\n")
    edges, names = E.read_named_edges(spark, str(tmp_path / "names.txt"))
    assert sorted((r.src, r.dst) for r in edges.collect()) == [(0, 2), (1, 0)] and names.count() == 3


def test_graph_against_small_algorithms(spark):
    e = S.random_graph(spark, 30, 70, 3)
    adj = S.adjacency(e)
    roots = {r.id: r.root for r in G.weak_components(e).collect()}
    assert all(roots[u] == min(p) for p in S._split(adj) for u in p)
    tri = G.triangle_count(e).first().triangles
    assert tri == sum(1 for a in adj for b in adj[a] for c in adj[b] & adj[a] if a < b < c)
    strong = G.strong_components(G.add_edges(S.circle(spark, 4), spark.createDataFrame([(3, 9)], "src long, dst long")))
    assert {r.id: r.root for r in strong.collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 9: 9}
    assert G.shortest_path(S.grid(spark, 3, 3), 0, 8) == [0, 1, 2, 5, 8]
    assert G.k_core(S.full(spark, 4), 3).count() == 6
    total = sum(r["rank"] for r in G.pagerank(e).collect())
    assert total == pytest.approx(1.0)


def test_small_graphs(spark):
    path = {0: {1}, 1: {0, 2}, 2: {1, 3, 4}, 3: {2, 4}, 4: {2, 3}}
    bridges, cuts, parts = S.bridges_and_cuts(path)
    assert bridges == [(0, 1), (1, 2)] and cuts == [1, 2] and len(parts) == 3
    node, _ = S.betweenness(path)
    assert node[1] == 3 and node[2] == 4
    two = {i: {j for j in range(6) if j != i and i // 3 == j // 3} for i in range(6)}
    two[2].add(3)
    two[3].add(2)
    assert sorted(map(sorted, S.girvan_newman(two)[0])) == [[0, 1, 2], [3, 4, 5]] == sorted(map(sorted, S.greedy_modularity(two)[0]))
    flow = spark.createDataFrame([(0, 1, 3), (0, 2, 2), (1, 2, 5), (1, 3, 2), (2, 3, 3)], "src long, dst long, capacity long")
    assert S.max_flow(flow, 0, 3) == 5
    assert S.canonical_form({(5, 7), (7, 9)}) == S.canonical_form({(1, 0), (0, 2)})


def test_texts(spark):
    df = spark.createDataFrame([("<b>Hi</b> you", "https://www.Example.org/a/#x")], "h string, u string")
    r = df.select(C.strip_html(F.col("h")).alias("h"), C.normalized_url(F.col("u")).alias("u"), C.person_name(F.lit("Ada B. Lovelace")).alias("n")).first()
    assert (r.h, r.u, r.n) == ("Hi you", "example.org/a", "lovelace_ab")


def test_stream_windows(spark, tmp_path):
    from weftline.streaming.windows import windowed_counts

    spark.sql("select timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, id) as ts, 'a' as k from range(10)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k string").parquet(str(tmp_path / "in"))
    q = windowed_counts(stream, "ts", ["k"], "5 minutes").writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [r.n for r in spark.sql("select n from w order by start").collect()] == [5, 5]
