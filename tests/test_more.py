"""Orders, similarity joins near poles, densest sets with decay, estimates and sketches against brute force."""

import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from weftline.operators import graph as G
from weftline.operators import order
from weftline.operators import relational as R
from weftline.plans import densest as D
from weftline.plans import motifs as M

EXAMPLE = [(0, 1, 10), (0, 1, 11), (0, 1, 12), (1, 2, 15), (2, 3, 17), (2, 3, 18), (2, 3, 20), (3, 1, 22), (2, 0, 30), (2, 0, 31), (1, 4, 40), (1, 4, 43), (4, 0, 50), (0, 4, 51), (5, 1, 54), (6, 1, 55), (6, 1, 56), (1, 6, 58), (1, 6, 59)]


def edges_of(spark, n=24, m=90, seed=1):
    rng = random.Random(seed)
    rows = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})
    return spark.createDataFrame(rows, "src long, dst long"), rows


def test_prefix_sums(spark):
    rng = random.Random(0)
    rows = [(f"customer#{rng.randrange(10**6):07d}", i, rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "name string, i int, x long")
    total, want = 0, {}
    for k, (_, i, x) in enumerate(sorted(rows)):
        total += x
        want[i] = (k, total)
    got = order.prefix(order.numbered(df, ["name", "i"], "k"), ["name", "i"], {"s": F.col("x")}).collect()
    assert {r.i: (r.k, r.s) for r in got} == want
    assert order.numbered(df.where("false"), ["name"], "k").count() == 0


def test_haversine_near_poles_and_the_date_line(spark):
    rng = random.Random(3)
    places = [(i, rng.choice([rng.uniform(-90, 90), rng.uniform(86, 90), -89.9]), rng.choice([rng.uniform(-180, 180), 179.9, -179.9])) for i in range(250)]
    a = spark.createDataFrame(places, "a int, lat1 double, lon1 double")
    b = spark.createDataFrame(places, "b int, lat2 double, lon2 double")

    def km(p, q):
        x, y, dl = math.radians(p[1]), math.radians(q[1]), math.radians(q[2] - p[2])
        h = math.sin((y - x) / 2) ** 2 + math.cos(x) * math.cos(y) * math.sin(dl / 2) ** 2
        return 2 * R.EARTH_KM * math.atan2(math.sqrt(h), math.sqrt(max(0.0, 1 - h)))

    for most in (30.0, 900.0, 15000.0):
        want = {(p[0], q[0]) for p in places for q in places if km(p, q) <= most}
        assert {(r.a, r.b) for r in R.sim_join(a, b, ["lat1", "lon1"], ["lat2", "lon2"], most, "haversine").collect()} == want
    with pytest.raises(NotImplementedError):
        R.sim_join(a, b, ["lat1"], ["lat2"], 1.0, "jaccard")


def brute_density(spark, sets):
    nodes = sorted({x for s, _ in sets for x in s})
    return max(sum(w for s, w in sets if set(s) <= set(c)) / len(c) for k in range(1, len(nodes) + 1) for c in combinations(nodes, k))


@pytest.mark.parametrize("decay", [None, 0.05])
def test_densest_sets_with_decay(spark, decay):
    g = M.literal_graph(spark, EXAMPLE)
    sets = D.collect_hyperedges(M.hyperedges(M.instances(g, M.MOTIFS["m1"], 50), M.MOTIFS["m1"], decay))
    best = brute_density(spark, sets)
    assert D.exact_densest(sets, 3)[1] == pytest.approx(best)
    for algorithm in ("exact", "greedy", "batch", "hybrid", "probpeel"):
        rows = D.densest(g, M.MOTIFS["m1"], 50, algorithm, decay=decay, rounds=0).collect()
        nodes = spark.createDataFrame([(r.node,) for r in rows], "node long")
        found = M.evaluate(g, nodes, M.MOTIFS["m1"], 50, decay).first()["density"]
        assert rows[0].density == pytest.approx(found) and found <= best + 1e-9 and found >= best / 3.1
    assert D.densest(g, M.MOTIFS["m1"], 50, "hybrid", decay=decay, rounds=0).first()["density"] == pytest.approx(D.greedy_peel(sets, 3)[1])


def test_estimates_are_unbiased(spark):
    g = M.literal_graph(spark, EXAMPLE)
    true = M.instances(g, M.MOTIFS["m1"], 20).count()
    spread = D.estimate_spread(g, M.MOTIFS["m1"], 20, 4, 400).agg(F.sum("mean")).first()[0]
    assert spread / 3 == pytest.approx(true, rel=0.2)
    sweep = {(r.parameter, r.value): r.result for r in D.sweep(spark, g, M.MOTIFS["m1"], 20, [800], [0.01, 0.5]).collect()}
    assert sweep["samples", 800.0] == pytest.approx(true, rel=0.25) and sweep["xi", 0.01] >= sweep["xi", 0.5] > 0


def test_squares_estimate(spark):
    e, _ = edges_of(spark, 30, 260)
    true = G.squares(e).count()
    found = [G.squares_estimate(e, 0.5, seed).first()[0] for seed in range(6)]
    assert sum(found) / 6 == pytest.approx(true, rel=0.25)


def test_neighbourhood_function(spark):
    e, rows = edges_of(spark)
    nodes = {x for r in rows for x in r}
    reach = {x: {x} for x in nodes}
    want = [len(nodes)]
    while True:
        reach = {x: reach[x].union(*[reach[b] for a, b in rows if a == x]) for x in nodes}
        total = sum(map(len, reach.values()))
        if total == want[-1]:
            break
        want.append(total)
    got = [round(r.pairs) for r in G.neighbourhood_function(e, growth=0.0).orderBy("hop").collect()]
    assert got[: len(want)] == want and set(got[len(want) :]) <= {want[-1]}


def test_loops_that_do_not_settle_raise(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(8)], "src long, dst long")
    one = spark.createDataFrame([(0,)], "id long")
    with pytest.raises(RuntimeError):
        G.bfs(path, one, most=3)
    with pytest.raises(RuntimeError):
        G.weighted_distances(path.withColumn("w", F.lit(1.0)), 0, "w", most=3)


def test_matches_and_anchors(spark):
    e, rows = edges_of(spark, 12, 60)
    pairs = {(a, b) for a, b in rows if a != b}
    want = {(a, b, c) for a, b in pairs for x, c in pairs if x == b and c != a and (a, c) in pairs}
    assert {tuple(r) for r in G.static_matches(e, [(0, 1), (1, 2), (0, 2)]).collect()} == want
    anchor = sorted(pairs)[0]
    got = {tuple(r) for r in G.matches_of_edges(e, spark.createDataFrame([anchor], "src long, dst long"), [(0, 1), (1, 2), (0, 2)]).collect()}
    assert got == {(a, b, c) for a, b, c in want if anchor in ((a, b), (b, c), (a, c))}


def test_mode_networks(spark):
    people, places = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(1,), (9,)], "id long")
    visits = spark.createDataFrame([(1, 9), (2, 1)], "src long, dst long")
    net = G.ModeNet({"person": people}).with_mode("place", places).with_cross("visits", "person", "place", visits)
    nodes, edges = net.flat()
    assert nodes.count() == 4 and edges.count() == 2
    assert net.sub_modes({"person": F.col("id") == 1, "place": F.lit(True)}).neighbours("visits").collect() == [(1, 9)]
    assert net.without_mode("place").crosses == {} and net.sub_crosses(["visits"]).modes.keys() == {"person", "place"}
    assert net.without_cross("visits").crosses == {}
    with pytest.raises(ValueError):
        net.with_cross("x", "person", "nowhere", visits)
