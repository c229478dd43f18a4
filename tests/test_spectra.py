"""Singular values, eigenpairs, core measures, paws, component statistics and growing networks against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest

from weftline.operators import graph as G
from weftline.operators import small_graphs as S
from weftline.operators import spectra as P


def edges_of(spark, n=14, m=50, seed=1):
    rng = random.Random(seed)
    rows = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})
    return spark.createDataFrame(rows, "src long, dst long"), rows


def test_singular_vectors(spark):
    df, rows = edges_of(spark)
    n = 14
    a = np.zeros((n, n))
    for x, y in rows:
        a[x, y] = 1
    want = np.linalg.svd(a)[1][:2]
    values, vectors = P.singular_vectors(df, 2)
    np.testing.assert_allclose(values, want, rtol=1e-6)
    left, right = np.zeros((2, n)), np.zeros((2, n))
    for r in vectors.collect():
        left[r["rank"] - 1, r["id"]], right[r["rank"] - 1, r["id"]] = r["left"], r["right"]
    np.testing.assert_allclose(a @ right.T, left.T * values, atol=1e-3)
    np.testing.assert_allclose(right @ right.T, np.eye(2), atol=1e-6)


def test_ranks_below_k(spark):
    values, vectors = P.singular_vectors(spark.createDataFrame([(0, 1), (0, 2)], "src long, dst long"), 3)
    np.testing.assert_allclose(values, [2**0.5], rtol=1e-9)
    assert vectors.count() == 3
    empty = spark.createDataFrame([], "src long, dst long")
    assert P.singular_vectors(empty, 2)[0] == [] and P.eigenpairs(empty, 2)[1].count() == 0
    with pytest.raises(ValueError):
        P.singular_vectors(empty, 0)


def test_eigenpairs_and_participation(spark):
    # A star with three leaves: eigenvalues sqrt(3) and -sqrt(3), with equal ratios.
    star = spark.createDataFrame([(0, 1), (0, 2), (3, 0), (0, 0)], "src long, dst long")
    values, vectors = P.eigenpairs(star, 2)
    np.testing.assert_allclose(sorted(values), [-(3**0.5), 3**0.5], rtol=1e-9)
    ratios = [r.ratio for r in P.participation_ratios(vectors).collect()]
    np.testing.assert_allclose(ratios, [1 / 4 + 3 / 36] * 2, rtol=1e-6)


def test_paws_and_core_measures(spark):
    df, rows = edges_of(spark)
    und = {frozenset(r) for r in rows if r[0] != r[1]}
    near = lambda x: {y for e in und if x in e for y in e if y != x}
    anchors = [rows[3], rows[10][::-1], (100, 101)]
    want = set()
    for u, v in {tuple(sorted(x)) for x in anchors if frozenset(x) in und}:
        for w in near(u) & near(v):
            want |= {(u, v, w, at, x) for at in (u, v, w) for x in near(at) - {u, v, w}}
    got = G.paws_of_edges(df, spark.createDataFrame(anchors, "src long, dst long")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    core, nodes = {0, 1, 2, 3, 4}, {x for e in rows for x in e}
    r = G.core_measures(df, spark.createDataFrame([(x,) for x in core], "id long")).first()
    k, o = len(core & nodes), len(nodes - core)
    inside = sum(e <= core for e in und)
    assert r.touched == pytest.approx(sum(bool(e & core) for e in und) / (k * (k - 1) / 2))
    assert r.inside == pytest.approx(inside / (k * (k - 1) / 2))
    assert r.quality == pytest.approx(inside / (k * (k - 1) / 2) + 1 - sum(not e & core for e in und) / (o * (o - 1) / 2))
    r = G.core_measures(df.where("false"), spark.createDataFrame([], "id long")).first()
    assert r.touched is None and r.quality is None


def test_component_statistics(spark):
    rows = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 2), (5, 6), (6, 6), (0, 1)]
    got = {r.statistic: r.value for r in G.component_statistics(spark.createDataFrame(rows, "src long, dst long")).collect()}
    und = {frozenset(r) for r in rows if r[0] != r[1]}
    triangles = sum(all(frozenset(p) in und for p in combinations(t, 2)) for t in combinations(range(7), 3))
    want = {"nodes": 6, "edges": 6, "unique_edges": 5, "mutual_edges": 1, "src_nodes": 5, "dst_nodes": 5, "wcc_nodes": 4, "wcc_edges": 5, "wcc_unique_edges": 4, "wcc_mutual_edges": 1, "wcc_src_nodes": 4, "wcc_dst_nodes": 4}
    want |= {"scc_nodes": 4, "scc_edges": 5, "closed_triads": triangles, "open_triads": 2, "wcc_share": 4 / 6, "scc_share": 4 / 6}
    assert got == pytest.approx(want)


def test_growing_networks(spark):
    for df, m in ((S.timed_random(spark, 20, 60, 1), 60), (S.timed_preferential(spark, 20, 3, 1), 1 + 2 + 3 * 17), (S.timed_evolution(spark, 20, 60, 1.0, 1.0, 1), 60)):
        rows = df.collect()
        assert len(rows) == len({(r.src, r.dst) for r in rows}) == m
        assert all(r.src != r.dst for r in rows) and len({r.t for r in rows}) == m
        assert max(max(r.src, r.dst) for r in rows) < 20
    assert S.timed_random(spark, 20, 60, 1).collect() == S.timed_random(spark, 20, 60, 1).collect()
    with pytest.raises(ValueError):
        S.timed_random(spark, 3, 7)
    with pytest.raises(RuntimeError):
        S.timed_evolution(spark, 20, 60, 1.0, 1.0, 1, most=10)
