from fractions import Fraction
from itertools import combinations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.plans import densest as D
from weftline.plans import motifs as M

TESTS = [(0, 1, 1), (2, 0, 2), (2, 0, 7), (2, 0, 9), (2, 3, 10), (2, 3, 12), (2, 3, 13), (2, 3, 15), (2, 3, 18), (4, 3, 20), (4, 3, 23), (4, 3, 24), (4, 3, 25), (4, 3, 26)]
EXAMPLE = [(0, 1, 10), (0, 1, 11), (0, 1, 12), (1, 2, 15), (2, 3, 17), (2, 3, 18), (2, 3, 20), (3, 1, 22), (2, 0, 30), (2, 0, 31), (1, 4, 40), (1, 4, 43), (4, 0, 50), (0, 4, 51), (5, 1, 54), (6, 1, 55), (6, 1, 56), (1, 6, 58), (1, 6, 59)]


def brute(rows, motif, delta):
    found = []

    def extend(chosen, where):
        if len(chosen) == len(motif.edges):
            found.append((tuple(chosen), tuple(where[i] for i in range(motif.k))))
            return
        u, v = motif.edges[len(chosen)]
        for i, (a, b, t) in enumerate(rows):
            if a == b or (chosen and (t <= rows[chosen[-1]][2] or t > rows[chosen[0]][2] + delta)):
                continue
            new = dict(where)
            if new.setdefault(u, a) == a and new.setdefault(v, b) == b and len(set(new.values())) == len(new):
                extend([*chosen, i], new)

    extend([], {})
    return found


@pytest.mark.parametrize(("rows", "delta", "motif", "count", "best"), [(TESTS, 10, "m6", 8, Fraction(8, 3)), (TESTS, 50, "m6", 100, Fraction(100, 3)), (EXAMPLE, 10, "m1", 13, Fraction(9, 4)), (EXAMPLE, 20, "m3", 8, 2), (EXAMPLE, 50, "m2", 25, Fraction(25, 6)), (EXAMPLE, 50, "m1", 33, Fraction(31, 6))])
def test_fixture_counts_and_densities(spark, rows, delta, motif, count, best):
    m = M.MOTIFS[motif]
    found = M.instances(M.literal_graph(spark, rows), m, delta)
    assert found.count() == count == M.instances(M.literal_graph(spark, rows), m, delta, strategy="slab").count()
    sets = D.collect_hyperedges(M.hyperedges(found, m))
    nodes, density = D.exact_densest(sets, m.k)
    assert density == pytest.approx(float(best))
    assert sum(w for s, w in sets if set(s) <= set(nodes)) / len(nodes) == pytest.approx(density)
    _, greedy = D.greedy_peel(sets, m.k)
    _, batch = D.batch_peel(M.hyperedges(found, m), m.k, 0.1)
    assert float(best) >= greedy >= float(best) / m.k and batch >= float(best) / (m.k * 1.1)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4), st.integers(-15, 15)), max_size=14), st.integers(0, 12), st.sampled_from(["m1", "m3", "m5", "m7", "m10"]))
def test_instances_match_brute_force(spark, rows, delta, name):
    m = M.MOTIFS[name]
    found = M.instances(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "eid long, src long, dst long, t long"), m, delta)
    got = {(tuple(r[f"e{i + 1}"] for i in range(len(m.edges))), tuple(r[f"n{i}"] for i in range(m.k))) for r in found.collect()}
    assert got == set(brute(rows, m, delta))


def test_exact_is_the_maximum_over_all_node_sets():
    sets = [((0, 1, 2), 3.0), ((1, 2, 3), 2.0), ((3, 4, 5), 4.0), ((0, 4, 5), 1.0)]
    best = max(sum(w for s, w in sets if set(s) <= set(c)) / len(c) for n in range(3, 7) for c in combinations(range(6), n))
    assert D.exact_densest(sets, 3)[1] == pytest.approx(best)
    assert D.exact_densest([], 3) == ([], 0.0)


def test_sampling_is_unbiased(spark):
    edges, m = M.literal_graph(spark, EXAMPLE), M.MOTIFS["m1"]
    estimates = [D.sampled_hyperedges(edges, m, 20, 400, seed).agg(F.sum("w")).first()[0] or 0.0 for seed in range(4)]
    assert sum(estimates) / 4 == pytest.approx(17, rel=0.25)


def test_decay_and_span(spark):
    edges = M.literal_graph(spark, [(0, 1, 0), (1, 2, 10), (1, 2, 11)])
    assert M.instances(edges, M.MOTIFS["m1"], 10).count() == 1
    w = M.hyperedges(M.instances(edges, M.MOTIFS["m1"], 10), M.MOTIFS["m1"], 0.1).first()["w"]
    assert w == pytest.approx(2.718281828 ** -1)


def test_bad_motifs():
    with pytest.raises(ValueError):
        M.Motif(((0, 0),))
    assert M.Motif.parse("0 1 1\n1 2 2").edges == ((0, 1), (1, 2))
