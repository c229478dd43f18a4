"""The genetic search crosses, migrates and saves sequences; small cases against the exact optimum; both tokenizer libraries."""

from itertools import product

import numpy as np
import pyarrow.parquet as pq
import pytest

from weftline.llm import packing


def fewest(sizes, length):
    """The least number of bins, by trying all placements."""
    best = len(sizes)

    def place(i, loads):
        nonlocal best
        if len(loads) >= best:
            return
        if i == len(sizes):
            best = len(loads)
            return
        for k in range(len(loads)):
            if loads[k] + sizes[i] <= length:
                place(i + 1, [*loads[:k], loads[k] + sizes[i], *loads[k + 1 :]])
        place(i + 1, [*loads, sizes[i]])

    place(0, [])
    return best


def test_small_cases_reach_the_optimum():
    rng = np.random.default_rng(0)
    for _ in range(25):
        sizes = np.sort(rng.integers(15, 60, 11))[::-1]
        best, _, _ = packing.evolve(sizes, [], np.random.default_rng(1), 100, 4, 60)
        assert np.bincount(best, weights=sizes).max() <= 100
        assert packing.fitness(sizes, best, 100)[0] == fewest(sorted(sizes.tolist(), reverse=True), 100)


def triplets(n):
    rng = np.random.default_rng(2)
    a, b = rng.integers(600, 760, n), rng.integers(560, 760, n)
    return np.r_[a, b, 2048 - a - b]


def test_islands_migrate_and_save_sequences(spark):
    sizes = triplets(300)
    items = spark.createDataFrame([(i, int(x)) for i, x in enumerate(sizes)], "uid long, length long")
    placed, history = packing.search(items, shard=500)
    rows = [[r.asDict() for r in h.collect()] for h in history]
    got = placed.collect()
    assert sorted(r.uid for r in got) == list(range(len(sizes)))
    place = np.full(len(sizes), -1)
    plain = 0
    for shard in {r.shard for r in got}:
        own = np.sort([sizes[r.uid] for r in got if r.shard == shard])[::-1]
        place = np.full(len(own), -1)
        packing.best_fit(own.tolist(), list(range(len(own))), place, [], 2048)
        plain += place.max() + 1
    assert len({(r.shard, r.bin) for r in got}) < plain
    assert len(rows) == packing.ROUNDS and all(r["kept"] > 0 for h in rows for r in h)
    assert all(r["migrants"] == (i > 0) for i, h in enumerate(rows) for r in h)
    assert sum(r["bins"] for r in rows[-1]) < sum(r["start"] for r in rows[0])


def test_crossover_keeps_a_packing():
    sizes = np.sort(triplets(60))[::-1]
    rng = np.random.default_rng(4)
    pool = []
    for spread in (0.0, 0.5):
        place = np.full(len(sizes), -1)
        packing.best_fit(sizes.tolist(), np.argsort(-sizes * rng.uniform(1 - spread, 1 + spread, len(sizes))).tolist(), place, [], 2048)
        pool.append(place)
    for a, b in product(pool, pool):
        child = packing.crossover(sizes, a, b, rng, 2048)
        load = np.bincount(child, weights=sizes)
        assert child.min() >= 0 and load.max() <= 2048 and load.sum() == sizes.sum()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_both_libraries_agree_on_the_tables(sf):
    encode = packing.Encoder(*packing.default_vocabulary())
    for name in ("documents", "pages", "conversations", "benchmark"):
        column = "html" if name == "pages" else "text"
        for text in pq.read_table(f"/root/testdata/{sf}/{name}.parquet", columns=[column]).column(0).to_pylist():
            assert encode(text or "") == encode.slow.encode(text or "", add_special_tokens=False).ids


def test_documents_longer_than_a_sequence(spark):
    docs = spark.createDataFrame([(1, "word " * 5000, "x"), (2, None, None), (2, "", "y"), (None, "a", "z")], "doc_id long, text string, `my-col` string")
    got = sorted((r.doc_id or 0, r.piece, r.start, r.length) for r in packing.pack(docs).collect())
    total = len(packing.Encoder(*packing.default_vocabulary())("word " * 5000)) + 1
    assert [(s, n) for d, _, s, n in got if d == 1] == packing.cut(total)
    assert [x for x in got if x[0] == 2] == [(2, 0, 0, 1)] * 2 and got[0][3] == 2
