"""The seated model against a plain one made from dictionaries: predictive probabilities, their sums, and scores."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import pitman_yor as py
from weftline.llm.blocks import blocks

WORD = re.compile(r"[^\x20\x09-\x0D]+")
END = "\0end"


def corpus():
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(40)]
    weights = 1 / np.arange(1, 41)
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(0, 60)), p=weights / weights.sum()))) for i in range(120)]
    return [*rows, (120, "new words here w0"), (121, None), (122, ""), rows[3], (None, "w1 w2 w1")]


def hashed(word):
    return py._END if word == END else max(next(blocks(pa.array([word]))).hashes[0] >> np.uint64(16), np.uint64(1))


def key_of(u, w):
    return int(py.dish_key(np.array([np.uint64(0) if u is None else hashed(u)]), np.array([hashed(w)]))[0])


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string").withColumn("held", py.held_out())


def test_probabilities_by_brute_force(spark, rows):
    model = py.Model(rows, 4, 3, 1, keep_state=True)
    state, answers = model.state
    numbers = model.numbers
    shards = {}
    for r in py.Model._with(model, state, answers).collect():
        shards.setdefault(r.shard, []).append(r.asDict())
    seated = [py.Seated(x, numbers, model.roots) for x in shards.values()]
    tables = {int(k): int(t) for x in seated for k, t in zip(x.key, x.t, strict=True)}
    found = {int(k): float(p) for x in seated for k, p in zip(x.key, x.predictive(), strict=True)}
    at_root = {int(w): int(t) for x in seated for w, t in zip(x.words, x.tables, strict=True)}
    train, every = Counter(), set()
    for i, text in corpus():
        w = [*WORD.findall(text or ""), END]
        pairs = list(zip([None, *w[:-1]], w, strict=True))
        every |= set(pairs)
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            train.update(pairs)
    assert found.keys() == {key_of(*x) for x in every}
    t = {x: tables[key_of(*x)] for x in every}
    assert all(1 <= t[x] <= n for x, n in train.items()) and all(t[x] == 0 for x in every if x not in train)
    assert any(1 < t[x] < n for x, n in train.items())
    vocabulary = {w for _, w in train}
    customers = Counter()
    for (_, w), n in t.items():
        customers[w] += n
    root = {w: at_root[int(hashed(w))] for w in vocabulary}
    assert all(1 <= root[w] <= customers[w] for w in vocabulary)
    d, d0 = numbers["d"], numbers["d0"]
    parent = lambda w: (customers[w] - d0 * root.get(w, 0) + (py.PARENT_STRENGTH + d0 * sum(root.values())) / (len(vocabulary) + 1)) / (py.PARENT_STRENGTH + sum(customers.values()))

    def p(u, w):
        c, tu = (sum(x.get((u, v), 0) for v in vocabulary) for x in (train, t))
        return (train[u, w] - d * t.get((u, w), 0) + (py.STRENGTH + d * tu) * parent(w)) / (py.STRENGTH + c)

    for x in every:
        assert found[key_of(*x)] == pytest.approx(p(*x))
    for u in {u for u, _ in every}:
        assert sum(p(u, w) for w in vocabulary) + p(u, "\0unknown") == pytest.approx(1)


def test_scores_are_sums_of_averages(rows):
    docs = rows.drop("held")
    got = {r.doc_id: r for r in py.score(docs, 4, 2, 10).collect()}
    again = {r.doc_id: r for r in py.score(docs.repartition(7), 4, 2, 10).collect()}
    assert {k: round(r.score, 3) for k, r in got.items()} == {k: round(r.score, 3) for k, r in again.items()}
    assert got[121].n_tokens == got[122].n_tokens == 1 and got[121].score == pytest.approx(got[122].score)
    assert py.score(docs).count() == len(corpus())
    # Contexts tell more than the base score knows.
    rng = np.random.default_rng(1)
    chain = [(i, " ".join(f"a{(s + j) % 30}" for j in range(40))) for i, s in enumerate(rng.integers(0, 30, 200))]
    r = py.score(docs.sparkSession.createDataFrame(chain, "doc_id long, text string")).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > 0.2 * r.b


def test_hot_contexts_go_to_several_tasks(rows, monkeypatch):
    docs = rows.drop("held")
    want = sorted((r.doc_id or -1, round(r.score, 4), round(r.base_score, 6)) for r in py.score(docs, 2, 1, 20).collect())
    monkeypatch.setattr(py, "TASK_USES", 100)
    monkeypatch.setattr(py, "MERGED", 2)
    monkeypatch.setattr(py, "LEAST_TOKENS", 200)
    got = sorted((r.doc_id or -1, round(r.score, 4), round(r.base_score, 6)) for r in py.score(docs, 2, 1, 20).collect())
    assert got == want


def test_no_training_documents(spark):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1]
    rows = py.score(spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")).collect()
    assert len(rows) == len(held) and all(r.n_known == r.train_tokens == 0 and math.isfinite(r.score) for r in rows)
