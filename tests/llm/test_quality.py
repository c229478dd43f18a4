"""The quality model and its limits come from all trusted documents, however many the labels name."""

import functools
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import quality
from weftline.llm.blocks import pack
from weftline.llm.scratch import durable, small


def test_all_trusted_documents_count(spark):
    docs = spark.createDataFrame([(i, f"text {i * 7919 % 1000} of number {'abcdefghij'[i % 10] * 5}", "en" if i % 20 else "de") for i in range(60)], "doc_id long, text string, lang string")
    few = spark.range(60).selectExpr("id as doc_id", "1 as quality")
    many = spark.range(400_000).selectExpr("id as doc_id", "1 as quality")
    want, got = ({r.doc_id: (r.perplexity, r.threshold, r.kept) for r in quality.classify(docs, labels).collect()} for labels in (few, many))
    assert got == want and len(got) == 60


def brute(trusted):
    """log2 probability of a text under interpolated modified Kneser-Ney over bytes, n-gram after n-gram."""
    m = quality.ORDER
    spelled = lambda t: (0,) * (m - 1) + tuple(b + 1 for b in "".join(c.lower() if c.isascii() else c for c in t or "").encode()) + (0,)
    raw = [Counter(s[i - k + 1 : i + 1] for s in map(spelled, trusted) for i in range(m - 1, len(s))) for k in range(m + 1)]
    counts = {m: raw[m]}
    for k in range(m - 1, 0, -1):
        before = Counter(g[1:] for g in counts[k + 1])
        counts[k] = {g: raw[k][g] if k > 1 and g[0] == 0 else n for g, n in before.items()}
    discounts, after = {}, {}
    for k, table in counts.items():
        n = [0, *(sum(x == i for x in table.values()) for i in (1, 2, 3, 4))]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        discounts[k] = [0, *(min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i - 0.05) if n[i] and n[i + 1] else 0.5 for i in (1, 2, 3))]
        for g, x in table.items():
            after.setdefault(g[:-1], []).append(x)

    @functools.cache
    def p(g):
        k = len(g)
        if not k:
            return 1 / 257
        if g[:-1] not in after:
            return p(g[1:])
        d, seen = discounts[k], after[g[:-1]]
        x = counts[k].get(g, 0)
        return (x - d[min(x, 3)] + sum(d[min(i, 3)] for i in seen) * p(g[1:])) / sum(seen)

    def perplexity(t):
        s = spelled(t)
        return 2 ** (-sum(math.log2(p(s[i - m + 1 : i + 1])) for i in range(m - 1, len(s))) / (len(s) - m + 1))

    return perplexity


def test_perplexities_equal_brute_force(spark, monkeypatch):
    # Bytes that one symbol once stood for: digits, marks, letters of other scripts.
    good = ["The cat sat on the mat.", "the cat ran, 10 of 12 times", "Слово о полку Игореве", "слова и слоги", "猫は丸くなる", "", None, "a", "the THE the"]
    rest = ["The cot sat on tho met.", "the cat ran; 97 of 35 times", "Олово ф рплку", "犬は走る", "", "qzx \x00\x7f", "the cat sat " * 100_000, " \t\n", "éa" * 40]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(good + rest)], "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1) for i in range(len(good))], "doc_id long, quality int")
    want = brute(good)
    for boxes in (256, 1):
        monkeypatch.setattr(quality, "BOXES", boxes, raising=False)
        got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
        assert {i: r.n_bytes for i, r in got.items()} == {i: len((t or "").encode()) for i, t in enumerate(good + rest)}
        assert {i: r.perplexity for i, r in got.items()} == pytest.approx({i: want(t) for i, t in enumerate(good + rest)}, rel=1e-5)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("weftline_")]


def test_texts_do_not_move(spark, monkeypatch):
    """Boxes are in buckets: no exchange has their payload, whether the trusted ids are few or many."""
    rows = spark.createDataFrame([(1, "some text", "en"), (2, None, None)], "doc_id long, text string, lang string")
    plans = []
    for limit in (quality.small.__defaults__[0], 0):
        monkeypatch.setattr(quality, "small", lambda df, limit=limit: small(df, limit))
        monkeypatch.setattr(quality, "durable", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or durable(df))
        with quality._boxed(rows) as boxes:
            model = quality.learn(boxes, spark.range(2).toDF("doc_id"))
            assert {r.doc_id for r in quality._perplexities(boxes, model).collect()} == {1, 2}
    assert len(plans) == 4
    for plan in plans:
        tree = plan.split("\n")
        ends = []
        for i in (i for i, line in enumerate(tree) if "FileScan" in line and "payload" in line and "spark_catalog" in line):
            depth = tree[i].index("FileScan")
            for line in reversed(tree[:i]):
                here = len(line) - len(line.lstrip(" :+-"))
                if here < depth:
                    depth = here
                    assert "Exchange" not in line
                    if "CoGroups" in line or "MapInArrow" in line:
                        ends.append("CoGroups" in line)
                        break
        assert any(ends)


def test_no_trusted_text_leaves_a_uniform_model(spark):
    docs = spark.createDataFrame([(1, "some text", "en"), (2, None, None), (None, "x", "en")], "doc_id long, text string, lang string")
    got = quality.classify(docs, spark.createDataFrame([(1, 0)], "doc_id long, quality int")).collect()
    assert len(got) == 3 and all(r.kept for r in got)
    assert [r.perplexity for r in got] == pytest.approx([257] * 3, rel=1e-5)


def test_left_out_equals_counts_without_one():
    grams = np.unique(np.concatenate([code for _, _, code in quality._windows(pa.array(["the cat", "the cats", "that at", "at a tea"]))]))
    order, cuts = quality._by_shard(grams)
    discounts = {k: np.array([0, 0.4, 0.8, 1.1]) for k in range(3, quality.ORDER + 1)}
    pairs = np.full((257, 257), 1 / 257)
    for _, lo, hi in cuts:
        own = grams[order[lo:hi]]
        n = np.arange(len(own)) % 3 + 1
        _, left = quality._probabilities(own, pack(np.diff(own, prepend=0), n), discounts, pairs)
        for i in range(len(own)):
            less = n - (np.arange(len(own)) == i)
            rest = own[less > 0]
            want, _ = quality._probabilities(own[i : i + 1], pack(np.diff(rest, prepend=0), less[less > 0]), discounts, pairs)
            assert left[i] == pytest.approx(want[0])


def test_limits_hold_for_texts_that_the_model_has_not_seen(spark):
    rng = np.random.default_rng(5)
    parts = ["".join(rng.choice(list("etaoinshrdlucm"), rng.integers(2, 4))) for _ in range(60)]
    texts = [" ".join("".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(40)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*texts, *("".join(rng.permutation(list(t))) for t in texts)])], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in quality.classify(docs, spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int")).collect() if r.kept}
    assert kept == set(range(60))
