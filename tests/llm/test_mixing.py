"""Words taken, by brute force from the keys' definition: whole epochs, then documents by key up to the target."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), ["a", "b", "b", "c", "c", "c", "c", "c", "c", None][i % 10], 1) for i in range(400)]
    rows += [(400, "w " * 900, "b", 1), (401, None, "a", 1), (402, "", "zero", 1), rows[5], (None, "w w", "c", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, `my-col` int"), rows


def test_taken_words_by_brute_force(spark):
    docs, rows = documents(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 400, 3)], "doc_id long, quality int")
    got = mixing.mixture(docs, labels).collect()
    assert len(got) == len(rows)
    target = {r.source_size: r.target for r in got}
    weight = {i: (mixing.GOOD if i % 2 else mixing.POOR) for i in range(0, 400, 3)}
    draw = {r.doc_id: r.u for r in docs.select("doc_id", F.pmod(F.xxhash64(F.lit(mixing.SEED), F.col("doc_id")), F.lit(1 << 52)).alias("u")).collect()}
    sources = defaultdict(list)
    for d, text, source, _ in rows:
        n = len(WORD.findall(text or ""))
        sources[source].append((-math.log((draw[d] + 0.5) / (1 << 52)) / weight.get(d, mixing.PLAIN), d is not None, d or 0, n))
    want = Counter()
    for own in sources.values():
        size = sum(x[3] for x in own)
        epochs = int(target[size] // size) if size else 0
        left = round(target[size] - epochs * size)
        for _, known, d, n in sorted(own):
            part = max(0, min(n, left))
            left -= n
            want[(d if known else None, n, min(3 * n, epochs * n + part) if size else 0)] += 1
    assert Counter((r.doc_id, r["size"], r.taken) for r in got) == want
    taken = defaultdict(int)
    for r in got:
        taken[r.source_size] += r.taken
    assert all(taken[s] == pytest.approx(t, abs=1) for s, t in target.items())


def test_rows_taken_follow_the_targets(spark):
    docs, rows = documents(spark)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r.source] += len(WORD.findall(r.text or ""))
    target = {r.source_size: r.target for r in mixing.mixture(docs).collect()}
    sizes = defaultdict(int)
    for _, text, source, _ in rows:
        sizes[source] += len(WORD.findall(text or ""))
    assert all(abs(words[s] - target[n]) <= 900 for s, n in sizes.items())
    assert mixing.mix(docs.where("false")).count() == 0
