"""Quality classification by an interpolated modified Kneser-Ney model of trusted text.

The model is over n-grams of ORDER symbols: the 256 bytes of the text, A-Z lower-cased, and its edge. Counts come from all
trusted texts and stay in shards; the shard of an n-gram is that of the two symbols before its last, so all its suffixes of
three symbols or more and their contexts are in the same shard, and continuation counts and totals are taken there. Only
the levels of one and two symbols, at most SYMBOLS**2 numbers, and the numbers of n-grams that occur once to four times
meet on the driver.

Texts are scored by a join with those shards. They are put into boxes; a box asks each shard for its distinct n-grams, the
shard answers with their probabilities from its counts, and the answers meet the box again. Boxes are written in buckets,
so neither that nor marking the trusted texts in them shuffles any text.

A document is kept if its perplexity is at most SLACK times the QUANTILE of the trusted documents in its language, or, where a
language has no trusted ones, of its own documents. As the model has seen the trusted documents, that quantile is of
perplexities that leave one of the times out that each of their n-grams occurs.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.blocks import LOWER, U, distinct, mix, pack, raw, returning, unpack
from weftline.llm.scratch import bucketed, durable, small, temporary, unlist

ORDER = 6
#: Symbol 0 is the edge of a text, 1 + b is byte b.
SYMBOLS = 257
SHARDS = 64
QUANTILE = 0.99
#: The limit is this many times the quantile, as trusted texts are seen in training and others are not.
SLACK = 1.25
#: Text that is put into one box, and that is turned into n-grams at once.
BOX_BYTES = 16 << 20
WINDOW_BYTES = 1 << 20
#: So many boxes share a copy of the shards that answer them, so that what a task reads stays bounded.
BOXES = 256


def _windows(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The codes of the n-grams that end at each symbol (an edge symbol last) of the texts, in runs of whole texts or pieces of
    a long one: the run's first text, where each of its texts starts among the codes, and the codes."""
    data, offsets = raw(column)
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + WINDOW_BYTES, "right")) - 1
        last = min(max(last, first + 1), n)
        at = offsets[first : last + 1] - offsets[first]
        docs = np.arange(last - first)
        symbols = np.zeros(at[-1] + len(docs) * ORDER, np.int16)
        symbols[np.arange(at[-1]) + np.repeat(docs * ORDER + ORDER - 1, np.diff(at))] = LOWER[data[offsets[first] : offsets[last]]].astype(np.int16) + 1
        sizes = np.diff(at) + 1
        if len(docs) == 1:
            for lo in range(0, int(sizes[0]), WINDOW_BYTES):
                yield first, np.zeros(1, np.int64), _codes(symbols[lo : lo + WINDOW_BYTES + ORDER - 1])
        else:
            yield first, np.cumsum(sizes) - sizes, _codes(symbols)[np.arange(sizes.sum()) + np.repeat(docs * (ORDER - 1), sizes)]
        first = last


def _codes(symbols: np.ndarray) -> np.ndarray:
    code = np.zeros(len(symbols) - ORDER + 1, np.int64)
    for k in range(ORDER):
        code *= SYMBOLS
        code += symbols[k : k + len(code)]
    return code


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


def _summed(grams: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(grams, kind="stable")
    grams, n = grams[order], n[order]
    at = _runs(grams)
    return grams[at], np.add.reduceat(n, at) if len(at) else n


class _Counts:
    """A sum of sorted tables of counts, merged whenever what waits is as large as the sum."""

    def __init__(self) -> None:
        self.parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        self.waiting = 0

    def add(self, grams: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((grams, n))
        self.waiting += len(grams)
        if self.waiting > len(self.parts[0][0]) + (1 << 20):
            self.merged()

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            self.parts = [_summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))]
        self.waiting = 0
        return self.parts[0]


def _by_shard(grams: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of the sorted n-grams by shard, then n-gram, and (shard, start, end) of the shards present."""
    shard = (mix((grams // SYMBOLS % SYMBOLS**2).astype(U)) % U(SHARDS)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    at = _runs(shard[order])
    return order, [(int(shard[order[a]]), int(a), int(b)) for a, b in zip(at, np.r_[at, len(grams)][1:], strict=True)]


def _count(box: pa.Table, marks: pa.Table) -> pa.Table:
    """The n-grams of the texts at the marked places of a box, by shard."""
    counts, first = _Counts(), 0
    places = np.sort(np.concatenate([np.asarray(x.values) for x in marks.column("places")] or [np.zeros(0, np.int64)]))
    for b in _texts(box.column("payload")[0].as_py()):
        own = places[np.searchsorted(places, first) : np.searchsorted(places, first + b.num_rows)] - first
        first += b.num_rows
        for _, _, code in _windows(b.column("text").take(pa.array(own))):
            code = np.sort(code)
            at = _runs(code)
            counts.add(code[at], np.diff(at, append=len(code)))
    grams, n = counts.merged()
    order, cuts = _by_shard(grams)
    payloads = [pack(np.diff(grams[order[lo:hi]], prepend=0), n[order[lo:hi]]) for _, lo, hi in cuts]
    return pa.table({"shard": pa.array([s for s, _, _ in cuts], pa.int32()), "payload": pa.array(payloads, pa.binary())})


def _shorter(grams: np.ndarray, n: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of order symbols that end those of one more, with how many symbols precede them. Nothing precedes the
    start of a text, so n-grams from there keep their number."""
    short = grams % SYMBOLS**order
    return _summed(short, np.where(short // SYMBOLS ** (order - 1) == 0, n, 1))


def _levels(grams: np.ndarray, n: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The counts of a shard's n-grams of ORDER down to 3 symbols."""
    out = {ORDER: (grams, n)}
    for order in range(ORDER - 1, 2, -1):
        out[order] = _shorter(*out[order + 1], order)
    return out


def _merge(table: pa.Table) -> pa.Table:
    """A shard's counts, its numbers of n-grams that occur once to four times by level, and its share of the counts of pairs."""
    counts = _Counts()
    for payload in table.column("payload"):
        steps, n = unpack(payload.as_py())
        counts.add(np.cumsum(steps), n)
    grams, n = counts.merged()
    levels = _levels(grams, n)
    seen = [int((levels[k][1] == i).sum()) for k in range(3, ORDER + 1) for i in (1, 2, 3, 4)]
    return pa.table({"shard": table.column("shard")[:1], "payload": pa.array([pack(np.diff(grams, prepend=0), n)], pa.binary()), "seen": pa.array([seen], pa.list_(pa.int64())), "pairs": pa.array([pack(*_shorter(*levels[3], 2))], pa.binary())})


def _discounts(seen: np.ndarray) -> np.ndarray:
    """Discounts of counts 0, 1, 2, 3 and more, from the numbers of n-grams that occur once to four times."""
    n1, n2, n3, n4 = (float(x) for x in seen)
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    return np.array([0.0, *(min(max(i - (i + 1) * y * b / a, 0.05), i - 0.05) if a and b else 0.5 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))])


def _dense(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probabilities of a level in full: counts by context and symbol, over those of the level below."""
    d = _discounts([(counts == i).sum() for i in (1, 2, 3, 4)])[np.minimum(counts, 3)]
    total = counts.sum(axis=1, keepdims=True)
    return np.where(total > 0, (counts - d + d.sum(axis=1, keepdims=True) * lower) / np.maximum(total, 1), lower)


@dataclass
class Model:
    """shards: shard, payload (the n-grams of ORDER symbols and their counts). discounts: by level from 3 on. pairs: the
    probability of each symbol after each symbol."""

    shards: DataFrame
    discounts: dict[int, np.ndarray]
    pairs: np.ndarray


def learn(boxes: DataFrame, ids: DataFrame) -> Model:
    """The model of the boxed texts whose doc_id is in ids, each id once there. The ids of the texts move, not the texts."""
    places = boxes.select(F.col("box").alias("of"), F.posexplode("ids").alias("place", "doc_id")).join(small(ids), "doc_id")
    marks = places.groupBy("of").agg(F.collect_list(F.col("place").cast("long")).alias("places"))
    counted = boxes.select("box", "payload").groupBy("box").cogroup(marks.groupBy("of")).applyInArrow(_count, "shard int, payload binary")
    shards = durable(counted.groupBy("shard").applyInArrow(_merge, "shard int, payload binary, seen array<long>, pairs binary"))
    seen, pairs = np.zeros((ORDER - 2, 4), np.int64), np.zeros((SYMBOLS, SYMBOLS), np.int64)
    for r in shards.select("seen", "pairs").toLocalIterator():
        seen += np.array(r.seen).reshape(seen.shape)
        grams, n = unpack(bytes(r.pairs))
        pairs.ravel()[grams] += n
    single = _dense((pairs > 0).sum(axis=0, keepdims=True), np.full((1, SYMBOLS), 1.0 / SYMBOLS))
    return Model(shards.select("shard", "payload"), {k: _discounts(seen[k - 3]) for k in range(3, ORDER + 1)}, _dense(pairs, single))


def _find(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where each of x is among the sorted keys, len(keys) where it is not."""
    at = np.searchsorted(keys, x)
    hit = at < len(keys)
    hit[hit] = keys[at[hit]] == x[hit]
    return np.where(hit, at, len(keys))


def _probabilities(asked: np.ndarray, payload: bytes | None, discounts: dict[int, np.ndarray], pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The probability of the last symbol of each asked n-gram after the others, from the counts of their shard, and the same
    without one of the times that the n-gram occurs, if it does (the levels of one and two symbols stay as they are)."""
    steps, n = unpack(payload) if payload else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    levels, gone = [], np.ones(len(asked), bool)
    for order, (grams, n) in _levels(np.cumsum(steps), n).items():
        d = discounts[order][np.minimum(n, 3)]
        context = grams // SYMBOLS
        at = _runs(context)
        total, held = (np.add.reduceat(x, at) if len(at) else x for x in (n, d))
        x = asked % SYMBOLS**order
        here, around = _find(grams, x), _find(context[at], x // SYMBOLS)
        n, total, held = np.r_[n, 0][here], np.r_[total, 0][around], np.r_[held, 0.0][around]
        gone = gone & (n > 0)
        levels.append((order, n, total, held, gone))
        # A shorter n-gram loses one that precedes it if that is gone altogether, one from the start of a text loses its own.
        gone = gone & ((n == 1) | (x % SYMBOLS ** (order - 1) // SYMBOLS ** (order - 2) == 0))
    p = left = pairs[asked // SYMBOLS % SYMBOLS, asked % SYMBOLS]
    for order, n, total, held, gone in reversed(levels):
        d, less = (discounts[order][np.minimum(x, 3)] for x in (n, n - gone))
        p = np.where(total > 0, (n - d + held * p) / np.maximum(total, 1), p)
        left = np.where(total > gone, (n - gone - less + (held - d + less) * left) / np.maximum(total - gone, 1), left)
    return p, left


def train(trusted: DataFrame) -> np.ndarray:
    """log2 probability of each symbol (SYMBOLS of them) after each context of ORDER - 1 symbols that occurs, in one array: a
    view of the model for small texts. trusted: text."""
    spark = trusted.sparkSession
    rows = trusted.select(F.lit(0).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit("").alias("lang"))
    with temporary(spark), _boxed(rows) as boxes:
        model = learn(boxes, spark.range(1).toDF("doc_id"))
        out = []
        for r in model.shards.orderBy("shard").collect():
            contexts = distinct(np.cumsum(unpack(bytes(r.payload))[0]) // SYMBOLS)
            out.append(_probabilities((contexts[:, None] * SYMBOLS + np.arange(SYMBOLS)).ravel(), bytes(r.payload), model.discounts, model.pairs)[0])
    return np.log2(np.concatenate(out)).astype(np.float32) if out else np.zeros(0, np.float32)


@returning
def _boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about BOX_BYTES of text, or one longer row, as compressed Arrow streams with a number each, and their ids."""
    held, size, number = [], 0, TaskContext.get().partitionId() << 32

    def box() -> pa.RecordBatch:
        out = io.BytesIO()
        with pa.ipc.new_stream(out, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as stream:
            for b in held:
                stream.write_batch(b)
        ids = [x for b in held for x in b.column("doc_id").to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([out.getvalue()], pa.binary()), pa.array([ids], pa.list_(pa.int64()))], ["box", "payload", "ids"])

    for b in batches:
        weight = raw(b.column("text"))[1] + 64 * np.arange(b.num_rows + 1)
        lo = 0
        while lo < b.num_rows:
            hi = min(max(int(np.searchsorted(weight, weight[lo] + BOX_BYTES - size, "right")) - 1, lo + 1), b.num_rows)
            held.append(b.slice(lo, hi - lo))
            size += int(weight[hi] - weight[lo])
            lo = hi
            if size >= BOX_BYTES:
                yield box()
                held, size, number = [], 0, number + 1
    if held:
        yield box()


def _wanted(texts: list[pa.RecordBatch]) -> np.ndarray:
    """The distinct n-grams of a box, in order."""
    known, new = np.zeros(0, np.int64), []
    for b in texts:
        for _, _, code in _windows(b.column("text")):
            new.append(distinct(code))
            if sum(map(len, new)) > len(known) + (1 << 20):
                known, new = distinct(np.concatenate([known, *new])), []
    return distinct(np.concatenate([known, *new]))


def _texts(payload: bytes) -> list[pa.RecordBatch]:
    return list(pa.ipc.open_stream(payload))


@returning
def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for box, payload in zip(b.column("box"), b.column("payload"), strict=True):
            grams = _wanted(_texts(payload.as_py()))
            order, cuts = _by_shard(grams)
            payloads = [pack(np.diff(grams[order[lo:hi]], prepend=0)) for _, lo, hi in cuts]
            yield pa.RecordBatch.from_arrays([pa.array([box.as_py()] * len(cuts), pa.int64()), pa.array([s for s, _, _ in cuts], pa.int32()), pa.array(payloads, pa.binary())], ["box", "shard", "payload"])


def _answer(model) -> Callable:
    def run(asked: pa.Table, shard: pa.Table) -> pa.Table:
        each = [np.cumsum(unpack(x.as_py())[0]) for x in asked.column("payload")]
        grams = distinct(np.concatenate(each)) if each else np.zeros(0, np.int64)
        logs, left = (np.log2(p) for p in _probabilities(grams, shard.column("payload")[0].as_py() if len(shard) else None, *model.value))
        logs, less = logs.astype(np.float32), (left - logs).astype(np.float32)
        places = [np.searchsorted(grams, x) for x in each]
        return pa.table({"box": asked.column("box"), "shard": asked.column("shard"), "payload": pa.array([pack(logs[i], less[i]) for i in places], pa.binary())})

    return run


def _score(box: pa.Table, answers: pa.Table) -> pa.Table:
    texts = _texts(box.column("payload")[0].as_py())
    grams = _wanted(texts)
    order, cuts = _by_shard(grams)
    by_shard = dict(zip(answers.column("shard").to_pylist(), answers.column("payload"), strict=True))
    logs = np.zeros((2, len(grams)), np.float32)
    for shard, lo, hi in cuts:
        logs[:, order[lo:hi]] = unpack(by_shard[shard].as_py())
    find = pd.Index(grams)
    out = []
    for b in texts:
        n_bytes, sums = np.diff(raw(b.column("text"))[1]), np.zeros((2, b.num_rows))
        for first, starts, code in _windows(b.column("text")):
            sums[:, first : first + len(starts)] += np.add.reduceat(logs[:, find.get_indexer(code)].astype(np.float64), starts, axis=1)
        seen, unseen = np.exp2(-np.array([sums[0], sums[0] + sums[1]]) / (n_bytes + 1))
        out.append(pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array(n_bytes), pa.array(seen), pa.array(unseen)], ["doc_id", "lang", "n_bytes", "perplexity", "left_out"]))
    return pa.Table.from_batches(out)


@contextmanager
def _boxed(rows: DataFrame) -> Iterator[DataFrame]:
    """box, payload, ids: rows (doc_id, text, lang) in boxes, written in buckets. They can't be read afterwards."""
    # Boxes are few and large, so with four buckets a partition not many meet in one by chance.
    buckets = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    boxes = bucketed(rows.mapInArrow(_boxes, "box long, payload binary, ids array<long>"), "box", buckets)
    try:
        yield boxes
    finally:
        unlist(boxes)


def _perplexities(boxes: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, left_out (what the perplexity were without one of the times that each n-gram occurs in
    trusted texts) of the boxed rows, written."""
    copies = -(-boxes.count() // BOXES) or 1
    boxes = boxes.select("box", "payload")
    asked = boxes.mapInArrow(_ask, "box long, shard int, payload binary").withColumn("copy", F.pmod(F.hash("box"), F.lit(copies)))
    shards = model.shards.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    shared = boxes.sparkSession.sparkContext.broadcast((model.discounts, model.pairs))
    answers = asked.groupBy("shard", "copy").cogroup(shards.groupBy("shard", "copy")).applyInArrow(_answer(shared), "box long, shard int, payload binary")
    return durable(boxes.groupBy("box").cogroup(answers.groupBy("box")).applyInArrow(_score, "doc_id long, lang string, n_bytes long, perplexity double, left_out double"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """One row per row of docs (doc_id, text, lang; others are ignored): doc_id, lang, n_bytes, perplexity, threshold, kept.

    Trusted are the documents that labels (doc_id, quality) give quality 1 and not 0. A null or empty text has only the
    edge symbol; null is a language of its own. Without trusted text the model is uniform and everything is kept.
    """
    ids = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    # All of them train the model and set the limits. They are marked by id, in boxes and among scored rows, so no texts are
    # shuffled however many ids there are.
    with temporary(docs.sparkSession) as keep:
        ids = keep(durable(ids))
        with _boxed(rows) as boxes:
            scored = keep(_perplexities(boxes, learn(boxes, ids)))
    scored = scored.join(small(ids.withColumn("trusted", F.lit(True))), "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    own = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000))
    limits = scored.groupBy("lang").agg(F.coalesce(F.percentile_approx(F.when(F.col("trusted"), F.col("left_out")), F.lit(quantile), F.lit(10_000)), own).alias("threshold"))
    limits = limits.select(F.col("lang").alias("of"), (F.col("threshold") * SLACK).alias("threshold"))
    return scored.join(limits, F.col("lang").eqNullSafe(F.col("of"))).select("doc_id", "lang", "n_bytes", "perplexity", "threshold", (F.col("perplexity") <= F.col("threshold")).alias("kept"))
