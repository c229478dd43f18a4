"""Substring deduplication with a log-structured index of window fingerprints.

A window is WINDOW consecutive words. Its fingerprint is the smallest hash among its GRAM-word runs, so equal windows
have equal fingerprints, and about one word in twenty starts a new one. FingerprintIndex takes documents batch by batch:
each batch becomes an immutable run of (fingerprint, doc_id) sorted by fingerprint, which is merge-joined with the runs
before it; when there are more than FAN_IN runs they are compacted into one. What the index gives are the fingerprints
that several documents share. Those documents are read again and verified window by window.

In verification a segment is a maximal row of windows with the same fingerprint. Segments with equal contents collapse
first, to the smallest doc_id; only where a fingerprint has several contents are their windows compared one by one. So
a passage in a third of all documents costs a row a document, summed on the map side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.blocks import Block, U, blocks, mix, spans_hash
from weftline.llm.scratch import durable, temporary

WINDOW = 50
GRAM = 10
FAN_IN = 2
BATCHES = 3


def _fingerprints(block: Block, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint of the window at each word, and whether a whole window starts there in the same document."""
    n = len(block.hashes)
    valid = np.arange(n) + window <= np.repeat(block.first_word[1:], block.n_words)
    if n < window:
        return np.zeros(n, U), valid
    at = np.arange(n - gram + 1)
    least = spans_hash(block.hashes, at, at + gram)
    width, goal = 1, window - gram + 1
    while width * 2 <= goal:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < goal:
        least = np.minimum(least[: len(least) - (goal - width)], least[goal - width :])
    return np.r_[least, np.zeros(n - len(least), U)], valid


def _changes(doc: np.ndarray, fp: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Where a new row of used windows with one document and one fingerprint begins."""
    new = used.copy()
    new[1:] &= ~used[:-1] | (doc[1:] != doc[:-1]) | (fp[1:] != fp[:-1])
    return np.flatnonzero(new)


def _index_rows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            for block in blocks(b.column("text"), lower=False):
                fp, valid = _fingerprints(block, window, gram)
                doc = block.word_doc()
                i = _changes(doc, fp, valid)
                yield pa.RecordBatch.from_arrays([pa.array(fp[i].view(np.int64)), pa.array(ids[block.first + doc[i]])], ["fp", "doc_id"])

    return run


class FingerprintIndex:
    """Sorted immutable runs of the fingerprints of all documents taken so far."""

    def __init__(self, spark: SparkSession, window: int = WINDOW, gram: int = GRAM, fan_in: int = FAN_IN):
        self.spark, self.window, self.gram, self.fan_in = spark, window, gram, fan_in
        self.runs: list[DataFrame] = []
        self.found: list[DataFrame] = []

    def ingest(self, docs: DataFrame) -> None:
        """Take docs (doc_id, text): write their run, note the fingerprints they share with each other or with history."""
        rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        rows = rows.mapInArrow(_index_rows(self.window, self.gram), "fp long, doc_id long").distinct()
        run = durable(rows.repartition("fp").sortWithinPartitions("fp", "doc_id"))
        # A row for each fingerprint and run is joined, whatever the number of documents that have it.
        spread = lambda df, lo, hi: df.groupBy("fp").agg(F.min("doc_id").alias(lo), F.max("doc_id").alias(hi))
        new = spread(run, "lo", "hi")
        shared = new.where("lo < hi").select("fp")
        for old in self.runs:
            both = new.join(spread(old, "old_lo", "old_hi"), "fp")
            shared = shared.unionByName(both.where("least(lo, old_lo) < greatest(hi, old_hi)").select("fp"))
        self.found.append(durable(shared.distinct()))
        self.runs.append(run)
        if len(self.runs) > self.fan_in:
            self.compact()

    def compact(self) -> None:
        """Merge all runs into one."""
        merged = reduce(DataFrame.unionByName, self.runs).distinct()
        self.runs = [durable(merged.repartition("fp").sortWithinPartitions("fp", "doc_id"))]

    def candidates(self) -> DataFrame:
        """doc_id and fps: the shared fingerprints of each document that has some."""
        shared = reduce(DataFrame.unionByName, self.found).distinct()
        rows = reduce(DataFrame.unionByName, self.runs).join(shared, "fp")
        return rows.groupBy("doc_id").agg(F.collect_list("fp").alias("fps"))


def _segments(window: int, gram: int):
    """Rows of windows with a shared fingerprint: doc_id, t, start, fp, n, digest and the hash of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, t, fps = b.column("doc_id").to_numpy(), b.column("t").to_numpy(), b.column("fps")
            sizes = np.diff(fps.offsets.to_numpy())
            flat = fps.flatten().to_numpy().view(U)
            first = np.r_[0, np.cumsum(sizes)]
            for block in blocks(b.column("text"), lower=False):
                fp, valid = _fingerprints(block, window, gram)
                doc = block.word_doc()
                lo, hi = first[block.first], first[block.first + block.n]
                wanted = mix(flat[lo:hi] ^ mix(np.repeat(np.arange(block.n), sizes[block.first : block.first + block.n]).astype(U)))
                used = valid & np.isin(mix(fp ^ mix(doc.astype(U))), wanted, kind="sort")
                i = _changes(doc, fp, used)
                if not len(i):
                    continue
                at = np.flatnonzero(used)
                h = spans_hash(block.hashes, at, at + window)
                cuts = np.r_[np.searchsorted(at, i), len(at)]
                digest = spans_hash(h, cuts[:-1], cuts[1:])
                d = doc[i]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[block.first + d]), pa.array(t[block.first + d]), pa.array(i - block.first_word[d]), pa.array(fp[i].view(np.int64)), pa.array(np.diff(cuts)), pa.array(digest.view(np.int64)), pa.ListArray.from_arrays(cuts.astype(np.int32), h.view(np.int64))],
                    ["doc_id", "t", "start", "fp", "n", "digest", "windows"],
                )

    return run


def _removed(window: int, texts_too: bool):
    """doc_id, n_words, n_removed and the kept text, from the text and its spans of repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column("spans").to_pylist()
            total, gone, sums, kept = [], [], [], []
            for block in blocks(b.column("text"), lower=False):
                data = block.data.tobytes()
                for k in range(block.n):
                    lo, hi = int(block.first_word[k]), int(block.first_word[k + 1])
                    step = np.zeros(hi - lo + 1, np.int64)
                    for s in spans[block.first + k] or ():
                        step[s["start"]] += 1
                        step[min(s["start"] + s["n"] - 1 + window, hi - lo)] -= 1
                    keep = np.cumsum(step)[:-1] == 0
                    if keep.all():
                        text = data[int(block.offsets[k]) : int(block.offsets[k + 1])].translate(_TO_SPACE)
                        words = b" ".join(filter(None, text.split(b" ")))
                    else:
                        words = b" ".join(data[s:e] for s, e in zip(block.starts[lo:hi][keep].tolist(), block.ends[lo:hi][keep].tolist(), strict=True))
                    total.append(hi - lo)
                    gone.append(int((~keep).sum()))
                    sums.append(hashlib.sha256(words).hexdigest())
                    if texts_too:
                        kept.append(words)
            arrays = [b.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sums, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if texts_too:
                arrays.append(pa.array(kept, pa.binary()).cast(pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


#: The separators other than the space become spaces.
_TO_SPACE = bytes(0x20 if 0x09 <= i <= 0x0D else i for i in range(256))


def repeated_spans(docs: DataFrame, index: FingerprintIndex) -> DataFrame:
    """doc_id, t (hash of the text), spans (start, n): the windows of each document that also start in a smaller doc_id.

    docs has to hold all documents that the index took.
    """
    wanted = durable(index.candidates())
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, t long, start long, fp long, n long, digest long, windows array<long>"
    segments = durable(rows.join(wanted, "doc_id").select("doc_id", "t", "text", "fps").mapInArrow(_segments(index.window, index.gram), schema))
    contents = durable(segments.groupBy("fp", "digest").agg(F.min("doc_id").alias("least"), F.first("windows").alias("windows")))
    several = contents.groupBy("fp").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("fp")
    windows = contents.join(several, "fp").select("fp", "digest", "least", F.posexplode("windows").alias("pos", "h"))
    lower = windows.groupBy("fp", "h").agg(F.min("least").alias("lowest"), F.max("least").alias("highest")).where("lowest < highest").select("fp", "h", "lowest")
    # Of the document a content is least in, single windows may be in a smaller one; all others repeat the whole content.
    partly = windows.join(durable(lower), ["fp", "h"]).where("lowest < least").select("fp", "digest", "least", "pos")
    whole = segments.select("doc_id", "t", "start", "n", "fp", "digest").join(contents.select("fp", "digest", "least"), ["fp", "digest"])
    whole = durable(whole)
    spans = whole.where("doc_id > least").select("doc_id", "t", "start", "n")
    own = whole.where("doc_id = least").select("fp", "digest", "doc_id", "t", "start").join(partly.drop("least"), ["fp", "digest"])
    spans = spans.unionByName(own.select("doc_id", "t", (F.col("start") + F.col("pos")).alias("start"), F.lit(1).cast("long").alias("n")))
    return spans.groupBy("doc_id", "t").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def substring_dedup(docs: DataFrame, index: FingerprintIndex | None = None, batches: int = BATCHES, texts: bool = True) -> DataFrame:
    """One row per row of docs (doc_id, text; others are ignored): doc_id, n_words, n_removed, kept_sha256, and with texts kept_text.

    Words are kept as they are and joined by one space. A word goes if a window covers it whose words also start in a
    document with a smaller doc_id, as the input has it; repetition within a document, or between rows with the same
    doc_id, doesn't count. A null text has no words; rows with a null doc_id stay whole. Without an index of these
    documents, one is made in batches of rising doc_id.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), F.col("text").cast("string").alias("text"))
    with temporary(spark) as keep:
        if index is None:
            index = FingerprintIndex(spark)
            lo, hi = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
            if lo is not None:
                cuts = [lo + (hi + 1 - lo) * i // batches for i in range(batches + 1)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if a < b:
                        index.ingest(docs.where((F.col("doc_id") >= a) & (F.col("doc_id") < b)))
        if index.runs:
            rows = rows.join(keep(durable(repeated_spans(docs, index))), ["doc_id", "t"], "left").select("doc_id", "text", "spans")
        else:
            rows = rows.select("doc_id", "text", F.expr("cast(null as array<struct<start: bigint, n: bigint>>)").alias("spans"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts
    return rows.mapInArrow(_removed(index.window, texts), schema)
