"""Exact deduplication by a distributed most-significant-digit radix partition of the texts.

A digit is a run of successive characters: the first LEVELS[0] of them, then the next LEVELS[1], and so on, each level
eight times as wide. Every level splits each open group by its next digit. A group of one row, or one whose texts have
ended, is settled; only the rest of the others' texts goes on. Groups are told apart by the digits themselves, so
equality needs no digest (text_sha256 is only an output).

Scale: a level is one aggregation (with map-side sums, so a group with a third of all rows costs a row per map task)
and one join of rows with their group, which adaptive execution can split where a group is hot. Few rows pass the
first level, and a text of L characters is settled within log8(L) levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.scratch import discard, durable

FIRST_DIGIT = 128
WIDER = 8
#: Stands for a null doc_id: smaller than any other.
_NONE = -(2**63)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _settle(rows: DataFrame, first_digit: int, wider: int, normal: Column, keep_text: bool) -> DataFrame:
    """rows: uid, doc_id, text, payload, from durable(), and deleted here. normal: the normalised digit, made from the column raw_digit.

    Returns uid, doc_id, payload, n (rows of the group) and best (struct d, uid: the row that stays), of all rows with a
    null text, or with keep_text of the rows that stay, with their texts.
    """
    open_rows, start, width, settled = rows.withColumn("gid", F.lit(0).cast("long")), 1, first_digit, None
    while True:
        state = open_rows.withColumn("raw_digit", F.coalesce(F.expr(f"substring(text, {start}, {width})"), F.lit(""))).withColumn("digit", normal).drop("raw_digit")
        best = F.max(F.struct(F.coalesce("doc_id", F.lit(_NONE)).alias("d"), "uid"))
        # Written, so that the join below has two plain exchanges and a hot group's rows can be split.
        groups = durable(state.groupBy("gid", "digit").agg(F.count(F.lit(1)).alias("n"), best.alias("best")).where("n > 1"))
        done = F.col("n").isNull() | (F.length("digit") < width)
        own = F.struct(F.coalesce("doc_id", F.lit(_NONE)).alias("d"), "uid")
        text = F.col("text") if keep_text else F.when(~done, F.col("text"))
        level = durable(state.join(groups, ["gid", "digit"], "left").select("uid", "doc_id", text.alias("text"), "payload", F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("best", own).alias("best"), done.alias("done")).where(F.lit(not keep_text) | ~F.col("done") | (F.col("uid") == F.col("best.uid"))))
        discard(rows.sparkSession, groups, *([rows] if start == 1 else []))
        ended = level.where("done").drop("done")
        settled = ended if settled is None else settled.unionByName(ended)
        open_rows = level.where("not done").select("uid", "doc_id", "text", "payload", F.col("best.uid").alias("gid"))
        if open_rows.isEmpty():
            return settled
        start, width = start + width, width * wider


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text with A-Z lower-cased (bytes.lower() touches ASCII only); its SHA-256 is the payload."""
    for b in batches:
        texts = [(x or "").encode().lower() for x in b.column("text").to_pylist()]
        digests = [hashlib.sha256(x).hexdigest() for x in texts]
        yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(digests, pa.string())], ["uid", "doc_id", "text", "payload"])


def exact_duplicates(docs: DataFrame, first_digit: int = FIRST_DIGIT, wider: int = WIDER) -> DataFrame:
    """One row per row of docs (doc_id long, text string; other columns are ignored):
    doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the row with the largest doc_id is kept; a
    null doc_id is smaller than any other, and of repeated rows with the same doc_id one is kept. Null and empty texts
    are equal to each other. An empty table gives an empty result.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = durable(rows.mapInArrow(_normalised, "uid long, doc_id long, text string, payload string"))
    return _settle(rows, first_digit, wider, F.col("raw_digit"), False).select(
        "doc_id",
        F.when(F.col("best.d") != _NONE, F.col("best.d")).alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("uid") == F.col("best.uid")).alias("kept"),
        F.col("payload").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, first_digit: int = FIRST_DIGIT, wider: int = WIDER) -> DataFrame:
    """The rows of docs that exact_duplicates keeps, with all columns as they were, whatever their names.

    Nulls, empty texts, ties, repeated rows and an empty table are treated as there.
    """
    others = [c for c in docs.columns if c != "text"]
    rows = durable(docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*[F.col(f"`{c}`") for c in others]).alias("payload")))
    settled = _settle(rows, first_digit, wider, F.translate("raw_digit", _UPPER, _LOWER), True)
    return settled.select(*[F.col("text") if c == "text" else F.col(f"payload.`{c}`").alias(c) for c in docs.columns])
