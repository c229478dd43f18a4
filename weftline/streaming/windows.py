"""Event-time windows over streams: the streaming form of tumbling and sliding buckets, and of first edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, ts: str, keys: list[str], size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """start, keys, n of each window; rows later than the watermark are dropped."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def recent_pairs(edges: DataFrame, delta: str, late: str = "10 minutes") -> DataFrame:
    """Two-edge temporal paths (src, mid, dst, t1, t2) within delta on a stream of src, dst, ts, by a bounded self-join."""
    a = edges.select(F.col("src"), F.col("dst").alias("mid"), F.col("ts").alias("t1")).withWatermark("t1", late)
    b = edges.select(F.col("src").alias("_mid"), F.col("dst"), F.col("ts").alias("t2")).withWatermark("t2", late)
    return a.join(b, F.expr(f"mid = _mid and t2 > t1 and t2 <= t1 + interval {delta} and src != dst")).drop("_mid")
