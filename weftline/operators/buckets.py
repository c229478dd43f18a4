"""Time buckets: tumbling, sliding, growing and given intervals, and series over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.order import numbered


def tumbling(df: DataFrame, value: str, start: int, end: int, jump: int) -> DataFrame:
    """Rows in [start, end] with bucket = (value - start) div jump."""
    return df.where(F.col(value).between(start, end)).withColumn("bucket", F.floor((F.col(value) - start) / jump).cast("long"))


def sliding(df: DataFrame, value: str, start: int, end: int, size: int, jump: int) -> DataFrame:
    """Each row once for every bucket [start + b * jump, start + b * jump + size) it is in."""
    off = F.col(value) - start
    first = F.greatest(F.floor((off - size) / jump) + 1, F.lit(0)).cast("long")
    return df.where(F.col(value).between(start, end)).withColumn("bucket", F.explode(F.sequence(first, F.floor(off / jump).cast("long"))))


def expanding(df: DataFrame, value: str, start: int, end: int, size: int) -> DataFrame:
    """Bucket b holds all rows from start to the end of the b-th interval."""
    last = (end - start) // size
    return df.where(F.col(value).between(start, end)).withColumn("bucket", F.explode(F.sequence(F.floor((F.col(value) - start) / size).cast("long"), F.lit(last).cast("long"))))


def intervals(df: DataFrame, value: str, bounds: list[tuple[int, int]]) -> DataFrame:
    """Each row with the number of every given interval [a, b) it is in."""
    hits = F.filter(F.array(*[F.when((F.col(value) >= a) & (F.col(value) < b), F.lit(i)) for i, (a, b) in enumerate(bounds)]), lambda x: x.isNotNull())
    return df.withColumn("bucket", F.explode(hits))


#: Seconds of the units that all have the same length.
UNITS = {"sec": 1, "min": 60, "10min": 600, "15min": 900, "30min": 1800, "1h": 3600, "2h": 7200, "4h": 14400, "6h": 21600, "12h": 43200, "day": 86400}


def unit_start(seconds: Column, unit: str) -> Column:
    """Start, in epoch seconds, of the unit that holds the time; weeks begin on Sunday, months and years as in the calendar."""
    if unit in UNITS:
        return F.floor(seconds / UNITS[unit]).cast("long") * UNITS[unit]
    if unit == "week":  # the epoch's day was a Thursday
        return (F.floor((seconds + 4 * 86400) / 604800).cast("long") * 604800) - 4 * 86400
    return F.unix_timestamp(F.date_trunc(unit, F.timestamp_seconds(seconds)))


def by_count(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Buckets of so many rows in the given order."""
    return numbered(df, order, "bucket").withColumn("bucket", F.floor(F.col("bucket") / size).cast("long"))


def first_edges(edges: DataFrame) -> DataFrame:
    """src, dst and the first time of each pair."""
    return edges.groupBy("src", "dst").agg(F.min("t").alias("t"))


def node_times(edges: DataFrame) -> DataFrame:
    """node and the time of its first edge."""
    return edges.select(F.col("src").alias("node"), "t").union(edges.select("dst", "t")).groupBy("node").agg(F.min("t").alias("t"))


def snapshot(edges: DataFrame, until: int) -> DataFrame:
    return edges.where(F.col("t") <= until)


def growth(edges: DataFrame, unit: str = "day") -> DataFrame:
    """bucket, new and cumulative nodes and distinct edges, average degree."""
    e = first_edges(edges).groupBy(unit_start(F.col("t"), unit).alias("bucket")).agg(F.count(F.lit(1)).alias("new_edges"))
    n = node_times(edges).groupBy(unit_start(F.col("t"), unit).alias("bucket")).agg(F.count(F.lit(1)).alias("new_nodes"))
    both = e.join(n, "bucket", "full").na.fill(0, ["new_edges", "new_nodes"])
    w = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("edges", F.sum("new_edges").over(w)).withColumn("nodes", F.sum("new_nodes").over(w))
    return both.withColumn("degree", 2 * F.col("edges") / F.col("nodes"))


def closing_edges(edges: DataFrame) -> DataFrame:
    """a < b and t of the first edges of pairs that had a common neighbour before, undirected."""
    first = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "t").where("a != b").groupBy("a", "b").agg(F.min("t").alias("t"))
    both = first.select(F.col("a").alias("x"), F.col("b").alias("y"), "t").union(first.select("b", "a", "t"))
    wedge = both.select("x", F.col("y").alias("a"), F.col("t").alias("t1")).join(both.select("x", F.col("y").alias("b"), F.col("t").alias("t2")), "x").where("a < b").groupBy("a", "b").agg(F.min(F.greatest("t1", "t2")).alias("ready"))
    return first.join(wedge, ["a", "b"]).where("ready < t").select("a", "b", "t")


def per_bucket(edges: DataFrame, bucket: str = "bucket") -> DataFrame:
    """A row for each bucket with edges: nodes, edges and distinct edges of its graph."""
    ends = edges.select(bucket, F.col("src").alias("node")).union(edges.select(bucket, "dst")).groupBy(bucket).agg(F.countDistinct("node").alias("nodes"))
    own = edges.groupBy(bucket, "src", "dst").agg(F.count(F.lit(1)).alias("n")).groupBy(bucket).agg(F.sum("n").alias("edges"), F.count(F.lit(1)).alias("pairs"))
    return own.join(ends, bucket)


def graph_sequence(edges: DataFrame, bucket: str = "bucket") -> DataFrame:
    """The graphs of all buckets as one whose nodes are structs (bucket, id), for algorithms that work node by node."""
    return edges.select(F.struct(F.col(bucket).alias("bucket"), F.col("src").alias("id")).alias("src"), F.struct(F.col(bucket).alias("bucket"), F.col("dst").alias("id")).alias("dst"))


def ranks_in_sequence(edges: DataFrame, iterations: int = 10, damping: float = 0.85, bucket: str = "bucket") -> DataFrame:
    """bucket, id, rank: PageRank in the graph of each bucket, all buckets in the same rounds."""
    from weftline.plans.densest import cut_lineage

    e = edges.select(bucket, "src", "dst").distinct()
    e = cut_lineage(e.join(e.groupBy(bucket, "src").agg(F.count(F.lit(1)).alias("o")), [bucket, "src"]))
    nodes = e.select(bucket, F.col("src").alias("id")).union(e.select(bucket, "dst")).distinct()
    sizes = nodes.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))
    rank = cut_lineage(nodes.join(sizes, bucket).select(bucket, "id", "n", (1 / F.col("n")).alias("rank")))
    for _ in range(iterations):
        got = e.join(rank.select(bucket, F.col("id").alias("src"), "rank"), [bucket, "src"]).groupBy(bucket, F.col("dst").alias("id")).agg((damping * F.sum(F.col("rank") / F.col("o"))).alias("got"))
        new = rank.select(bucket, "id", "n").join(got, [bucket, "id"], "left").na.fill(0.0, ["got"])
        new = cut_lineage(new)
        leak = new.groupBy(bucket).agg(((1 - F.sum("got")) / F.first("n")).alias("leak"))
        rank = cut_lineage(new.join(leak, bucket).select(bucket, "id", "n", (F.col("got") + F.col("leak")).alias("rank")))
    return rank.select(bucket, "id", "rank")
