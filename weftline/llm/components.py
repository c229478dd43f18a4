"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.blocks import returning
from weftline.llm.scratch import durable

#: Edges that a task joins in memory, on average, before the stars.
TASK_EDGES = 100_000


@returning
def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's edges: each node but the smallest of its component, with the smallest. Nodes are longs or structs of
    longs, without nulls."""
    kind, parts = None, []
    for b in batches:
        kind = b.column("v").type
        parts.append([_longs(b.column(c)) for c in ("v", "m")])
    if kind is None:
        return
    both = np.concatenate([np.concatenate(x) for x in zip(*parts, strict=True)])
    del parts
    nodes, at = _numbered(both)
    v, m = at[: len(at) // 2], at[len(at) // 2 :]
    root = np.arange(len(nodes))
    while True:  # numbers follow the order of the nodes, so the smallest number is the smallest node
        low = root.copy()
        np.minimum.at(low, root[v], root[m])
        np.minimum.at(low, root[m], root[v])
        low = low[low[root]]
        if (low == root).all():
            break
        root = low
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    for lo in range(0, len(moved), 50_000):
        some = moved[lo : lo + 50_000]
        yield pa.RecordBatch.from_arrays([_column(nodes[some], kind), _column(nodes[root[some]], kind)], ["v", "m"])


def _longs(column: pa.Array) -> np.ndarray:
    """One row of longs per node."""
    fields = column.flatten() if pa.types.is_struct(column.type) else [column]
    return np.stack([x.to_numpy() for x in fields], axis=1)


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows in order, and the number of each row among them."""
    order = np.lexsort(x.T[::-1])
    ranked = x[order]
    new = np.r_[True, (ranked[1:] != ranked[:-1]).any(axis=1)]
    at = np.empty(len(x), np.int64)
    at[order] = np.cumsum(new) - 1
    return ranked[new], at


def _column(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    if not pa.types.is_struct(kind):
        return pa.array(x[:, 0], kind)
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x[:, i])) for i in range(kind.num_fields)], fields=list(kind))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges: a, b (longs or structs of longs). Returns node, root: the smallest node it can reach.

    Nodes without edges don't occur in the result. Tasks first join about TASK_EDGES edges each in memory, which leaves
    a forest of stars; one task's are final. Each round then is two aggregations with map-side minima and two joins,
    written to the shared folder; paths shrink by half or more in a round. No node reaches the driver.
    """
    stars = durable(edges.where("a != b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct())
    tasks = max(1, -(-stars.count() // TASK_EDGES))
    stars = durable(stars.coalesce(tasks).mapInArrow(_forest, stars.schema))
    for _ in range(max_rounds):
        if tasks == 1:
            break
        both = stars.select(F.col("v").alias("u"), F.col("m").alias("x")).unionByName(stars.select(F.col("m").alias("u"), F.col("v").alias("x")))
        low = durable(both.groupBy("u").agg(F.min("x").alias("low")))
        # Large star: every larger neighbour of u goes to the smallest node around u.
        large = both.where("x > u").join(low, "u").select(F.col("x").alias("v"), F.least("u", "low").alias("m"))
        large = durable(large.where("v != m").distinct())
        # Small star: u and its smaller neighbours go to the smallest of them.
        least = durable(large.groupBy(F.col("v").alias("u")).agg(F.min("m").alias("low"), F.count(F.lit(1)).alias("n")))
        small = large.join(least.where("n > 1"), F.col("v") == F.col("u")).select(F.col("m").alias("v"), F.col("low").alias("m"))
        stars = durable(small.where("v != m").unionByName(least.select(F.col("u").alias("v"), F.col("low").alias("m"))).distinct())
        # Done when every node has one star and no centre is in another one.
        twice = stars.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if twice.isEmpty() and stars.select("m").join(stars.select(F.col("v").alias("m")), "m", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError(f"the components are not settled after {max_rounds} rounds")
    roots = stars.select(F.col("m").alias("node")).distinct().withColumn("root", F.col("node"))
    return durable(stars.select(F.col("v").alias("node"), F.col("m").alias("root")).unionByName(roots))
