"""Singular values and vectors, eigenpairs and participation ratios of adjacency matrices, by subspace iteration.

A block of k vectors is a table (id, v0, v1, ...). Each round multiplies it by the matrix (a join on the edges and sums by
node) and makes it orthonormal by the k x k matrix of its inner products, the only numbers that reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.graph import nodes_of, symmetric
from weftline.plans.densest import cut_lineage


#: Directions beyond the ones asked for, which make the iteration settle sooner.
SPARE = 8


def _names(k: int) -> list[str]:
    return [f"v{i}" for i in range(k)]


def _start(nodes: DataFrame, k: int, seed: int) -> DataFrame:
    """k columns of values in [-1, 1) that depend on the node and the seed alone."""
    draw = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.lit(i), "id"), F.lit(1 << 30)) / float(1 << 29) - 1
    return nodes.select("id", *[draw(i).alias(x) for i, x in enumerate(_names(k))])


def _times(edges: DataFrame, block: DataFrame, to: str, k: int) -> DataFrame:
    """The block after one multiplication: each node of column to gets the sum over the other ends of its edges."""
    other = "dst" if to == "src" else "src"
    met = edges.join(block.withColumnRenamed("id", other), other)
    return met.groupBy(F.col(to).alias("id")).agg(*[F.sum(x).alias(x) for x in _names(k)])


def _inner(block: DataFrame, k: int, other: DataFrame | None = None) -> np.ndarray:
    """The k x k inner products of a block with itself, or with another over the nodes of both."""
    both = block if other is None else block.join(other.select("id", *[F.col(x).alias(f"o{x}") for x in _names(k)]), "id")
    right = _names(k) if other is None else [f"o{x}" for x in _names(k)]
    row = both.agg(*[F.coalesce(F.sum(F.col(x) * F.col(y)), F.lit(0.0)) for x in _names(k) for y in right]).first()
    return np.array(row, float).reshape(k, k)


def _turned(block: DataFrame, matrix: np.ndarray) -> DataFrame:
    """The block times a small matrix."""
    parts = [sum((F.col(x) * float(c) for x, c in zip(_names(len(matrix)), column, strict=True)), F.lit(0.0)) for column in np.asarray(matrix).T]
    return block.select("id", *[p.alias(f"v{i}") for i, p in enumerate(parts)])


def _orthonormal(block: DataFrame, k: int) -> tuple[DataFrame, int]:
    """An orthonormal basis of what the block spans, and its size."""
    size, axes = np.linalg.eigh(_inner(block, k))
    use = size > max(size.max(), 0.0) * 1e-14
    return _turned(block, axes[:, use] / np.sqrt(size[use])), int(use.sum())


def _pairs_of(edges: DataFrame, k: int) -> DataFrame:
    if k < 1:
        raise ValueError("k must be positive")
    return cut_lineage(edges.select("src", "dst").distinct())


def _iterated(e: DataFrame, nodes: DataFrame, k: int, rounds: int, tolerance: float, seed: int) -> tuple[DataFrame, int]:
    """A basis of k + SPARE leading directions of the squared matrix, once the first k sums along them change by no more
    than the tolerance; raises where the rounds are too few."""
    block, width = _orthonormal(cut_lineage(_start(nodes, k + SPARE, seed)), k + SPARE)
    before = None
    for _ in range(rounds):
        if not width:
            return block, width
        after = cut_lineage(_times(e, _times(e, block, "src", width), "dst", width))
        size, axes = np.linalg.eigh(_inner(after, width))
        use = size > max(size.max(), 0.0) * 1e-14
        block, width = _turned(after, axes[:, use] / np.sqrt(size[use])), int(use.sum())
        now = np.sqrt(size[use])[::-1][:k]
        if before is not None and len(before) == len(now) and (np.abs(now - before) <= tolerance * now).all():
            return cut_lineage(block), width
        before = now
    raise RuntimeError(f"not settled after {rounds} rounds")


def _long(block: DataFrame, k: int, name: str) -> DataFrame:
    """rank, id, name: one row per vector and node."""
    return block.select("id", F.posexplode(F.array(*_names(k))).alias("rank", name)).select((F.col("rank") + 1).alias("rank"), "id", name)


def singular_vectors(edges: DataFrame, k: int, rounds: int = 200, tolerance: float = 1e-7, seed: int = 0) -> tuple[list[float], DataFrame]:
    """The k largest singular values, falling, of the adjacency matrix of distinct directed edges, and rank, id, left, right.

    Fewer come back where the matrix has a smaller rank; nodes without edges in a direction have 0 there. The vectors'
    signs make their largest right component in magnitude positive (the smallest id of equal ones). No edges: none.
    """
    e = _pairs_of(edges, k)
    nodes = cut_lineage(nodes_of(e))
    block, width = _iterated(e, nodes, k, rounds, tolerance, seed)
    if width:
        size, axes = np.linalg.eigh(_inner(_times(e, block, "src", width), width))
        order = [i for i in np.argsort(-size) if size[i] > max(size.max(), 0.0) * 1e-12][:k]
        right = cut_lineage(_turned(block, axes[:, order]))
        width, values = len(order), np.sqrt(size[order])
        left = _turned(_times(e, right, "src", width), np.diag(1 / values))
    else:
        return [], nodes.where("false").select(F.lit(1).alias("rank"), "id", F.lit(0.0).alias("left"), F.lit(0.0).alias("right"))
    ranks = F.explode(F.sequence(F.lit(1), F.lit(width))).alias("rank")
    both = nodes.select(ranks, "id").join(_long(left, width, "left"), ["rank", "id"], "left").join(_long(right, width, "right"), ["rank", "id"], "left").na.fill(0.0, ["left", "right"])
    return [float(x) for x in values], _signed(both, "right", ["left", "right"])


def eigenpairs(edges: DataFrame, k: int, rounds: int = 200, tolerance: float = 1e-7, seed: int = 0) -> tuple[list[float], DataFrame]:
    """The k eigenvalues of largest magnitude, by falling magnitude, of the undirected graph's adjacency matrix, and rank, id, value."""
    e = _pairs_of(symmetric(edges), k)
    nodes = cut_lineage(nodes_of(e))
    block, width = _iterated(e, nodes, k, rounds, tolerance, seed)
    if not width:
        return [], nodes.where("false").select(F.lit(1).alias("rank"), "id", F.lit(0.0).alias("value"))
    small = _inner(block, width, _times(e, block, "src", width))
    size, axes = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-np.abs(size), kind="stable")[:k]
    vectors = _long(_turned(block, axes[:, order]), len(order), "value")
    return [float(x) for x in size[order]], _signed(vectors, "value", ["value"])


def _signed(vectors: DataFrame, by: str, columns: list[str]) -> DataFrame:
    top = vectors.groupBy("rank").agg(F.max_by(by, F.struct(F.round(F.abs(by), 9), -F.col("id"))).alias("top"))
    signed = vectors.join(F.broadcast(top), "rank")
    return signed.select("rank", "id", *[(F.col(c) * F.when(F.col("top") < 0, -1.0).otherwise(1.0)).alias(c) for c in columns])


def participation_ratios(vectors: DataFrame, column: str = "value") -> DataFrame:
    """rank, ratio: the sum of fourth powers over the squared sum of squares, 1 where a vector has one non-zero component."""
    square = F.sum(F.col(column) * F.col(column))
    return vectors.groupBy("rank").agg((F.sum(F.pow(column, F.lit(4.0))) / (square * square)).alias("ratio"))
