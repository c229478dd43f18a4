"""All-pairs measures over a graph that each task holds in arrays, with the sources dealt to the tasks.

The arrays take 4 bytes an edge and direction and reach the executors in one broadcast. Reached nodes are bits: a word
stands for 64 sources, and a step takes the union of the neighbours' words, so no table of pairs is made. Graphs of
more than MAX_SHARED edges, and ids that are no whole numbers or null, are left to the caller.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from weftline.plans.densest import cut_lineage

MAX_SHARED = 20_000_000
#: Weights that differ; more of them are left to the caller, as each has its own edges and sums.
MAX_WEIGHTS = 32
#: Edges that a step reads at once.
_CHUNK = 1 << 20
_U = np.uint64


@dataclass
class Adjacency:
    """For each node a sorted span of indices, by its starts."""

    starts: np.ndarray
    ends: np.ndarray

    @staticmethod
    def of(at: np.ndarray, other: np.ndarray, n: int) -> Adjacency:
        order = np.lexsort((other, at))
        return Adjacency(np.r_[0, np.cumsum(np.bincount(at, minlength=n))], other[order].astype(np.int32))

    def degree(self, rows: np.ndarray) -> np.ndarray:
        return self.starts[rows + 1] - self.starts[rows]

    def spans(self, rows: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Pieces of rows, their degrees and all their neighbours, about _CHUNK at once. Rows must rise and have neighbours."""
        n = self.degree(rows)
        upto = np.cumsum(n)
        lo = 0
        while lo < len(rows):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + _CHUNK, "right")))
            size = n[lo:hi]
            before = np.cumsum(size) - size
            if rows[hi - 1] - rows[lo] == hi - lo - 1:
                found = self.ends[self.starts[rows[lo]] : self.starts[rows[hi - 1] + 1]]
            else:
                found = self.ends[np.repeat(self.starts[rows[lo:hi]] - before, size) + np.arange(int(size.sum()))]
            yield slice(lo, hi), size, found.astype(np.intp)
            lo = hi


@dataclass
class Shared:
    """Sorted ids and, for each weight, the nodes that lead to a node and those it leads to."""

    ids: np.ndarray
    by_weight: list[tuple[float, Adjacency, Adjacency]]


def shared(edges: DataFrame, directed: bool = True, weight: str | None = None, limit: int = MAX_SHARED) -> Shared | None:
    """The graph of distinct edges (with the least weight each) without self-loops, whose nodes still count; None if it does
    not fit."""
    whole = ByteType | ShortType | IntegerType | LongType
    if not all(isinstance(edges.schema[c].dataType, whole) for c in ("src", "dst")):
        return None
    e = edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), *([F.col(weight).cast("double").alias("w")] if weight else []))
    if not directed:
        # Unlike least() and greatest(), null where one end is.
        e = e.selectExpr("if(src is null or dst is null, null, least(src, dst)) as src", "if(src is null or dst is null, null, greatest(src, dst)) as dst")
    e = cut_lineage(e.groupBy("src", "dst").agg(F.min("w").alias("w")) if weight else e.distinct())
    if e.count() > limit or not e.where("src is null or dst is null" + (" or w is null or not (w >= 0) or w = double('inf')" if weight else "")).isEmpty():
        return None
    rows = e.toArrow()
    src, dst = (rows.column(c).to_numpy() for c in ("src", "dst"))
    ids = np.unique(np.r_[src, dst])
    src, dst = np.searchsorted(ids, src), np.searchsorted(ids, dst)
    other = src != dst
    w = rows.column("w").to_numpy()[other] if weight else None
    src, dst = src[other], dst[other]
    if not directed:
        both = Adjacency.of(np.r_[src, dst], np.r_[dst, src], len(ids))
        return Shared(ids, [(1, both, both)])
    if w is None:
        return Shared(ids, [(1, Adjacency.of(dst, src, len(ids)), Adjacency.of(src, dst, len(ids)))])
    kinds = np.unique(w)
    if len(kinds) > MAX_WEIGHTS:
        return None
    return Shared(ids, [(float(x), Adjacency.of(dst[w == x], src[w == x], len(ids)), Adjacency.of(src[w == x], dst[w == x], len(ids))) for x in kinds])


def _per_source(bits: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """How many of the columns each of the 64 sources of each word has."""
    out = np.zeros((len(bits), 64), np.int64)
    for lo in range(0, len(columns), 1 << 17):
        for w, row in enumerate(bits):
            out[w] += np.unpackbits(row[columns[lo : lo + (1 << 17)]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return out.ravel()


def reached(g: Shared, sources: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
    """Rising distances and how many nodes each of the sources (positions) has at it; itself at 0."""
    n, words = len(g.ids), -(-len(sources) // 64)
    at = np.arange(len(sources))
    first = np.zeros((words, n), _U)
    np.bitwise_or.at(first, (at // 64, sources), _U(1) << (at % 64).astype(_U))
    every = np.bitwise_or.reduce(first, axis=1)[:, None]
    seen, pending = np.zeros((words, n), _U), {0: first}
    while pending:
        d = min(pending)
        front = pending.pop(d) & ~seen
        active = np.flatnonzero(front.any(axis=0))
        if not len(active):
            continue
        yield d, _per_source(front, active)[: len(sources)]
        seen |= front
        left = np.flatnonzero((seen != every).any(axis=0))
        for w, into, out in g.by_weight:
            to = left
            outgoing = active[out.degree(active) > 0]
            if out.degree(outgoing).sum() * 8 < len(out.ends):
                mark = np.zeros(n, bool)
                for _, _, found in out.spans(outgoing):
                    mark[found] = True
                to = left[mark[left]]
            to = to[into.degree(to) > 0]
            for part, size, found in into.spans(to):
                rows, heads = to[part], np.cumsum(size) - size
                new = np.stack([np.bitwise_or.reduceat(x[found], heads) for x in front]) & ~seen[:, rows]
                if new.any():
                    if d + w not in pending:
                        pending[d + w] = np.zeros((words, n), _U)
                    pending[d + w][:, rows] |= new


def hop_counts(g: Shared, edges: DataFrame, sources: list[int] | None = None) -> DataFrame:
    """source, dist, n: the nodes at each distance from each source (all by default; others must be nodes)."""
    spark = edges.sparkSession
    at = np.arange(len(g.ids)) if sources is None else np.searchsorted(g.ids, np.array(sources, np.int64))
    words = max(1, min(16, -(-len(at) // (64 * 48)), (1 << 21) // max(1, len(g.ids))))
    batches = -(-len(at) // (64 * words))
    data = spark.sparkContext.broadcast((g, at))
    kind = "double" if any(isinstance(w, float) for w, _, _ in g.by_weight) else "int"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, order = data.value
        for part in parts:
            for b in part.column(0).to_pylist():
                own = order[b * 64 * words : (b + 1) * 64 * words]
                for d, n in reached(graph, own):
                    some = np.flatnonzero(n)
                    dist = np.full(len(some), d, np.float64 if kind == "double" else np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(graph.ids[own[some]]), pa.array(dist), pa.array(n[some])], ["source", "dist", "n"])

    return spark.range(0, batches, 1, max(1, batches)).mapInArrow(run, f"source long, dist {kind}, n long")


def dependencies(g: Shared, s: int, total: np.ndarray) -> None:
    """Adds to each node what the shortest paths from the source s over an undirected graph give it (Brandes), both of a
    step's ends being tried: the edges of the nearer nodes or of the farther ones, whichever are fewer."""
    (_, adj, _), n = g.by_weight[0], len(g.ids)
    dist, paths = np.full(n, -1, np.int32), np.zeros(n)
    dist[s], paths[s] = 0, 1.0
    levels = [np.array([s])]
    left = n - 1
    degree = np.diff(adj.starts)
    while left:
        front, d = levels[-1], len(levels) - 1
        other = np.flatnonzero((dist < 0) & (degree > 0))
        got = _from(adj, front, other, paths, degree)
        new = other[got[other] > 0]
        if not len(new):
            break
        dist[new], paths[new] = d + 1, got[new]
        levels.append(new)
        left -= len(new)
    share = np.zeros(n)
    for d in range(len(levels) - 1, 1, -1):
        far, near = levels[d], levels[d - 1]
        given = np.zeros(n)
        given[far] = (1 + share[far]) / paths[far]
        share[near] = paths[near] * _from(adj, far, near, given, degree)[near]
    share[s] = 0
    total += share


def _from(adj: Adjacency, giving: np.ndarray, taking: np.ndarray, value: np.ndarray, degree: np.ndarray) -> np.ndarray:
    """For each taking node the sum of the values of the giving nodes next to it; other nodes' entries mean nothing."""
    n = len(degree)
    giving = giving[degree[giving] > 0]
    if degree[giving].sum() <= degree[taking].sum():
        out = np.zeros(n)
        for part, size, found in adj.spans(giving):
            out += np.bincount(found, np.repeat(value[giving[part]], size), n)
        return out
    only = np.zeros(n)
    only[giving] = value[giving]
    out = np.zeros(n)
    for part, size, found in adj.spans(taking):
        out[taking[part]] = np.add.reduceat(only[found], np.cumsum(size) - size)
    return out


def constraints(g: Shared, edges: DataFrame) -> DataFrame:
    """id, constraint (Burt's, with equal shares) of the nodes of an undirected graph that have neighbours."""
    spark, n = edges.sparkSession, len(g.ids)
    data = spark.sparkContext.broadcast(g)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = data.value
        _, adj, _ = graph.by_weight[0]
        degree = np.diff(adj.starts)
        for part in parts:
            at, found = [], []
            for i in part.column(0).to_pylist():
                if not degree[i]:
                    continue
                near = adj.ends[adj.starts[i] : adj.starts[i + 1]].astype(np.intp)
                # What each node gets by two steps from i, but for the share of the first one, which is the same for all.
                two = np.zeros(n)
                for piece, size, ends in adj.spans(near):
                    two += np.bincount(ends, np.repeat(1 / degree[near[piece]], size), n)
                at.append(i)
                found.append((((1 + two[near]) / degree[i]) ** 2).sum())
            yield pa.RecordBatch.from_arrays([pa.array(graph.ids[at]), pa.array(np.array(found, np.float64))], ["id", "constraint"])

    tasks = max(1, min(n // 64, 8 * spark.sparkContext.defaultParallelism))
    return spark.range(n).repartition(tasks, "id").mapInArrow(run, "id long, constraint double")
