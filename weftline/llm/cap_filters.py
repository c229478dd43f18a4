"""Near-duplicate vectors by spherical-cap filters.

Filter directions are the concatenations of one codeword for each half of the rotated space, so k codewords a half give
k**2 directions. A vector goes to every filter whose direction it exceeds the threshold for; those are list-decoded from
the sorted scores of the halves, so the time follows the number of filters found. Vectors that share a filter are
verified in double precision, each pair in the first filter it shares.

The threshold is set so that a filter has BUCKET vectors on average whatever their number, and the number of directions
so that a pair at the cosine limit shares SHARED filters on average (a miss has about e**-SHARED). Equal vectors are one
class. A filter of more than TILE classes is dealt in tiles of two parts, each a task's row group of bounded size; what
leaves a tile is a number of links and one edge a vector, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.components import components
from weftline.llm.scratch import durable, temporary
from weftline.llm.tiles import TILE, dealt

LIMIT = 0.95
SHARED = 12.0
BUCKET = 48
PARTS = 2
SEED = 7


def parameters(n: int, limit: float = LIMIT, bucket: int = BUCKET, shared: float = SHARED) -> tuple[float, int]:
    """The threshold in standard deviations of a random score, and the number of codewords a half, for n vectors."""
    q = min(0.05, max(bucket / max(n, 1), 1e-12))
    t = NormalDist().inv_cdf(1 - q)
    # Chance that a vector at the limit of one in a filter is in it too, by integration over the score of the first.
    xs = np.linspace(t, t + 6, 2000)
    weight = np.exp(-xs * xs / 2)
    rest = np.array([1 - NormalDist().cdf((t - limit * x) / math.sqrt(1 - limit * limit)) for x in xs])
    both = float((weight * rest).sum() / weight.sum())
    return t, max(2, math.ceil((shared / both / q) ** (1 / PARTS)))


def _code(dim: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A rotation of the space (a multiple of PARTS wide) and the codewords of each half."""
    wide = -(-dim // PARTS) * PARTS
    rng = np.random.default_rng([SEED, dim, k])
    rotation, _ = np.linalg.qr(rng.standard_normal((wide, wide)))
    words = rng.standard_normal((PARTS, k, wide // PARTS))
    return rotation, words / np.linalg.norm(words, axis=2, keepdims=True) / math.sqrt(PARTS)


def unit(values: np.ndarray) -> np.ndarray:
    values = values.astype(np.float64)
    values = values / np.abs(values).max()
    return values / np.sqrt((values * values).sum())


def decode(x: np.ndarray, rotation: np.ndarray, words: np.ndarray, t: float) -> np.ndarray:
    """The filters of one unit vector, in order."""
    wide, k = rotation.shape[0], words.shape[1]
    y = (rotation[:, : len(x)] @ x).reshape(PARTS, -1)
    scores = np.einsum("pkd,pd->pk", words, y)
    left, right = scores
    bound = t / math.sqrt(wide)
    order = np.argsort(-right)
    ranked = -right[order]
    heads = np.flatnonzero(left >= bound - right.max())
    n = np.searchsorted(ranked, left[heads] - bound, "right")
    tail = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    return np.sort(np.repeat(heads, n) * k + tail)


def _filters(t: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, tuple] = {}
        for b in batches:
            v, found = b.column("v"), []
            for x in v:
                x = unit(x.values.to_numpy(zero_copy_only=False))
                if len(x) not in codes:
                    codes[len(x)] = _code(len(x), k)
                found.append(decode(x, *codes[len(x)], t) * 4096 + len(x) % 4096)
            yield pa.RecordBatch.from_arrays([b.column("cid"), b.column("mult"), v, pa.array(found, pa.list_(pa.int64()))], ["cid", "mult", "v", "filters"])

    return run


def _links(limit: float):
    """Of rows sorted by tile: a row (cid, links, other) for each member with links the tile is first to see."""

    def tile(f: int, across: bool, cid: np.ndarray, mult: np.ndarray, side: np.ndarray, v: list, filters: list) -> tuple:
        # Vectors of different lengths may share a filter's number; they link with nothing.
        length = np.array([len(x) for x in v])
        out = []
        for d in sorted(set(length.tolist())):
            m = np.flatnonzero(length == d)
            x = np.array([unit(v[i]) for i in m])
            before = [filters[i][filters[i] < f] for i in m]
            names, at = np.unique(np.concatenate(before), return_inverse=True) if len(m) else (np.zeros(0), np.zeros(0, int))
            seen = np.zeros((len(m), max(1, len(names))), np.float32)
            seen[np.repeat(np.arange(len(m)), [len(y) for y in before]), at] = 1
            linked = x @ x.T >= limit
            np.fill_diagonal(linked, False)
            if across:
                linked &= side[m][:, None] != side[m][None]
            new = linked & (seen @ seen.T == 0)
            links = new @ mult[m]
            root = np.arange(len(m))
            while True:  # the smallest member each one reaches inside the tile
                low = np.minimum(root, np.where(linked, root[None], len(m)).min(axis=1, initial=len(m)))
                low = low[low]
                if (low == root).all():
                    break
                root = low
            keep = (links > 0) | (root != np.arange(len(m)))
            out.append((cid[m][keep], links[keep], cid[m][root][keep]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                cid, mult, side, v, filters = zip(*rows, strict=True)
                got = tile(key[0], key[1] != key[2], np.array(cid), np.array(mult), np.array(side), v, filters)
                if len(got[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], ["cid", "links", "other"])

        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("f", "i", "j", "cid", "mult", "side")]
            v, filters = b.column("v"), b.column("filters")
            for r, (f, i, j, cid, mult, side) in enumerate(zip(*columns, strict=True)):
                if key != (f, i, j):
                    yield from close()
                    key, rows = (f, i, j), []
                rows.append((cid, mult, side, v[r].values.to_numpy(zero_copy_only=False), filters[r].values.to_numpy()))
        yield from close()

    return run


def near_vectors(vectors: DataFrame, limit: float = LIMIT, tile: int = TILE) -> DataFrame:
    """One row per row of vectors (vec_id long, embedding array of numbers; others are ignored):
    vec_id, n_links, component_id, kept.

    Vectors link at a cosine of limit or more. Null, empty or zero vectors and those with null, NaN or infinite
    components link with nothing, nor do vectors of different lengths. Repeated rows are vectors of their own, also
    where they share a vec_id; a null vec_id is larger than any other. Each link found is verified; some may be missed.
    """
    none = 2**63 - 1
    id_ = F.coalesce(F.col("vec_id").cast("long"), F.lit(none))
    usable = F.expr("coalesce(size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x != 0), false)")
    rows = durable(vectors.select(F.monotonically_increasing_id().alias("uid"), id_.alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).withColumn("v", F.when(usable, F.col("v"))))
    with temporary(vectors.sparkSession) as keep:
        grouped = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("mult"))
        classes = durable(grouped.withColumn("cid", F.monotonically_increasing_id()))
        t, k = parameters(classes.count(), limit)
        coded = durable(classes.select("cid", "mult", "v").mapInArrow(_filters(t, k), "cid long, mult long, v array<double>, filters array<long>"))
        sizes = coded.select(F.explode("filters").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"))
        members = dealt(coded.withColumn("f", F.explode("filters")), sizes, "f", "cid", tile)
        found = durable(members.mapInArrow(_links(limit), "cid long, links long, other long"))
        links = found.groupBy("cid").agg(F.sum("links").alias("links"))
        roots = components(found.select(F.col("cid").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "cid")
        joined = keep(durable(classes.join(links, "cid", "left").join(roots, "cid", "left").select("cid", "v", "least", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root"))))
    lowest = joined.groupBy("root").agg(F.min("least").alias("component"))
    out = rows.join(joined.join(lowest, "root").select("v", "n_links", "component"), "v", "left")
    component = F.coalesce("component", "vec_id")
    return out.select(F.nullif("vec_id", F.lit(none)).alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.nullif(component, F.lit(none)).alias("component_id"), (F.col("vec_id") == component).alias("kept"))
