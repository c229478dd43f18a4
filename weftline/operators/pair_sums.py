"""Sums over the values that two keys share, for all pairs of keys, without a row for each pair and value.

Keys with their values are dealt into blocks, and each pair of blocks meets in one group that sums in arrays. So the
rows are repeated by the number of blocks, about the square root of the work, and only results leave a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Values of a block: up to PARTS blocks of at least LEAST, then more blocks of at most MOST.
LEAST, MOST, PARTS = 100_000, 3_000_000, 6
#: Pairs of values that are summed at once.
_CHUNK = 1 << 22


def blocks_for(values: int) -> int:
    return max(min(PARTS, -(-values // LEAST)), -(-values // MOST), 1)


def _sums(k1: np.ndarray, v1: np.ndarray, n1: np.ndarray, k2: np.ndarray, v2: np.ndarray, n2: np.ndarray, may: Callable) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of rows (key 1, key 2, sum of n1 n2 over their common values) with every pair of a key 1 in one piece, its keys
    in order. k1 rises; may(key 1, key 2) tells pairs that are wanted."""
    order = np.argsort(v2, kind="stable")
    k2, n2 = k2[order], n2[order]
    starts = np.searchsorted(v2[order], np.arange(max(v1.max(initial=-1), v2.max(initial=-1)) + 2))
    size = starts[v1 + 1] - starts[v1]
    upto = np.cumsum(size)
    keys2 = int(k2.max(initial=-1)) + 1
    ends = np.flatnonzero(np.r_[k1[1:] != k1[:-1], True]) + 1
    lo = 0
    while lo < len(k1):
        room = (upto[lo - 1] if lo else 0) + _CHUNK
        hi = int(ends[max(np.searchsorted(upto[ends - 1], room, "right") - 1, np.searchsorted(ends, lo, "right"))])
        s = size[lo:hi]
        at = np.repeat(starts[v1[lo:hi]] - (np.cumsum(s) - s), s) + np.arange(int(s.sum()))
        one, two = np.repeat(k1[lo:hi] - k1[lo], s), k2[at]
        weight = np.repeat(n1[lo:hi], s) * n2[at]
        want = may(one + k1[lo], two)
        if want is not None:
            one, two, weight = one[want], two[want], weight[want]
        code = one * keys2 + two
        cells = (int(k1[hi - 1] - k1[lo]) + 1) * keys2
        if cells <= 8 * len(code):
            dense = np.bincount(code, weight, cells)
            code = np.flatnonzero(dense)
            total = dense[code].astype(np.int64)
        else:
            by = np.argsort(code)
            code = code[by]
            first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
            total = np.add.reduceat(weight[by], first) if len(code) else np.zeros(0, np.int64)
            code = code[first]
        yield code // keys2 + k1[lo], code % keys2, total
        lo = hi


def _flat(t: pa.Table) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Key number (the row), value and count of each element."""
    lists = t.column("vs").combine_chunks()
    items = lists.flatten()
    return np.repeat(np.arange(len(t)), np.diff(lists.offsets.to_numpy())), items.field("v"), items.field("n").to_numpy()


def met(left: DataFrame, right: DataFrame, pairs: list[tuple[int, int]], pick: Callable, may: Callable, schema: str) -> DataFrame:
    """left, right: key, block, vs (array of v, n) and size, one row a key; pairs: the blocks that meet. may(sizes 1, sizes 2)
    tells which of several pairs are wanted, or is None for all. pick(keys 1, keys 2, sizes 1, sizes 2, i, j, sums) gives the
    columns of schema for the pairs (rows i and j of the keys)."""

    def dealt(df: DataFrame, mine: int) -> DataFrame:
        of: dict[int, list[int]] = {}
        for p in pairs:
            of.setdefault(p[mine], []).append(p[1 - mine])
        table = df.sparkSession.createDataFrame([(b, o) for b, os in of.items() for o in os], "block int, other int")
        return df.join(F.broadcast(table), "block").withColumnsRenamed({"block": "ij"[mine], "other": "ij"[1 - mine]})

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in schema.split(", ")]
        found = []
        b = b.rename_columns([c.removesuffix("_2") for c in b.column_names])
        if len(a) and len(b):
            (k1, v1, n1), (k2, v2, n2) = _flat(a), _flat(b)
            both = pa.chunked_array([v1, v2]).combine_chunks().dictionary_encode().indices.to_numpy()
            s1, s2 = a.column("size").to_numpy(), b.column("size").to_numpy()
            keys1, keys2 = a.column("key").combine_chunks(), b.column("key").combine_chunks()
            wanted = lambda i, j: may(s1[i], s2[j]) if may else None
            for i, j, total in _sums(k1, both[: len(v1)].astype(np.int64), n1, k2, both[len(v1) :].astype(np.int64), n2, wanted):
                found.append(pa.table(pick(keys1, keys2, s1, s2, i, j, total), names=names))
        return pa.concat_tables(found) if found else empty

    kinds = left.sparkSession.createDataFrame([], schema).schema.fields
    empty = pa.table({f.name: pa.array([], to_arrow_type(f.dataType)) for f in kinds})
    one, two = dealt(left, 0), dealt(right, 1)
    # Other names, as both sides may be one table.
    two = two.select(*[F.col(c).alias(f"{c}_2") for c in two.columns])
    return one.groupBy("i", "j").cogroup(two.groupBy("i_2", "j_2")).applyInArrow(run, schema)


def listed(counts: DataFrame, key: str, value: str, n: Column, size: Column) -> DataFrame:
    """key, vs, size of rows (key, value): size is an aggregate."""
    return counts.groupBy(F.col(key).alias("key")).agg(F.sort_array(F.collect_list(F.struct(F.col(value).alias("v"), n.cast("long").alias("n")))).alias("vs"), size.alias("size"))


def in_blocks(keys: DataFrame, by: str, blocks: int) -> tuple[DataFrame, dict[int, tuple[float, float]]]:
    """keys with their block by rising values of a number, and the least and largest size of each block."""
    cuts = keys.agg(F.percentile_approx(by, [i / blocks for i in range(1, blocks)], 10_000)).first()[0] if blocks > 1 else []
    block = sum((F.when(F.col(by) > F.lit(c), 1).otherwise(0) for c in cuts or []), F.lit(0)).cast("int")
    out = keys.withColumn("block", block)
    ends = {r["block"]: (r["lo"], r["hi"]) for r in out.groupBy("block").agg(F.min("size").alias("lo"), F.max("size").alias("hi")).collect()}
    return out, ends
