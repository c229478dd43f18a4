"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures and exact sorted-array intersections.

A document is its set of distinct five-word shingles. Two sets of Jaccard similarity 0.8 or more share one of the first
n - ceil(0.8 n) + 1 shingles of each, whatever total order the shingles have; the order here puts rare shingles first
(by a count sketch of fixed size), so a passage that many documents share makes no candidates. A tile holds the
documents with one such shingle, by size; only sizes within a factor 0.8 meet. Of a pair, the bit counts of the two
signatures bound the overlap from above, and only then the sorted arrays are intersected.

All pairs of a tile are never made. First each document is compared with one other of the tile, then with its neighbour
by size where the links found so far leave the two apart; at last only tiles with documents of different components
go on, with the pairs between those. So the
components are those of all links, while a group of copies costs one comparison a copy.

Scale: two passes over the texts for the sketch and the tiles, one for the documents of candidate pairs. Tiles are
dealt by shingle, in binary payloads; the number of shards grows with the number of shingles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.blocks import Block, U, blocks, distinct, mix, pack, returning, sharded, spans_hash, unpack
from weftline.llm.components import components
from weftline.llm.scratch import durable, small, temporary
from weftline.llm.tiles import dealt

WORDS = 5
SKETCH_BITS = 20
SKETCH_SLICES = 16
#: Shingles that a shard gets, on average (a fifth of them are in its tiles).
SHARD_SHINGLES = 6_000_000
#: Pairs that a task remembers as no links.
PASSED = 400_000
#: Stands for a null doc_id: larger than any other.
_NONE = 2**63 - 1
_52 = U((1 << 52) - 1)
_NODE = "struct<d: bigint, t: bigint>"


def shingles(block: Block, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted doc << 52 | hash of the distinct shingles of a block, and each document's number of them."""
    n = block.n_words
    k = np.minimum(n, words)
    per = np.where(n > 0, n - k + 1, 0)
    doc = np.repeat(np.arange(block.n), per)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    start = block.first_word[doc] + within
    h = spans_hash(block.hashes, start, start + k[doc])
    keys = distinct((doc.astype(U) << U(52)) | (h & _52))
    return keys, np.bincount((keys >> U(52)).astype(np.int64), minlength=block.n)


@returning
def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of two kinds: documents (d, t, n, signatures), and a slice of how many shingles fall into each of 2**SKETCH_BITS buckets."""
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    names = ["d", "t", "n", "octave", "wide", "slice", "counts"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.binary()]
    for b in batches:
        for block in blocks(b.column("text")):
            keys, n = shingles(block)
            np.add.at(counts, ((keys & _52) >> U(52 - SKETCH_BITS)).astype(np.int64), np.uint32(1))
            octave, wide = _signatures(keys, n)
            own = [b.column(c).slice(block.first, block.n) for c in ("d", "t")] + [pa.array(n), pa.array(octave, pa.int32()), wide]
            yield pa.RecordBatch.from_arrays([*own, *[pa.nulls(block.n, k) for k in kinds[5:]]], names)
    parts = [pack(x) for x in np.split(counts, SKETCH_SLICES)]
    yield pa.RecordBatch.from_arrays([*[pa.nulls(SKETCH_SLICES, k) for k in kinds[:5]], pa.array(range(SKETCH_SLICES), pa.int32()), pa.array(parts, pa.binary())], names)


def _sum_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, x in zip(b.column("slice").to_pylist(), b.column("counts").to_pylist(), strict=True):
            total[k] = total.get(k, 0) + unpack(x)[0].astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["slice", "counts"])


def rarity(slices: DataFrame) -> tuple[np.ndarray, int]:
    """A level 0..15 for each bucket of shingles (0: as frequent as usual or rarer), and the number of shingles."""
    found = slices.select("slice", "counts").repartition(SKETCH_SLICES, "slice").mapInArrow(_sum_slices, "slice int, counts binary").collect()
    counts = np.zeros((SKETCH_SLICES, (1 << SKETCH_BITS) // SKETCH_SLICES), np.int64)
    for r in found:
        counts[r["slice"]] += np.frombuffer(r["counts"], np.int64)
    counts = counts.ravel()
    return np.clip(np.floor(np.log2(np.maximum(counts, 1) / max(1.0, counts.mean()))), 0, 15).astype(np.uint8), int(counts.sum())


def _signatures(keys: np.ndarray, n: np.ndarray) -> tuple[list[int], pa.Array]:
    """For each set: the octave of its size, and the parities of its elements in 64 << octave buckets. The two halves of a
    signature, folded, are that of half as many buckets."""
    octaves = [max(0, int(x - 1).bit_length() - 6) for x in n.tolist()]
    words = np.array([1 << o for o in octaves])
    starts = np.cumsum(words) - words
    doc = (keys >> U(52)).astype(np.int64)
    bucket = ((keys & _52) & ((words[doc] << 6) - 1).astype(U)).astype(np.int64)
    bits = np.bincount((starts[doc] << 6) + bucket, minlength=int(words.sum()) << 6) & 1
    wide = np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)
    return octaves, pa.ListArray.from_arrays(np.r_[starts, words.sum()].astype(np.int32), wide)


def _tiles(levels: np.ndarray, shards: int) -> Callable:
    """For each block and shard, a payload of documents and postings."""

    @returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, t = b.column("d").to_numpy(), b.column("t").to_numpy()
            for block in blocks(b.column("text")):
                keys, n = shingles(block)
                doc = (keys >> U(52)).astype(np.int64)
                digest = np.zeros(block.n, U)
                np.add.at(digest, doc, mix(keys & _52))
                level = levels[((keys & _52) >> U(52 - SKETCH_BITS)).astype(np.int64)].astype(U)
                ordered = np.sort((keys & ~_52) | (level << U(48)) | ((keys & _52) >> U(4)))
                rank = np.arange(len(keys)) - (np.cumsum(n) - n)[doc]
                first = ordered[rank < (n - (4 * n + 4) // 5 + 1)[doc]]
                key, who = first & _52, (first >> U(52)).astype(np.int64)
                own_d, own_t = d[block.first : block.first + block.n], t[block.first : block.first + block.n]
                order, cuts = sharded(key, shards)
                shard, payload = [], []
                for s, lo, hi in cuts:
                    w = who[order[lo:hi]]
                    used = distinct(w)
                    at = np.searchsorted(used, w)
                    shard.append(s)
                    payload.append(pack(own_d[used], own_t[used], n[used].astype(np.uint32), digest[used], key[order[lo:hi]], at.astype(np.uint16)))
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(payload, pa.binary())], ["shard", "payload"])

    return run


@returning
def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one shard: rows of kind E (equal sets), C (neighbours to compare) and G (members of tiles of three or more sets)."""
    parts: list[list[np.ndarray]] = []
    for b in batches:
        for x in b.column("payload").to_pylist():
            d, t, n, digest, key, at = unpack(x)
            parts.append([key, d[at], t[at], n[at].astype(np.int64), digest[at]])
    if not parts:
        return
    key, d, t, n, digest = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    # Only keys of two documents or more are sorted in full.
    order = np.argsort(key, kind="stable")
    k = key[order]
    again = np.r_[False, k[1:] == k[:-1]]
    order = order[again | np.r_[again[1:], False]] if len(k) else order
    key, d, t, n, digest = (x[order] for x in (key, d, t, n, digest))
    order = np.lexsort((t, d, digest, n, key))
    key, d, t, n, digest = (x[order] for x in (key, d, t, n, digest))
    same_key = key[1:] == key[:-1]
    same_set = same_key & (digest[1:] == digest[:-1]) & (n[1:] == n[:-1])
    same_doc = same_set & (d[1:] == d[:-1]) & (t[1:] == t[:-1])
    fits = same_key & (5 * n[:-1] >= 4 * n[1:])
    # A run of equal sets is one set below: its first document, the one with the smallest id, stands for it.
    stands = np.flatnonzero(np.r_[True, ~same_set]) if len(key) else np.zeros(0, np.int64)
    rep = stands[np.cumsum(np.r_[True, ~same_set]) - 1] if len(key) else stands
    copy = np.flatnonzero(np.r_[False, same_set & ~same_doc])
    # A set is compared with the first of the tile that a chain of fitting sizes leads back to, or with the one before.
    head = np.flatnonzero(np.r_[True, ~fits]) if len(key) else stands
    lead = head[np.cumsum(np.r_[True, ~fits]) - 1] if len(key) else stands
    after = np.flatnonzero(np.r_[False, fits & ~same_set])
    against = np.where(5 * n[lead[after]] >= 4 * n[after], lead[after], rep[after - 1])
    group = np.cumsum(np.r_[True, key[stands][1:] != key[stands][:-1]]) - 1 if len(stands) else stands
    large = stands[np.bincount(group)[group] >= 3] if len(stands) else stands
    kind = np.repeat(["E", "C", "G"], [len(copy), len(after), len(large)])
    first = np.r_[rep[copy], against, large]
    second = np.r_[copy, after, large]
    table = np.empty(len(kind), [("kind", "U1"), ("k", np.int64), ("d", np.int64), ("t", np.int64), ("d2", np.int64), ("t2", np.int64), ("n", np.int64)])
    for name, x in (("kind", kind), ("k", np.r_[np.zeros(len(first) - len(large), np.int64), key[large].astype(np.int64)]), ("d", d[first]), ("t", t[first]), ("d2", d[second]), ("t2", t[second]), ("n", n[first])):
        table[name] = x
    table = table[np.lexsort([table[c] for c in reversed(table.dtype.names)])]
    table = table[np.r_[True, table[1:] != table[:-1]]] if len(table) else table
    for lo in range(0, len(table), 50_000):
        x = table[lo : lo + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(x[c].tolist() if c == "kind" else x[c]) for c in x.dtype.names], list(x.dtype.names))


@returning
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and its whole set as sorted 52-bit hashes."""
    for b in batches:
        node = b.column("node")
        for block in blocks(b.column("text")):
            keys, n = shingles(block)
            ends = np.cumsum(n)
            elements = [pack(np.diff(keys[lo:hi] & _52, prepend=U(0))) for lo, hi in zip(ends - n, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([node.slice(block.first, block.n), pa.array(elements, pa.binary())], ["node", "elements"])


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets link."""
    if len(x) > len(y):
        x, y = y, x
    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(y) else 0
    return 100 * common >= 80 * (len(x) + len(y) - common) and common > 0


def _elements(payload: bytes) -> np.ndarray:
    return np.cumsum(unpack(payload)[0], dtype=U)


@returning
def _intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        good = [_similar(_elements(x), _elements(y)) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
        keep = pa.array(good, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])


def _pairs(rows: list[tuple], across: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of a tile's rows: pairs of fitting sizes in different components whose signatures leave them possible."""
    side, root, n, octave, wide = (list(x) for x in list(zip(*rows, strict=True))[2:])
    side, n, octave = np.array(side), np.array(n), np.array(octave)
    _, root = np.unique(np.array(root, [("d", np.int64), ("t", np.int64)]), return_inverse=True)
    for o in sorted(set(octave.tolist())):
        own = np.flatnonzero(octave == o)
        above = np.flatnonzero(octave == o + 1)
        x = np.array([wide[i] for i in own]).view(U)
        y = np.array([wide[i] for i in above]).view(U)
        for other, y in ((own, x), (above, y[:, : 1 << o] ^ y[:, 1 << o :] if len(above) else y)):
            for lo in range(0, len(own) * bool(len(other)), 256):
                a = own[lo : lo + 256]
                ok = (root[a][:, None] != root[other][None]) & (5 * n[a][:, None] >= 4 * n[other][None]) & (5 * n[other][None] >= 4 * n[a][:, None])
                if across:
                    ok &= side[a][:, None] != side[other][None]
                if other is own:
                    ok &= a[:, None] < other[None]
                p, q = np.nonzero(ok)
                for cut in range(0, len(p), 1 << 16):
                    u, v = p[cut : cut + (1 << 16)], q[cut : cut + (1 << 16)]
                    differ = np.bitwise_count(x[lo + u] ^ y[v]).sum(axis=1, dtype=np.int64)
                    good = n[a[u]] + n[other[v]] >= 9 * differ
                    yield a[u[good]], other[v[good]]


_TILE_ROW = "lod bigint, lot bigint, half bigint, i bigint, j bigint, k bigint, d bigint, t bigint, side bigint, rd bigint, rt bigint, n bigint, octave int, wide array<bigint>"


@returning
def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by tile: those with a possible pair in it."""
    key, rows, whole, schema = None, [], [], None

    def close() -> Iterator[pa.RecordBatch]:
        used = np.zeros(len(rows), bool)
        if len({r[3] for r in rows}) > 1:
            for u, v in _pairs(rows, key[1] != key[2]):
                used[u] = used[v] = True
        if used.any():
            yield pa.RecordBatch.from_pylist([whole[x] for x in np.flatnonzero(used)], schema)

    for b in batches:
        schema = b.schema
        for r in b.to_pylist():
            if key != (r["k"], r["i"], r["j"]):
                yield from close()
                key, rows, whole = (r["k"], r["i"], r["j"]), [], []
            rows.append((r["d"], r["t"], r["side"], (r["rd"], r["rt"]), r["n"], r["octave"], r["wide"]))
            whole.append(r)
    yield from close()


@returning
def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by family and tile, the sets of a family's documents first: links that join components. Pairs of fitting
    sizes in different components whose signatures leave them possible are intersected here, so fewer rows come out than
    documents came in."""

    def top(root: tuple) -> tuple:
        while (up := joined.get(root, root)) != root:
            joined[root] = joined.get(up, up)
            root = up
        return root

    def whole(node: tuple) -> np.ndarray:
        if isinstance(sets[node], bytes):
            sets[node] = _elements(sets[node])
        return sets[node]

    def close(key: tuple | None, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows = [(d, t, side, top(root), *rest) for d, t, side, root, *rest in rows]
        if len({r[3] for r in rows}) < 2:
            return
        links = []
        for u, v in _pairs(rows, key[1] != key[2]):
            for x, y in zip(u.tolist(), v.tolist(), strict=True):
                one, two = rows[x][:2], rows[y][:2]
                pair = (one, two) if one < two else (two, one)
                roots = top(rows[x][3]), top(rows[y][3])
                if roots[0] == roots[1] or pair in apart:
                    continue
                if _similar(whole(one), whole(two)):
                    joined[max(roots)] = min(roots)
                    links.append((*one, *two))
                else:
                    if len(apart) > PASSED:
                        apart.clear()
                    apart.add(pair)
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["d", "t", "d2", "t2"])

    # Components that links of this task join, and pairs it has found to be no links: a pair often shares many tiles.
    joined: dict[tuple, tuple] = {}
    apart: set[tuple] = set()
    sets: dict[tuple, bytes | np.ndarray] = {}
    family, key, rows = None, None, []
    names = ("lod", "lot", "half", "i", "j", "k", "d", "t", "side", "rd", "rt", "n", "octave", "wide", "elements")
    for b in batches:
        for lod, lot, half, i, j, k, d, t, side, rd, rt, n, octave, wide, elements in zip(*[b.column(c).to_pylist() for c in names], strict=True):
            new = (lod, lot, half, i, j)
            if elements is not None:
                if family != new:
                    yield from close(key, rows)
                    family, key, rows, sets = new, None, [], {}
                sets[d, t] = elements
                continue
            if key != (k, i, j):
                yield from close(key, rows)
                key, rows = (k, i, j), []
            rows.append((d, t, side, (rd, rt), n, octave, wide))
    yield from close(key, rows)


def _sets_of(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """node, elements of the documents in nodes. rows: node, text of all documents."""
    wanted = durable(nodes.distinct())
    return durable(rows.join(small(wanted), "node").mapInArrow(_sets, f"node {_NODE}, elements binary")).dropDuplicates(["node"])


def _verified(pairs: DataFrame, rows: DataFrame, signatures: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. rows: node, text of all documents."""
    sides = [signatures.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("octave").alias(f"o{s}"), F.col("wide").alias(f"w{s}")) for s in ("a", "b")]
    # The signatures of a pair in the width of the smaller octave; each differing bit is an element of one set alone.
    half = "zip_with(slice({0}, 1, size({0}) div 2), slice({0}, size({0}) div 2 + 1, size({0}) div 2), (x, y) -> x ^ y)"
    differ = F.expr(f"aggregate(zip_with(if(oa <= ob, wa, {half.format('wa')}), if(ob <= oa, wb, {half.format('wb')}), (x, y) -> cast(bit_count(x ^ y) as long)), 0L, (s, x) -> s + x)")
    sized = (5 * F.col("na") >= 4 * F.col("nb")) & (5 * F.col("nb") >= 4 * F.col("na")) & (F.abs(F.col("oa") - F.col("ob")) <= 1)
    bounded = durable(pairs.join(sides[0], "a").join(sides[1], "b").where(sized).where(F.col("na") + F.col("nb") >= 9 * differ).select("a", "b"))
    found = _sets_of(bounded.select(F.col("a").alias("node")).unionByName(bounded.select(F.col("b").alias("node"))), rows)
    full = bounded.join(found.select(F.col("node").alias("a"), F.col("elements").alias("x")), "a").join(found.select(F.col("node").alias("b"), F.col("elements").alias("y")), "b")
    return full.select("a", "b", "x", "y").mapInArrow(_intersect, f"a {_NODE}, b {_NODE}")


def _key() -> tuple[Column, Column]:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("d"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("t")


def _keyed(docs: DataFrame) -> DataFrame:
    """node: doc_id and a hash of the text, which holds whatever the partitioning of a later pass; repeated rows share it."""
    return docs.select(F.struct(*_key()).alias("node"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _between_components(members: DataFrame, signatures: DataFrame, rows: DataFrame) -> DataFrame:
    """Links a, b that join the components of documents that share a tile: of all pairs of fitting sizes between them that pass
    the bound of the bit counts, those that are similar enough, less those that earlier ones make needless. members: k,
    node, root; rows: node, text of all documents."""
    # Only tiles with more than one component go on.
    whose = [F.xxhash64("node"), F.xxhash64(F.lit(1), "node")]
    tiles = members.groupBy("k").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n"), F.bit_xor(whose[0]).alias("x"), F.bit_xor(whose[1]).alias("y"))
    # Tiles of the same documents have the same pairs; one of them is enough.
    mixed = durable(tiles.where("lo != hi").groupBy("lo", "n", "x", "y").agg(F.min("k").alias("k")).select("k", "lo", "n"))
    tiles = members.join(mixed.select("k", "lo"), "k").join(signatures, "node").select("k", "lo", "node.d", "node.t", F.col("root.d").alias("rd"), F.col("root.t").alias("rt"), "n", "octave", "wide")
    # A family's tiles meet in two tasks, which get each of its sets once and remember the pairs they have compared.
    group = ["lod", "lot", "half", "i", "j"]
    parts = dealt(tiles, mixed, "k", "t", near=[F.col("lo"), F.pmod("k", F.lit(2))]).select(F.col("lo.d").alias("lod"), F.col("lo.t").alias("lot"), F.pmod("k", F.lit(2)).alias("half"), "i", "j", "k", "d", "t", "side", "rd", "rt", "n", "octave", "wide")
    # Only documents with a possible pair need their sets.
    split = durable(parts.mapInArrow(_possible, _TILE_ROW))
    used = split.select(*group, F.struct("d", "t").alias("node")).distinct()
    sets = used.join(_sets_of(used.select("node"), rows), "node").select(*group, "node.d", "node.t", "elements")
    tasks = max(8, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Nulls come first in the order: a family's sets before its tiles.
    both = split.unionByName(sets, allowMissingColumns=True).repartition(tasks, *group).sortWithinPartitions(*group, "k")
    found = both.mapInArrow(_across, "d bigint, t bigint, d2 bigint, t2 bigint")
    a, b = F.struct("d", "t"), F.struct(F.col("d2").alias("d"), F.col("t2").alias("t"))
    return found.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def _joined(roots: DataFrame, more: DataFrame) -> DataFrame:
    """roots (node, root) after more links (a, b), by the components of the roots that meet."""
    if more.isEmpty():
        return roots
    one, two = (roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in ("a", "b"))
    met = more.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    top = components(met).select(F.col("node").alias("root"), F.col("root").alias("top"))
    moved = roots.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return durable(moved.unionByName(top.select(F.col("root").alias("node"), F.col("top").alias("root"))).distinct())


def link(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For docs (doc_id, text): members (d, t, n: one row per row of docs) and roots (node, root) of linked documents."""
    with temporary(docs.sparkSession) as keep:
        members, roots = _link(docs)
        return keep(durable(members)), keep(roots)


def _link(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = _keyed(docs)
    survey = durable(rows.select("node.d", "node.t", "text").mapInArrow(_survey, "d bigint, t bigint, n bigint, octave int, wide array<bigint>, slice int, counts binary"))
    levels, total = rarity(survey.where("slice is not null"))
    shards = max(4, -(-total // SHARD_SHINGLES))
    signed = survey.where("slice is null")
    signatures = signed.select(F.struct("d", "t").alias("node"), "n", "octave", "wide").dropDuplicates(["node"])
    tiles = rows.select("node.d", "node.t", "text").mapInArrow(_tiles(levels, shards), "shard int, payload binary")
    near = tiles.repartitionById(shards, "shard").mapInArrow(_neighbours, "kind string, k bigint, d bigint, t bigint, d2 bigint, t2 bigint, n bigint")
    near = durable(near)
    pair = [F.struct("d", "t").alias("a"), F.struct(F.col("d2").alias("d"), F.col("t2").alias("t")).alias("b")]
    equal = near.where("kind = 'E'").select(*pair).distinct()
    compared = durable(near.where("kind = 'C'").select(*pair).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = durable(equal.unionByName(_verified(compared, rows, signatures)))
    roots = components(links)
    grouped = near.where("kind = 'G'").select("k", F.struct("d", "t").alias("node"), "n")
    for last in (False, True):
        members = grouped.join(roots, "node", "left").select("k", "node", "n", F.coalesce("root", "node").alias("root"))
        if last:
            roots = _joined(roots, durable(_between_components(durable(members.drop("n")), signatures, rows)))
        else:
            # Neighbours by size in a tile: they join most of what the first comparisons left apart.
            by_size = Window.partitionBy("k", F.floor(F.log("n") / math.log(1.25))).orderBy("n", "node")
            with_next = members.select("node", "n", "root", F.lead(F.struct("node", "n", "root")).over(by_size).alias("next"))
            found = with_next.where("root != next.root and 5 * n >= 4 * next.n").select(F.least("node", "next.node").alias("a"), F.greatest("node", "next.node").alias("b"))
            pairs = durable(found.distinct().join(compared, ["a", "b"], "left_anti"))
            roots = _joined(roots, durable(_verified(pairs, rows, signatures)))
    return signed.select("d", "t", "n"), roots


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id long, text string; others are ignored): doc_id, n_shingles, component_id.

    A-Z are lower-cased; with fewer than five words the whole sequence is the only shingle. Documents link when
    100 * intersection >= 80 * union of their sets; those without words (null, empty) link with nothing.
    component_id is the smallest doc_id that links reach. Repeated rows with the same doc_id and text are one document
    and get equal rows; a null doc_id is larger than any other. An empty table gives an empty result.
    """
    members, roots = link(docs)
    root = F.coalesce(F.col("root.d"), F.col("d"))
    out = members.join(roots, F.struct("d", "t") == F.col("node"), "left")
    return out.select(F.nullif("d", F.lit(_NONE)).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif(root, F.lit(_NONE)).alias("component_id"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all columns as they were, but of each group of linked documents only the one with the smallest doc_id.

    Documents without words stay. Repeated rows with the same doc_id and text are one document and stay or go together; a
    null doc_id is larger than any other. Extra columns may have any names; an empty table stays empty.
    """
    _, roots = link(docs)
    gone = roots.where("node != root").select(F.col("node.d").alias("d"), F.col("node.t").alias("t"))
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_key())
    return inner.join(gone, ["d", "t"], "left_anti").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
