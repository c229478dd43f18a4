"""Whole texts as numpy arrays: words, their hashes and compact binary payloads for shuffles.

A block is a run of documents of one Arrow batch with at most BLOCK_BYTES of text (or one longer document), so that
the arrays made from it stay small whatever the batch size. Words are the runs of [^\\x20\\x09-\\x0D]+ of the UTF-8
bytes; those separators never occur inside a multi-byte character.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard

BLOCK_BYTES = 1 << 20
#: A block's document number fits into 12 bits, which leaves 52 bits of a hash in one sorted 64-bit word.
BLOCK_DOCS = 4096
U = np.uint64
_B = 0x9E3779B97F4A7C15 | 1
_BINV = pow(_B, -1, 1 << 64)

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_tables: dict[str, np.ndarray] = {}


def returning(run: Callable) -> Callable:
    """run, a function of batches, giving unused memory back to the system when a task ends; workers outlive their tasks."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _B and of its inverse modulo 2**64, n of each at least."""
    if len(_tables.get("p", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("p", _B), ("q", _BINV)):
            t = np.full(size, base, U)
            t[0] = 1
            _tables[name] = np.cumprod(t)
    return _tables["p"], _tables["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over all."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each values[start:end], from one running sum; equal runs have equal hashes wherever they stand."""
    p, q = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, U)
    np.cumsum((values.astype(U) + U(1)) * p[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * q[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], U)


def words_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word, eight bytes at a time."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray((len(data) + 1,), U, padded, strides=(1,))
    left = ends - starts
    h = mix(left.astype(U) * U(0xD6E8FEB86659FD93) ^ (eights[starts] & _MASKS[np.minimum(left, 8)]))
    more, at = np.flatnonzero(left > 8), 8
    while len(more):
        h[more] = mix(h[more] * U(0x9FB21C651E98DF25) ^ (eights[starts[more] + at] & _MASKS[np.minimum(left[more] - at, 8)]))
        at += 8
        more = more[left[more] > at]
    return h


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order; sorting is far faster here than numpy's hashing unique()."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


@dataclass
class Block:
    """Documents first..first+n-1 of a batch. first_word[i]:first_word[i+1] are the words of document i."""

    first: int
    n: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first_word: np.ndarray
    hashes: np.ndarray

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first_word)

    def word_doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def blocks(column: pa.Array, lower: bool = True) -> Iterator[Block]:
    """The words of all texts of the column, block after block."""
    data, offsets = raw(column)
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, "right")) - 1
        last = min(max(last, first + 1), n, first + BLOCK_DOCS)
        yield _block(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], first, lower)
        first = last


def _block(data: np.ndarray, offsets: np.ndarray, first: int, lower: bool) -> Block:
    inside = ~SEPARATOR[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Block(first, len(offsets) - 1, data, offsets, starts, ends, np.searchsorted(starts, offsets), words_hash(LOWER[data] if lower else data, starts, ends))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed payload, like bytes of the numbers side by side."""
    head = [np.array([len(arrays)], np.int64)]
    body = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        code = a.dtype.str[1:].encode().ljust(8)
        head.append(np.frombuffer(code, np.int64))
        head.append(np.array([len(a)], np.int64))
        body.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate(head).tobytes() + b"".join(body))


def unpack(payload: bytes) -> list[np.ndarray]:
    """The arrays that pack() got."""
    b = zstandard.ZstdDecompressor().decompress(payload)
    n = int(np.frombuffer(b, np.int64, 1)[0])
    at, out = 8 + 16 * n, []
    for i in range(n):
        kind = np.dtype(b[8 + 16 * i : 16 + 16 * i].decode().strip())
        size = int(np.frombuffer(b, np.int64, 1, 16 + 16 * i)[0])
        out.append(np.frombuffer(b, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size).T.copy().view(kind).reshape(size))
        at += size * kind.itemsize
    return out


def sharded(key: np.ndarray, shards: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of the keys by shard, then key, and (shard, start, end) of the shards present."""
    shard = (mix(key) % U(shards)).astype(np.int64)
    order = np.lexsort((key, shard))
    s = shard[order]
    cut = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
    return order, [(int(s[a]), int(a), int(b)) for a, b in zip(cut, np.r_[cut[1:], len(s)], strict=True)]
