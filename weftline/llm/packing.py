"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands.

Documents are tokenized once; longer ones are cut into full sequences and a shorter first piece, so that one piece a
document is left to pack. Those pieces are dealt by a hash into shards of about SHARD, each packed on its own. A shard
has ISLANDS populations of best-fit packings in several orders, evolved in tasks of their own: a crossover injects whole well-filled bins of one parent into
another, removes the bins that hold duplicates and best-fits the displaced documents. Between rounds the elite of each
island migrates to the next one of its shard; the best island's packing is taken at the end.

Scale: one pass over the texts, whose token ids never leave the task unless asked for; the search moves 16 bytes a
document and shards are independent, so there is no step over all of them.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.blocks import returning
from weftline.llm.scratch import durable

LENGTH = 2048
SHARD = 4096
ISLANDS = 2
ROUNDS = 2
POPULATION = 4
CROSSOVERS = 40
#: Bins filled to this share may be injected.
WELL_FILLED = 0.97
SEED = 13
#: Texts of these characters have the same ids from both libraries (tests compare them); tiktoken is four times as fast.
_COMMON = regex.compile(r"[\x00-ɏ]*")


class Encoder:
    """Token ids of texts by byte_bpe_50k.json; special tokens' strings are ordinary text."""

    def __init__(self, vocabulary: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(vocabulary)
        self.slow.encode_special_tokens = True
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        return self.fast.encode_ordinary(text) if _COMMON.fullmatch(text) else self.slow.encode(text, add_special_tokens=False).ids


def default_vocabulary() -> tuple[str, str, str]:
    """Paths of the vocabulary for both libraries and the pattern of its words, on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def cut(total: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: all full but for the first, which may be shorter."""
    first = total % length or length
    return [(0, first)] + [(s, length) for s in range(first, total, length)]


def _pieces(vocabulary: tuple[str, str, str] | None, length: int, with_ids: bool):
    @returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(*(vocabulary or default_vocabulary()))
        for b in batches:
            columns: list[list] = [[] for _ in range(6 + with_ids)]
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), 0], "<u4")
                for piece, (start, n) in enumerate(cut(len(ids), length)):
                    part = ids[start : start + n]
                    for column, x in zip(columns, (doc_id, piece, start, n, zlib.crc32(part.tobytes()), n == length, part), strict=False):
                        column.append(x)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "whole", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names[: len(columns)])

    return run


def best_fit(sizes: list[int], items: list[int], place: np.ndarray, load: list[int], length: int) -> None:
    """Put the items (largest first) into the fullest bins they fit in, opening new ones; place and load are changed."""
    open_bins: dict[int, list[int]] = {}
    mask = 0
    for b, x in enumerate(load):
        if 0 < x < length:
            open_bins.setdefault(length - x, []).append(b)
            mask |= 1 << (length - x)
    for i in items:
        n = sizes[i]
        room = mask >> n
        if room:
            gap = n + (room & -room).bit_length() - 1
            stack = open_bins[gap]
            b = stack.pop()
            if not stack:
                mask &= ~(1 << gap)
        else:
            gap, b = length, len(load)
            load.append(0)
        place[i] = b
        load[b] += n
        gap -= n
        if gap:
            open_bins.setdefault(gap, []).append(b)
            mask |= 1 << gap


def fitness(sizes: np.ndarray, place: np.ndarray, length: int) -> tuple[int, float]:
    """Fewer bins first, then the mean square of the fill, which favours full bins; smaller is better."""
    load = np.bincount(place, weights=sizes)
    load = load[load > 0]
    return len(load), -float(((load / length) ** 2).mean()) if len(load) else 0.0


def crossover(sizes: np.ndarray, a: np.ndarray, b: np.ndarray, rng: np.random.Generator, length: int) -> np.ndarray:
    """A packing with some well-filled bins of b and else, as far as they are free of duplicates, the bins of a."""
    load_b = np.bincount(b, weights=sizes)
    good = np.flatnonzero(load_b >= WELL_FILLED * length)
    chosen = np.zeros(len(load_b), bool)
    chosen[good[rng.random(len(good)) < rng.uniform(0.05, 0.3)]] = True
    injected = chosen[b]
    bins_a = a.max(initial=-1) + 1
    broken = np.zeros(bins_a, bool)
    broken[a[injected]] = True
    load_a = np.bincount(a, weights=sizes, minlength=bins_a)
    if bins_a:  # a few of the emptiest bins go too, and some of those that are not full
        broken[np.argsort(load_a)[: 1 + int(rng.integers(0, 8))]] = True
        broken |= (load_a < length) & (rng.random(bins_a) < rng.uniform(0, 0.5))
    child = np.where(injected, bins_a + b, a)
    displaced = np.flatnonzero(broken[a] & ~injected)
    child[displaced] = -1
    used, child[child >= 0] = np.unique(child[child >= 0], return_inverse=True)
    load = np.bincount(child[child >= 0], weights=sizes[child >= 0], minlength=len(used)).astype(int).tolist()
    order = displaced[np.argsort(-sizes[displaced] * rng.uniform(1 - (spread := rng.choice([0.0, 0.1, 0.4])), 1 + spread, len(displaced)), kind="stable")]
    best_fit(sizes.tolist(), order.tolist(), child, load, length)
    return child


def evolve(sizes: np.ndarray, seeds: list[np.ndarray], rng: np.random.Generator, length: int, population: int, crossovers: int) -> tuple[np.ndarray, int, int]:
    """The best packing after the crossovers, the bins of the best one before them, and how many children were kept.

    sizes fall; seeds are packings to start from, joined by best-fit packings: by falling size if there are no seeds, else in
    random orders.
    """
    pool = list(seeds)
    while len(pool) < population:
        place = np.full(len(sizes), -1)
        order = np.argsort(-sizes * rng.uniform(0.5, 1.5, len(sizes)), kind="stable") if pool else np.arange(len(sizes))
        best_fit(sizes.tolist(), order.tolist(), place, [], length)
        pool.append(place)
    scores = [fitness(sizes, x, length) for x in pool]
    start, kept = min(scores)[0], 0
    for _ in range(crossovers):
        x, y = rng.choice(len(pool), 2, replace=False)
        child = crossover(sizes, pool[x], pool[y], rng, length)
        score, worst = fitness(sizes, child, length), max(range(len(pool)), key=scores.__getitem__)
        if score <= scores[worst]:
            pool[worst], scores[worst] = child, score
            kept += 1
    return pool[min(range(len(pool)), key=scores.__getitem__)], start, kept


def _sorted(items: pd.DataFrame) -> pd.DataFrame:
    return items.sort_values(["length", "uid"], ascending=[False, True], kind="stable")


def _placed(items: pd.DataFrame, genome: bytes) -> pd.DataFrame:
    items = _sorted(items)
    items["bin"] = np.frombuffer(genome, np.int32)
    items["offset"] = items.groupby("bin")["length"].cumsum() - items["length"]
    return items[["uid", "shard", "bin", "offset"]].astype("int64")


def _searches(r: int, length: int, population: int, crossovers: int):
    """Round r of an island without and with genomes to start from."""

    def search(key: tuple, own: pd.DataFrame, genomes: list[bytes]) -> pd.DataFrame:
        sizes = _sorted(own)["length"].to_numpy()
        seeds = [np.frombuffer(g, np.int32).astype(np.int64) for g in genomes]
        best, start, kept = evolve(sizes, seeds, np.random.default_rng([SEED, int(key[0]), int(key[1]), r]), length, population, crossovers)
        bins, fill = fitness(sizes, best, length)
        return pd.DataFrame({"shard": [key[0]], "island": [key[1]], "start": [start], "kept": [kept], "migrants": [len(seeds) - bool(seeds)], "bins": [bins], "fill": [fill], "genome": [best.astype(np.int32).tobytes()]})

    def alone(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        return search(key, own, [])

    def visited(key: tuple, own: pd.DataFrame, guests: pd.DataFrame) -> pd.DataFrame:
        return search(key, own, list(guests.sort_values("rank")["genome"]))

    return alone, visited


def search(items: DataFrame, length: int = LENGTH, shard: int = SHARD, islands: int = ISLANDS, rounds: int = ROUNDS, population: int = POPULATION, crossovers: int = CROSSOVERS) -> tuple[DataFrame, list[DataFrame]]:
    """uid, shard, bin, offset for items (uid, length at most that of a sequence), and for each round a row an island: bins
    before and after its crossovers, children kept, migrants taken in."""
    shards = max(1, -(-items.count() // shard))
    # repartition(): adaptive execution would merge these small groups into one task.
    items = items.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)))
    each = durable(items.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).repartition(shards * islands, "shard", "island"))
    elite, history = None, []
    for r in range(rounds):
        alone, visited = _searches(r, length, population, crossovers)
        schema = "shard long, island int, start long, kept long, migrants long, bins long, fill double, genome binary"
        own = each.select("shard", "island", "uid", "length").repartition(shards * islands, "shard", "island").groupBy("shard", "island")
        if elite is None:
            elite = durable(own.applyInPandas(alone, schema))
        else:
            stay = elite.select("shard", "island", F.lit(0).alias("rank"), "genome")
            moved = elite.select("shard", ((F.col("island") + 1) % islands).alias("island"), F.lit(1).alias("rank"), "genome")
            guests = stay.unionByName(moved).repartition(shards * islands, "shard", "island").groupBy("shard", "island")
            elite = durable(own.cogroup(guests).applyInPandas(visited, schema))
        history.append(elite)
    best = elite.groupBy("shard").agg(F.min_by("genome", F.struct("bins", "fill", "island")).alias("genome"))

    def settle(key: tuple, own: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        return _placed(own, found["genome"].iloc[0]) if len(own) else pd.DataFrame({"uid": [], "shard": [], "bin": [], "offset": []})

    by_shard = items.repartition(shards, "shard").groupBy("shard")
    placed = by_shard.cogroup(best.repartition(shards, "shard").groupBy("shard")).applyInPandas(settle, "uid long, shard long, bin long, offset long")
    return placed, history


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: tuple[str, str, str] | None = None, with_ids: bool = False, shard: int = SHARD, islands: int = ISLANDS, rounds: int = ROUNDS, population: int = POPULATION, crossovers: int = CROSSOVERS) -> DataFrame:
    """One row per piece of docs (doc_id, text; others are ignored): doc_id, piece, start, length, ids_crc32,
    sequence_id, offset, and with_ids the token ids.

    A document's ids are those of its text (null: empty) and then 0. vocabulary: paths and pattern as in
    default_vocabulary(), valid on every executor. Repeated rows are documents of their own. Sequence ids of full
    pieces are negative. An empty table gives an empty result.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, whole boolean" + ", ids array<long>" * with_ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Written, which fixes uid and tokenizes once.
    pieces = durable(rows.mapInArrow(_pieces(vocabulary, length, with_ids), schema).withColumn("uid", F.monotonically_increasing_id()))
    placed, _ = search(pieces.where("not whole").select("uid", "length"), length, shard, islands, rounds, population, crossovers)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    full = pieces.where("whole").withColumn("sequence_id", -1 - F.col("uid")).withColumn("offset", F.lit(0).cast("long"))
    rest = pieces.where("not whole").join(placed, "uid").withColumn("sequence_id", F.col("shard") * F.lit(1 << 20) + F.col("bin"))
    return full.select(*columns).unionByName(rest.select(*columns))
