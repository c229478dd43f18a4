"""Language-model scoring with a hierarchical Pitman-Yor model whose seating is sampled by Gibbs sweeps.

A token's restaurant is that of its context, the word before it (or the start of a text), every word with its own; all of
them share one parent restaurant, over the uniform distribution of the known tokens and one unknown. Tables of the
restaurants are customers of the parent.

Contexts are dealt to shards by hash, so a restaurant with all its dishes (context, word) is in one shard; words are dealt
to roots, which hold the parent's dishes. In a sweep the shards tell the roots how many tables each word has with them,
the roots seat the parent's tables and answer with each word's customers and tables, and each shard draws the number of
tables of every dish from its conditional distribution given the others (by generalised Stirling numbers up to EXACT
customers, by seating in blocks above). All dishes of a sweep are drawn from the totals of the sweep before. The
predictive probabilities of the last SAMPLES sweeps are averaged and used for the scores.

Scale: two passes over the texts. Counts and postings go to the shards in sorted, packed payloads; the number of shards
follows the number of documents, and a payload gathers so many tokens that their number stays in proportion to the text.
Counts of a frequent context are merged in groups first and at most a dish a word; its postings go to several tasks,
each with a copy of the shard's finished probabilities. The state of a sweep is written, so the next one reads only that.
Words are told apart by 48 bits of a hash.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.blocks import Block, U, blocks, distinct, mix, pack, returning, unpack
from weftline.llm.scratch import discard, durable, temporary

SWEEPS = 6
SAMPLES = 3
EXACT = 200
STRENGTH, PARENT_STRENGTH = 1.0, 10.0
SHARD_DOCS = 4000
#: Tokens gathered before they are dealt to the shards: so many a shard, between the two bounds.
PAYLOAD_TOKENS, LEAST_TOKENS, MOST_TOKENS = 256, 300_000, 1_500_000
#: Counts of so many rounds of gathering are merged before the shards get them.
MERGED = 64
#: Occurrences of a shard's dishes that one task scores.
TASK_USES = 8_000_000
SEED = 5
_END = U(0x1B873593CC9E)
_48 = U(16)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text, modulo 5, is 1; a null id is not."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))


def tokens(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word and each text's end: its context (0 at the start of a text), its hash and its document."""
    n = block.n_words + 1
    ends = np.cumsum(n) - 1
    w = np.full(int(n.sum()), _END, U)
    inner = np.ones(len(w), bool)
    inner[ends] = False
    w[inner] = np.maximum(block.hashes >> _48, U(1))
    u = np.empty(len(w), U)
    u[1:] = w[:-1]
    u[ends - n + 1] = 0
    return u, w, np.repeat(np.arange(block.n), n)


def dish_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """48 bits that tell a shard's dishes apart."""
    return mix(mix(u + U(1)) + w * U(0x9E3779B97F4A7C15)) >> _48


def _shard(u: np.ndarray, shards: int) -> np.ndarray:
    return (mix(u ^ U(0x5851F42D4C957F2D)) % U(shards)).astype(np.int64)


def _delta(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=U(0))


def _starts(*sorted_: np.ndarray) -> np.ndarray:
    """Where a new combination begins in arrays sorted together."""
    if not len(sorted_[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(sorted_[0]), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in sorted_])
    return np.flatnonzero(new)


def _gathered(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[tuple[int, tuple[np.ndarray, ...], list[tuple]]]:
    """Number, (u, w, document, held) of the tokens and (ids, missing, held, n_tokens) of the documents of each round."""
    quota = min(max(PAYLOAD_TOKENS * shards, LEAST_TOKENS), MOST_TOKENS)
    number = (TaskContext.get().partitionId() << 32) if TaskContext.get() else 0
    kept, docs, size, first = [], [], 0, 0

    def flush():
        u, w, doc, held = (np.concatenate(x) for x in zip(*kept, strict=True))
        return number, (u, w, doc, held), [np.concatenate(x) for x in zip(*docs, strict=True)]

    for b in batches:
        ids, missing = b.column("doc_id").fill_null(0).to_numpy(), b.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        held = b.column("held").to_numpy(zero_copy_only=False)
        for block in blocks(b.column("text")):
            u, w, doc = tokens(block)
            own = slice(block.first, block.first + block.n)
            kept.append((u, w, (doc + first).astype(np.uint32), held[own][doc]))
            docs.append((ids[own].astype(np.int64), missing[own].astype(np.uint8), held[own].astype(np.uint8), (block.n_words + 1).astype(np.int64)))
            size, first = size + len(u), first + block.n
            if size >= quota:
                yield flush()
                number, size, first = number + 1, 0, 0
                kept.clear()
                docs.clear()
    if kept:
        yield flush()


def _packed_counts(u: np.ndarray, w: np.ndarray, c: np.ndarray) -> bytes:
    """Dishes sorted by context and word, a context's hash once."""
    at = _starts(u)
    return pack(_delta(u[at]), np.diff(np.r_[at, len(u)]).astype(np.uint32), w, c.astype(np.uint32))


def _unpacked_counts(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    u, n, w, c = unpack(payload)
    return np.repeat(np.cumsum(u, dtype=U), n), w, c.astype(np.int64)


def _summed(u: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((w, u))
    u, w, c = u[order], w[order], c[order]
    at = _starts(u, w)
    return u[at], w[at], np.add.reduceat(c, at) if len(at) else c


_COUNTS = "shard int, part long, uses long, payload binary"


def _count(shards: int) -> Callable:
    """For each round of tokens and shard: its dishes with their customers, none where only held-out documents have them."""

    @returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (u, w, _, held), _ in _gathered(batches, shards):
            shard = _shard(u, shards)
            order = np.argsort(shard, kind="stable")
            u, w, c = u[order], w[order], (~held[order]).astype(np.int64)
            cuts, rows = np.searchsorted(shard[order], np.arange(shards + 1)), []
            for s in np.flatnonzero(np.diff(cuts)):
                part = slice(cuts[s], cuts[s + 1])
                rows.append((s, number, cuts[s + 1] - cuts[s], _packed_counts(*_summed(u[part], w[part], c[part]))))
            yield _rows(rows, _COUNTS)

    return run


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    names, types = zip(*[x.split(" ") for x in schema.split(", ")], strict=True)
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))


def _all_rows(batches: Iterator[pa.RecordBatch]) -> list[dict]:
    return [r for b in batches for r in b.to_pylist()]


@returning
def _merge_some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each shard in the partition."""
    kept: dict[int, list] = {}
    for r in _all_rows(batches):
        kept.setdefault(r["shard"], []).append(r)
    for s, rows in kept.items():
        merged = _summed(*[np.concatenate(x) for x in zip(*[_unpacked_counts(r["payload"]) for r in rows], strict=True)])
        yield _rows([(s, 0, sum(r["uses"] for r in rows), _packed_counts(*merged))], _COUNTS)


#: A shard's row, or what it asks a root (root and ask set). ones, twos: dishes with so many customers.
_STATE = "shard int, uses long, ones long, twos long, fixed binary, state binary, root int, ask binary"


def _asks(shard: int, words: np.ndarray, roots: int, *sums: np.ndarray) -> list[tuple]:
    """For each root its words in order and their sums in this shard."""
    of = (mix(words) % U(roots)).astype(np.int64)
    out = []
    for r in distinct(of):
        i = np.flatnonzero(of == r)
        out.append((shard, None, None, None, None, None, int(r), pack(_delta(words[i]), *[x[i].astype(np.uint64) for x in sums])))
    return out


def _merge(roots: int) -> Callable:
    """Of a shard's counts: its row, one table a dish, and what it asks."""

    @returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _all_rows(batches)
        if not rows:
            return
        u, w, c = _summed(*[np.concatenate(x) for x in zip(*[_unpacked_counts(r["payload"]) for r in rows], strict=True)])
        at, words = _starts(u), distinct(w)
        wi = np.searchsorted(words, w)
        t = np.minimum(c, 1)
        # Dishes in the order of context and word, which takes fewest bytes; their keys follow from the hashes.
        fixed = pack(_delta(u[at]), np.diff(np.r_[at, len(u)]).astype(np.uint32), wi.astype(np.uint32), c.astype(np.uint32), _delta(words))
        shard, uses = rows[0]["shard"], sum(r["uses"] for r in rows)
        own = (shard, uses, int((c == 1).sum()), int((c == 2).sum()), fixed, pack(t.astype(np.uint32)), None, None)
        per_word = [np.bincount(wi, weights=x, minlength=len(words)) for x in (t, c)]
        yield _rows([own, *_asks(shard, words, roots, *per_word)], _STATE)

    return run


def stirling(d: float, size: int = EXACT) -> np.ndarray:
    """log of the generalised Stirling numbers S(c, t) with discount d, for c and t up to size."""
    s = np.full((size + 1, size + 2), -np.inf)
    s[0, 0] = 0.0
    for c in range(size):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore"):
            stay = s[c, 1 : c + 2] + np.log(np.maximum(c - t * d, 0))
        s[c + 1, 1 : c + 2] = np.logaddexp(s[c, : c + 1], stay)
    return s


def draw_tables(c: np.ndarray, others: np.ndarray, p: np.ndarray, d: float, strength: float, table: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A number of tables for each dish with c customers, others tables in its restaurant and parent probability p.

    P(t) is proportional to S(c, t) p**t (strength + d others)(strength + d (others + 1)) ... over t factors.
    """
    t = np.minimum(c, 1)
    start = strength + d * others
    many = np.flatnonzero(c > 1)
    many = many[np.argsort(c[many], kind="stable")]
    sizes = c[many]
    for k in range(2, int(min(EXACT, sizes.max(initial=0))) + 1):
        i = many[np.searchsorted(sizes, k) : np.searchsorted(sizes, k, "right")]
        step = max(1, 4_000_000 // k)
        for lo in range(0, len(i), step):
            j = i[lo : lo + step]
            steps = np.log(start[j][:, None] + d * np.arange(k)[None]) + np.log(p[j])[:, None]
            w = np.cumsum(steps, axis=1) + table[k, 1 : k + 1][None]
            w = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
            t[j] = 1 + (w < (rng.random(len(j)) * w[:, -1])[:, None]).sum(axis=1)
    big = many[np.searchsorted(sizes, EXACT, "right") :]
    if len(big):
        x, own = np.full(len(big), 1.0), np.ones(len(big), np.int64)
        while True:
            block = np.minimum(np.ceil(x * 0.1), c[big] - x)
            if not (block > 0).any():
                break
            fresh = (start[big] + d * own) * p[big]
            own += rng.binomial(np.maximum(block, 0).astype(np.int64), np.clip(fresh / (fresh + np.maximum(x - d * own, 0.1)), 0, 1))
            x += np.maximum(block, 0)
        t[big] = np.minimum(own, c[big])
    return t


#: kind 0: a root's answer to a shard; 1: the root's own state; 2: its sums.
_ANSWER = "kind int, shard int, root int, payload binary"


def _root(model: dict | None, sweep: int) -> Callable:
    """Of one root's questions and state: its answers (customers, tables, training tokens of each word asked for)."""

    @returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _all_rows(batches)
        asked = [(r["shard"], unpack(r["ask"])) for r in rows if r["ask"] is not None]
        if not asked:
            return
        asked = [(s, np.cumsum(x[0], dtype=U), x[1:]) for s, x in sorted(asked, key=lambda a: a[0])]
        words = distinct(np.concatenate([x[1] for x in asked]))
        at = [np.searchsorted(words, x[1]) for x in asked]
        summed = lambda i: sum(np.bincount(a, weights=x[2][i], minlength=len(words)) for a, x in zip(at, asked, strict=True)).astype(np.int64)
        root, customers = rows[0]["root"], summed(0)
        if model is None:
            known, tables = summed(1), np.minimum(customers, 1)
        else:
            known, before = (x.astype(np.int64) for x in unpack(next(r["payload"] for r in rows if r["ask"] is None)))
            rng = np.random.default_rng([SEED, 1, root, sweep])
            tables = draw_tables(customers, model["tables"] - before, np.full(len(words), 1.0 / model["types"]), model["d0"], PARENT_STRENGTH, stirling(model["d0"]), rng)
        for a, (s, _, _) in zip(at, asked, strict=True):
            yield _rows([(0, s, root, pack(customers[a].astype(np.uint64), tables[a].astype(np.uint64), known[a].astype(np.uint64)))], _ANSWER)
        sums = np.array([customers.sum(), tables.sum(), (customers == 1).sum(), (customers == 2).sum(), (known > 0).sum(), known.sum()], np.float64)
        yield _rows([(1, None, root, pack(known.astype(np.uint64), tables.astype(np.uint64))), (2, None, root, sums.tobytes())], _ANSWER)

    return run


class Seated:
    """A shard's dishes, in the order of context and word, with the answers of all roots."""

    def __init__(self, rows: list[dict], model: dict, roots: int):
        own = next(r for r in rows if r["fixed"] is not None)
        contexts, runs, wi, c, words = unpack(own["fixed"])
        self.shard, self.contexts, self.words = own["shard"], np.cumsum(contexts, dtype=U), np.cumsum(words, dtype=U)
        self.ui, self.wi, self.c = np.repeat(np.arange(len(runs)), runs), wi.astype(np.int64), c.astype(np.int64)
        t, *self.samples = unpack(own["state"])
        self.t, self.model = t.astype(np.int64), model
        of = (mix(self.words) % U(roots)).astype(np.int64)
        self.customers, self.tables, self.known = np.zeros((3, len(self.words)), np.int64)
        for r in rows:
            if r["payload"] is not None:
                i = np.flatnonzero(of == r["root"])
                self.customers[i], self.tables[i], self.known[i] = (x.astype(np.int64) for x in unpack(r["payload"]))
        self.in_context = np.bincount(self.ui, weights=self.c)

    @property
    def key(self) -> np.ndarray:
        return dish_key(self.contexts[self.ui], self.words[self.wi])

    def parent(self, customers: np.ndarray, tables: np.ndarray, model: dict) -> np.ndarray:
        """The parent's probability of each word."""
        d0 = model["d0"]
        return (customers - d0 * tables + (PARENT_STRENGTH + d0 * model["tables"]) / model["types"]) / (PARENT_STRENGTH + model["customers"])

    def predictive(self, t: np.ndarray | None = None, customers: np.ndarray | None = None, tables: np.ndarray | None = None, model: dict | None = None) -> np.ndarray:
        """The probability of each dish's word after its context, in the seating given or else the present one."""
        if t is None:
            t, customers, tables, model = self.t, self.customers, self.tables, self.model
        d, parent = model["d"], self.parent(customers, tables, model)
        return (self.c - d * t + (STRENGTH + d * np.bincount(self.ui, weights=t)[self.ui]) * parent[self.wi]) / (STRENGTH + self.in_context[self.ui])

    def add_sample(self) -> None:
        self.samples += [x.astype(np.uint32) for x in (self.t, self.customers, self.tables)]

    def averaged(self, models: list[dict]) -> np.ndarray:
        """The mean of the predictive probabilities of the samples, whose totals are in models."""
        total = np.zeros(len(self.c))
        for i, model in enumerate(models):
            total += self.predictive(*[x.astype(np.float64) for x in self.samples[3 * i : 3 * i + 3]], model)
        return total / len(models)

    def sweep(self, number: int) -> None:
        rng = np.random.default_rng([SEED, 0, self.shard, number])
        others = np.bincount(self.ui, weights=self.t)[self.ui] - self.t
        self.t = draw_tables(self.c, others, self.parent(self.customers, self.tables, self.model)[self.wi], self.model["d"], STRENGTH, stirling(self.model["d"]), rng)


def _seat(model: dict, number: int, roots: int, sample: bool) -> Callable:
    """One sweep of a shard: its row with the new seating, and what it asks."""

    @returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _all_rows(batches)
        if not rows:
            return
        own = next(r for r in rows if r["fixed"] is not None)
        x = Seated(rows, model, roots)
        if sample:
            x.add_sample()
        x.sweep(number)
        new = (own["shard"], own["uses"], own["ones"], own["twos"], own["fixed"], pack(x.t.astype(np.uint32), *x.samples), None, None)
        yield _rows([new, *_asks(x.shard, x.words, roots, np.bincount(x.wi, weights=x.t, minlength=len(x.words)))], _STATE)

    return run


def _finish(models: list[dict], roots: int) -> Callable:
    """A shard's dishes by key, with the logarithm of their averaged probabilities and their words' training tokens."""

    @returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _all_rows(batches)
        if rows:
            x = Seated(rows, models[-1], roots)
            x.add_sample()
            key = x.key
            order = np.argsort(key, kind="stable")
            log = np.log10(x.averaged(models)).astype(np.float32)
            yield _rows([(x.shard, next(r["uses"] for r in rows if r["uses"] is not None), pack(_delta(key[order]), log[order], x.known[x.wi][order].astype(np.uint64)))], "shard int, uses long, payload binary")

    return run


class Model:
    """The trained model: model (its numbers), finished (a row a shard) and, with keep_state, the last state and answers."""

    def __init__(self, rows: DataFrame, shards: int, sweeps: int, samples: int, keep_state: bool = False):
        """rows: doc_id, text, held, of which those not held train."""
        spark = rows.sparkSession
        self.shards, self.roots = shards, max(4, math.isqrt(shards))
        with temporary(spark) as keep:
            counts = rows.mapInArrow(_count(shards), _COUNTS)
            if shards >= 2 * MERGED:
                groups = F.pmod(F.xxhash64("part"), F.lit(shards // MERGED))
                counts = counts.repartition(4 * shards, "shard", groups).mapInArrow(_merge_some, _COUNTS)
            state = durable(counts.repartitionById(shards, "shard").mapInArrow(_merge(self.roots), _STATE))
            of = state.agg(F.sum("ones"), F.sum("twos")).first()
            self.numbers = {"d": self._discount(*[x or 0 for x in of])}
            answers = self._answers(state, None, None, 0)
            sampled = []
            for k in range(1, sweeps + 1):
                # What is sampled is the seating before the sweep, to which the answers belong.
                sample = k > sweeps - samples + 1
                sampled += [dict(self.numbers)] * sample
                new = durable(self._with(state, answers).mapInArrow(_seat(dict(self.numbers), k, self.roots, sample), _STATE))
                told = self._answers(new, answers, dict(self.numbers), k)
                discard(spark, state, answers)
                state, answers = new, told
            sampled.append(dict(self.numbers))
            self.finished = keep(durable(self._with(state, answers).mapInArrow(_finish(sampled, self.roots), "shard int, uses long, payload binary")))
            self.state = (keep(state), keep(answers)) if keep_state else None

    @staticmethod
    def _discount(one: float, two: float) -> float:
        return min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.5

    def _answers(self, state: DataFrame, before: DataFrame | None, model: dict | None, sweep: int) -> DataFrame:
        asked = state.where("ask is not null").select("root", "shard", "ask", F.lit(None).cast("binary").alias("payload"))
        if before is not None:
            asked = asked.unionByName(before.where("kind = 1").select("root", F.lit(None).cast("int").alias("shard"), F.lit(None).cast("binary").alias("ask"), "payload"))
        out = durable(asked.repartitionById(self.roots, "root").mapInArrow(_root(model, sweep), _ANSWER))
        sums = sum((np.frombuffer(r["payload"]) for r in out.where("kind = 2").select("payload").collect()), np.zeros(6))
        self.numbers |= {"customers": float(sums[0]), "tables": float(sums[1])}
        if before is None:
            self.numbers |= {"d0": self._discount(sums[2], sums[3]), "types": int(sums[4]) + 1, "tokens": int(sums[5])}
        return out

    def _with(self, state: DataFrame, answers: DataFrame) -> DataFrame:
        own = state.where("ask is null").select("shard", "uses", "ones", "twos", "fixed", "state", F.lit(None).cast("int").alias("root"), F.lit(None).cast("binary").alias("payload"))
        got = answers.where("kind = 0").select("shard", "root", "payload")
        return own.unionByName(got, allowMissingColumns=True).repartitionById(self.shards, "shard")


_ROW = "slot int, kind int, part long, payload binary"


def _postings(shards: int, copies: np.ndarray) -> Callable:
    """Rows of kind 1: for a round of tokens and a slot, its dishes and the documents they are in; of kind 2: its documents."""
    first = np.cumsum(copies) - copies

    @returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (u, w, doc, _), docs in _gathered(batches, shards):
            shard, key = _shard(u, shards), dish_key(u, w)
            order = np.lexsort((key, shard))
            key, doc = key[order], doc[order]
            cuts, rows = np.searchsorted(shard[order], np.arange(shards + 1)), []
            for s in np.flatnonzero(np.diff(cuts)):
                part = slice(cuts[s], cuts[s + 1])
                at = _starts(key[part])
                rows.append((first[s] + number % copies[s], 1, number, pack(_delta(key[part][at]), np.diff(np.r_[at, cuts[s + 1] - cuts[s]]).astype(np.uint32), doc[part])))
            rows.append((number % len(copies), 2, number, pack(*docs)))
            yield _rows(rows, _ROW)

    return run


_SUMS = "part long, kind int, payload binary"


def _score(model: dict) -> Callable:
    """Of a slot's rows, the dishes first: each round's sums by document, or its documents as they came."""
    n, types = model["tokens"], model["types"]

    @returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dishes = log = count = None
        for b in batches:
            out = []
            for kind, part, x in zip(*[b.column(k).to_pylist() for k in ("kind", "part", "payload")], strict=True):
                if kind == 0:
                    dishes, log, count = unpack(x)
                    dishes = np.cumsum(dishes, dtype=U)
                elif kind == 2:
                    out.append((part, 2, x))
                else:
                    delta, times, doc = unpack(x)
                    at = np.repeat(np.searchsorted(dishes, np.cumsum(delta, dtype=U)), times)
                    ids, own = np.unique(doc, return_inverse=True)
                    c = count[at]
                    sums = [np.bincount(own, weights=v, minlength=len(ids)) for v in (log[at], np.log10((c + 0.5) / (n + 0.5 * types)), c > 0)]
                    out.append((part, 1, pack(ids, *sums)))
            if out:
                yield _rows(out, _SUMS)

    return run


_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _collect(n_train: int) -> Callable:
    """Of rows sorted by round: a row for each document with its sums over all shards."""

    def close(parts: list[list[np.ndarray]], docs: list[np.ndarray] | None) -> Iterator[pa.RecordBatch]:
        if docs is not None:
            ids, missing, held, n = docs
            at = np.concatenate([p[0] for p in parts])
            score, base, known = (np.bincount(at, weights=np.concatenate([p[i] for p in parts]), minlength=len(ids)) for i in (1, 2, 3))
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=missing.astype(bool)), pa.array(held.astype(bool)), pa.array(n), pa.array(np.rint(known).astype(np.int64)), pa.array(np.full(len(ids), n_train)), pa.array(base), pa.array(score)], [x.split(" ")[0] for x in _RESULT.split(", ")])

    @returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, docs = None, [], None
        for b in batches:
            for part, kind, x in zip(*[b.column(k).to_pylist() for k in ("part", "kind", "payload")], strict=True):
                if part != at:
                    yield from close(parts, docs)
                    at, parts, docs = part, [], None
                if kind == 2:
                    docs = unpack(x)
                else:
                    parts.append(unpack(x))
        yield from close(parts, docs)

    return run


def score(docs: DataFrame, sweeps: int = SWEEPS, samples: int = SAMPLES, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row per row of docs (doc_id, text; others are ignored): doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score, perplexity.

    A null or empty text is its end token alone; whole texts of any length are read; repeated rows count as often as they
    come and get equal scores; rows with a null doc_id train. Without training documents all tokens are unknown. An empty
    table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held"))
    shards = max(4, -(-docs.count() // shard_docs))
    model = Model(rows, shards, sweeps, samples)
    copies = np.ones(shards, np.int64)
    for r in model.finished.select("shard", "uses").collect():
        copies[r["shard"]] = -(-r["uses"] // TASK_USES)
    slots = docs.sparkSession.createDataFrame([(s, int(lo), int(lo + n - 1)) for s, (lo, n) in enumerate(zip(np.cumsum(copies) - copies, copies, strict=True))], "shard int, lo int, hi int")
    first = model.finished.join(F.broadcast(slots), "shard").select(F.explode(F.sequence("lo", "hi")).alias("slot"), F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("part"), "payload")
    dealt = first.unionByName(rows.mapInArrow(_postings(shards, copies), _ROW)).repartitionById(int(copies.sum()), "slot").sortWithinPartitions("kind")
    sums = dealt.mapInArrow(_score(model.numbers), _SUMS)
    tasks = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = sums.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(_collect(model.numbers["tokens"]), _RESULT)
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
