"""Operators against brute force on small tables, with nulls, empty and repeated rows, and clashing column names."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from weftline.llm import cap_filters, components as stars, exact_dedup, language, licenses, mixing, ngram_join, packing, pitman_yor, quality, substring_dedup
from weftline.llm.blocks import blocks, pack, unpack
from weftline.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, uid int, n int, kept int"


def corpus():
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(300)]
    base = [" ".join(rng.choice(vocabulary, 120)) for _ in range(12)]
    texts = [None, "", " \t ", "one", "One two", "one  TWO", "a b c d e", *base]
    for b in base[:6]:
        w = b.split(" ")
        texts += [b.upper() if b.isascii() else b, " ".join(w[:100] + ["x"] * 5 + w[100:]), " ".join(w[20:75] + list(rng.choice(vocabulary, 60)))]
    texts += ["long " * 3000, "spam " * 200, base[0] + "\n" + base[1]]
    rows = [(i, t, ["en", "de", None][i % 3], ["s0", "s0", "s1", None][i % 4], 7, 7, 7) for i, t in enumerate(texts)]
    return [*rows, rows[8], rows[1], (None, base[3], "en", "s1", 7, 7, 7), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def low(t):
    return (t or "").translate(LOWER)


def test_exact(docs, empty):
    got = exact_dedup.exact_duplicates(docs, first_digit=4, wider=2).collect()
    groups = defaultdict(list)
    for r in corpus():
        groups[hashlib.sha256(low(r[1]).encode()).hexdigest()].append(r[0])
    assert Counter(r.text_sha256 for r in got) == {k: len(v) for k, v in groups.items()}
    for r in got:
        ids = [x for x in groups[r.text_sha256] if x is not None]
        assert (r.keep_id, r.group_size) == (max(ids, default=None), len(groups[r.text_sha256]))
    assert Counter(r.text_sha256 for r in got if r.kept) == dict.fromkeys(groups, 1)
    kept = exact_dedup.drop_exact_duplicates(docs, 4, 2)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_duplicates(empty).count() == 0 == exact_dedup.drop_exact_duplicates(empty).count()


def shingle_sets():
    out = {}
    for r in corpus():
        w = WORD.findall(low(r[1]))
        out.setdefault((r[0], r[1]), {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def test_ngram_join(docs, empty):
    sets = shingle_sets()
    linked = {k: {o for o in sets if o != k and sets[k] and 100 * len(sets[k] & sets[o]) >= 80 * len(sets[k] | sets[o])} for k in sets}
    want = Counter()
    for r in corpus():
        seen, queue = set(), [(r[0], r[1])]
        while queue:
            k = queue.pop()
            if k not in seen:
                seen.add(k)
                queue.extend(linked[k])
        ids = [k[0] for k in seen if k[0] is not None]
        want[(r[0], len(sets[(r[0], r[1])]), min(ids, default=None))] += 1
    assert Counter(tuple(r) for r in ngram_join.near_duplicates(docs).collect()) == want
    assert ngram_join.near_duplicates(empty).count() == 0
    assert ngram_join.drop_near_duplicates(docs).columns == docs.columns


def test_substrings(docs, empty):
    words = [(r[0], WORD.findall(r[1] or "")) for r in corpus()]
    first = {}
    for i, w in words:
        for s in range(len(w) - 49 if i is not None else 0):
            k = tuple(w[s : s + 50])
            first[k] = min(i, first.get(k, i))
    want = Counter()
    for i, w in words:
        keep = [True] * len(w)
        for s in range(len(w) - 49 if i is not None else 0):
            if first[tuple(w[s : s + 50])] < i:
                keep[s : s + 50] = [False] * 50
        kept = " ".join(x for x, k in zip(w, keep, strict=True) if k)
        want[(i, len(w), keep.count(False), hashlib.sha256(kept.encode()).hexdigest(), kept)] += 1
    assert sum(k[2] for k in want) > 0
    assert Counter(tuple(r) for r in substring_dedup.substring_dedup(docs).collect()) == want
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_mixing(docs, empty, spark):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (4, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = mixing.mixture(docs, labels).collect()
    sizes = defaultdict(int)
    for r in corpus():
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    total, order = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s or ""))
    open_, target, left = dict(zip(order, (1.0, 2.0, 3.0), strict=True)), {}, float(total)
    while open_:
        level = left / sum(open_.values())
        full = [s for s, w in open_.items() if level * w >= 3 * sizes[s]]
        if not full:
            target |= {s: level * w for s, w in open_.items()}
            break
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            del open_[s]
    assert Counter(r["size"] for r in got) == Counter(len(WORD.findall(r[1] or "")) for r in corpus())
    by_size = {v: target[s] for s, v in sizes.items()}
    for r in got:
        assert r.target == pytest.approx(by_size[r.source_size]) and 0 <= r.taken <= 3 * r["size"]
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mixture(docs, labels).collect()))
    assert mixing.mix(docs, labels).columns == docs.columns and mixing.mixture(empty).count() == 0 == mixing.mix(empty).count()


def test_language(docs, empty, spark):
    rng = np.random.default_rng(0)
    parts = {"aa": ["kala", "moto", "rine", "sul"], "bb": ["xyz", "wqu", "zzt", "qvr"]}
    rows = [(i, " ".join(rng.choice(parts[k], 40)), k) for i, k in enumerate(["aa", "bb"] * 60)]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.learn(known.where(~language.held_out()))
    out = {r.doc_id: r for r in language.identify(known, found).collect()}
    assert sum(out[i].lang_pred == k for i, _, k in rows) >= 118
    other = language.identify(docs, found).collect()
    assert len(other) == len(corpus()) and all(0 <= r.score <= 1 and (r.lang_pred == "und") <= r.rejected for r in other)
    assert language.learn(empty) == {} and language.identify(docs, {}).where("lang_pred != 'und'").count() == 0
    assert language.keep_identified(docs, found).columns == docs.columns


def test_packing(docs, empty):
    got = packing.pack(docs, length=64, shard=16, with_ids=True).collect()
    encode = packing.Encoder(*packing.default_vocabulary())
    want = Counter((r[0], len(encode(r[1] or "")) + 1) for r in corpus())
    assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(k[0] for k in want.elements())
    fill = defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        fill[r.sequence_id].append((r.offset, r.length))
    for parts in fill.values():
        parts.sort()
        assert sum(n for _, n in parts) <= 64 and all(o == sum(n for _, n in parts[:i]) for i, (o, _) in enumerate(parts))
    assert sum(r.length for r in got) == sum(k[1] for k in want.elements())
    assert packing.pack(empty).count() == 0


def test_encoders_agree():
    encode = packing.Encoder(*packing.default_vocabulary())
    rng = np.random.default_rng(3)
    for text in ["", "a" * 3000, "<|endoftext|> x", "  \n\t\r\x0b\x85\xa0 a  b", "it's 12½ ÉÀ'S", *["".join(map(chr, rng.integers(1, 0x24F, 80))) for _ in range(300)]]:
        assert encode.fast.encode_ordinary(text) == encode.slow.encode(text, add_special_tokens=False).ids


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 16))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.vstack([base, base[:15] + rng.standard_normal((15, 16)) * 0.1, base[:3]]))]
    rows += [(100, None), (101, [0.0] * 16), (102, [math.nan] * 16), (103, [None] + [1.0] * 15), (104, []), (105, [1.0, 2.0]), (106, [2.0, 4.0]), (None, rows[0][1]), rows[0]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = cap_filters.near_vectors(df, tile=4).collect()

    def usable(v):
        return v and None not in v and all(map(math.isfinite, v)) and any(v)

    def cosine(v, w):
        return np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) if usable(v) and usable(w) and len(v) == len(w) else 0

    want = sum(cosine(v, w) >= 0.95 for i, (_, v) in enumerate(rows) for j, (_, w) in enumerate(rows) if i != j)
    assert 0.9 * want <= sum(r.n_links for r in got) <= want
    assert len(got) == len(rows) and all(r.n_links == 0 and r.component_id == r.vec_id for r in got if r.vec_id in (100, 101, 102, 103, 104))
    assert cap_filters.near_vectors(df.where("false")).count() == 0


def test_scores(docs, empty):
    got = pitman_yor.score(docs)
    rows = corpus()
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 1 for r in rows]
    toks = [[*WORD.findall(low(r[1])), None] for r in rows]
    c = Counter(w for t, h in zip(toks, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    want = Counter((r[0], h, len(t), sum(w in c for w in t), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for r, h, t in zip(rows, held, toks, strict=True))
    found = got.collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == want
    assert all(r.score < 0 for r in found)
    assert pitman_yor.score(empty).count() == 0


def test_table_draws_follow_their_distribution():
    d, strength, p, others, c = 0.6, 1.0, 0.2, 3, 6
    table = pitman_yor.stirling(d)
    assert math.exp(table[3, 2]) == pytest.approx(3 * (1 - d))
    w = np.array([math.exp(table[c, t]) * np.prod([(strength + d * (others + i)) * p for i in range(t)]) for t in range(1, c + 1)])
    t = pitman_yor.draw_tables(np.full(40_000, c), np.full(40_000, others), np.full(40_000, p), d, strength, table, np.random.default_rng(0))
    assert np.bincount(t, minlength=c + 1)[1:] / 40_000 == pytest.approx(w / w.sum(), abs=0.01)


def test_quality(docs, empty, spark):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(7, 19)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert got[10].kept and got[38].perplexity > got[10].perplexity
    assert quality.classify(empty, labels).count() == 0
    table = 2.0 ** quality.train(docs.where("text is not null")).astype(float).reshape(-1, quality.SYMBOLS)
    assert table.sum(axis=1) == pytest.approx(np.ones(len(table)), abs=1e-3)


def test_licenses(spark):
    texts = ["x. Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License,\nVersion 2.0", "Nothing here", None, "", "(c) All rights reserved."]
    got = [r.license for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["MIT", "GPL-3.0", "Apache-2.0", None, None, None, "Proprietary"]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 102), (102, 101), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_blocks_and_payloads():
    import pyarrow as pa

    texts = ["A  b\tc", None, "", "é x" * 9, "abcdefghijklmnopq abcdefghijklmnopq ABCDEFGHIJKLMNOPq"]
    b = next(blocks(pa.array(texts)))
    assert b.n_words.tolist() == [len(WORD.findall(t or "")) for t in texts]
    assert b.hashes[-1] == b.hashes[-2] == b.hashes[-3]
    for x, y in zip(unpack(pack(np.arange(5, dtype=np.uint16), np.zeros(0), np.array([1.5]))), ([0, 1, 2, 3, 4], [], [1.5]), strict=True):
        assert x.tolist() == y


@pytest.mark.parametrize("task_edges", [10_000, 20])
def test_components_match_union_find(spark, monkeypatch, task_edges):
    monkeypatch.setattr(stars, "TASK_EDGES", task_edges)
    edges = [(x * 37 % 101, x * 53 % 97) for x in range(60)] + [(200 + x, 201 + x) for x in range(30)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    found = components(spark.createDataFrame(edges, "a long, b long"))
    assert {tuple(r) for r in found.collect()} == {(x, root[x]) for x in linked}
