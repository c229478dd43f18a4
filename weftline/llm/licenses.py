"""Licence scans by sentences: known licence sentences get identifiers, and ordered rules match the identifiers.

A text is cut into sentences at line ends and at full stops followed by white space; a sentence is normalised (lower case, white
space and punctuation collapsed). Each is looked up among known sentence patterns; the identifiers found, in the order of
the text, are matched with rules, which are ordered sequences of identifiers with other sentences allowed between them. The
first rule that matches names the licence, so full texts stand before notices, and notices before mentions.

Scale: one pass without a shuffle; patterns and rules are a few kilobytes of code.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words between a licence's name and its version, such as who published it; not another licence.
_GAP = r"(?:(?!licen[cs]e).){0,80}?"
#: Sentence identifiers and patterns over normalised sentences; fixed values from the licences' own wording.
SENTENCES = {
    "mit-name": r"\b(the )?(mit|expat)( x11)? licen[cs]e\b",
    "mit-grant": r"permission is hereby granted free of charge to any person obtaining a copy",
    "mit-condition": r"the above copyright notice and this permission notice shall be included in all copies",
    "as-is": r"\bsoftware is provided (by .{1,80} )?as is\b",
    "apache-name": r"\bapache licen[cs]e( version)? ?2( ?0)?\b",
    "apache-plain": r"\bapache licen[cs]e\b",
    "apache-grant": r"licensed under the apache licen[cs]e version 2 0",
    "apache-compliance": r"you may not use this file except in compliance with the licen[cs]e",
    "gpl3-name": rf"\bgnu general public licen[cs]e{_GAP}\b(version|v) ?3|\bgpl (version )?v? ?3\b|\bgplv?3\b",
    "gpl2-name": rf"\bgnu general public licen[cs]e{_GAP}\b(version|v) ?2|\bgpl (version )?v? ?2\b|\bgplv?2\b",
    "gpl-name": r"\bgnu general public licen[cs]e\b|\bgnu gpl\b",
    "lgpl-name": r"\bgnu lesser general public licen[cs]e\b|\blgpl\b",
    "agpl-name": r"\bgnu affero general public licen[cs]e\b|\bagpl\b",
    "gpl-redistribute": r"free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e",
    "gpl-warranty": r"distributed in the hope that it will be useful but without any warranty",
    "bsd3-name": r"\b3 clause bsd licen[cs]e\b|\bbsd 3 clause licen[cs]e\b",
    "bsd2-name": r"\b2 clause bsd licen[cs]e\b|\bbsd 2 clause licen[cs]e\b",
    "bsd-name": r"\b(?:(?P<n>[23]) clause )?bsd(?: [23] clause)? licen[cs]e\b",
    "bsd-redistribution": r"redistribution and use in source and binary forms with or without modification are permitted",
    "bsd-source": r"redistributions of source code must retain the above copyright notice",
    "bsd-binary": r"redistributions in binary form must reproduce the above copyright notice",
    "bsd-endorse": r"neither the name of .{1,120} may be used to endorse or promote products",
    "mpl2-name": r"\bmozilla public licen[cs]e\b|\bmpl 2 0\b",
    "isc-name": r"\bisc licen[cs]e\b",
    "isc-grant": r"permission to use copy modify and or distribute this software for any purpose",
    "unlicense": r"\bfree and unencumbered software released into the public domain\b|\bthe unlicense\b",
    "public-domain": r"(?<!software released into the )\bpublic domain\b",
    "cc0-name": r"\bcc0\b|\bcreative commons zero\b",
    "cc-by-sa-name": r"\bcc by sa\b|\bcreative commons attribution share ?alike\b",
    "cc-by-nc-name": r"\bcc by nc\b|\bcreative commons attribution non ?commercial\b",
    "cc-by-name": r"\bcc by\b(?! (sa|nc)\b)|\bcreative commons attribution\b(?! (share ?alike|non ?commercial)\b)",
    "cc-name": r"\bcreative commons\b",
    "all-rights": r"\ball rights reserved\b",
    "copyright": r"\bcopyright( c)? (\d{4}|by|c)\b",
}
#: Ordered rules: licence, and the identifiers that have to occur in this order.
RULES = [
    ("MIT", "full", ("mit-grant", "mit-condition", "as-is")),
    ("BSD-3-Clause", "full", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", "full", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("Apache-2.0", "full", ("apache-grant", "apache-compliance")),
    ("ISC", "full", ("isc-grant",)),
    ("GPL-3.0", "full", ("gpl-redistribute", "gpl3-name", "gpl-warranty")),
    ("GPL-2.0", "full", ("gpl-redistribute", "gpl2-name", "gpl-warranty")),
    ("GPL", "full", ("gpl-redistribute", "gpl-warranty")),
    ("MIT", "full", ("mit-grant",)),
    ("BSD", "full", ("bsd-redistribution",)),
    ("AGPL", "notice", ("agpl-name",)),
    ("LGPL", "notice", ("lgpl-name",)),
    ("GPL-3.0", "notice", ("gpl3-name",)),
    ("GPL-2.0", "notice", ("gpl2-name",)),
    ("GPL", "notice", ("gpl-name",)),
    ("Apache-2.0", "notice", ("apache-name",)),
    ("Apache", "notice", ("apache-plain",)),
    ("MIT", "notice", ("mit-name",)),
    ("BSD-3-Clause", "notice", ("bsd3-name",)),
    ("BSD-2-Clause", "notice", ("bsd2-name",)),
    ("BSD", "notice", ("bsd-name",)),
    ("MPL-2.0", "notice", ("mpl2-name",)),
    ("ISC", "notice", ("isc-name",)),
    ("Unlicense", "notice", ("unlicense",)),
    ("CC0-1.0", "notice", ("cc0-name",)),
    ("CC-BY-SA", "notice", ("cc-by-sa-name",)),
    ("CC-BY-NC", "notice", ("cc-by-nc-name",)),
    ("CC-BY", "notice", ("cc-by-name",)),
    ("CC", "notice", ("cc-name",)),
    ("Public-Domain", "notice", ("public-domain",)),
    ("Proprietary", "reserved", ("copyright", "all-rights")),
    ("Proprietary", "reserved", ("all-rights",)),
]
#: A name without a version or terms says nothing more where one of these is found.
FAMILIES = {"GPL": {"GPL-3.0", "GPL-2.0"}, "Apache": {"Apache-2.0"}, "BSD": {"BSD-3-Clause", "BSD-2-Clause"}, "CC": {"CC0-1.0", "CC-BY-SA", "CC-BY-NC", "CC-BY"}}
#: Licence expressions of SPDX lines, and names of the rules for their identifiers; others are named as they stand.
_SPDX = regex.compile(r"SPDX-License-Identifier\s*:[ \t]*([( ]*[a-z0-9][a-z0-9.+-]*\)*(?:[ \t]+(?:or|and|with)[ \t]+[( ]*[a-z0-9][a-z0-9.+-]*\)*)*)", regex.I)
_SPDX_PART = regex.compile(r"[a-z0-9][a-z0-9.+-]*", regex.I)
_SPDX_NAMES = [("gpl-3", "GPL-3.0"), ("gpl-2", "GPL-2.0"), ("gpl", "GPL"), ("lgpl", "LGPL"), ("agpl", "AGPL"), ("cc-by-sa", "CC-BY-SA"), ("cc-by-nc", "CC-BY-NC"), ("cc-by-nd", "CC-BY-ND"), ("cc-by", "CC-BY")]
_SPDX_CASE = {n.lower(): n for n, _, _ in RULES}
#: Every pattern needs one of these words in the normalised text, which lets most texts pass without being cut.
_HINT = regex.compile(r"licen[cs]e|permission|copyright|redistribut|warranty|gpl|\bmpl\b|creative commons|\bcc0\b|\bcc by\b|public domain|unencumbered|as is|rights reserved|apache|compliance|provided by|neither the")
_CUT = regex.compile(r"[.!?;:]+(?=\s|$)|[\r\n]+")
_OTHER = regex.compile(r"[^\p{L}\p{N}]+")
_ANY = [(name, regex.compile(p)) for name, p in SENTENCES.items()]


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, normalised sentence). A line end inside a sentence of running text is a boundary too."""
    out, at = [], 0
    for m in [*_CUT.finditer(text), None]:
        end = m.start() if m else len(text)
        if end > at:
            normal = _OTHER.sub(" ", text[at:end].lower()).strip()
            if normal:
                out.append((at, end, normal))
        at = m.end() if m else end
    return out


def _spdx(text: str) -> Iterator[tuple[str, int, int]]:
    """(licence, start, end) of the licences in SPDX lines."""
    for m in _SPDX.finditer(text):
        before = ""
        for x in _SPDX_PART.findall(m.group(1)):
            low = x.lower().rstrip(".")
            if low not in ("or", "and", "with", "none", "noassertion") and before != "with":
                yield next((n for p, n in _SPDX_NAMES if low.startswith(p)), _SPDX_CASE.get(low, x.rstrip("."))), m.start(), m.end()
            before = low


def identifiers(text: str | None) -> list[tuple[str, int, int]]:
    """(identifier, start, end) of the known licence sentences in the text, in order; "spdx:" and the licence for SPDX lines.

    A sentence may be wrapped over any number of lines, so the sentences are searched as one; each match is given the
    place of the one it starts in.
    """
    if not text or not _HINT.search(_OTHER.sub(" ", text.lower())):
        return []
    cut = sentences(text)
    starts = list(accumulate((len(x[2]) + 1 for x in cut), initial=0))
    joined, found = " ".join(x[2] for x in cut), {}
    for name, pattern in _ANY:
        for m in pattern.finditer(joined):
            i = bisect_right(starts, m.start()) - 1
            found.setdefault((name, cut[i][0], cut[i][1]), (i, m.start()))
    for i, (start, end, normal) in enumerate(cut):
        if normal.startswith("copyright") and not normal[9:10].isalnum():
            found.setdefault(("copyright", start, end), (i, starts[i]))
    for name, start, end in _spdx(text):
        i = max(0, bisect_right(cut, start, key=lambda x: x[0]) - 1)
        found.setdefault((f"spdx:{name}", start, end), (i, starts[i]))
    return sorted(found, key=found.get)


def licenses_of(ids: list[str]) -> list[tuple[str, str]]:
    """Licences and kinds of all rules whose identifiers occur in this order, in the order of the rules, SPDX lines last.

    A full text's sentences are used up by it, so the rules for its parts need others. Reserved rights count where
    there is nothing else.
    """
    left, out = [x for x in ids if not x.startswith("spdx:")], {}
    for name, kind, rule in RULES:
        while True:
            at, i = [], -1
            for x in rule:
                i = next((j for j in range(i + 1, len(left)) if left[j] == x), len(left))
                at.append(i)
            if at[-1] == len(left) or kind == "reserved" and out:
                break
            out.setdefault(name, kind)
            if kind != "full":
                break
            left = [x for j, x in enumerate(left) if j not in at]
    for x in ids:
        if x.startswith("spdx:"):
            if set(out.values()) == {"reserved"}:
                out.clear()
            out.setdefault(x[5:], "notice")
    return [(name, kind) for name, kind in out.items() if not FAMILIES.get(name, set()) & out.keys()]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("id", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for b in batches:
        found = [identifiers(x) for x in b.column("text").to_pylist()]
        named = [licenses_of([x[0] for x in f]) for f in found]
        first = [x[0] if x else (None, None) for x in named]
        spans = pa.array([[{"id": a, "start": s, "end": e} for a, s, e in f] for f in found], span)
        every = pa.array([[{"license": n, "kind": k} for n, k in x] for x in named], pa.list_(pa.struct([("license", pa.string()), ("kind", pa.string())])))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x[0] for x in first], pa.string()), pa.array([x[1] for x in first], pa.string()), every, spans], ["doc_id", "license", "kind", "licenses", "sentences"])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text; others are ignored): doc_id, license, kind, licenses (license, kind),
    sentences (id, start, end).

    licenses are all that the text names, license and kind the first of them. They are null, and licenses empty, where no rule matches, as for null or empty texts; kind is full, notice or reserved.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan, "doc_id long, license string, kind string, licenses array<struct<license: string, kind: string>>, sentences array<struct<id: string, start: int, end: int>>")
