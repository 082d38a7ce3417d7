"""Fuzzy search for short licence notices.

A notice of m characters may be met with up to k edits (a tenth of its length). It is split into k + 1 pieces: a match
with k edits leaves at least one piece whole (the pigeonhole principle), so exact searches for the pieces find every
place worth a look. There the regex library's bounded-error matching verifies the notice and gives its span and edits:
best matches first, from the beginning of a word to the end of one. The words that tell a notice from its siblings (nc,
sa, mit, lesser ..) must be there without an edit. Of overlapping matches of several notices the one that says most
stays: the longest, each edit counted against it as three characters.
Texts are lower-cased (A-Z only) and brought to words of letters, digits and non-ASCII bytes with one space between.

Besides the fuzzy notices, fixed base phrases are counted wherever their words stand in a row.

Nulls and empty texts: no words, no labels, score 0. Very long texts are searched whole. Repeated rows each give a
row. An empty table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.store import raw_documents

# fixed values of the contract
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# phrase, label, words that must be there as they are
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0", "apache 2 0"),
    ("released under the mit license", "mit", "mit"),
    ("licensed under the mit license", "mit", "mit"),
    ("permission is hereby granted free of charge to any person", "mit", ""),
    ("released under the bsd license", "bsd", "bsd"),
    ("licensed under the bsd license", "bsd", "bsd"),
    ("redistribution and use in source and binary forms", "bsd", ""),
    ("released under the isc license", "isc", "isc"),
    ("permission to use copy modify and or distribute this software", "isc", ""),
    ("licensed under cc by nc", "cc-by-nc", "nc"),
    ("licensed under cc by nc sa", "cc-by-nc-sa", "nc sa"),
    ("licensed under cc by nc nd", "cc-by-nc-nd", "nc nd"),
    ("licensed under cc by nd", "cc-by-nd", "nd"),
    ("licensed under cc by sa", "cc-by-sa", "sa"),
    ("creative commons attribution", "cc-by", ""),
    ("creative commons attribution noncommercial", "cc-by-nc", ""),
    ("creative commons attribution noncommercial sharealike", "cc-by-nc-sa", ""),
    ("creative commons attribution sharealike", "cc-by-sa", ""),
    ("licensed under the gnu general public license", "gpl", "general"),
    ("gnu lesser general public license", "lgpl", "lesser"),
    ("gnu affero general public license", "agpl", "affero"),
    ("mozilla public license", "mpl", "mozilla"),
    ("released into the public domain", "public-domain", "public domain"),
    ("all rights reserved", "reserved", ""),
)
EDIT = 3  # characters that an edit weighs among overlapping matches
WORD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
MATCH = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())])
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label: string, start: long, end: long, edits: int>>"


class Notice:
    def __init__(self, phrase: str, label: str, exact: str = ""):
        raw = phrase.encode()
        self.label, self.length, self.edits, self.exact = label, len(raw), max(1, len(raw) // 10), set(exact.encode().split())
        cuts = [len(raw) * i // (self.edits + 1) for i in range(self.edits + 2)]
        self.pieces = [(a, raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.pattern = regex.compile(b"(?b)(?<= )(?:" + regex.escape(raw, special_only=True) + b"){e<=%d}(?= )" % self.edits)

    def best(self, text: bytes, a: int, b: int) -> list[tuple[int, int, int]]:
        """The best match between two places, then those left and right of it."""
        m = self.pattern.search(text, a, b) if b - a >= self.length - self.edits else None
        if not m:
            return []
        here = [(m.start(), m.end(), sum(m.fuzzy_counts))] if self.exact <= set(m[0].split()) else []
        return self.best(text, a, m.start()) + here + self.best(text, m.end(), b)

    def search(self, text: bytes) -> list[tuple[int, int, int]]:
        """(start, end, edits) of the matches, left to right without overlap."""
        windows = []
        for offset, piece in self.pieces:
            at = text.find(piece)
            while at >= 0:
                windows.append((max(0, at - offset - self.edits - 1), at - offset + self.length + self.edits + 1))
                at = text.find(piece, at + 1)
        out: list[tuple[int, int, int]] = []
        merged: list[list[int]] = []
        for a, b in sorted(windows):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        for a, b in merged:
            out += self.best(text, a, min(b, len(text)))
        return out


def strongest(found: list[dict]) -> list[dict]:
    """Of overlapping matches those that say most, by their place."""
    out: list[dict] = []
    for x in sorted(found, key=lambda x: (-(x["end"] - x["start"] - EDIT * x["edits"]), x["start"], x["label"])):
        if all(x["end"] <= y["start"] or y["end"] <= x["start"] for y in out):
            out.append(x)
    return sorted(out, key=lambda x: x["start"])


def scan(raw: bytes, notices: list[Notice]) -> tuple:
    """The result columns of one text, after doc_id. Spans are byte positions in the normalised text."""
    words = raw.translate(WORD).split()
    text = b" " + b" ".join(words) + b" " if words else b""
    places, base = [], set()
    for phrase, label in BASE:
        key = b" " + phrase.encode() + b" "
        at = text.find(key)
        while at >= 0:
            places.append(at)
            base.add(label)
            at = text.find(key, at + 1)
    found: list[dict] = []
    for n in notices:
        found += [{"label": n.label, "start": a, "end": b, "edits": e} for a, b, e in n.search(text)]
    found = strongest(found) if len(found) > 1 else found
    best = max((1 - x["edits"] / max(1, x["end"] - x["start"]) for x in found), default=0.0)
    ends = [text.count(b" ", 0, min(places)), text.count(b" ", 0, max(places))] if places else [None, None]
    labels = base | {x["label"] for x in found}
    return len(words), len(places), *ends, ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if base else max(0.0, best), found


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    notices = [Notice(*x) for x in NOTICES]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(MATCH)]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
    for batch in batches:
        rows = [scan(x.as_py(), notices) for x in batch.column("raw")]
        cols = list(zip(*rows, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", *names])


def license_scan(docs: DataFrame) -> DataFrame:
    """Words, base phrases, labels, score and the notices' spans of every document."""
    return raw_documents(docs).mapInArrow(_scanned, SCHEMA)


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the query op2_license_scan."""
    return license_scan(docs).withColumn("n_matches", F.size("matches")).drop("matches")
