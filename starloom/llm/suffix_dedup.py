"""Removal of repeated byte strings across documents, by rounds of ranks over content-sampled positions.

Plain prefix doubling sorts a (position, rank, rank) row for every byte of the corpus in every round, many times the
input on disk; this is a departure from it, in fixed rounds (README.md has the figures).
Here the first round is run on a sample that is chosen by content: of the ``length - q + 1`` first substrings of q
bytes in each window of ``length`` bytes, the one with the smallest hash (the leftmost on ties). Equal windows choose
equal substrings at equal offsets, so no repeat is lost, and about one position in 13 is left. Ranks are classes of
hashes; the rounds are at growing lengths, and what has become unique to one document leaves:

1. substrings of q (about half of ``length``) bytes at the sampled positions: those in one document only leave;
2. the whole stretch under the windows that share a sampled position (from ``length`` bytes on): a stretch that is in
   a smaller document goes as a whole; those whose substring has one class only leave;
3. past the threshold: single windows of ``length`` bytes, of one document of each class that is left.

In each round a chunk of documents sends every distinct key once, with its smallest and largest doc_id, to the bucket
of the key, and the bucket answers only chunks that the answer can change. A string in a third of all documents
therefore costs a row a chunk, and no pairs are made. Keys are 64-bit hashes (40 bits and the bucket in round 1, where
a collision only keeps a position longer).

Nulls: a null text is empty; a null doc_id counts as larger than any other. Rows with one doc_id never remove each
other's bytes. Texts shorter than ``length`` are kept whole; very long ones are handled in overlapping blocks. An
empty table gives an empty result. Columns other than doc_id and text are not read, but may be carried along.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm import bytesets as B
from starloom.llm.store import chunk_keys, chunk_of, materialize, materialize_by_key, shuffle_partitions, small_batches

CHUNK = 32 << 20  # bytes of text in a chunk, about
_POS = 24  # bits for a position in a block
_ANSWER = "chunk int, kind int, keys binary, docs binary, flags binary"


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:]) if len(x) > have else x[:0]
        have *= 2
    rest = width - have
    return np.minimum(x[:-rest], x[rest:]) if rest and len(x) > rest else x if not rest else x[:0]


class Block:
    """The stretches of one block: windows lo .. lo + n - 1 share a sampled substring ``key``; ``stretch`` is the
    class of all bytes under them. Positions count from the chunk's first byte."""

    def __init__(self, values: np.ndarray, base: int, ends: np.ndarray, offsets: np.ndarray, length: int):
        q = (length + 2) // 2
        self.base, self.length, self.prefix = base, length, B.Prefix(values)
        sampled = B.mix(self.prefix.every(q))
        sampled = sampled >> np.uint64(_POS) << np.uint64(_POS) | np.arange(len(sampled), dtype=np.uint64)
        least = _sliding_min(sampled, length - q + 1)
        crossing = np.zeros(len(values) + 1, np.int32)  # windows that run over a document's end
        starts = np.append(0, ends[:-1])
        np.add.at(crossing, np.maximum(starts, ends - length + 1), 1)
        np.add.at(crossing, ends, -1)
        at = np.flatnonzero(np.cumsum(crossing)[: len(least)] == 0)
        chosen = least[at]
        new = np.ones(len(at), bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        self.lo, self.n = at[first], np.diff(np.append(first, len(at)))
        self.key = chosen[first] >> np.uint64(_POS)
        self.doc = np.searchsorted(offsets, self.lo + base, "right") - 1

    def stretches(self) -> np.ndarray:
        return self.prefix.of(self.lo, self.lo + self.n - 1 + self.length) ^ B.mix(self.n.astype(np.uint64))

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the single windows of the chosen stretches."""
        n = self.n[which]
        start = np.repeat(self.lo[which] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return start, self.prefix.of(start, start + self.length)


def _blocks(values: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[Block]:
    for i, j in B.blocks(offsets):
        a, b = offsets[i], offsets[j]
        if b - a <= 2 * B.BLOCK:
            if b - a >= length:
                yield Block(values[a:b], a, offsets[i + 1 : j + 1] - a, offsets, length)
        else:  # one long document: the overlap holds the windows that start before it
            for s in range(a, b - length + 1, B.BLOCK):
                e = min(b, s + B.BLOCK + length - 1)
                yield Block(values[s:e], s, np.array([e - s]), offsets, length)


def _chunk(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values, offsets = B.bytes_of(table.column("raw"))
    ids = table.column("doc_id").combine_chunks().fill_null(np.iinfo(np.int64).max)
    return values, offsets, np.asarray(ids, dtype=np.int64)


def _least(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys with the smallest and largest doc_id, and where each is in ``key``."""
    order = np.lexsort((doc, key))
    k = key[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(k)) - 1 if len(k) else first
    return k[first], doc[order[first]], doc[order[last]], order[first]


def _find(key: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key its place in sorted ``known``, and whether it is there."""
    at = np.searchsorted(known, key)
    at[at == len(known)] = 0
    return at, known[at] == key if len(known) else np.zeros(len(key), bool)


def _blobs(rows: list[tuple], names: list[str]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.table([pa.array(c, pa.binary() if isinstance(c[0] if c else b"", bytes) else pa.int32()) for c in cols], names)


def _dealt(buckets: list[int], chunk: int, by: np.ndarray, *arrays: np.ndarray) -> pa.Table:
    """A row for each bucket with what falls there."""
    to = (by % np.uint64(len(buckets))).astype(np.int64)
    order = np.argsort(to, kind="stable")
    borders = np.searchsorted(to[order], np.arange(len(buckets) + 1))
    arrays = [a[order] for a in arrays]
    rows = [(buckets[b], chunk, *(a[borders[b] : borders[b + 1]].tobytes() for a in arrays)) for b in range(len(buckets)) if borders[b] < borders[b + 1]]
    names = ["bucket", "chunk", *"abcd"[: len(arrays)]]
    if not rows:
        return pa.table([pa.array([], pa.int32()), pa.array([], pa.int32()), *(pa.array([], pa.binary()) for _ in arrays)], names)
    return _blobs(rows, names)


def _gathered(table: pa.Table, *types: type) -> tuple[np.ndarray, list[np.ndarray]]:
    """What a bucket got: the row each entry came in, and the arrays."""
    arrays = [np.concatenate([np.frombuffer(x.as_py(), t) for x in table.column(c)]) for c, t in zip("abcd", types, strict=False)]
    sizes = [len(x.as_py()) // np.dtype(types[0]).itemsize for x in table.column("a")]
    return np.repeat(np.arange(len(sizes)), sizes), arrays


def _answers(table: pa.Table, kind: int, row: np.ndarray, use: np.ndarray, keys: np.ndarray, docs: np.ndarray, flags: np.ndarray) -> pa.Table:
    at = np.flatnonzero(use)
    at = at[np.argsort(row[at], kind="stable")]
    borders = np.searchsorted(row[at], np.arange(table.num_rows + 1))
    chunks = table.column("chunk").to_pylist()
    rows = [(chunks[r], kind, *(x[at[borders[r] : borders[r + 1]]].tobytes() for x in (keys, docs, flags))) for r in range(table.num_rows) if borders[r] < borders[r + 1]]
    names = ["chunk", "kind", "keys", "docs", "flags"]
    if not rows:
        return pa.table([pa.array([], t) for t in (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())], names)
    return _blobs(rows, names)


def _known(table: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The answers of one kind to a chunk, sorted by key."""
    rows = [r for r in table.to_pylist() if r["kind"] == kind]
    keys, docs, flags = (np.concatenate([np.frombuffer(r[c], t) for r in rows] or [np.zeros(0, t)]) for c, t in (("keys", np.uint64), ("docs", np.int64), ("flags", np.uint8)))
    order = np.argsort(keys)
    return keys[order], docs[order], flags[order]


def _round_1(buckets: list[int], length: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        values, offsets, ids = _chunk(table)
        parts = [(b.key, ids[b.doc]) for b in _blocks(values, offsets, length)]
        key, low, high, _ = _least(*(np.concatenate(x) for x in zip(*parts, strict=True))) if parts else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
        five = (key // np.uint64(len(buckets))).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]  # the bucket tells the rest
        return _dealt(buckets, table.column("chunk")[0].as_py(), key, np.ascontiguousarray(five), (low < high).astype(np.uint8))

    return run


def _answer_1(table: pa.Table) -> pa.Table:
    row, (five, several) = _gathered(table, np.dtype((np.void, 5)), np.uint8)
    wide = np.zeros((len(five), 8), np.uint8)
    wide[:, :5] = five.view(np.uint8).reshape(-1, 5)
    key = wide.view(np.uint64).ravel()
    _, which, count = np.unique(key, return_inverse=True, return_counts=True)
    alive = (count >= 2) | (np.bincount(which, several, len(count)) > 0)
    return _answers(table, 1, row, alive[which], key, key.astype(np.int64), several)


def _round_2(buckets: list[int], length: int) -> Callable:
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        values, offsets, ids = _chunk(table)
        known, _, _ = _known(answers, 1)
        parts = []
        for b in _blocks(values, offsets, length):
            # short keys may match those of another bucket: that only keeps a position longer
            at = np.flatnonzero(_find(b.key // np.uint64(len(buckets)), known)[1])
            parts.append((b.stretches()[at], ids[b.doc[at]], b.key[at]))
        if not parts:
            return _dealt(buckets, 0, np.zeros(0, np.uint64), *[np.zeros(0, np.uint64)] * 4)
        stretch, doc, key = (np.concatenate(x) for x in zip(*parts, strict=True))
        stretch, low, high, at = _least(stretch, doc)
        return _dealt(buckets, table.column("chunk")[0].as_py(), key[at], key[at], stretch, low, high)

    return run


def _answer_2(table: pa.Table) -> pa.Table:
    row, (key, stretch, low, high) = _gathered(table, np.uint64, np.uint64, np.int64, np.int64)
    _, first, which = np.unique(stretch, return_index=True, return_inverse=True)
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, which, low)
    _, of, classes = np.unique(key[first], return_inverse=True, return_counts=True)
    several = (classes[of] >= 2)[which]
    return _answers(table, 2, row, several | (least[which] < high), stretch, least[which], several.astype(np.uint8))


def _round_3(buckets: list[int], length: int) -> Callable:
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        values, offsets, ids = _chunk(table)
        known, least, several = _known(answers, 2)
        parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        for b in _blocks(values, offsets, length) if len(known) else ():
            at, there = _find(b.stretches(), known)
            which = np.flatnonzero(there & (several[at] > 0) & (ids[b.doc] == least[at]))
            start, window = b.windows(which)
            parts.append((window, np.repeat(ids[b.doc[which]], b.n[which])))
            if sum(len(p[0]) for p in parts) > 4 * B.BLOCK:
                parts = [tuple(np.concatenate(x) for x in zip(*parts, strict=True))]
        window, low, high, _ = _least(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        return _dealt(buckets, table.column("chunk")[0].as_py() if table.num_rows else 0, window, window, low, high)

    return run


def _answer_3(table: pa.Table) -> pa.Table:
    row, (window, low, high) = _gathered(table, np.uint64, np.int64, np.int64)
    _, which = np.unique(window, return_inverse=True)
    least = np.full(which.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, which, low)
    return _answers(table, 3, row, least[which] < high, window, least[which], np.zeros(len(row), np.uint8))


def removed(values: np.ndarray, offsets: np.ndarray, ids: np.ndarray, answers: pa.Table, length: int) -> np.ndarray:
    """Which bytes of a chunk go."""
    known, least, several = _known(answers, 2)
    single, smaller, _ = _known(answers, 3)
    cover = np.zeros(len(values) + 1, np.int32)
    for b in _blocks(values, offsets, length) if len(known) else ():
        at, there = _find(b.stretches(), known)
        doc = ids[b.doc]
        whole = np.flatnonzero(there & (doc > least[at]))
        np.add.at(cover, b.base + b.lo[whole], 1)
        np.add.at(cover, b.base + b.lo[whole] + b.n[whole] - 1 + length, -1)
        which = np.flatnonzero(there & (several[at] > 0) & (doc == least[at]))
        if len(which) and len(single):
            start, window = b.windows(which)
            place, found = _find(window, single)
            start = b.base + start[found & (np.repeat(doc[which], b.n[which]) > smaller[place])]
            np.add.at(cover, start, 1)
            np.add.at(cover, start + length, -1)
    return np.cumsum(cover)[:-1] > 0


def _cut(length: int, names: list[str]) -> Callable:
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        values, offsets, ids = _chunk(table)
        gone = removed(values, offsets, ids, answers, length)
        starts, ends = B.runs(gone, offsets)
        borders = B.per_document(starts, offsets)
        kept = [values[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets, offsets[1:], strict=False)]
        spans = [[{"start": int(s - offsets[i]), "end": int(e - offsets[i])} for s, e in zip(starts[borders[i] : borders[i + 1]], ends[borders[i] : borders[i + 1]], strict=True)] for i in range(len(ids))]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        cols = [*(table.column(c) for c in names), pa.array(np.diff(offsets)), pa.array(B.sums(gone, offsets)), pa.array(spans, kind), pa.array(kept, pa.binary())]
        if "row" in names:  # a cut inside a character drops the rest of it
            cols.append(pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()))
        return pa.table(cols, [*names, "n_bytes", "n_removed", "spans", "kept", "kept_text"][: len(cols)])

    return run


def suffix_dedup(docs: DataFrame, length: int = 50, carry: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (of the text's UTF-8 bytes) and kept (bytes) of every document.

    With ``carry``, the columns of ``docs`` come along in the struct ``row``, and kept_text is kept as a string.
    """
    if length < 4:
        raise ValueError("length must be at least 4")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(shuffle_partitions(docs.sparkSession), -(-size // (2 * CHUNK)))  # a chunk is one task's table, however much there is
    keys = chunk_keys(n)
    rows = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []
    parts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("raw"), chunk_of(keys, "doc_id", "text").alias("chunk"), *rows)
    chunks = materialize_by_key(parts, "chunk", "chunks", n)
    bare = chunks.select("chunk", "doc_id", "raw")
    pair = lambda answers, f, schema, left=bare: left.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(f, schema)
    sent = lambda k: "bucket int, chunk int, " + ", ".join(f"{c} binary" for c in "abcd"[:k])
    first = bare.groupBy("chunk").applyInArrow(_round_1(keys, length), sent(2))
    alive = materialize(first.groupBy("bucket").applyInArrow(_answer_1, _ANSWER), "alive")
    second = pair(alive, _round_2(keys, length), sent(4))
    classes = materialize(second.groupBy("bucket").applyInArrow(_answer_2, _ANSWER), "classes")
    third = pair(classes, _round_3(keys, length), sent(3))
    windows = materialize(third.groupBy("bucket").applyInArrow(_answer_3, _ANSWER), "windows")
    names = ["doc_id", *(["row"] if carry else [])]
    row = f"row {chunks.schema['row'].dataType.simpleString()}, " if carry else ""
    schema = f"doc_id long, {row}n_bytes long, n_removed long, spans array<struct<start: bigint, end: bigint>>, kept binary" + ", kept_text string" * carry
    return pair(classes.union(windows), _cut(length, names), schema, chunks if carry else bare)


def dedup_texts(docs: DataFrame, length: int = 50) -> DataFrame:
    """``docs`` with the repeated strings cut out of text (and n_chars, if there, brought up to date). A document
    that is left without a byte stays as an empty text; a null text stays null."""
    out = suffix_dedup(docs, length, carry=True)
    text = F.when(F.col("row.text").isNull() | (F.col("n_removed") == 0), F.col("row.text")).otherwise(F.col("kept_text"))
    changed = {"text": text.cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return out.select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the query op1_suffix_dedup."""
    out = suffix_dedup(docs, 50)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
