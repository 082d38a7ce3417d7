"""Token packing along a space-filling curve.

Every document's ids are hashed into a vector of few dimensions (fixed random signs for each id, summed and brought to
length 1), the vector's place on a Hilbert curve is its key, and documents are put in the order of (key, doc_id).
Concatenated in that order and cut every ``length`` ids they fill sequences without a gap; only the last one is padded.
Neighbours on the curve thereby share sequences.

Texts are tokenized once; ids are written with their keys. The order needs keys and counts only: these are
range-sorted, every partition's total is one row, and a running sum over those rows and inside each partition gives a
document's place. The places are joined back to the ids by row, and each document is cut on its own, however long.

Nulls: a null text has only the end id; null doc_ids come first among equal keys. Repeated rows are packed each.
An empty table gives an empty result. The pipeline stage drops nothing. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from starloom.llm import bytesets as B
from starloom.llm.store import materialize, shuffle_partitions, small_batches

END = 1
DIMS, BITS = 4, 12
TABLE = 300_000  # words in a task's table
PART = 2 << 20  # bytes of text that are cut into words at once, about; a text is never parted
WHITE = np.array([i < 128 and chr(i).isspace() for i in range(256)])
WIDE_WHITE = re.compile(r"[^\S\x00-\x7f]")


class Growing:
    """An array that grows at its end without being copied each time."""

    def __init__(self, dtype: type, width: int = 0):
        self.n, self.held = 0, np.zeros((1024, width) if width else 1024, dtype)

    def add(self, more: np.ndarray) -> None:
        need = self.n + len(more)
        if need > len(self.held):
            wider = np.zeros((max(need, 2 * len(self.held)), *self.held.shape[1:]), self.held.dtype)
            wider[: self.n] = self.held[: self.n]
            self.held = wider
        self.held[self.n : need] = more
        self.n = need

    @property
    def all(self) -> np.ndarray:
        return self.held[: self.n]


class Words:
    """Byte-level BPE by a table of distinct words: no token reaches over a single space into the next word.

    Beside its ids the table holds the sum of their signs for every word, so a document's vector is a sum over words."""

    def __init__(self, tokenizer: str, ranks: str, pattern: str):
        self.json, self.whole = tokenizer, None
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
        self.fast = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.size = np.zeros(max(table.values()) + 1, np.int64)
        for token, i in table.items():
            self.size[i] = len(token)
        self.special = "<|endoftext|>"
        self.signs = _signs(1 << 16)
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.flat, self.first, self.count, self.vector = (Growing(*x) for x in ((np.uint16,), (np.int64,), (np.int64,), (np.float32, DIMS)))
        self.safe = Growing(bool)

    def learn(self, words: list[str]) -> None:
        """Adds those of the distinct ``words`` that the table lacks, all in one call of the tokenizer."""
        if len(self.at) > TABLE:
            self.clear()
        new = [w for w in words if w not in self.at]
        if not new:
            return
        text = " " + " ".join(new)
        raw = np.frombuffer(text.encode(), np.uint8)
        begins = np.flatnonzero(raw == ord(" "))  # words hold no space
        ends = np.append(begins[1:], len(raw))
        ids = self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint16)
        borders = np.searchsorted(np.cumsum(self.size[ids]), ends) + 1
        starts = np.append(0, borders[:-1])
        self.first.add(starts + self.flat.n)
        self.count.add(borders - starts)
        self.vector.add(np.add.reduceat(self.signs[ids], np.minimum(starts, len(ids) - 1)))
        self.flat.add(ids)
        # two spaces, or a space beside other white space, may join in one token
        left, right = raw[np.minimum(begins + 1, len(raw) - 1)], raw[ends - 1]
        safe = (ends - begins > 1) & ~WHITE[left] & ~WHITE[right]
        if WIDE_WHITE.search(text):
            for k in np.flatnonzero(safe & ((left > 127) | (right > 127))):
                safe[k] = not new[k][0].isspace() and not new[k][-1].isspace()
        if self.special in text:
            safe &= ~np.fromiter((self.special in w for w in new), bool, len(new))
        self.safe.add(safe)
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))

    def one(self, text: str) -> np.ndarray:
        if self.special in text:  # an id of its own for the tokenizers library
            self.whole = self.whole or Tokenizer.from_file(self.json)
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint16)
        return np.array(self.fast.encode_ordinary(text), np.uint16)

    def encode(self, texts: list[str] | pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
        """Each text's ids, and the sum of their signs. Words are cut and numbered by Arrow, so that Python sees each
        distinct one once."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        cut = pc.split_pattern(texts, " ")
        words = cut.flatten().dictionary_encode()
        known = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn(known)
        number = words.indices.to_numpy()
        at = np.fromiter(map(self.at.__getitem__, known), np.int64, len(known))[number]
        ends = np.cumsum(pc.list_value_length(cut).to_numpy())
        heads = np.append(0, ends[:-1])
        plain = np.logical_and.reduceat(self.safe.all[at], heads)
        n = self.count.all[at]
        n[heads] = 0  # a first word has no space before it
        n[~np.repeat(plain, ends - heads)] = 0
        upto = np.cumsum(n)
        flat = self.flat.all[np.repeat(self.first.all[at] - upto + n, n) + np.arange(upto[-1])]
        summed = np.add.reduceat(self.vector.all[at] * (n > 0)[:, None], heads, dtype=np.float64)
        first, last = (upto - n)[heads], upto[ends - 1]
        out, vectors = [], np.zeros((len(texts), DIMS))
        for k, simple in enumerate(plain.tolist()):
            if simple:
                start = np.array(self.fast.encode_ordinary(known[number[heads[k]]]), np.uint16)
                vectors[k] = self.signs[start].sum(0) + summed[k]
                out.append(np.concatenate([start, flat[first[k] : last[k]]]))
            else:
                ids = self.one(texts[k].as_py())
                vectors[k] = self.signs[ids].sum(0)
                out.append(ids)
        return out, vectors


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index on the Hilbert curve of integer points (rows) with ``bits`` bits each (Skilling's transform)."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[dims - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> b) & 1
    return key


def _signs(n: int) -> np.ndarray:
    h = B.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.stack([(h >> np.uint64(d) & np.uint64(1)).astype(np.float32) * 2 - 1 for d in range(DIMS)], 1)


def curve_keys(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return hilbert(np.clip(((vectors + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1))


def _tokenized(tokenizer: str, ranks: str, pattern: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(tokenizer, ranks, pattern)
        for batch in batches:
            size = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)) // PART
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(size)) + 1, [batch.num_rows]]) if batch.num_rows else []
            for k, end in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(k, end - k)
                ids, vectors = words.encode(part.column("text"))
                ids = [np.append(x, np.uint16(END)) for x in ids]
                n = np.array([len(x) for x in ids], np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(curve_keys(vectors + words.signs[END])), pa.array(n), pa.array([x.tobytes() for x in ids], pa.binary())], ["doc_id", "key", "n", "ids"])

    return run


def _pieces(length: int, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, at, raw = batch.column("doc_id").to_pylist(), batch.column("place").to_pylist(), batch.column("ids").to_pylist()
            rows: list[tuple] = []
            for d, a, x in zip(doc, at, raw, strict=True):
                ids = np.frombuffer(x, np.uint16).astype("<u4")
                i = 0
                while i < len(ids):
                    j = min(len(ids), i + length - (a + i) % length)
                    rows.append((d, i, j - i, zlib.crc32(ids[i:j].tobytes()), len(ids), (a + i) // length, (a + i) % length, *([ids[i:j].tolist()] if with_ids else [])))
                    i = j
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int32()) if k == "ids" else pa.int64()) for k, c in zip(names, cols, strict=True)], names)

    return run


def pack(docs: DataFrame, tokenizer: str, ranks: str, pattern: str, length: int = 2048, with_ids: bool = True) -> DataFrame:
    """A row for each piece of a document: its place in the document and in a sequence, and its ids if asked for.

    ``tokenizer`` is the file of the tokenizers library, ``ranks`` the same vocabulary for tiktoken, ``pattern`` its split.
    """
    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tokens = texts.mapInArrow(_tokenized(tokenizer, ranks, pattern), "doc_id long, key long, n long, ids binary")
    tokens = materialize(tokens.withColumn("row", F.monotonically_increasing_id()), "tokens")
    order = ("key", "doc_id", "row")
    parts = tokens.select(*order, "n").repartitionByRange(shuffle_partitions(docs.sparkSession), *order)
    parts = materialize(parts.withColumn("part", F.spark_partition_id()), "curve")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = parts.groupBy("part").agg(F.sum("n").alias("ids")).select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    places = parts.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, "part").select("row", (F.col("start") + F.col("before")).alias("place"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return tokens.select("row", "doc_id", "ids").join(places, "row").select("doc_id", "place", "ids").mapInArrow(_pieces(length, with_ids), schema)
