"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader updates.

Words are runs of letters, digits and non-ASCII bytes; runs of other signs are words too. A document's features are
its words and pairs of neighbouring words, hashed into 2**BITS places, each with its share of all features as value.
Training takes labelled documents up to ``max_rows`` (a documented bound: of more of them those whose doc_id has the
smallest hash); their features go to one task, which learns by FTRL-proximal in a fixed order. Every text is then scored whole where it
is read, as a sparse dot product with the broadcast weights (2**BITS floats). Only text enters a score.

Nulls and empty texts score the bias alone. Labels that are null, or of documents that are not there, are left out; a
document labelled twice counts with its smaller label, and of several texts with one doc_id one is learnt from (the
smallest features). Scores depend on the rows alone, not on how they are dealt, though on the hashes that order them.
Repeated rows each give a row, an empty table an empty result;
without labels all scores are 0.5. Columns other than doc_id and text (in labels: doc_id and quality) are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.llm import bytesets as B
from starloom.llm.store import small_batches

BITS, SCALE = 18, 16.0
MAX_ROWS, EPOCHS, THRESHOLD = 20_000, 2, 0.3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5
KIND = np.full(256, 2, np.uint8)
KIND[B.SPACE] = 0
KIND[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") + list(range(128, 256))] = 1


def features(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed places of all features of a block's documents, and the borders between documents."""
    kind = KIND[values]
    cut = np.ones(len(values), bool)
    cut[1:] = kind[1:] != kind[:-1]
    cut[offsets[:-1][offsets[:-1] < len(values)]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(values)) if len(starts) else starts
    real = kind[starts] != 0
    starts, ends = starts[real], ends[real]
    words = B.per_document(starts, offsets)
    h = B.Prefix(values).of(starts, ends)
    pair = B.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) if len(h) > 1 else h[:0]
    n = np.diff(words)
    doc = np.repeat(np.arange(len(n)), n)
    inside = doc[1:] == doc[:-1] if len(doc) > 1 else np.zeros(0, bool)
    place = np.concatenate([h, pair[inside]]) & np.uint64((1 << BITS) - 1)
    owner = np.concatenate([doc, doc[1:][inside]]) if len(doc) > 1 else doc
    order = np.argsort(owner, kind="stable")
    return place[order].astype(np.uint32), np.searchsorted(owner[order], np.arange(len(n) + 1))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values, offsets = B.bytes_of(batch.column("text"))
        for i, j in B.blocks(offsets):
            place, borders = features(values[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            rows = [np.unique(place[a:b], return_counts=True) for a, b in zip(borders, borders[1:], strict=False)]
            part = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array([p.tobytes() for p, _ in rows], pa.binary()), pa.array([c.astype(np.uint32).tobytes() for _, c in rows], pa.binary())], ["doc_id", "label", "places", "counts"])


class Ftrl:
    """FTRL-proximal for logistic loss; the last weight is the bias."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def update(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def fit(rows: list[tuple[int, float, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weights (the last: the bias) from (doc_id, label, places, counts), whatever their order."""
    model = Ftrl(1 << BITS)
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    rng = np.random.default_rng(5)
    for _ in range(EPOCHS):
        for i in rng.permutation(order):
            _, y, place, count = rows[i]
            x = np.append(count * (SCALE / max(1, int(count.sum()))), 1.0)
            model.update(np.append(place.astype(np.int64), 1 << BITS), x, y)
    return model.weights(slice(None)).astype(np.float32)


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [(r["doc_id"], float(r["label"]), np.frombuffer(r["places"], np.uint32), np.frombuffer(r["counts"], np.uint32)) for b in batches for r in b.to_pylist()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([fit(rows).tobytes()], pa.binary())], ["weights"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> np.ndarray:
    """Weights learnt from labelled rows whose crc32(doc_id) mod 5 is not 0, at most ``max_rows`` of them."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    usable = usable.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"))
    total = usable.count()
    if total > max_rows:
        share = int(1e6 * min(1.0, 1.05 * max_rows / total)) + 1  # a few more, of which the first are taken
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
        usable = usable.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)), "doc_id").limit(max_rows)
    # at most max_rows ids and labels: a proven bound for the broadcast
    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chosen = texts.join(F.broadcast(usable), "doc_id").mapInArrow(_featured, "doc_id long, label int, places binary, counts binary")
    # rows of one doc_id multiply in the join: one stays of each, so that one task gets max_rows of them at most
    chosen = chosen.groupBy("doc_id", "label").agg(F.min(F.struct("places", "counts")).alias("x")).select("doc_id", "label", "x.places", "x.counts")
    found = chosen.repartition(1).mapInArrow(_fitted, "weights binary").collect()
    return np.frombuffer(found[0][0], np.float32) if found else np.zeros((1 << BITS) + 1, np.float32)


def score_block(values: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    place, borders = features(values, offsets)
    mean = B.sums(weights[place].astype(np.float64), borders) / np.maximum(np.diff(borders), 1)
    return 1 / (1 + np.exp(-np.clip(SCALE * mean + weights[-1], -30, 30)))


def _scored(weights, keep: float | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = B.bytes_of(batch.column("text"))
            parts = [score_block(values[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], weights.value) for i, j in B.blocks(offsets)]
            score = np.concatenate(parts or [np.zeros(0)])
            if keep is None:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])
            else:
                yield batch.filter(pa.array(score >= keep))

    return run


def classify(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = texts.mapInArrow(_scored(sent, None), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score at least the threshold, all columns as they were."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return small_batches(docs).mapInArrow(_scored(sent, THRESHOLD), docs.schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of the query op5_quality_classifier."""
    return classify(docs, train(docs, labels))
