"""Masked pseudo-likelihood: a bidirectional window network predicts every token from both sides.

Tokens are white-space separated words, each known by its 64-bit hash. All words of all documents are counted in a
table that grows with the corpus. The most frequent OWN words are classes of their own, the others are dealt to the
remaining classes at equal mass (by count as far as the 2**BITS most frequent words, which every task holds; by hash
beyond them), and P(token) = P(class | window) * count(word) / count(class). Counts of words beyond the frequent ones
are joined back to the documents that have them. The network sees WINDOW classes on either side (class 0
beyond the text's borders), one rectified layer whose last unit is always 1, softmax over classes.

Texts are read twice: once to count words, once to write their classes (a byte a token). Training deals documents by a
hash to groups of about GROUP tokens, whose number grows with the corpus, and reads each group in the order of that
hash: every group learns by Adagrad in NumPy from the same starting weights, and the groups' weights are averaged by
tokens. This is repeated in ROUNDS rounds, in each of which one in ROUNDS of every document's tokens is a target, so
every token is one once. Groups and steps depend on the documents alone, not on how the table is partitioned; only
the order in which 64-bit sums are added may differ. Weights are added up in streaming lanes; the driver sees arrays of
fixed size only.

A document's score is the sum of its tokens' conditional log-probabilities; mean_logp is that sum by token.

Nulls and empty texts have no tokens: sum 0, mean null. Very long texts are scored whole. Repeated rows each count and
each give a row. An empty table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm import bytesets as B
from starloom.llm.store import materialize, raw_documents, shuffle_partitions, sum_blobs

BITS, CLASSES, OWN = 18, 128, 95
WINDOW, HIDDEN = 2, 32
ROUNDS, BATCH, RATE = 2, 1024, 0.1
GROUP, PART = 1 << 21, 1 << 16  # tokens that one group learns from, and that are handled at once
HELD = 1 << 20  # words a task counts before it passes them on
SHAPES = {"t": (2 * WINDOW, CLASSES, HIDDEN), "b": (HIDDEN,), "u": (HIDDEN, CLASSES)}


def bins(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of a block's words, and the documents' borders there."""
    starts, ends = B.runs(~B.SPACE[values], offsets)
    return B.Prefix(values).of(starts, ends).view(np.int64), B.per_document(starts, offsets)


class Classes:
    """Each word's class. ``words`` are the frequent ones with their ``counts``, ``others`` is the count of all others."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, others: int):
        at = np.argsort(words)
        self.words, self.counts = words[at], counts[at]
        order = np.argsort(-self.counts, kind="stable")
        tail = order[OWN:]
        mass = np.cumsum(self.counts[tail].astype(np.float64))
        known = mass[-1] if len(mass) else 0.0
        rest = CLASSES - OWN - 1
        self.of_known = np.zeros(len(words), np.uint8)
        self.of_known[order[:OWN]] = np.arange(1, len(order[:OWN]) + 1)
        self.of_known[tail] = OWN + 1 + np.minimum(mass / max(known + others, 1.0) * rest, rest - 1).astype(np.int64)
        self.first = known / max(known + others, 1.0)
        # most words are found at once, at the place that their last bits name
        self.places = np.zeros(4 << BITS, np.int32)
        self.places[self.words[order[::-1]] & ((4 << BITS) - 1)] = order[::-1]

    def find(self, found: np.ndarray) -> np.ndarray:
        """Where the frequent words are, -1 for others."""
        if not len(self.words):
            return np.full(len(found), -1, np.int32)
        at = self.places[found & (len(self.places) - 1)]
        miss = np.flatnonzero(self.words[at] != found)
        i = np.minimum(np.searchsorted(self.words, found[miss]), len(self.words) - 1)
        at[miss] = np.where(self.words[i] == found[miss], i, -1)
        return at

    def at(self, found: np.ndarray, where: np.ndarray) -> np.ndarray:
        out = np.zeros(len(found), np.uint8)
        frequent = where >= 0
        out[frequent] = self.of_known[where[frequent]]
        rest = CLASSES - OWN - 1
        u = (B.mix(found[~frequent].view(np.uint64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        out[~frequent] = OWN + 1 + np.minimum((self.first + u * (1 - self.first)) * rest, rest - 1).astype(np.int64)
        return out

    def __getitem__(self, found):
        one = np.asarray(found, np.int64)
        return self.at(one.ravel(), self.find(one.ravel())).reshape(one.shape)[()]


class Inside:
    """Log-probabilities of words in their classes: those of frequent words at hand, counts of others in ``rare``
    (word, n), without words that occur once; None if there are no others. Unseen words count as occurring once."""

    def __init__(self, cls: Classes, totals: np.ndarray, rare: DataFrame | None):
        self.cls, self.rare = cls, rare
        self.minus = -np.log(np.maximum(totals, 1))
        self.known = np.log(np.maximum(cls.counts, 1)) + self.minus[cls.of_known]

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        return self.known, self.minus

    def __getitem__(self, word) -> float:
        at = self.cls.find(np.array([word], np.int64))[0]
        if at >= 0:
            return float(self.known[at])
        n = self.rare.where(F.col("word") == int(word)).collect() if self.rare is not None else []
        return float(self.minus[self.cls[word]] + (np.log(n[0].n) if n else 0.0))


def fresh() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(11)
    out = {k: (rng.normal(0, 0.1, s) if k in "tu" else np.zeros(s)).astype(np.float32) for k, s in SHAPES.items()}
    out["t"][:, :, -1], out["b"][-1], out["u"][-1] = 0, 1, 0
    return out


def flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in SHAPES])


def unflat(x: np.ndarray) -> dict[str, np.ndarray]:
    out, i = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = x[i : i + n].reshape(s).astype(np.float32)
        i += n
    return out


def contexts(cls: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """The classes around each token, a row each; 0 beyond the document."""
    n = len(cls)
    doc = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
    left = np.arange(n) - borders[doc]
    right = borders[doc + 1] - 1 - np.arange(n)
    out = np.zeros((n, 2 * WINDOW), np.uint8)
    for k in range(1, WINDOW + 1):
        i = np.flatnonzero(left >= k)
        out[i, WINDOW - k] = cls[i - k]
        i = np.flatnonzero(right >= k)
        out[i, WINDOW + k - 1] = cls[i + k]
    return out


class Buffers:
    """Arrays that steps of up to BATCH tokens are worked out in: fresh ones would cost more than the sums."""

    def __init__(self):
        self.h, self.part, self.p = (np.empty((BATCH, n), np.float32) for n in (HIDDEN, HIDDEN, CLASSES))
        self.rows, self.ones = np.arange(BATCH), np.ones((CLASSES, 1), np.float32)

    def hidden(self, w: dict[str, np.ndarray], ctx: np.ndarray) -> np.ndarray:
        n = len(ctx)
        h, part = self.h[:n], self.part[:n]
        np.take(w["t"][0], ctx[:, 0], axis=0, out=h, mode="clip")
        h += w["b"]
        for k in range(1, 2 * WINDOW):
            np.take(w["t"][k], ctx[:, k], axis=0, out=part, mode="clip")
            h += part
        return np.maximum(h, 0, out=h)

    def shares(self, w: dict[str, np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """exp(logits) and its sum, by row; logits end at 80, far beyond what training gives."""
        p = self.p[: len(h)]
        np.matmul(h, w["u"], out=p)
        np.minimum(p, 80, out=p)
        np.exp(p, out=p)
        return p, p @ self.ones


def class_logp(w: dict[str, np.ndarray], ctx: np.ndarray, target: np.ndarray) -> np.ndarray:
    out, held = np.empty(len(target), np.float64), Buffers()
    for s in range(0, len(target), BATCH):
        p, total = held.shares(w, held.hidden(w, ctx[s : s + BATCH]))
        mine = p[held.rows[: len(p)], target[s : s + BATCH]]
        out[s : s + BATCH] = np.log(np.maximum(mine, 1e-37)) - np.log(total[:, 0])
    return out


class Trainer:
    """Adagrad on batches of masked tokens."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: v.copy() for k, v in weights.items()}
        self.g = {k: np.full(s, 1e-3, np.float32) for k, s in SHAPES.items()}
        self.seen, self.held = 0, Buffers()

    def step(self, ctx: np.ndarray, target: np.ndarray) -> None:
        h = self.held.hidden(self.w, ctx)
        p, total = self.held.shares(self.w, h)
        p /= total * np.float32(len(p))
        p[self.held.rows[: len(p)], target] -= np.float32(1 / len(p))
        dh = np.matmul(p, self.w["u"].T, out=self.held.part[: len(p)])
        dh *= h > 0
        dh[:, -1] = 0  # the unit that is always 1
        grad = {"u": h.T @ p, "b": dh.sum(0), "t": np.zeros(SHAPES["t"], np.float32)}
        for k in range(2 * WINDOW):
            order = np.argsort(ctx[:, k], kind="stable")
            c = ctx[order, k]
            first = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
            grad["t"][k][c[first]] = np.add.reduceat(dh[order], first)
        for k, d in grad.items():
            self.g[k] += d * d
            self.w[k] -= RATE * d / np.sqrt(self.g[k])
        self.seen += len(target)

    def learn(self, ctx: np.ndarray, target: np.ndarray) -> None:
        for s in range(0, len(target), BATCH):
            self.step(ctx[s : s + BATCH], target[s : s + BATCH])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        values, offsets = B.bytes_of(batch.column("raw"))
        for i, j in B.blocks(offsets):
            yield bins(values[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def _merged(words: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
    w, n = np.concatenate(words), np.concatenate(counts)
    order = np.argsort(w)
    w, n = w[order], n[order]
    first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
    return pa.RecordBatch.from_arrays([pa.array(w[first]), pa.array(np.add.reduceat(n, first))], ["word", "n"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, counts, held = [], [], 0
    for found, _ in _blocks(batches):
        if len(found):
            w, n = np.unique(found, return_counts=True)
            words.append(w)
            counts.append(n.astype(np.int64))
            held += len(w)
        if held > HELD:
            yield _merged(words, counts)
            words, counts, held = [], [], 0
    if held:
        yield _merged(words, counts)


def _totals(sent) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES, np.int64)
        for batch in batches:
            word, n = (batch.column(c).to_numpy() for c in ("word", "n"))
            np.add.at(total, sent.value[word], n)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["totals"])

    return run


def count_words(raw: DataFrame) -> tuple[Classes, Inside]:
    """Classes and log-probabilities of all words."""
    counts = materialize(raw.mapInArrow(_counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    level = F.floor(F.log2("n") * 256)  # a few thousand levels, whatever the input
    frequent, words, others = None, 0, 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect(), reverse=True):
        if others or words + r.words > 1 << BITS:
            others += r.n
        else:
            frequent, words = r.level, words + r.words
    known = counts.where(F.lit(False) if frequent is None else level >= frequent).toArrow()
    cls = Classes(*(known.column(c).to_numpy() for c in ("word", "n")), others)
    totals = np.bincount(cls.of_known, cls.counts, CLASSES).astype(np.int64)
    if not others:
        return cls, Inside(cls, totals, None)
    rare = counts if frequent is None else counts.where(level < frequent)
    totals += sum_blobs(rare.mapInArrow(_totals(raw.sparkSession.sparkContext.broadcast(cls)), "totals binary"), "i8")
    return cls, Inside(cls, totals, rare.where("n > 1"))


def turn_of(classes: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """The round in which each token is a target: every token has one."""
    nth = np.arange(len(classes)) - np.repeat(borders[:-1], np.diff(borders))
    return B.mix((nth.astype(np.uint64) << np.uint64(8)) + classes.astype(np.uint64)) % np.uint64(ROUNDS)


def _coded(sent) -> Callable:
    """Classes of each document's tokens, the sum of their logarithms inside classes as far as counts are at hand, and
    the words whose counts are not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, known, minus = sent.value
        for batch in batches:
            values, offsets = B.bytes_of(batch.column("raw"))
            for i, j in B.blocks(offsets):
                found, borders = bins(values[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                where = cls.find(found)
                classes = cls.at(found, where)
                other = np.flatnonzero(where < 0)
                inside = known[where] if len(known) else np.zeros(len(found))
                inside[other] = minus[classes[other]]
                rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(other, borders), pa.int32()), pa.array(found[other]))
                blobs = [classes[a:b].tobytes() for a, b in zip(borders, borders[1:], strict=False)]
                hashes = B.mix(B.Prefix(values).of(offsets[i:j], offsets[i + 1 : j + 1])).view(np.int64)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(borders)), pa.array(B.sums(inside, borders)), pa.array(blobs, pa.binary()), pa.array(hashes), rare], ["doc_id", "n_tokens", "inside", "classes", "place", "rare"])

    return run


def code(docs: DataFrame, cls: Classes, inside: Inside) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast((cls, *inside.arrays()))
    rows = raw_documents(docs).mapInArrow(_coded(sent), "doc_id long, n_tokens long, inside double, classes binary, place long, rare array<long>")
    return materialize(rows.withColumn("id", F.monotonically_increasing_id()), "coded")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(group, classes, borders): documents of a group, in their order, as soon as they have PART tokens together."""
    held: list[bytes] = []
    size, group = 0, None

    def out() -> tuple[int, np.ndarray, np.ndarray]:
        return group, np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)])

    for batch in batches:
        for g, c in zip(batch.column("group").to_pylist(), batch.column("classes").to_pylist(), strict=True):
            if held and (g != group or size >= PART):
                yield out()
                held, size = [], 0
            group = g
            held.append(c)
            size += len(c)
    if held:
        yield out()


def _trained(sent, turn: int) -> Callable:
    """Rows sorted by group: a row with weights for each of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, at = None, None

        def out() -> pa.RecordBatch:
            weighted = np.append(flat(trainer.w).astype(np.float64) * trainer.seen, trainer.seen)
            return pa.RecordBatch.from_arrays([pa.array([weighted.tobytes()], pa.binary())], ["weights"])

        for group, classes, borders in _parts(batches):
            if group != at:
                if trainer:
                    yield out()
                trainer, at = Trainer(unflat(sent.value)), group
            masked = np.flatnonzero(turn_of(classes, borders) == turn)
            ctx = contexts(classes, borders)[masked]
            order = np.random.default_rng(len(classes)).permutation(len(masked))
            trainer.learn(ctx[order], classes[masked][order].astype(np.intp))
        if trainer:
            yield out()

    return run


def _learnt(coded: DataFrame) -> np.ndarray:
    """The network's weights, from the written classes of all documents."""
    spark = coded.sparkSession
    tokens = coded.agg(F.sum("n_tokens")).first()[0] or 0
    groups = max(1, -(-tokens // GROUP))
    dealt = coded.where("n_tokens > 0").select(F.pmod(F.xxhash64("place", "doc_id"), F.lit(groups)).alias("group"), "place", "doc_id", "classes")
    dealt = dealt.repartition(max(1, min(groups, shuffle_partitions(spark))), "group").sortWithinPartitions("group", "place", "doc_id").select("group", "classes")
    weights = flat(fresh())
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast(weights)
        total = sum_blobs(dealt.mapInArrow(_trained(sent, turn), "weights binary"), "f8")
        if total is not None and total[-1]:
            weights = (total[:-1] / total[-1]).astype(np.float32)
    return weights


def train(docs: DataFrame) -> tuple[Classes, Inside, np.ndarray]:
    """Classes and log-probabilities of the words, and the network's weights, from all documents."""
    cls, inside = count_words(raw_documents(docs).select("raw"))
    return cls, inside, _learnt(code(docs, cls, inside))


def _scored(sent) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = unflat(sent.value)
        for batch in batches:
            blobs = batch.column("classes").to_pylist()
            ends = np.cumsum([0, *map(len, blobs)])
            total = [np.zeros(0)]
            for i, j in B.blocks(ends, PART):
                classes, borders = np.frombuffer(b"".join(blobs[i:j]), np.uint8), ends[i : j + 1] - ends[i]
                total.append(B.sums(class_logp(weights, contexts(classes, borders), classes.astype(np.intp)), borders))
            cols = [batch.column(c) for c in ("id", "doc_id", "n_tokens", "inside")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate(total))], ["id", "doc_id", "n_tokens", "inside", "logp"])

    return run


def score(docs: DataFrame, model: tuple | None = None) -> DataFrame:
    """doc_id, n_tokens, sum_logp and mean_logp of every document; the model is trained on ``docs`` if not given."""
    cls, inside = model[:2] if model else count_words(raw_documents(docs).select("raw"))
    coded = code(docs, cls, inside)
    sent = docs.sparkSession.sparkContext.broadcast(model[2] if model else _learnt(coded))
    out = coded.select("id", "doc_id", "n_tokens", "inside", "classes").mapInArrow(_scored(sent), "id long, doc_id long, n_tokens long, inside double, logp double")
    total = F.col("logp") + F.col("inside")
    if inside.rare is not None:
        logs = coded.select("id", F.explode("rare").alias("word")).join(inside.rare, "word").groupBy("id").agg(F.sum(F.ln("n")).alias("more"))
        out, total = out.join(logs, "id", "left"), total + F.coalesce("more", F.lit(0.0))
    out = out.select("doc_id", "n_tokens", total.alias("sum_logp"))
    return out.withColumn("mean_logp", F.when(F.col("n_tokens") > 0, F.col("sum_logp") / F.col("n_tokens")))


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the query op10_lm_scoring."""
    return score(docs)
