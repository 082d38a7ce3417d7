"""Exact top-k by inner product: vectors in descending length, partial sums, Cauchy-Schwarz bounds.

Vectors are rotated by the singular vectors of the whole table (from its Gram matrix, summed by task), so that the
first few coordinates carry most of an inner product. They are range-sorted by length, packed into blocks and written.
Every query first meets the few longest blocks, which gives a lower limit for its k-th best score. Then queries are
sent to the blocks, never blocks to the queries: a bounded number of queries at a time is broadcast, and a task streams
through its blocks from the longest on. Blocks that no query of the pass can win in are not read at all; a block goes
unseen by a query if |query| * |longest vector| is below its limit; of the others the partial sum over the first
coordinates plus |rest of query| * |rest of vector| bounds the score, and only vectors that can still win get their
exact integer product. Each task's best k of a query meet in a last ranking.

A task holds one block and one pass of queries. Ties go to the smaller vec_id. A query's own row is no candidate;
another row of the same vec_id is.

Nulls: vectors null, holding null or non-finite components, or with a null vec_id take no part. Shorter vectors count
as if filled up with zeros; an empty vector has score 0 with all. Repeated rows are candidates each. An empty table
gives an empty result. Columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm.store import materialize, new_path, shuffle_partitions, sum_blobs

BLOCK, QUERIES, HEAD, EVERY = 1024, 4096, 16, 50
SEEDS = 4  # blocks of the longest vectors that every query meets first
PASS = 1 << 22  # numbers in the queries that are broadcast at once: 32 MB
DENSE = 0.02  # share of open pairs from which a block is multiplied as a whole


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of integers, filled up with zeros."""
    flat = np.asarray(column.flatten(), np.float64)
    n = np.asarray(column.value_lengths(), np.int64)
    out = np.zeros((len(column), dims))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = np.floor(256 * flat)
    return out


def _gram(dims: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            x = _matrix(batch.column("embedding"), dims)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["gram"])

    return run


def _packed(dims: int, size: int) -> Callable:
    """Blocks of ``size`` rows in the order they come: their rows, ids and vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, ids, x = [], [], []

        def out() -> pa.RecordBatch:
            cols = [np.concatenate(row), np.concatenate(ids), np.concatenate(x)]
            for name, a in ((row, cols[0]), (ids, cols[1]), (x, cols[2])):
                name[:] = [a[size:]]
            top = float(np.linalg.norm(cols[2][:size], axis=1).max(initial=0))
            return pa.RecordBatch.from_arrays([*(pa.array([a[:size].tobytes()], pa.binary()) for a in cols), pa.array([top])], ["rows", "ids", "vectors", "top"])

        for batch in batches:
            row.append(np.asarray(batch.column("row"), np.int64))
            ids.append(np.asarray(batch.column("vec_id"), np.int64))
            x.append(_matrix(batch.column("embedding"), dims))
            while sum(map(len, row)) >= size:
                yield out()
        if sum(map(len, row)):
            yield out()

    return run


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of q with those of x, pair by pair."""
    top = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1])
    if top < 2**53:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for u, v in zip(q, x, strict=True)], np.int64)


class Search:
    """The best k of some queries among the blocks they have met; ``limit`` is what a score must reach at least."""

    def __init__(self, queries: tuple, rotation: np.ndarray, k: int, limit: np.ndarray | None = None):
        self.row, self.id, self.q = queries
        self.k, self.rotation = k, rotation
        self.turned = self.q @ rotation
        self.length = np.linalg.norm(self.q, axis=1)
        self.rest = np.linalg.norm(self.turned[:, HEAD:], axis=1)
        self.limit = np.full(len(self.q), -np.inf) if limit is None else limit.copy()
        self.score, self.found = np.full((len(self.q), k), np.iinfo(np.int64).min), np.zeros((len(self.q), k), np.int64)

    def meet(self, row: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        q, k, limit = self.q, self.k, self.limit
        norms = np.linalg.norm(x, axis=1)
        active = np.flatnonzero(self.length * norms.max(initial=0) * (1 + 1e-9) + 1e-6 >= limit)
        if not len(active):
            return
        y = x @ self.rotation
        bound = self.turned[active, :HEAD] @ y[:, :HEAD].T + self.rest[active, None] * np.linalg.norm(y[:, HEAD:], axis=1)[None, :]
        slack = (self.length[active, None] * norms[None, :]) * 1e-9 + 1e-6
        open_ = (bound + slack >= limit[active, None]) & (self.row[active, None] != row[None, :])
        if open_.mean() > DENSE and np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1]) < 2**53:
            # many pairs: one product, exact as all sums are integers below 2**53; only a query's best k of the block stay
            s = np.where(open_, q[active] @ x.T, -np.inf)
            least = limit[active]
            if s.shape[1] > k:
                least = np.maximum(least, np.partition(s, -k, axis=1)[:, -k])
            a, c = np.nonzero((s >= least[:, None]) & open_)
            who, score = active[a], s[a, c].astype(np.int64)
        else:
            a, c = np.nonzero(open_)
            who = active[a]
            score = np.empty(len(who), np.int64)
            for b in range(0, len(who), 1 << 16):
                score[b : b + (1 << 16)] = _exact(q[who[b : b + (1 << 16)]], x[c[b : b + (1 << 16)]])
            wins = score >= limit[who]
            who, c, score = who[wins], c[wins], score[wins]
        self._rank(who, score, ids[c])

    def _rank(self, who: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """A query's best so far and its new ones, ranked."""
        none, touched = np.iinfo(np.int64).min, np.unique(who)
        all_q = np.concatenate([np.repeat(touched, self.k), who])
        all_s, all_i = np.concatenate([self.score[touched].ravel(), score]), np.concatenate([self.found[touched].ravel(), ids])
        real = all_s != none
        all_q, all_s, all_i = all_q[real], all_s[real], all_i[real]
        order = np.lexsort((all_i, -all_s, all_q))
        all_q, all_s, all_i = all_q[order], all_s[order], all_i[order]
        nth = np.arange(len(all_q)) - np.searchsorted(all_q, all_q)
        top = nth < self.k
        self.score[touched] = none
        self.score[all_q[top], nth[top]], self.found[all_q[top], nth[top]] = all_s[top], all_i[top]
        full = touched[self.score[touched, self.k - 1] != none]
        self.limit[full] = np.maximum(self.limit[full], self.score[full, self.k - 1])

    def result(self) -> pa.RecordBatch:
        i, n = np.nonzero(self.score != np.iinfo(np.int64).min)
        return pa.RecordBatch.from_arrays([pa.array(a) for a in (self.row[i], self.id[i], self.found[i, n], self.score[i, n])], ["query_row", "query_id", "vec_id", "score"])


def _unpacked(rows: bytes, ids: bytes, vectors: bytes, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r = np.frombuffer(rows, np.int64)
    return r, np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.float64).reshape(len(r), dims)


def _limited(sent, dims: int, k: int) -> Callable:
    """Query blocks with the limits that the longest blocks give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotation, seeds = sent.value
        for batch in batches:
            for r in batch.to_pylist():
                found = Search(_unpacked(r["rows"], r["ids"], r["vectors"], dims), rotation, k)
                for b in seeds:
                    found.meet(*b)
                yield pa.RecordBatch.from_arrays([pa.array([r[c]], pa.binary()) for c in ("rows", "ids", "vectors")] + [pa.array([found.limit.tobytes()], pa.binary())], ["rows", "ids", "vectors", "limits"])

    return run


def _searched(sent, dims: int, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotation, queries = sent.value
        found = [Search(q[:3], rotation, k, q[3]) for q in queries]
        for batch in batches:
            for c in range(batch.num_rows):
                block = _unpacked(*(batch.column(n)[c].as_py() for n in ("rows", "ids", "vectors")), dims)
                for f in found:
                    f.meet(*block)
        for f in found:
            yield f.result()

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id and score: the best k of every row whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    clean = clean.where("vec_id is not null and embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    clean = clean.withColumn("row", F.monotonically_increasing_id())
    dims = clean.agg(F.max(F.size("embedding"))).first()[0] or 1
    gram = sum_blobs(clean.mapInArrow(_gram(dims), "gram binary"), "f8")
    rotation = np.linalg.eigh(np.zeros((dims, dims)) if gram is None else gram.reshape(dims, dims))[1][:, ::-1].copy()
    length = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    by_length = clean.withColumn("length", length).repartitionByRange(shuffle_partitions(spark), F.col("length").desc(), "row").sortWithinPartitions(F.col("length").desc(), "row")
    names = "rows binary, ids binary, vectors binary"
    blocks = by_length.select("row", "vec_id", "embedding").mapInArrow(_packed(dims, BLOCK), names + ", top double")
    blocks = materialize(blocks, "blocks")
    open_ = lambda r: _unpacked(r["rows"], r["ids"], r["vectors"], dims)
    seeds = [open_(r) for r in blocks.orderBy(F.col("top").desc()).limit(SEEDS).collect()]  # a few blocks of bounded size
    # queries are taken from the written blocks, where rows have their numbers
    n_queries = blocks.mapInArrow(_counted(every), "n long").agg(F.sum("n")).first()[0] or 0
    queries = blocks.mapInArrow(_queries(dims, every), names).repartition(max(1, -(-n_queries // QUERIES))).mapInArrow(_queries(dims, 1), names)
    sent = spark.sparkContext.broadcast((rotation, seeds))
    queries = materialize(queries.mapInArrow(_limited(sent, dims, k), names + ", limits binary"), "queries")
    path, result = new_path(spark, "found"), "query_row long, query_id long, vec_id long, score long"

    def run(group: list[tuple]) -> None:
        """One pass of queries over all blocks that they can win in."""
        least = min(float(np.min((x[3] - 1e-3) / np.maximum(np.linalg.norm(x[2], axis=1), 1e-9) * (1 - 1e-6), initial=np.inf)) for x in group)
        here = blocks.where(F.col("top") >= least) if least > 0 else blocks
        found = here.select("rows", "ids", "vectors").mapInArrow(_searched(spark.sparkContext.broadcast((rotation, group)), dims, k), result)
        found.write.mode("append").option("compression", "zstd").parquet(path)

    held, passes = [], 0
    for r in queries.toLocalIterator():  # a partition at a time, and no more than a pass of them is held
        held.append((*open_(r), np.frombuffer(r["limits"], np.float64)))
        if sum(x[2].size for x in held) >= PASS:
            run(held)
            held, passes = [], passes + 1
    if held or not passes:
        run(held) if held else spark.createDataFrame([], result).write.parquet(path)
    rank = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    found = spark.read.schema(result).parquet(path)
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _counted(every: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = sum(int((np.frombuffer(x.as_py(), np.int64) % every == 0).sum()) for x in batch.column("ids"))
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return run


def _queries(dims: int, every: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            held[:] = [tuple(c[QUERIES:] for c in cols)]
            return pa.RecordBatch.from_arrays([pa.array([c[:QUERIES].tobytes()], pa.binary()) for c in cols], ["rows", "ids", "vectors"])

        for batch in batches:
            for r in batch.to_pylist():
                row, ids, x = _unpacked(r["rows"], r["ids"], r["vectors"], dims)
                use = ids % every == 0
                held.append((row[use], ids[use], x[use]))
                while sum(len(h[0]) for h in held) >= QUERIES:
                    yield out()
        if sum(len(h[0]) for h in held):
            yield out()

    return run


def digest(vectors: DataFrame) -> DataFrame:
    """The columns of the query op3_top_k."""
    return top_k(vectors).select("query_id", "rank", "vec_id", "score")
