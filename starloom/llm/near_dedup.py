"""Near duplicates by DartMinHash signatures, banded joins and exact verification.

A document's elements are its word shingles (five white-space separated words; a shorter text is one shingle of all its
words), each weighing as often as it occurs. Every element is thrown at with hashed darts: it owns a plane of weight
times rank, cut into regions that double in both directions, and a hash of (element, region) gives the darts there, as
a Poisson process does. Darts within the element's weight and under the document's rank limit count; each falls on one
of ``K`` coordinates, and the earliest on each coordinate is kept. Two documents agree on a coordinate with the
probability of their weighted Jaccard similarity, and only about K log K darts are looked at, however many elements
there are and however much they weigh. With ``weighted`` off every element weighs 1.

1. Equal texts are one row from here on (pre-aggregated by a 128-bit hash of the text).
2. Bands of the signature are joined by their smallest member: a star, never all pairs in a band. Members of a large
   band are dealt over several tasks. Verified stars join documents to components; first one star a document, then all
   others between components.
3. What is left are members of one band in different components. They are compared inside the band, in blocks of
   bounded size: by their signatures, then exactly, and only links that join components leave the block. So a link
   is lost only where the signatures miss it.

Verification is the exact weighted Jaccard similarity of the shingles (32-bit hashes). Components are found by rounds
of joins; no link is brought to the driver.

Nulls: a null text is empty; empty texts (no word) are copies only of the same text. Rows with a null doc_id belong
to classes, but name one only if all are null; unlike texts with one doc_id, or none, are classes of one name (comp
tells them apart). Repeated rows are one class; ``kept`` is true for each row that has its class's doc_id, while
keep_one keeps a single row. An empty table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm import bytesets as B
from starloom.llm.store import materialize, raw_documents, temporary

WORDS, SIMILARITY = 5, 0.8
K, BANDS = 64, 16
AGREE = 35  # coordinates of 64: at similarity 0.8 fewer agree once in a million
BLOCK = 1024  # members of a band compared at once
BROADCAST_ROWS = 200_000  # a checked size
FIRST = 6  # the first region of ranks ends at 2**-FIRST, each next one is as long as all before


def shingles(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document << 32 | 32-bit shingle), sorted, with repeats, and the documents' borders there."""
    starts, ends = B.runs(~B.SPACE[values], offsets)
    words = B.per_document(starts, offsets)
    n = np.diff(words)
    h = B.Prefix(values).of(starts, ends)
    doc = np.repeat(np.arange(len(n)), n)
    m = max(0, len(h) - WORDS + 1)
    whole = np.flatnonzero(doc[:m] == doc[WORDS - 1 :]) if m else np.zeros(0, np.int64)
    g = np.zeros(len(whole), np.uint64)
    for k in range(WORDS):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[whole + k]
    owner = doc[whole]
    short = np.flatnonzero((n > 0) & (n < WORDS))
    tail = []
    for d in short:
        t = np.uint64(0)
        for x in h[words[d] : words[d + 1]]:
            t = np.uint64((int(t) * 0x9E3779B97F4A7C15 + int(x)) & (1 << 64) - 1)
        tail.append(t)
    g, owner = np.concatenate([g, np.array(tail, np.uint64)]), np.concatenate([owner, short])
    keys = np.sort(owner.astype(np.uint64) << np.uint64(32) | B.mix(g) >> np.uint64(32))
    return keys, np.searchsorted(keys, np.arange(len(n) + 1, dtype=np.uint64) << np.uint64(32))


def _poisson(area: float) -> np.ndarray:
    """The distribution function, as far as it differs from 1."""
    out, k, log = [], 0, -area
    total = 0.0
    while total < 1 - 1e-12 and k < area + 12 * math.sqrt(area) + 40:
        total += math.exp(log)
        out.append(total)
        k += 1
        log += math.log(area) - math.log(k)
    return np.array(out)


def _levels(weight: np.ndarray) -> Iterator[tuple[int, float, float, np.ndarray]]:
    """Weight regions [0, 1), [1, 2), [2, 4) .. with the elements that reach into each."""
    level, low, high = 0, 0.0, 1.0
    reach = np.arange(len(weight))
    while len(reach):
        yield level, low, high, reach
        level, low, high = level + 1, high, 2 * high
        reach = reach[weight[reach] > low]


def signatures(elements: np.ndarray, owner: np.ndarray, documents: int, weight: np.ndarray | None = None, k: int = K) -> np.ndarray:
    """Earliest dart of each coordinate (32 bits), a row a document; 0 for documents without elements.

    ``elements`` are 64-bit hashes, one for each distinct element of a document, ``owner`` their documents.
    """
    weight = np.ones(len(elements)) if weight is None else weight.astype(np.float64)
    size = np.bincount(owner, weight, minlength=documents)
    best = np.full(documents * k, np.iinfo(np.uint64).max, np.uint64)
    todo = size > 0
    limit = np.where(todo, k * (math.log(k) + 2) / np.maximum(size, 1e-9), 0.0)
    while todo.any():
        mine = np.flatnonzero(todo[owner])
        for column, left, right, reach in _levels(weight[mine]):
            live, wide = mine[reach], right - left
            seed = elements[live] if not column else B.mix(elements[live] + np.uint64(column * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            level, low, high = 0, 0.0, 2.0**-FIRST
            while len(live):
                u = B.mix(seed ^ B.mix(np.full(1, level + 1, np.uint64)))
                count = np.searchsorted(_poisson(wide * (high - low)), (u >> np.uint64(11)).astype(np.float64) * 2.0**-53)
                hit = np.flatnonzero(count)
                n = count[hit]
                nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                dart = B.mix(np.repeat(u[hit], n) + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
                of = np.repeat(live[hit], n)
                doc = owner[of]
                rank = low + (dart >> np.uint64(40)).astype(np.float64) * 2.0**-24 * (high - low)
                under = rank <= limit[doc]
                if column:  # the first region lies within every weight, others may reach beyond it
                    place = left + (B.mix(dart) & np.uint64(0xFFFFFF)).astype(np.float64) * 2.0**-24 * wide
                    under &= place < weight[of]
                elif weight[of].min(initial=1.0) < 1:
                    under &= (B.mix(dart) & np.uint64(0xFFFFFF)).astype(np.float64) * 2.0**-24 < weight[of]
                dart, doc, rank = dart[under], doc[under], rank[under]
                packed = rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | B.mix(dart) >> np.uint64(32)
                np.minimum.at(best, doc * k + (dart & np.uint64(k - 1)).astype(np.int64), packed)
                level, low, high = level + 1, high, 2 * high
                on = low < limit[owner[live]]
                live, seed = live[on], seed[on]
        todo &= (best.reshape(-1, k) == np.iinfo(np.uint64).max).any(1)
        limit[todo] *= 2  # a coordinate without a dart: look further
    out = (best & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(-1, k)
    out[size == 0] = 0
    return out


def _signed(weighted: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = B.bytes_of(batch.column("raw"))
            for i, j in B.blocks(offsets):
                keys, _ = shingles(values[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
                sets = keys[first]
                count = np.diff(np.append(first, len(keys))) if weighted else np.ones(len(sets), np.int64)
                owner = (sets >> np.uint64(32)).astype(np.int64)
                sig = signatures(B.mix((sets & np.uint64(0xFFFFFFFF)) + np.uint64(1)), owner, j - i, count)
                borders = np.searchsorted(sets, np.arange(j - i + 1, dtype=np.uint64) << np.uint64(32))
                low, times, n = sets.astype(np.uint32), count.astype(np.uint32), B.sums(count, borders)
                part, ends = batch.slice(i, j - i), list(zip(borders, borders[1:], strict=False))
                several = n > np.diff(borders)  # weights are kept only where they are not all 1
                cols = [pa.array([s.tobytes() for s in sig], pa.binary()), pa.array(n), pa.array([low[a:b].tobytes() for a, b in ends], pa.binary()), pa.array([times[a:b].tobytes() if w else None for (a, b), w in zip(ends, several, strict=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), *cols], ["doc_id", "text_hash", "sig", "n", "shingles", "weights"])

    return run


def _unpacked(shingles: bytes, weights: bytes | None) -> tuple[np.ndarray, np.ndarray | None]:
    return np.frombuffer(shingles, np.uint32), None if weights is None else np.frombuffer(weights, np.uint32).astype(np.int64)


def _similar(similarity: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, v, y, w in zip(*(batch.column(c) for c in ("x", "v", "y", "w")), strict=True):
                good.append(alike(*_unpacked(x.as_py(), v.as_py()), *_unpacked(y.as_py(), w.as_py()), similarity))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    x, y = (sets.select(F.col("id").alias(i), F.col("shingles").alias(s), F.col("weights").alias(w)) for i, s, w in ("axv", "byw"))
    return pairs.join(x, "a").join(y, "b").mapInArrow(_similar(similarity), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """id and comp (the smallest id reached) of every end of the edges (a, b)."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("comp").alias("near"))
        moved = labels.join(near, labels.id == near.a).select("id", "comp", F.least("comp", "near").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("comp").alias("far"))
        moved = materialize(moved.join(jump, "low").select("id", F.col("comp").alias("old"), F.least("low", "far").alias("comp")), "labels")
        labels = moved.select("id", "comp")
        if moved.where("old <> comp").isEmpty():
            return labels


def alike(x: np.ndarray, v: np.ndarray | None, y: np.ndarray, w: np.ndarray | None, similarity: float) -> bool:
    """Whether two weighted sets are similar enough; weights of None are all 1."""
    one, two = len(x) if v is None else v.sum(), len(y) if w is None else w.sum()
    if min(one, two) < similarity * max(one, two):
        return False
    if v is None and w is None:
        both = len(np.intersect1d(x, y, assume_unique=True))
    else:
        _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        both = np.minimum(1 if v is None else v[i], 1 if w is None else w[j])
        both = int(both.sum()) if isinstance(both, np.ndarray) and both.ndim else len(i) * int(both)
    return both >= similarity * (one + two - both) - 1e-9


def _across(similarity: float) -> Callable:
    """Links between the components inside a block pair of a band: a spanning forest of them, not all pairs.

    A pair is looked at in the first band that its signatures share, if they agree enough, and verified at once."""

    def run(table: pa.Table) -> pa.Table:
        ids, comp, n, side, nth = (np.asarray(table.column(c).combine_chunks()) for c in ("id", "comp", "n", "side", "nth"))
        sig = np.frombuffer(b"".join(x.as_py() for x in table.column("sig")), np.uint32).reshape(len(ids), BANDS, K // BANDS)
        shingles, weights = table.column("shingles"), table.column("weights")
        held = lambda i: _unpacked(shingles[int(i)].as_py(), weights[int(i)].as_py())
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # 2: the block against itself
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while root.get(c, c) != c:
                c = root[c]
            return c

        links = []
        for i in left:
            other = right[right > i] if side[i] == 2 else right
            other = other[(comp[other] != comp[i]) & (np.minimum(n[other], n[i]) >= similarity * np.maximum(n[other], n[i]))]
            same = sig[other] == sig[i]
            other = other[(same.sum((1, 2)) >= AGREE) & (same.all(2).argmax(1) == nth[i])]
            mine = None
            for o in other:
                a, b = find(int(comp[i])), find(int(comp[o]))
                if a == b:
                    continue
                mine = mine or held(i)
                if alike(*mine, *held(o), similarity):
                    root[max(a, b)] = min(a, b)
                    links.append((min(ids[i], ids[o]), max(ids[i], ids[o])))
        cols = list(zip(*links, strict=True)) or [(), ()]
        return pa.table([pa.array(c, pa.int64()) for c in cols], ["a", "b"])

    return run


def _text_hash(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast where few rows are counted (some bytes each); beyond that the join shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, weighted: bool = True) -> DataFrame:
    """doc_id, text_hash, comp (the class itself) and class_id (the smallest doc_id of the class) of every document."""
    spark = docs.sparkSession
    raw = raw_documents(docs).select("doc_id", F.unhex(F.md5("raw")).alias("text_hash"), "raw")
    signed = raw.mapInArrow(_signed(weighted), "doc_id long, text_hash binary, sig binary, n long, shingles binary, weights binary")
    signed = materialize(signed.withColumn("id", F.monotonically_increasing_id()), "signed")
    texts = signed.groupBy("text_hash").agg(F.min("id").alias("id"), F.min("doc_id").alias("least"), F.max("n").alias("n"), F.max("sig").alias("sig"))
    texts = materialize(texts, "texts")
    rows = K // BANDS * 4
    keys = F.array(*(F.xxhash64(F.lit(b), F.substring("sig", 1 + b * rows, rows)) for b in range(BANDS)))
    bands = texts.where("n > 0").select(F.posexplode(keys).alias("nth", "band"), "id")
    stars = bands.groupBy("band").agg(F.min("id").alias("a"), F.count("*").alias("members")).where("members > 1")
    stars = materialize(stars.withColumn("slices", F.ceil(F.col("members") / BLOCK).cast("int")), "stars")
    # members of large bands are dealt over several tasks, each of which meets a copy of the band's star
    large = _small(stars.where("slices > 1").select("band", F.col("slices").alias("of")))
    dealt = bands.join(large, "band", "left").select("nth", "band", "id", F.coalesce(F.pmod(F.xxhash64("id"), F.col("of")), F.lit(0)).cast("int").alias("slice"))
    copies = stars.select("band", "a", "members", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    shared = materialize(dealt.join(copies, ["band", "slice"]).select("nth", "band", "a", "members", F.col("id").alias("b")), "bands")
    found = shared.select("b").distinct()
    sets = materialize(signed.select("id", "shingles", "weights").join(_small(found), F.col("id") == F.col("b"), "left_semi"), "sets")
    pairs = shared.where("a <> b").select("a", "b").distinct()
    # one star a document, then the other stars between components
    links = materialize(_verified(pairs.groupBy("b").agg(F.min("a").alias("a")), sets, similarity), "links")
    comp = components(links)

    def between(p: DataFrame) -> DataFrame:
        at = lambda c: comp.select(F.col("id").alias(c), F.col("comp").alias(f"comp_{c}"))
        q = p.join(at("a"), "a", "left").join(at("b"), "b", "left")
        return q.where(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")).select("a", "b")

    more = materialize(_verified(between(pairs), sets, similarity), "links")
    if not more.isEmpty():
        links = links.union(more)
        comp = components(links)
    # members of one band in different components
    member = shared.select("nth", "band", F.col("b").alias("id"), "members").join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    mixed = member.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("band")
    mixed = _small(materialize(mixed, "mixed"))
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    open_ = member.join(mixed, "band", "left_semi").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # block i meets block j for i <= j: a row goes to each pair that its block is in
    open_ = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    open_ = open_.withColumn("side", F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    whole_rows = open_.join(texts.select("id", "n", "sig"), "id").join(sets, "id").select("nth", "band", "i", "j", "id", "comp", "n", "side", "sig", "shingles", "weights")
    rest = materialize(whole_rows.groupBy("band", "i", "j").applyInArrow(_across(similarity), "a long, b long"), "links")
    if not rest.isEmpty():
        comp = components(links.union(rest))
    whole = texts.select("text_hash", "id", "least").join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    named = whole.groupBy("comp").agg(F.min("least").alias("class_id"))
    return signed.select("doc_id", "text_hash").join(whole.join(named, "comp").select("text_hash", "comp", "class_id"), "text_hash")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the smallest doc_id, all columns as they were."""
    with temporary(docs.sparkSession):  # signatures and sets are not needed any more once it is chosen
        first = near_duplicates(docs).where(F.col("doc_id").eqNullSafe(F.col("class_id")))
        # of rows with this doc_id in a class, one text and of that one row stays; classes of one name are still several
        chosen = first.groupBy("comp").agg(F.min("text_hash").alias("keep_hash"), F.first("doc_id").alias("keep_id"), F.count("*").alias("rows"))
        chosen = materialize(chosen, "chosen", stay=True)
    # conditions on expressions, rows as a struct: no inner column can meet one of the caller's
    mine, text = docs["doc_id"].cast("long"), _text_hash(docs["text"])
    kept = docs.join(chosen, mine.eqNullSafe(chosen["keep_id"]) & (text == chosen["keep_hash"]), "left_semi")
    if not chosen.where("rows > 1").isEmpty():  # else each row is there once, and no window is needed
        row = kept.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
        one = Window.partitionBy(F.col("row.doc_id").cast("long"), _text_hash(F.col("row.text"))).orderBy(F.lit(0))
        row = row.select("row", F.row_number().over(one).alias("nth")).where("nth = 1")
        kept = row.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
    return kept


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the query op7_near_dedup."""
    return near_duplicates(docs).select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))
