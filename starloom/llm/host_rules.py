"""Document rules, and verdicts on whole hosts.

Every document is measured by fixed rules. Its host is that of the URL in ``source``, or ``source`` itself where it is
no URL, lower-cased. Failures are summed by host before they are shuffled, so a host with a third of all rows costs one
row a task. The hosts' failure rates follow a beta prior fitted by moments over all hosts (each weighted by its size),
and a host's rate is shrunk towards it: (failures + a) / (documents + a + b). A host is rejected as a whole where its
rate lies above the corpus' by more than ``margin`` with a posterior probability of CREDIBLE (normal approximation of
the beta posterior), and the verdict is joined back to its documents. Small hosts are thereby judged by the prior until
they have shown enough documents; where all hosts fail alike none is rejected, whatever the common rate.

Nulls: a null text has no words and fails the base rule; null sources are one host of their own. Empty and very long
texts are measured whole. Repeated rows count each. An empty table gives an empty result. Columns other than doc_id,
text and source are not read; the filter carries them along. If all hosts have one rate the prior is as strong as all
documents together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.llm import bytesets as B
from starloom.llm.store import materialize, small_batches

MIN_WORDS, MAX_REPEATED = 10, 20  # base rule: at least so many words, at most so many percent of them repeated
WINDOW = 5
MARGIN = 0.2  # how far a host's failure rate may lie above that of the corpus
Z = 1.645  # CREDIBLE = 0.95, one-sided
BROADCAST_HOSTS = 100_000
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True  # fixed values of the contract


def measure(values: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The five counts of each document of a block."""
    n = len(offsets) - 1
    space = B.SPACE[values]
    starts, ends = B.runs(~space, offsets)
    words = B.per_document(starts, offsets)
    out = {"n_words": np.diff(words), "word_chars": B.sums(~space & ((values & 0xC0) != 0x80), offsets), "n_symbols": B.sums(SYMBOLS[values], offsets)}
    prefix = B.Prefix(values)
    # lines: newlines and document borders cut
    inner = np.flatnonzero(values == 10)
    owner = np.searchsorted(offsets, inner, "right") - 1
    line_start = np.concatenate([offsets[:-1], inner + 1])
    line_doc = np.concatenate([np.arange(n), owner])
    order = np.lexsort((line_start, line_doc))
    line_start, line_doc = line_start[order], line_doc[order]
    last = np.append(line_doc[1:] != line_doc[:-1], True) if n else np.zeros(0, bool)
    line_end = np.where(last, offsets[line_doc + 1], np.append(line_start[1:], 0) - 1) if n else line_start
    has_word = np.searchsorted(starts, line_end, "left") > np.searchsorted(starts, line_start, "left")
    key = B.mix(prefix.of(line_start, line_end) ^ B.mix(line_doc.astype(np.uint64) + np.uint64(1)))[has_word]
    doc = line_doc[has_word]
    _, first = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[first] = False
    out["n_dup_lines"] = np.bincount(doc[again], minlength=n)
    # windows of five words that occur twice or more in their document
    repeated = np.zeros(len(starts) + 1, np.int64)
    if len(starts) >= WINDOW:
        hashed = prefix.of(starts, ends)
        word_doc = np.repeat(np.arange(n), out["n_words"])
        m = len(starts) - WINDOW + 1
        whole = word_doc[:m] == word_doc[WINDOW - 1 :]
        h = np.zeros(m, np.uint64)
        for k in range(WINDOW):
            h = h * np.uint64(0x9E3779B97F4A7C15) + hashed[k : k + m]
        at = np.flatnonzero(whole)
        h = B.mix(h[at] ^ B.mix(word_doc[at].astype(np.uint64) + np.uint64(7)))
        order = np.argsort(h)
        s = h[order]
        same = s[1:] == s[:-1]
        twice = np.zeros(len(s), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = at[order[twice]]
        np.add.at(repeated, hit, 1)
        np.add.at(repeated, hit + WINDOW, -1)
    out["n_repeat_words"] = B.sums(np.cumsum(repeated)[:-1] > 0, words)
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values, offsets = B.bytes_of(batch.column("raw"))
        parts = [measure(values[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in B.blocks(offsets)]
        cols = [np.concatenate([p[k] for p in parts] or [np.zeros(0)]).astype(np.int64) for k in METRICS]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), *map(pa.array, cols)], ["doc_id", "host", *METRICS])


def _prior(hosts: DataFrame) -> tuple[float, float]:
    """Mean and strength (a + b) of the beta prior: one row of moments over hosts, each weighted by its documents."""
    rate = F.col("failed") / F.col("n")
    x = hosts.agg(F.sum("n").alias("docs"), F.sum("failed").alias("failed"), F.sum(F.col("n") * rate * rate).alias("square"), F.count("*").alias("k")).first()
    if not x["docs"]:
        return 0.0, 1.0
    m = x["failed"] / x["docs"]
    base = m * (1 - m)
    spread = x["square"] / x["docs"] - m * m - x["k"] / x["docs"] * base  # what chance alone gives is taken off
    return m, float(x["docs"]) if spread <= 0 or base <= 0 else min(max(base / spread - 1, 1.0), float(x["docs"]))


def host_of(source: Column) -> Column:
    """The host of a URL, else the text itself; lower-cased."""
    text = source.cast("string")
    host = F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.lower(F.when(host != "", host).otherwise(text))


def _judged(rows: DataFrame, margin: float) -> DataFrame:
    """host, host_rate (shrunk) and whether it is rejected, a row a host."""
    hosts = rows.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    m, strength = _prior(hosts)
    rate = (F.col("failed") + m * strength) / (F.col("n") + strength)
    spread = F.sqrt(rate * (1 - rate) / (F.col("n") + strength + 1))
    return hosts.select("host", rate.alias("host_rate"), (rate - Z * spread > m + margin).alias("rejected"))


def host_rules(docs: DataFrame, margin: float = MARGIN) -> DataFrame:
    """doc_id, host, the five counts, base_failed, host_rate (shrunk) and kept of every document."""
    rows = _rows(docs)
    judged = _judged(rows, margin).withColumnRenamed("host", "judged_host")
    # a plain join: small host tables are broadcast by size, large ones are shuffled and split where skewed
    out = rows.join(judged, F.col("host").eqNullSafe(F.col("judged_host")), "left")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("rejected")).drop("judged_host", "rejected")


def _rows(docs: DataFrame) -> DataFrame:
    raw = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), host_of(F.col("source")).alias("host"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("raw"))
    rows = raw.mapInArrow(_measured, "doc_id long, host string, " + ", ".join(f"{k} long" for k in METRICS))
    return materialize(rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))), "measured")


def _passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("text")
        values, offsets = B.bytes_of(text.fill_null("") if text.null_count else text)
        parts = [measure(values[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in B.blocks(offsets)]
        words, again = (np.concatenate([p[k] for p in parts] or [np.zeros(0, np.int64)]) for k in ("n_words", "n_repeat_words"))
        yield batch.filter(pa.array((words >= MIN_WORDS) & (100 * again <= MAX_REPEATED * words)))


def keep_documents(docs: DataFrame, margin: float = MARGIN) -> DataFrame:
    """The rows of ``docs`` that pass with their hosts, all columns as they were. Texts are not shuffled: rows are
    measured where they are read, and only the rejected hosts are joined to them."""
    bad = materialize(_judged(_rows(docs), margin).where("rejected").select("host"), "bad_hosts")
    passing = small_batches(docs).mapInArrow(_passing, docs.schema)
    few = bad.count() <= BROADCAST_HOSTS  # a checked size; beyond it the join shuffles
    return passing.join(F.broadcast(bad) if few else bad, host_of(passing["source"]).eqNullSafe(bad["host"]), "left_anti")


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the query op9_host_rules."""
    return host_rules(docs).select("doc_id", *METRICS, "base_failed", "kept", "host_rate")
