"""Many small groups in one call of Python: rows dealt out and sorted by key, cut where the key changes.

A call for each group costs some milliseconds, whatever the group holds; here a call sees as many whole groups as fit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ROWS = 30_000  # rows that a call waits for; a group is never cut, so a larger one is held whole
WHOLE = {"int": pa.int32(), "long": pa.int64(), "bigint": pa.int64()}


def medians(v: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The median of each group's values without NaN; NaN for none."""
    n = len(starts) - 1
    order = np.lexsort((v, np.repeat(np.arange(n), np.diff(starts))))
    good = np.add.reduceat(~np.isnan(v), starts[:-1], dtype=np.int64) if n else np.zeros(0, int)
    at = v[order]
    low, high = starts[:-1] + np.maximum(good - 1, 0) // 2, starts[:-1] + good // 2
    high = np.minimum(high, starts[1:] - 1)
    return np.where(good > 0, (at[low] + at[high]) / 2, np.nan)


def _column(c: pa.ChunkedArray) -> np.ndarray:
    return c.to_numpy()


def in_groups(df: DataFrame, keys: list[str], run: Callable[[dict[str, np.ndarray], np.ndarray], dict[str, np.ndarray] | Iterator[dict[str, np.ndarray]]], out: str, sort: Iterable[str] = (), rows: int = ROWS) -> DataFrame:
    """``run(columns, starts)`` over whole groups of df: columns as arrays (null numbers as NaN), sorted by ``keys`` and
    then by ``sort``; starts[i] is where group i begins, the last one is the end. It returns
    columns by name (or several such, one after the other), which go out in the order of ``out`` (DDL)."""
    names, whole_numbers = [c.split()[0] for c in out.split(",")], {c.split()[0]: WHOLE[c.split()[1]] for c in out.split(",") if c.split()[1] in WHOLE}

    def whole(part: list[pa.RecordBatch], last: bool) -> tuple[pa.Table | None, list[pa.RecordBatch]]:
        t = pa.Table.from_batches(part).combine_chunks()
        new = np.zeros(len(t), bool)
        for k in keys:
            v = _column(t[k])
            new[1:] |= (v[1:] != v[:-1]) & ((v[1:] == v[1:]) | (v[:-1] == v[:-1]))  # null keys are one group
        at = np.flatnonzero(new)
        if last:
            return (t, np.concatenate([[0], at, [len(t)]])), []
        if not len(at):
            return None, t.to_batches()
        return (t[: at[-1]], np.concatenate([[0], at])), t[at[-1] :].to_batches()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        size, wait = 0, rows

        def give(found: tuple[pa.Table, np.ndarray]) -> Iterator[pa.RecordBatch]:
            t, starts = found
            got = run({c: _column(t[c]) for c in t.column_names}, starts)
            yield from map(batch, [got] if isinstance(got, dict) else got)

        def batch(got: dict[str, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([column(c, got[c]) for c in names], names)

        def column(c: str, v: np.ndarray) -> pa.Array:
            if v.dtype.kind != "f":
                return pa.array(v)
            found = pa.array(v, from_pandas=True)
            return found.cast(whole_numbers[c]) if c in whole_numbers else found  # a key with nulls came as floats

        for b in it:
            if not b.num_rows:
                continue
            kept.append(b)
            size += b.num_rows
            if size >= wait:
                found, kept = whole(kept, False)
                if found is not None:
                    yield from give(found)
                size = sum(b.num_rows for b in kept)
                wait = max(rows, 2 * size)  # a group beyond the limit is looked at again only when twice as much is there
        if kept:
            yield from give(whole(kept, True)[0])

    return df.repartition(*keys).sortWithinPartitions(*keys, *sort).mapInArrow(batches, out)
