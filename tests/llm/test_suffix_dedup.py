import hashlib
from collections import defaultdict

import numpy as np
import pytest

from starloom.llm import bytesets, suffix_dedup

LAST = 2**63 - 1


def brute(rows, length):
    """rows of (doc_id, bytes): removed masks, straight from the definition."""
    first = {}
    for d, x in rows:
        d = LAST if d is None else d
        for i in range(len(x) - length + 1):
            w = x[i : i + length]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, x in rows:
        d = LAST if d is None else d
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - length + 1):
            if first[x[i : i + length]] < d:
                gone[i : i + length] = True
        out.append(gone)
    return out


def expected(rows, length):
    out = []
    for (d, x), gone in zip(rows, brute(rows, length), strict=True):
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        out.append((d, len(x), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [bytesets.BLOCK, 256])
def test_equals_brute_force(spark, docs, block, monkeypatch):
    monkeypatch.setattr(bytesets, "BLOCK", block)  # small blocks: texts are cut with overlap
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    got = [tuple(r) for r in suffix_dedup.digest(docs).collect()]
    assert sorted(got, key=str) == expected(rows, 50)
    assert sum(r[2] for r in got) > 1000


def test_small_blocks_in_one_process(texts):
    """Block borders inside texts give the same stretches' bytes."""
    x = b" ".join((t or "").encode() for t in texts) * 3
    values = np.frombuffer(x, np.uint8)
    seen = defaultdict(set)
    for size in (300, 1 << 20):
        bytesets_block, bytesets.BLOCK = bytesets.BLOCK, size
        try:
            for b in suffix_dedup._blocks(values, np.array([0, len(x)]), 50):
                start, h = b.windows(np.arange(len(b.lo)))
                seen[size] |= set(zip((start + b.base).tolist(), h.tolist(), strict=True))
        finally:
            bytesets.BLOCK = bytesets_block
    assert {p for p, _ in seen[300]} == set(range(len(x) - 49)) == {p for p, _ in seen[1 << 20]}
    assert seen[300] == seen[1 << 20]


def test_other_lengths(spark, docs):
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    for length in (9, 24):
        got = suffix_dedup.suffix_dedup(docs, length).select("doc_id", "n_removed").collect()
        assert sorted(map(tuple, got), key=str) == sorted([(d, int(g.sum())) for (d, _), g in zip(rows, brute(rows, length), strict=True)], key=str)


def test_texts_and_empty(spark, docs, empty):
    assert suffix_dedup.digest(empty).collect() == []
    out = suffix_dedup.dedup_texts(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert sorted(r.text is None for r in out.collect()) == sorted(r.text is None for r in docs.collect())
