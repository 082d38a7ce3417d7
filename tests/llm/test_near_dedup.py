import random
from collections import Counter

import numpy as np
import pytest

from starloom.llm import near_dedup


def shingle_sets(text):
    """Weighted: a shingle counts as often as it occurs."""
    w = (text or "").encode().split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def classes(rows, similarity):
    sets = [shingle_sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            same = (rows[i][1] or "") == (rows[j][1] or "")
            if same or (a and b and jaccard(a, b) >= similarity - 1e-9):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        known = [x for x in groups[find(i)] if x is not None]
        out.append((d, min(known, default=None)))
    return out


def test_equals_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [(r.doc_id, r.class_id) for r in near_dedup.digest(docs).collect()]
    assert sorted(got, key=str) == sorted(classes(rows, 0.8), key=str)


def test_star_centre_unlike_its_members(spark):
    """A chain: each text is like its neighbours only, so stars alone would lose links."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[7 * i : 7 * i + 160])) for i in range(24)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.class_id) for r in near_dedup.digest(df).collect()]
    assert sorted(got) == sorted(classes(rows, 0.8)) and len({c for _, c in got}) == 1


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    h = rng.integers(1, 2**63, 3000).astype(np.uint64)
    a, b = h[:900], np.concatenate([h[:700], h[2000:2100]])
    got = []
    for salt in range(12):
        s = near_dedup.signatures(np.concatenate([a, b]) + np.uint64(salt * 977), np.repeat([0, 1], [len(a), len(b)]), 2)
        got.append((s[0] == s[1]).mean())
    assert abs(np.mean(got) - 700 / 1000) < 0.05
    for n in (1, 3, 20_000):
        x = rng.integers(1, 2**63, n).astype(np.uint64)
        s = near_dedup.signatures(np.concatenate([x, x]), np.repeat([0, 1], n), 2)
        assert (s[0] == s[1]).all()


def test_keep_one_and_empty(spark, docs, empty):
    assert near_dedup.digest(empty).collect() == []
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted({(c, i) for i, (_, c) in enumerate(classes(rows, 0.8))} and {str(c) for _, c in classes(rows, 0.8)})
    assert sorted({str(r.doc_id) for r in kept.collect()}) == want and kept.count() == len(want)


def test_signatures_of_weights():
    """Coordinates agree as often as the weighted similarity says, also for weights below 1 and far above it."""
    rng = np.random.default_rng(2)
    h = rng.integers(1, 2**63, 60).astype(np.uint64)
    for scale in (1, 100, 0.01):
        v, w = rng.integers(1, 60, 60) * scale, rng.integers(1, 60, 60) * scale
        want = np.minimum(v, w).sum() / np.maximum(v, w).sum()
        got = [(lambda s: (s[0] == s[1]).mean())(near_dedup.signatures(np.concatenate([h, h]) + np.uint64(salt * 977), np.repeat([0, 1], 60), 2, np.concatenate([v, w]))) for salt in range(40)]
        assert abs(np.mean(got) - want) < 0.04, scale


def test_weights_tell_texts_apart(spark):
    """Texts of the same shingles in other numbers."""
    line = " ".join(f"a{i}" for i in range(20))
    rest = " ".join(f"b{i}" for i in range(40))
    rows = [(k, " ".join([line] * n + [rest])) for k, n in enumerate((1, 2, 10, 11, 30))]
    got = {r.doc_id: r.class_id for r in near_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sorted(got.items()) == sorted(classes(rows, 0.8)) and len(set(got.values())) == 4


@pytest.mark.parametrize("size", [80, 400])
def test_recall_near_the_threshold(spark, size, capsys):
    """Of the pairs at 0.8 to 0.9 that brute force finds nearly all fall into one class."""
    rng = random.Random(size)
    rows = []
    for g in range(60):
        base = [f"g{g}w{rng.randrange(10**6)}" for _ in range(size)]
        copy, changed = list(base), rng.randint(1, max(1, size // 50))
        for i in rng.sample(range(size), changed):
            copy[i] = "changed"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(copy))]
    got = {r.doc_id: r.class_id for r in near_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pairs = [g for g in range(60) if 0.8 <= jaccard(shingle_sets(rows[2 * g][1]), shingle_sets(rows[2 * g + 1][1]))]
    found = sum(got[2 * g] == got[2 * g + 1] for g in pairs)
    assert len(pairs) > 10 and found / len(pairs) >= 0.97
    assert all(got[2 * g] != got[2 * g + 1] for g in range(60) if g not in pairs)


def test_large_bands_are_split(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 0)  # and no broadcasts
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(words[: 150 + i % 7])) for i in range(30)] + [(100 + i, " ".join(words[5 * i : 5 * i + 120])) for i in range(20)]
    got = [(r.doc_id, r.class_id) for r in near_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(classes(rows, 0.8))
