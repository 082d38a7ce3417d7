"""Corpus operators against brute force where part of the input was once left out."""

from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from starloom.llm import lm_scoring, near_dedup


def test_lm_words_keep_their_own_counts(spark, monkeypatch):
    """More words than the frequent ones at hand: each still has its own count, and classes add up."""
    monkeypatch.setattr(lm_scoring, "BITS", 7)
    rows = [(i, " ".join(f"w{k}" for k in range(300) if i % (k + 1) == 0 or k % 97 == i % 97)) for i in range(120)]
    docs = spark.createDataFrame(rows + [(None, None)], "doc_id long, text string").repartition(3)
    counts = Counter(w for _, t in rows for w in t.split())
    cls, inside, weights = model = lm_scoring.train(docs)
    assert len(counts) > len(cls.words) > 0
    words = sorted(counts)
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    found, _ = lm_scoring.bins(raw, np.array([0, len(raw)]))
    of = dict(zip(words, cls[found].tolist(), strict=True))
    total = Counter()
    for w, n in counts.items():
        total[of[w]] += n
    logp = {w: np.log(n / total[of[w]]) for w, n in counts.items()}
    for w, h in list(zip(words, found, strict=True))[::25]:
        assert abs(inside[h] - logp[w]) < 1e-9
    net = lm_scoring.unflat(weights)
    text = dict(rows)
    for r in lm_scoring.score(docs, model).collect():
        w = text.get(r.doc_id, "").split()
        c = np.array([of[x] for x in w], np.uint8)
        want = lm_scoring.class_logp(net, lm_scoring.contexts(c, np.array([0, len(w)])), c.astype(np.intp)).sum() + sum(logp[x] for x in w)
        assert r.n_tokens == len(w) and abs(r.sum_logp - want) < 1e-6 * max(1, abs(want))


def test_keep_one_of_each_class_not_of_each_name(spark):
    """Unlike texts stay, though their doc_ids are null or equal."""
    text = lambda k: " ".join(f"{k}x{i}" for i in range(60))
    near = text("c").replace("cx59", "other")
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (5, text("c")), (5, text("d")), (9, near), (5, near), (7, text("d")), (None, text("e")), (8, text("e"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.text) for r in near_dedup.keep_one(df).collect()]
    kind = lambda t: t.split("x")[0]
    assert sorted((str(d), kind(t)) for d, t in got) == [("5", "c"), ("5", "d"), ("8", "e"), ("None", "a"), ("None", "b")]
    assert set(got) <= set(rows)


def test_lm_every_token_is_a_target_once(monkeypatch):
    """The trainer sees each token of each text over the rounds, and groups do not mix."""
    texts = [bytes((i * k) % 23 + 1 for k in range(40 + i)) for i in range(30)] + [b"\x01"]
    groups = [i // 8 for i in range(len(texts))]
    batches = [pa.RecordBatch.from_arrays([pa.array(groups[i : i + 5]), pa.array(texts[i : i + 5], pa.binary())], ["group", "classes"]) for i in range(0, len(texts), 5)]
    monkeypatch.setattr(lm_scoring, "PART", 100)
    seen, learn = [], lm_scoring.Trainer.learn
    monkeypatch.setattr(lm_scoring.Trainer, "learn", lambda self, ctx, target: (seen.append(len(target)), learn(self, ctx, target)))
    for turn in range(lm_scoring.ROUNDS):
        assert len(list(lm_scoring._trained(SimpleNamespace(value=lm_scoring.flat(lm_scoring.fresh())), turn)(iter(batches)))) == 4
    assert sum(seen) == sum(map(len, texts))


def test_lm_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "GROUP", 4000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a, b = ({r.doc_id: r.mean_logp for r in lm_scoring.digest(docs.repartition(n)).collect()} for n in (2, 9))
    assert a.keys() == b.keys() and all(a[k] == b[k] or abs(a[k] - b[k]) < 1e-3 for k in a)


def test_lm_learns_as_plain_loops():
    """A few steps of training against one token at a time."""
    rng = np.random.default_rng(6)
    ctx, target = rng.integers(0, 9, (40, 4)), rng.integers(0, 9, 40)
    t = lm_scoring.Trainer(lm_scoring.fresh())
    t.learn(ctx, target)
    w = {k: v.astype(np.float64) for k, v in lm_scoring.fresh().items()}
    grad = {k: np.zeros_like(v) for k, v in w.items()}
    for row, y in zip(ctx, target, strict=True):
        h = np.maximum(w["b"] + sum(w["t"][k][c] for k, c in enumerate(row)), 0)
        z = h @ w["u"]
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        p[y] -= 1
        back = (w["u"] @ p) * (h > 0)
        back[-1] = 0
        grad["u"] += np.outer(h, p) / 40
        grad["b"] += back / 40
        for k, c in enumerate(row):
            grad["t"][k][c] += back / 40
    for k in w:
        assert np.allclose(t.w[k], w[k] - lm_scoring.RATE * grad[k] / np.sqrt(1e-3 + grad[k] ** 2), atol=1e-4)


def test_lm_gradient_adds_up_over_a_batch():
    rng = np.random.default_rng(5)
    ctx, target = rng.integers(0, 9, (64, 4)), rng.integers(0, 9, 64)
    a = lm_scoring.Trainer(lm_scoring.unflat(lm_scoring.flat(lm_scoring.fresh())))
    start = {k: v.astype(np.float64) for k, v in a.w.items()}
    h = np.maximum(sum(start["t"][k][ctx[:, k]] for k in range(4)) + start["b"], 0)
    p = np.exp(h @ start["u"])
    p /= p.sum(1, keepdims=True)
    p[np.arange(64), target] -= 1
    dh = (p / 64 @ start["u"].T) * (h > 0)
    dh[:, -1] = 0
    want = np.zeros_like(start["t"])
    for k in range(4):
        np.add.at(want[k], ctx[:, k], dh)
    a.step(ctx, target)
    assert np.allclose(a.w["t"], start["t"] - lm_scoring.RATE * want / np.sqrt(1e-3 + want * want), atol=1e-4)
