import random
import zlib

import numpy as np

from starloom.llm import lm_scoring, quality_classifier, topk

SF = "/root/testdata/sf0.01"


def test_classifier_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality_classifier.digest(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for d, r in got.items())
    test = [(got[r.doc_id], r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([x.predicted == y for x, y in test]) > 0.9
    kept = quality_classifier.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got.values())


def test_classifier_odd_rows(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 1), (2, None), (None, 1), (99999, 0)], "doc_id long, quality int")
    out = quality_classifier.digest(docs, labels).collect()
    assert len(out) == docs.count() and len({r.score for r in out if r.doc_id == 3}) == 1
    assert quality_classifier.digest(empty, labels).collect() == []
    assert {r.score for r in quality_classifier.digest(docs, labels.limit(0)).collect()} == {0.5}


def test_lm_prefers_text_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = lm_scoring.train(docs)
    rows = [(r.doc_id, r.text) for r in docs.where("lang = 'en' and n_chars > 1500").limit(60).collect()]
    rng = random.Random(2)

    def shuffled(t):
        w = t.split()
        rng.shuffle(w)
        return " ".join(w)

    mean = lambda x: np.mean([r.mean_logp for r in lm_scoring.score(spark.createDataFrame(x, "doc_id long, text string"), model).collect()])
    plain = mean(rows)
    assert plain > mean([(d, shuffled(t)) for d, t in rows]) and plain > -18 * np.log(2)


def test_lm_score_is_the_sum(spark, docs, empty):
    model = lm_scoring.train(docs)
    cls, inside, weights = model
    w = lm_scoring.unflat(weights)
    for r, t in zip(lm_scoring.score(docs, model).orderBy("doc_id", "n_tokens").collect(), docs.orderBy("doc_id").collect(), strict=True):
        raw = np.frombuffer((t.text or "").encode(), np.uint8)
        found, _ = lm_scoring.bins(raw, np.array([0, len(raw)]))
        assert r.n_tokens == len((t.text or "").encode().split()) == len(found)
        total = 0.0
        for i in range(len(found)):
            h = w["b"].copy()
            for k, j in enumerate((i - 2, i - 1, i + 1, i + 2)):
                h += w["t"][k][cls[found[j]] if 0 <= j < len(found) else 0]
            z = np.maximum(h, 0) @ w["u"]
            total += z[cls[found[i]]] - np.log(np.exp(z).sum()) + inside[found[i]]
        assert abs(total - r.sum_logp) < 1e-2 + 1e-4 * abs(total)
        assert (r.mean_logp is None) == (r.n_tokens == 0)
    assert lm_scoring.digest(empty).collect() == []


def brute_top(rows, k=5):
    out = []
    x = [(i, v, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    for a, (i, _, u) in enumerate(x):
        if i % 50 == 0:
            score = lambda v: int(sum(int(p) * int(q) for p, q in zip(u, v, strict=False)))
            best = sorted(((-score(v), j) for b, (j, _, v) in enumerate(x) if b != a))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.1 + i % 7, 20).tolist()) for i in range(401)]
    rows += [(450, None), (500, [1.0, None]), (550, [float("nan")] * 20), (600, [float("inf")] * 20), (None, [1.0] * 20), (650, []), (700, [0.5, -0.5]), (50, rows[50][1]), (351, rows[350][1]), (352, rows[350][1]), (353, [0.0] * 20), (750, [0.0] * 20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    rows = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    for block, queries, numbers in ((1024, 16384, 1 << 22), (32, 5, 60)):
        monkeypatch.setattr(topk, "BLOCK", block)
        monkeypatch.setattr(topk, "QUERIES", queries)
        monkeypatch.setattr(topk, "PASS", numbers)
        assert sorted(map(tuple, topk.digest(df).collect())) == brute_top(rows)
    assert topk.digest(df.limit(0)).collect() == []


def test_top_k_large_numbers(spark):
    """Products beyond 2**53 are summed as whole numbers."""
    rows = [(i, [float(2**17 + i), 3.0 + i, -(2.0**17)]) for i in range(0, 120, 10)]
    got = sorted(map(tuple, topk.digest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    assert got == brute_top(rows)


def test_classifier_equals_plain_loops():
    """FTRL and the dot product against loops over dictionaries."""
    from math import exp, sqrt

    rng = np.random.default_rng(3)
    rows = [(d, float(d % 3 == 0), np.unique(rng.integers(0, 50, 12)).astype(np.uint32)) for d in range(40)]
    rows = [(d, y, p, rng.integers(1, 4, len(p)).astype(np.uint32)) for d, y, p in rows]
    z, n = {}, {}
    q = quality_classifier
    weight = lambda i: 0.0 if abs(z.get(i, 0.0)) <= q.L1 else (np.sign(z[i]) * q.L1 - z[i]) / ((q.BETA + sqrt(n[i])) / q.ALPHA + q.L2)
    order, deal = sorted(range(len(rows)), key=lambda i: rows[i][0]), np.random.default_rng(5)
    for _ in range(q.EPOCHS):
        for r in deal.permutation(order):
            _, y, place, count = rows[r]
            x = {int(i): c * q.SCALE / count.sum() for i, c in zip(place, count, strict=True)} | {1 << q.BITS: 1.0}
            w = {i: weight(i) for i in x}
            error = 1 / (1 + exp(-sum(w[i] * x[i] for i in x))) - y
            for i, v in x.items():
                g, old = error * v, n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (sqrt(old + g * g) - sqrt(old)) / q.ALPHA * w[i]
                n[i] = old + g * g
    got = q.fit(rows[::-1])
    assert all(abs(got[i] - weight(i)) < 1e-5 for i in z) and np.count_nonzero(got) <= len(z)
    text = b"one two two, three"
    values = np.frombuffer(text, np.uint8)
    place, _ = q.features(values, np.array([0, len(text)]))
    dense = rng.normal(0, 1, (1 << q.BITS) + 1).astype(np.float32)
    want = 1 / (1 + exp(-(sum(float(dense[i]) for i in place) * q.SCALE / len(place) + float(dense[-1]))))
    assert len(place) == 5 + 4 and abs(q.score_block(values, np.array([0, len(text)]), dense)[0] - want) < 1e-6


def test_classifier_bound_holds_after_the_join(spark):
    """Repeated doc_ids do not multiply what one task gets; with more labels than the bound some are learnt from."""
    docs = spark.createDataFrame([(i % 50, f"{'good' if i % 50 % 2 else 'bad'} words here {i}") for i in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    a, b = (quality_classifier.train(docs.repartition(n), labels, 20) for n in (2, 7))
    assert (a == b).all() and np.count_nonzero(a)
