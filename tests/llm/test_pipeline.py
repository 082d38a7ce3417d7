from collections import defaultdict

import numpy as np
import public_tokenizers
from test_near_dedup import classes
from test_suffix_dedup import brute
from test_text_ops import brute_rules
from tokenizers import Tokenizer

import corpus_pipeline
from starloom.llm import host_rules, near_dedup, quality_classifier, queries

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = queries.table(spark, SF, "documents")
    out, kept = docs, None
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = {r.doc_id for r in out.select("doc_id").collect()}
        out = corpus_pipeline.materialize(stage(spark, out, SF), f"test{i}")
        assert out.columns == docs.columns
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        assert kept <= before
    packed = corpus_pipeline.STAGES[-1][1](spark, out, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == kept
    assert kept < {r.doc_id for r in docs.select("doc_id").collect()}


def test_run_on_odd_rows(spark, docs, empty, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert near_dedup.keep_one(host_rules.keep_documents(empty)).collect() == []


def test_rows_equal_a_brute_force_chain(spark):
    """Every stage by plain Python over all documents; only the classifier's trained weights are taken over."""
    docs, labels = (queries.table(spark, SF, t) for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in docs.collect()}
    text = {d: r.text or "" for d, r in rows.items()}
    assert len(rows) == docs.count()

    # 1. rules of documents and hosts
    measured = {d: brute_rules(t) for d, t in text.items()}
    failed = {d: n < 10 or 100 * again > 20 * n for d, (n, _, _, _, again) in measured.items()}
    hosts = defaultdict(list)
    for d, r in rows.items():
        hosts[r.source if r.source is None else r.source.lower()].append(failed[d])
    n, m = len(rows), sum(failed.values()) / len(rows)
    spread = sum(len(h) * (sum(h) / len(h)) ** 2 for h in hosts.values()) / n - m * m - len(hosts) / n * m * (1 - m)
    a = n if spread <= 0 else min(max(m * (1 - m) / spread - 1, 1), n)
    rate = {h: (sum(x) + m * a) / (len(x) + a) for h, x in hosts.items()}
    bad = {h for h, x in hosts.items() if rate[h] - host_rules.Z * (rate[h] * (1 - rate[h]) / (len(x) + a + 1)) ** 0.5 > m + host_rules.MARGIN}
    kept = {d for d, r in rows.items() if not failed[d] and (r.source if r.source is None else r.source.lower()) not in bad}
    out = corpus_pipeline.materialize(corpus_pipeline.quality_rules(spark, docs, SF), "b1")
    assert {r.doc_id for r in out.collect()} == kept

    # 2. quality
    weights = quality_classifier.train(out, labels)

    def score(t):
        x = np.frombuffer(t.encode(), np.uint8)
        place, _ = quality_classifier.features(x, np.array([0, len(x)]))
        z = sum(float(weights[i]) for i in place) * quality_classifier.SCALE / max(1, len(place)) + float(weights[-1])
        return 1 / (1 + np.exp(-z))

    kept = {d for d in kept if score(text[d]) >= quality_classifier.THRESHOLD}
    out = corpus_pipeline.materialize(corpus_pipeline.classifier(spark, out, SF), "b2")
    assert {r.doc_id for r in out.collect()} == kept

    # 3. one document of each class, the one with the smallest doc_id
    pairs = sorted((d, text[d]) for d in kept)
    kept = {c for _, c in classes(pairs, 0.8)}
    out = corpus_pipeline.materialize(corpus_pipeline.near_duplicates(spark, out, SF), "b3")
    assert {r.doc_id for r in out.collect()} == kept

    # 4. repeated strings
    pairs = [(d, text[d].encode()) for d in sorted(kept)]
    want = {d: bytes(np.frombuffer(x, np.uint8)[~gone]).decode("utf-8", "ignore") for (d, x), gone in zip(pairs, brute(pairs, 50), strict=True)}
    out = corpus_pipeline.materialize(corpus_pipeline.repeated_strings(spark, out, SF), "b4")
    assert {r.doc_id: r.text or "" for r in out.collect()} == want
    assert all(r.n_chars == len(r.text or "") or r.n_chars == rows[r.doc_id].n_chars for r in out.collect())

    # 5. packing, of this chain and of the whole run
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {d: len(whole.encode(t, add_special_tokens=False).ids) + 1 for d, t in want.items()}
    for packed in (corpus_pipeline.packing(spark, out, SF), corpus_pipeline.run(spark, SF)):
        got = packed.collect()
        assert {d: sum(r.length for r in got if r.doc_id == d) for d in tokens} == tokens and sum(r.length for r in got) == sum(tokens.values())
        assert sorted(r.sequence_id * 2048 + r.offset for r in got)[0] == 0 and max(r.sequence_id * 2048 + r.offset + r.length for r in got) == sum(tokens.values())
