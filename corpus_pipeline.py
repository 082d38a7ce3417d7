"""From raw documents to packed training sequences, in five stages.

Each stage works on all that its predecessor kept; between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from starloom.llm import host_rules, near_dedup, quality_classifier, suffix_dedup
from starloom.llm.queries import pack_documents, table
from starloom.llm.store import materialize, temporary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return host_rules.keep_documents(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_texts(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, with_ids=False)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", classifier),
    ("near duplicates", near_duplicates),
    ("repeated strings", repeated_strings),
    ("packing", packing),
]

ORACLE_SQL = None  # trained scores, signatures and tokenizers are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        if i + 1 < len(STAGES):
            with temporary(spark):  # what a stage wrote for itself goes with it
                out = materialize(stage(spark, out, sf_dir), f"stage{i + 1}", stay=True)
        else:
            out = stage(spark, out, sf_dir)
    return out
