"""The queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from starloom.llm import host_rules, license_scan, lm_scoring, near_dedup, packing, quality_classifier, sharding, sp_codec, suffix_dedup, topk


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pack_documents(docs: DataFrame, with_ids: bool) -> DataFrame:
    path = public_tokenizers.path
    return packing.pack(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 2048, with_ids)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    docs = lambda s, d: table(s, d, "documents")
    return {
        "op1_suffix_dedup": lambda s, d: suffix_dedup.digest(docs(s, d)),
        "op2_license_scan": lambda s, d: license_scan.digest(docs(s, d)),
        "op3_top_k": lambda s, d: topk.digest(table(s, d, "embeddings")),
        "op4_packing": lambda s, d: pack_documents(docs(s, d), False),
        "op5_quality_classifier": lambda s, d: quality_classifier.digest(docs(s, d), table(s, d, "labels")),
        "op6_sp_codec": lambda s, d: sp_codec.digest(docs(s, d), public_tokenizers.path("piece_bpe_32k.model")),
        "op7_near_dedup": lambda s, d: near_dedup.digest(docs(s, d)),
        "op8_sharding": lambda s, d: sharding.digest(docs(s, d)),
        "op9_host_rules": lambda s, d: host_rules.digest(docs(s, d)),
        "op10_lm_scoring": lambda s, d: lm_scoring.digest(docs(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    """Where SQL can express a query over whole tables."""
    return {
        "op3_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
""",
    }
