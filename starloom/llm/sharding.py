"""Contiguous shards of near equal bytes, from global prefix sums.

DataFrame functions only. Rows are put in the order of (doc_id, size, text_crc32), nulls first. The rows' sizes are
written once, range-partitioned by that order; every partition's total is one row, and a running sum over those few
rows gives where each partition starts, in bytes and in rows. A row's shard is where the middle of its bytes falls
among equal targets, so the shards are contiguous in that order and differ by at most about one row's size. The placed
rows are written too: a shard's first row is one of as many rows as there are shards, and a slot counts from there.

Nulls: a null text has size 1 and checksum 0; null doc_ids come first. Empty and very long texts need no special case.
Repeated rows each get a slot of their own; which of several equal rows gets which slot is not told apart. An empty
table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm.store import materialize, shuffle_partitions

ORDER = ("doc_id", "size", "text_crc32")


def shard_by_bytes(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    # the order of the rows is fixed by the written table: what follows reads the same parts whoever is lost
    parts = materialize(sized.repartitionByRange(shuffle_partitions(docs.sparkSession), *ORDER).withColumn("part", F.spark_partition_id()), "sizes")
    totals = parts.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition, not for each document
    sum_of = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    starts = totals.select("part", sum_of("bytes").alias("start"), sum_of("rows").alias("first"), F.sum("bytes").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("part").orderBy(*ORDER)
    sums = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    # sum and number in one pass: rows that tie must not change places between them
    placed = parts.select("*", F.coalesce(sums, F.lit(0)).alias("before"), (F.row_number().over(inside) - 1).alias("nth")).join(starts, "part")
    middle = 2 * (F.col("start") + F.col("before")) + F.col("size")  # twice the middle byte
    # exact: decimals, as shards * total may pass 2**63
    cut = F.floor(middle.cast("decimal(24,0)") * F.lit(shards) / (2 * F.col("total").cast("decimal(24,0)"))).cast("int")
    placed = placed.select(*ORDER, F.least(cut, F.lit(shards - 1)).alias("shard"), (F.col("first") + F.col("nth")).alias("row"))
    placed = materialize(placed, "placed")
    heads = placed.groupBy("shard").agg(F.min("row").alias("head"))  # a row for each shard
    return placed.join(F.broadcast(heads), "shard").select(*ORDER, "shard", (F.col("row") - F.col("head")).alias("slot"))


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the query op8_sharding."""
    out = shard_by_bytes(docs, 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
