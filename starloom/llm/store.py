"""Where intermediate tables live, and how work is dealt evenly over partitions."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one in local mode where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="starloom-"))
        atexit.register(shutil.rmtree, _local[0], True)
    return _local[0]


_scopes: list[list[str]] = []


@contextlib.contextmanager
def temporary(spark: SparkSession):
    """Tables that :func:`materialize` writes inside go at its end, but for those asked to stay: they belong to the
    scope around it, if there is one."""
    _scopes.append([])
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _scopes.pop():
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def new_path(spark: SparkSession, name: str, stay: bool = False) -> str:
    """A folder of its own in the shared one."""
    folder = f"{shared_dir(spark)}/starloom-{uuid.uuid4().hex}"
    scopes = _scopes[:-1] if stay else _scopes
    if scopes:
        scopes[-1].append(folder)
    return f"{folder}/{name}"


def materialize(df: DataFrame, name: str, stay: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, name, stay)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_by_key(df: DataFrame, key: str, name: str, n: int) -> DataFrame:
    """As :func:`materialize`, bucketed by ``key``: later groupings on it read the table without another shuffle."""
    spark, table = df.sparkSession, f"starloom_{name}_{uuid.uuid4().hex}"
    writer = df.repartition(n, key).write.option("compression", "zstd").option("path", new_path(spark, name))
    writer.bucketBy(n, key).sortBy(key).format("parquet").saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the name only: its files and what was read of their buckets stay
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _murmur3_int(value: int, seed: int = 42) -> int:
    """Spark's hash of an INT, by which hash partitioning deals rows."""
    m = 0xFFFFFFFF
    k = value * 0xCC9E2D51 & m
    k = (k << 15 | k >> 17) & m
    h = seed ^ k * 0x1B873593 & m
    h = (h << 13 | h >> 19) & m
    h = h * 5 + 0xE6546B64 & m
    h ^= 4
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    return h ^ h >> 16


def even_keys(n: int, per: int) -> list[int]:
    """``n * per`` INT keys of which hash partitioning into ``n`` sends ``per`` to every partition."""
    left, keys, k = [per] * n, [], 0
    while len(keys) < n * per:
        h = _murmur3_int(k)
        p = (h - (1 << 32) if h >> 31 else h) % n
        if left[p]:
            left[p] -= 1
            keys.append(k)
        k += 1
    return keys


def chunk_keys(n: int) -> list[int]:
    """Keys of chunks and buckets for ``n`` partitions: two for each, evenly dealt while they fit into an expression."""
    return even_keys(n, 2) if n <= 2048 else list(range(2 * n))


def chunk_of(keys: list[int], *cols: str) -> Column:
    """One of ``keys`` for each row, by a hash of ``cols``."""
    if keys[-1] == len(keys) - 1:
        return F.pmod(F.xxhash64(*cols), F.lit(len(keys))).cast("int")
    at = F.pmod(F.xxhash64(*cols), F.lit(len(keys))).cast("int")
    return F.element_at(F.array(*map(F.lit, keys)), at + 1)


ROWS = 1000  # rows of text that go to Python at once


def small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, with the session's batches to Python cut to ``ROWS``: texts are long, and executors hold several."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= ROWS:
        conf.set(name, str(ROWS))
    return docs


def raw_documents(docs: DataFrame) -> DataFrame:
    """doc_id and the UTF-8 bytes of text (null: empty); all other columns are left out."""
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("raw"))


def sum_blobs(df: DataFrame, dtype: str, lanes: int = 8):
    """Element-wise sum of the array that each row's only column holds, or None. Rows are added up as they stream, first
    in as many lanes as there are shuffle partitions, then in a few; one array of each of these comes to the driver."""
    import numpy as np
    import pyarrow as pa

    name = df.columns[0]

    def add(batches):
        total = None
        for batch in batches:
            for x in batch.column(0):
                a = np.frombuffer(x.as_py(), dtype)
                total = a.copy() if total is None else total + a
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], [name])

    wide = shuffle_partitions(df.sparkSession)
    if wide > 8 * lanes:
        df = df.repartition(wide).mapInArrow(add, f"{name} binary")
    found = [np.frombuffer(r[0], dtype) for r in df.repartition(lanes).mapInArrow(add, f"{name} binary").collect()]
    return sum(found[1:], found[0]) if found else None
