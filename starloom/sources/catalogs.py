"""Star catalogs and plate solutions: chunked tables, tab-separated exports, keyword cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CARDS = ("CRVAL1", "CRVAL2", "CRPIX1", "CRPIX2", "NAXIS1", "NAXIS2", "CDELT1", "CDELT2", "CROTA1", "CROTA2", "CD1_1", "CD1_2", "CD2_1", "CD2_2")  # the keywords of a plate solution


def chunk_of(ra: Column, dec: Column, size: float) -> Column:
    """Cells of the sky, ``size`` degrees on each axis."""
    return (F.floor((dec + 90) / size) * int(360 / size + 1) + F.floor(F.pmod(ra, F.lit(360.0)) / size)).cast("int")


def write_catalog(stars: DataFrame, path: str, size: float = 5.0) -> None:
    """stars(ra, dec, ...) in a folder for each chunk: a search of some chunks reads only their files."""
    stars.withColumn("chunk", chunk_of(F.col("ra"), F.col("dec"), size)).repartition("chunk").write.partitionBy("chunk").parquet(path)


def read_box(spark: SparkSession, path: str, ra: tuple[float, float], dec: tuple[float, float], size: float = 5.0) -> DataFrame:
    """Stars in a box of the sky; the chunks that it touches are known beforehand, all others are pruned.
    Where ``ra`` runs over 360 degrees, the first bound is the larger."""
    parts = [ra] if ra[0] <= ra[1] else [(ra[0], 360.0), (0.0, ra[1])]
    across = int(360 / size + 1)
    rows = range(int((dec[0] + 90) // size), int((dec[1] + 90) // size) + 1)
    chunks = {j * across + i for j in rows for a, b in parts for i in range(int(a // size), int(b // size) + 1)}
    inside = F.lit(False)
    for a, b in parts:
        inside = inside | F.col("ra").between(a, b)
    return spark.read.parquet(path).where(F.col("chunk").isin(sorted(chunks))).where(inside & F.col("dec").between(*dec)).drop("chunk")


def tab_rows(lines: DataFrame, names: list[str], by: str = "line_no") -> DataFrame:
    """Rows of exports given as (source, line_no, line): comments and blanks go, then each source's first three lines
    (names, units, rule) and lines with too few fields. One window over what is left of a source finds these three."""
    from pyspark.sql import Window

    kept = lines.where("line <> '' and not startswith(line, '#')")
    nth = F.row_number().over(Window.partitionBy("source").orderBy(by))
    fields = kept.withColumn("nth", nth).withColumn("f", F.split("line", "\t")).where((F.col("nth") > 3) & (F.size("f") >= len(names)))
    return fields.select("source", by, *(F.col("f")[i].alias(n) for i, n in enumerate(names)))


def plate_solution(lines: DataFrame) -> DataFrame:
    """One row for each source of (source, line) cards ``KEY = value / comment``: centre, size and CD matrix.

    Missing sizes are twice the centre pixel; a missing matrix comes from steps and rotation (the second one first).
    """
    key, value = F.trim(F.regexp_extract("line", r"^([^=]*)=", 1)), F.regexp_extract("line", r"=\s*'?\s*([-+]?[0-9.]+(?:[EeDd][-+]?[0-9]+)?)", 1)
    cards = lines.select("source", key.alias("k"), F.regexp_replace(value, "[Dd]", "E").try_cast("double").alias("v"))
    g = cards.where(F.col("k").isin(*CARDS)).groupBy("source").agg(*(F.max(F.when(F.col("k") == c, F.col("v"))).alias(c) for c in CARDS))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    turn = F.radians(F.when(zero("CROTA2") != 0, F.col("CROTA2")).otherwise(zero("CROTA1")))
    has = F.coalesce("CD1_1", "CD1_2", "CD2_1", "CD2_2").isNotNull()
    steps = {"CD1_1": zero("CDELT1") * F.cos(turn), "CD1_2": -zero("CDELT2") * F.sin(turn), "CD2_1": zero("CDELT1") * F.sin(turn), "CD2_2": zero("CDELT2") * F.cos(turn)}
    size = lambda i: F.when(zero(f"NAXIS{i}") != 0, F.col(f"NAXIS{i}")).otherwise(F.round(2 * F.greatest(zero(f"CRPIX{i}"), F.lit(0.0)))).cast("long").alias(f"naxis{i}")
    return g.select("source", *(zero(c).alias(c.lower()) for c in CARDS[:4]), size(1), size(2), *(F.when(has, zero(c)).otherwise(e).alias(c.lower()) for c, e in steps.items()))
