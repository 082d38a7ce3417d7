"""Robust statistics as column expressions; all skip nulls."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

MAD_TO_SIGMA = 1.4826  # fixed value: MAD of a normal distribution


def round6(c: Column) -> Column:
    return F.round(c, 6)


def median_or_zero(c: Column) -> Column:
    """Mean of the two middle values for even counts, 0 for none."""
    return F.coalesce(F.median(c), F.lit(0.0))


def sorted_at(c: Column, index: Column) -> Column:
    """The value at a 0-based index of the sorted group."""
    return F.element_at(F.array_sort(F.collect_list(c)), index.cast("int") + 1)


def upper_median(c: Column) -> Column:
    return sorted_at(c, F.floor(F.count(c) / 2))


def nearest_rank(c: Column, p: float) -> Column:
    return sorted_at(c, F.floor(F.lit(p) * (F.count(c) - 1) + 0.5))


def floor_rank(c: Column, p: float) -> Column:
    return sorted_at(c, F.floor(F.lit(p) * (F.count(c) - 1)))


def robust_z(df, value: str, window: WindowSpec, out: str):
    """(value - median) / (1.4826 * MAD) over ``window``; 0 where the spread is 0."""
    med = df.withColumn("__med", F.median(value).over(window))
    mad = med.withColumn("__sigma", F.median(F.abs(F.col(value) - F.col("__med"))).over(window) * MAD_TO_SIGMA)
    z = F.when(F.col("__sigma") > 0, (F.col(value) - F.col("__med")) / F.col("__sigma")).otherwise(F.lit(0.0))
    return mad.withColumn(out, z).drop("__med", "__sigma")


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def hann(i: Column, n: int) -> Column:
    """Symmetric Hann window with zero ends."""
    return F.lit(1.0) if n == 1 else 0.5 * (1 - F.cos(2 * 3.141592653589793 * i / (n - 1)))


def haversine_squared(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    a, b = F.radians(dec2 - dec1) / 2, F.radians(ra2 - ra1) / 2
    return F.sin(a) * F.sin(a) + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * F.sin(b) * F.sin(b)


def teff_from_bv(bv: Column) -> Column:
    """Effective temperature from B-V (Ballesteros 2012), B-V held to [-0.4, 2]."""
    x = 0.92 * clip(bv, -0.4, 2.0)
    return 4600 * (1 / (x + 1.7) + 1 / (x + 0.62))


def huber_weight(z: Column, k: float = 1.345) -> Column:
    return F.when(F.abs(z) <= k, 1.0).otherwise(k / F.abs(z))


def tukey_weight(z: Column, k: float = 4.685) -> Column:
    return F.when(F.abs(z) < k, F.pow(1 - F.pow(z / k, F.lit(2.0)), F.lit(2.0))).otherwise(0.0)


def smoothstep(c: Column, low: float, high: float) -> Column:
    t = clip((c - low) / (high - low), 0.0, 1.0)
    return t * t * (3 - 2 * t)
