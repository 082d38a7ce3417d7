"""Whether a frame still is linear: the share of slow waves and the steepness of its edges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# largest |skewness|, |kurtosis|, variation, least share of slow waves, largest steepness: fixed values
LIMITS = {"strict": (1.2, 1.2, 0.5, 0.95, 0.5), "moderate": (1.2, 1.2, 0.7, 0.9, 0.7), "permissive": (1.5, 1.5, 1.0, 0.8, 1.0)}


def slow_share(image: np.ndarray) -> float:
    """The part of the spectrum's energy in the lowest eighth of frequencies on each axis, both signs; 0 below 8 pixels."""
    if min(image.shape) < 8:
        return 0.0
    energy = np.abs(np.fft.fft2(image)) ** 2
    r = max(1, min(image.shape) // 8)
    edge = [np.minimum(np.arange(n), n - 1 - np.arange(n)) < r for n in image.shape]
    return float(energy[np.ix_(*edge)].sum() / energy.sum()) if energy.sum() > 0 else 0.0


def steepness(image: np.ndarray) -> float:
    """Twice the mean Sobel gradient by the mean value."""
    p = np.pad(image, 1, "reflect" if min(image.shape) > 1 else "edge")
    smooth_y, smooth_x = p[:-2] + 2 * p[1:-1] + p[2:], p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    return float(2 * np.hypot(smooth_y[:, 2:] - smooth_y[:, :-2], smooth_x[2:] - smooth_x[:-2]).mean() / (abs(image.mean()) + 1e-12))


def linearity(px: DataFrame, strictness: str = "strict", edge: int = 256) -> DataFrame:
    """frame_id, the five measures, the three verdicts, score (their mean) and is_linear; frames are brought down to at
    most ``edge`` pixels a side before a task holds one."""
    skew, kurt, cv, share, steep = LIMITS[strictness]
    size = px.groupBy("frame_id").agg(F.greatest(F.lit(1), F.ceil((F.greatest(F.max("y"), F.max("x")) + 1) / edge)).alias("f"))
    small = px.join(size, "frame_id").groupBy("frame_id", F.floor(F.col("y") / F.col("f")).alias("y"), F.floor(F.col("x") / F.col("f")).alias("x")).agg(F.avg("v").alias("v"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        image = np.full((int(rows["y"].max()) + 1, int(rows["x"].max()) + 1), np.nan)
        image[rows["y"], rows["x"]] = rows["v"]
        v = np.sort(image[np.isfinite(image)])
        if not len(v):
            return pd.DataFrame([(key[0], *[None] * 5)], columns=["frame_id", "skewness", "kurtosis", "variation", "slow", "steep"])
        p1, p5, p50, p95, p99 = (v[int(p * (len(v) - 1) + 0.5)] for p in (0.01, 0.05, 0.5, 0.95, 0.99))
        full = np.where(np.isfinite(image), image, p50)
        spread = v.std(ddof=1) if len(v) > 1 else 0.0
        return pd.DataFrame([(key[0], (p99 - p50) / (p50 - p1 + 1e-12), (p95 - p50) / (p50 - p5 + 1e-12), spread / (abs(v.mean()) + 1e-12), slow_share(full), steepness(full))], columns=["frame_id", "skewness", "kurtosis", "variation", "slow", "steep"])

    m = small.groupBy("frame_id").applyInPandas(run, "frame_id long, skewness double, kurtosis double, variation double, slow double, steep double")
    yes = lambda c: F.coalesce(c, F.lit(False))
    m = m.withColumns({"moments_ok": yes((F.abs("skewness") < skew) & (F.abs("kurtosis") < kurt) & (F.col("variation") < cv)), "waves_ok": yes(F.col("slow") >= share), "edges_ok": yes(F.col("steep") < steep)})
    passed = sum((F.col(c).cast("int") for c in ("moments_ok", "waves_ok", "edges_ok")), F.lit(0))
    return m.withColumn("score", passed / 3).withColumn("is_linear", passed == 3)
