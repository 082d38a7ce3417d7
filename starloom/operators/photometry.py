"""Star fluxes in three channels with their guards, catalog sources by priority, and a colour run from both."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions.robust import clip
from starloom.operators.colour import gains
from starloom.operators.joins import around

CHANNELS = ("r", "g", "b")


def first_source(stars: DataFrame, order: list[str], key: str = "field") -> DataFrame:
    """stars(field, source, ...) of the first source in ``order`` that has any for the field; others are left out.

    The winner of a field is a small aggregate (one row a field) joined back, so a field's stars need no common task."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("source"))
    known = stars.where(rank > 0)
    best = known.groupBy(key).agg(F.min_by("source", rank).alias("source"))
    return known.join(best, [key, "source"])


def _offsets(inner: float, outer: float) -> int:
    n = math.ceil(outer)
    return sum(inner <= math.hypot(i, j) <= outer for i in range(-n, n + 1) for j in range(-n, n + 1))


def measure_stars(rgb: DataFrame, stars: DataFrame, sky: DataFrame | str, height: int, width: int, r: float = 1.5, inner: float = 2.0, outer: float = 3.0, min_stars: int = 3, aperture_share: float = 0.5, annulus_share: float = 0.3, least: int = 10, saturation: float = 0.995, top: float = 0.999) -> DataFrame:
    """frame_id, rank, flux_r, flux_g, flux_b, relaxed for stars(frame_id, rank, py, px_) on rgb(frame_id, y, x, r, g, b).

    Out go: stars within outer + 2 of an edge; those whose 3 x 3 peak reaches ``saturation`` of the frame's ``top``
    quantile in any channel; those with too few pixels in aperture or annulus; those whose annulus holds too small a
    share of sky(frame_id, y, x), or of the pixels where rgb's column of that name is true, which is 0.25 and half the frame's share of sky, at most 0.55. A frame left with fewer
    than ``min_stars`` valid stars by the last guard is measured without it (relaxed), if that gives more. A flux is the
    sum over the aperture less the annulus' median; all three must be above 0. A null value is no pixel.

    What holds for a frame is told to its pixels by windows, so rgb is made and dealt to frames once.
    """
    edge = outer + 2
    inside = stars.select("frame_id", "rank", "py", "px_").where(F.col("px_").between(edge, width - edge - 1e-9) & F.col("py").between(edge, height - edge - 1e-9))
    if isinstance(sky, str):
        seen = rgb.select("frame_id", "y", "x", *CHANNELS, F.when(F.col(sky), 1).alias("sky")).dropna(subset=CHANNELS)
    else:
        calm = sky.select("frame_id", "y", "x", F.lit(1).alias("sky"))
        seen = rgb.select("frame_id", "y", "x", *CHANNELS).dropna().join(calm, ["frame_id", "y", "x"], "left")
    of = Window.partitionBy("frame_id")
    frame = [f"top_{c}" for c in CHANNELS] + ["share"]
    seen = seen.withColumns({f"top_{c}": F.percentile(c, top).over(of) for c in CHANNELS} | {"share": F.count("sky").over(of) / F.count("*").over(of)})
    near = around(inside, seen, math.ceil(outer)).withColumn("d", F.sqrt((F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")).cast("double")))
    peak = (F.abs("dy") <= 1) & (F.abs("dx") <= 1)
    ring, disk = F.col("d").between(inner, outer), F.col("d") <= r
    found = near.groupBy("frame_id", "rank").agg(
        *(F.max(F.when(peak, F.col(c))).alias(f"peak_{c}") for c in CHANNELS), *(F.median(F.when(ring, F.col(c))).alias(f"sky_{c}") for c in CHANNELS),
        *(F.sum(F.when(disk, F.col(c))).alias(f"sum_{c}") for c in CHANNELS), F.count_if(disk).alias("k"), F.count_if(ring).alias("n"), F.count_if(ring & F.col("sky").isNotNull()).alias("safe"), *(F.first(c).alias(c) for c in frame))
    dark = F.lit(True)
    for c in CHANNELS:
        dark = dark & ~((F.col(f"top_{c}") > 0) & (F.col(f"peak_{c}") >= saturation * F.col(f"top_{c}")))
    found = found.where(dark & (F.col("k") >= aperture_share * _offsets(0, r)) & (F.col("n") >= annulus_share * _offsets(inner, outer)) & (F.col("n") >= least))
    flux = [(F.col(f"sum_{c}") - F.col("k") * F.col(f"sky_{c}")).alias(f"flux_{c}") for c in CHANNELS]
    found = found.select("frame_id", "rank", *flux, (F.col("safe") >= clip(0.25 + 0.5 * F.col("share"), 0.25, 0.55) * F.col("n")).alias("calm"))
    good = (F.col("flux_r") > 0) & (F.col("flux_g") > 0) & (F.col("flux_b") > 0)
    # a frame's star list is bounded by the catalog's magnitudes
    strict = F.count_if(good & F.col("calm")).over(of)
    found = found.withColumn("relaxed", (strict < min_stars) & (F.count_if(good).over(of) > strict))
    return found.where(good & (F.col("calm") | F.col("relaxed"))).select("frame_id", "rank", *(f"flux_{c}" for c in CHANNELS), "relaxed")


def colour_run(measured: DataFrame, catalog: DataFrame, frames: DataFrame, **guards) -> DataFrame:
    """frame_id, n_stars, kr, kb, applied, reason of every frame: gains from measured fluxes and catalog(rank, cat_r,
    cat_b); gains of 1 where a guard failed or the frame has no star."""
    stars = measured.join(catalog, "rank").select("frame_id", F.col("rank").alias("id"), (F.col("flux_r") / F.col("flux_g")).alias("img_r"), (F.col("flux_b") / F.col("flux_g")).alias("img_b"), "cat_r", "cat_b")
    found = frames.select("frame_id").distinct().join(gains(stars, **guards), "frame_id", "left")
    ok = F.col("n_stars").isNotNull() & F.col("reason").isNull()
    return found.select("frame_id", F.coalesce("n_stars", F.lit(0)).cast("long").alias("n_stars"), *(F.when(ok, F.col(c)).otherwise(1.0).alias(c) for c in ("kr", "kb")), ok.alias("applied"), F.when(F.col("n_stars").isNull(), "few stars").otherwise(F.col("reason")).alias("reason"))
