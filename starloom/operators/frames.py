"""Projections, statistics, windows and stacking over px(frame_id, y, x, v)."""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions.robust import MAD_TO_SIGMA, clip, floor_rank, hann, median_or_zero, nearest_rank, robust_z, round6, upper_median
from starloom.operators.groups import in_groups

CELL, TILE, STRIDE = 4, 8, 4  # tiles of 8 x 8 pixels, every 4 pixels: each pixel is in up to four


def normalize(px: DataFrame) -> DataFrame:
    """Values divided by the frame's background (its median), with a scale of its own for odd parity."""
    scale = px.groupBy("frame_id").agg(median_or_zero(F.col("v")).alias("b"), F.median(F.when((F.col("y") % 2 == 0) & (F.col("x") % 2 == 0), F.col("v"))).alias("b_red"))
    red = (F.col("y") % 2 == 0) & (F.col("x") % 2 == 0)
    # frames are joined by key: the scale table has a row a frame
    return px.join(scale, "frame_id").select("frame_id", "y", "x", round6(F.col("v") / F.greatest(F.when(red, F.col("b_red")).otherwise(F.col("b")), F.lit(1e-6))).alias("v"))


def frame_stats(px: DataFrame) -> DataFrame:
    med = px.withColumn("m", F.median("v").over(Window.partitionBy("frame_id")))
    return med.groupBy("frame_id").agg(
        F.count("v").alias("n"), round6(F.min("v")).alias("lo"), round6(F.max("v")).alias("hi"), round6(F.first("m")).alias("med"),
        round6(F.median(F.abs(F.col("v") - F.col("m"))) * MAD_TO_SIGMA).alias("sigma"), round6(F.percentile("v", 0.95)).alias("p95_linear"),
        round6(nearest_rank(F.col("v"), 0.95)).alias("p95_nearest"), round6(floor_rank(F.col("v"), 0.95)).alias("p95_floor"),
        round6(upper_median(F.col("v"))).alias("upper_med"), F.round(F.stddev_pop("v"), 4).alias("std_pop"), F.round(F.stddev_samp("v"), 4).alias("std_samp"),
    )


def sigma_clip_background(px: DataFrame, rounds: int = 5, k: float = 3.0) -> DataFrame:
    """Median after at most ``rounds`` strict clips at k population sigmas; stops where nothing or all would go."""
    w = Window.partitionBy("frame_id")
    df = px.withColumn("keep", F.lit(True)).withColumn("stop", F.lit(False))
    for _ in range(rounds):
        kept = F.when(F.col("keep"), F.col("v"))
        df = df.withColumn("m", F.median(kept).over(w)).withColumn("s", F.stddev_pop(kept).over(w))
        df = df.withColumn("next", F.col("keep") & (F.abs(F.col("v") - F.col("m")) < k * F.col("s")))
        df = df.withColumn("n0", F.sum(F.col("keep").cast("int")).over(w)).withColumn("n1", F.sum(F.col("next").cast("int")).over(w))
        df = df.withColumn("stop", F.col("stop") | (F.col("n1") == F.col("n0")) | (F.col("n1") == 0)).withColumn("keep", F.when(F.col("stop"), F.col("keep")).otherwise(F.col("next")))
    return df.groupBy("frame_id").agg(round6(F.median(F.when(F.col("keep"), F.col("v")))).alias("background"), F.sum(F.col("keep").cast("long")).alias("n_kept"))


def sampled(px: DataFrame, n: int) -> DataFrame:
    """The rows of ``n`` frames spread evenly from the first to the last (frame_id counts from 0)."""
    last = px.agg(F.max("frame_id").alias("__hi"))
    wanted = last.select(F.explode(F.array_distinct(F.array(*(F.floor(i * F.col("__hi") / (n - 1) + 0.5) for i in range(n))))).alias("frame_id"))
    return px.join(F.broadcast(wanted), "frame_id", "left_semi")


def coverage(px: DataFrame, frames: int) -> DataFrame:
    """covered: frames with a value above 0 at a pixel; common: whether at least ``frames`` have one."""
    valid = (~F.isnan("v") & (F.col("v") > 0)).cast("long")
    return px.groupBy("y", "x").agg(F.sum(valid).alias("covered")).withColumn("common", F.col("covered") >= frames)


def metrics(px: DataFrame) -> DataFrame:
    """background, noise (MAD sigma) and gradient energy of each frame."""
    med = px.withColumn("m", F.median("v").over(Window.partitionBy("frame_id")))
    row = Window.partitionBy("frame_id", "y").orderBy("x")
    g = F.coalesce(F.lead("v").over(row), F.col("v")) - F.coalesce(F.lag("v").over(row), F.col("v"))
    graded = med.withColumn("g2", g * g)
    return graded.groupBy("frame_id").agg(F.first("m").alias("background"), (F.median(F.abs(F.col("v") - F.col("m"))) * MAD_TO_SIGMA).alias("noise"), F.median("g2").alias("energy"))


def global_weights(m: DataFrame, wb: float = 0.4, wn: float = 0.3, wg: float = 0.3, k: float = 1.0, limit: float = 3.0, adaptive: bool = False) -> DataFrame:
    """exp(k * clip(-wb z(background) - wn z(noise) + wg z(energy))); the metrics have one row a frame.

    ``adaptive`` takes the z-scores' shares of variance, held to [0.1, 0.7], as weights, where there are more than two
    frames and any variance."""
    every = Window.partitionBy()
    for c in ("background", "noise", "energy"):
        m = robust_z(m, c, every, f"z_{c}")
    shares = [F.lit(wb), F.lit(wn), F.lit(wg)]
    if adaptive:
        variance = [F.var_pop(f"z_{c}").over(every) for c in ("background", "noise", "energy")]
        total = variance[0] + variance[1] + variance[2]
        held = [clip(v / total, 0.1, 0.7) for v in variance]
        use = (F.count("*").over(every) > 2) & (total > 1e-12)
        shares = [F.when(use, h / (held[0] + held[1] + held[2])).otherwise(s) for h, s in zip(held, shares, strict=True)]
    q = clip(shares[0] * -F.col("z_background") + shares[1] * -F.col("z_noise") + shares[2] * F.col("z_energy"), -limit, limit)
    return m.select("frame_id", round6(q).alias("quality"), round6(F.exp(k * q)).alias("weight"))


def tile_of(px: DataFrame, side: int) -> DataFrame:
    """Each pixel with every overlapping tile it is in: an exploded equi key, no range join."""
    last = (side - TILE) // STRIDE
    at = lambda c: F.sequence(F.greatest(F.floor((F.col(c) - TILE + STRIDE) / STRIDE), F.lit(0)).cast("int"), F.least(F.floor(F.col(c) / STRIDE), F.lit(last)).cast("int"))
    return px.withColumn("trow", F.explode(at("y"))).withColumn("tcol", F.explode(at("x")))


def local_weights(px: DataFrame, side: int) -> DataFrame:
    """Per tile across frames: 0.7 z(spread / noise) - 0.3 z(background), clipped, exponentiated."""
    t = tile_of(px, side)
    med = t.withColumn("m", F.median("v").over(Window.partitionBy("frame_id", "trow", "tcol")))
    stat = med.groupBy("frame_id", "trow", "tcol").agg(F.first("m").alias("background"), (F.median(F.abs(F.col("v") - F.col("m"))) * MAD_TO_SIGMA).alias("noise"), (F.max("v") - F.min("v")).alias("spread"))
    stat = stat.withColumn("ratio", F.col("spread") / (F.col("noise") + 1e-6))
    w = Window.partitionBy("trow", "tcol")
    z = robust_z(robust_z(stat, "ratio", w, "zr"), "background", w, "zb")
    q = clip(0.7 * F.col("zr") - 0.3 * F.col("zb"), -3.0, 3.0)
    return z.select("frame_id", "trow", "tcol", round6(F.exp(q)).alias("weight"))


def stack(px: DataFrame, low: float = 2.0, high: float = 2.0, iters: int = 3, min_frac: float = 0.5, weighted: bool = False, keys: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """Sigma-clipped (weighted) mean of each pixel over frames; invalid values (not finite, or not above 0) take no part.

    Each round clips at mean -/+ sigmas of what is kept. Where fewer than ceil(min_frac * n) survive, the rounds stop
    with the over-clipped set; an empty set falls back to the mean of all valid values. A task holds one pixel's values
    over all frames (and weights) at a time, as arrays.
    """
    types = {f.name: f.dataType.simpleString() for f in px.schema}
    rows = px.where((F.col("v") > 0) & (F.col("v") < float("inf"))).select(*keys, F.col("v").cast("double").alias("v"), (F.col("w") if weighted else F.lit(1.0)).cast("double").alias("w"))

    def run(cols: dict[str, np.ndarray], starts: np.ndarray) -> dict[str, np.ndarray]:
        v, w, n = cols["v"], np.where(np.isnan(cols["w"]), 0.0, cols["w"]), np.diff(starts)
        total = lambda a: np.add.reduceat(a, starts[:-1])
        each = lambda a: np.repeat(a, n)
        keep, stop, left = np.ones(len(v), bool), n <= 2, n
        with np.errstate(divide="ignore", invalid="ignore"):
            for _ in range(iters):
                if stop.all():
                    break
                k = keep * w
                v1 = total(k)
                mean, free = total(k * v) / v1, v1 - total(k * w) / v1
                sigma = np.sqrt(total(k * (v - each(mean)) ** 2) / free)
                known = (v1 != 0) & (free != 0) & ~stop  # elsewhere nothing is clipped
                keep &= ~each(known) | ((v >= each(mean - low * sigma)) & (v <= each(mean + high * sigma)))
                had, left = left, total(keep.astype(np.int64))
                stop = stop | (left < np.ceil(min_frac * n)) | (left == had)
            k = keep * w
            mean = np.where(total(k) != 0, total(k * v) / total(k), total(v) / n)
        return {c: cols[c][starts[:-1]] for c in keys} | {"v": mean, "n_kept": left}

    found = in_groups(rows, list(keys), run, ", ".join(f"{c} {types[c]}" for c in keys) + ", v double, n_kept long")
    return found.withColumn("v", F.round("v", 4))


def overlap_add(tiles: DataFrame, keys: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """Tiles blended with two-dimensional Hann windows (times their column w, if there); null where these sum to nothing."""
    w = hann(F.col("y") - F.col("trow") * STRIDE, TILE) * hann(F.col("x") - F.col("tcol") * STRIDE, TILE)
    s = tiles.withColumn("hw", w * F.col("w") if "w" in tiles.columns else w).groupBy(*keys).agg(F.sum(F.col("v") * F.col("hw")).alias("vs"), F.sum("hw").alias("ws"))
    return s.select(*keys, F.when(F.col("ws") > 1e-6, F.round(F.col("vs") / F.col("ws"), 4)).alias("v"))


def seams(px: DataFrame, side: int) -> DataFrame:
    """Neighbouring tiles (right or below), compared over the pixels both cover."""
    t = tile_of(px, side).groupBy("trow", "tcol", "y", "x").agg(F.avg("v").alias("v"))
    # the value of a tile differs from its neighbour's by the tile's own median
    t = t.withColumn("v", F.col("v") - F.median("v").over(Window.partitionBy("trow", "tcol")))
    a = t.select(F.col("trow").alias("r1"), F.col("tcol").alias("c1"), "y", "x", F.col("v").alias("va"))
    b = t.select(F.col("trow").alias("r2"), F.col("tcol").alias("c2"), "y", "x", F.col("v").alias("vb"))
    right = a.join(b.withColumn("r1", F.col("r2")).withColumn("c1", F.col("c2") - 1), ["r1", "c1", "y", "x"])
    below = a.join(b.withColumn("r1", F.col("r2") - 1).withColumn("c1", F.col("c2")), ["r1", "c1", "y", "x"])
    d = right.unionByName(below).withColumn("d", F.abs(F.col("va") - F.col("vb")))
    return d.groupBy("r1", "c1", "r2", "c2").agg(F.count("*").alias("samples"), F.round(F.avg("d"), 4).alias("mean_abs"), F.round(nearest_rank(F.col("d"), 0.95), 4).alias("p95_abs"))


def local_maxima(px: DataFrame, sigmas: float = 1.0, top: int = 3) -> DataFrame:
    """The brightest strict maxima of their rows and columns above median + sigmas * sigma, per frame."""
    frame = Window.partitionBy("frame_id")
    m = px.withColumn("m", F.median("v").over(frame)).withColumn("s", F.median(F.abs(F.col("v") - F.col("m"))).over(frame) * MAD_TO_SIGMA)
    row, col = Window.partitionBy("frame_id", "y").orderBy("x"), Window.partitionBy("frame_id", "x").orderBy("y")
    low = F.lit(float("-inf"))
    near = [F.coalesce(f("v").over(w), low) for f in (F.lag, F.lead) for w in (row, col)]
    peaks = m.withColumn("near", F.greatest(*near)).where((F.col("v") > F.col("near")) & (F.col("v") > F.col("m") + sigmas * F.col("s")))
    nth = F.row_number().over(Window.partitionBy("frame_id").orderBy(F.col("v").desc(), "y", "x"))
    return peaks.withColumn("rank", nth).where(F.col("rank") <= top).select("frame_id", "rank", "y", "x", round6(F.col("v")).alias("v"))


def quantile_labels(df: DataFrame, value: str, k: int) -> DataFrame:
    """floor(rank * k / n) on the values in ascending order; one row a frame."""
    rank = F.row_number().over(Window.orderBy(value, "frame_id")) - 1
    return df.withColumn("label", F.floor(rank * k / F.count("*").over(Window.partitionBy())).cast("int"))


def kmeans(points: DataFrame, dims: list[str], k: int, rounds: int = 20) -> DataFrame:
    """Lloyd's rounds on a frame table: the first centre is the middle row, the others are farthest points, an empty
    cluster's centre is 0. Centres (k rows) are held by the driver, points are not; these are kept by the executors (on
    disk where memory is short) while the rounds read them, a lost part is computed anew."""
    points = points.persist(StorageLevel.MEMORY_AND_DISK)
    n = points.count()
    if not n:
        return points.withColumn("label", F.lit(0))
    mid = points.orderBy("frame_id").offset(n // 2).limit(1).select(*dims).first()
    centres = [tuple(mid)]
    dist = lambda c: sum(((F.col(d) - F.lit(float(v))) * (F.col(d) - F.lit(float(v))) for d, v in zip(dims, c, strict=True)), F.lit(0.0))
    nearest = lambda: F.least(*map(dist, centres)) if len(centres) > 1 else dist(centres[0])
    while len(centres) < k:
        centres.append(tuple(points.orderBy(nearest().desc(), "frame_id").select(*dims).first()))
    label = lambda: F.array_position(F.transform(F.array(*map(dist, centres)), lambda d: d <= nearest()), True) - 1
    for _ in range(rounds):
        found = {r["label"]: r for r in points.withColumn("label", label()).groupBy("label").agg(*(F.avg(d).alias(d) for d in dims)).collect()}
        new = [tuple(found[i][d] for d in dims) if i in found else (0.0,) * len(dims) for i in range(k)]
        if new == centres:
            break
        centres = new
    return points.withColumn("label", label().cast("int"))


def tile_grid(spark, height: int, width: int, size: int, overlap: float) -> DataFrame:
    """trow, tcol, y0, x0 of a grid of tiles; the last row and column are moved inwards, a frame below one tile has one."""
    step = max(1, int(size * (1 - overlap)))
    n = lambda length: 1 + max(0, -(-(length - size) // step))
    at = lambda i, length: F.least(F.col(i) * step, F.lit(max(length - size, 0))).cast("int")
    rows = spark.range(n(height)).select(F.col("id").cast("int").alias("trow")).withColumn("tcol", F.explode(F.sequence(F.lit(0), F.lit(n(width) - 1))))
    return rows.select("trow", "tcol", at("trow", height).alias("y0"), at("tcol", width).alias("x0"))


def limited(grid: DataFrame, frames: int = 0, tiles: int = 0) -> DataFrame:
    """The first frames and tiles only; 0 is no limit."""
    out = grid.where(F.col("frame") < frames) if frames else grid
    return out.where(F.col("tile") < tiles) if tiles else out


def finite_stats(values: DataFrame, key: str) -> DataFrame:
    """Counts of finite, NaN, infinite and zero values; extremes, mean and sample deviation of the finite ones."""
    infinite = F.abs("v") == float("inf")
    finite = F.when(~F.isnan("v") & ~infinite, F.col("v"))
    return values.groupBy(key).agg(F.count(finite).alias("n"), F.count_if(F.isnan("v")).alias("n_nan"), F.count_if(infinite).alias("n_inf"), F.count_if(F.col("v") == 0).alias("n_zero"), F.min(finite).alias("lo"), F.max(finite).alias("hi"), round6(F.avg(finite)).alias("mean"), round6(F.stddev_samp(finite)).alias("sd"))


def header_scan(headers: DataFrame, key: str) -> DataFrame:
    """Frames, whether they are of one size, a count for each pattern, and whether their colour modes differ."""
    of = lambda p: F.count_if(F.col("found") == p).alias(p.lower())
    return headers.groupBy(key).agg(F.count("*").alias("frames"), (F.count_distinct("width", "height") == 1).alias("one_size"), *map(of, ("RGGB", "BGGR", "GRBG", "GBRG")), (F.count_distinct("mode") > 1).alias("ambiguous"), F.min("mode").alias("first_mode"))


def forward_box(warps: DataFrame, key: str, width: int, height: int) -> DataFrame:
    """The whole pixels that hold the frame itself and its corners under every forward warp."""
    corners = F.array(*(F.struct(F.lit(float(x)).alias("cx"), F.lit(float(y)).alias("cy")) for x in (0, width) for y in (0, height)))
    at = warps.withColumn("c", F.explode(corners))
    x = F.col("a00") * F.col("c.cx") + F.col("a01") * F.col("c.cy") + F.col("tx")
    y = F.col("a10") * F.col("c.cx") + F.col("a11") * F.col("c.cy") + F.col("ty")
    low = lambda e, n: F.floor(F.least(F.lit(0.0), F.min(e))).cast("int").alias(n)
    high = lambda e, m, n: F.ceil(F.greatest(F.lit(float(m)), F.max(e))).cast("int").alias(n)
    return at.groupBy(key).agg(low(x, "x0"), low(y, "y0"), high(x, width, "x1"), high(y, height, "y1"))


def final_stack(px: DataFrame, quality: DataFrame, weighted: bool = True, method: str = "rej", kappa: float = 1.0, cap_ratio: float = 0.0) -> DataFrame:
    """The stack of synthetic frames: weighted by exp(kappa * q), held to ``cap_ratio`` medians if that is given; only
    with weights off does ``method`` count, and "rej" clips by sigma. ``quality`` (frame_id, q) has a row a frame."""
    if not weighted and method == "rej":
        return sigma_clip_stack(px)
    w = quality.select("frame_id", F.exp(kappa * F.col("q")).alias("w") if weighted else F.lit(1.0).alias("w"))
    if weighted and cap_ratio > 0:
        w = w.select("frame_id", F.least("w", F.greatest(F.lit(1e-6), cap_ratio * F.median("w").over(Window.partitionBy()))).alias("w"))
    return px.join(w, "frame_id").groupBy("y", "x").agg(F.round(F.sum(F.col("v") * F.col("w")) / F.greatest(F.lit(1e-6), F.sum("w")), 4).alias("v"))


def enforce_mask(rgb: DataFrame, mask: DataFrame, height: int, width: int) -> DataFrame:
    """Pixels outside the mask set to 0, in frames whose mask has a value for each of their pixels."""
    fits = mask.groupBy("frame_id").agg((F.count("*") == height * width).alias("fits"))
    out = rgb.join(mask, ["frame_id", "y", "x"], "left").join(fits, "frame_id", "left")
    gone = F.coalesce("fits", F.lit(False)) & ~F.coalesce("inside", F.lit(False))
    return out.select("frame_id", "y", "x", *(F.when(gone, 0.0).otherwise(round6(F.col(c))).alias(c) for c in "rgb"))


def metric_report(m: DataFrame) -> DataFrame:
    """Count, extremes, median, mean and population deviation of every metric over the frames."""
    long = m.unpivot("frame_id", ["background", "noise", "energy"], "metric", "value")
    return long.groupBy("metric").agg(F.count("*").alias("n"), *(F.round(e, 4).alias(n) for n, e in (("lo", F.min("value")), ("hi", F.max("value")), ("med", F.median("value")), ("mean", F.avg("value")), ("sd", F.stddev_pop("value")))))
