"""Smooth surfaces through coarse grids, one for each frame (and channel), taken off the pixels if they leave them flatter.

``key`` names the columns that tell images apart. A task fits one image's coarse grid (some hundred cells, whatever the
image); pixels meet their surface by an equi join on the image and a band of rows, so no task holds a whole image.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from starloom.functions.robust import MAD_TO_SIGMA
from starloom.operators.groups import in_groups
from starloom.operators.joins import nearest_cells


def robust_fit(design: np.ndarray, v: np.ndarray, ridge: float = 0.0, rounds: int = 8, k: float = 1.345) -> np.ndarray:
    """Least squares, repeated with Huber weights from the residuals' MAD sigma."""
    w = np.ones(len(v))
    for _ in range(rounds):
        left = design.T @ (design * w[:, None]) + ridge * np.eye(design.shape[1])
        c = np.linalg.lstsq(left, design.T @ (w * v), rcond=None)[0]
        far = np.abs(v - design @ c)
        sigma = MAD_TO_SIGMA * np.median(far)
        if sigma <= 1e-12:
            break
        w = np.minimum(1, k * sigma / np.maximum(far, 1e-12))
    return c


def powers(degree: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(degree + 1) for j in range(degree + 1 - i)]


def _poly_fit(g: np.ndarray, degree: int) -> dict:
    """A polynomial through the grid: its terms are rows (power of y, power of x, coefficient)."""
    if not len(g):
        return {"method": "poly", "rms": 0.0, "y0": 0.0, "x0": 0.0, "unit": 1.0, "mid": 0.0, "nodes": []}
    y0, x0 = g[:, 0].mean(), g[:, 1].mean()
    size = max(float(np.ptp(g[:, 0])), float(np.ptp(g[:, 1])), 1.0)
    y, x = (g[:, 0] - y0) / size, (g[:, 1] - x0) / size
    design = np.stack([y**i * x**j for i, j in powers(degree)], 1)
    c = robust_fit(design, g[:, 2])
    rms = float(np.sqrt(np.mean((g[:, 2] - design @ c) ** 2)))
    return {"method": "poly", "rms": rms, "y0": y0, "x0": x0, "unit": size, "mid": 0.0, "nodes": [[float(i), float(j), float(k)] for k, (i, j) in zip(c, powers(degree), strict=True)]}


KERNELS = {
    "multiquadric": (lambda d, s: np.sqrt(d * d + s * s), lambda d, s: F.sqrt(d * d + s * s)),
    "gaussian": (lambda d, s: np.exp(-d * d / (2 * s * s)), lambda d, s: F.exp(-d * d / (2 * s * s))),
    "thinplate": (lambda d, s: d * d * np.log(d + s), lambda d, s: d * d * F.ln(d + s)),
}
RIDGES = tuple(1e-6 * 3.0**i for i in range(6))


def _radial_fit(g: np.ndarray, kernel: str, reach: float, ridges: tuple[float, ...]) -> tuple[np.ndarray, float]:
    """Coefficients (one a cell) and rms: the strongest ridge that stays within a fifth of the cells' own scatter, else
    the one that fits best."""
    far = np.hypot(g[:, None, 0] - g[None, :, 0], g[:, None, 1] - g[None, :, 1])
    design, v = KERNELS[kernel][0](far, reach), g[:, 2] - np.median(g[:, 2])
    limit = max(0.15, 0.2 * MAD_TO_SIGMA * np.median(np.abs(v - np.median(v))))
    tried = [(robust_fit(design, v, r), r) for r in sorted(ridges)]
    scored = [(c, float(np.sqrt(np.mean((v - design @ c) ** 2)))) for c, _ in tried]
    within = [t for t in scored if t[1] <= limit]
    return within[-1] if within else min(scored, key=lambda t: t[1])


def _radial(g: np.ndarray, kernel: str, reach: float | None) -> dict:
    """A radial-basis surface: its terms are rows (y, x, coefficient); below three cells there is none."""
    if len(g) < 3:
        return {"method": kernel, "rms": 0.0, "y0": 0.0, "x0": 0.0, "unit": 1.0, "mid": 0.0, "nodes": []}
    step = np.diff(np.unique(g[:, 0]))
    reach = reach or float(step.min() if len(step) else 1.0)
    c, rms = _radial_fit(g, kernel, reach, RIDGES)
    return {"method": kernel, "rms": rms, "y0": 0.0, "x0": 0.0, "unit": reach, "mid": float(np.median(g[:, 2])), "nodes": [[float(a), float(b), float(k)] for (a, b, _), k in zip(g, c, strict=True)]}


def _valid(pdf: pd.DataFrame) -> np.ndarray:
    return pdf[["y", "x", "v"]].dropna().sort_values(["y", "x"]).to_numpy(float)


def surfaces(cells: DataFrame, method: str = "multiquadric", degree: int = 2, reach: float | None = None, worst: float | None = None, key: Iterable[str] = ("frame_id",)) -> DataFrame:
    """One row an image: the surface through its cells(*key, y, x, v) by ``method`` (poly or a kernel), null and NaN
    cells left out. ``reach`` defaults to the grid's spacing. With ``worst``, a radial surface whose rms is above it
    gives way to a polynomial that fits better."""
    key = list(key)

    def best(g: np.ndarray) -> dict:
        if method == "poly":
            return _poly_fit(g, degree)
        found = _radial(g, method, reach)
        if worst is not None and found["rms"] > worst:
            other = _poly_fit(g, degree)
            return other if other["rms"] < found["rms"] else found
        return found

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{k: pdf[k].iloc[0] for k in key} | best(_valid(pdf))])

    out = StructType([cells.schema[k] for k in key] + StructType.fromDDL("method string, rms double, y0 double, x0 double, unit double, mid double, nodes array<array<double>>").fields)
    return cells.select(*key, "y", "x", "v").groupBy(*key).applyInPandas(run, out)


def modelled(px: DataFrame, found: DataFrame, key: Iterable[str] = ("frame_id",), band: int = 256) -> DataFrame:
    """px with the column model: its image's surface at the pixel."""
    key, rows = list(key), F.floor(F.col("y") / band)
    wide = found.select(*key, F.struct("method", "y0", "x0", "unit", "mid", "nodes").alias("__s")).join(px.select(*key, rows.alias("__band")).distinct(), key)
    s, y, x = (lambda n: F.col("__s")[n]), F.col("y"), F.col("x")
    over = lambda term: F.aggregate(s("nodes"), F.lit(0.0), lambda total, n: total + n[2] * term(n))
    value = F.when(s("method") == "poly", over(lambda n: F.pow((y - s("y0")) / s("unit"), n[0]) * F.pow((x - s("x0")) / s("unit"), n[1])))
    for name, (_, shape) in KERNELS.items():
        value = value.when(s("method") == name, over(lambda n, shape=shape: shape(F.sqrt((y - n[0]) * (y - n[0]) + (x - n[1]) * (x - n[1])), s("unit"))))
    return px.withColumn("__band", rows).join(wide, [*key, "__band"]).select(*px.columns, (s("mid") + value).alias("model"))


def _spread(c: str):
    return F.percentile(c, 0.9) - F.percentile(c, 0.1)


def _slope(v: str):
    """Length of the gradient of the least-squares plane through points (y, x, v)."""
    c = lambda a, b: F.covar_pop(a, b)
    det = c("x", "x") * c("y", "y") - c("x", "y") * c("x", "y")
    sx, sy = c("x", v) * c("y", "y") - c("y", v) * c("x", "y"), c("y", v) * c("x", "x") - c("x", v) * c("x", "y")
    return F.when(F.abs(det) > 1e-12, F.sqrt(sx * sx + sy * sy) / F.abs(det))


def plane(px: DataFrame, cells: DataFrame, key: Iterable[str] = ("frame_id",)) -> DataFrame:
    """px with the column model: the least-squares plane through its image's cells(*key, y, x, v); level where the cells
    lie on a line. One small aggregation, without Python."""
    c, key = (lambda a, b: F.covar_pop(a, b)), list(key)
    det = c("x", "x") * c("y", "y") - c("x", "y") * c("x", "y")
    slope = lambda e: F.coalesce(F.when(F.abs(det) > 1e-12, e / det), F.lit(0.0))
    fit = cells.groupBy(*key).agg(
        slope(c("x", "v") * c("y", "y") - c("y", "v") * c("x", "y")).alias("__sx"), slope(c("y", "v") * c("x", "x") - c("x", "v") * c("x", "y")).alias("__sy"),
        F.avg("y").alias("__y"), F.avg("x").alias("__x"), F.avg("v").alias("__v"))
    model = F.col("__v") + F.col("__sx") * (F.col("x") - F.col("__x")) + F.col("__sy") * (F.col("y") - F.col("__y"))
    return px.join(fit, key).select(*px.columns, model.alias("model"))


def subtract(px: DataFrame, block: int, flat: float = 1.15, steep: float | None = None, key: Iterable[str] = ("frame_id",), together: Iterable[str] | None = None) -> DataFrame:
    """px(*key, y, x, v, model) to v - model + median(model), and the column applied.

    An image stays as it is where the spread of its block medians would grow beyond ``flat`` times or, with ``steep``,
    the slope of the plane through them beyond that many times. Images that share the columns ``together`` (the channels
    of a frame) are corrected all or not at all. What is joined back to the pixels has a row an image.
    """
    key, unit = list(key), list(together or key)
    moved = px.join(px.groupBy(*key).agg(F.median("model").alias("__m")), key).withColumn("__v", F.col("v") - F.col("model") + F.col("__m"))
    at = lambda c: F.floor(F.col(c) / block).alias(c)
    blocks = moved.groupBy(*key, at("y"), at("x")).agg(F.median("v").alias("old"), F.median("__v").alias("new"))
    test = _spread("new") <= flat * _spread("old")
    if steep is not None:
        test = test & F.coalesce(_slope("new") <= steep * _slope("old"), F.lit(True))
    good = blocks.groupBy(*key).agg(test.alias("ok")).groupBy(*unit).agg(F.min("ok").alias("applied"))
    return moved.join(good, unit).select(*key, "y", "x", F.when(F.col("applied"), F.col("__v")).otherwise(F.col("v")).alias("v"), "applied")


def chroma_guard(before: DataFrame, after: DataFrame, sky: DataFrame, limit: float = 1.08) -> DataFrame:
    """after(frame_id, y, x, r, g, b) where neither ln(r / g) nor ln(b / g) scatters over the sky(frame_id, y, x) beyond
    ``limit`` times what it did in ``before``; the frame as it was where one does. The column chroma_ok tells which."""
    pair = before.join(after.select("frame_id", "y", "x", *(F.col(c).alias(f"__{c}") for c in "rgb")), ["frame_id", "y", "x"])
    std = lambda a, g: F.stddev_pop(F.ln(F.when(F.col(a) > 0, F.col(a)) / F.when(F.col(g) > 0, F.col(g))))
    keep = lambda c: F.coalesce(std(f"__{c}", "__g") <= limit * std(c, "g"), F.lit(True))
    ok = pair.join(sky.select("frame_id", "y", "x"), ["frame_id", "y", "x"], "left_semi").groupBy("frame_id").agg((keep("r") & keep("b")).alias("__ok"))
    ok_col = F.coalesce("__ok", F.lit(True))
    return pair.join(ok, "frame_id", "left").select("frame_id", "y", "x", *(F.when(ok_col, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in "rgb"), ok_col.alias("chroma_ok"))


def autotune(cells: DataFrame, every: int = 5, degrees: tuple[int, ...] = (1, 2, 3), kernels: tuple[str, ...] = tuple(KERNELS), reaches: tuple[float, ...] = (1.0, 2.0), steps: tuple[int, ...] = (1,)) -> DataFrame:
    """frame_id, trial, method (poly or a kernel), degree, reach, step, rms, rank: all settings for the cells(frame_id,
    y, x, v) of each frame, fitted without each ``every``-th cell and measured on these; ``step`` takes only each n-th
    row and column of the grid. The best of a frame has rank 1, ties go to the simpler (earlier) trial; a frame with
    fewer than three cells to fit has no finite rms. Frames whose cells lie at the same places are fitted together."""
    kinds = [("poly", d, None) for d in degrees] + [(k, None, r) for k in kernels for r in reaches]
    trials = [(i, *t, n) for i, (t, n) in enumerate((t, n) for t in kinds for n in steps)]
    rows = F.array(*(F.struct(F.lit(i).alias("trial"), F.lit(m).alias("method"), F.lit(d).cast("int").alias("degree"), F.lit(r).cast("double").alias("reach"), F.lit(n).alias("step")) for i, m, d, r, n in trials))
    each = cells.select("frame_id", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), F.col("v").cast("double").alias("v"))
    scored = in_groups(each, ["frame_id"], _held_out(trials, every), f"frame_id {cells.schema['frame_id'].dataType.simpleString()}, trial int, rms double", sort=["y", "x"])
    scored = scored.select("frame_id", F.element_at(rows, F.col("trial") + 1).alias("t"), "rms").select("frame_id", "t.*", "rms")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("frame_id").orderBy(F.round("rms", 6), "trial")))


FITTED = 1_000_000  # numbers in the matrices that are solved at once


def robust_fits(design: np.ndarray, v: np.ndarray, ridge: float = 0.0, rounds: int = 8, k: float = 1.345) -> np.ndarray:
    """:func:`robust_fit` of one design to each row of v."""
    n, p = design.shape
    out, live, w = np.zeros((len(v), p)), np.arange(len(v)), np.ones(v.shape)
    for _ in range(rounds):
        left = ((design.T[None] * w[:, None, :]).reshape(-1, n) @ design).reshape(-1, p, p) + ridge * np.eye(p)
        right = (w * v[live]) @ design
        if ridge > 10 * np.finfo(float).eps * p * np.trace(left, axis1=1, axis2=2).max(initial=0.0):  # of full rank
            c = np.linalg.solve(left, right[..., None])[..., 0]
        else:
            a, s, b = np.linalg.svd(left)
            keep = s > np.finfo(float).eps * p * s[:, :1]
            c = np.einsum("bji,bj->bi", b, np.einsum("bji,bj->bi", a, right) * np.where(keep, 1 / np.where(keep, s, 1.0), 0.0))
        out[live] = c
        far = np.abs(v[live] - c @ design.T)
        sigma = MAD_TO_SIGMA * np.median(far, 1)
        on = sigma > 1e-12
        if not on.any():
            break
        live, far, sigma = live[on], far[on], sigma[on]
        w = np.minimum(1, k * sigma[:, None] / np.maximum(far, 1e-12))
    return out


def _rms(d: np.ndarray) -> np.ndarray:
    return np.sqrt(np.mean(d**2, 1))


def _trial(fit: np.ndarray, out: np.ndarray, v: np.ndarray, held: np.ndarray, method: str, degree: int | None, reach: float | None) -> np.ndarray:
    """rms at the places ``out`` (values: rows of held) of surfaces through the places ``fit`` (values: rows of v)."""
    if method == "poly":
        mid = fit.mean(0)
        size = max(float(np.ptp(fit[:, 0])), float(np.ptp(fit[:, 1])), 1.0)
        terms = lambda g: np.stack([((g[:, 0] - mid[0]) / size) ** i * ((g[:, 1] - mid[1]) / size) ** j for i, j in powers(degree)], 1)
        return _rms(held - robust_fits(terms(fit), v) @ terms(out).T)
    spacing = np.diff(np.unique(fit[:, 0]))
    shape = lambda g: KERNELS[method][0](np.hypot(g[:, None, 0] - fit[:, 0], g[:, None, 1] - fit[:, 1]), reach * float(spacing.min() if len(spacing) else 1.0))
    design, mid = shape(fit), np.median(v, 1, keepdims=True)
    d = v - mid
    limit = np.maximum(0.15, 0.2 * MAD_TO_SIGMA * np.median(np.abs(d - np.median(d, 1, keepdims=True)), 1))
    tried = [robust_fits(design, d, r) for r in sorted(RIDGES)]
    score = np.stack([_rms(d - c @ design.T) for c in tried])
    within = score <= limit
    best = np.where(within.any(0), len(tried) - 1 - within[::-1].argmax(0), score.argmin(0))
    return _rms(held - (np.stack(tried)[best, np.arange(len(v))] @ shape(out).T + mid))


def _held_out(trials: list[tuple], every: int) -> Callable[[dict[str, np.ndarray], np.ndarray], dict[str, np.ndarray]]:
    """Frames whose cells lie at the same places are fitted together: they share every trial's design."""
    def run(cols: dict[str, np.ndarray], starts: np.ndarray) -> dict[str, np.ndarray]:
        good = ~(np.isnan(cols["y"]) | np.isnan(cols["x"]) | np.isnan(cols["v"]))
        ends = np.concatenate([[0], np.cumsum(good)])[starts]
        g = np.stack([cols[c][good] for c in "yxv"], 1)
        alike: dict[bytes, list[int]] = {}
        for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            alike.setdefault(g[a:b, :2].tobytes(), []).append(i)
        rms = np.full((len(starts) - 1, len(trials)), np.inf)
        for frames in alike.values():
            a, n = ends[frames[0]], ends[frames[0] + 1] - ends[frames[0]]
            at, test = g[a : a + n, :2], np.arange(n) % every == every - 1
            for i in range(0, len(frames), step := max(1, FITTED // max(1, n * n))):
                some = frames[i : i + step]
                v = np.stack([g[ends[f] : ends[f] + n, 2] for f in some])
                for t, method, degree, reach, nth in trials:
                    lines = lambda c, nth=nth: np.searchsorted(np.unique(at[:, c]), at[:, c]) % nth == 0
                    fit = ~test & lines(0) & lines(1)
                    if fit.sum() >= 3 and test.any():
                        rms[some, t] = _trial(at[fit], at[test], v[:, fit], v[:, test], method, degree, reach)
        return {"frame_id": np.repeat(cols["frame_id"][starts[:-1]], len(trials)), "trial": np.tile(np.array([t[0] for t in trials], np.int32), len(rms)), "rms": rms.ravel()}

    return run


def _side(df: DataFrame, small: DataFrame, key: list[str]) -> DataFrame:
    """df beside a table with a row an image (without a key: a single row)."""
    return df.join(small, key) if key else df.join(F.broadcast(small))


def mesh_cells(px: DataFrame, size: int, sigmas: float = 3.0, least: int = 4, key: Iterable[str] = ()) -> DataFrame:
    """cells(*key, cy, cx, v) of px(*key, y, x, v): medians of pixels within ``sigmas`` of the image's median (bright sources fall out);
    a cell with fewer than ``least`` of them takes the value of the nearest that has a value."""
    key = list(key)
    m = _side(px, px.groupBy(*key).agg(F.median("v").alias("__m")), key)
    m = _side(m, m.groupBy(*key).agg((MAD_TO_SIGMA * F.median(F.abs(F.col("v") - F.col("__m")))).alias("__s")), key)
    calm = F.when((F.col("__s") <= 0) | (F.abs(F.col("v") - F.col("__m")) <= sigmas * F.col("__s")), F.col("v"))
    cells = m.groupBy(*key, F.floor(F.col("y") / size).alias("cy"), F.floor(F.col("x") / size).alias("cx")).agg(F.median(calm).alias("v"), F.count(calm).alias("n"))
    return nearest_cells(cells.select(*key, "cy", "cx", F.when(F.col("n") >= least, F.col("v")).alias("v")), *key)


def mesh(px: DataFrame, cells: DataFrame, size: int, key: Iterable[str] = ()) -> DataFrame:
    """px with the column model: cells read bilinearly between their centres, level beyond the outermost ones.

    Four equi joins with the coarse grid; Spark broadcasts it where it is small and shuffles both sides where not."""
    key = list(key)
    df = _side(px, cells.groupBy(*key).agg(F.max("cy").alias("__hy"), F.max("cx").alias("__hx")), key)
    for c, h in (("y", "__hy"), ("x", "__hx")):
        at = F.least(F.greatest((F.col(c) + 0.5) / size - 0.5, F.lit(0.0)), F.col(h).cast("double"))
        df = df.withColumn(f"__{c}0", F.floor(at)).withColumn(f"__{c}1", F.least(F.col(f"__{c}0") + 1, F.col(h))).withColumn(f"__{c}f", at - F.floor(at))
    for i in (0, 1):
        for j in (0, 1):
            df = df.join(cells.select(*key, F.col("cy").alias(f"__y{i}"), F.col("cx").alias(f"__x{j}"), F.col("v").alias(f"__c{i}{j}")), [*key, f"__y{i}", f"__x{j}"], "left")
    side = lambda i: F.col(f"__c{i}0") * (1 - F.col("__xf")) + F.col(f"__c{i}1") * F.col("__xf")
    return df.withColumn("model", side(0) * (1 - F.col("__yf")) + side(1) * F.col("__yf")).select(*px.columns, "model")
