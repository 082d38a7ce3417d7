"""Shifts and similarities between a frame and the reference, one group a frame."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def phase_shift(image: np.ndarray, reference: np.ndarray) -> tuple[float, float, float]:
    """dy, dx of image against reference by phase correlation, to a fraction of a pixel (parabola), and the peak's height."""
    window = np.outer(np.hanning(image.shape[0] + 2)[1:-1], np.hanning(image.shape[1] + 2)[1:-1])
    a, b = (np.fft.rfft2((m - m.mean()) * window) for m in (image, reference))
    cross = a * b.conj()
    peaks = np.fft.irfft2(cross / np.maximum(np.abs(cross), 1e-12), image.shape)
    at = np.unravel_index(peaks.argmax(), peaks.shape)
    out = []
    for axis, n in enumerate(peaks.shape):
        i = at[axis]
        low, mid, high = (np.take(np.take(peaks, at[1 - axis], 1 - axis), (i + k) % n) for k in (-1, 0, 1))
        bend = low - 2 * mid + high
        place = i + (0.5 * (low - high) / bend if abs(bend) > 1e-12 else 0.0)
        out.append(float(place - n if place > n / 2 else place))
    return out[0], out[1], float(peaks[at])


def frame_shifts(px: DataFrame, reference: int) -> DataFrame:
    """frame_id, dy, dx, peak: each frame against the reference; give it down-sampled frames, as a task holds one."""
    ref = px.where(F.col("frame_id") == reference).select("y", "x", F.col("v").alias("ref"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a, b = np.full((2, int(rows["y"].max()) + 1, int(rows["x"].max()) + 1), np.nan)
        a[rows["y"], rows["x"]], b[rows["y"], rows["x"]] = rows["v"], rows["ref"]
        a, b = (np.where(np.isnan(m), np.nanmedian(m), m) for m in (a, b))
        return pd.DataFrame([(key[0], *phase_shift(a, b))], columns=["frame_id", "dy", "dx", "peak"])

    return px.join(ref, ["y", "x"]).groupBy("frame_id").applyInPandas(run, "frame_id long, dy double, dx double, peak double")


HELD = 200_000  # distances that are looked at at once


def similarity(a: np.ndarray, b: np.ndarray, tolerance: float = 2.0) -> tuple[np.ndarray, int]:
    """The 2 x 3 similarity from points a (x, y) to b with most matches within the tolerance, refitted to them.

    Hypotheses are pairs of stars (the longest first) set upon pairs of about any length between half and twice as long."""
    za, zb = a[:, 0] + 1j * a[:, 1], b[:, 0] + 1j * b[:, 1]
    i, j = np.triu_indices(len(za), 1)
    k, m = np.nonzero(~np.eye(len(zb), dtype=bool))
    best, pairs = (1 + 0j, 0j), np.empty((2, 0), int)
    for n in np.argsort(-np.abs(za[i] - za[j]))[:60]:
        p, q = za[i[n]], za[j[n]]
        turn = (zb[m] - zb[k]) / (q - p) if q != p else np.zeros(0)
        fit = np.flatnonzero((np.abs(turn) >= 0.5) & (np.abs(turn) <= 2))
        for some in np.array_split(fit, -(-len(fit) * len(za) * len(zb) // HELD)) if len(fit) else ():
            far = np.abs((turn[some, None] * (za - p) + zb[k[some], None])[:, :, None] - zb)
            near = far.argmin(2)
            good = np.take_along_axis(far, near[:, :, None], 2)[:, :, 0] <= tolerance
            good &= np.take_along_axis(far.argmin(1), near, 1) == np.arange(len(za))
            most = good.sum(1)
            if most.max(initial=0) > pairs.shape[1]:
                first = most.argmax()
                own = np.flatnonzero(good[first])
                pairs = np.stack([own, near[first, own]])
        if pairs.shape[1] >= max(3, 0.8 * min(len(za), len(zb))):
            break
    if pairs.shape[1] >= 2:
        x, y = za[pairs[0]], zb[pairs[1]]
        dx = x - x.mean()
        t = (dx.conj() @ (y - y.mean())) / (dx.conj() @ dx)
        best = (t, y.mean() - t * x.mean())
    t, o = best
    return np.array([[t.real, -t.imag, o.real], [t.imag, t.real, o.imag]]), pairs.shape[1]


def match_stars(stars: DataFrame, reference: DataFrame, least: int = 3, tolerance: float = 2.0) -> DataFrame:
    """A frame's similarity to the reference's stars; the identity where fewer than ``least`` stars match.

    Both hold the brightest stars of a frame (a top-k list, rank and place): the reference's list is one array of k."""
    ref = reference.agg(F.sort_array(F.collect_list(F.array(F.col("x").cast("double"), F.col("y").cast("double")))).alias("ref"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        m, n = similarity(rows[["x", "y"]].to_numpy(float), np.array([list(p) for p in rows["ref"].iloc[0]]), tolerance)
        if n < least:
            m = np.eye(3)[:2]
        return pd.DataFrame([(key[0], *map(float, m.ravel()), n)], columns=["frame_id", "a00", "a01", "tx", "a10", "a11", "ty", "matched"])

    return stars.select("frame_id", "x", "y").join(F.broadcast(ref)).groupBy("frame_id").applyInPandas(run, "frame_id long, a00 double, a01 double, tx double, a10 double, a11 double, ty double, matched long")


def _refit(a: np.ndarray, b: np.ndarray, start: tuple[complex, complex], tolerance: float) -> tuple[np.ndarray, int]:
    """The similarity fitted to all mutual neighbours within the tolerance of where ``start`` puts the points."""
    za, zb = a[:, 0] + 1j * a[:, 1], b[:, 0] + 1j * b[:, 1]
    (t, o), n = start, 0
    for _ in range(3):
        far = np.abs((t * za + o)[:, None] - zb[None])
        near = far.argmin(1)
        good = np.flatnonzero((far[np.arange(len(za)), near] <= tolerance) & (far.argmin(0)[near] == np.arange(len(za))))
        if len(good) < 2:
            return np.eye(3)[:2], 0
        x, y, n = za[good], zb[near[good]], len(good)
        dx = x - x.mean()
        t = (dx.conj() @ (y - y.mean())) / (dx.conj() @ dx)
        o = y.mean() - t * x.mean()
    return np.array([[t.real, -t.imag, o.real], [t.imag, t.real, o.imag]]), n


def _shapes(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All triangles of the points: the ratios of the two shorter sides to the longest, and the corners in an order that
    any similarity keeps (facing the shortest, the middle, the longest side)."""
    i, j, k = (np.array(c) for c in zip(*combinations(range(len(z)), 3), strict=True))
    corners = np.stack([i, j, k], 1)
    sides = np.abs(np.stack([z[j] - z[k], z[i] - z[k], z[i] - z[j]], 1))  # each facing its corner
    order = sides.argsort(1)
    sides, corners = np.take_along_axis(sides, order, 1), np.take_along_axis(corners, order, 1)
    fit = (sides[:, 0] > 1e-9) & (sides[:, 2] - sides[:, 0] > 0.02 * sides[:, 2])  # nearly equal sides tell no order
    return (sides[:, :2] / np.maximum(sides[:, 2:], 1e-12))[fit], corners[fit]


def triangles(a: np.ndarray, b: np.ndarray, tolerance: float = 3.0, alike: float = 0.01, brightest: int = 15, tries: int = 300) -> tuple[np.ndarray, int]:
    """The 2 x 3 similarity from points a (x, y) to b by triangles of the same shape: the pairs of triangles that agree
    best are tried in turn, and the one that brings most points together is refitted to these. Brightest points first."""
    a, b = a[:brightest], b[:brightest]
    if min(len(a), len(b)) < 3:
        return np.eye(3)[:2], 0
    za, zb = a[:, 0] + 1j * a[:, 1], b[:, 0] + 1j * b[:, 1]
    (sa, ca), (sb, cb) = _shapes(za), _shapes(zb)
    if not len(sa) or not len(sb):
        return np.eye(3)[:2], 0
    off = np.abs(sa[:, None] - sb[None]).max(2)
    i, j = np.nonzero(off <= alike)
    best, most = (1 + 0j, 0j), 0
    for n in np.argsort(off[i, j], kind="stable")[:tries]:
        x, y = za[ca[i[n]]], zb[cb[j[n]]]
        dx = x - x.mean()
        t = (dx.conj() @ (y - y.mean())) / (dx.conj() @ dx)
        o = y.mean() - t * x.mean()
        if np.abs(t * x + o - y).max() > tolerance or not 0.5 <= abs(t) <= 2:
            continue  # mirrored, or of another size
        count = int((np.abs((t * za + o)[:, None] - zb[None]).min(1) <= tolerance).sum())
        if count > most:
            best, most = (t, o), count
            if most >= 0.9 * min(len(a), len(b)):
                break
    return _refit(a, b, best, tolerance) if most >= 3 else (np.eye(3)[:2], 0)


def bilinear(image: np.ndarray, m: np.ndarray, fill: float = np.nan) -> np.ndarray:
    """``image`` read at m @ (x, y, 1) of every pixel."""
    y, x = np.indices(image.shape)
    u, v = (m[k, 0] * x + m[k, 1] * y + m[k, 2] for k in (0, 1))
    inside = (u >= 0) & (v >= 0) & (u <= image.shape[1] - 1) & (v <= image.shape[0] - 1)
    u0, v0 = (np.clip(np.floor(c).astype(int), 0, n - 2) if n > 1 else np.zeros(c.shape, int) for c, n in ((u, image.shape[1]), (v, image.shape[0])))
    fu, fv = u - u0, v - v0
    u1, v1 = np.minimum(u0 + 1, image.shape[1] - 1), np.minimum(v0 + 1, image.shape[0] - 1)
    out = (image[v0, u0] * (1 - fu) + image[v0, u1] * fu) * (1 - fv) + (image[v1, u0] * (1 - fu) + image[v1, u1] * fu) * fv
    return np.where(inside, out, fill)


def ncc(a: np.ndarray, b: np.ndarray) -> float:
    """Correlation where both are known; 0 for a constant image or less than a fifth of the pixels."""
    both = ~np.isnan(a) & ~np.isnan(b)
    if both.sum() < max(2, 0.2 * a.size):
        return 0.0
    a, b = a[both] - a[both].mean(), b[both] - b[both].mean()
    scale = np.sqrt((a @ a) * (b @ b))
    return float(a @ b / scale) if scale > 1e-10 else 0.0


def bright_points(image: np.ndarray, sigmas: float = 3.5, top: int = 20) -> np.ndarray:
    """x, y of the brightest maxima, moved by the parabola through their neighbours; with fewer sigmas if few are found."""
    mid = np.median(image)
    spread = 1.4826 * np.median(np.abs(image - mid))
    inner = image[1:-1, 1:-1]
    peak = np.ones(inner.shape, bool)
    for dy, dx in ((a, b) for a in (0, 1, 2) for b in (0, 1, 2) if (a, b) != (1, 1)):
        peak &= inner > image[dy : dy + inner.shape[0], dx : dx + inner.shape[1]]
    for limit in (sigmas, 2.5):
        y, x = np.nonzero(peak & (inner > mid + limit * spread))
        if len(y) >= max(4, top // 2):
            break
    order = np.argsort(-inner[y, x], kind="stable")[:top]
    y, x = y[order] + 1, x[order] + 1
    bend = lambda l, m, h: np.where(np.abs(l - 2 * m + h) > 1e-12, 0.5 * (l - h) / np.where(np.abs(l - 2 * m + h) > 1e-12, l - 2 * m + h, 1), 0)  # noqa: E731, E741
    return np.stack([x + bend(image[y, x - 1], image[y, x], image[y, x + 1]), y + bend(image[y - 1, x], image[y, x], image[y + 1, x])], 1).astype(float)


def _by_shift(image: np.ndarray, reference: np.ndarray) -> np.ndarray:
    dy, dx, _ = phase_shift(image, reference)
    return np.array([[1.0, 0.0, dx], [0.0, 1.0, dy]])


CASCADE = {  # each gives the map from reference pixels to the frame's
    "stars": lambda image, ref: similarity(bright_points(ref), bright_points(image))[0],
    "triangles": lambda image, ref: triangles(bright_points(ref), bright_points(image))[0],
    "shift": _by_shift,
}


def register(image: np.ndarray, reference: np.ndarray, methods: tuple[str, ...] = tuple(CASCADE), gain: float = 0.01) -> tuple[str, np.ndarray, float]:
    """The first method whose warp correlates at least ``gain`` better than no warp, its warp and the correlation; else the identity."""
    still = ncc(image, reference)
    for name in methods:
        m = CASCADE[name](image, reference)
        cc = ncc(bilinear(image, m), reference)
        if cc >= still + gain:
            return name, m, cc
    return "identity", np.eye(3)[:2], still


def cascade(px: DataFrame, reference: int, methods: tuple[str, ...] = tuple(CASCADE)) -> DataFrame:
    """frame_id, method, a00 .. ty, cc of each frame against the reference; a task holds one (down-sampled) frame."""
    ref = px.where(F.col("frame_id") == reference).select("y", "x", F.col("v").alias("ref"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a, b = np.full((2, int(rows["y"].max()) + 1, int(rows["x"].max()) + 1), np.nan)
        a[rows["y"], rows["x"]], b[rows["y"], rows["x"]] = rows["v"], rows["ref"]
        a, b = (np.where(np.isnan(m), np.nanmedian(m), m) for m in (a, b))
        name, m, cc = register(a, b, methods)
        return pd.DataFrame([(key[0], name, *map(float, m.ravel()), cc)], columns=["frame_id", "method", "a00", "a01", "tx", "a10", "a11", "ty", "cc"])

    return px.join(ref, ["y", "x"]).groupBy("frame_id").applyInPandas(run, "frame_id long, method string, a00 double, a01 double, tx double, a10 double, a11 double, ty double, cc double")


def local_value(t: np.ndarray, values: np.ndarray, cc: np.ndarray, at: float, k: int) -> tuple[np.ndarray, float]:
    """Columns of ``values`` at time ``at`` from a weighted polynomial through the ``k`` nearest times, and its score
    (largest misses in units of the columns' own tolerances, plus a twentieth of the span); lower is better."""
    near = np.sort(np.argsort(np.abs(t - at), kind="stable")[:k])
    span = max(float(np.abs(t[near] - at).max()), 1.0)
    x = (t[near] - at) / span
    w = np.maximum(1e-3, np.maximum(0, 1 - np.abs(x) ** 3) ** 3 * np.maximum(0.05, cc[near]))
    design = np.vander(x, 1 + (2 if len(near) >= 5 else 1 if len(near) >= 2 else 0), increasing=True)
    root = np.sqrt(w)[:, None]
    c = np.linalg.lstsq(design * root, values[near] * root, rcond=None)[0]
    misses = np.abs(values[near] - design @ c).max(0)
    return c[0], float(misses @ np.array([1 / np.radians(0.35), 1 / 20, 1 / 20]) + 0.05 * span)


def fill_warps(warps: DataFrame, supports: tuple[int, ...] = (6, 8, 12, 16, 24, 32, 48)) -> DataFrame:
    """warps(run_id, frame_id, angle, tx, ty, cc) with the unknown ones (angle null) predicted, cc 0.0001 there.

    The best-scored support is taken; with fewer known frames than the least support all known ones are used, and with
    fewer than three the nearest is copied. A run has a row a frame, and a task holds one run's rows. A run with no
    known frame keeps its nulls."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame_id").reset_index(drop=True)
        known = rows["angle"].notna().to_numpy()
        t = rows["frame_id"].to_numpy(float)
        values = rows[["angle", "tx", "ty"]].to_numpy(float)
        fixed = values[known].copy()
        fixed[:, 0] = np.unwrap(fixed[:, 0])
        cc = rows["cc"].fillna(0.0).to_numpy(float)[known]
        for i in np.flatnonzero(~known) if known.any() else ():
            if len(fixed) < 3:
                values[i] = fixed[np.abs(t[known] - t[i]).argmin()]
                continue
            sizes = [k for k in supports if k <= len(fixed)] or [len(fixed)]
            values[i] = min((local_value(t[known], fixed, cc, t[i], k) for k in sizes), key=lambda r: r[1])[0]
        rows[["angle", "tx", "ty"]] = values
        rows.loc[~known, "cc"] = 1e-4 if known.any() else None
        return rows.assign(predicted=~known)

    schema = "run_id long, frame_id long, angle double, tx double, ty double, cc double, predicted boolean"
    return warps.selectExpr("cast(run_id as long) run_id", "cast(frame_id as long) frame_id", "angle", "tx", "ty", "cc").groupBy("run_id").applyInPandas(run, schema)
