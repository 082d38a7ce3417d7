"""Stencil kernels on blocks of a frame, each with the rim of pixels that its kernel looks at.

A pixel goes to its block and, near an edge, to the neighbours: one shuffle of little more than the pixels, and a task
holds a block of bounded size, however large the frames are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions.robust import MAD_TO_SIGMA
from starloom.operators.groups import in_groups, medians

BLOCK = 512
AROUND = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
CROSS = [(-1, 0), (0, -1), (0, 1), (1, 0)]


CELLS = 500_000  # cells of the arrays that a kernel sees at once; a block alone may have more


def stacked(y: np.ndarray, x: np.ndarray, starts: np.ndarray, run: Callable[[slice, np.ndarray, np.ndarray, np.ndarray, tuple[int, int, int]], None]) -> None:
    """Groups of places as layers of arrays just large enough: ``run(rows, layer, y, x, shape)`` for as many groups as
    fit into CELLS, with each row's layer and place in it."""
    if len(starts) < 2:
        return
    low = lambda c: np.repeat(np.minimum.reduceat(c, starts[:-1]), np.diff(starts))
    dy, dx = y - low(y), x - low(x)

    def part(i: int, j: int) -> None:
        rows = slice(starts[i], starts[j])
        h, w = int(dy[rows].max()) + 1, int(dx[rows].max()) + 1
        if (j - i) * h * w > CELLS and j - i > 1:
            part(i, (i + j) // 2)
            part((i + j) // 2, j)
        else:
            run(rows, np.repeat(np.arange(j - i), np.diff(starts[i : j + 1])), dy[rows], dx[rows], (j - i, h, w))

    part(0, len(starts) - 1)


def on_blocks(px: DataFrame, kernel: Callable[..., dict[str, np.ndarray]], halo: int, out: str, block: int = BLOCK, planes: tuple[str, ...] = ("v",)) -> DataFrame:
    """frame_id, y, x and the columns of ``out`` (DDL, doubles) for each pixel of px.

    ``kernel(values, first, y0, x0)`` sees many blocks as layers of one array: values with NaN where no pixel is, cut to
    where pixels are, the blocks' first rows (for columns that hold for a whole frame) and the places of values[i, 0, 0],
    both as (layers, 1, 1) arrays; it returns arrays of the same shape as values. With several ``planes`` (columns of
    values) these are the first axis of values, and only of it."""
    cells = lambda c: F.explode(F.sequence(F.greatest(F.floor((F.col(c) - halo) / block), F.lit(0)), F.floor((F.col(c) + halo) / block)))
    names = [c.split()[0] for c in out.split(",")]
    more = [c for c in px.columns if c not in ("frame_id", "y", "x", *planes)]

    def run(cols: dict[str, np.ndarray], starts: np.ndarray) -> dict[str, np.ndarray]:
        y, x = cols["y"], cols["x"]
        own = (y // block == cols["__by"]) & (x // block == cols["__bx"])
        live = np.logical_or.reduceat(own, starts[:-1])  # the others are rims of blocks without a pixel
        if not live.all():
            rows = np.repeat(live, np.diff(starts))
            starts = np.concatenate([[0], np.cumsum(np.diff(starts)[live])])
            cols, own = {c: v[rows] for c, v in cols.items()}, own[rows]
            y, x = cols["y"], cols["x"]
        found = {c: np.full(len(y), np.nan) for c in names}

        def layers(rows: slice, layer: np.ndarray, i: np.ndarray, j: np.ndarray, shape: tuple[int, int, int]) -> None:
            values = np.full((len(planes), *shape), np.nan)
            for k, c in enumerate(planes):
                values[k, layer, i, j] = cols[c][rows]
            head = rows.start + np.searchsorted(layer, np.arange(shape[0]))
            wide = lambda a: a[:, None, None]
            got = kernel(values if len(planes) > 1 else values[0], {c: wide(cols[c][head]) for c in more}, wide(y[head] - i[head - rows.start]), wide(x[head] - j[head - rows.start]))
            for c in names:
                found[c][rows] = got[c][layer, i, j]

        stacked(y, x, starts, layers)
        return {"frame_id": cols["frame_id"][own], "y": y[own], "x": x[own]} | {c: found[c][own] for c in names}

    dealt = px.withColumn("__by", cells("y")).withColumn("__bx", cells("x")).select("frame_id", "__by", "__bx", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), *(F.col(c).cast("double").alias(c) for c in planes), *more)
    return in_groups(dealt, ["frame_id", "__by", "__bx"], run, f"frame_id long, y long, x long, {out}")


def with_sigma(px: DataFrame) -> DataFrame:
    """px with m and s, its frame's median and MAD sigma."""
    w = Window.partitionBy("frame_id")
    return px.withColumn("m", F.median("v").over(w)).withColumn("s", F.median(F.abs(F.col("v") - F.col("m"))).over(w) * MAD_TO_SIGMA)


def near(a: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """For each place the value ``dy`` below and ``dx`` right of it; NaN outside. The last two axes are y and x."""
    out = np.full(a.shape, np.nan)
    h, w = a.shape[-2:]
    if abs(dy) < h and abs(dx) < w:
        out[..., max(-dy, 0) : h - max(dy, 0), max(-dx, 0) : w - max(dx, 0)] = a[..., max(dy, 0) : h - max(-dy, 0), max(dx, 0) : w - max(-dx, 0)]
    return out


def mean_of(parts: list[np.ndarray]) -> np.ndarray:
    """Mean of what is there; NaN where nothing is."""
    total, n = np.zeros(parts[0].shape), np.zeros(parts[0].shape)
    for p in parts:
        good = ~np.isnan(p)
        total[good] += p[good]
        n += good
    return np.divide(total, n, out=np.full(total.shape, np.nan), where=n > 0)


def box_mean(a: np.ndarray, r: int) -> np.ndarray:
    """Mean of the valid values of a square of 2r + 1, by sums along both axes in turn."""
    def sums(b: np.ndarray) -> np.ndarray:
        for axis in (b.ndim - 2, b.ndim - 1):
            wide = np.pad(b, [(r + 1, r) if i == axis else (0, 0) for i in range(b.ndim)]).cumsum(axis)
            n = b.shape[axis]
            b = np.take(wide, range(2 * r + 1, 2 * r + 1 + n), axis) - np.take(wide, range(n), axis)
        return b

    n = sums((~np.isnan(a)).astype(float))
    return np.divide(sums(np.nan_to_num(a)), n, out=np.full(a.shape, np.nan), where=n > 0)


def disk(r: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx <= r * r]


def dilate(mask: np.ndarray, r: int) -> np.ndarray:
    return np.any([near(mask.astype(float), dy, dx) > 0 for dy, dx in disk(r)], axis=0)


def background_mask(px: DataFrame, sigmas: float = 3.0, r: int = 3, block: int = BLOCK) -> DataFrame:
    """background is 1 where no pixel within r is further than ``sigmas`` from the median; all, if the spread is 0."""
    def kernel(a, first, y0, x0):
        far = (first["s"] > 0) & (np.abs(a - first["m"]) > sigmas * first["s"])
        return {"background": 1.0 - dilate(far, r)}

    return on_blocks(with_sigma(px), kernel, r, "background double", block)


def cosmetic(px: DataFrame, sigmas: float = 5.0, block: int = BLOCK) -> DataFrame:
    """A hot pixel with at most one hot neighbour takes the mean of the pixels two away (of its own colour in a mosaic)."""
    def kernel(a, first, y0, x0):
        hot = a > first["m"] + sigmas * first["s"]
        beside = sum(np.nan_to_num(near(hot.astype(float), *d)) for d in AROUND)
        mean = mean_of([near(a, 2 * dy, 2 * dx) for dy, dx in CROSS])
        return {"v": np.where(hot & (beside <= 1) & ~np.isnan(mean), mean, a)}

    return on_blocks(with_sigma(px), kernel, 2, "v double", block)


# fixed values: colours of a 2 x 2 cell, row by row
PATTERNS = ("RGGB", "BGGR", "GRBG", "GBRG")


def debayer(px: DataFrame, pattern: str = "RGGB", block: int = BLOCK) -> DataFrame:
    """r, g, b: a pixel's own colour as it is, the others as means of the neighbours that have them."""
    if pattern not in PATTERNS:
        raise ValueError(f"unknown pattern {pattern}")

    def kernel(a, first, y0, x0):
        cell = (np.arange(a.shape[1])[:, None] + y0) % 2 * 2 + (np.arange(a.shape[2]) + x0) % 2
        out = {}
        for c in "RGB":
            own = np.isin(cell, [i for i in range(4) if pattern[i] == c])
            known = np.where(own, a, np.nan)
            out[c.lower()] = np.where(own, a, mean_of([near(known, *d) for d in AROUND]))
        return out

    return on_blocks(px, kernel, 1, "r double, g double, b double", block)


def box_blur(px: DataFrame, r: int = 2, block: int = BLOCK) -> DataFrame:
    return on_blocks(px, lambda a, *_: {"v": box_mean(a, r)}, r, "v double", block)


def derivatives(px: DataFrame, block: int = BLOCK) -> DataFrame:
    """v as it is; sobel2: squared Sobel gradient, a missing neighbour counting as the pixel itself; laplacian: null at an edge."""
    def kernel(a, *_):
        at = {d: np.where(np.isnan(n := near(a, *d)), a, n) for d in AROUND}
        gx = at[-1, 1] + 2 * at[0, 1] + at[1, 1] - at[-1, -1] - 2 * at[0, -1] - at[1, -1]
        gy = at[1, -1] + 2 * at[1, 0] + at[1, 1] - at[-1, -1] - 2 * at[-1, 0] - at[-1, 1]
        return {"v": a, "sobel2": gx * gx + gy * gy, "laplacian": sum(near(a, *d) for d in CROSS) - 4 * a}

    return on_blocks(px, kernel, 1, "v double, sobel2 double, laplacian double", block)


def components(px: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """frame_id, y, x (first pixel) and n of each 8-connected region above median + sigmas * sigma.

    Only pixels above the threshold travel; labels are shared along pairs of neighbours, with shortcuts."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        y, x = rows["y"].to_numpy(), rows["x"].to_numpy()
        wide = int(x.max()) + 3
        code = np.sort((y + 1) * wide + x + 1)
        root = np.arange(len(code))
        pairs = []
        for step in (1, wide - 1, wide, wide + 1):
            at = np.minimum(np.searchsorted(code, code + step), len(code) - 1)
            has = np.flatnonzero(code[at] == code + step)
            pairs.append(np.stack([has, at[has]]))
        a, b = np.concatenate(pairs, axis=1)
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, root[a], low)
            np.minimum.at(new, root[b], low)
            while (new[new] != new).any():
                new = new[new]
            if (new == root).all():
                break
            root = new
        heads, n = np.unique(root, return_counts=True)
        return pd.DataFrame({"frame_id": key[0], "y": code[heads] // wide - 1, "x": code[heads] % wide - 1, "n": n})

    return with_sigma(px).where(F.col("v") > F.col("m") + sigmas * F.col("s")).groupBy("frame_id").applyInPandas(run, "frame_id long, y long, x long, n long")


def warp(px: DataFrame, warps: DataFrame, height: int, width: int, block: int = BLOCK) -> DataFrame:
    """Frames sampled at A (x, y) + t for each place (x, y) of a canvas, bilinearly; outside a frame is 0.

    warps(frame_id, a00, a01, tx, a10, a11, ty) has a row a frame. A source pixel goes to the block of the canvas where
    it lands, and to those within its reach; a row for each block and frame stands for the places that no pixel reaches."""
    det = F.col("a00") * F.col("a11") - F.col("a01") * F.col("a10")
    dx, dy = F.col("x") - F.col("tx"), F.col("y") - F.col("ty")
    reach = 1.5 * (F.abs("a00") + F.abs("a01") + F.abs("a10") + F.abs("a11")) / F.abs(det) + 1
    lands = px.join(warps, "frame_id").withColumn("__x", (F.col("a11") * dx - F.col("a01") * dy) / det).withColumn("__y", (F.col("a00") * dy - F.col("a10") * dx) / det).withColumn("__r", reach)
    blocks = lambda c, size: F.explode(F.sequence(F.floor(F.greatest(F.col(c) - F.col("__r"), F.lit(0.0)) / block), F.floor(F.least(F.col(c) + F.col("__r"), F.lit(size - 1.0)) / block)))
    inside = lands.where(F.col("__x").between(-F.col("__r"), width - 1 + F.col("__r")) & F.col("__y").between(-F.col("__r"), height - 1 + F.col("__r")))
    dealt = inside.withColumn("__by", blocks("__y", height)).withColumn("__bx", blocks("__x", width))

    empty = px.select("frame_id").distinct().join(warps, "frame_id").withColumn("__by", F.explode(F.sequence(F.lit(0), F.lit((height - 1) // block)))).withColumn("__bx", F.explode(F.sequence(F.lit(0), F.lit((width - 1) // block))))
    six = ("a00", "a01", "tx", "a10", "a11", "ty")
    columns = lambda df, y, x, v, real: df.select("frame_id", F.col("__by").cast("long").alias("__by"), F.col("__bx").cast("long").alias("__bx"), y.cast("long").alias("y"), x.cast("long").alias("x"), v.cast("double").alias("v"), F.lit(real).alias("real"), *(F.col(c).cast("double").alias(c) for c in six))
    rows = columns(dealt, F.col("y"), F.col("x"), F.col("v"), 1).unionByName(columns(empty, F.lit(0), F.lit(0), F.lit(0.0), 0))

    def run(cols: dict[str, np.ndarray], starts: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
        gy, gx = (g.ravel() for g in np.mgrid[0 : min(block, height), 0 : min(block, width)])
        step = max(1, CELLS // len(gy))
        for i in range(0, len(starts) - 1, step):
            yield sampled({c: v[starts[i] : starts[min(i + step, len(starts) - 1)]] for c, v in cols.items()}, starts[i : i + step + 1] - starts[i], gy, gx)

    def sampled(cols: dict[str, np.ndarray], starts: np.ndarray, gy: np.ndarray, gx: np.ndarray) -> dict[str, np.ndarray]:
        first, n = starts[:-1], len(starts) - 1
        m = {c: cols[c][first, None] for c in six}
        y, x = cols["__by"][first, None] * block + gy, cols["__bx"][first, None] * block + gx
        sx, sy = m["a00"] * x + m["a01"] * y + m["tx"], m["a10"] * x + m["a11"] * y + m["ty"]
        fx, fy = np.floor(sx).astype(int), np.floor(sy).astype(int)
        v = np.zeros(x.shape)
        real = cols["real"] == 1
        if real.any():
            group = np.repeat(np.arange(n), np.diff(starts))[real]
            ends = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=n))])
            live = np.flatnonzero(np.diff(ends))
            inner = np.concatenate([ends[live], ends[-1:]])
            ys, xs, vs = (cols[c][real] for c in ("y", "x", "v"))

            def layers(rows: slice, layer: np.ndarray, i: np.ndarray, j: np.ndarray, shape: tuple[int, int, int]) -> None:
                a = np.zeros(shape)
                a[layer, i, j] = vs[rows]
                head = np.searchsorted(layer, np.arange(shape[0]))
                at = group[rows][head]
                y0, x0 = (ys[rows][head] - i[head])[:, None], (xs[rows][head] - j[head])[:, None]
                k = np.arange(shape[0])[:, None]
                for dj in (0, 1):
                    for di in (0, 1):
                        r, c = fy[at] + dj - y0, fx[at] + di - x0
                        good = (r >= 0) & (r < shape[1]) & (c >= 0) & (c < shape[2])
                        w = np.where(di, sx[at] - fx[at], 1 - (sx[at] - fx[at])) * np.where(dj, sy[at] - fy[at], 1 - (sy[at] - fy[at]))
                        v[at] += np.where(good, w * a[k, np.where(good, r, 0), np.where(good, c, 0)], 0.0)

            stacked(ys, xs, inner, layers)
        inside = (y < height) & (x < width)
        return {"frame_id": np.broadcast_to(cols["frame_id"][first, None], y.shape)[inside], "y": y[inside], "x": x[inside], "v": v[inside]}

    return in_groups(rows, ["frame_id", "__by", "__bx"], run, "frame_id long, y long, x long, v double")


def warp_mosaic(px: DataFrame, warps: DataFrame, height: int, width: int, block: int = BLOCK) -> DataFrame:
    """:func:`warp` for mosaics: each of the four planes of a 2 x 2 cell is sampled on its own, so colours never mix."""
    plane = F.col("y") % 2 * 2 + F.col("x") % 2
    planes = px.select((F.col("frame_id") * 4 + plane).alias("frame_id"), F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x"), "v")
    four = warps.withColumn("p", F.explode(F.array(*map(F.lit, range(4))))).withColumns({"oy": F.floor(F.col("p") / 2), "ox": F.col("p") % 2})
    shift = lambda a, b, t, o: (F.col(a) * F.col("ox") + F.col(b) * F.col("oy") + F.col(t) - F.col(o)) / 2
    four = four.select((F.col("frame_id") * 4 + F.col("p")).alias("frame_id"), "a00", "a01", shift("a00", "a01", "tx", "ox").alias("tx"), "a10", "a11", shift("a10", "a11", "ty", "oy").alias("ty"))
    out = warp(planes, four, (height + 1) // 2, (width + 1) // 2, max(block // 2, 1))
    p = F.col("frame_id") % 4
    return out.select(F.floor(F.col("frame_id") / 4).alias("frame_id"), (F.col("y") * 2 + F.floor(p / 2)).alias("y"), (F.col("x") * 2 + p % 2).alias("x"), "v").where((F.col("y") < height) & (F.col("x") < width))


def soft_threshold(tile: np.ndarray, alpha: float = 1.5, r: int = 15) -> np.ndarray:
    """A tile's difference from its box mean, shrunk by alpha sigmas (upper median); zeros stay. Leading axes are tiles."""
    upper = lambda a: np.sort(a.reshape(*a.shape[:-2], -1), -1)[..., a.shape[-1] * a.shape[-2] // 2, None, None]
    rest = tile - (back := box_mean(tile, r))
    far = upper(np.abs(rest - upper(rest)))
    shrunk = np.sign(rest) * np.maximum(np.abs(rest) - alpha * MAD_TO_SIGMA * far, 0)
    return np.where(tile == 0, 0.0, back + shrunk)


def wiener(tile: np.ndarray, sigma: float) -> np.ndarray:
    """A tile, mirrored at its edges by a quarter of its height, filtered by (P - sigma^2) / P in frequency. Leading axes
    are tiles."""
    h, w = tile.shape[-2:]
    pad = min(max(h // 4, 1), min(h, w) - 1)
    wide = np.pad(tile, [(0, 0)] * (tile.ndim - 2) + [(pad, pad)] * 2, "reflect")
    f = np.fft.rfft2(wide)
    power = np.abs(f) ** 2 / (wide.shape[-1] * wide.shape[-2])
    back = np.fft.irfft2(f * np.maximum(power - sigma**2, 0) / (power + 1e-12), wide.shape[-2:])
    return back[..., pad : pad + h, pad : pad + w]


def by_shape(y: np.ndarray, x: np.ndarray, v: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of pixels as whole tiles, those of one shape together: the groups, their rows, each row's layer and place
    in it, and the tiles, whose holes hold their median."""
    head, n = starts[:-1], np.diff(starts)
    y0, x0 = np.minimum.reduceat(y, head), np.minimum.reduceat(x, head)
    h, w = np.maximum.reduceat(y, head) - y0 + 1, np.maximum.reduceat(x, head) - x0 + 1
    mid = medians(v, starts)
    for shape in sorted(set(zip(h.tolist(), w.tolist(), strict=True))):
        groups = np.flatnonzero((h == shape[0]) & (w == shape[1]))
        for some in np.array_split(groups, -(-len(groups) * shape[0] * shape[1] // CELLS)):
            if not len(some):
                continue
            layer = np.repeat(np.arange(len(some)), n[some])
            rows = np.arange(len(layer)) + np.repeat(head[some] - np.concatenate([[0], np.cumsum(n[some])[:-1]]), n[some])
            i, j = y[rows] - y0[some][layer], x[rows] - x0[some][layer]
            a = np.repeat(mid[some], shape[0] * shape[1]).reshape(-1, *shape)
            a[layer, i, j] = v[rows]
            yield some, rows, layer, i, j, a


def on_tiles(tiles: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], *more: Column) -> DataFrame:
    """A kernel over whole tiles of (frame_id, trow, tcol), as layers of one array; holes take the tile's median."""
    def run(cols: dict[str, np.ndarray], starts: np.ndarray) -> dict[str, np.ndarray]:
        out = np.empty(len(cols["v"]))
        for _, rows, layer, i, j, a in by_shape(cols["y"], cols["x"], cols["v"], starts):
            out[rows] = kernel(a)[layer, i, j]
        return {c: cols[c] for c in ("frame_id", "trow", "tcol", "y", "x")} | {"v": out}

    keys = ["frame_id", "trow", "tcol", *(f"__k{i}" for i in range(len(more)))]
    flat = tiles.select("frame_id", F.col("trow").cast("int").alias("trow"), F.col("tcol").cast("int").alias("tcol"), *(c.alias(f"__k{i}") for i, c in enumerate(more)), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("v").cast("double").alias("v"))
    return in_groups(flat, keys, run, "frame_id long, trow int, tcol int, y long, x long, v double")


def chroma_denoise(rgb: DataFrame, strength: float = 0.7, r: int = 2, protect: float = 0.9, rounds: int = 1, block: int = BLOCK) -> DataFrame:
    """rgb(frame_id, y, x, r, g, b) with its colour differences drawn towards their box means; luma stays as it is.

    Pixels above the frame's ``protect`` quantile of luma (stars) keep their colours."""
    luma = 0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")
    df = rgb.withColumn("luma", luma).withColumns({"cb": F.col("b") - F.col("luma"), "cr": F.col("r") - F.col("luma")})
    df = df.select("frame_id", "y", "x", "luma", "cb", "cr")
    keep, smooth = ("luma", "cb", "cr"), ("sb", "sr")
    for i in range(rounds):
        planes = (*keep, *smooth) if i else keep

        def kernel(a, *_, planes=planes):
            return dict(zip(keep, a, strict=False)) | dict(zip(smooth, box_mean(a[-2:], r), strict=True))

        df = on_blocks(df, kernel, r, ", ".join(f"{c} double" for c in (*keep, *smooth)), block, planes)
    limit = F.percentile("luma", protect).over(Window.partitionBy("frame_id"))
    df = df.withColumn("limit", limit).withColumn("k", F.when(F.col("luma") <= F.col("limit"), strength).otherwise(0.0))
    cb, cr = (F.col(c) + F.col("k") * (F.col(s) - F.col(c)) for c, s in (("cb", "sb"), ("cr", "sr")))
    red, blue = F.col("luma") + cr, F.col("luma") + cb
    return df.select("frame_id", "y", "x", red.alias("r"), ((F.col("luma") - 0.299 * red - 0.114 * blue) / 0.587).alias("g"), blue.alias("b"))
