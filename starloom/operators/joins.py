"""Joins by nearness, time and sky position, written with equi keys."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from starloom.functions.robust import haversine_squared


def asof_starts(events: DataFrame, start: str, end: str, key: str = "user_id") -> DataFrame:
    """Each ``end`` event with the latest ``start`` event of its key at or before it: one window, no join."""
    order = Window.partitionBy(key).orderBy("ts", F.when(F.col("event_type") == start, 0).otherwise(1), "event_id")
    started = F.last(F.when(F.col("event_type") == start, F.col("ts")), ignorenulls=True).over(order)
    out = events.where(F.col("event_type").isin(start, end)).withColumn("start_ts", started).where(F.col("event_type") == end)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return out.select(key, "event_id", (micros("ts") - micros("start_ts")).alias("micros"))


MEMBERS = 1024  # rows of one place that a list holds at most, about


def _lists(df: DataFrame, place: list[str], name: str) -> DataFrame:
    """place, name: the other columns of df's rows of one place as lists of about MEMBERS, so a place met by many rows is
    in several."""
    rest = F.struct(*(c for c in df.columns if c not in place))
    n = df.groupBy(*place).agg(F.count("*").alias("__n"))
    part = F.pmod(F.xxhash64(rest), F.ceil(F.col("__n") / MEMBERS)).alias("__part")
    return df.join(n, place).select(*place, part, rest.alias("__row")).groupBy(*place, "__part").agg(F.collect_list("__row").alias(name)).drop("__part")


def _pairs(lists: DataFrame) -> DataFrame:
    """Every row of the list a beside every row of b. Only lists are dealt out, evenly; the pairs are made where they are used."""
    n = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lists.repartition(n)
    return dealt.withColumn("__a", F.explode("a")).withColumn("__b", F.explode("b"))


def band_join(left: DataFrame, right: DataFrame, value: str, width: float) -> DataFrame:
    """Pairs whose values differ by at most ``width``: buckets of distinct values, and the two neighbours of each; then
    the rows that have them."""
    bucket = F.floor(F.col(value) / width)
    a = _lists(left, [value], "a").withColumn("bucket", bucket)
    b = _lists(right, [value], "b").withColumn("bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1))).withColumnRenamed(value, f"{value}_r")
    near = a.join(b, "bucket").where(F.abs(F.col(value) - F.col(f"{value}_r")) <= width)
    others = lambda df: [c for c in df.columns if c != value]
    return _pairs(near).select(value, *(F.col("__a")[c].alias(c) for c in others(left)), f"{value}_r", *(F.col("__b")[c].alias("id_r" if c == "id" else c) for c in others(right)))


def cone_search(stars: DataFrame, centres: DataFrame, radius: float) -> DataFrame:
    """Stars within ``radius`` degrees of centres: cells of declination and right ascension as equi keys, then the exact
    test, between distinct places; then the rows that have them.

    A band of declination is ``radius`` high and cut into as many cells as are at least as wide as the furthest that a
    star in it can be from a centre; near a pole that is one."""
    limit = math.sin(math.radians(radius) / 2) ** 2
    band = lambda c: F.floor(F.col(c) / radius)
    edge = F.least(F.greatest(F.abs(F.col("band") * radius), F.abs((F.col("band") + 1) * radius)) + radius, F.lit(90.0))
    wide = 2 * F.asin(F.least(math.sin(math.radians(radius) / 2) / F.greatest(F.cos(F.radians(edge)), F.lit(1e-9)), F.lit(1.0))) * (1 + 1e-9)
    n = F.floor(2 * math.pi / wide)
    cells = F.when(n < 3, 1).otherwise(n)
    cell = lambda ra, shift: F.pmod(F.floor(F.pmod(F.col(ra), F.lit(360.0)) / 360 * F.col("cells")) + shift, F.col("cells"))
    s = _lists(stars.select("id", "ra", "dec"), ["ra", "dec"], "a").withColumn("band", band("dec")).withColumn("cells", cells).withColumn("cell", cell("ra", 0))
    c = _lists(centres.select("id", "ra", "dec"), ["ra", "dec"], "b").select(F.col("ra").alias("ra0"), F.col("dec").alias("dec0"), "b")
    c = c.withColumn("band", F.explode(F.array(band("dec0") - 1, band("dec0"), band("dec0") + 1))).withColumn("cells", cells)
    c = c.withColumn("cell", F.explode(F.array_distinct(F.array(*(cell("ra0", k) for k in (-1, 0, 1)))))).drop("cells")
    near = s.drop("cells").join(c, ["band", "cell"]).where(haversine_squared(F.col("ra0"), F.col("dec0"), F.col("ra"), F.col("dec")) <= limit)
    return _pairs(near).select(F.col("__b")["id"].alias("centre_id"), F.col("__a")["id"].alias("id"))


def nearest_cells(cells: DataFrame, *key: str) -> DataFrame:
    """cells(*key, cy, cx, v), ``key`` telling images apart: a null cell takes the value of the nearest valid one, ties to the smaller (cy, cx).

    The grid is coarse (a few hundred cells, whatever the images), so an image's valid cells travel in one array; nothing
    of the pixels does."""
    valid = cells.where("v is not null").groupBy(*key).agg(F.collect_list(F.struct("cy", "cx", "v")).alias("valid"))
    near = F.array_min(F.transform("valid", lambda s: F.struct(((s.cy - F.col("cy")) * (s.cy - F.col("cy")) + (s.cx - F.col("cx")) * (s.cx - F.col("cx"))).alias("d2"), s.cy.alias("cy"), s.cx.alias("cx"), s.v.alias("v"))))
    both = cells.join(valid, list(key), "left") if key else cells.join(F.broadcast(valid))
    return both.select(*key, "cy", "cx", F.coalesce("v", near.v).alias("v"))


def bridge(series: DataFrame, value: str, order: str, *keys: str) -> DataFrame:
    """Nulls bridged linearly between the neighbours in time; at the ends the nearest value is copied."""
    back = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    t = F.when(F.col(value).isNotNull(), F.col(order))
    df = series.withColumn("v0", F.last(value, True).over(back)).withColumn("t0", F.last(t, True).over(back)).withColumn("v1", F.first(value, True).over(ahead)).withColumn("t1", F.first(t, True).over(ahead))
    line = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col(order) - F.col("t0")) / (F.col("t1") - F.col("t0"))
    return df.withColumn("filled", F.coalesce(F.col(value), line, "v0", "v1")).drop("v0", "v1", "t0", "t1")


SLOPES = 1_000_000  # slopes of a group that are held at once


def _siegel(x: np.ndarray, y: np.ndarray) -> float | None:
    """Median over points of the median slope to the points with another x; None without any."""
    inner = []
    step = max(1, SLOPES // len(x))
    with np.errstate(divide="ignore", invalid="ignore"):
        for i in range(0, len(x), step):
            dx = x - x[i : i + step, None]
            s = np.where(dx != 0, (y - y[i : i + step, None]) / dx, np.nan)  # NaN: last in order
            s.sort(1)
            n = np.count_nonzero(dx, 1)
            rows = np.flatnonzero(n)
            inner.append((s[rows, (n[rows] - 1) // 2] + s[rows, n[rows] // 2]) / 2)
    inner = np.concatenate(inner)
    return float(np.median(inner)) if len(inner) else None


def repeated_median(points: DataFrame, key: str) -> DataFrame:
    """Siegel's line: the median over points of the median slope to the others. All pairs of a group are looked at, in
    parts of bounded size inside its task; what travels is the points."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x, y = b.column("p").offsets.to_numpy(), *(b.column("p").flatten().field(c).to_numpy(zero_copy_only=False) for c in "xy")
            at = at - at[0]
            slopes = [_siegel(x[i:j], y[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(slopes, pa.float64())], [key, "slope"])

    lists = points.where("x is not null and y is not null").groupBy(key).agg(F.collect_list(F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))).alias("p"))
    slope = lists.mapInArrow(run, StructType([points.schema[key], StructField("slope", DoubleType())])).where("slope is not null")
    return points.join(slope, key).groupBy(key).agg(F.first("slope").alias("slope"), F.median(F.col("y") - F.col("slope") * F.col("x")).alias("intercept"))


def around(points: DataFrame, px: DataFrame, r: int) -> DataFrame:
    """points(frame_id, py, px_, ...) with every pixel at most ``r`` away on both axes (dy, dx, v): an equi join on exploded places."""
    steps = F.sequence(F.lit(-r), F.lit(r))
    at = points.withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps)).withColumn("y", F.col("py") + F.col("dy")).withColumn("x", F.col("px_") + F.col("dx"))
    return at.join(px, ["frame_id", "y", "x"])


def aperture_flux(stars: DataFrame, px: DataFrame, r: float, inner: float, outer: float, least: int) -> DataFrame:
    """sky: median of the annulus (stars with fewer than ``least`` pixels there go); flux: sum of v - sky within ``r``."""
    near = around(stars, px, math.ceil(max(r, outer))).withColumn("d", F.sqrt((F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")).cast("double")))
    ring, disk = F.col("d").between(inner, outer), F.when(F.col("d") <= r, F.col("v"))
    found = near.groupBy("frame_id", "rank").agg(F.median(F.when(ring, F.col("v"))).alias("sky"), F.count_if(ring).alias("n"), F.sum(disk).alias("s"), F.count(disk).alias("k"))
    return found.where(F.col("n") >= least).select("frame_id", "rank", F.round("sky", 6).alias("sky"), F.round(F.col("s") - F.col("k") * F.col("sky"), 3).alias("flux"))


def ring_fill(cells: DataFrame, least: int) -> DataFrame:
    """A null cell takes the median of the valid ones in square rings around it, as many rings as hold ``least`` of them.

    As in nearest_cells, the coarse grid's valid cells travel in one array of bounded size."""
    valid = cells.where("v is not null").agg(F.collect_list(F.struct("cy", "cx", "v")).alias("valid"))
    ring = lambda c: F.greatest(F.abs(c.cy - F.col("cy")), F.abs(c.cx - F.col("cx")))
    df = cells.join(F.broadcast(valid)).withColumn("reach", F.get(F.array_sort(F.transform("valid", ring)), F.least(F.lit(least), F.size("valid")) - 1))
    df = df.withColumn("near", F.array_sort(F.transform(F.filter("valid", lambda c: ring(c) <= F.col("reach")), lambda c: c.v)))
    mid = F.size("near") / 2
    both = (F.get("near", F.ceil(mid - 1).cast("int")) + F.get("near", F.floor(mid).cast("int"))) / 2
    return df.select("cy", "cx", F.round(F.coalesce("v", both), 6).alias("v"))


def overlapping(boxes: DataFrame, cell: int) -> DataFrame:
    """(lhs, rhs) of all boxes(tile, x, y, w, h) that share area, lhs < rhs: an equi join on the cells that they touch,
    and only the first common cell of a pair counts. ``cell`` should be about a box's size."""
    top = lambda at, n: F.floor((F.col(at) + F.col(n) - 1) / cell)
    on = boxes.withColumn("cx", F.explode(F.sequence(F.floor(F.col("x") / cell), top("x", "w")))).withColumn("cy", F.explode(F.sequence(F.floor(F.col("y") / cell), top("y", "h"))))
    a, b = (on.select("cx", "cy", *(F.col(c).alias(f"{c}_{s}") for c in ("tile", "x", "y", "w", "h"))) for s in "ab")
    both = a.join(b, ["cx", "cy"]).where("tile_a < tile_b and x_a < x_b + w_b and x_b < x_a + w_a and y_a < y_b + h_b and y_b < y_a + h_a")
    first = (F.col("cx") == F.floor(F.greatest("x_a", "x_b") / cell)) & (F.col("cy") == F.floor(F.greatest("y_a", "y_b") / cell))
    return both.where(first).select(F.col("tile_a").alias("lhs"), F.col("tile_b").alias("rhs"))
