"""Stencil kernels over px; SQL looks at neighbours by self joins. Box means and warps are made in blocks of 8 x 8, so
that 16 x 16 frames have inner edges there; elsewhere a block is a whole frame, and no pixel travels twice."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.functions.robust import MAD_TO_SIGMA, round6
from starloom.operators import blocks as B
from starloom.operators import frames as O
from starloom.registry import SQL, on_px
from starloom.sources.frames import SIDE

EDGE = 8
STAT_SQL = ", st0 AS (SELECT *, median(v) OVER f AS m FROM px WINDOW f AS (PARTITION BY frame_id)), st AS (SELECT *, 1.4826 * median(abs(v - m)) OVER (PARTITION BY frame_id) AS s FROM st0)"
COLOUR = "CASE WHEN {0}.y % 2 = 0 AND {0}.x % 2 = 0 THEN 'r' WHEN {0}.y % 2 = 1 AND {0}.x % 2 = 1 THEN 'b' ELSE 'g' END"
RGB_SQL = ", rgb AS (SELECT a.frame_id, a.y, a.x, " + ", ".join(f"CASE WHEN any_value({COLOUR.format('a')}) = '{c}' THEN any_value(a.v) ELSE avg(b.v) FILTER ({COLOUR.format('b')} = '{c}') END AS {c}" for c in "rgb") + " FROM px a JOIN px b ON a.frame_id = b.frame_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY 1, 2, 3)"


def near_sql(r: int, source: str = "px") -> str:
    return f"FROM {source} a JOIN {source} b ON a.frame_id = b.frame_id AND abs(a.y - b.y) <= {r} AND abs(a.x - b.x) <= {r} GROUP BY 1, 2, 3"


def rounded(df, *names, digits=3):
    return df.select("frame_id", "y", "x", *(F.round(c, digits).alias(c) for c in names))


on_px("n1_background_mask", lambda px: B.background_mask(px, 1.5).select("frame_id", "y", "x", F.col("background").cast("int").alias("background")), f"""{STAT_SQL}
SELECT a.frame_id, a.y, a.x, CAST(NOT bool_or(abs(b.v - b.m) > 1.5 * b.s AND (a.y - b.y) ** 2 + (a.x - b.x) ** 2 <= 9) AS INTEGER) AS background {near_sql(3, 'st')}""")
on_px("n11_cosmetic", lambda px: rounded(B.cosmetic(px, 1.5), "v"), f"""{STAT_SQL}, h AS (SELECT a.frame_id, a.y, a.x, any_value(a.v) AS v, any_value(a.v > a.m + 1.5 * a.s) AS hot,
count(*) FILTER (b.v > b.m + 1.5 * b.s AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND (a.y <> b.y OR a.x <> b.x)) AS beside,
avg(b.v) FILTER (abs(a.y - b.y) + abs(a.x - b.x) = 2 AND (a.y = b.y OR a.x = b.x)) AS mean {near_sql(2, 'st')}) SELECT frame_id, y, x, round(CASE WHEN hot AND beside <= 1 THEN coalesce(mean, v) ELSE v END, 3) AS v FROM h""")
on_px("n15_debayer", lambda px: rounded(B.debayer(px), "r", "g", "b"), f"{RGB_SQL} SELECT frame_id, y, x, round(r, 3) AS r, round(g, 3) AS g, round(b, 3) AS b FROM rgb")
on_px("n12_green_proxy", lambda px: rounded(B.debayer(px), "g"), f"{RGB_SQL} SELECT frame_id, y, x, round(g, 3) AS g FROM rgb")
on_px("f16_luminance", lambda px: B.debayer(px).select("frame_id", "y", "x", F.round(0.2126 * F.col("r") + 0.7152 * F.col("g") + 0.0722 * F.col("b"), 3).alias("luma"), F.round(0.25 * F.col("r") + 0.5 * F.col("g") + 0.25 * F.col("b"), 3).alias("mono")), f"{RGB_SQL} SELECT frame_id, y, x, round(0.2126 * r + 0.7152 * g + 0.0722 * b, 3) AS luma, round(0.25 * r + 0.5 * g + 0.25 * b, 3) AS mono FROM rgb")
on_px("x26_log_chroma", lambda px: B.debayer(px).groupBy("frame_id").agg(*(F.round(F.stddev_pop(F.ln(F.col(c) / F.col("g"))), 5).alias(f"sd_{c}") for c in "rb")), f"{RGB_SQL} SELECT frame_id, round(stddev_pop(ln(r / g)), 5) AS sd_r, round(stddev_pop(ln(b / g)), 5) AS sd_b FROM rgb GROUP BY 1")
on_px("p8_apply_gains", lambda px: B.debayer(px).withColumns({"kr": F.least(F.median(F.col("g") / F.col("r")).over(O.Window.partitionBy("frame_id")), F.lit(3.0)), "kb": F.least(F.median(F.col("g") / F.col("b")).over(O.Window.partitionBy("frame_id")), F.lit(3.0))}).select("frame_id", "y", "x", F.round(F.col("r") * F.col("kr"), 3).alias("r"), F.round("g", 3).alias("g"), F.round(F.col("b") * F.col("kb"), 3).alias("b")), f"""{RGB_SQL}
SELECT frame_id, y, x, round(r * least(median(g / r) OVER f, 3), 3) AS r, round(g, 3) AS g, round(b * least(median(g / b) OVER f, 3), 3) AS b FROM rgb WINDOW f AS (PARTITION BY frame_id)""")
on_px("n8_box_blur", lambda px: rounded(B.box_blur(px, 2, EDGE), "v"), f"SELECT a.frame_id, a.y, a.x, round(avg(b.v), 3) AS v {near_sql(2)}")
_AT = {d: f"coalesce(max(b.v) FILTER (b.y - a.y = {d[0]} AND b.x - a.x = {d[1]}), any_value(a.v))" for d in B.AROUND}
on_px("n2_sobel_energy", lambda px: B.derivatives(px).groupBy("frame_id").agg(F.round(F.median("sobel2"), 2).alias("energy")), f""", e AS (SELECT a.frame_id, a.y, a.x, {_AT[-1, 1]} + 2 * {_AT[0, 1]} + {_AT[1, 1]} - {_AT[-1, -1]} - 2 * {_AT[0, -1]} - {_AT[1, -1]} AS gx,
{_AT[1, -1]} + 2 * {_AT[1, 0]} + {_AT[1, 1]} - {_AT[-1, -1]} - 2 * {_AT[-1, 0]} - {_AT[-1, 1]} AS gy {near_sql(1)}) SELECT frame_id, round(median(gx * gx + gy * gy), 2) AS energy FROM e GROUP BY 1""")


def _post(px):
    w = O.Window.partitionBy("frame_id", "ty", "tx")
    tiles = B.derivatives(px).withColumn("ty", F.floor(F.col("y") / 8)).withColumn("tx", F.floor(F.col("x") / 8)).withColumn("m", F.median("v").over(w))
    sigma = F.median(F.abs(F.col("v") - F.col("m"))) * MAD_TO_SIGMA
    return tiles.groupBy("frame_id", "ty", "tx").agg(F.round(F.sqrt(F.var_pop("laplacian")), 3).alias("sharpness"), round6(F.first("m")).alias("med"), F.round((F.percentile("v", 0.99) - F.first("m")) / (sigma + 1e-6), 5).alias("snr"))


on_px("n20_post_metrics", _post, f""", l AS (SELECT a.frame_id, a.y, a.x, any_value(a.v) AS v, CASE WHEN count(*) FILTER (abs(a.y - b.y) + abs(a.x - b.x) = 1) = 4 THEN sum(b.v) FILTER (abs(a.y - b.y) + abs(a.x - b.x) = 1) - 4 * any_value(a.v) END AS lap {near_sql(1)}),
m AS (SELECT *, y // 8 AS ty, x // 8 AS tx, median(v) OVER (PARTITION BY frame_id, y // 8, x // 8) AS m FROM l)
SELECT frame_id, ty, tx, round(sqrt(var_pop(lap)), 3) AS sharpness, round(any_value(m), 6) AS med, round((quantile_cont(v, 0.99) - any_value(m)) / (1.4826 * median(abs(v - m)) + 1e-6), 5) AS snr FROM m GROUP BY 1, 2, 3""")
on_px("n10_components", lambda px: B.components(px, 1.0), None)
SQL["n10_components"] = SQL["n11_cosmetic"].split(", h AS")[0].replace("WITH ", "WITH RECURSIVE ", 1) + """, hot AS MATERIALIZED (SELECT frame_id, y, x FROM st WHERE v > m + s),
r AS (SELECT frame_id, y, x, y * 1000 + x AS l FROM hot UNION SELECT h.frame_id, h.y, h.x, r.l FROM r JOIN hot h ON h.frame_id = r.frame_id AND abs(h.y - r.y) <= 1 AND abs(h.x - r.x) <= 1)
SELECT frame_id, l // 1000 AS y, l % 1000 AS x, count(*) AS n FROM (SELECT frame_id, y, x, min(l) AS l FROM r GROUP BY 1, 2, 3) GROUP BY 1, 2, 3"""


def _warps(px):
    t = F.col("frame_id") * 0.01
    return px.select("frame_id").distinct().select("frame_id", F.cos(t).alias("a00"), (-F.sin(t)).alias("a01"), (F.col("frame_id") * 0.25 - 2).alias("tx"), F.sin(t).alias("a10"), F.cos(t).alias("a11"), (1.5 - F.col("frame_id") * 0.125).alias("ty"))


# hundredths are rounded as whole numbers, as the SQL's engine does: half shifts lie at ties
on_px("n16_warp", lambda px: B.warp(px, _warps(px), SIDE, SIDE, EDGE).select("frame_id", "y", "x", (F.round(F.col("v") * 100) / 100).alias("v")), f""", m AS (SELECT frame_id, y, x, cos(frame_id * 0.01) * x - sin(frame_id * 0.01) * y + frame_id * 0.25 - 2 AS sx, sin(frame_id * 0.01) * x + cos(frame_id * 0.01) * y + 1.5 - frame_id * 0.125 AS sy
FROM (SELECT DISTINCT frame_id FROM px), range({SIDE}) a(y), range({SIDE}) b(x)), c AS (SELECT m.*, floor(sy) + j AS cy, floor(sx) + i AS cx, (CASE WHEN i = 1 THEN sx - floor(sx) ELSE 1 - sx + floor(sx) END) * (CASE WHEN j = 1 THEN sy - floor(sy) ELSE 1 - sy + floor(sy) END) AS w FROM m, range(2) i(i), range(2) j(j))
SELECT c.frame_id, c.y, c.x, round(coalesce(sum(w * v), 0), 2) AS v FROM c LEFT JOIN px ON px.frame_id = c.frame_id AND px.y = cy AND px.x = cx GROUP BY 1, 2, 3""")
on_px("n17_soft_threshold", lambda px: B.on_tiles(O.tile_of(px, SIDE), B.soft_threshold).withColumn("v", F.round("v", 3)), None)
on_px("n18_wiener", lambda px: B.on_tiles(O.tile_of(px, SIDE), lambda a: B.wiener(a, 5000.0)).withColumn("v", F.round("v", 3)), None)
