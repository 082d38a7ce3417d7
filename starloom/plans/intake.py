"""Headers, modes, sizes, colours and tile pairs, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions import intake as I
from starloom.functions.robust import median_or_zero, round6
from starloom.operators import frames as O
from starloom.operators import joins as J
from starloom.registry import SQL, on_px, query
from starloom.sources.frames import PX_SQL, table
from starloom.catalog import METRICS_SQL, stack_sql, z_sql

# orders as frame headers: each card is there for some of them
HEAD_SQL = """h AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 3 ELSE 2 END AS axes, CASE WHEN o_custkey % 3 = 0 THEN ['RGGB', 'bggr', ' GRBG', 'gbrg', 'XTRANS'][CAST(o_custkey % 5 AS INT) + 1] END AS pattern,
 CASE WHEN o_custkey % 4 = 1 THEN CASE o_orderstatus WHEN 'O' THEN 'OSC gbrg camera' WHEN 'F' THEN 'Mono' ELSE 'one shot Color' END END AS colour,
 CASE WHEN o_custkey % 5 = 2 THEN o_orderkey % 4 END AS xo, CASE WHEN o_custkey % 5 = 2 THEN o_custkey % 4 END AS yo,
 ['OSC', 'MONO', 'RGB', ''][CAST(o_orderkey % 4 AS INT) + 1] AS wanted, ['', 'GBRG', 'RGGB'][CAST(o_orderkey % 3 AS INT) + 1] AS wanted_pattern, 100 + o_custkey % 2 AS width, 80 AS height FROM orders),
p AS (SELECT *, CASE WHEN pattern IS NOT NULL THEN CASE WHEN upper(trim(pattern)) IN ('RGGB', 'BGGR', 'GRBG', 'GBRG') THEN upper(trim(pattern)) ELSE 'UNKNOWN' END
 WHEN lower(colour) LIKE '%rggb%' THEN 'RGGB' WHEN lower(colour) LIKE '%bggr%' THEN 'BGGR' WHEN lower(colour) LIKE '%grbg%' THEN 'GRBG' WHEN lower(colour) LIKE '%gbrg%' THEN 'GBRG'
 WHEN xo % 2 = 0 AND yo % 2 = 0 THEN 'RGGB' WHEN xo % 2 = 1 AND yo % 2 = 0 THEN 'GRBG' WHEN xo % 2 = 0 AND yo % 2 = 1 THEN 'GBRG' WHEN xo % 2 = 1 AND yo % 2 = 1 THEN 'BGGR' ELSE 'UNKNOWN' END AS found FROM h),
m AS (SELECT *, CASE WHEN axes >= 3 THEN 'RGB' WHEN found <> 'UNKNOWN' THEN 'OSC' WHEN lower(colour) LIKE '%mono%' THEN 'MONO' WHEN lower(colour) LIKE '%osc%' OR lower(colour) LIKE '%color%' THEN 'OSC' ELSE 'MONO' END AS mode FROM p)"""


def headers(orders: DataFrame) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    h = orders.select(
        key.alias("id"), F.when(key % 7 == 0, 3).otherwise(2).alias("axes"), F.when(cust % 3 == 0, pick(("RGGB", "bggr", " GRBG", "gbrg", "XTRANS"), cust % 5)).alias("pattern"),
        F.when(cust % 4 == 1, F.when(F.col("o_orderstatus") == "O", "OSC gbrg camera").when(F.col("o_orderstatus") == "F", "Mono").otherwise("one shot Color")).alias("colour"),
        F.when(cust % 5 == 2, key % 4).alias("xo"), F.when(cust % 5 == 2, cust % 4).alias("yo"), pick(("OSC", "MONO", "RGB", ""), key % 4).alias("wanted"), pick(("", "GBRG", "RGGB"), key % 3).alias("wanted_pattern"), (100 + cust % 2).alias("width"), F.lit(80).alias("height"))
    h = h.withColumn("found", I.bayer_pattern(*map(F.col, ("pattern", "colour", "xo", "yo"))))
    return h.withColumn("mode", I.colour_mode(F.col("axes"), F.col("found"), F.col("colour")))


@query("f10_header_mode", f"WITH {HEAD_SQL} SELECT id, found, mode FROM m")
def _modes(s, d):
    return headers(table(s, d, "orders")).select("id", "found", "mode")


@query("f11_reconciled_mode", f"""WITH {HEAD_SQL}, o AS (SELECT *, NOT (axes >= 3 OR found <> 'UNKNOWN' OR colour IS NOT NULL) AND wanted <> '' AS open, wanted = 'OSC' AND wanted_pattern IN ('', 'GBRG') AS vague FROM m),
r AS (SELECT *, CASE WHEN open AND vague THEN 'MONO' WHEN open THEN wanted ELSE mode END AS final FROM o)
SELECT id, final AS mode, CASE WHEN final = 'OSC' AND found = 'UNKNOWN' AND wanted_pattern <> '' THEN wanted_pattern ELSE found END AS pattern, CASE WHEN open AND vague THEN 'ambiguous' WHEN open THEN 'fallback' END AS warning FROM r""")
def _reconciled(s, d):
    out = I.reconciled(*map(F.col, ("mode", "found", "colour", "axes", "wanted", "wanted_pattern")))
    return headers(table(s, d, "orders")).select("id", *(c.alias(n) for c, n in zip(out, ("mode", "pattern", "warning"), strict=True)))


@query("f12_mode_gates", """WITH u AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT user_id, CASE WHEN n < 50 THEN CASE WHEN user_id % 2 = 0 THEN 'emergency_reduced' ELSE 'abort' END WHEN n < 40 + user_id % 50 THEN 'reduced' ELSE 'full' END AS mode, n < 50 AND user_id % 2 = 1 AS stops FROM u""")
def _gates(s, d):
    u = table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    mode, stops = I.mode_gate(F.col("n"), 40 + F.col("user_id") % 50, F.col("user_id") % 2 == 0, F.lit(50))
    return u.select("user_id", mode.alias("mode"), stops.alias("stops"))


@query("f9_tile_limit", "SELECT ps AS frame, tile FROM (SELECT s_suppkey AS ps, unnest(range(9)) AS tile FROM supplier) WHERE ps < 12 AND tile < 4")
def _limit(s, d):
    tiles = table(s, d, "supplier").select(F.col("s_suppkey").alias("frame"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))).alias("tile"))
    return O.limited(tiles, frames=12, tiles=4)


@query("x17_tile_plan", """WITH f AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal / 1000 ELSE 3.0 END AS f, 1000 + c_custkey % 3000 AS w, 900 AS h, c_acctbal / 5000 AS o FROM customer),
t AS (SELECT *, CAST(floor(least(greatest(32 * f, 48), greatest(floor(least(w, h) / 6), 48))) AS INTEGER) AS size FROM f) SELECT c_custkey, size, CAST(floor(least(greatest(o, 0), 0.5) * size) AS INTEGER) AS overlap, CAST(size - floor(least(greatest(o, 0), 0.5) * size) AS INTEGER) AS stride FROM t""")
def _plan(s, d):
    c = table(s, d, "customer")
    out = I.tile_plan(F.col("c_acctbal") / 1000, 1000 + F.col("c_custkey") % 3000, F.lit(900), 32.0, 48, 6, F.col("c_acctbal") / 5000)
    return c.select("c_custkey", *(e.alias(n) for e, n in zip(out, ("size", "overlap", "stride"), strict=True)))


@query("x19_grid_spacing", "SELECT c_custkey, CAST(least(greatest(greatest(2 * t, 64), floor(least(w, h) / 8)), greatest(floor(least(w, h) * 0.2), greatest(2 * t, 64))) AS INTEGER) AS spacing FROM (SELECT c_custkey, 600 + c_custkey % 4000 AS w, 3000 AS h, 16 + c_custkey % 200 AS t FROM customer)")
def _spacing(s, d):
    k = F.col("c_custkey")
    return table(s, d, "customer").select("c_custkey", I.grid_spacing(600 + k % 4000, F.lit(3000), 16 + k % 200, 8, 64, 0.2).alias("spacing"))


@query("p10_auto_radii", "WITH a AS (SELECT *, greatest(3.0, 1.8 * f) AS a FROM (SELECT c_custkey, greatest(coalesce(c_acctbal / 1000, 0), 0) AS f FROM customer)), b AS (SELECT *, greatest(a + 1, 3.0 * f) AS b FROM a) SELECT c_custkey, round(a, 6) AS aperture, round(b, 6) AS inner_, round(greatest(b + 2, 5.0 * f), 6) AS outer_ FROM b")
def _radii(s, d):
    out = I.auto_radii(F.col("c_acctbal") / 1000, 3.0, 1.8, 3.0, 5.0)
    return table(s, d, "customer").select("c_custkey", *(round6(e).alias(n) for e, n in zip(out, ("aperture", "inner_", "outer_"), strict=True)))


@query("x25_disk_full", "SELECT event_id, m, lower(m) LIKE '%no space left on device%' OR lower(m) LIKE '%disk full%' OR lower(m) LIKE '%not enough space%' OR lower(m) LIKE '%enospc%' AS full FROM (SELECT event_id, ['write: No space left on device', 'Disk FULL', 'bad header', 'errno ENOSPC', 'Not enough space here', 'space left'][CAST(event_id % 6 AS INT) + 1] AS m FROM events)")
def _full(s, d):
    m = F.element_at(F.array(*map(F.lit, ("write: No space left on device", "Disk FULL", "bad header", "errno ENOSPC", "Not enough space here", "space left"))), (F.col("event_id") % 6 + 1).cast("int"))
    return table(s, d, "events").select("event_id", m.alias("m"), I.disk_full(m).alias("full"))


_ROWS = ", ".join("(" + ", ".join(map(repr, r)) + ")" for r in I.colour_table())


@query("x6_blackbody_rgb", f"""WITH c(e, r, g, b) AS (VALUES {_ROWS}), t AS (SELECT c_custkey, 6000 + 5.5 * c_acctbal AS k FROM customer),
l AS (SELECT c_custkey, any_value(k) AS k, greatest(sum(r / (exp(e / k) - 1)), 0) AS r, greatest(sum(g / (exp(e / k) - 1)), 0) AS g, greatest(sum(b / (exp(e / k) - 1)), 0) AS b FROM t, c WHERE k BETWEEN 1000 AND 50000 GROUP BY 1)
SELECT t.c_custkey, round(coalesce(r / (r + g + b), 0), 6) AS r, round(coalesce(g / (r + g + b), 0), 6) AS g, round(coalesce(b / (r + g + b), 0), 6) AS b FROM t LEFT JOIN l USING (c_custkey)""")
def _rgb(s, d):
    return table(s, d, "customer").select("c_custkey", *(round6(c).alias(n) for c, n in zip(I.blackbody_rgb(6000 + 5.5 * F.col("c_acctbal")), "rgb", strict=True)))


@query("x8_filter_curves", """SELECT wl, CASE WHEN wl < 570 OR wl > 720 THEN 0 WHEN wl < 600 THEN round((wl - 570) / 30, 6) WHEN wl <= 680 THEN 1 ELSE round((720 - wl) / 40, 6) END AS r, CASE WHEN wl < 460 OR wl > 620 THEN 0 WHEN wl < 500 THEN round((wl - 460) / 40, 6) WHEN wl <= 580 THEN 1 ELSE round((620 - wl) / 40, 6) END AS g,
CASE WHEN wl < 380 OR wl > 530 THEN 0 WHEN wl < 400 THEN round((wl - 380) / 20, 6) WHEN wl <= 500 THEN 1 ELSE round((530 - wl) / 30, 6) END AS b FROM (SELECT 336.0::DOUBLE + 2 * i AS wl FROM range(343) t(i))""")
def _curves(s, d):
    wl = s.range(343).select((336.0 + 2 * F.col("id")).alias("wl"))
    return wl.select("wl", *(round6(I.filter_curve(F.col("wl"), c)).alias(c) for c in "rgb"))


@query("x11_half_float", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN e = 31 THEN NULL ELSE (CASE WHEN h >= 32768 THEN -1 ELSE 1 END) * CASE WHEN e = 0 THEN m / 1024.0 * pow(2.0, -14) ELSE pow(2.0, e - 15) * (1 + m / 1024.0) END END AS v, round(q * 360.0 / 2147483647, 6) AS degrees FROM (SELECT *, (l_orderkey * 31 + l_partkey * 7 + l_suppkey) % 65536 AS h, h // 1024 % 32 AS e, h % 1024 AS m, l_partkey * 100003 % 2147483647 AS q FROM lineitem)")
def _half(s, d):
    bits = (F.col("l_orderkey") * 31 + F.col("l_partkey") * 7 + F.col("l_suppkey")) % 65536
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", I.half_float(bits).alias("v"), round6(I.fixed_angle(F.col("l_partkey") * 100003 % 2147483647)).alias("degrees"))


_BOX = "SELECT s_suppkey AS tile, s_suppkey * 37 % 900 AS x, s_suppkey * 91 % 700 AS y, 40 + s_suppkey % 25 AS w, 30 + s_suppkey % 35 AS h FROM supplier"


@query("j5_overlapping_tiles", f"WITH t AS ({_BOX}) SELECT a.tile AS lhs, b.tile AS rhs FROM t a JOIN t b ON a.tile < b.tile AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h")
def _overlaps(s, d):
    k = F.col("s_suppkey")
    return J.overlapping(table(s, d, "supplier").select(k.alias("tile"), (k * 37 % 900).alias("x"), (k * 91 % 700).alias("y"), (40 + k % 25).alias("w"), (30 + k % 35).alias("h")), 64)


@query("g16_forward_box", "SELECT o_custkey, CAST(floor(least(0, min(x))) AS INTEGER) AS x0, CAST(floor(least(0, min(y))) AS INTEGER) AS y0, CAST(ceil(greatest(640, max(x))) AS INTEGER) AS x1, CAST(ceil(greatest(480, max(y))) AS INTEGER) AS y1 FROM (SELECT o_custkey, c * cx - s * cy + tx AS x, s * cx + c * cy + ty AS y FROM (SELECT o_custkey, cos(o_orderkey % 7 / 100.0) AS c, sin(o_orderkey % 7 / 100.0) AS s, o_orderkey % 41 - 20.25 AS tx, o_orderkey % 31 - 15.25 AS ty FROM orders), (VALUES (0, 0), (640, 0), (0, 480), (640, 480)) v(cx, cy)) GROUP BY 1")
def _box(s, d):
    k = F.col("o_orderkey")
    warps = table(s, d, "orders").select("o_custkey", F.cos(k % 7 / 100.0).alias("a00"), (-F.sin(k % 7 / 100.0)).alias("a01"), (k % 41 - 20.25).alias("tx"), F.sin(k % 7 / 100.0).alias("a10"), F.cos(k % 7 / 100.0).alias("a11"), (k % 31 - 15.25).alias("ty"))
    return O.forward_box(warps, "o_custkey", 640, 480)


@query("a13_finite_stats", "WITH v AS (SELECT event_type, CASE WHEN event_id % 11 = 0 THEN 'nan'::DOUBLE WHEN event_id % 13 = 0 THEN 'inf'::DOUBLE WHEN event_id % 17 = 0 THEN '-inf'::DOUBLE WHEN event_id % 19 = 0 THEN 0 ELSE value END AS v FROM events) SELECT event_type, count(*) FILTER (isfinite(v)) AS n, count(*) FILTER (isnan(v)) AS n_nan, count(*) FILTER (isinf(v)) AS n_inf, count(*) FILTER (v = 0) AS n_zero, min(v) FILTER (isfinite(v)) AS lo, max(v) FILTER (isfinite(v)) AS hi, round(avg(v) FILTER (isfinite(v)), 6) AS mean, round(stddev_samp(v) FILTER (isfinite(v)), 6) AS sd FROM v GROUP BY 1")
def _finite(s, d):
    i = F.col("event_id")
    v = F.when(i % 11 == 0, float("nan")).when(i % 13 == 0, float("inf")).when(i % 17 == 0, float("-inf")).when(i % 19 == 0, 0.0).otherwise(F.col("value"))
    return O.finite_stats(table(s, d, "events").select("event_type", v.alias("v")), "event_type")


@query("a26_header_scan", f"WITH {HEAD_SQL} SELECT id % 9 AS folder, count(*) AS frames, count(DISTINCT (width, height)) = 1 AS one_size, CAST(count(*) FILTER (found = 'RGGB') AS BIGINT) AS rggb, CAST(count(*) FILTER (found = 'BGGR') AS BIGINT) AS bggr, CAST(count(*) FILTER (found = 'GRBG') AS BIGINT) AS grbg, CAST(count(*) FILTER (found = 'GBRG') AS BIGINT) AS gbrg, count(DISTINCT mode) > 1 AS ambiguous, list_sort(list(DISTINCT mode))[1] AS first_mode FROM m GROUP BY 1")
def _scan(s, d):
    return O.header_scan(headers(table(s, d, "orders")).withColumn("folder", F.col("id") % 9), "folder")


on_px("w3_adaptive_weights", lambda px: O.global_weights(O.metrics(px), adaptive=True), f""", {METRICS_SQL}, {z_sql('met', 'background', 'zb')}, {z_sql('zb_t', 'noise', 'zn')}, {z_sql('zn_t', 'energy', 'ze')},
va AS (SELECT *, var_pop(zb) OVER () AS vb, var_pop(zn) OVER () AS vn, var_pop(ze) OVER () AS vg, count(*) OVER () AS n FROM ze_t), sh AS (SELECT *, least(greatest(vb / (vb + vn + vg), 0.1), 0.7) AS sb, least(greatest(vn / (vb + vn + vg), 0.1), 0.7) AS sn, least(greatest(vg / (vb + vn + vg), 0.1), 0.7) AS sg FROM va)
SELECT frame_id, round(q, 6) AS quality, round(exp(q), 6) AS weight FROM (SELECT frame_id, least(greatest((-sb * zb - sn * zn + sg * ze) / (sb + sn + sg), -3), 3) AS q FROM sh)""")


# every frame stands for a cluster, its noise for the quality
def _final(px: DataFrame, quality: bool, method: str) -> DataFrame:
    q = O.global_weights(O.metrics(px)).select("frame_id", F.col("quality").alias("q"))
    return O.final_stack(px, q, quality, method, kappa=1.7, cap_ratio=1.5)


on_px("r17_final_stack", lambda px: _final(px, True, "rej"), None)
SQL["r17_final_stack"] = f"WITH {PX_SQL}, w AS (SELECT frame_id, exp(1.7 * quality) AS w FROM ({SQL['w3_global_weights']})), c AS (SELECT frame_id, least(w, greatest(1e-6, 1.5 * median(w) OVER ())) AS w FROM w) SELECT y, x, round(sum(v * w) / greatest(1e-6, sum(w)), 4) AS v FROM px JOIN c USING (frame_id) GROUP BY 1, 2"
on_px("r17_mean_stack", lambda px: _final(px, False, "average"), "SELECT y, x, round(avg(v), 4) AS v FROM px GROUP BY 1, 2")
on_px("f6_masked_colour", lambda px: O.enforce_mask(px.select("frame_id", "y", "x", F.col("v").alias("r"), (F.col("v") / 2).alias("g"), (F.col("v") / 4).alias("b")), px.where("v > 30000").select("frame_id", "y", "x", (F.col("v") < 60000).alias("inside")), 16, 16), """, k AS (SELECT frame_id, count(*) = 256 AS fits FROM px WHERE v > 30000 GROUP BY 1), q AS (SELECT px.*, fits AND NOT (v > 30000 AND v < 60000) AS out FROM px LEFT JOIN k USING (frame_id)) SELECT frame_id, y, x, CASE WHEN out THEN 0 ELSE round(v, 6) END AS r, CASE WHEN out THEN 0 ELSE round(v / 2, 6) END AS g, CASE WHEN out THEN 0 ELSE round(v / 4, 6) END AS b FROM q""")


@query("v7_plot_bounds", "SELECT event_type, round(lo - 0.05 * (hi - lo), 5) AS low, round(hi + 0.05 * (hi - lo), 5) AS high FROM (SELECT event_type, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events GROUP BY 1)")
def _bounds(s, d):
    e = table(s, d, "events").groupBy("event_type").agg(F.percentile("value", 0.01).alias("lo"), F.percentile("value", 0.99).alias("hi"))
    margin = 0.05 * (F.col("hi") - F.col("lo"))
    return e.select("event_type", F.round(F.col("lo") - margin, 5).alias("low"), F.round(F.col("hi") + margin, 5).alias("high"))


on_px("v3_metric_report", lambda px: O.metric_report(O.metrics(px)), f", {METRICS_SQL}, " + "u AS (UNPIVOT met ON background, noise, energy INTO NAME metric VALUE value) SELECT metric, count(*) AS n, round(min(value), 4) AS lo, round(max(value), 4) AS hi, round(median(value), 4) AS med, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS sd FROM u GROUP BY 1")
