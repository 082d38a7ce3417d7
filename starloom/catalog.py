"""All queries of the frame engine and the SQL that checks them.

Names begin with the survey's number of the operator. px is built from lineitem, series from events, stars from customer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starloom.functions.robust import clip, median_or_zero, robust_z, round6, teff_from_bv
from starloom.operators import frames as O
from starloom.operators import joins as J
from starloom.registry import QUERIES, SQL, on_px, query
from starloom.sources.frames import COMMON, PX_SQL, SIDE, pixels, table
from starloom.streaming.events import windowed_counts

def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


METRICS_SQL = """med AS (SELECT *, median(v) OVER (PARTITION BY frame_id) AS m,
  coalesce(lead(v) OVER r, v) - coalesce(lag(v) OVER r, v) AS g FROM px WINDOW r AS (PARTITION BY frame_id, y ORDER BY x)),
met AS (SELECT frame_id, any_value(m) AS background, 1.4826 * median(abs(v - m)) AS noise, median(g * g) AS energy FROM med GROUP BY 1)"""


def z_sql(table_: str, value: str, out: str, part: str = "") -> str:
    w = f"({part})"
    return f"""{out}_a AS (SELECT *, median({value}) OVER {w} AS {out}_m FROM {table_}), {out}_b AS (SELECT *, 1.4826 * median(abs({value} - {out}_m)) OVER {w} AS {out}_s FROM {out}_a),
{out}_t AS (SELECT *, CASE WHEN {out}_s > 0 THEN ({value} - {out}_m) / {out}_s ELSE 0 END AS {out} FROM {out}_b)"""


on_px("f1_normalize", O.normalize, """, s AS (SELECT frame_id, median(v) AS b, median(CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN v END) AS b_red FROM px GROUP BY 1)
SELECT frame_id, y, x, round(v / greatest(CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN b_red ELSE b END, 1e-6), 6) AS v FROM px JOIN s USING (frame_id)""")
on_px("f14_linear_stretch", lambda px: (lambda r: px.select("frame_id", "y", "x", F.round((F.col("v") - F.lit(r[0])) / F.lit(max(r[1] - r[0], 1e-12)) * 65535, 3).alias("v")))(px.where("v > 0").agg(F.min("v"), F.max("v")).first()), "SELECT frame_id, y, x, round((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) * 65535, 3) AS v FROM px")
on_px("f15_crop_box", lambda px: px.where("v > 30000").groupBy("frame_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h")), "SELECT frame_id, min(x) AS x0, min(y) AS y0, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM px WHERE v > 30000 GROUP BY 1")
on_px("a1_frame_stats", O.frame_stats, """, m AS (SELECT *, median(v) OVER (PARTITION BY frame_id) AS m FROM px)
SELECT frame_id, count(v) AS n, round(min(v), 6) AS lo, round(max(v), 6) AS hi, round(any_value(m), 6) AS med, round(1.4826 * median(abs(v - m)), 6) AS sigma,
round(quantile_cont(v, 0.95), 6) AS p95_linear, round(list_sort(list(v))[CAST(floor(0.95 * (count(v) - 1) + 0.5) AS INT) + 1], 6) AS p95_nearest,
round(list_sort(list(v))[CAST(floor(0.95 * (count(v) - 1)) AS INT) + 1], 6) AS p95_floor, round(list_sort(list(v))[CAST(floor(count(v) / 2) AS INT) + 1], 6) AS upper_med,
round(stddev_pop(v), 4) AS std_pop, round(stddev_samp(v), 4) AS std_samp FROM m GROUP BY 1""")


def _clip_sql(rounds: int) -> str:
    parts = ["k0 AS (SELECT *, TRUE AS keep, FALSE AS stop FROM px)"]
    for i in range(rounds):
        parts.append(f"a{i} AS (SELECT *, median(CASE WHEN keep THEN v END) OVER f AS m, stddev_pop(CASE WHEN keep THEN v END) OVER f AS s FROM k{i} WINDOW f AS (PARTITION BY frame_id))")
        parts.append(f"b{i} AS (SELECT *, keep AND abs(v - m) < 3 * s AS nxt FROM a{i})")
        parts.append(f"c{i} AS (SELECT *, sum(keep::INT) OVER f AS n0, sum(nxt::INT) OVER f AS n1 FROM b{i} WINDOW f AS (PARTITION BY frame_id))")
        parts.append(f"k{i + 1} AS (SELECT frame_id, y, x, v, CASE WHEN stop OR n1 = n0 OR n1 = 0 THEN keep ELSE nxt END AS keep, stop OR n1 = n0 OR n1 = 0 AS stop FROM c{i})")
    return ", " + ", ".join(parts) + f" SELECT frame_id, round(median(CASE WHEN keep THEN v END), 6) AS background, CAST(sum(keep::INT) AS BIGINT) AS n_kept FROM k{rounds} GROUP BY 1"


on_px("a15_sigma_clip_background", O.sigma_clip_background, _clip_sql(5))
on_px("a16_coverage", lambda px: O.coverage(px, COMMON), f"SELECT y, x, count(*) AS covered, count(*) >= {COMMON} AS common FROM px WHERE v > 0 GROUP BY 1, 2")
on_px("w2_frame_metrics", lambda px: O.metrics(px).select("frame_id", *(round6(F.col(c)).alias(c) for c in ("background", "noise", "energy"))), f", {METRICS_SQL} SELECT frame_id, round(background, 6) AS background, round(noise, 6) AS noise, round(energy, 6) AS energy FROM met")
on_px("w3_global_weights", lambda px: O.global_weights(O.metrics(px)), f""", {METRICS_SQL}, {z_sql('met', 'background', 'zb')}, {z_sql('zb_t', 'noise', 'zn')}, {z_sql('zn_t', 'energy', 'ze')}
SELECT frame_id, round(q, 6) AS quality, round(exp(q), 6) AS weight FROM (SELECT frame_id, least(greatest(-0.4 * zb - 0.3 * zn + 0.3 * ze, -3), 3) AS q FROM ze_t)""")
TILES_SQL = f"t AS (SELECT px.*, trow, tcol FROM px, range({(SIDE - O.TILE) // O.STRIDE + 1}) a(trow), range({(SIDE - O.TILE) // O.STRIDE + 1}) b(tcol) WHERE y >= trow * {O.STRIDE} AND y < trow * {O.STRIDE} + {O.TILE} AND x >= tcol * {O.STRIDE} AND x < tcol * {O.STRIDE} + {O.TILE})"
on_px("j1_tile_pixels", lambda px: O.tile_of(px, SIDE).groupBy("frame_id", F.col("trow").cast("long").alias("trow"), F.col("tcol").cast("long").alias("tcol")).agg(F.count("*").alias("n"), round6(F.median("v")).alias("med")), f", {TILES_SQL} SELECT frame_id, trow, tcol, count(*) AS n, round(median(v), 6) AS med FROM t GROUP BY 1, 2, 3")
on_px("w4_local_weights", lambda px: O.local_weights(px, SIDE).withColumn("trow", F.col("trow").cast("long")).withColumn("tcol", F.col("tcol").cast("long")), f""", {TILES_SQL}, m AS (SELECT *, median(v) OVER (PARTITION BY frame_id, trow, tcol) AS m FROM t),
st AS (SELECT frame_id, trow, tcol, any_value(m) AS background, (max(v) - min(v)) / (1.4826 * median(abs(v - m)) + 1e-6) AS ratio FROM m GROUP BY 1, 2, 3),
{z_sql('st', 'ratio', 'zr', 'PARTITION BY trow, tcol')}, {z_sql('zr_t', 'background', 'zb', 'PARTITION BY trow, tcol')}
SELECT frame_id, trow, tcol, round(exp(least(greatest(0.7 * zr - 0.3 * zb, -3), 3)), 6) AS weight FROM zb_t""")
on_px("w5_standardize", lambda px: O.metrics(px).select("frame_id", *(F.when(F.stddev_pop(c).over(Window.partitionBy()) > 1e-6, round6((F.col(c) - F.avg(c).over(Window.partitionBy())) / F.stddev_pop(c).over(Window.partitionBy()))).otherwise(0.0).alias(c) for c in ("background", "noise"))), f", {METRICS_SQL} SELECT frame_id, round((background - avg(background) OVER ()) / stddev_pop(background) OVER (), 6) AS background, round((noise - avg(noise) OVER ()) / stddev_pop(noise) OVER (), 6) AS noise FROM met")
on_px("w6_quantile_labels", lambda px: O.quantile_labels(O.metrics(px).select("frame_id", "noise"), "noise", 4).select("frame_id", "label"), f", {METRICS_SQL} SELECT frame_id, CAST(((row_number() OVER (ORDER BY noise, frame_id) - 1) * 4) // count(*) OVER () AS INTEGER) AS label FROM met")
on_px("w11_gradients", lambda px: px.select("frame_id", "y", "x", round6((F.coalesce(F.lead("v").over(Window.partitionBy("frame_id", "y").orderBy("x")), "v") - F.coalesce(F.lag("v").over(Window.partitionBy("frame_id", "y").orderBy("x")), "v")) / 2).alias("gx")), "SELECT frame_id, y, x, round((coalesce(lead(v) OVER r, v) - coalesce(lag(v) OVER r, v)) / 2, 6) AS gx FROM px WINDOW r AS (PARTITION BY frame_id, y ORDER BY x)")


def stack_sql(iters: int, weight: str, keys: str = "y, x", source: str = "px") -> str:
    p = f"PARTITION BY {keys}"
    parts = [f"k0 AS (SELECT {keys}, v, {weight} AS w, count(*) OVER ({p}) AS n, TRUE AS keep, count(*) OVER ({p}) <= 2 AS stop FROM {source} WHERE v > 0)"]
    for i in range(iters):
        parts.append(f"a{i} AS (SELECT *, sum(keep::INT * w) OVER ({p}) AS v1, sum(keep::INT * w * w) OVER ({p}) AS v2, sum(keep::INT * w * v) OVER ({p}) AS sv FROM k{i})")
        parts.append(f"b{i} AS (SELECT *, sv / v1 AS mean, sqrt(sum(keep::INT * w * (v - sv / v1) ** 2) OVER ({p}) / (v1 - v2 / v1)) AS s FROM a{i})")
        parts.append(f"c{i} AS (SELECT *, CASE WHEN stop THEN keep ELSE coalesce(keep AND v >= mean - 2 * s AND v <= mean + 2 * s, keep) END AS nxt FROM b{i})")
        parts.append(f"d{i} AS (SELECT *, sum(nxt::INT) OVER ({p}) AS n1, sum(keep::INT) OVER ({p}) AS n0 FROM c{i})")
        parts.append(f"k{i + 1} AS (SELECT {keys}, v, w, n, nxt AS keep, stop OR n1 < ceil(0.5 * n) OR n1 = n0 AS stop FROM d{i})")
    return ", " + ", ".join(parts) + f" SELECT {keys}, round(coalesce(sum(keep::INT * w * v) / nullif(sum(keep::INT * w), 0), avg(v)), 4) AS v, CAST(sum(keep::INT) AS BIGINT) AS n_kept FROM k{iters} GROUP BY ALL"


on_px("r1_sigma_clip_stack", lambda px: O.stack(px), stack_sql(3, "1.0"))
on_px("r2_weighted_stack", lambda px: O.stack(px.withColumn("w", 1 / (F.col("frame_id") + 1).cast("double")), weighted=True), stack_sql(3, "1.0 / (frame_id + 1)"))
OLA_SQL = f"SELECT y, x, CASE WHEN ws > 1e-6 THEN round(vs / ws, 4) END AS v FROM (SELECT y, x, sum(v * w) AS vs, sum(w) AS ws FROM (SELECT *, 0.25 * (1 - cos(2 * pi() * (y - trow * {O.STRIDE}) / {O.TILE - 1})) * (1 - cos(2 * pi() * (x - tcol * {O.STRIDE}) / {O.TILE - 1})) AS w FROM t) GROUP BY 1, 2)"
on_px("r8_overlap_add", lambda px: O.overlap_add(O.tile_of(px, SIDE), ("frame_id", "y", "x")), f", {TILES_SQL} {OLA_SQL.replace('SELECT y, x', 'SELECT frame_id, y, x').replace('GROUP BY 1, 2', 'GROUP BY 1, 2, 3')}")
on_px("r10_tile_seams", lambda px: O.seams(px, SIDE).select(*(F.col(c).cast("long").alias(c) for c in ("r1", "c1", "r2", "c2", "samples")), "mean_abs", "p95_abs"), f""", {TILES_SQL}, u AS (SELECT trow, tcol, y, x, avg(v) AS v FROM t GROUP BY 1, 2, 3, 4), w AS (SELECT trow, tcol, y, x, v - median(v) OVER (PARTITION BY trow, tcol) AS v FROM u),
d AS (SELECT a.trow AS r1, a.tcol AS c1, b.trow AS r2, b.tcol AS c2, abs(a.v - b.v) AS d FROM w a JOIN w b ON a.y = b.y AND a.x = b.x AND ((b.trow = a.trow AND b.tcol = a.tcol + 1) OR (b.trow = a.trow + 1 AND b.tcol = a.tcol)))
SELECT r1, c1, r2, c2, count(*) AS samples, round(avg(d), 4) AS mean_abs, round(list_sort(list(d))[CAST(floor(0.95 * (count(*) - 1) + 0.5) AS INT) + 1], 4) AS p95_abs FROM d GROUP BY ALL""")
on_px("k2_top_maxima", O.local_maxima, """, m AS (SELECT *, median(v) OVER (PARTITION BY frame_id) AS m FROM px), s AS (SELECT *, 1.4826 * median(abs(v - m)) OVER (PARTITION BY frame_id) AS s,
greatest(coalesce(lag(v) OVER r, '-inf'::DOUBLE), coalesce(lead(v) OVER r, '-inf'::DOUBLE), coalesce(lag(v) OVER c, '-inf'::DOUBLE), coalesce(lead(v) OVER c, '-inf'::DOUBLE)) AS near
FROM m WINDOW r AS (PARTITION BY frame_id, y ORDER BY x), c AS (PARTITION BY frame_id, x ORDER BY y))
SELECT * FROM (SELECT frame_id, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY v DESC, y, x) AS INTEGER) AS rank, y, x, round(v, 6) AS v FROM s WHERE v > near AND v > m + s) WHERE rank <= 3""")
on_px("n8_downsample", lambda px: px.groupBy("frame_id", F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x")).agg(round6(F.avg("v")).alias("v")), "SELECT frame_id, y // 2 AS y, x // 2 AS x, round(avg(v), 6) AS v FROM px GROUP BY 1, 2, 3")
on_px("n13_split_planes", lambda px: px.select("frame_id", (F.col("y") % 2 * 2 + F.col("x") % 2).alias("plane"), F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x"), round6(F.col("v")).alias("v")), "SELECT frame_id, y % 2 * 2 + x % 2 AS plane, y // 2 AS y, x // 2 AS x, round(v, 6) AS v FROM px")
on_px("g8_correlation", lambda px: px.alias("a").join(px.where("frame_id = 0").alias("b"), ["y", "x"]).groupBy("a.frame_id").agg(F.round(F.corr("a.v", "b.v"), 5).alias("ncc")), "SELECT a.frame_id, round(corr(a.v, b.v), 5) AS ncc FROM px a JOIN px b USING (y, x) WHERE b.frame_id = 0 GROUP BY 1")
on_px("j8_nearest_cell", lambda px: J.nearest_cells(px.groupBy(F.floor(F.col("y") / 2).alias("cy"), F.floor(F.col("x") / 2).alias("cx")).agg(F.median("v").alias("v")).withColumn("v", F.when((F.col("cy") * 7 + F.col("cx") * 3) % 5 > 0, round6(F.col("v"))))), """, c AS (SELECT cy, cx, CASE WHEN (cy * 7 + cx * 3) % 5 > 0 THEN round(v, 6) END AS v FROM (SELECT y // 2 AS cy, x // 2 AS cx, median(v) AS v FROM px GROUP BY 1, 2))
SELECT a.cy, a.cx, coalesce(any_value(a.v), arg_min(b.v, ((b.cy - a.cy) ** 2 + (b.cx - a.cx) ** 2) * 10000 + b.cy * 100 + b.cx)) AS v FROM c a, c b WHERE b.v IS NOT NULL GROUP BY 1, 2""")
on_px("r12_kmeans", lambda px: O.kmeans(O.quantile_labels(O.metrics(px), "noise", 5).select("frame_id", "background", "noise"), ["background", "noise"], 3).select("frame_id", "label"), None)
LINE_SQL = """, p AS (SELECT frame_id, y AS row, x AS col, x::DOUBLE AS x, v AS y FROM px), i AS (SELECT a.frame_id, a.row, a.col, median((b.y - a.y) / (b.x - a.x)) AS s FROM p a JOIN p b ON a.frame_id = b.frame_id AND a.x <> b.x GROUP BY 1, 2, 3),
s AS (SELECT frame_id, median(s) AS slope FROM i GROUP BY 1)"""


def line_of(px: DataFrame) -> DataFrame:
    return J.repeated_median(px.select("frame_id", F.struct("y", "x").alias("id"), F.col("x").cast("double").alias("x"), F.col("v").alias("y")), "frame_id")


on_px("p4_repeated_median", lambda px: line_of(px).select("frame_id", round6(F.col("slope")).alias("slope"), F.round("intercept", 4).alias("intercept")), f"{LINE_SQL} SELECT frame_id, round(any_value(slope), 6) AS slope, round(median(y - slope * x), 4) AS intercept FROM p JOIN s USING (frame_id) GROUP BY 1")
on_px("f7_sampled_frames", lambda px: O.sampled(px.select("frame_id").distinct(), 7), "SELECT DISTINCT frame_id FROM px WHERE frame_id IN (SELECT CAST(floor(i * hi / 6.0 + 0.5) AS BIGINT) FROM (SELECT max(frame_id) AS hi FROM px), range(7) t(i))")


@query("f12_mode_gate", "SELECT user_id, n, CASE WHEN n < 50 THEN 'abort' WHEN n < 70 THEN 'reduced' ELSE 'full' END AS mode FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)")
def _gate(s, d):
    n = F.col("n")
    return table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).withColumn("mode", F.when(n < 50, "abort").when(n < 70, "reduced").otherwise("full"))


@query("a13_value_stats", "SELECT event_type, count(*) AS n, CAST(count(*) FILTER (value = 0) AS BIGINT) AS zeros, round(min(value), 6) AS lo, round(max(value), 6) AS hi, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM events GROUP BY 1")
def _stats(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") == 0).alias("zeros"), round6(F.min("value")).alias("lo"), round6(F.max("value")).alias("hi"), round6(F.avg("value")).alias("mean"), round6(F.stddev_samp("value")).alias("sd"))


@query("a14_positive_median", "SELECT event_type, round(coalesce(median(value) FILTER (value > 10), 1.0), 6) AS med FROM events GROUP BY 1")
def _positive(s, d):
    return table(s, d, "events").groupBy("event_type").agg(round6(F.coalesce(F.median(F.when(F.col("value") > 10, F.col("value"))), F.lit(1.0))).alias("med"))


@query("a21_weighted_median", """SELECT user_id, round(min(value), 6) AS wmed FROM (SELECT user_id, value, sum(w) OVER (PARTITION BY user_id ORDER BY value, event_id) AS c, sum(w) OVER (PARTITION BY user_id) AS t
FROM (SELECT user_id, event_id, value, event_id % 7 + 1 AS w FROM events)) WHERE 2 * c >= t GROUP BY 1""")
def _wmed(s, d):
    e = table(s, d, "events").withColumn("w", F.col("event_id") % 7 + 1)
    w = Window.partitionBy("user_id")
    e = e.withColumn("c", F.sum("w").over(w.orderBy("value", "event_id"))).withColumn("t", F.sum("w").over(w))
    return e.where("2 * c >= t").groupBy("user_id").agg(round6(F.min("value")).alias("wmed"))


@query("a23_wfwhm", "SELECT user_id, round(f * max(n) OVER () / n, 6) AS wfwhm FROM (SELECT user_id, median(value) AS f, count(*) AS n FROM events GROUP BY 1)")
def _wfwhm(s, d):
    m = table(s, d, "events").groupBy("user_id").agg(F.median("value").alias("f"), F.count("*").alias("n"))
    return m.select("user_id", round6(F.col("f") * F.max("n").over(Window.partitionBy()) / F.col("n")).alias("wfwhm"))


@query("a26_scan_summary", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT user_id) = 1 AS uniform FROM events GROUP BY 1")
def _scan(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users")).withColumn("uniform", F.col("users") == 1)


@query("w1_robust_z", f"WITH {z_sql('events', 'value', 'z', 'PARTITION BY event_type')} SELECT event_id, round(z, 6) AS z FROM z_t")
def _z(s, d):
    return robust_z(table(s, d, "events"), "value", Window.partitionBy("event_type"), "z").select("event_id", round6(F.col("z")).alias("z"))


@query("w8_unwrap", """WITH a AS (SELECT user_id, event_id, value / 50 - floor(value / 50 / (2 * pi())) * 2 * pi() AS a, ts FROM events), b AS (SELECT *, a - lag(a) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM a)
SELECT event_id, round(a + 2 * pi() * coalesce(sum(CASE WHEN d > pi() THEN -1 WHEN d < -pi() THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0), 6) AS angle FROM b""")
def _unwrap(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = F.col("value") / 50
    a = table(s, d, "events").withColumn("a", x - F.floor(x / (2 * F.pi())) * 2 * F.pi())
    a = a.withColumn("d", F.col("a") - F.lag("a").over(w))
    turn = F.when(F.col("d") > F.pi(), -1).when(F.col("d") < -F.pi(), 1).otherwise(0)
    return a.withColumn("turn", turn).select("event_id", round6(F.col("a") + 2 * F.pi() * F.sum("turn").over(w)).alias("angle"))


@query("w9_bridge", """WITH e AS (SELECT user_id, event_id, CAST(event_id AS DOUBLE) AS t, CASE WHEN event_id % 3 > 0 THEN value END AS v FROM events),
f AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER b AS t0, first_value(v IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER a AS t1 FROM e
WINDOW b AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(coalesce(v, v0 + (v1 - v0) * (t - t0) / nullif(t1 - t0, 0), v0, v1), 6) AS filled FROM f""")
def _bridge(s, d):
    e = table(s, d, "events").select("user_id", "event_id", F.col("event_id").cast("double").alias("t"), F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("v"))
    return J.bridge(e, "v", "t", "user_id").select("event_id", round6(F.col("filled")).alias("filled"))


@query("w12_running_max", "SELECT event_id, round(max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS pct FROM events")
def _running(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(s, d, "events").select("event_id", round6(F.max("value").over(w)).alias("pct"))


@query("w13_tail", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 5")
def _tail(s, d):
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return table(s, d, "events").withColumn("n", F.row_number().over(w)).where("n <= 5").select("user_id", "event_id")


@query("j16_asof_phases", """SELECT user_id, event_id, CAST(epoch_us(ts) - epoch_us(s) AS BIGINT) AS micros FROM (SELECT *, last_value(CASE WHEN event_type = 'view' THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END, event_id ROWS UNBOUNDED PRECEDING) AS s
FROM events WHERE event_type IN ('view', 'purchase')) WHERE event_type = 'purchase'""")
def _asof(s, d):
    return J.asof_starts(table(s, d, "events"), "view", "purchase")


@query("j11_band_join", "SELECT a.p_partkey AS id, b.p_partkey AS id_r FROM part a JOIN part b ON abs(a.p_retailprice - b.p_retailprice) <= 0.5 AND a.p_partkey < b.p_partkey")
def _band(s, d):
    p = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"))
    return J.band_join(p, p, "price", 0.5).where("id < id_r").select("id", "id_r")


STARS_SQL = "stars AS (SELECT c_custkey AS id, (c_custkey * 137.5) % 360 AS ra, (c_custkey * 73.25) % 120 - 60 AS dec FROM customer)"


def _stars(s, d):
    k = F.col("c_custkey")
    return table(s, d, "customer").select(k.alias("id"), (k * 137.5 % 360).alias("ra"), (k * 73.25 % 120 - 60).alias("dec"))


@query("j15_cone_search", f"""WITH {STARS_SQL} SELECT c.id AS centre_id, s.id FROM stars s, stars c
WHERE abs(s.dec - c.dec) <= 2.5 AND sin(radians(s.dec - c.dec) / 2) ** 2 + cos(radians(c.dec)) * cos(radians(s.dec)) * sin(radians(s.ra - c.ra) / 2) ** 2 <= sin(radians(2.5) / 2) ** 2""")
def _cone(s, d):
    stars = _stars(s, d)
    return J.cone_search(stars, stars, 2.5)


@query("j13_wcs_project", f"""WITH {STARS_SQL}, p AS (SELECT id, sin(radians(dec)) * sin(radians(10)) + cos(radians(dec)) * cos(radians(10)) * cos(radians(ra - 180)) AS c, ra, dec FROM stars)
SELECT id, round(degrees(cos(radians(dec)) * sin(radians(ra - 180)) / c) * 50 + 500, 4) AS px, round(degrees((sin(radians(dec)) * cos(radians(10)) - cos(radians(dec)) * sin(radians(10)) * cos(radians(ra - 180))) / c) * 50 + 500, 4) AS py FROM p WHERE c > 0.5""")
def _wcs(s, d):
    r = F.radians
    ra, dec, at = r(F.col("ra") - 180), r(F.col("dec")), r(F.lit(10.0))
    c = F.sin(dec) * F.sin(at) + F.cos(dec) * F.cos(at) * F.cos(ra)
    xi = F.cos(dec) * F.sin(ra) / c
    eta = (F.sin(dec) * F.cos(at) - F.cos(dec) * F.sin(at) * F.cos(ra)) / c
    return _stars(s, d).where(c > 0.5).select("id", F.round(F.degrees(xi) * 50 + 500, 4).alias("px"), F.round(F.degrees(eta) * 50 + 500, 4).alias("py"))


@query("x5_temperature", "SELECT p_partkey AS id, round(4600 * (1 / (b + 1.7) + 1 / (b + 0.62)), 3) AS teff FROM (SELECT p_partkey, 0.92 * least(greatest(p_retailprice / 500 - 2, -0.4), 2) AS b FROM part)")
def _teff(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), F.round(teff_from_bv(F.col("p_retailprice") / 500 - 2), 3).alias("teff"))


@query("v7_histogram", "SELECT least(CAST(floor(value / 10) AS INTEGER), 20) AS bin, count(*) AS n FROM events GROUP BY 1")
def _hist(s, d):
    return table(s, d, "events").groupBy(F.least(F.floor(F.col("value") / 10).cast("int"), F.lit(20)).alias("bin")).agg(F.count("*").alias("n"))


@query("v2_usage_funnel", "SELECT user_id, count(*) AS events, CAST(count(*) FILTER (event_type = 'view') AS BIGINT) AS views, CAST(count(*) FILTER (event_type = 'purchase') AS BIGINT) AS purchases, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS last FROM events GROUP BY 1")
def _funnel(s, d):
    kind = F.col("event_type")
    return table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("events"), F.count_if(kind == "view").alias("views"), F.count_if(kind == "purchase").alias("purchases"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))


@query("x24_json_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _json(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("x21_digest", "SELECT event_id, sha256(props) AS digest FROM events")
def _sha(s, d):
    return table(s, d, "events").select("event_id", F.sha2("props", 256).alias("digest"))


@query("e5_windowed_counts", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _windows(s, d):
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed_counts(e).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("b2_coarse_grid", f"WITH {PX_SQL}, p AS (SELECT *, median(v) OVER () AS m FROM px), q AS (SELECT *, 1.4826 * median(abs(v - m)) OVER () AS s FROM p) SELECT y // {O.CELL} AS cy, x // {O.CELL} AS cx, count(*) AS n, round(median(v), 6) AS v FROM q WHERE v >= m - 5 * s AND v <= m + 4 * s GROUP BY 1, 2")
def _grid(s, d):
    px = pixels(s, d)
    m = px.agg(F.median("v")).first()[0]
    sigma = 1.4826 * px.agg(F.median(F.abs(F.col("v") - F.lit(m)))).first()[0]
    good = px.where(F.col("v").between(m - 5 * sigma, m + 4 * sigma))
    return good.groupBy(F.floor(F.col("y") / O.CELL).alias("cy"), F.floor(F.col("x") / O.CELL).alias("cx")).agg(F.count("*").alias("n"), round6(F.median("v")).alias("v"))


@query("g12_rejected_frames", """WITH e AS (SELECT user_id, count(*) AS n, median(value) AS cc FROM events GROUP BY 1), m AS (SELECT *, median(cc) OVER () AS m FROM e), s AS (SELECT *, 1.4826 * median(abs(cc - m)) OVER () AS s FROM m)
SELECT user_id, CASE WHEN n < 50 THEN 'few' WHEN cc < m - 1.5 * s THEN 'low_cc' WHEN cc > m + 1.5 * s THEN 'scale' END AS reason FROM s""")
def _reject(s, d):
    e = table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.median("value").alias("cc"))
    every = Window.partitionBy()
    e = e.withColumn("m", F.median("cc").over(every)).withColumn("s", 1.4826 * F.median(F.abs(F.col("cc") - F.col("m"))).over(every))
    return e.select("user_id", F.when(F.col("n") < 50, "few").when(F.col("cc") < F.col("m") - 1.5 * F.col("s"), "low_cc").when(F.col("cc") > F.col("m") + 1.5 * F.col("s"), "scale").alias("reason"))


@query("r17_capped_weights", "SELECT user_id, round(least(w, 2 * median(w) OVER ()), 6) AS w FROM (SELECT user_id, exp(1.7 * least(greatest(median(value) / 100 - 1, -3), 3)) AS w FROM events GROUP BY 1)")
def _capped(s, d):
    q = clip(median_or_zero(F.col("value")) / 100 - 1, -3.0, 3.0)
    e = table(s, d, "events").groupBy("user_id").agg(F.exp(1.7 * q).alias("w"))
    return e.select("user_id", round6(F.least("w", 2 * F.median("w").over(Window.partitionBy()))).alias("w"))


from starloom.plans import analytics, colour, intake, kernels, photometry, runs, sky, stencils  # noqa: E402, F401  (they register theirs, some upon the SQL above)
