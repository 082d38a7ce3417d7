"""Sky cells, spectra, text forms, masks and mosaic warps, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.catalog import STARS_SQL
from starloom.functions.robust import MAD_TO_SIGMA, clip, round6
from starloom.functions.sky import band_flux, byte_text, glob_pattern, nested_cell
from starloom.operators import background as G
from starloom.operators import blocks as B
from starloom.operators import colour as C
from starloom.operators import frames as O
from starloom.operators import joins as J
from starloom.plans.analytics import part
from starloom.plans.colour import GAINS_SQL, _stars
from starloom.plans.stencils import EDGE, RGB_SQL, near_sql
from starloom.registry import SQL, on_px, query
from starloom.sources.frames import PX_SQL, SIDE, table

_CELL = f"""WITH {STARS_SQL}, a AS (SELECT id, sin(radians(dec)) AS z, (((radians(ra) % (2 * pi())) + 2 * pi()) % (2 * pi())) / (pi() / 2) AS p FROM stars),
b AS (SELECT *, least(floor(p), 3)::BIGINT AS q, 8 * sqrt(3 * (1 - abs(z))) AS r, floor(8 * (0.5 + p) - 8 * z * 0.75)::BIGINT AS u, floor(8 * (0.5 + p) + 8 * z * 0.75)::BIGINT AS d FROM a),
c AS (SELECT *, least(floor((p - q) * r), 7)::BIGINT AS ca, least(floor((1 - p + q) * r), 7)::BIGINT AS cb FROM b),
e AS (SELECT id, CASE WHEN abs(z) <= 2.0 / 3 THEN (CASE WHEN u // 8 = d // 8 THEN u // 8 % 4 + 4 WHEN u // 8 < d // 8 THEN u // 8 % 4 ELSE d // 8 % 4 + 8 END) WHEN z > 0 THEN q ELSE q + 8 END AS face,
CASE WHEN abs(z) <= 2.0 / 3 THEN d % 8 WHEN z > 0 THEN 7 - cb ELSE ca END AS ix, CASE WHEN abs(z) <= 2.0 / 3 THEN 7 - u % 8 WHEN z > 0 THEN 7 - ca ELSE cb END AS iy FROM c)
SELECT id, CAST(face * 64 + (ix & 1) + (ix & 2) * 2 + (ix & 4) * 4 + (iy & 1) * 2 + (iy & 2) * 4 + (iy & 4) * 8 AS BIGINT) AS cell FROM e"""


@query("x10_sky_cells", _CELL)
def _cells(s, d):
    k = F.col("c_custkey")
    stars = table(s, d, "customer").select(k.alias("id"), ((k * 137.5) % 360).cast("double").alias("ra"), ((k * 73.25) % 120 - 60).cast("double").alias("dec"))
    return stars.select("id", nested_cell(F.col("ra"), F.col("dec"), 3).alias("cell"))


@query("x7_band_flux", "SELECT vec_id, round(0.5 * (list_sum(list_transform(range(64), lambda i: embedding[i + 1]::DOUBLE * (1 - abs(i - 32) / 32.0))) - (embedding[64]::DOUBLE * (1 - 31 / 32.0)) / 2), 5) AS flux FROM embeddings WHERE len(embedding) = 64")
def _flux(s, d):
    return table(s, d, "embeddings").where(F.size("embedding") == 64).select("vec_id", F.round(band_flux(F.col("embedding"), [1 - abs(i - 32) / 32 for i in range(64)], 0.5), 5).alias("flux"))


@query("s2_glob", "SELECT n_name FROM nation WHERE regexp_full_match(lower(n_name), 'nation_[12].?')")
def _glob(s, d):
    return table(s, d, "nation").where(F.col("n_name").rlike(glob_pattern("nation_[12]*")) & (F.length("n_name") <= 9)).select("n_name")


@query("x25_byte_text", "SELECT o_orderkey, CASE WHEN n < 1024 THEN concat(n, ' B') WHEN n < 1048576 THEN concat((n * 10 + 512) // 1024 // 10, '.', (n * 10 + 512) // 1024 % 10, ' KiB') ELSE concat((n * 10 + 524288) // 1048576 // 10, '.', (n * 10 + 524288) // 1048576 % 10, ' MiB') END AS size FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * (o_orderkey % 30) AS n FROM orders)")
def _bytes(s, d):
    return table(s, d, "orders").select("o_orderkey", byte_text(F.floor("o_totalprice") * (F.col("o_orderkey") % 30)).alias("size"))


@query("x22_iso_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events")
def _iso(s, d):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    back = F.to_timestamp_ntz(F.substring(F.col("iso"), 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    return table(s, d, "events").select("event_id", text.alias("iso")).withColumn("seconds", F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), back))


@query("x20_strings", "SELECT n_nationkey, lower(n_name) AS low, starts_with(n_name, 'NATION_1') AS first, ends_with(n_name, '2') AS last, array_to_string(string_split(trim(concat('  ', n_name, ' ')), '_'), '-') AS joined FROM nation")
def _strings(s, d):
    n = F.col("n_name")
    return table(s, d, "nation").select("n_nationkey", F.lower(n).alias("low"), n.startswith("NATION_1").alias("first"), n.endswith("2").alias("last"), F.array_join(F.split(F.trim(F.concat(F.lit("  "), n, F.lit(" "))), "_"), "-").alias("joined"))


@query("x17_tile_size", "SELECT user_id, least(greatest(size, 64), 256) AS size, CAST(floor(least(greatest(size, 64), 256) * 0.5) AS BIGINT) AS step FROM (SELECT user_id, CAST(floor(32 * greatest(median(value), 0) / 10) AS BIGINT) AS size FROM events GROUP BY 1)")
def _tile_size(s, d):
    e = table(s, d, "events").groupBy("user_id").agg(F.floor(32 * F.greatest(F.median("value"), F.lit(0.0)) / 10).alias("size"))
    return e.select("user_id", clip(F.col("size"), 64, 256).cast("long").alias("size")).withColumn("step", F.floor(F.col("size") * 0.5))


@query("x15_even_canvas", "SELECT c_custkey, w + w % 2 AS w, h + h % 2 AS h, x0 - ((x0 % 2) + 2) % 2 AS x0, y0 - ((y0 % 2) + 2) % 2 AS y0 FROM (SELECT c_custkey, 100 + c_custkey % 37 AS w, 90 + c_custkey % 41 AS h, c_custkey % 11 - 5 AS x0, c_custkey % 13 - 6 AS y0 FROM customer)")
def _even(s, d):
    k = F.col("c_custkey")
    up, down = lambda c: c + c % 2, lambda c: c - F.pmod(c, F.lit(2))
    return table(s, d, "customer").select("c_custkey", up(100 + k % 37).alias("w"), up(90 + k % 41).alias("h"), down(k % 11 - 5).alias("x0"), down(k % 13 - 6).alias("y0"))


@query("k5_latest_runs", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY max(ts) DESC, user_id LIMIT 10")
def _latest(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last")).orderBy(F.col("last").desc(), "user_id").limit(10).drop("last")


# each bright point's nearest one of frame 0 within 3 pixels: cells as equi keys
def _nearest(px: DataFrame, far: int = 3) -> DataFrame:
    p = O.local_maxima(px, 0.5, 8).withColumns({"cy": F.floor(F.col("y") / far), "cx": F.floor(F.col("x") / far)})
    around = lambda c: F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1))
    ref = p.where("frame_id = 0").select(F.col("rank").alias("ref"), F.col("y").alias("ry"), F.col("x").alias("rx"), around("cy").alias("cy"), "cx").withColumn("cx", around("cx"))
    d2 = (F.col("y") - F.col("ry")) * (F.col("y") - F.col("ry")) + (F.col("x") - F.col("rx")) * (F.col("x") - F.col("rx"))
    return p.join(ref, ["cy", "cx"]).withColumn("d2", d2).where(F.col("d2") <= far * far).groupBy("frame_id", "rank").agg(F.min(F.struct("d2", "ref")).alias("m")).select("frame_id", "rank", F.col("m.ref").alias("ref"), F.col("m.d2").alias("d2"))


on_px("j10_nearest_star", _nearest, None)
SQL["j10_nearest_star"] = f"WITH p AS {part('k2_top_maxima').replace('m + s)', 'm + 0.5 * s)').replace('rank <= 3', 'rank <= 8')} SELECT a.frame_id, a.rank, CAST(arg_min(b.rank, ((a.y - b.y) ** 2 + (a.x - b.x) ** 2) * 100 + b.rank) AS INTEGER) AS ref, CAST(min((a.y - b.y) ** 2 + (a.x - b.x) ** 2) AS BIGINT) AS d2 FROM p a JOIN p b ON b.frame_id = 0 AND (a.y - b.y) ** 2 + (a.x - b.x) ** 2 <= 9 GROUP BY 1, 2"


# width of a frame's stars: median over those within 2.5 sigma; 0 for too few
def _fwhm(px: DataFrame, least: int = 3) -> DataFrame:
    near = J.around(O.local_maxima(px, 0.5, 12).select("frame_id", "rank", F.col("y").alias("py"), F.col("x").alias("px_")), px, 2)
    m = near.groupBy("frame_id", "rank").agg((2.3548 * F.sqrt(F.sum(F.col("v") * (F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx"))) / F.sum("v") / 2)).alias("f"))
    w = Window.partitionBy("frame_id")
    m = m.withColumn("m", F.median("f").over(w)).withColumn("s", MAD_TO_SIGMA * F.median(F.abs(F.col("f") - F.col("m"))).over(w))
    kept = m.where((F.col("s") <= 0) | (F.abs(F.col("f") - F.col("m")) <= 2.5 * F.col("s")))
    return kept.groupBy("frame_id").agg(F.count("*").alias("n"), F.when(F.count("*") >= least, F.round(F.median("f"), 5)).otherwise(0.0).alias("fwhm"))


on_px("n5_frame_fwhm", _fwhm, None)
SQL["n5_frame_fwhm"] = f"""WITH {PX_SQL}, p AS {part('k2_top_maxima').replace('m + s)', 'm + 0.5 * s)').replace('rank <= 3', 'rank <= 12')},
f AS (SELECT p.frame_id, rank, 2.3548 * sqrt(sum(px.v * ((px.y - p.y) ** 2 + (px.x - p.x) ** 2)) / sum(px.v) / 2) AS f FROM px JOIN p ON px.frame_id = p.frame_id AND abs(px.y - p.y) <= 2 AND abs(px.x - p.x) <= 2 GROUP BY 1, 2),
a AS (SELECT *, median(f) OVER (PARTITION BY frame_id) AS m FROM f), b AS (SELECT *, 1.4826 * median(abs(f - m)) OVER (PARTITION BY frame_id) AS s FROM a)
SELECT frame_id, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(median(f), 5) ELSE 0 END AS fwhm FROM b WHERE s <= 0 OR abs(f - m) <= 2.5 * s GROUP BY 1"""


# calm and dark pixels: at most the 60th part of 100 in value and the 70th in gradient
def _calm(px: DataFrame) -> DataFrame:
    row = Window.partitionBy("frame_id", "y").orderBy("x")
    g = px.withColumn("g", F.abs(F.coalesce(F.lead("v").over(row), "v") - F.coalesce(F.lag("v").over(row), "v")))
    q = g.groupBy("frame_id").agg(F.percentile("v", 0.6).alias("qv"), F.percentile("g", 0.7).alias("qg"))
    return g.join(q, "frame_id").select("frame_id", "y", "x", ((F.col("v") <= F.col("qv")) & (F.col("g") <= F.col("qg"))).cast("int").alias("calm"))


on_px("n21_calm_mask", _calm, ", g AS (SELECT *, abs(coalesce(lead(v) OVER r, v) - coalesce(lag(v) OVER r, v)) AS g FROM px WINDOW r AS (PARTITION BY frame_id, y ORDER BY x)), q AS (SELECT frame_id, quantile_cont(v, 0.6) AS qv, quantile_cont(g, 0.7) AS qg FROM g GROUP BY 1) SELECT frame_id, y, x, CAST(v <= qv AND g.g <= qg AS INTEGER) AS calm FROM g JOIN q USING (frame_id)")


def _moved(px: DataFrame) -> DataFrame:
    warps = px.select("frame_id").distinct().selectExpr("frame_id", "1d a00", "0d a01", "3d tx", "0d a10", "1d a11", "-2d ty")
    return B.warp_mosaic(px, warps, SIDE, SIDE, EDGE).select("frame_id", "y", "x", F.round("v", 3).alias("v"))


# an odd shift lies between two pixels of the same colour
on_px("n14_mosaic_warp", _moved, f", s AS (SELECT frame_id, y + 2 AS y, x - 2 AS x, v / 2 AS v FROM px UNION ALL SELECT frame_id, y + 2, x - 4, v / 2 FROM px) SELECT frame_id, y, x, round(coalesce(sum(v), 0), 3) AS v FROM (SELECT DISTINCT frame_id FROM px) CROSS JOIN range({SIDE}) a(y) CROSS JOIN range({SIDE}) b(x) LEFT JOIN s USING (frame_id, y, x) GROUP BY 1, 2, 3")
on_px("p12_chroma_after", lambda px: B.debayer(px).join(C.gains(_stars(px)).select("frame_id", "kr", "kb"), "frame_id").groupBy("frame_id").agg(*(F.round(F.stddev_pop(F.ln(e) - F.ln("g")), 5).alias(n) for n, e in (("was_r", F.col("r")), ("now_r", C.attenuated(F.col("r"), F.col("kr"), 20000.0, 60000.0)), ("was_b", F.col("b")), ("now_b", C.attenuated(F.col("b"), F.col("kb"), 20000.0, 60000.0)))), round6(F.median("g")).alias("green")), f"""{GAINS_SQL}, w AS (SELECT rgb.*, kr, kb, least(greatest((r - 20000) / 40000, 0), 1) AS tr, least(greatest((b - 20000) / 40000, 0), 1) AS tb FROM rgb JOIN g USING (frame_id))
SELECT frame_id, round(stddev_pop(ln(r) - ln(g)), 5) AS was_r, round(stddev_pop(ln(r * (1 + tr * tr * (3 - 2 * tr) * (kr - 1))) - ln(g)), 5) AS now_r, round(stddev_pop(ln(b) - ln(g)), 5) AS was_b, round(stddev_pop(ln(b * (1 + tb * tb * (3 - 2 * tb) * (kb - 1))) - ln(g)), 5) AS now_b, round(median(g), 6) AS green FROM w GROUP BY 1""")


# a mesh of calm cells under every frame; a value between two thousandths, but for rounding, goes up
def _mesh(px: DataFrame) -> DataFrame:
    return G.mesh(px, G.mesh_cells(px, O.CELL, 0.8, 8, ("frame_id",)), O.CELL, ("frame_id",)).select("frame_id", "y", "x", (F.floor(F.col("model") * 1000 + 0.500001) / 1000).alias("model"))


_TOP = SIDE // O.CELL - 1
on_px("b8_mesh_model", _mesh, f""", o AS (SELECT *, median(v) OVER (PARTITION BY frame_id) AS m FROM px), k AS (SELECT *, 1.4826 * median(abs(v - m)) OVER (PARTITION BY frame_id) AS s FROM o),
h AS (SELECT frame_id, cy, cx, CASE WHEN n >= 8 THEN v END AS v FROM (SELECT frame_id, y // {O.CELL} AS cy, x // {O.CELL} AS cx, median(v) FILTER (s <= 0 OR abs(v - m) <= 0.8 * s) AS v, count(*) FILTER (s <= 0 OR abs(v - m) <= 0.8 * s) AS n FROM k GROUP BY 1, 2, 3)),
c AS (SELECT a.frame_id, a.cy, a.cx, coalesce(any_value(a.v), arg_min(b.v, ((b.cy - a.cy) ** 2 + (b.cx - a.cx) ** 2) * 10000 + b.cy * 100 + b.cx)) AS v FROM h a JOIN h b USING (frame_id) WHERE b.v IS NOT NULL GROUP BY 1, 2, 3),
u AS (SELECT frame_id, y, x, least(greatest((y + 0.5::DOUBLE) / {O.CELL} - 0.5::DOUBLE, 0), {_TOP}) AS uy, least(greatest((x + 0.5::DOUBLE) / {O.CELL} - 0.5::DOUBLE, 0), {_TOP}) AS ux FROM o)
SELECT frame_id, y, x, floor(sum(c.v * (1 - abs(cy - uy)) * (1 - abs(cx - ux))) * 1000 + 0.500001) / 1000 AS model FROM u JOIN c USING (frame_id) WHERE abs(cy - uy) < 1 AND abs(cx - ux) < 1 GROUP BY 1, 2, 3""")
_CHROMA = f"""{RGB_SQL}, l AS (SELECT *, 0.299 * r + 0.587 * g + 0.114 * b AS y_ FROM rgb), q AS (SELECT frame_id, quantile_cont(y_, 0.9) AS lim FROM l GROUP BY 1),
s AS (SELECT a.frame_id, a.y, a.x, any_value(a.y_) AS l, any_value(a.r - a.y_) AS cr, any_value(a.b - a.y_) AS cb, avg(b.r - b.y_) AS sr, avg(b.b - b.y_) AS sb {near_sql(2, 'l')}),
k AS (SELECT s.*, l + cr + CASE WHEN l <= lim THEN 0.7 ELSE 0 END * (sr - cr) AS red, l + cb + CASE WHEN l <= lim THEN 0.7 ELSE 0 END * (sb - cb) AS blue FROM s JOIN q USING (frame_id))
SELECT frame_id, y, x, round(red, 3) AS r, round((l - 0.299 * red - 0.114 * blue) / 0.587, 3) AS g, round(blue, 3) AS b FROM k"""
on_px("n19_chroma_denoise", lambda px: B.chroma_denoise(B.debayer(px), block=EDGE).select("frame_id", "y", "x", *(F.round(c, 3).alias(c) for c in "rgb")), _CHROMA)
