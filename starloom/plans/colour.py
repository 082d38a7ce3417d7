"""Colour gains and their damping, channel and cluster stacks, star centroids, card and table text: with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.catalog import TILES_SQL, stack_sql
from starloom.functions.robust import MAD_TO_SIGMA
from starloom.operators import blocks as B
from starloom.operators import colour as C
from starloom.operators import frames as O
from starloom.operators import joins as J
from starloom.plans.analytics import _LAB, _labels, local, longs, part
from starloom.plans.stencils import RGB_SQL
from starloom.registry import SQL, on_px, query
from starloom.sources import catalogs as S
from starloom.sources.frames import PX_SQL, SIDE, table

HANN_SQL = f"0.25 * (1 - cos(2 * pi() * (y - trow * {O.STRIDE}) / {O.TILE - 1})) * (1 - cos(2 * pi() * (x - tcol * {O.STRIDE}) / {O.TILE - 1}))"


def blend_sql(source: str, keys: str, weight: str = "1", dead: str = "NULL") -> str:
    return f"SELECT {keys}, CASE WHEN ws > 1e-6 THEN round(vs / ws, 4) ELSE {dead} END AS v FROM (SELECT {keys}, sum(v * h) AS vs, sum(h) AS ws FROM (SELECT *, {weight} * {HANN_SQL} AS h FROM {source}) GROUP BY {keys})"


# every frame's tiles blended at once, by local weight and window
def _direct(px: DataFrame) -> DataFrame:
    return O.overlap_add(longs(O.tile_of(px, SIDE), "trow", "tcol").join(local(px).withColumnRenamed("weight", "w"), ["frame_id", "trow", "tcol"]))


on_px("r4_direct_blend", _direct, None)
SQL["r4_direct_blend"] = f"WITH {PX_SQL}, {TILES_SQL}, tw AS (SELECT t.*, weight FROM t JOIN {part('w4_local_weights')} USING (frame_id, trow, tcol)) {blend_sql('tw', 'y, x', 'weight')}"


# three channels, stacked with the frames' shared weights
def _channels(px: DataFrame) -> DataFrame:
    w = O.global_weights(O.metrics(px)).select("frame_id", F.col("weight").alias("w"))
    rgb = B.debayer(px).join(w, "frame_id").select("y", "x", "w", F.posexplode(F.array("r", "g", "b")).alias("c", "v"))
    stacked = O.stack(rgb.withColumn("v", F.round("v", 3)), weighted=True, keys=("c", "y", "x"))
    return stacked.select(F.element_at(F.array(*map(F.lit, "rgb")), F.col("c") + 1).alias("channel"), "y", "x", "v", "n_kept")


on_px("r6_channel_stack", _channels, None)
SQL["r6_channel_stack"] = f"WITH {PX_SQL}{RGB_SQL}, ch AS (SELECT frame_id, y, x, weight AS w, channel, round(v, 3) AS v FROM (UNPIVOT rgb ON r, g, b INTO NAME channel VALUE v) JOIN {part('w3_global_weights')} USING (frame_id)){stack_sql(3, 'w', 'channel, y, x', 'ch')}"


# a cluster's synthetic frame: its tiles stacked by weight, then blended; dead pixels are 0
def _tile_weighted(px: DataFrame) -> DataFrame:
    w = local(px).withColumnRenamed("weight", "lw").join(_labels(px).select("frame_id", "label", "weight"), "frame_id")
    t = longs(O.tile_of(px, SIDE), "trow", "tcol").join(w, ["frame_id", "trow", "tcol"]).withColumn("w", F.col("weight") * F.col("lw"))
    tiles = O.stack(t, weighted=True, keys=("label", "trow", "tcol", "y", "x"))
    return O.overlap_add(tiles, ("label", "y", "x")).fillna(0.0, ["v"])


on_px("r15_tile_weighted_frames", _tile_weighted, None)
SQL["r15_tile_weighted_frames"] = f"WITH {PX_SQL}, {TILES_SQL}, {_LAB}, lw AS {part('w4_local_weights')}, tw AS (SELECT t.*, label, lab.weight * lw.weight AS w FROM t JOIN lab USING (frame_id) JOIN lw USING (frame_id, trow, tcol)), st AS (SELECT * FROM ({stack_sql(3, 'w', 'label, trow, tcol, y, x', 'tw').replace(', k0', 'WITH k0', 1)})) {blend_sql('st', 'label, y, x', dead='0')}"


# centroids of maxima in 5 x 5 pixels, too peaked or too long ones left out
def _centroids(px: DataFrame, concentration: float = 0.8, roundness: float = 0.15) -> DataFrame:
    near = J.around(O.local_maxima(px, 1.0, 12).select("frame_id", "rank", F.col("y").alias("py"), F.col("x").alias("px_")), px, 2)
    key = ["frame_id", "rank", "py", "px_"]
    floor = F.median("v").over(Window.partitionBy("frame_id", "rank"))
    s = near.withColumn("f", F.greatest(F.col("v") - floor, F.lit(0.0))).groupBy(*key).agg(F.sum("f").alias("flux"), F.max("f").alias("peak"), *(F.sum(F.col("f") * e).alias(n) for n, e in (("sy", F.col("dy")), ("sx", F.col("dx")), ("syy", F.col("dy") * F.col("dy")), ("sxx", F.col("dx") * F.col("dx")), ("sxy", F.col("dx") * F.col("dy")))))
    s = s.where("flux > 0").withColumns({"cy": F.col("sy") / F.col("flux"), "cx": F.col("sx") / F.col("flux")})
    a, b, c = F.col("syy") / F.col("flux") - F.col("cy") * F.col("cy"), F.col("sxx") / F.col("flux") - F.col("cx") * F.col("cx"), F.col("sxy") / F.col("flux") - F.col("cx") * F.col("cy")
    s = s.withColumn("half", (a + b) / 2).withColumn("diff", F.sqrt((a - b) * (a - b) / 4 + c * c)).withColumn("roundness", (F.col("half") - F.col("diff")) / F.greatest(F.col("half") + F.col("diff"), F.lit(1e-12)))
    return s.where((F.col("peak") / F.col("flux") <= concentration) & (F.col("roundness") >= roundness)).select("frame_id", "rank", F.round(F.col("py") + F.col("cy"), 5).alias("cy"), F.round(F.col("px_") + F.col("cx"), 5).alias("cx"), F.round("flux", 2).alias("flux"))


on_px("g1_star_centroids", _centroids, None)
SQL["g1_star_centroids"] = f"""WITH {PX_SQL}, k AS (SELECT frame_id, rank, y AS py, x AS qx FROM {part('k2_top_maxima').replace('rank <= 3', 'rank <= 12')}),
n AS (SELECT k.*, y - py AS dy, x - qx AS dx, v, median(v) OVER (PARTITION BY k.frame_id, rank) AS m FROM px JOIN k ON px.frame_id = k.frame_id AND abs(y - py) <= 2 AND abs(x - qx) <= 2),
s AS (SELECT frame_id, rank, py, qx, sum(f) AS flux, max(f) AS peak, sum(f * dy) / sum(f) AS cy, sum(f * dx) / sum(f) AS cx, sum(f * dy * dy) / sum(f) AS yy, sum(f * dx * dx) / sum(f) AS xx, sum(f * dy * dx) / sum(f) AS xy FROM (SELECT *, greatest(v - m, 0) AS f FROM n) GROUP BY 1, 2, 3, 4 HAVING sum(f) > 0),
e AS (SELECT *, (yy - cy * cy + xx - cx * cx) / 2 AS h, sqrt((yy - cy * cy - xx + cx * cx) ** 2 / 4 + (xy - cx * cy) ** 2) AS d FROM s)
SELECT frame_id, rank, round(py + cy, 5) AS cy, round(qx + cx, 5) AS cx, round(flux, 2) AS flux FROM e WHERE peak / flux <= 0.8 AND (h - d) / greatest(h + d, 1e-12) >= 0.15"""


# values within 2.5 sigma of their frame's median
def _kept(px: DataFrame) -> DataFrame:
    w = Window.partitionBy("frame_id")
    m = px.withColumn("m", F.median("v").over(w)).withColumn("s", MAD_TO_SIGMA * F.median(F.abs(F.col("v") - F.col("m"))).over(w))
    return m.where((F.col("s") <= 0) | (F.abs(F.col("v") - F.col("m")) <= 2.5 * F.col("s"))).groupBy("frame_id").agg(F.count("*").alias("n"), F.round(F.median("v"), 6).alias("med"))


on_px("n4_mad_clip", _kept, ", a AS (SELECT *, median(v) OVER (PARTITION BY frame_id) AS m FROM px), b AS (SELECT *, 1.4826 * median(abs(v - m)) OVER (PARTITION BY frame_id) AS s FROM a) SELECT frame_id, count(*) AS n, round(median(v), 6) AS med FROM b WHERE s <= 0 OR abs(v - m) <= 2.5 * s GROUP BY 1")


# every pixel stands in for a star
def _stars(px: DataFrame) -> DataFrame:
    rgb = B.debayer(px)
    return rgb.select("frame_id", F.struct("y", "x").alias("id"), (F.col("r") / F.col("g")).alias("img_r"), (F.col("b") / F.col("g")).alias("img_b"), (0.5 + F.col("x") / 10).alias("cat_r"), (1.5 - F.col("x") / 20).alias("cat_b"))


GAINS_SQL = f"""{RGB_SQL}, p AS (SELECT frame_id, 'r' AS c, y * 64 + x AS id, 0.5::DOUBLE + x / 10 AS cat, r / g AS img FROM rgb WHERE r / g > 0 AND b / g > 0 UNION ALL SELECT frame_id, 'b', y * 64 + x, 1.5::DOUBLE - x / 20, b / g FROM rgb WHERE r / g > 0 AND b / g > 0),
sl AS (SELECT frame_id, c, median(s) AS slope FROM (SELECT a.frame_id, a.c, a.id, median((b.img - a.img) / (b.cat - a.cat)) AS s FROM p a JOIN p b ON a.frame_id = b.frame_id AND a.c = b.c AND a.cat <> b.cat GROUP BY 1, 2, 3) GROUP BY 1, 2),
ln AS (SELECT frame_id, c, any_value(slope) AS slope, median(img - slope * cat) AS icept, median(cat) AS white, count(*) AS n FROM p JOIN sl USING (frame_id, c) GROUP BY 1, 2),
kk AS (SELECT *, least(greatest(1 / (icept + slope * white), 1e-3), 3) AS k FROM ln),
dd AS (SELECT frame_id, c, k, n, ln(cat) - ln(k * img) AS d FROM p JOIN kk USING (frame_id, c)), dm AS (SELECT *, median(d) OVER (PARTITION BY frame_id, c) AS m FROM dd),
rr AS (SELECT frame_id, c, any_value(k) AS k, any_value(n) AS n, 1.4826 * median(abs(d - m)) AS rms FROM dm GROUP BY 1, 2),
gg AS (SELECT frame_id, max(k) FILTER (c = 'r') AS kr, max(k) FILTER (c = 'b') AS kb, max(n) AS n_stars, max(rms) AS rms FROM rr GROUP BY 1),
g AS (SELECT *, kr * kb AS determinant, greatest(kr, 1, kb) / least(kr, 1, kb) AS condition FROM gg)"""
on_px("p6_colour_matrix", lambda px: C.gains(_stars(px)).select("frame_id", "n_stars", "reason", *(F.round(c, 5).alias(c) for c in ("kr", "kb", "rms", "determinant", "condition"))), f"{GAINS_SQL} SELECT frame_id, n_stars, round(kr, 5) AS kr, round(kb, 5) AS kb, round(rms, 5) AS rms, round(determinant, 5) AS determinant, round(condition, 5) AS condition, CASE WHEN n_stars < 3 THEN 'few stars' WHEN determinant <= 0 THEN 'determinant' WHEN condition > 3 THEN 'condition' WHEN rms > 0.35 THEN 'residual' END AS reason FROM g")
_GRID = f"(SELECT unnest([{', '.join(map(str, C.STRENGTHS))}])::DOUBLE AS alpha)"
_SIGMA = "CASE WHEN was > 0 THEN now / was - 1 ELSE 0 END"
on_px("p7_damping", lambda px: C.damp(B.debayer(px).where("r < 70000 and g < 70000 and b < 70000"), C.gains(_stars(px)).select("frame_id", "kr", "kb"), 20000.0, 60000.0), f"""{GAINS_SQL}, bg AS (SELECT rgb.*, kr, kb FROM rgb JOIN g USING (frame_id) WHERE r < 70000 AND rgb.g < 70000 AND b < 70000),
u AS (SELECT frame_id, 'r' AS c, r AS v, g AS gr, kr AS k FROM bg UNION ALL SELECT frame_id, 'b', b, g, kb FROM bg), st AS (SELECT *, least(greatest((v - 20000) / 40000, 0), 1) AS t FROM u),
sd AS (SELECT frame_id, c, alpha, round(stddev_pop(ln(v / gr)), 9) AS was, round(stddev_pop(ln(v * (1 + t * t * (3 - 2 * t) * alpha * (k - 1)) / gr)), 9) AS now FROM st, {_GRID} GROUP BY 1, 2, 3),
ch AS (SELECT frame_id, c, alpha, {_SIGMA} AS d FROM sd WHERE {_SIGMA} <= 0.08),
pr AS (SELECT a.frame_id, a.alpha AS alpha_r, b.alpha AS alpha_b, a.d AS dr, b.d AS db, greatest(a.d, 0) + greatest(b.d, 0) AS worse, greatest(-a.d, 0) + greatest(-b.d, 0) AS better FROM ch a JOIN ch b ON a.frame_id = b.frame_id AND a.c = 'r' AND b.c = 'b'),
sc AS (SELECT *, dr <= 0.01 AND db <= 0.01 AS inside, CASE WHEN dr <= 0.01 AND db <= 0.01 THEN (alpha_r + alpha_b) / 2 + 0.6 * better - 0.8 * abs(dr - db) - 0.2 * worse
ELSE 1.25 * (alpha_r + alpha_b) / 2 - 4.5 * worse - 1.4 * abs(dr - db) - 0.35 * (abs(dr) + abs(db)) + 0.7 * better END AS score FROM pr)
SELECT frame_id, alpha_r, alpha_b FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY inside DESC, round(score, 6) DESC, alpha_r DESC, alpha_b DESC) AS nth FROM sc) WHERE nth = 1""")


@query("s19_plate_solution", "SELECT n_name AS source, (n_nationkey + 0.5)::DOUBLE AS crval1, (-2.0 * (n_nationkey + 1))::DOUBLE AS crval2, 512.5::DOUBLE AS crpix1, 384.0::DOUBLE AS crpix2, 1025::BIGINT AS naxis1, 768::BIGINT AS naxis2, round(-0.001 * cos(radians(n_nationkey + 1)), 9) AS cd1_1, round(-0.001 * sin(radians(n_nationkey + 1)), 9) AS cd1_2, round(-0.001 * sin(radians(n_nationkey + 1)), 9) AS cd2_1, round(0.001 * cos(radians(n_nationkey + 1)), 9) AS cd2_2 FROM nation")
def _plate(s, d):
    k = F.col("n_nationkey").cast("string")
    cards = [F.concat(F.lit("CRVAL1  = "), k, F.lit(".5 / degrees")), F.concat(F.lit("CRVAL2  =  "), ((F.col("n_nationkey") + 1) * -2).cast("string"), F.lit(".0")), *map(F.lit, ("CRPIX1  = 512.5", "CRPIX2  = 3.84D2 / pixel", "NAXIS2  = 768", "CDELT1  = -1.0E-3", "CDELT2  = 1.0E-3", "no card")), F.concat(F.lit("CROTA2  = "), (F.col("n_nationkey") + 1).cast("string"))]
    out = S.plate_solution(table(s, d, "nation").select(F.col("n_name").alias("source"), F.explode(F.array(*cards)).alias("line")))
    return out.select("source", "crval1", "crval2", "crpix1", "crpix2", "naxis1", "naxis2", *(F.round(c, 9).alias(c) for c in ("cd1_1", "cd1_2", "cd2_1", "cd2_2")))


@query("s17_tab_rows", "SELECT n_regionkey AS source, n_nationkey AS line_no, n_name AS name, CAST(n_nationkey AS VARCHAR) AS id FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS nth FROM nation WHERE n_nationkey % 7 <> 3) WHERE nth > 3 AND n_nationkey % 5 <> 4")
def _tabs(s, d):
    k = F.col("n_nationkey")
    line = F.when(k % 7 == 3, F.concat(F.lit("#"), "n_name")).when(k % 5 == 4, F.col("n_name")).otherwise(F.concat("n_name", F.lit("\t"), k.cast("string")))
    return S.tab_rows(table(s, d, "nation").select(F.col("n_regionkey").alias("source"), k.alias("line_no"), line.alias("line")), ["name", "id"])
