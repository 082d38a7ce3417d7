"""Guarded backgrounds of colour frames, star fluxes, colour runs, catalog sources, cluster reports: with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.functions.robust import round6
from starloom.operators import background as G
from starloom.operators import blocks as B
from starloom.operators import frames as O
from starloom.operators import photometry as P
from starloom.operators import stars as S
from starloom.plans.analytics import _labels, part
from starloom.plans.colour import GAINS_SQL
from starloom.plans.stencils import RGB_SQL
from starloom.registry import SQL, on_px, query
from starloom.sources.frames import PX_SQL, SIDE, table


def _rgb(px: DataFrame) -> DataFrame:
    """Pixels with all three colours."""
    return B.debayer(px).dropna()


_RGB = RGB_SQL.replace("rgb AS", "rgb0 AS", 1) + ", rgb AS (SELECT * FROM rgb0 WHERE r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL)"


def _sky(rgb: DataFrame) -> DataFrame:
    """The darker three fifths of a frame, by green; a pixel at the quantile, but for rounding, is in."""
    return rgb.join(rgb.groupBy("frame_id").agg((F.percentile("g", 0.6) * (1 + 1e-9)).alias("q")), "frame_id").where(F.col("g") <= F.col("q")).select("frame_id", "y", "x")


_SKY = "q AS (SELECT frame_id, quantile_cont(g, 0.6) * (1 + 1e-9::DOUBLE) AS qg FROM rgb GROUP BY 1)"


# a plane off every channel, all three or none, then the scatter of the sky's colours
def _guarded(px: DataFrame) -> DataFrame:
    rgb, key = _rgb(px), ("frame_id", "channel")
    long = rgb.unpivot(["frame_id", "y", "x"], list("rgb"), "channel", "v")
    at = lambda c: (F.floor(F.col(c) / O.CELL) * O.CELL + 1.5).alias(c)
    cells = long.groupBy(*key, at("y"), at("x")).agg(F.median("v").alias("v"))
    flat = G.subtract(G.plane(long, cells, key), O.CELL, steep=1.08, key=key, together=("frame_id",))
    wide = flat.groupBy("frame_id", "y", "x").agg(*(F.max(F.when(F.col("channel") == c, F.col("v"))).alias(c) for c in "rgb"))
    return G.chroma_guard(rgb, wide, _sky(rgb)).select("frame_id", "y", "x", *(F.round(c, 3).alias(c) for c in "rgb"), "chroma_ok")


_DET = "(covar_pop(x, x) * covar_pop(y, y) - covar_pop(x, y) * covar_pop(x, y))"
_SX = "(covar_pop(x, {0}) * covar_pop(y, y) - covar_pop(y, {0}) * covar_pop(x, y))"
_SY = "(covar_pop(y, {0}) * covar_pop(x, x) - covar_pop(x, {0}) * covar_pop(x, y))"
_STEEP = f"sqrt({_SX} * {_SX} + {_SY} * {_SY}) / abs({_DET})"
_STD = "stddev_pop(ln(CASE WHEN {0} > 0 THEN {0} END / CASE WHEN {1} > 0 THEN {1} END)) FILTER (g <= qg)"
on_px("b9_guarded_background", _guarded, f"""{_RGB}, {_SKY}, ch AS (SELECT frame_id, y, x, 'r' AS c, r AS v FROM rgb UNION ALL SELECT frame_id, y, x, 'g', g FROM rgb UNION ALL SELECT frame_id, y, x, 'b', b FROM rgb),
ce AS (SELECT frame_id, c, y // {O.CELL} * {O.CELL} + 1.5::DOUBLE AS y, x // {O.CELL} * {O.CELL} + 1.5::DOUBLE AS x, median(v) AS v FROM ch GROUP BY 1, 2, 3, 4),
pl AS (SELECT frame_id, c, {_SX.format('v')} / {_DET} AS sx, {_SY.format('v')} / {_DET} AS sy, avg(y) AS y0, avg(x) AS x0, avg(v) AS v0 FROM ce GROUP BY 1, 2),
mo AS (SELECT ch.*, v0 + sx * (x - x0) + sy * (y - y0) AS model FROM ch JOIN pl USING (frame_id, c)), mv AS (SELECT *, v - model + median(model) OVER (PARTITION BY frame_id, c) AS nv FROM mo),
bl AS (SELECT frame_id, c, y // {O.CELL} AS y, x // {O.CELL} AS x, median(v) AS o, median(nv) AS n FROM mv GROUP BY 1, 2, 3, 4),
gu AS (SELECT frame_id, quantile_cont(n, 0.9) - quantile_cont(n, 0.1) <= 1.15 * (quantile_cont(o, 0.9) - quantile_cont(o, 0.1)) AND {_STEEP.format('n')} <= 1.08 * {_STEEP.format('o')} AS ok FROM bl GROUP BY frame_id, c), ap AS (SELECT frame_id, bool_and(ok) AS applied FROM gu GROUP BY 1),
w AS (SELECT frame_id, y, x, {', '.join(f"max(CASE WHEN applied THEN nv ELSE v END) FILTER (c = '{c}') AS n{c}" for c in 'rgb')} FROM mv JOIN ap USING (frame_id) GROUP BY 1, 2, 3), pr AS (SELECT * FROM rgb JOIN w USING (frame_id, y, x) JOIN q USING (frame_id)),
ok AS (SELECT frame_id, {_STD.format('nr', 'ng')} <= 1.08 * {_STD.format('r', 'g')} AND {_STD.format('nb', 'ng')} <= 1.08 * {_STD.format('b', 'g')} AS chroma_ok FROM pr GROUP BY 1)
SELECT frame_id, y, x, {', '.join(f'round(CASE WHEN chroma_ok THEN n{c} ELSE {c} END, 3) AS {c}' for c in 'rgb')}, chroma_ok FROM pr JOIN ok USING (frame_id)""")


def _measured(px: DataFrame) -> DataFrame:
    q = F.percentile("g", 0.6).over(O.Window.partitionBy("frame_id"))
    rgb = _rgb(px).withColumn("calm", F.col("g") <= q * (1 + 1e-9))  # as _sky, without another pass over rgb
    stars = O.local_maxima(px, 0.5, 12).select("frame_id", "rank", F.col("y").alias("py"), F.col("x").alias("px_"))
    return P.measure_stars(rgb, stars, "calm", SIDE, SIDE)


_TOPS = ", ".join(f"quantile_cont({c}, 0.999) AS t{c}" for c in "rgb")
_MEASURED = f"""{_RGB}, {_SKY}, st AS (SELECT frame_id, rank, y AS py, x AS qx FROM {{stars}} WHERE y BETWEEN 5 AND {SIDE - 6} AND x BETWEEN 5 AND {SIDE - 6}),
fr AS (SELECT frame_id, {_TOPS}, count(*) FILTER (g <= qg) / count(*) AS share FROM rgb JOIN q USING (frame_id) GROUP BY 1),
di AS (SELECT st.*, r, g, b, g <= qg AS calm, sqrt((y - py) ** 2 + (x - qx) ** 2) AS d, greatest(abs(y - py), abs(x - qx)) AS box FROM st JOIN rgb ON rgb.frame_id = st.frame_id AND abs(y - py) <= 3 AND abs(x - qx) <= 3 JOIN q ON q.frame_id = st.frame_id),
ag AS (SELECT frame_id, rank, {', '.join(f"max({c}) FILTER (box <= 1) AS p{c}, sum({c}) FILTER (d <= 1.5) - count(*) FILTER (d <= 1.5) * median({c}) FILTER (d BETWEEN 2 AND 3) AS f{c}" for c in 'rgb')}, count(*) FILTER (d <= 1.5) AS k, count(*) FILTER (d BETWEEN 2 AND 3) AS n, count(*) FILTER (calm AND d BETWEEN 2 AND 3) AS safe FROM di GROUP BY 1, 2),
va AS (SELECT frame_id, rank, fr AS flux_r, fg AS flux_g, fb AS flux_b, safe >= least(greatest(0.25 + 0.5 * share, 0.25), 0.55) * n AS calm FROM ag JOIN fr USING (frame_id) WHERE pr < 0.995 * tr AND pg < 0.995 * tg AND pb < 0.995 * tb AND k >= 0.5 * {P._offsets(0, 1.5)} AND n >= 0.3 * {P._offsets(2, 3)} AND n >= 10 AND fr > 0 AND fg > 0 AND fb > 0),
ca AS (SELECT *, count(*) FILTER (calm) OVER (PARTITION BY frame_id) AS n0, count(*) OVER (PARTITION BY frame_id) AS n1 FROM va), ms AS (SELECT frame_id, rank, flux_r, flux_g, flux_b, n0 < 3 AND n1 > n0 AS relaxed FROM ca WHERE calm OR (n0 < 3 AND n1 > n0))"""
_MEASURED = _MEASURED.replace("{stars}", part("k2_top_maxima").replace("m + s)", "m + 0.5 * s)").replace("rank <= 3", "rank <= 12"))
on_px("p3_star_fluxes", lambda px: _measured(px).select("frame_id", "rank", *(F.round(f"flux_{c}", 2).alias(f"flux_{c}") for c in "rgb"), "relaxed"), f"{_MEASURED} SELECT frame_id, rank, round(flux_r, 2) AS flux_r, round(flux_g, 2) AS flux_g, round(flux_b, 2) AS flux_b, relaxed FROM ms")


def _run(px: DataFrame) -> DataFrame:
    catalog = px.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("rank"), (0.6 + F.col("id") / 20).alias("cat_r"), (1.4 - F.col("id") / 30).alias("cat_b"))
    return P.colour_run(_measured(px), catalog, px).withColumns({c: F.round(c, 5) for c in ("kr", "kb")})


_REASON = "CASE WHEN n_stars IS NULL OR n_stars < 3 THEN 'few stars' WHEN coalesce(determinant <= 0, TRUE) THEN 'determinant' WHEN condition > 3 THEN 'condition' WHEN rms > 0.35 THEN 'residual' END"
on_px("p9_colour_run", _run, f"""{_MEASURED}, p AS (SELECT frame_id, 'r' AS c, rank AS id, 0.6::DOUBLE + rank / 20 AS cat, flux_r / flux_g AS img FROM ms UNION ALL SELECT frame_id, 'b', rank, 1.4::DOUBLE - rank / 30, flux_b / flux_g FROM ms),
sl AS{GAINS_SQL.split("sl AS", 1)[1]}, al AS (SELECT frame_id, n_stars, kr, kb, {_REASON} AS reason FROM (SELECT DISTINCT frame_id FROM px) LEFT JOIN g USING (frame_id))
SELECT frame_id, coalesce(n_stars, 0) AS n_stars, round(CASE WHEN reason IS NULL THEN kr ELSE 1 END, 5) AS kr, round(CASE WHEN reason IS NULL THEN kb ELSE 1 END, 5) AS kb, reason IS NULL AS applied, reason FROM al""")


@query("p1_first_source", """WITH e AS (SELECT user_id AS field, event_id, event_type AS source, list_position(['purchase', 'error', 'click'], event_type) AS p FROM events WHERE event_type IN ('purchase', 'error', 'click'))
SELECT field, event_id, source FROM (SELECT *, min(p) OVER (PARTITION BY field) AS best FROM e) WHERE p = best""")
def _source(s, d):
    return P.first_source(table(s, d, "events").select(F.col("user_id").alias("field"), "event_id", F.col("event_type").alias("source")), ["purchase", "error", "click"]).select("field", "event_id", "source")


# report of the clusters: sizes, shares and weights
on_px("v6_cluster_report", lambda px: (lambda c: c.groupBy("label").agg(F.count("*").alias("n"), F.min("frame_id").alias("first_frame"), *(round6(f("weight")).alias(n) for n, f in (("lo", F.min), ("med", F.median), ("hi", F.max), ("mean", F.avg)))))(_labels(px)), None)
SQL["v6_cluster_report"] = f"SELECT label, count(*) AS n, min(frame_id) AS first_frame, round(min(weight), 6) AS lo, round(median(weight), 6) AS med, round(max(weight), 6) AS hi, round(avg(weight), 6) AS mean FROM {part('w6_quantile_labels')} JOIN {part('w3_global_weights')} USING (frame_id) GROUP BY 1"
on_px("v6_overlap_report", lambda px: px.groupBy("y", "x").agg(F.count("*").alias("covered")).groupBy("covered").agg(F.count("*").alias("pixels")), None)
SQL["v6_overlap_report"] = f"WITH {PX_SQL} SELECT covered, count(*) AS pixels FROM (SELECT y, x, count(*) AS covered FROM px GROUP BY 1, 2) GROUP BY 1"


# stars in patches: no SQL, tests hold them against planted stars and plain Python
def _tiles(px: DataFrame) -> DataFrame:
    return S.typed_weights(S.tile_metrics(O.tile_of(px, SIDE).select("frame_id", "trow", "tcol", "y", "x", "v")), 1)


on_px("n6_frame_stars", lambda px: (lambda f: f.select("frame_id", "star_count", *(F.round(c, 4).alias(c) for c in f.columns[2:])))(S.frame_stars(px, r=3, apart=2)), None)
on_px("n7_tile_metrics", lambda px: _tiles(px).withColumns({c: F.round(c, 4) for c in (*S.TILE_METRICS, "weight")}), None)
on_px("a18_nine_medians", lambda px: S.tile_summary(_tiles(px)).withColumns({c: F.round(c, 4) for c in S.TILE_METRICS}), None)
on_px("b1_sky_tiles", lambda px: S.sky_tiles(S.tile_summary(_tiles(px))).select("trow", "tcol", "kind", "star_count"), None)
