"""Weights, tiles, clusters, photometry and reports: relational plans with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.catalog import LINE_SQL, METRICS_SQL, STARS_SQL, TILES_SQL, line_of, stack_sql
from starloom.functions.robust import clip, floor_rank, nearest_rank, round6, upper_median
from starloom.operators import frames as O
from starloom.operators import joins as J
from starloom.registry import SQL, on_px, query
from starloom.sources.frames import COMMON, PX_SQL, SIDE, table

def by_frame():
    return Window.partitionBy("frame_id")


def along_row():
    return Window.partitionBy("frame_id", "y").orderBy("x")


def part(name: str) -> str:
    """The SQL of another query, for use within this one's."""
    return f"({SQL[name]})"


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in names})


def local(px: DataFrame) -> DataFrame:
    return longs(O.local_weights(px, SIDE), "trow", "tcol")


# projections and predicates
on_px("f2_output_scale", lambda px: px.withColumn("b", F.median("v").over(by_frame())).select("frame_id", "y", "x", F.round(F.col("v") / F.col("b") * F.when((F.col("y") % 2 == 0) & (F.col("x") % 2 == 0), 1000.0).otherwise(800.0) + 32, 5).alias("v")), "SELECT frame_id, y, x, round(v / median(v) OVER (PARTITION BY frame_id) * CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN 1000 ELSE 800 END + 32, 5) AS v FROM px")
on_px("f3_normalize_to", lambda px: px.withColumn("b", F.median("v").over(by_frame())).select("frame_id", "y", "x", round6(F.col("v") * 1000 / F.greatest("b", F.lit(1e-6))).alias("scaled"), round6(F.col("v") + 1000 - F.col("b")).alias("shifted")), "SELECT frame_id, y, x, round(v * 1000 / greatest(median(v) OVER f, 1e-6), 6) AS scaled, round(v + 1000 - median(v) OVER f, 6) AS shifted FROM px WINDOW f AS (PARTITION BY frame_id)")
on_px("f4_valid", lambda px: px.select("frame_id", "y", "x", F.when(~F.isnan("v") & (F.col("v") > 40000), round6(F.col("v"))).alias("v")), "SELECT frame_id, y, x, CASE WHEN NOT isnan(v) AND v > 40000 THEN round(v, 6) END AS v FROM px")
on_px("f5_canvas_mask", lambda px: px.join(px.groupBy("y", "x").agg(F.count("*").alias("n")).where(f"n >= {COMMON}"), ["y", "x"], "left").select("frame_id", "y", "x", F.when(F.col("n").isNotNull(), round6(F.col("v"))).otherwise(0.0).alias("v")), f"SELECT frame_id, y, x, CASE WHEN count(*) OVER (PARTITION BY y, x) >= {COMMON} THEN round(v, 6) ELSE 0 END AS v FROM px")
on_px("f8_probe_frames", lambda px: O.sampled(px, 5).where(F.col("y").between(4, 11) & F.col("x").between(4, 11)).select("frame_id", "y", "x", round6(F.col("v")).alias("v")), "SELECT frame_id, y, x, round(v, 6) AS v FROM px WHERE frame_id IN (SELECT CAST(floor(i * hi / 4.0 + 0.5) AS BIGINT) FROM (SELECT max(frame_id) AS hi FROM px), range(5) t(i)) AND y BETWEEN 4 AND 11 AND x BETWEEN 4 AND 11")
on_px("f9_frame_limit", lambda px: px.where("frame_id < 3").groupBy("frame_id").agg(F.count("*").alias("n")), "SELECT frame_id, count(*) AS n FROM px WHERE frame_id < 3 GROUP BY 1")


@query("f10_colour_mode", """SELECT o_orderkey, CASE WHEN split_part(o_orderpriority, '-', 1) IN ('1', '2') THEN 'OSC' WHEN lower(o_orderpriority) LIKE '%not%' THEN 'MONO' WHEN o_orderkey % 2 = 0 AND o_custkey % 2 = 0 THEN 'RGGB' ELSE 'UNKNOWN' END AS mode FROM orders""")
def _colour(s, d):
    p = F.col("o_orderpriority")
    even = (F.col("o_orderkey") % 2 == 0) & (F.col("o_custkey") % 2 == 0)
    return table(s, d, "orders").select("o_orderkey", F.when(F.substring_index(p, "-", 1).isin("1", "2"), "OSC").when(F.lower(p).contains("not"), "MONO").when(even, "RGGB").otherwise("UNKNOWN").alias("mode"))


# aggregations
on_px("a16_tile_coverage", lambda px: longs(O.tile_of(O.coverage(px, COMMON), SIDE).groupBy("trow", "tcol").agg(round6(F.avg(F.col("common").cast("double"))).alias("ratio")), "trow", "tcol"), f", c AS (SELECT y, x, count(*) >= {COMMON} AS common FROM px WHERE v > 0 GROUP BY 1, 2), {TILES_SQL.replace('px.*', 'c.*').replace('FROM px,', 'FROM c,')} SELECT trow, tcol, round(avg(common::INT), 6) AS ratio FROM t GROUP BY 1, 2")
on_px("a17_tile_quality", lambda px: local(px).groupBy("frame_id").agg(F.round(F.avg("weight"), 5).alias("mean"), F.round(F.var_pop("weight"), 5).alias("var")), None)
SQL["a17_tile_quality"] = f"SELECT frame_id, round(avg(weight), 5) AS mean, round(var_pop(weight), 5) AS var FROM {part('w4_local_weights')} GROUP BY 1"
on_px("a18_tile_medians", lambda px: longs(O.tile_of(px, SIDE).groupBy("frame_id", "trow", "tcol").agg(F.count("*").alias("n"), round6(F.median("v")).alias("med")).groupBy("trow", "tcol").agg(round6(F.median("med")).alias("med"), F.round(F.median("n")).cast("long").alias("n"), F.when(F.count_if(F.col("med") > 50000) * 2 >= F.count("*"), "STAR").otherwise("STRUCTURE").alias("kind")), "trow", "tcol"), None)
SQL["a18_tile_medians"] = f"SELECT trow, tcol, round(median(med), 6) AS med, CAST(round(median(n)) AS BIGINT) AS n, CASE WHEN count(*) FILTER (med > 50000) * 2 >= count(*) THEN 'STAR' ELSE 'STRUCTURE' END AS kind FROM {part('j1_tile_pixels')} GROUP BY 1, 2"


def _labels(px):
    m = O.metrics(px)
    return O.quantile_labels(m.select("frame_id", "noise"), "noise", 4).select("frame_id", "label").join(O.global_weights(m), "frame_id")


on_px("a20_cluster_quality", lambda px: _labels(px).groupBy("label").agg(F.count("*").alias("n"), F.round(F.median(clip(F.ln(F.greatest("weight", F.lit(1e-6))), -3.0, 3.0)), 5).alias("quality")), None)
SQL["a20_cluster_quality"] = f"SELECT label, count(*) AS n, round(median(least(greatest(ln(greatest(weight, 1e-6)), -3), 3)), 5) AS quality FROM {part('w6_quantile_labels')} JOIN {part('w3_global_weights')} USING (frame_id) GROUP BY 1"
on_px("a22_weight_variance", lambda px: local(px).groupBy("trow", "tcol").agg(F.avg("weight").alias("w")).agg(F.round(F.var_pop("w") / (F.avg("w") * F.avg("w") + 1e-12), 6).alias("variance")), None)
SQL["a22_weight_variance"] = f"SELECT round(var_pop(w) / (avg(w) ** 2 + 1e-12), 6) AS variance FROM (SELECT avg(weight) AS w FROM {part('w4_local_weights')} GROUP BY trow, tcol)"


@query("a28_scan_score", "SELECT user_id, round(greatest(0, 1 - 0.25 * count(*) FILTER (event_type = 'error') - 0.1 * count(*) FILTER (event_type = 'signup')), 4) AS score FROM events GROUP BY 1")
def _score(s, d):
    kind = F.col("event_type")
    return table(s, d, "events").groupBy("user_id").agg(F.round(F.greatest(F.lit(0.0), 1 - 0.25 * F.count_if(kind == "error") - 0.1 * F.count_if(kind == "signup")), 4).alias("score"))


@query("a27_merged_scan", "SELECT n_name AS folder, count(*) AS frames, CAST(count(*) FILTER (bal < 0) AS BIGINT) AS errors FROM (SELECT c_nationkey AS k, c_acctbal AS bal FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier) JOIN nation ON n_nationkey = k GROUP BY 1")
def _merged(s, d):
    both = table(s, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("bal")).unionByName(table(s, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("bal")))
    sums = both.groupBy("k").agg(F.count("*").alias("frames"), F.count_if(F.col("bal") < 0).alias("errors"))
    return sums.join(table(s, d, "nation"), sums.k == F.col("n_nationkey")).groupBy(F.col("n_name").alias("folder")).agg(F.sum("frames").alias("frames"), F.sum("errors").alias("errors"))


on_px("a29_line_means", lambda px: px.withColumn("g", F.abs(F.coalesce(F.lead("v").over(along_row()), "v") - F.coalesce(F.lag("v").over(along_row()), "v")) / 2).groupBy("x").agg(F.round(F.avg("g"), 3).alias("mean")), "SELECT x, round(avg(g), 3) AS mean FROM (SELECT x, abs(coalesce(lead(v) OVER r, v) - coalesce(lag(v) OVER r, v)) / 2 AS g FROM px WINDOW r AS (PARTITION BY frame_id, y ORDER BY x)) GROUP BY 1")
on_px("a30_seam_summary", lambda px: O.seams(px, SIDE).agg(F.count("*").alias("pairs"), F.round(F.avg("mean_abs"), 3).alias("mean"), round6(nearest_rank(F.col("mean_abs"), 0.95)).alias("p95"), round6(F.max("mean_abs")).alias("worst")), None)
SQL["a30_seam_summary"] = f"SELECT count(*) AS pairs, round(avg(mean_abs), 3) AS mean, round(list_sort(list(mean_abs))[CAST(floor(0.95 * (count(*) - 1) + 0.5) AS INT) + 1], 6) AS p95, round(max(mean_abs), 6) AS worst FROM {part('r10_tile_seams')}"
on_px("k4_worst_seams", lambda px: longs(O.seams(px, SIDE).select("r1", "c1", "r2", "c2", "mean_abs").orderBy(F.col("mean_abs").desc(), "r1", "c1", "r2", "c2").limit(3), "r1", "c1", "r2", "c2"), None)
SQL["k4_worst_seams"] = f"SELECT r1, c1, r2, c2, mean_abs FROM {part('r10_tile_seams')} ORDER BY mean_abs DESC, r1, c1, r2, c2 LIMIT 3"
on_px("a31_strided_quantiles", lambda px: px.where("y % 4 = 0 AND x % 4 = 0 AND v > 0").groupBy("frame_id").agg(round6(floor_rank(F.col("v"), 0.25)).alias("q25"), round6(floor_rank(F.col("v"), 0.999)).alias("q999"), round6(upper_median(F.col("v"))).alias("med")), """, s AS (SELECT frame_id, list_sort(list(v)) AS l, count(*) AS n FROM px WHERE y % 4 = 0 AND x % 4 = 0 AND v > 0 GROUP BY 1)
SELECT frame_id, round(l[CAST(floor(0.25 * (n - 1)) AS INT) + 1], 6) AS q25, round(l[CAST(floor(0.999 * (n - 1)) AS INT) + 1], 6) AS q999, round(l[CAST(floor(n / 2) AS INT) + 1], 6) AS med FROM s""")
on_px("a11_basic_stats", lambda px: px.groupBy("frame_id").agg(F.count("v").alias("n"), F.round(F.avg("v"), 4).alias("mean"), round6(F.percentile("v", 0.01)).alias("p01"), round6(F.percentile("v", 0.99)).alias("p99")), "SELECT frame_id, count(v) AS n, round(avg(v), 4) AS mean, round(quantile_cont(v, 0.01), 6) AS p01, round(quantile_cont(v, 0.99), 6) AS p99 FROM px GROUP BY 1")
_SHAPE = "(p99 - p50) / (p50 - p01)"


def _linearity(px):
    q = px.groupBy("frame_id").agg(*(nearest_rank(F.col("v"), p).alias(n) for n, p in (("p01", 0.01), ("p05", 0.05), ("p50", 0.5), ("p95", 0.95), ("p99", 0.99))), (F.stddev_pop("v") / F.avg("v")).alias("cv"))
    return q.select("frame_id", F.round((F.col("p99") - F.col("p50")) / (F.col("p50") - F.col("p01")), 5).alias("skew"), F.round((F.col("p95") - F.col("p50")) / (F.col("p50") - F.col("p05")), 5).alias("kurt"), F.round("cv", 5).alias("cv"))


_NR = "list_sort(list(v))[CAST(floor({} * (count(*) - 1) + 0.5) AS INT) + 1] AS {}"
on_px("a24_linearity_moments", _linearity, f""", q AS (SELECT frame_id, {', '.join(_NR.format(p, n) for n, p in (('p01', 0.01), ('p05', 0.05), ('p50', 0.5), ('p95', 0.95), ('p99', 0.99)))}, stddev_pop(v) / avg(v) AS cv FROM px GROUP BY 1)
SELECT frame_id, round({_SHAPE}, 5) AS skew, round((p95 - p50) / (p50 - p05), 5) AS kurt, round(cv, 5) AS cv FROM q""")
on_px("a25_linear_share", lambda px: _linearity(px).agg(F.round(F.avg(((F.col("skew") < 1.2) & (F.col("kurt") < 1.2)).cast("double")), 5).alias("share")), None)
SQL["a25_linear_share"] = f"SELECT round(avg((skew < 1.2 AND kurt < 1.2)::INT), 5) AS share FROM {part('a24_linearity_moments')}"


# choice of the reference, weights and stacks
def _reference(px):
    g = O.global_weights(O.metrics(px)).withColumn("n", F.count("*").over(Window.partitionBy())).withColumn("rank", F.row_number().over(Window.orderBy(F.col("weight").desc(), "frame_id")))
    top = g.where(F.col("rank") <= F.greatest(F.lit(1), F.least("n", F.greatest(F.lit(16), F.floor(F.col("n") / 5)))))
    return top.orderBy(F.abs(F.col("frame_id") - (F.col("n") - 1) / 2), F.col("weight").desc(), "frame_id").limit(1).select("frame_id", "weight")


on_px("g11_reference", _reference, None)
SQL["g11_reference"] = f"SELECT frame_id, weight FROM (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY weight DESC, frame_id) AS rank FROM {part('w3_global_weights')}) WHERE rank <= greatest(1, least(n, greatest(16, n // 5))) ORDER BY abs(frame_id - (n - 1) / 2), weight DESC, frame_id LIMIT 1"
on_px("r3_weight_fallback", lambda px: local(px).withColumn("w", F.when(F.col("trow") != 1, F.col("weight")).otherwise(0.0)).withColumn("fell", F.sum(F.greatest("w", F.lit(0.0))).over(Window.partitionBy("trow", "tcol")) <= 1e-6).select("frame_id", "trow", "tcol", F.when(F.col("fell"), 1.0).otherwise(F.col("w")).alias("w"), "fell"), None)
SQL["r3_weight_fallback"] = f"SELECT frame_id, trow, tcol, CASE WHEN fell THEN 1.0 ELSE w END AS w, fell FROM (SELECT *, sum(greatest(w, 0)) OVER (PARTITION BY trow, tcol) <= 1e-6 AS fell FROM (SELECT *, CASE WHEN trow <> 1 THEN weight ELSE 0 END AS w FROM {part('w4_local_weights')}))"


def tile_stack(px: DataFrame) -> DataFrame:
    """Each tile's weighted stack; a frame's weight in a tile is its global weight times its local one (1 if none)."""
    w = local(px).withColumnRenamed("weight", "lw").join(O.global_weights(O.metrics(px)).select("frame_id", "weight"), "frame_id")
    t = longs(O.tile_of(px, SIDE), "trow", "tcol").join(w, ["frame_id", "trow", "tcol"], "left")
    return O.stack(t.withColumn("w", F.col("weight") * F.coalesce("lw", F.lit(1.0))), weighted=True, keys=("trow", "tcol", "y", "x"))


_TS = f"WITH {PX_SQL}, {TILES_SQL}, lw AS {part('w4_local_weights')}, gw AS {part('w3_global_weights')}, tw AS (SELECT t.*, gw.weight * coalesce(lw.weight, 1) AS w FROM t JOIN gw USING (frame_id) LEFT JOIN lw USING (frame_id, trow, tcol)){stack_sql(3, 'w', 'trow, tcol, y, x', 'tw')}"
on_px("r5_tile_stack", tile_stack, None)
SQL["r5_tile_stack"] = _TS
on_px("r5_tile_image", lambda px: O.overlap_add(tile_stack(px)), None)
SQL["r5_tile_image"] = f"SELECT y, x, CASE WHEN ws > 1e-6 THEN round(vs / ws, 4) END AS v FROM (SELECT y, x, sum(v * w) AS vs, sum(w) AS ws FROM (SELECT *, 0.25 * (1 - cos(2 * pi() * (y - trow * {O.STRIDE}) / {O.TILE - 1})) * (1 - cos(2 * pi() * (x - tcol * {O.STRIDE}) / {O.TILE - 1})) AS w FROM ({_TS})) GROUP BY 1, 2)"


def _tile_norm(px):
    w = Window.partitionBy("frame_id", "trow", "tcol")
    t = longs(O.tile_of(px, SIDE), "trow", "tcol").withColumn("m", F.median("v").over(w)).withColumn("s", F.greatest(F.lit(1e-6), F.median(F.abs(F.col("v") - F.col("m"))).over(w)))
    return t.withColumn("z", (F.col("v") - F.col("m")) / F.col("s"))


_TN = f", {TILES_SQL}, tm AS (SELECT *, median(v) OVER w AS m FROM t WINDOW w AS (PARTITION BY frame_id, trow, tcol)), tz AS (SELECT *, greatest(1e-6, median(abs(v - m)) OVER (PARTITION BY frame_id, trow, tcol)) AS s FROM tm)"
on_px("r7_tile_normalize", lambda px: _tile_norm(px).select("frame_id", "trow", "tcol", "y", "x", F.round("z", 5).alias("z")), f"{_TN} SELECT frame_id, trow, tcol, y, x, round((v - m) / s, 5) AS z FROM tz")


def _restore(px):
    t = _tile_norm(px)
    g = t.groupBy("frame_id", "trow", "tcol").agg(F.first("m").alias("m"), F.first("s").alias("s")).groupBy("frame_id").agg(F.median("m").alias("gm"), F.median("s").alias("gs"))
    return t.groupBy("frame_id", "y", "x").agg(F.avg("z").alias("z")).join(g, "frame_id").select("frame_id", "y", "x", F.round(F.col("z") * F.col("gs") + F.col("gm"), 3).alias("v"))


on_px("r9_global_restore", _restore, f"""{_TN}, g AS (SELECT frame_id, median(m) AS gm, median(s) AS gs FROM (SELECT DISTINCT frame_id, trow, tcol, m, s FROM tz) GROUP BY 1)
SELECT frame_id, y, x, round(avg((v - m) / s) * any_value(gs) + any_value(gm), 3) AS v FROM tz JOIN g USING (frame_id) GROUP BY 1, 2, 3""")


def _synthetic(px):
    labels = _labels(px).select("frame_id", "label", "weight")
    total = labels.groupBy("label").agg(F.sum("weight").alias("total"))
    sums = px.join(labels, "frame_id").where("v > 0").groupBy("label", "y", "x").agg(F.sum(F.col("weight") * F.col("v")).alias("s"))
    return sums.join(total, "label").select("label", "y", "x", F.round(F.col("s") / F.col("total"), 3).alias("v"))


_LAB = f"lab AS (SELECT frame_id, label, weight FROM {part('w6_quantile_labels')} JOIN {part('w3_global_weights')} USING (frame_id))"
on_px("r14_synthetic_frames", _synthetic, f", {_LAB}, tot AS (SELECT label, sum(weight) AS total FROM lab GROUP BY 1) SELECT label, y, x, round(sum(weight * v) / any_value(total), 3) AS v FROM px JOIN lab USING (frame_id) JOIN tot USING (label) WHERE v > 0 GROUP BY 1, 2, 3")
on_px("r16_eligible_clusters", lambda px: _labels(px).groupBy("label").agg(F.count("*").alias("n")).where("n >= 2").orderBy("label").limit(3), f", {_LAB} SELECT label, count(*) AS n FROM lab GROUP BY 1 HAVING n >= 2 ORDER BY label LIMIT 3")
on_px("r13_cluster_fallback", lambda px: _labels(px).select("frame_id", F.when(F.min("label").over(Window.partitionBy()) == 0, F.col("label")).otherwise(-1).alias("label")), f", {_LAB} SELECT frame_id, CASE WHEN min(label) OVER () = 0 THEN label ELSE -1 END AS label FROM lab")
on_px("r11_state_vectors", lambda px: O.metrics(px).select("frame_id", round6(F.col("background")).alias("background"), round6(F.col("noise")).alias("noise")).join(O.global_weights(O.metrics(px)).select("frame_id", "weight"), "frame_id").join(local(px).groupBy("frame_id").agg(F.round(F.avg("weight"), 5).alias("mean"), F.round(F.var_pop("weight"), 5).alias("var")), "frame_id"), None)
SQL["r11_state_vectors"] = f"SELECT frame_id, background, noise, weight, mean, var FROM (SELECT frame_id, background, noise FROM {part('w2_frame_metrics')}) JOIN (SELECT frame_id, weight FROM {part('w3_global_weights')}) USING (frame_id) JOIN {part('a17_tile_quality')} USING (frame_id)"
on_px("r18_validation", lambda px: O.seams(px, SIDE).agg(F.round(F.max("mean_abs") / F.median("mean_abs"), 5).alias("worst"), F.round(nearest_rank(F.col("mean_abs"), 0.95) / F.median("mean_abs"), 5).alias("p95")).withColumn("ok", (F.col("worst") < 1.5) & (F.col("p95") < 1.25)), None)
SQL["r18_validation"] = f"SELECT *, worst < 1.5 AND p95 < 1.25 AS ok FROM (SELECT round(max(mean_abs) / median(mean_abs), 5) AS worst, round(list_sort(list(mean_abs))[CAST(floor(0.95 * (count(*) - 1) + 0.5) AS INT) + 1] / median(mean_abs), 5) AS p95 FROM {part('r10_tile_seams')})"
on_px("n22_plane_slope", lambda px: px.groupBy("frame_id").agg(*(F.covar_pop(a, b).alias(f"{a}{b}") for a, b in (("x", "x"), ("y", "y"), ("x", "y"), ("x", "v"), ("y", "v")))).select("frame_id", F.round((F.col("xv") * F.col("yy") - F.col("yv") * F.col("xy")) / (F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")), 4).alias("sx"), F.round((F.col("yv") * F.col("xx") - F.col("xv") * F.col("xy")) / (F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")), 4).alias("sy")), """, c AS (SELECT frame_id, covar_pop(x, x) AS xx, covar_pop(y, y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, v) AS xv, covar_pop(y, v) AS yv FROM px GROUP BY 1)
SELECT frame_id, round((xv * yy - yv * xy) / (xx * yy - xy * xy), 4) AS sx, round((yv * xx - xv * xy) / (xx * yy - xy * xy), 4) AS sy FROM c""")
on_px("n22_background_spread", lambda px: px.groupBy("frame_id", F.floor(F.col("y") / 4).alias("cy"), F.floor(F.col("x") / 4).alias("cx")).agg(F.median("v").alias("m")).groupBy("frame_id").agg(round6(F.percentile("m", 0.9) - F.percentile("m", 0.1)).alias("spread")), "SELECT frame_id, round(quantile_cont(m, 0.9) - quantile_cont(m, 0.1), 6) AS spread FROM (SELECT frame_id, median(v) AS m FROM px GROUP BY frame_id, y // 4, x // 4) GROUP BY 1")
on_px("n3_psf_moments", lambda px: O.local_maxima(px).where("rank = 1").select("frame_id", F.col("y").alias("py"), F.col("x").alias("px_")).transform(lambda p: J.around(p, px, 3)).groupBy("frame_id").agg(*(F.round(F.sum(F.col("v") * F.pow(F.col(f"d{a}").cast("double"), F.lit(2.0))) / F.sum("v"), 5).alias(f"m{a}{a}") for a in "yx")), None)
SQL["n3_psf_moments"] = f"WITH {PX_SQL}, k AS (SELECT frame_id, y AS py, x AS qx FROM {part('k2_top_maxima')} WHERE rank = 1) SELECT px.frame_id, round(sum(v * (y - py) ** 2) / sum(v), 5) AS myy, round(sum(v * (x - qx) ** 2) / sum(v), 5) AS mxx FROM px JOIN k ON px.frame_id = k.frame_id AND abs(y - py) <= 3 AND abs(x - qx) <= 3 GROUP BY 1"


# background grid and photometry
def _cells(px):
    return px.groupBy(F.floor(F.col("y") / 2).alias("cy"), F.floor(F.col("x") / 2).alias("cx")).agg(F.median("v").alias("v")).withColumn("v", F.when((F.col("cy") * 7 + F.col("cx") * 3) % 5 > 0, round6(F.col("v"))))


_CELL_SQL = ", c AS (SELECT cy, cx, CASE WHEN (cy * 7 + cx * 3) % 5 > 0 THEN round(v, 6) END AS v FROM (SELECT y // 2 AS cy, x // 2 AS cx, median(v) AS v FROM px GROUP BY 1, 2))"
on_px("j9_ring_fill", lambda px: J.ring_fill(_cells(px), 4), f"""{_CELL_SQL}, d AS (SELECT a.cy, a.cx, a.v AS own, b.v, greatest(abs(a.cy - b.cy), abs(a.cx - b.cx)) AS r FROM c a, c b WHERE b.v IS NOT NULL), k AS (SELECT cy, cx, list_sort(list(r))[4] AS r4 FROM d GROUP BY 1, 2)
SELECT cy, cx, round(coalesce(any_value(own), median(v) FILTER (r <= r4)), 6) AS v FROM d JOIN k USING (cy, cx) GROUP BY 1, 2""")
on_px("b6_cv_split", lambda px: _cells(px).where("v is not null").withColumn("i", F.row_number().over(Window.orderBy("cy", "cx")) - 1).select("cy", "cx", (F.col("i") % 5 == 0).alias("held_out")), f"{_CELL_SQL} SELECT cy, cx, (row_number() OVER (ORDER BY cy, cx) - 1) % 5 = 0 AS held_out FROM c WHERE v IS NOT NULL")
on_px("b1_tile_samples", lambda px: longs(O.tile_of(px, SIDE).groupBy("frame_id", "trow", "tcol").agg(F.count("*").alias("n"), F.percentile("v", 0.2).alias("q"), F.stddev_pop("v").alias("e"), F.median("v").alias("m")), "trow", "tcol").where("n >= 60").select("frame_id", "trow", "tcol", round6(F.col("q")).alias("sample"), F.round(clip(F.exp(-2 * F.col("e") / F.col("m")) * F.col("n") / 64, 0.01, 1.0), 5).alias("weight")), f", {TILES_SQL} SELECT frame_id, trow, tcol, round(quantile_cont(v, 0.2), 6) AS sample, round(least(greatest(exp(-2 * stddev_pop(v) / median(v)) * count(*) / 64, 0.01), 1), 5) AS weight FROM t GROUP BY 1, 2, 3 HAVING count(*) >= 60")
on_px("p2_aperture_flux", lambda px: J.aperture_flux(O.local_maxima(px).select("frame_id", "rank", F.col("y").alias("py"), F.col("x").alias("px_")), px, 1.5, 2.0, 4.0, 10), None)
SQL["p2_aperture_flux"] = f"""WITH {PX_SQL}, k AS (SELECT frame_id, rank, y AS py, x AS qx FROM {part('k2_top_maxima')}), d AS (SELECT k.frame_id, k.rank, v, sqrt((y - py) ** 2 + (x - qx) ** 2) AS d FROM px JOIN k ON px.frame_id = k.frame_id AND abs(y - py) <= 4 AND abs(x - qx) <= 4),
s AS (SELECT frame_id, rank, median(v) FILTER (d >= 2 AND d <= 4) AS sky, count(*) FILTER (d >= 2 AND d <= 4) AS n FROM d GROUP BY 1, 2) SELECT frame_id, rank, round(any_value(sky), 6) AS sky, round(sum(v - sky) FILTER (d <= 1.5), 3) AS flux FROM d JOIN s USING (frame_id, rank) WHERE n >= 10 GROUP BY 1, 2"""


def _wloc_sql(rounds: int) -> str:
    """Clip rounds that stop where the spread is nothing, fewer than 3 values would be left, or none goes."""
    g, wm = "PARTITION BY event_type", "min(x) FILTER (keep AND 2 * c >= t)"
    sql = "WITH k0 AS (SELECT event_type, event_id, value AS v, event_id % 7 + 1 AS w, value IS NOT NULL AS keep FROM events)"
    cum = f"SELECT *, sum(CASE WHEN keep THEN w END) OVER ({g} ORDER BY x, event_id) AS c, sum(CASE WHEN keep THEN w END) OVER ({g}) AS t FROM (SELECT *, {{}} AS x FROM {{}})"
    for i in range(rounds):
        sql += f", a{i} AS (SELECT *, {wm} OVER ({g}) AS m FROM ({cum.format('v', f'k{i}')})), b{i} AS (SELECT * EXCLUDE (x, c, t) FROM a{i}), d{i} AS (SELECT *, 1.4826 * ({wm} OVER ({g})) AS mad FROM ({cum.format('abs(v - m)', f'b{i}')}))"
        sql += f", e{i} AS (SELECT *, keep AND abs(v - m) <= 2.5 * mad AS near FROM d{i}), f{i} AS (SELECT *, count(*) FILTER (near) OVER ({g}) AS n, count(*) FILTER (keep) OVER ({g}) AS held FROM e{i})"
        sql += f", k{i + 1} AS (SELECT event_type, event_id, v, w, CASE WHEN mad >= 1e-15 AND n >= 3 AND n < held THEN near ELSE keep END AS keep FROM f{i})"
    return sql + f" SELECT event_type, round(min(x) FILTER (keep AND 2 * c >= t), 5) AS location, CAST(count(*) FILTER (keep) AS BIGINT) AS n FROM ({cum.format('v', f'k{rounds}')}) GROUP BY 1"


@query("p5_robust_location", _wloc_sql(5))
def _location(s, d):
    e = table(s, d, "events").select("event_type", "event_id", F.col("value").alias("v"), F.greatest(F.col("event_id") % 7 + 1, F.lit(1e-9)).alias("w"), F.col("value").isNotNull().alias("keep"))
    group = Window.partitionBy("event_type")

    def middle(df, x, out):
        w = F.when(F.col("keep"), F.col("w"))
        df = df.withColumn("x", x).withColumn("c", F.sum(w).over(group.orderBy("x", "event_id"))).withColumn("t", F.sum(w).over(group))
        return df.withColumn(out, F.min(F.when(F.col("keep") & (2 * F.col("c") >= F.col("t")), F.col("x"))).over(group))

    for _ in range(5):
        e = middle(middle(e, F.col("v"), "m"), F.abs(F.col("v") - F.col("m")), "mad").withColumn("mad", 1.4826 * F.col("mad"))
        e = e.withColumn("near", F.col("keep") & (F.abs(F.col("v") - F.col("m")) <= 2.5 * F.col("mad")))
        e = e.withColumn("n", F.count_if("near").over(group)).withColumn("all", F.count_if("keep").over(group))
        # a group that stops here stops in all later rounds, too; fewer than 3 values, or none clipped, end it
        e = e.withColumn("keep", F.when((F.col("mad") >= 1e-15) & (F.col("n") >= 3) & (F.col("n") < F.col("all")), F.col("near")).otherwise(F.col("keep")))
    return middle(e, F.col("v"), "m").groupBy("event_type").agg(F.round(F.min("m"), 5).alias("location"), F.count_if("keep").alias("n"))


on_px("p6_white_gains", lambda px: line_of(px).select("frame_id", F.round(F.least(1e4 / F.greatest(F.col("intercept") + F.col("slope") * 0.5, F.lit(1e-6)), F.lit(3.0)), 6).alias("gain")), None)
SQL["p6_white_gains"] = f"WITH {PX_SQL} {LINE_SQL}, l AS (SELECT frame_id, any_value(slope) AS slope, median(y - slope * x) AS intercept FROM p JOIN s USING (frame_id) GROUP BY 1) SELECT frame_id, round(least(1e4 / greatest(intercept + slope * 0.5, 1e-6), 3), 6) AS gain FROM l"


# sky, warps, grids
@query("x9_pixel_to_sky", f"""WITH {STARS_SQL}, t AS (SELECT id, radians(ra - 180) / 60 AS xi, radians(dec) / 60 AS eta FROM stars), r AS (SELECT *, sqrt(xi * xi + eta * eta) AS rho FROM t)
SELECT id, round(180 + degrees(atan2(xi, cos(radians(10)) - eta * sin(radians(10)))), 6) AS ra, round(degrees(atan((sin(radians(10)) + eta * cos(radians(10))) / sqrt(xi * xi + (cos(radians(10)) - eta * sin(radians(10))) ** 2))), 6) AS dec FROM r""")
def _sky(s, d):
    from starloom.catalog import _stars

    at = F.radians(F.lit(10.0))
    xi, eta = F.radians(F.col("ra") - 180) / 60, F.radians("dec") / 60
    below = F.cos(at) - eta * F.sin(at)
    return _stars(s, d).select("id", F.round(180 + F.degrees(F.atan2(xi, below)), 6).alias("ra"), F.round(F.degrees(F.atan((F.sin(at) + eta * F.cos(at)) / F.sqrt(xi * xi + below * below))), 6).alias("dec"))


WARPS_SQL = "w AS (SELECT c_custkey AS id, cos(c_custkey * 0.001) AS a00, -sin(c_custkey * 0.001) AS a01, c_custkey % 37 - 18.0 AS tx, sin(c_custkey * 0.001) AS a10, cos(c_custkey * 0.001) AS a11, c_custkey % 23 - 11.0 AS ty FROM customer)"


def _warps(s, d):
    k = F.col("c_custkey")
    return table(s, d, "customer").select(k.alias("id"), F.cos(k * 0.001).alias("a00"), (-F.sin(k * 0.001)).alias("a01"), (k % 37 - 18.0).alias("tx"), F.sin(k * 0.001).alias("a10"), F.cos(k * 0.001).alias("a11"), (k % 23 - 11.0).alias("ty"))


def on_warps(name: str, sql: str, f) -> None:
    query(name, f"WITH {WARPS_SQL} {sql}")(lambda s, d: f(_warps(s, d)))


C = F.col
on_warps("x13_invert_warp", "SELECT id, round(a11 / (a00 * a11 - a01 * a10), 6) AS b00, round((a01 * ty - a11 * tx) / (a00 * a11 - a01 * a10), 5) + 0.0 AS bx, round((a10 * tx - a00 * ty) / (a00 * a11 - a01 * a10), 5) + 0.0 AS by FROM w", lambda w: w.withColumn("det", C("a00") * C("a11") - C("a01") * C("a10")).select("id", F.round(C("a11") / C("det"), 6).alias("b00"), (F.round((C("a01") * C("ty") - C("a11") * C("tx")) / C("det"), 5) + 0.0).alias("bx"), (F.round((C("a10") * C("tx") - C("a00") * C("ty")) / C("det"), 5) + 0.0).alias("by")))
on_warps("x14_canvas_bounds", ", k AS (SELECT a00 * x + a01 * y + tx AS cx, a10 * x + a11 * y + ty AS cy FROM w, (VALUES (0, 0), (511, 0), (0, 383), (511, 383)) c(x, y)) SELECT CAST(floor(min(cx)) AS BIGINT) AS x0, CAST(floor(min(cy)) AS BIGINT) AS y0, CAST(ceil(max(cx)) AS BIGINT) AS x1, CAST(ceil(max(cy)) AS BIGINT) AS y1 FROM k", lambda w: w.withColumn("c", F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (0, 511) for y in (0, 383))))).select((C("a00") * C("c.x") + C("a01") * C("c.y") + C("tx")).alias("cx"), (C("a10") * C("c.x") + C("a11") * C("c.y") + C("ty")).alias("cy")).agg(F.floor(F.min("cx")).alias("x0"), F.floor(F.min("cy")).alias("y0"), F.ceil(F.max("cx")).alias("x1"), F.ceil(F.max("cy")).alias("y1")))


def half_turn():
    return (C("a00") < 0) & (C("a11") < 0)


on_warps("x16_shift", "SELECT id, a00 < 0 AND a11 < 0 AS half_turn, round(CASE WHEN a00 < 0 AND a11 < 0 THEN sqrt((tx - 511) ** 2 + (ty - 383) ** 2) ELSE sqrt(tx * tx + ty * ty) END, 5) AS shift FROM w", lambda w: w.select("id", half_turn().alias("half_turn"), F.round(F.when(half_turn(), F.hypot(C("tx") - 511, C("ty") - 383)).otherwise(F.hypot("tx", "ty")), 5).alias("shift")))
on_warps("g15_dithering", "SELECT round(avg((sqrt(tx * tx + ty * ty) >= 10)::INT), 6) AS share FROM w", lambda w: w.agg(F.round(F.avg((F.sqrt(C("tx") * C("tx") + C("ty") * C("ty")) >= 10).cast("double")), 6).alias("share")))
on_warps("v4_registration_report", "SELECT id, round(degrees(atan2(a01, a00)), 5) AS rotation, round(sqrt(a00 * a00 + a01 * a01), 6) AS scale FROM w", lambda w: w.select("id", F.round(F.degrees(F.atan2("a01", "a00")), 5).alias("rotation"), F.round(F.hypot("a00", "a01"), 6).alias("scale")))
on_warps("f13_identity", "SELECT id, abs(a00 - 1) < 1e-6 AND abs(a11 - 1) < 1e-6 AND abs(a01) < 1e-6 AND abs(a10) < 1e-6 AND abs(tx) < 1e-6 AND abs(ty) < 1e-6 AS same FROM w", lambda w: w.select("id", (F.greatest(F.abs(C("a00") - 1), F.abs(C("a11") - 1), F.abs("a01"), F.abs("a10"), F.abs("tx"), F.abs("ty")) < 1e-6).alias("same")))


@query("x18_tile_grid", "SELECT CAST(r AS INTEGER) AS trow, CAST(c AS INTEGER) AS tcol, CAST(least(r * 48, 511 - 64) AS INTEGER) AS y0, CAST(least(c * 48, 640 - 64) AS INTEGER) AS x0 FROM range(11) a(r), range(13) b(c)")
def _grid(s, d):
    return O.tile_grid(s, 511, 640, 64, 0.25)


@query("x4_robust_weights", "SELECT event_id, round(CASE WHEN abs(z) <= 1.345 THEN 1 ELSE 1.345 / abs(z) END, 6) AS huber, round(CASE WHEN abs(z) < 4.685 THEN (1 - (z / 4.685) ** 2) ** 2 ELSE 0 END, 6) AS tukey FROM (SELECT event_id, value / 20 - 3 AS z FROM events)")
def _loss(s, d):
    from starloom.functions.robust import huber_weight, tukey_weight

    z = F.col("value") / 20 - 3
    return table(s, d, "events").select("event_id", round6(huber_weight(z)).alias("huber"), round6(tukey_weight(z)).alias("tukey"))


@query("x12_smoothstep", "SELECT event_id, round(t * t * (3 - 2 * t), 6) AS a FROM (SELECT event_id, least(greatest((value - 20) / 60, 0), 1) AS t FROM events)")
def _smooth(s, d):
    from starloom.functions.robust import smoothstep

    return table(s, d, "events").select("event_id", round6(smoothstep(F.col("value"), 20.0, 80.0)).alias("a"))


@query("j18_latest_job", "SELECT c_custkey, coalesce(last, 'none') AS status FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderstatus, struct_pack(a := o_orderdate, b := o_orderkey)) AS last FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def _latest(s, d):
    last = table(s, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("last"))
    return table(s, d, "customer").join(last, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("last", F.lit("none")).alias("status"))


@query("v1_timeline", f"SELECT user_id, count(micros) AS phases, CAST(sum(micros) AS BIGINT) AS total FROM {part('j16_asof_phases')} GROUP BY 1")
def _timeline(s, d):
    return J.asof_starts(table(s, d, "events"), "view", "purchase").groupBy("user_id").agg(F.count("micros").alias("phases"), F.sum("micros").alias("total"))


on_px("w7_reference_cut", lambda px: O.global_weights(O.metrics(px)).orderBy(F.col("weight").desc(), "frame_id").limit(16).select("frame_id"), None)
SQL["w7_reference_cut"] = f"SELECT frame_id FROM (SELECT frame_id, row_number() OVER (ORDER BY weight DESC, frame_id) AS rank FROM {part('w3_global_weights')}) WHERE rank <= 16"
on_px("v5_local_report", lambda px: local(px).groupBy("trow", "tcol").agg(F.round(F.avg("weight"), 5).alias("mean"), F.max("weight").alias("best")), None)
SQL["v5_local_report"] = f"SELECT trow, tcol, round(avg(weight), 5) AS mean, max(weight) AS best FROM {part('w4_local_weights')} GROUP BY 1, 2"
