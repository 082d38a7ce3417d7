import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.operators import photometry as P

SIDE = 40


def field(places, level=100.0, flux=(600.0, 800.0, 700.0)):
    """Flat sky with squares of 3 x 3 equal pixels as stars; one frame."""
    image = {c: np.full((SIDE, SIDE), level) for c in "rgb"}
    for y, x in places:
        for c, f in zip("rgb", flux, strict=True):
            image[c][y - 1 : y + 2, x - 1 : x + 2] += f / 9
    return image


def tables(spark, image, places, frame=0):
    rows = [(frame, y, x, *(float(image[c][y, x]) for c in "rgb")) for y in range(SIDE) for x in range(SIDE)]
    stars = [(frame, i + 1, y, x) for i, (y, x) in enumerate(places)]
    return spark.createDataFrame(rows, "frame_id long, y long, x long, r double, g double, b double"), spark.createDataFrame(stars, "frame_id long, rank int, py long, px_ long")


def test_fluxes_edges_and_saturation(spark):
    places = [(10, 10), (10, 30), (30, 10), (30, 30), (2, 20), (20, 20)]
    image = field(places)
    image["g"][20, 20] = 60000.0  # the frame's top value: saturated
    image["r"][0, :4] = image["b"][0, :4] = image["g"][0, :4] = 5000.0
    rgb, stars = tables(spark, image, places)
    out = {r["rank"]: r for r in P.measure_stars(rgb, stars, rgb.where("g <= 100"), SIDE, SIDE).collect()}
    assert sorted(out) == [1, 2, 3, 4]  # 5 is at the edge, 6 is saturated
    for r in out.values():
        assert (r.flux_r, r.flux_g, r.flux_b) == pytest.approx((600, 800, 700)) and not r.relaxed


def test_relaxed_where_the_sky_guard_leaves_too_few(spark):
    places = [(10, 10), (10, 30), (30, 10)]
    image = field(places)
    image["g"][0, :4] = image["r"][0, :4] = image["b"][0, :4] = 5000.0
    rgb, stars = tables(spark, image, places)
    some = rgb.where("g <= 100 and y > 20")  # only the third star has a calm annulus
    assert {(r["rank"], r.relaxed) for r in P.measure_stars(rgb, stars, some, SIDE, SIDE).collect()} == {(1, True), (2, True), (3, True)}
    assert {(r["rank"], r.relaxed) for r in P.measure_stars(rgb, stars, some, SIDE, SIDE, min_stars=1).collect()} == {(3, False)}
    assert P.measure_stars(rgb, stars.limit(0), some, SIDE, SIDE).count() == 0


def test_missing_pixels_cost_support(spark):
    places = [(10, 10), (30, 30)]
    image = field(places)
    image["g"][0, :4] = image["r"][0, :4] = image["b"][0, :4] = 5000.0
    rgb, stars = tables(spark, image, places)
    holes = rgb.withColumn("r", F.when(~F.expr("y between 9 and 10 and x between 9 and 11"), F.col("r")))
    assert [r["rank"] for r in P.measure_stars(holes, stars, rgb.where("g <= 100"), SIDE, SIDE).collect()] == [2]


def test_colour_run_applies_or_falls_back(spark):
    # frame 0: image ratios are 0.8 of the catalog's; frame 1 has one star; frame 2 none
    rows = [(0, i, 0.8 * (0.5 + i / 10), 1.0, 0.9 * (1.5 - i / 20), False) for i in range(1, 9)] + [(1, 1, 1.0, 1.0, 1.0, False)]
    measured = spark.createDataFrame(rows, "frame_id long, rank int, flux_r double, flux_g double, flux_b double, relaxed boolean")
    catalog = spark.createDataFrame([(i, 0.5 + i / 10, 1.5 - i / 20) for i in range(1, 9)], "rank int, cat_r double, cat_b double")
    out = {r.frame_id: r for r in P.colour_run(measured, catalog, spark.range(3).withColumnRenamed("id", "frame_id")).collect()}
    white_r, white_b = 0.95, 1.275
    assert out[0].applied and out[0].kr == pytest.approx(1 / (0.8 * white_r)) and out[0].kb == pytest.approx(1 / (0.9 * white_b))
    assert (out[1].applied, out[1].kr, out[1].reason) == (False, 1.0, "few stars") and (out[2].n_stars, out[2].kb, out[2].reason) == (0, 1.0, "few stars")


def test_first_source(spark):
    rows = [(1, "b", 1), (1, "a", 2), (1, "a", 3), (2, "b", 4), (3, "z", 5), (2, None, 6)]
    stars = spark.createDataFrame(rows, "field long, source string, id long")
    assert {(r.field, r.source, r.id) for r in P.first_source(stars, ["a", "b"]).collect()} == {(1, "a", 2), (1, "a", 3), (2, "b", 4)}


def test_sky_as_a_column_and_as_a_table_agree(spark):
    places = [(10, 10), (10, 30), (30, 10)]
    image = field(places)
    image["g"][0, :4] = image["r"][0, :4] = image["b"][0, :4] = 5000.0
    rgb, stars = tables(spark, image, places)
    for calm in ("g <= 100", "g <= 100 and y > 20", "g <= 100 and nullif(x, 30) is not null"):
        a = P.measure_stars(rgb, stars, rgb.where(calm), SIDE, SIDE)
        b = P.measure_stars(rgb.withColumn("calm", F.expr(calm)), stars, "calm", SIDE, SIDE)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) != []
