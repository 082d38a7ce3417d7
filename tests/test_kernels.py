import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.operators import background as G
from starloom.operators import blocks as B
from starloom.operators import registration as R


def rows(spark, image, frame=0):
    return spark.createDataFrame([(frame, y, x, float(v)) for (y, x), v in np.ndenumerate(image)], "frame_id long, y long, x long, v double")


def grid(df, column, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.y, r.x] = r[column]
    return out


@pytest.mark.parametrize("pattern", B.PATTERNS)
def test_debayer_flat_colours(spark, pattern):
    y, x = np.indices((6, 6))
    level = {"R": 100.0, "G": 200.0, "B": 300.0}
    mosaic = np.vectorize(lambda i: level[pattern[i]])(y % 2 * 2 + x % 2)
    found = B.debayer(rows(spark, mosaic), pattern, block=4).distinct().select("r", "g", "b").distinct().collect()
    assert [tuple(r) for r in found] == [(100.0, 200.0, 300.0)]


def test_blocks_do_not_change_results(spark):
    px = rows(spark, np.random.default_rng(1).normal(100, 10, (13, 11)))
    for f in (B.box_blur, B.cosmetic, B.background_mask, B.derivatives):
        one, many = (sorted(map(tuple, f(px, block=b).fillna(-1.0).collect())) for b in (64, 4))
        assert np.allclose(one, many), f


def test_box_mean_is_a_mean():
    a = np.random.default_rng(2).normal(size=(9, 7))
    a[3, 3] = np.nan
    got = B.box_mean(a, 2)
    for y, x in np.ndindex(a.shape):
        assert got[y, x] == pytest.approx(np.nanmean(a[max(y - 2, 0) : y + 3, max(x - 2, 0) : x + 3]))


def test_warp_moves_whole_pixels(spark):
    image = np.random.default_rng(3).uniform(1, 9, (10, 12))
    warps = spark.createDataFrame([(0, 1.0, 0.0, 2.0, 0.0, 1.0, -1.0)], "frame_id long, a00 double, a01 double, tx double, a10 double, a11 double, ty double")
    got = grid(B.warp(rows(spark, image), warps, 10, 12, block=4), "v", (10, 12))
    assert np.allclose(got[1:, :10], image[:9, 2:])
    assert (np.nan_to_num(got[0]) == 0).all()


def test_tile_filters():
    rng = np.random.default_rng(4)
    flat = np.full((16, 16), 50.0)
    assert np.allclose(B.wiener(flat, 1.0), flat, atol=0.5)
    y, x = np.indices((32, 32))
    clean = 100 + 50 * np.sin(x / 5)
    noisy = clean + rng.normal(0, 5, clean.shape)
    assert np.std(B.wiener(noisy, 5.0) - clean) < np.std(noisy - clean)
    noisy[2, 2] = 0
    soft = B.soft_threshold(noisy)
    assert soft[2, 2] == 0 and np.std(soft) < np.std(noisy)


def test_phase_shift_finds_the_shift():
    y, x = np.indices((64, 64))
    star = lambda cy, cx: sum(a * np.exp(-((y - cy - dy) ** 2 + (x - cx - dx) ** 2) / 6) for a, dy, dx in ((9, 0, 0), (5, 12, -8), (7, -10, 9)))
    dy, dx, _ = R.phase_shift(star(33, 29), star(30, 31))
    assert (dy, dx) == pytest.approx((3, -2), abs=0.3)


def test_similarity_from_stars(spark):
    a = np.random.default_rng(5).uniform(0, 500, (12, 2))
    t = 1.1 * np.exp(0.3j)
    z = t * (a[:, 0] + 1j * a[:, 1]) + 20 - 5j
    b = np.stack([z.real, z.imag], 1)
    b[0] += 90
    m, n = R.similarity(a, b[::-1])
    assert n == 11 and np.allclose(m, [[t.real, -t.imag, 20], [t.imag, t.real, -5]], atol=1e-6)
    stars = spark.createDataFrame([(7, float(x), float(y)) for x, y in a], "frame_id long, x double, y double")
    ref = spark.createDataFrame([(float(x), float(y)) for x, y in b], "x double, y double")
    assert R.match_stars(stars, ref).first().matched == 11
    assert R.match_stars(stars.limit(2), ref.limit(1)).first().a00 == 1.0


def test_surface_ignores_outliers_and_flattens(spark):
    y, x = np.indices((24, 24))
    image = 100 + 2.0 * y - 1.5 * x + 0.05 * x * y
    px = rows(spark, image)
    cells = image[::3, ::3].copy()
    cells[2, 2] += 500
    coarse = spark.createDataFrame([(0, float(3 * i), float(3 * j), float(v)) for (i, j), v in np.ndenumerate(cells)], "frame_id long, y double, x double, v double")
    model = G.modelled(px, G.surfaces(coarse, "poly"), band=7)
    flat = G.subtract(model, 4)
    assert np.ptp(grid(flat, "v", image.shape)) < 1.0 and flat.where("not applied").count() == 0
    worse = G.subtract(model.withColumn("model", -F.col("model")), 4)
    assert np.allclose(grid(worse, "v", image.shape), image)  # the guard holds
    assert worse.where("applied").count() == 0


def test_frames_have_surfaces_of_their_own_and_channels_go_together(spark):
    y, x = np.indices((12, 12))
    shapes = {"r": 50 + 3.0 * y, "g": 80 - 2.0 * x, "b": 70 + 1.0 * x}
    data = [(f, c, i, j, float(v) * (f + 1)) for f in range(2) for c, image in shapes.items() for (i, j), v in np.ndenumerate(image)]
    px, key = spark.createDataFrame(data, "frame_id long, channel string, y long, x long, v double"), ("frame_id", "channel")
    model = G.modelled(px, G.surfaces(px, "poly", 1, key=key), key)
    flat = G.subtract(model, 3, steep=1.08, key=key, together=("frame_id",))
    assert flat.count() == len(data) and flat.where("not applied").count() == 0
    assert all(r.s < 1e-6 for r in flat.groupBy(*key).agg(F.stddev("v").alias("s")).collect())
    turned = model.withColumn("model", F.when(F.expr("frame_id = 1 and channel = 'b'"), -F.col("model")).otherwise(F.col("model")))
    out = {r.frame_id: (r.a, r.n) for r in G.subtract(turned, 3, steep=1.08, key=key, together=("frame_id",)).groupBy("frame_id").agg(F.max("applied").alias("a"), F.count("*").alias("n")).collect()}
    assert out == {0: (True, 432), 1: (False, 432)}  # one channel worsens, so none of its frame is touched


def test_chroma_guard_takes_back_what_scatters_colours(spark):
    rng = np.random.default_rng(4)
    rows_ = [(f, i, j, *(float(v) for v in rng.normal(100, 2, 3))) for f in range(2) for i in range(8) for j in range(8)]
    before = spark.createDataFrame(rows_, "frame_id long, y long, x long, r double, g double, b double")
    after = before.withColumn("r", F.when(F.col("frame_id") == 1, F.col("r") + 20 * (F.col("x") % 2)).otherwise(F.col("r") + 1))
    got = {(r.frame_id, r.y, r.x): r for r in G.chroma_guard(before, after, before.where("y < 6")).collect()}
    assert all(got[f, i, j].r == pytest.approx(r + (f == 0)) and got[f, i, j].chroma_ok == (f == 0) for f, i, j, r, _, _ in rows_)


def test_mesh_follows_the_sky_under_stars(spark):
    y, x = np.indices((24, 24))
    sky = 100 + 0.5 * y + 0.25 * x
    image = sky + 900.0 * ((y % 11 == 5) & (x % 7 == 3))
    px = rows(spark, image).drop("frame_id")
    model = grid(G.mesh(px, G.mesh_cells(px, 6), 6), "model", image.shape)
    assert np.abs(model - sky)[4:-4, 4:-4].max() < 1.5
    assert np.isfinite(model).all()


def test_chroma_denoise_keeps_luma_and_stars(spark):
    rng = np.random.default_rng(9)
    data = [(0, y, x, *(float(v) for v in rng.normal(100, 10, 3) + (500 if (y, x) == (5, 5) else 0))) for y in range(12) for x in range(12)]
    rgb = spark.createDataFrame(data, "frame_id long, y long, x long, r double, g double, b double")
    old, new = ({(r.y, r.x): (r.r, r.g, r.b) for r in df.collect()} for df in (rgb, B.chroma_denoise(rgb, block=4)))
    luma = lambda c: 0.299 * c[0] + 0.587 * c[1] + 0.114 * c[2]
    assert all(luma(old[k]) == pytest.approx(luma(new[k])) for k in old)
    assert new[5, 5] == pytest.approx(old[5, 5])
    assert np.std([c[0] - c[2] for c in new.values()]) < 0.7 * np.std([c[0] - c[2] for c in old.values()])


def test_kmeans_finds_three_groups(spark):
    from starloom.operators import frames as O

    data = [(i, float(10 * (i % 3) + 0.1 * (i // 3)), float(-5 * (i % 3))) for i in range(18)]
    found = O.kmeans(spark.createDataFrame(data, "frame_id long, a double, b double"), ["a", "b"], 3).collect()
    groups = {frozenset(r.frame_id for r in found if r.label == k) for k in range(3)}
    assert groups == {frozenset(range(k, 18, 3)) for k in range(3)}
