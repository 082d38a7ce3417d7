import numpy as np
import pytest
from test_kernels import grid, rows

from starloom.operators import background as G
from starloom.operators import colour as C
from starloom.operators import linearity as L
from starloom.operators import registration as R
from starloom.sources import catalogs as S


def turned(a, t, o):
    z = t * (a[:, 0] + 1j * a[:, 1]) + o
    return np.stack([z.real, z.imag], 1)


def sky(points, shape):
    y, x = np.indices(shape)
    return 10 + sum((100 + 20 * i) * np.exp(-((x - u) ** 2 + (y - v) ** 2) / 4) for i, (u, v) in enumerate(points))


def test_triangles_find_a_similarity_among_strangers():
    rng = np.random.default_rng(1)
    a = rng.uniform(0, 800, (10, 2))
    t = 0.9 * np.exp(0.7j)
    b = np.concatenate([rng.uniform(0, 800, (4, 2)), turned(a[::-1], t, 30 + 12j)])
    m, n = R.triangles(a, b)
    assert n == 10 and np.allclose(m, [[t.real, -t.imag, 30], [t.imag, t.real, 12]], atol=1e-6)


def test_triangles_refuse_mirrors_and_few_points():
    a = np.random.default_rng(2).uniform(0, 800, (8, 2))
    assert R.triangles(a, a * [1, -1] + [0, 800])[1] < 4
    assert R.triangles(a[:2], a)[1] == 0
    assert R.triangles(np.zeros((5, 2)), a)[1] == 0


@pytest.mark.parametrize("methods", [("stars",), ("triangles",), ("shift",), ("stars", "triangles", "shift")])
def test_cascade_brings_a_moved_frame_back(spark, methods):
    points = np.random.default_rng(3).uniform(12, 52, (9, 2))
    ref, moved = sky(points, (64, 64)), sky(points + [4, -3], (64, 64))
    px = rows(spark, ref, 0).union(rows(spark, moved, 1))
    found = {r.frame_id: r for r in R.cascade(px, 0, methods).collect()}
    assert found[0].method == "identity" and found[0].cc == pytest.approx(1)
    assert found[1].method == methods[0] and found[1].cc > 0.95
    assert (found[1].tx, found[1].ty) == pytest.approx((4, -3), abs=0.3)


def test_cascade_keeps_noise_where_it_is():
    rng = np.random.default_rng(4)
    name, m, _ = R.register(np.full((32, 32), 5.0), rng.normal(100, 5, (32, 32)))
    assert name == "identity" and np.array_equal(m, np.eye(3)[:2])


def test_bilinear_moves_by_parts_of_a_pixel():
    y, x = np.indices((8, 9)).astype(float)
    got = R.bilinear(3 * x + y, np.array([[1, 0, 0.5], [0, 1, -0.25]]))
    want = 3 * (x + 0.5) + y - 0.25
    inside = ~np.isnan(got)
    assert np.allclose(got[inside], want[inside]) and not inside[0].any() and not inside[:, -1].any()
    assert R.bilinear(np.ones((1, 5)), np.eye(3)[:2]).shape == (1, 5)


def test_lost_warps_follow_the_drift(spark):
    truth = lambda i: (0.01 * i, 3.0 + 0.5 * i + 0.02 * i * i, -1.0 * i)
    data = [(1, i, *((None,) * 4 if i in (0, 7, 8, 19) else (*truth(i), 0.8))) for i in range(20)]
    data += [(2, 0, None, None, None, None), (2, 1, 0.1, 2.0, 3.0, 0.5), (3, 0, None, None, None, None)]
    warps = spark.createDataFrame(data, "run_id long, frame_id long, angle double, tx double, ty double, cc double")
    out = {(r.run_id, r.frame_id): r for r in R.fill_warps(warps).collect()}
    assert len(out) == 23
    for i in range(20):
        assert tuple(out[1, i][c] for c in ("angle", "tx", "ty")) == pytest.approx(truth(i), abs=1e-6)
        assert out[1, i].predicted == (i in (0, 7, 8, 19)) and (out[1, i].cc == 1e-4) == out[1, i].predicted
    assert (out[2, 0].angle, out[2, 0].tx, out[2, 0].ty) == (0.1, 2.0, 3.0)
    assert out[3, 0].angle is None and out[3, 0].predicted


def coarse(spark, image, step=3):
    return spark.createDataFrame([(0, float(step * i), float(step * j), float(v)) for (i, j), v in np.ndenumerate(image[::step, ::step])], "frame_id long, y double, x double, v double")


@pytest.mark.parametrize("kernel", G.KERNELS)
def test_radial_surface_flattens(spark, kernel):
    y, x = np.indices((25, 25))
    image = 200 + 20 * np.sin(y / 6) + 15 * np.cos(x / 7)
    found = G.surfaces(coarse(spark, image), kernel, reach=4.0)
    flat = grid(G.subtract(G.modelled(rows(spark, image), found), 5), "v", image.shape)
    assert found.first().rms < 3 and np.std(flat[3:-3, 3:-3]) < 0.3 * np.std(image)


def test_surface_choice_and_autotune(spark):
    y, x = np.indices((25, 25))
    cells = coarse(spark, 100 + 2.0 * y - x)
    best = {r["rank"]: r for r in G.autotune(cells).collect()}
    assert len(best) == 9 and best[1].method == "poly" and best[1].degree == 1 and best[1].rms < 1e-6
    assert {r.step for r in G.autotune(cells, steps=(1, 2)).collect()} == {1, 2}
    assert G.surfaces(cells, worst=0.0).first().method == "poly" and G.surfaces(cells).first().method == "multiquadric"
    assert G.surfaces(cells.limit(2)).first().rms == 0.0
    assert G.autotune(cells.limit(0)).count() == 0


def test_linearity_measures(spark):
    y, x = np.indices((32, 32))
    smooth = 1000 + np.sin(x / 9) + np.random.default_rng(5).normal(0, 3, x.shape)
    spiky = np.where((y * 7 + x * 13) % 17 == 0, 9000.0, 10.0)
    px = rows(spark, smooth, 0).union(rows(spark, spiky, 1))
    out = {r.frame_id: r for r in L.linearity(px).collect()}
    assert out[0].waves_ok and out[0].edges_ok and out[0].slow > 0.99
    assert not out[1].is_linear and not out[1].waves_ok and not out[1].edges_ok
    assert L.slow_share(np.ones((4, 4))) == 0 and L.steepness(np.ones((5, 5))) == 0
    few = L.linearity(px, edge=8)
    assert few.count() == 2


def test_gains_recover_the_colours(spark):
    rng = np.random.default_rng(6)
    cat = rng.uniform(0.6, 1.4, (40, 2))
    data = [(0, i, float(r / 1.5), float(b / 0.8), float(r), float(b)) for i, (r, b) in enumerate(cat)] + [(0, 99, 50.0, 0.01, 1.0, 1.0), (1, 0, 1.0, 1.0, 1.0, 1.2), (1, 1, 1.0, 1.1, 1.1, 1.3)]
    stars = spark.createDataFrame(data, "frame_id long, id long, img_r double, img_b double, cat_r double, cat_b double")
    out = {r.frame_id: r for r in C.gains(stars).collect()}
    assert (out[0].kr, out[0].kb) == pytest.approx(tuple([1.5, 0.8] / np.median(np.append(cat, [[1.0, 1.0]], 0), 0)), abs=0.001) and out[0].reason is None and out[0].n_stars == 41
    assert out[1].reason == "few stars"
    assert {r.frame_id: r.reason for r in C.gains(stars, max_condition=1.2).collect()}[0] == "condition"


def test_damping_leaves_calm_backgrounds_alone(spark):
    rng = np.random.default_rng(7)
    data = [(f, *(float(v) for v in rng.normal(1000 if f else 50, 5, 3))) for f in (0, 1) for _ in range(200)]
    sky = spark.createDataFrame(data, "frame_id long, r double, g double, b double")
    k = spark.createDataFrame([(0, 2.0, 0.7), (1, 2.0, 0.7)], "frame_id long, kr double, kb double")
    out = {r.frame_id: (r.alpha_r, r.alpha_b) for r in C.damp(sky, k, 100.0, 500.0).collect()}
    assert out == {0: (1.0, 1.0), 1: (1.0, 1.0)}  # below the ramp nothing moves; above it all moves alike
    torn = {r.frame_id: (r.alpha_r, r.alpha_b) for r in C.damp(sky, k, 990.0, 1010.0).collect()}
    assert torn[0] == (1.0, 1.0) and torn[1][0] < 0.5


def test_catalog_chunks(spark, tmp_path):
    rng = np.random.default_rng(8)
    data = [(i, float(a), float(d)) for i, (a, d) in enumerate(zip(rng.uniform(0, 360, 3000), rng.uniform(-90, 90, 3000), strict=True))] + [(3000, 359.99, 90.0), (3001, 0.0, -90.0)]
    stars = spark.createDataFrame(data, "id long, ra double, dec double")
    S.write_catalog(stars, str(tmp_path / "c"), 10.0)
    for ra, dec in (((20.0, 55.0), (-12.0, 31.0)), ((340.0, 15.0), (60.0, 90.0)), ((0.0, 0.0), (-90.0, -90.0))):
        got = S.read_box(spark, str(tmp_path / "c"), ra, dec, 10.0)
        inside = lambda a: ra[0] <= a <= ra[1] if ra[0] <= ra[1] else a >= ra[0] or a <= ra[1]  # noqa: E731, B023
        assert sorted(r.id for r in got.collect()) == [i for i, a, d in data if inside(a) and dec[0] <= d <= dec[1]]
    assert "PartitionFilters: [isnotnull" in got._jdf.queryExecution().toString() or "chunk" in got._jdf.queryExecution().toString()


def test_plate_solution_prefers_the_matrix(spark):
    lines = [("a", "CD1_1   = 1.5E-3 / x"), ("a", "CDELT1  = 9"), ("a", "CRPIX1  = 100.0"), ("b", "CRVAL1  = '12.5'"), ("b", "NAXIS1  = 7"), ("b", "nothing"), ("b", "CRVAL2  = none")]
    out = {r.source: r for r in S.plate_solution(spark.createDataFrame(lines, "source string, line string")).collect()}
    assert (out["a"].cd1_1, out["a"].cd2_2, out["a"].naxis1) == (0.0015, 0.0, 200)
    assert (out["b"].crval1, out["b"].crval2, out["b"].naxis1, out["b"].cd1_1) == (12.5, 0.0, 7, 0.0)
