import numpy as np
from pyspark.sql import functions as F
from test_kernels import grid, rows

from starloom.functions.sky import band_flux, byte_text, glob_pattern, nested_cell
from starloom.operators import blocks as B


def test_cells_nest_and_have_equal_areas(spark):
    rng = np.random.default_rng(1)
    n = 40_000
    data = list(zip(rng.uniform(0, 360, n).tolist(), np.degrees(np.arcsin(rng.uniform(-1, 1, n))).tolist(), strict=True))
    sky = spark.createDataFrame(data, "ra double, dec double").select("ra", "dec", *(nested_cell(F.col("ra"), F.col("dec"), k).alias(f"c{k}") for k in range(5)))
    got = np.array([tuple(r) for r in sky.collect()])
    for k in range(1, 5):
        assert np.array_equal(got[:, 2 + k] // 4, got[:, 1 + k])
    count = np.bincount(got[:, 5].astype(int), minlength=768)
    assert len(count) == 768 and count.min() > 20 and count.max() < 100  # 52 expected
    ra, dec = np.radians(got[:, :2].T)
    at = np.stack([np.cos(dec) * np.cos(ra), np.cos(dec) * np.sin(ra), np.sin(dec)], 1)
    for c in range(768):
        own = at[got[:, 5] == c]
        assert (own @ own.T).min() > np.cos(np.radians(16))  # one piece of sky


def test_base_cells(spark):
    data = [(45.0, 60.0, 0), (135.0, 60.0, 1), (0.0, 0.0, 4), (90.0, 0.0, 5), (-90.0, 0.0, 7), (45.0, -60.0, 8), (315.0, -60.0, 11), (0.0, 90.0, 0), (0.0, -90.0, 8)]
    df = spark.createDataFrame(data, "ra double, dec double, want int")
    assert all(r.got == r.want for r in df.withColumn("got", nested_cell(F.col("ra"), F.col("dec"), 0)).collect())


def test_flux_of_a_flat_spectrum(spark):
    df = spark.createDataFrame([([2.0] * 5,)], "s array<double>")
    assert df.select(band_flux(F.col("s"), [1.0] * 5, 10.0)).first()[0] == 80.0


def test_texts(spark):
    df = spark.createDataFrame([(0,), (1023,), (1536,), (1024**2,), (5 * 1024**4 + 1,)], "n long")
    assert [r[0] for r in df.select(byte_text(F.col("n"))).collect()] == ["0 B", "1023 B", "1.5 KiB", "1.0 MiB", "5.0 TiB"]
    names = spark.createDataFrame([("Light_01.FIT",), ("light_01.fits",), ("dark.fit",), ("light+1.fit",)], "n string")
    match = lambda g: [r[0] for r in names.where(F.col("n").rlike(glob_pattern(g))).collect()]
    assert match("light_*.fit") == ["Light_01.FIT"] and match("light?1.fit") == ["light+1.fit"] and match("*.fit[s]") == ["light_01.fits"]


def test_mosaic_warp_keeps_colours_apart(spark):
    y, x = np.indices((9, 11))
    mosaic = np.where((y % 2 == 0) & (x % 2 == 0), 900.0, np.where((y % 2 == 1) & (x % 2 == 1), 100.0, 400.0))
    warps = spark.createDataFrame([(0, 1.0, 0.0, 0.7, 0.0, 1.0, 1.3)], "frame_id long, a00 double, a01 double, tx double, a10 double, a11 double, ty double")
    got = grid(B.warp_mosaic(rows(spark, mosaic), warps, 9, 11, 4), "v", mosaic.shape)
    inner = (slice(2, 6), slice(2, 7))
    assert np.allclose(got[inner], mosaic[inner])
