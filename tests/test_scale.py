"""Steps whose cost must not grow faster than their input: many groups in one call, pairs made where they are used."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.operators import background as G
from starloom.operators import blocks as B
from starloom.operators import joins as J
from starloom.operators.groups import in_groups

PX = "frame_id long, y long, x long, v double"


def frames(spark, n, side=16, seed=1, holes=0.1):
    rng = np.random.default_rng(seed)
    rows = [(f, y, x, float(rng.normal(100, 10))) for f in range(n) for y in range(side) for x in range(side) if rng.random() >= holes]
    return spark.createDataFrame(rows, PX)


@pytest.mark.parametrize("rows", [1, 7, 10_000])
def test_groups_come_whole(spark, rows):
    df = spark.range(500).select((F.col("id") * 7 % 13).alias("k"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("g"), "id").repartition(3)
    run = lambda c, at: {"n": np.diff(at), "k": c["k"][at[:-1]], "total": np.add.reduceat(c["id"], at[:-1])}
    got = in_groups(df, ["k"], run, "k long, n long, total long", sort=["id"], rows=rows)
    want = df.groupBy("k").agg(F.count("*"), F.sum("id"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    by_null = in_groups(df, ["g"], lambda c, at: {"n": np.diff(at)}, "n long", rows=10_000)
    assert by_null.agg(F.max("n")).first()[0] == 100 and by_null.count() == 401


def test_a_kernel_sees_many_blocks_at_once(spark):
    out = B.on_blocks(frames(spark, 40), lambda a, *_: {"n": np.full(a.shape, float(len(a))), "cells": np.full(a.shape, float(a[0].size))}, 1, "n double, cells double", 8)
    most, cells = out.agg(F.max("n"), F.max("cells")).first()
    assert most > 4 and cells <= 100
    assert B.on_blocks(frames(spark, 40), lambda a, *_: {"n": np.full(a.shape, float(a[0].size))}, 1, "n double").agg(F.max("n")).first()[0] == 256


def test_frames_tuned_together_as_alone(spark):
    px = frames(spark, 6, 8).withColumn("v", F.when(F.col("frame_id") == 5, 7.0).otherwise(F.col("v") + F.col("x") * F.col("frame_id")))
    together = {(r.frame_id, r.trial): r for r in G.autotune(px.where("frame_id < 4 or x + y < 9"), steps=(1, 2)).collect()}
    assert len(together) == 6 * 18
    for f in range(6):
        g = np.array([[r.y, r.x, r.v] for r in px.where("frame_id < 4 or x + y < 9").where(F.col("frame_id") == f).orderBy("y", "x").collect()], float)
        test = np.arange(len(g)) % 5 == 4
        for t, degree in ((0, 1), (2, 2)):
            found = G._poly_fit(g[~test], degree)
            got = sum(c * ((g[test, 0] - found["y0"]) / found["unit"]) ** i * ((g[test, 1] - found["x0"]) / found["unit"]) ** j for i, j, c in found["nodes"])
            assert together[f, t].rms == pytest.approx(np.sqrt(np.mean((g[test, 2] - got) ** 2)), rel=1e-6, abs=1e-9)
        found = G._radial(g[~test], "multiquadric", float(np.diff(np.unique(g[~test, 0])).min()))
        nodes = np.array(found["nodes"])
        got = G.KERNELS["multiquadric"][0](np.hypot(g[test, None, 0] - nodes[:, 0], g[test, None, 1] - nodes[:, 1]), found["unit"]) @ nodes[:, 2] + found["mid"]
        assert together[f, 6].rms == pytest.approx(np.sqrt(np.mean((g[test, 2] - got) ** 2)), rel=1e-5, abs=1e-9)
    plan = G.autotune(px)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan


def test_repeated_median_sends_points_not_pairs(spark, monkeypatch):
    monkeypatch.setattr(J, "SLOPES", 50)
    rng = np.random.default_rng(2)
    rows = [(k, i, float(rng.integers(0, 5)), float(rng.normal())) for k in range(4) for i in range(23 + k)] + [(9, 0, 1.0, 2.0), (9, 1, 1.0, 3.0)]
    points = spark.createDataFrame(rows, "key long, id long, x double, y double")
    found = J.repeated_median(points, "key")
    got = {r.key: r for r in found.collect()}
    assert set(got) == {0, 1, 2, 3}
    for k, r in got.items():
        mine = [(x, y) for key, _, x, y in rows if key == k]
        slope = np.median([np.median(s) for x, y in mine if (s := [(b - y) / (a - x) for a, b in mine if a != x])])
        assert r.slope == pytest.approx(slope) and r.intercept == pytest.approx(np.median([y - slope * x for x, y in mine]))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "id2" not in plan and "MapInArrow" in plan


def test_band_join_of_copies(spark, monkeypatch):
    monkeypatch.setattr(J, "MEMBERS", 3)
    rows = [(i, float(i % 11) / 4) for i in range(90)] + [(91, None), (92, float("nan")), (93, -0.3)]
    df = spark.createDataFrame(rows, "id long, price double")
    found = J.band_join(df, df, "price", 0.5).select("id", "id_r")
    want = sorted((a, b) for a, p in rows for b, q in rows if p is not None and q is not None and abs(p - q) <= 0.5)
    assert sorted(map(tuple, found.collect())) == want
    assert "Generate explode(a" in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("radius", [2.5, 40.0])
def test_cone_search_everywhere(spark, radius):
    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(d)) for i, (a, d) in enumerate(zip(rng.uniform(0, 360, 250), np.degrees(np.arcsin(rng.uniform(-1, 1, 250))), strict=True))]
    rows += [(300 + i, a, d) for i, (a, d) in enumerate([(0.0, 89.5), (180.0, 89.0), (90.0, 90.0), (0.1, 0.0), (359.9, 0.5), (359.9, 0.5), (-0.2, 0.2), (10.0, -90.0), (200.0, -88.0), (12.0, 70.0), (18.0, 70.5)])]
    stars = spark.createDataFrame(rows, "id long, ra double, dec double")
    found = J.cone_search(stars, stars, radius)
    limit = math.sin(math.radians(radius) / 2) ** 2
    r = math.radians
    want = sorted((c, s) for c, a, d in rows for s, b, e in rows if math.sin(r(e - d) / 2) ** 2 + math.cos(r(d)) * math.cos(r(e)) * math.sin(r(b - a) / 2) ** 2 <= limit)
    assert sorted(map(tuple, found.collect())) == want
    assert "cell" in found._jdf.queryExecution().executedPlan().toString()


def test_warp_of_frames_that_leave_the_canvas(spark):
    px = frames(spark, 3, 10, holes=0.0)
    warps = spark.createDataFrame([(0, 1.0, 0.0, 300.0, 0.0, 1.0, 0.0), (1, 0.0, -1.0, 9.0, 1.0, 0.0, 0.0), (2, 1.0, 0.0, 0.5, 0.0, 1.0, -7.0)], "frame_id long, a00 double, a01 double, tx double, a10 double, a11 double, ty double")
    got = {(r.frame_id, r.y, r.x): r.v for r in B.warp(px, warps, 11, 9, block=4).collect()}
    assert len(got) == 3 * 11 * 9
    a = np.zeros((3, 20, 20))
    for r in px.collect():
        a[r.frame_id, r.y, r.x] = r.v
    for (f, y, x), v in got.items():
        want = {0: 0.0, 1: a[1, x, 9 - y] if y <= 9 else 0.0, 2: (a[2, y - 7, x] + a[2, y - 7, x + 1]) / 2 if y >= 7 else 0.0}[f]
        assert v == pytest.approx(want)


def test_tiles_filtered_together_as_alone(spark):
    rng = np.random.default_rng(5)
    stack = rng.normal(100, 9, (7, 8, 6))
    for kernel in (B.soft_threshold, lambda a: B.wiener(a, 3.0)):
        assert np.allclose(kernel(stack), [kernel(t) for t in stack])
    rows = [(0, 0, t, y, x, float(stack[t, y, x]) if (y, x) != (3, 3) else None) for t in range(7) for y in range(8 - t % 2) for x in range(6) if (y, x) != (2, 2)]
    out = B.on_tiles(spark.createDataFrame(rows, "frame_id long, trow int, tcol int, y long, x long, v double"), lambda a: np.full(a.shape, float(len(a))) + a * 0)
    assert sorted({r.v for r in out.where("y <> 3 or x <> 3").collect()}) == [3.0, 4.0]


def test_tiles_are_measured_in_batches(spark):
    from starloom.operators import stars as S

    rng = np.random.default_rng(6)
    tile = rng.normal(100, 5, (8, 8))
    rows = [(f, 0, 0, y, x, float(tile[y, x]) if (y + f, x) != (3, 3) else None) for f in range(3) for y in range(8) for x in range(8) if (y, x) != (7, 7)]
    out = S.tile_metrics(spark.createDataFrame(rows, "frame_id long, trow int, tcol int, y long, x long, v double"))
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        a = tile.copy()
        a[7, 7] = np.nan
        if r.frame_id <= 3:
            a[3 - r.frame_id, 3] = np.nan
        want = S.measure_tile(np.where(np.isnan(a), np.nanmedian(a), a))
        assert all(getattr(r, c) == pytest.approx(want[c]) for c in want)


def test_similarity_as_one_hypothesis_at_a_time(monkeypatch):
    from starloom.operators import registration as R

    rng = np.random.default_rng(7)
    for n in range(6):
        a = rng.uniform(0, 16, (9, 2)).round()
        b = np.concatenate([a[:5] @ np.array([[0.0, 1.0], [-1.0, 0.0]]) + n, rng.uniform(0, 16, (4, 2)).round()])
        whole = R.similarity(a, b)
        monkeypatch.setattr(R, "HELD", 81)
        alone = R.similarity(a, b)
        monkeypatch.undo()
        assert np.allclose(whole[0], alone[0]) and whole[1] == alone[1] >= 5


def test_black_body_takes_each_exponential_once(spark):
    from starloom.functions import intake as I

    df = spark.createDataFrame([(float(k),) for k in (900, 1000, 3500, 5772, 50000, 50001)], "k double")
    out = df.select("k", *(c.alias(n) for c, n in zip(I.blackbody_rgb(F.col("k")), "rgb", strict=True)))
    for r in out.collect():
        lit = [max(sum(row[i] / (math.exp(row[0] / r.k) - 1) for row in I.colour_table()), 0) for i in (1, 2, 3)]
        inside = 1000 <= r.k <= 50000
        assert [r.r, r.g, r.b] == pytest.approx([v / sum(lit) if inside else 0.0 for v in lit])
    assert out._jdf.queryExecution().optimizedPlan().toString().lower().count("exp(") <= 3


def test_warp_query_rounds_ties_as_its_sql(spark, tmp_path):
    from starloom import catalog

    import duckdb

    # half of it at the edge: 38582.505 prints as a tie, times 100 it is just below a half
    rows = [(0, y, x, 77165.01) for y in range(16) for x in range(16)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_orderkey long, l_extendedprice double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = sorted(con.execute(catalog.oracle_sql()["n16_warp"]).fetchall())
    assert sorted(tuple(r) for r in catalog.queries()["n16_warp"](spark, str(tmp_path)).select("frame_id", "y", "x", "v").collect()) == want


def test_star_fluxes_make_colours_once(spark):
    from starloom import catalog

    df = catalog.queries()["p3_star_fluxes"](spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_stack_holds_arrays_not_windows(spark):
    from starloom.operators import frames as O

    rng = np.random.default_rng(5)
    rows = [(f, y, x, float(rng.normal(100, 10) + 500 * (rng.random() < 0.1)), float(rng.random()) + 0.1) for f in range(25) for y in range(3) for x in (0, 1, None) if f < 2 + 20 * y]
    px = spark.createDataFrame(rows, "frame_id long, y long, x int, v double, w double")
    found = O.stack(px, weighted=True)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.y, r.x): (r.v, r.n_kept) for r in found.collect()}
    assert len(got) == 9 and [f.dataType.simpleString() for f in found.schema] == ["bigint", "int", "double", "bigint"]
    for (y, x), (v, n_kept) in got.items():
        a, w = np.array([r[3:] for r in rows if r[1] == y and r[2] == x]).T
        keep, stop = np.ones(len(a), bool), len(a) <= 2
        for _ in range(3):
            k = keep * w
            mean = (k * a).sum() / k.sum()
            sigma = np.sqrt((k * (a - mean) ** 2).sum() / (k.sum() - (k * w).sum() / k.sum()))
            if not stop:
                left = keep & (np.abs(a - mean) <= 2 * sigma)
                stop = left.sum() < np.ceil(0.5 * len(a)) or left.sum() == keep.sum()
                keep = left
        assert n_kept == keep.sum() and v == pytest.approx((keep * w * a).sum() / (keep * w).sum(), abs=1e-4)


@pytest.mark.parametrize("rounds", [1, 2])
def test_chroma_is_smoothed_in_one_call_of_both_planes(spark, rounds):
    rng = np.random.default_rng(8)
    rows = [(f, y, x, *map(float, rng.random(3))) for f in range(2) for y in range(9) for x in range(10) if rng.random() < 0.8]
    rgb = spark.createDataFrame(rows, "frame_id long, y long, x long, r double, g double, b double")
    found = B.chroma_denoise(rgb, rounds=rounds, block=4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == rounds and "Join" not in plan
    got = {(r.frame_id, r.y, r.x): (r.r, r.g, r.b) for r in found.collect()}
    assert len(got) == len(rows)
    for f in range(2):
        a = np.full((3, 9, 10), np.nan)
        for _, y, x, *v in (r for r in rows if r[0] == f):
            a[:, y, x] = v
        luma = 0.299 * a[0] + 0.587 * a[1] + 0.114 * a[2]
        there, limit = ~np.isnan(luma), np.nanquantile(luma, 0.9)
        for c in (0, 2):
            d = s = a[c] - luma
            for _ in range(rounds):
                s = np.where(there, B.box_mean(s, 2), np.nan)
            want = luma + d + np.where(luma <= limit, 0.7, 0.0) * (s - d)
            for y, x in zip(*np.nonzero(there), strict=True):
                assert got[f, y, x][c] == pytest.approx(want[y, x], abs=1e-9)


def test_pixels_of_whole_frames_are_dealt_once(spark, monkeypatch):
    from starloom import catalog
    from starloom.sources.frames import pixels

    folder, dealt, real = "/root/testdata/sf0.001", [], B.in_groups
    monkeypatch.setattr(B, "in_groups", lambda df, *a, **k: dealt.append(df) or real(df, *a, **k))
    found = {n: catalog.queries()[n](spark, folder) for n in ("n1_background_mask", "n2_sobel_energy", "n11_cosmetic", "f16_luminance", "x26_log_chroma", "p8_apply_gains", "n20_post_metrics")}
    assert len(dealt) == 7 and {d.count() for d in dealt} == {pixels(spark, folder).count()}
    plan = found["n20_post_metrics"]._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # values come out of the same call as their derivatives
