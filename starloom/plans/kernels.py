"""Registration and background surfaces over px; SQL cannot express them, tests hold them against known answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.operators import background as B
from starloom.operators import frames as O
from starloom.operators import linearity as L
from starloom.operators import registration as R
from starloom.registry import on_px


def _rounded(df, *names):
    return df.withColumns({c: F.round(c, 4) for c in names})


def _cells(px):
    at = lambda c: (F.floor(F.col(c) / O.CELL) * O.CELL + 1.5).alias(c)
    return px.groupBy("frame_id", at("y"), at("x")).agg(F.median("v").alias("v"))


def _flat(px, **how):
    return _rounded(B.subtract(B.modelled(px, B.surfaces(_cells(px), **how)), O.CELL), "v")


def _lost(px):
    shifts = R.frame_shifts(px, 0)
    lost = F.col("frame_id") % 5 == 2
    keep = lambda c: F.when(~lost, c)
    warps = shifts.select(F.lit(0).alias("run_id"), "frame_id", keep(F.lit(0.0)).alias("angle"), keep(F.col("dx")).alias("tx"), keep(F.col("dy")).alias("ty"), keep(F.col("peak")).alias("cc"))
    return _rounded(R.fill_warps(warps), "angle", "tx", "ty", "cc")


on_px("g7_phase_correlation", lambda px: _rounded(R.frame_shifts(px, 0), "dy", "dx", "peak"), None)
on_px("g3_star_match", lambda px: _rounded(R.match_stars(O.local_maxima(px, 0.5, 12), O.local_maxima(px.where("frame_id = 0"), 0.5, 12)), "a00", "a01", "tx", "a10", "a11", "ty"), None)
on_px("b4_flat_background", lambda px: _flat(px, method="poly"), None)
on_px("b3_radial_background", _flat, None)
on_px("b5_best_surface", lambda px: _flat(px, worst=0.25), None)
on_px("b7_autotune", lambda px: B.autotune(_cells(px), steps=(1, 2)).withColumn("rms", F.round("rms", 3)), None)
on_px("g9_cascade", lambda px: _rounded(R.cascade(px, 0), "a00", "a01", "tx", "a10", "a11", "ty", "cc"), None)
on_px("g4_triangles", lambda px: _rounded(R.cascade(px, 0, ("triangles",)), "a00", "a01", "tx", "a10", "a11", "ty", "cc"), None)
on_px("g13_filled_warps", _lost, None)
on_px("a24_linearity", lambda px: _rounded(L.linearity(px), "skewness", "kurtosis", "variation", "slow", "steep", "score"), None)
