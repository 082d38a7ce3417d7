import json

import numpy as np
import pytest

from starloom.operators import frames as O
from starloom.operators.joins import nearest_cells
from starloom.sources import frames as S
from starloom.streaming.events import fold, progress, status_batch, status_stream

PX = "frame_id long, y int, x int, v double"


def px(spark, values, **more):
    return spark.createDataFrame([(i, 0, 0, float(v)) for i, v in enumerate(values)], PX)


def test_stack_one_pixel(spark):
    assert O.stack(px(spark, [10, 20, 40]), 100, 100, 1, 1.0).first().v == pytest.approx(70 / 3, abs=1e-4)
    assert O.stack(px(spark, [5, 0, float("nan")])).first().v == 5
    assert O.stack(px(spark, [10] * 9 + [1000])).first().v == 10


def test_fits_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    image = rng.normal(100, 5, (7, 9)).astype(np.float32)
    S.write_fits(str(tmp_path / "b.fits"), image, {"BAYERPAT": "RGGB"})
    S.write_fits(str(tmp_path / "a.fits"), image * 2)
    (tmp_path / "note.txt").write_text("no frame")
    cards, back = S.parse_fits((tmp_path / "b.fits").read_bytes())
    assert (back == image).all() and cards["BAYERPAT"] == "RGGB"
    rows = S.read_fits(spark, str(tmp_path), (2, 1, 3, 2)).where("path like '%b.fits'").collect()
    assert {(r.y, r.x): r.v for r in rows} == {(y, x): float(image[y, x]) for y in (1, 2) for x in (2, 3, 4)}
    assert [r.path[-6:] for r in S.discover(spark, str(tmp_path)).orderBy("frame_id").collect()] == ["a.fits", "b.fits"]


def e(kind, phase=None, **more):
    return {"type": kind, "phase_name": phase} | more


CASES = [
    ([e("phase_start", "SCAN_INPUT"), e("phase_end", "SCAN_INPUT", status="ok"), e("phase_start", "ASTROMETRY"), e("phase_progress", "ASTROMETRY", progress=0.5), e("phase_progress", "ASTROMETRY", progress=0.2)], "running", "ASTROMETRY", {"ASTROMETRY": ("running", 0.5)}),
    ([e("phase_start", "ASTROMETRY"), e("phase_end", "ASTROMETRY", status="ok"), e("phase_start", "BGE"), e("phase_end", "BGE", status="ok"), e("resume_start", from_phase="BGE"), e("phase_start", "BGE")], "running", "BGE", {"BGE": ("running", 0.0), "ASTROMETRY": ("ok", 1.0)}),
    ([e("phase_start", "STATE_CLUSTERING"), e("phase_end", "STATE_CLUSTERING", status="skipped"), e("run_end", success=True)], "completed", None, {"STATE_CLUSTERING": ("skipped", 1.0)}),
    ([e("phase_start", "ASTROMETRY"), e("phase_end", "ASTROMETRY", status="skipped"), e("run_end", success=True), e("resume_start", from_phase="ASTROMETRY"), e("resume_end", success=True)], "completed", None, {"ASTROMETRY": ("ok", 1.0)}),
    ([e("phase_start", "BGE"), e("phase_end", "BGE", status="error")], "failed", None, {"BGE": ("error", 0.0)}),
    ([e("phase_start", "BGE"), e("phase_progress", "BGE", progress=0.4), e("phase_start", "BGE"), e("phase_progress", "BGE", progress=7.0)], "running", "BGE", {"BGE": ("running", 1.0)}),
    ([e("phase_end", "ASTROMETRY", status="ok"), e("resume_start", from_phase="pcc"), e("phase_start", "ASTROMETRY"), e("phase_end", "ASTROMETRY", status="ok"), e("phase_end", "ASTROMETRY", status="skipped", reason="existing_wcs")], "running", "PCC", {"ASTROMETRY": ("ok", 1.0), "BGE": ("ok", 1.0), "PCC": ("running", 0.0)}),
    ([e("phase_end", "BGE", status="stalled"), e("resume_start", from_phase="BGE"), e("resume_end", success=False)], "failed", "BGE", {"BGE": ("running", 0.0)}),
]


@pytest.mark.parametrize("events, status, current, phases", CASES)
def test_fold(events, status, current, phases):
    state = fold({}, events)
    assert (state["status"], state["current"]) == (status, current)
    assert {k: (state["phases"][k]["status"], state["phases"][k]["pct"]) for k in phases} == phases
    assert 0 <= progress(state) <= 1


def test_status_batch_and_stream(spark, tmp_path):
    rows = [{"run_id": f"run{i}", "line_no": n, **x} for i, case in enumerate(CASES) for n, x in enumerate(case[0])]
    schema = "run_id string, line_no long, type string, phase_name string, status string, progress double, from_phase string, success boolean"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/events.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows) + "not json\n\n")
    batch = {r.run_id: r for r in status_batch(spark.read.schema(schema).json(str(tmp_path / "in")).where("type is not null")).collect()}
    assert [batch[f"run{i}"].status for i in range(len(CASES))] == [c[1] for c in CASES]
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in")).where("type is not null")
    q = status_stream(stream).writeStream.outputMode("update").format("memory").queryName("status").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.run_id: tuple(r) for r in spark.table("status").collect()} == {k: tuple(v) for k, v in batch.items()}
    assert S.read_events(spark, str(tmp_path / "in")).count() == len(rows)


def test_nearest_cell_ties(spark):
    cells = spark.createDataFrame([(0, 0, None), (0, 1, 5.0), (1, 0, 7.0)], "cy long, cx long, v double")
    assert {(r.cy, r.cx): r.v for r in nearest_cells(cells).collect()}[0, 0] == 5.0


def test_tiles_cover(spark):
    one = spark.createDataFrame([(0, y, x, 1.0) for y in range(16) for x in range(16)], PX)
    tiles = O.tile_of(one, 16)
    assert tiles.groupBy("trow", "tcol").count().where("count <> 64").count() == 0 and tiles.select("trow", "tcol").distinct().count() == 9
    assert {r.v for r in O.overlap_add(tiles).collect()} <= {1.0, None}
