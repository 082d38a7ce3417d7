"""Files, settings and artifacts of a run."""

import io
import json

import numpy as np
import pytest

from starloom import config
from starloom.sources import artifacts as A
from starloom.sources import frames as S
from starloom.streaming.events import discover_runs


@pytest.fixture
def images(tmp_path):
    folder = tmp_path / "lights"
    folder.mkdir()
    cube = np.arange(3 * 4 * 5, dtype=np.float32).reshape(3, 4, 5)
    S.write_fits(str(folder / "b.FITS"), cube)
    S.write_fits(str(folder / "a.fit"), cube[0], {"BAYERPAT": "RGGB"})
    (folder / "notes.txt").write_text("no image")
    (folder / "below").mkdir()
    S.write_fits(str(folder / "below" / "c.fit"), cube[1])
    return folder, cube


def test_discovery_by_several_patterns(spark, images):
    folder, _ = images
    names = lambda p: [r.path.split("/")[-1] for r in S.discover(spark, str(folder), p).orderBy("frame_id").collect()]
    assert names("*.fit;*.fits") == ["a.fit", "b.FITS"] and names("?.fits") == ["b.FITS"] and names("x*") == []


def test_headers_planes_and_regions(spark, images):
    folder, cube = images
    heads = {r.path.split("/")[-1]: r for r in S.read_headers(spark, str(folder)).collect()}
    assert {k: (r.width, r.height, r.axes) for k, r in heads.items()} == {"a.fit": (5, 4, 2), "b.FITS": (5, 4, 3)} and heads["a.fit"].cards["BAYERPAT"] == "RGGB"
    rgb = {(r.path[-6:], r.channel, r.y, r.x): r.v for r in S.read_rgb(spark, str(folder)).collect()}
    assert len(rgb) == 4 * 20 and all(rgb["b.FITS", c, y, x] == cube[k, y, x] for k, c in enumerate("rgb") for y in range(4) for x in range(5)) and rgb["/a.fit", "l", 3, 4] == 19
    assert (S.read_region(str(folder / "b.FITS"), 3, -1, 9, 3) == cube[0, :2, 3:]).all() and S.read_region(str(folder / "a.fit"), 9, 9, 2, 2).size == 0
    S.write_fits(f"file://{folder}/d.fits", cube, spark=spark)
    assert (folder / "d.fits").read_bytes() == (folder / "b.FITS").read_bytes()


def test_artifacts(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1.5), (1, None)], "frame_id int, v double")
    A.write_artifact(rows, str(tmp_path / "x"), {"n": 2})
    head, back = A.read_artifact(spark, str(tmp_path / "x"), "frame_id int, v double")
    assert head == {"n": 2} and sorted(map(tuple, back.collect())) == [(0, 1.5), (1, None)]
    assert A.keeps_rows("test", 10**6, 10) and A.keeps_rows("production", 1200, 100) and not A.keeps_rows("production", 1201, 100)
    assert A.as_record({"a": np.array([1.0, np.nan]), 2: (np.int64(3), float("inf"))}) == {"a": [1.0, None], "2": [3, None]}
    mask = spark.createDataFrame([(y, x, y != x) for y in range(3) for x in range(4)], "y int, x int, inside boolean")
    stored = A.mask_table(mask)
    assert sorted(map(tuple, A.load_mask(stored, 3, 4).collect())) == sorted(map(tuple, mask.collect()))
    with pytest.raises(ValueError):
        A.load_mask(stored, 4, 3)


def test_event_sink_and_run_discovery(spark, tmp_path):
    tee = io.StringIO()
    for run, log in (("one", "logs/run_events.jsonl"), ("deep/two", "events.jsonl")):
        sink = A.EventSink(str(tmp_path / run / log), run, tee)
        sink.emit("phase_start", phase_name="BGE")
        sink.close()
    (tmp_path / "other.jsonl").write_text("{}")
    lines = [json.loads(x) for x in tee.getvalue().splitlines()]
    assert [x["run_id"] for x in lines] == ["one", "deep/two"] and lines[0]["phase_name"] == "BGE"
    found = discover_runs(spark, str(tmp_path)).collect()
    assert {r.run_dir.split(str(tmp_path))[1] for r in found} == {"/one", "/deep/two"} and found[0].modified >= found[1].modified
    assert discover_runs(spark, str(tmp_path), 1).count() == 1


def test_small_files(tmp_path):
    (tmp_path / "a").write_text("x")
    assert A.link_or_copy(str(tmp_path / "a"), str(tmp_path / "n" / "b")) in ("link", "copy") and (tmp_path / "n" / "b").read_text() == "x"
    assert A.first_existing(str(tmp_path), ["z", "a"]).endswith("/a") and A.first_existing(str(tmp_path), ["z"]) is None
    (tmp_path / ".git").mkdir()
    assert A.project_root(str(tmp_path / "n")) == str(tmp_path)


def test_settings(tmp_path):
    assert config.loads("") == config.DEFAULTS
    got = config.loads("stacking:\n  cluster_quality_weighting:\n    kappa_cluster: 1.7\n    cap_ratio: 15\n")
    assert config.get(got, "stacking.cluster_quality_weighting.kappa_cluster") == 1.7 and got["tile"] == config.DEFAULTS["tile"]
    for text in ("stacking: {cluster_quality_weighting: {kappa_cluster: 0}}", "stacking: {cluster_quality_weighting: {cap_ratio: 0}}", "pipeline: {mode: fast}", "nothing: 1", "tile: 3", "assumptions: {frames_min: 300}", "data: {color_mode: RGB}", "assumptions: {reduced_mode_cluster_range: [9, 2]}", "linearity: {max_frames: many}", "- 1"):
        with pytest.raises(config.Invalid):
            config.loads(text)
    config.save(got, str(tmp_path / "c.yaml"))
    assert config.load(str(tmp_path / "c.yaml")) == got
    s = config.schema()
    assert s["properties"]["data"]["properties"]["color_mode"]["enum"] == ["OSC", "MONO", "RGB"] and s["properties"]["tile"]["properties"]["min_size"] == {"type": "integer", "default": 64}
