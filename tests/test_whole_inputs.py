"""Queries held against plain Python over all rows of their table."""

from statistics import median

from starloom import catalog

SF = "/root/testdata/sf0.001"

EVENTS = "event_id long, user_id long, event_type string, value double"


def test_scan_score_counts_every_event(spark, tmp_path):
    kinds = ["error", "signup", "view"]
    rows = [(i, i % 5, kinds[i % 3], 1.0) for i in range(1, 12)] + [(13, 77, "error", 1.0), (14, None, "signup", 1.0)]
    spark.createDataFrame(rows, EVENTS).write.parquet(str(tmp_path / "events.parquet"))
    want = {}
    for _, user, kind, _ in rows:
        want[user] = want.get(user, 1.0) - {"error": 0.25, "signup": 0.1, "view": 0.0}[kind]
    got = {r.user_id: r.score for r in catalog.queries()["a28_scan_score"](spark, str(tmp_path)).collect()}
    assert got == {k: round(max(0.0, v), 4) for k, v in want.items()}


def _weighted_median(x, w):
    total, acc = sum(w), 0.0
    for v, k in sorted(zip(x, w, strict=True)):
        acc += k
        if acc >= total / 2:
            return v
    return None


def _location(x, w):
    for _ in range(5):
        if len(x) < 3:
            break
        m = _weighted_median(x, w)
        mad = 1.4826 * _weighted_median([abs(v - m) for v in x], w)
        kept = [(v, k) for v, k in zip(x, w, strict=True) if abs(v - m) <= 2.5 * mad]
        if mad < 1e-15 or len(kept) < 3 or len(kept) == len(x):
            break
        x, w = [v for v, _ in kept], [k for _, k in kept]
    return _weighted_median(x, w), len(x)


def test_robust_location_clips_until_nothing_is_left_to_clip(spark, tmp_path):
    rows = [(i, i, "long", float((i * 37 % 101) ** 3 / 1000)) for i in range(1, 400)]
    rows += [(i, i, "flat", 2.0 if i < 440 else 9.0 + i) for i in range(400, 460)]
    rows += [(500, 1, "two", 1.0), (501, 1, "two", 50.0), (502, 1, "two", None)]
    spark.createDataFrame(rows, EVENTS).write.parquet(str(tmp_path / "events.parquet"))
    want = {}
    for kind in ("long", "flat", "two"):
        some = [(v, i % 7 + 1) for i, _, k, v in rows if k == kind and v is not None]
        m, n = _location([v for v, _ in some], [k for _, k in some])
        want[kind] = (round(m, 5), n)
    got = {r.event_type: (r.location, r.n) for r in catalog.queries()["p5_robust_location"](spark, str(tmp_path)).collect()}
    assert got == want


def _line(points):
    slopes = [median([(v - y) / (u - x) for u, v in points if u != x]) for x, y in points]
    b = median(slopes)
    return b, median([y - b * x for x, y in points])


def test_lines_and_tiles_use_every_row_of_every_frame(spark):
    from starloom.sources.frames import pixels

    px = [(r.frame_id, r.y, r.x, float(r.v)) for r in pixels(spark, SF).select("frame_id", "y", "x", "v").collect()]
    frames = {p[0] for p in px}
    lines = {r.frame_id: (r.slope, r.intercept) for r in catalog.queries()["p4_repeated_median"](spark, SF).collect()}
    gains = {r.frame_id for r in catalog.queries()["p6_white_gains"](spark, SF).collect()}
    assert set(lines) == gains == frames
    for f in sorted(frames)[:3]:
        b, a = _line([(float(x), v) for g, _, x, v in px if g == f])
        assert abs(lines[f][0] - b) < 1e-4 and abs(lines[f][1] - a) < 1e-2
    blended = {(r.frame_id, r.y, r.x): r.v for r in catalog.queries()["r8_overlap_add"](spark, SF).collect()}
    assert {k[0] for k in blended} == frames
    for f, y, x, v in px:  # all tiles of a frame agree on a pixel
        got = blended.get((f, y, x))
        assert got is None or abs(got - v) < 1e-3
