"""Interpolation, gap filling, smoothing, crop paths, tiles."""

import math

import pytest
from pyspark.sql import functions as F

from cinelake.operators import ordered, tracks
from cinelake.plans import reframe

BOX = "media_id string, frame_number bigint, pos int, track_id bigint, class string, bbox_xywh array<double>, confidence double"


def box(frame, track, x, conf=0.9, pos=0, cls="person", media="m"):
    return (media, frame, pos, track, cls, [float(x), 50.0, 20.0, 40.0], conf)


def dense(spark, boxes, keyframes, total, step=3):
    frames, out = tracks.dense_tracks(
        spark.createDataFrame(boxes, BOX), spark.createDataFrame([("m", k) for k in keyframes], "media_id string, frame_number bigint"),
        spark.createDataFrame([("m", total, step)], "media_id string, total_frames bigint, step bigint"),
    )
    return sorted((r.frame_number, r.sampled) for r in frames.collect()), {(r.frame_number, r.track_id): r for r in out.collect()}


def test_linear_between_keyframes(spark):
    frames, out = dense(spark, [box(0, 1, 100, 0.9), box(6, 1, 160, 0.8)], [0, 6], 7, step=6)
    assert frames == [(i, i in (0, 6)) for i in range(7)]
    assert out[3, 1].bbox_xywh[0] == pytest.approx(130) and out[3, 1].confidence == pytest.approx(0.85)


def test_one_sided_tracks_hold(spark):
    _, out = dense(spark, [box(0, 1, 100), box(3, 2, 50, cls="dog")], [0, 3], 4)
    assert out[1, 1].bbox_xywh[0] == 100 and out[2, 2].bbox_xywh[0] == 50 and out[1, 2]["class"] == "dog"


def test_last_duplicate_and_null_track(spark):
    _, out = dense(spark, [box(0, 1, 10, pos=0), box(0, 1, 20, pos=1), box(3, 1, 50), box(0, None, 0, pos=2), box(3, None, 30, pos=1)], [0, 3], 4)
    assert out[1, 1].bbox_xywh[0] == pytest.approx(30) and out[1, None].bbox_xywh[0] == pytest.approx(10)


def test_ends_and_failed_samples(spark):
    # Frame 0 failed to decode: it is not filled; 1 and 2 copy the first keyframe, 7 and 8 the last one.
    frames, out = dense(spark, [box(3, 1, 30), box(6, 1, 60)], [3, 6], 9)
    assert [f for f, _ in frames] == [1, 2, 3, 4, 5, 6, 7, 8]
    assert out[1, 1].bbox_xywh[0] == 30 and out[8, 1].bbox_xywh[0] == 60


def test_empty_keyframe_gives_empty_frames(spark):
    frames, out = dense(spark, [], [0, 3], 5)
    assert [f for f, _ in frames] == [0, 1, 2, 3, 4] and out == {}


def gap_path(spark, n, missing, hold, drift, fps=30.0):
    rows = [("e", i, None if i in missing else 1000.0, None if i in missing else 1000.0) for i in range(n)]
    df = spark.createDataFrame(rows, "e string, f bigint, x double, y double")
    mid = F.lit(2048.0)
    out = ordered.fill_gaps(df, ["e"], "f", "x", "y", F.lit(fps), mid, mid, hold, drift, segment_frames=16)
    return {r.f: r.x for r in out.collect()}


def test_gap_holds(spark):
    assert gap_path(spark, 90, range(30, 60), 2.0, 1.0)[45] == 1000.0


def test_gap_drifts_then_centres(spark):
    path = gap_path(spark, 150, range(30, 120), 1.0, 1.0)
    assert path[59] == 1000.0 and path[60] == 1000.0 and path[75] == pytest.approx(1000 + 15 / 30 * 1048) and path[95] == 2048.0 and path[120] == 1000.0


def test_leading_gap_is_centre(spark):
    assert gap_path(spark, 20, range(5), 0.1, 0.1)[2] == 2048.0


def test_smoothing(spark):
    points = [None, 10.0, 20.0, None, 30.0] + [float(i % 7) for i in range(600)]
    df = spark.createDataFrame([("e", i, p) for i, p in enumerate(points)], "e string, f bigint, x double")
    alpha = 1 - math.exp(-1 / (0.5 * 30))
    got = {r.f: r.x for r in ordered.smooth(df, ["e"], "f", ["x"], ordered.smoothing_alpha(F.lit(0.5), F.lit(30.0))).collect()}
    prev, started = 0.0, False
    for i, p in enumerate(points):
        if p is not None:
            prev, started = (prev + alpha * (p - prev), True) if started else (p, True)
        assert got[i] == pytest.approx(prev)


ENTRY = "entry_id string, media_id string, target_aspect string, mode string, subject_track_id bigint, in_timecode string, out_timecode string, offset_x double, offset_y double, smoothing_tau double"


def test_crop_paths(spark, rows):
    media = spark.createDataFrame([("m", 30.0, 2.0)], "media_id string, fps double, duration_seconds double")
    entries = spark.createDataFrame(
        [
            ("centre", "m", "9:16", "center", None, None, "00:00:01.000", None, None, None),
            ("shift", "m", "9:16", "manual_offset", None, None, "00:00:00.010", 5000.0, 0.0, None),
            ("follow", "m", "9:16", "auto_subject", None, None, "00:00:00.100", None, None, 0.2),
            ("aspect", "m", "9x16", "center", None, None, None, None, None, None),
            ("lost", "zz", "9:16", "center", None, None, None, None, None, None),
            ("mode", "m", "9:16", "spin", None, None, None, None, None, None),
            ("tau", "m", "9:16", "auto_subject", None, None, None, None, None, 0.0),
            ("nobody", "m", "9:16", "auto_subject", None, "00:00:01.500", "00:00:01.600", None, None, None),
        ],
        ENTRY,
    )
    boxes = spark.createDataFrame([box(0, 1, 900), box(1, 1, 900), box(2, 1, 900), box(0, 2, 100, pos=1)], BOX)
    paths, rejects = reframe.crop_paths(entries, media, boxes, 1920, 1080)
    got = {}
    for r in paths.collect():
        got.setdefault(r.entry_id, {})[r.frame_index] = (r.track_id, r.crop_x, r.crop_y)
    assert len(got["centre"]) == 30 and got["centre"][0] == (None, 656.5, 0.0)
    assert got["shift"] == {0: (None, 1313.0, 0.0)}
    x = 900 - (2 / 3 - 0.5) * 607 - 303.5
    assert sorted(got["follow"]) == [0, 1, 2]
    for track, cx, cy in got["follow"].values():
        assert track == 1 and cx == pytest.approx(x) and cy == 0.0
    assert rows(rejects) == [("aspect", "bad aspect ratio"), ("lost", "media not found"), ("mode", "unknown crop mode"), ("nobody", "no tracked detections"), ("tau", "smoothing_tau must be positive")]


def test_tiles(spark, rows):
    samples = spark.createDataFrame([("a", i, 1.0) for i in range(25)], "media_id string, i bigint, v double")
    assert rows(ordered.tiles(samples, "media_id", "i", "v", 10)) == [("a", 0, 10, 10.0, 0), ("a", 1, 10, 10.0, 0), ("a", 2, 5, 5.0, 5)]
