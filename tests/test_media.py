"""Uploads, swept files, gate zones, positions and renumbered tracks at their borders."""

import base64
import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry
from tessera.operators import boxes, media, spatial
from tessera.streaming import jobs


def test_uploads(spark):
    data = lambda b, mime=None: (f"data:{mime};base64," if mime else "") + base64.b64encode(b).decode()
    rows = [
        (1, data(b"abc", "image/png"), "a b.PNG", None), (2, data(b"abcdef", "video/mp4"), "x/y.mp4", None), (3, data(b"abcd"), None, None), (4, data(b"abcd"), "clip", "video"), (5, "***", "bad.jpg", None),
        (6, None, "none", None), (7, "", "", None), (8, data(b"abcdefg", "video/webm"), "long", None), (9, data(b"ab", "image/jpeg"), "a name of more than twenty-two.jpg", "img"),
    ]
    sent = spark.createDataFrame(rows, "id int, data string, file_name string, kind string")
    got = {r.id: r for r in media.uploads(sent, 6, 3).collect()}
    assert [got[k].media_kind for k in range(1, 10)] == ["img", "video", "img", "video", "img", "img", "img", "video", "img"]
    assert [got[k].refused for k in range(1, 10)] == [None, None, "too large", None, "no base64", "no data", "no data", "too large", None]
    assert [got[k].filename for k in (1, 2, 4, 8, 9)] == ["a_b.PNG.png", "x_y.mp4", "clip.mp4", "long.webm", "a_name_of_more_than_twenty-two.jpg"]
    assert bytes(got[2].bytes) == b"abcdef" and got[8].bytes is None and got[8].url is None and got[2].url == "/data/uploads/x_y.mp4"
    assert got[9].name == "a name of more tha..." and got[3].filename.startswith("media_")
    assert media.uploads(sent.limit(0)).count() == 0


def test_registered(spark):
    old = spark.createDataFrame([("a", 5, None), ("b", 1, "x")], "filename string, created_at int, kind string")
    new = spark.createDataFrame([("z", "b", 1), ("y", "b", 0), ("w", "c", 9)], "kind string, filename string, created_at int")
    assert sorted(map(tuple, media.registered(old, new).collect())) == [("a", 5, None), ("b", 1, "z"), ("c", 9, "w")]
    assert media.registered(old.limit(0), new.limit(0)).count() == 0


def test_swept(spark):
    names = [("clips", "area_1.txt", True), ("clips", "x.mp4", True), ("clips", "gate_clip_1.avi", True), ("clips", ".gitkeep", True), ("clips", "area_dir", False), ("crops", "area_1.txt", True), ("crops", "a.jpg", True), ("crops", None, True), ("other", "a.mp4", True)]
    files = spark.createDataFrame(names, "folder string, name string, is_file boolean")
    got = {k: sorted((r.folder, r.name) for r in media.swept(files, k).collect()) for k in media.SWEPT}
    assert got["area"] == [("clips", "area_1.txt"), ("clips", "x.mp4")]
    assert got["gate"] == [("clips", "gate_clip_1.avi"), ("crops", "a.jpg")]
    assert got["all"] == [("clips", "area_1.txt"), ("clips", "gate_clip_1.avi"), ("clips", "x.mp4"), ("crops", "a.jpg"), ("crops", "area_1.txt")]


def test_active_version(spark):
    rows = [("v1", "REPLACED", "{}"), ("v3", "ACTIVE", '{"map": 0.5}'), ("v2", "ACTIVE", "no json")]
    versions = spark.createDataFrame(rows, "version_key string, status string, evaluation_metrics string")
    assert media.active_version(versions).collect()[0].asDict() == {"version_key": "v2", "status": "ACTIVE", "evaluation_metrics": {}}
    assert media.active_version(versions.where("version_key <> 'v2'")).first().evaluation_metrics == {"map": 0.5}
    assert media.active_version(versions.where("status <> 'ACTIVE'")).count() == 0


@pytest.mark.parametrize("scale", [1.0, 100.0])
def test_gate_zones_at_their_borders(spark, scale):
    """A square's lower left corner is outside, its right and lower sides are inside (y grows downwards)."""
    square = [{"x": x * scale, "y": y * scale} for x, y in ((0.25, 0.25), (0.75, 0.25), (0.75, 0.75), (0.25, 0.75))]
    at = [(0.5, 0.5, True), (0.5, 0.25, False), (0.5, 0.75, True), (0.75, 0.5, True), (0.25, 0.5, False), (0.25, 0.25, False), (0.75, 0.75, True), (0.8, 0.5, False), (0.2, 0.5, False)]
    points = spark.createDataFrame([(k, x, y) for k, (x, y, _) in enumerate(at)], "id int, px double, py double")
    zones = spark.createDataFrame([(0, square), (1, square[:2]), (2, []), (3, None)], "zone_id int, polygon array<struct<x: double, y: double>>")
    hits = {(r.id, r.zone_id) for r in spatial.gate_hits(points, zones).collect()}
    assert hits == {(k, 0) for k, (_, _, inside) in enumerate(at) if inside}


def test_boxes(spark):
    rows = [(-5.5, 10.9, 50.0, 20.0), (700.0, 400.0, 900.0, 500.0), (10.0, 10.0, 5.0, 5.0)]
    got = spark.createDataFrame(rows, "x1 double, y1 double, x2 double, y2 double").select(*[c.alias(k) for k, c in geometry.picture_box(geometry.box(), 640, 360).items()]).collect()
    assert [tuple(r)[:4] for r in got] == [(0, 10, 50, 20), (639, 359, 640, 360), (10, 10, 11, 11)]
    assert tuple(got[0])[4:] == (0.0, 0.0278, 0.0781, 0.0556)
    given = [(0.0, 0.0, 1.0, 1.0), (0.5, 0.5, 0.6, 0.1), (50.0, 50.0, 50.0, 50.0), (0.1, 0.1, 0.0, 0.1), (-0.1, 0.1, 0.1, 0.1), (None, 0.1, 0.1, 0.1), (math.nan, 0.1, 0.1, 0.1)]
    fits = spark.createDataFrame(given, "x double, y double, w double, h double").select(boxes.unit_box_fits(*map(F.col, "xywh")).alias("f"))
    assert [r.f for r in fits.collect()] == [True, False, True, False, False, False, False]


def test_positions(spark):
    frames = spark.range(100).withColumnRenamed("id", "frame_no")
    first = lambda df: df.agg(F.min("frame_no")).first()[0]
    assert [first(jobs.seek(frames, s, 10, 8.0)) for s in (-3, 2.0, 50)] == [0, 20, 80]
    assert [r.frame_no for r in jobs.preview(frames, 99, 10, 5.0).collect()] == [50]
    assert jobs.preview(frames, 99, 10).count() == 0


def reidentified(spark, hits, seen=()):
    columns = "id int, camera_id string, zone_id string, track_id int, frame_no int, seconds double, x1 double, y1 double, x2 double, y2 double"
    df = spark.createDataFrame(hits, columns)
    observed = df.select("camera_id", "frame_no", "track_id").union(spark.createDataFrame(list(seen), "camera_id string, frame_no int, track_id int"))
    return {r.id: (r.prior_id, round(r.iou, 3)) for r in spatial.reidentified(df, observed).collect()}


def test_renumbered_sessions(spark):
    box, far, half = (0.1, 0.1, 0.3, 0.3), (0.6, 0.6, 0.8, 0.8), (0.2, 0.1, 0.4, 0.3)
    hit = lambda n, track, at, b=box, zone="z", camera="c": (n, camera, zone, track, int(at * 4), float(at), *b)
    one = [hit(1, 1, 0), hit(2, 1, 1)]
    assert reidentified(spark, [*one, hit(3, 2, 5)]) == {3: (2, 1.0)}  # the last box of the prior one
    assert reidentified(spark, [*one, hit(3, 2, 13)]) == {}  # twelve seconds are too long
    assert reidentified(spark, [*one, hit(3, 2, 12.75)]) == {3: (2, 1.0)}
    assert reidentified(spark, [*one, hit(3, 2, 5, far)]) == {}
    assert reidentified(spark, [*one, hit(3, 2, 5, zone="y"), hit(4, 3, 5, camera="d")]) == {}
    assert reidentified(spark, [*one, hit(3, 2, 5)], [("c", 20, 1)]) == {}  # track 1 is seen elsewhere in this frame
    assert reidentified(spark, [*one, hit(3, 2, 5)], [("d", 20, 1), ("c", 19, 1)]) == {3: (2, 1.0)}
    assert reidentified(spark, [*one, hit(3, 2, 1)]) == {}  # both in one frame
    assert reidentified(spark, [*one, hit(3, 2, 5), hit(4, 2, 6), hit(5, 1, 7)]) == {3: (2, 1.0)}  # track 1 still has its session
    assert reidentified(spark, [hit(1, 1, 0), hit(2, 2, 0, half), hit(3, 3, 4)]) == {3: (1, 1.0)}  # the greatest overlap
    assert reidentified(spark, [hit(1, 1, 0), hit(2, 2, 0.5), hit(3, 1, 1), hit(4, 3, 4)])[4] == (2, 1.0)  # of equals the session that opened last
    assert reidentified(spark, []) == {}
