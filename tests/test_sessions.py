"""Golden scenarios of the session machine and frame steps; batch and stream agree."""

import datetime

import pytest
from pyspark.sql import functions as F

from tessera.config import Thresholds
from tessera.streaming import frames
from tessera.streaming.zone_machine import Hit, Machine, step

IN, OUT = (0.2, 0.2, 0.3, 0.4), (0.7, 0.7, 0.9, 0.9)
AT_ONCE = Thresholds(minimum_violation_seconds=0)


def play(events, limits):
    """events: (second, track or None, box); returns the transitions and the machine."""
    m, out = Machine("c"), []
    for at, track, box in events:
        inside = box is not None and box[3] <= 0.5 and (box[0] + box[2]) / 2 <= 0.5
        near = box is not None and (box[0] + box[2]) / 2 <= 0.52
        hits = [Hit(track, "z", "Xe máy", box, inside)] if near else []
        out += [(t["action"], t["entered_at"], t["exited_at"], t["duration_seconds"]) for t in step(m, at, hits, {track} if track is not None else set(), limits)]
    return out, m


def test_life_cycle():
    out, _ = play([(0, 1, IN), (1, 1, IN), (2, 1, OUT), (3, 1, OUT), (4, 1, OUT)], AT_ONCE)
    assert out == [("STARTED", 0, None, None), ("ENDED", 0, 1, 1)]


def test_renumbered():
    out, m = play([(0, 1, IN), (1, None, None), (3, None, None), (4, 99, IN)], AT_ONCE)
    assert len(out) == 1 and m.open[0].track_id == 99


@pytest.mark.parametrize(("last", "ended"), [(11.9, 0), (12.0, 1)])
def test_missing(last, ended):
    out, _ = play([(0, 1, IN), (last, None, None)], AT_ONCE)
    assert sum(t[0] == "ENDED" for t in out) == ended


def test_minimum_second():
    assert play([(0, 1, IN), (0.9, None, None)], Thresholds())[0] == []
    assert play([(0, 1, IN), (1, 1, IN)], Thresholds())[0] == [("STARTED", 0, None, None)]


def test_jitter_on_the_border():
    near, far = (0.49, 0.2, 0.53, 0.4), (0.53, 0.2, 0.57, 0.4)
    events = [(0, 1, IN), *[(k, 1, near) for k in range(1, 6)], *[(k, 1, far) for k in (6, 7, 8)]]
    assert [t[0] for t in play(events, AT_ONCE)[0]] == ["STARTED", "ENDED"]


def test_hysteresis():
    assert list(frames.hysteresis([(1, 0.20), (2, 0.45), (3, 0.16)])) == [(2, 0.45), (3, 0.334)]
    assert list(frames.hysteresis([(1, 0.16)])) == []
    assert list(frames.hysteresis([(1, 0.5), (70, 0.2)])) == [(1, 0.5)]


def test_assembly():
    car = {"class": "car", "confidence": 0.5, "bbox": [200, 100, 260, 180], "trackId": 1}
    truck = {"class": "truck", "confidence": 0.9, "bbox": [255, 95, 450, 185], "trackId": 2}
    (made,) = frames.assemble([car, truck])
    assert made["bbox"] == [200, 95, 450, 185] and made["source"] == "assembled" and made["class"] == "truck"


def test_suppression_prefers_the_better_source():
    custom = {"class": "forklift", "confidence": 0.76, "bbox": [80, 90, 260, 210], "source": "custom"}
    truck = {"class": "truck", "confidence": 0.92, "bbox": [110, 110, 250, 205], "source": "primary"}
    assert frames.suppress([truck, custom]) == [custom]


def test_gate_events_once_a_stay_and_cooldown():
    one = lambda *times: [(at, 1, "15R-158.45", 0.9) for at in times]
    told = lambda reads: [(a, t, p) for a, t, p, _ in frames.gate_events(reads)]
    assert told(one(0.0, 0.5, 3.0)) == [(0.0, 1, "15R-158.45")]
    assert told(one(0.0, 3.0, 20.0)) == [(0.0, 1, "15R-158.45"), (20.0, 1, "15R-158.45")]
    # Another track of the same plate waits for the cooldown, and tells when it has passed.
    second = [(at, 2, "15R-158.45", 0.8) for at in (19.0, 19.9, 20.1, 21.0)]
    assert told(one(0.0) + second) == [(0.0, 1, "15R-158.45"), (20.1, 2, "15R-158.45")]
    assert told([(0.0, 1, "15R", 0.9)]) == []


def test_cooldown_counts_from_the_last_told_event(spark):
    from tessera.operators.events import cooled_down

    base = datetime.datetime(2024, 1, 1)
    rows = [(k, "A", base + datetime.timedelta(seconds=15 * k)) for k in range(9)] + [(100, "B", base), (101, "B", base), (102, None, None)]
    df = spark.createDataFrame(rows, "id long, license_plate string, ts timestamp").repartition(3)
    assert sorted(r.id for r in cooled_down(df, 20).collect()) == [0, 2, 4, 6, 8, 100, 102]


def test_batch_and_stream_agree(spark, tmp_path):
    from tessera.streaming.runners import HITS, stream_zone_transitions, zone_transitions

    base = datetime.datetime(2024, 1, 1)
    rows = []
    for k in range(60):
        inside = k % 20 < 10
        hits = [(1, "z", "Xe máy", [0.2, 0.2, 0.3, 0.4], True)] if inside else []
        rows += [(c, base + datetime.timedelta(seconds=k), hits, [1]) for c in ("a", "b")]
    schema = f"camera_id string, frame_ts timestamp, hits {HITS}, observed array<int>"
    df = spark.createDataFrame(rows, schema)
    batch = sorted(map(tuple, zone_transitions(df).collect()), key=str)
    for part in range(3):
        df.where(f"minute(frame_ts) * 60 + second(frame_ts) BETWEEN {20 * part} AND {20 * part + 19}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_zone_transitions(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*zone_transitions(df).columns).collect()), key=str) == batch
    assert len(batch) == 12


def test_gate_events_of_one_camera_run_apart(spark):
    """Dense reads (few plates, stays of several plates, reads at one time) are told as by one loop for each camera, in several tasks."""
    import random

    from tessera.streaming.runners import gate_told

    draw = random.Random(5)
    names = [f"15A-{k:05d}" for k in range(60)] + ["15A-7", "AB12CD", "XA02MN0001"]
    rows = []
    for k in range(6000):
        track = draw.randrange(120)
        at = round(float(draw.choice([draw.random() * 9000, draw.randrange(9000), 8000 + draw.random() * 60])), 1)
        rows.append((draw.choice("PQ"), track, k, at, names[(track + draw.choice([0, 0, 0, 7])) % len(names)], draw.randrange(100) / 100))
    want = [e for c in "PQ" for e in frames.gate_events((r[3], r[1], r[4], r[5]) for r in sorted(rows, key=lambda r: (r[3], r[2])) if r[0] == c)]
    lost = [("P", None, 9001, 5.0, names[0], 0.5), ("P", 3, 9002, None, names[0], 0.5), (None, 3, 9003, 5.0, names[0], 0.5)]
    df = spark.createDataFrame(rows + lost, "camera_id string, track_id long, id long, at double, plate string, conf double")
    got = gate_told(df).withColumn("task", F.spark_partition_id())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = got.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.at, r.track_id, r.plate, r.confidence) for r in got) == sorted(want)
    assert len(want) < 6000 and len({r.task for r in got}) > 2
    assert gate_told(df.limit(0)).count() == 0
