"""Every query with SQL gives the rows of that SQL; the others give rows."""

import pytest
from pyspark.sql import functions as F

from tessera.plans.queries import ORACLES, QUERIES
from tests.conftest import DATA, same_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, DATA), duck.sql(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_sessions_by_one_machine(spark):
    """The query, which cuts cameras and runs in many tasks, tells what one machine for each camera tells."""
    from tessera.plans.domain import view
    from tessera.plans.queries import _frames
    from tessera.streaming.runners import frame_hits
    from tessera.streaming.zone_machine import Hit, Machine, step

    hits = frame_hits(_frames(spark, DATA), view(spark, DATA, "zones")).withColumn("at", F.unix_micros("frame_ts")).drop("frame_ts")
    machines, want = {}, []
    for r in sorted(hits.collect(), key=lambda r: (r.camera_id, r.at)):
        m = machines.setdefault(r.camera_id, Machine(r.camera_id))
        own = [Hit(h.track_id, h.zone_id, h.object_label, tuple(h.box), h.inside) for h in r.hits]
        want += [(t["action"], t["violation_id"], round(t["entered_at"] * 1e6), t["duration_seconds"]) for t in step(m, r.at / 1e6, own, set(r.observed))]
    got = QUERIES["zone_machine_transitions"](spark, DATA).select("action", "violation_id", F.unix_micros("entered_at"), "duration_seconds")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and want


def test_gate_events_and_trucks_by_plain_loops(spark):
    from tessera.functions import plates
    from tessera.plans.domain import view
    from tessera.streaming import frames

    at = view(spark, DATA, "gate_events").select("id", (F.unix_micros("ts") / 1e6).alias("at"))
    reads = view(spark, DATA, "ocr_reads").withColumn("plate", plates.plate_format(F.col("text"))).join(at, "id").where("plate IS NOT NULL")
    want = frames.gate_events((r.at, r.track_id, r.plate, r.conf) for r in sorted(reads.collect(), key=lambda r: (r.at, r.id)))
    got = QUERIES["gate_emitted_events"](spark, DATA).collect()
    assert sorted((r.at, r.track_id, r.plate, r.confidence) for r in got) == sorted(want)
    by_frame = {}
    for r in sorted(view(spark, DATA, "detections").collect(), key=lambda r: r.id):
        box = [round(v * 1000) for v in (r.x1, r.y1, r.x2, r.y2)]
        by_frame.setdefault(r.frame_no, []).append({"class": r["class"], "confidence": r.confidence, "bbox": box, "trackId": r.track_id})
    want = [(f, b["trackId"], *b["bbox"]) for f, own in by_frame.items() for b in frames.assemble(own) if b.get("source") == "assembled"]
    assert sorted(map(tuple, QUERIES["assembled_trucks"](spark, DATA).collect())) == sorted(want) and want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
