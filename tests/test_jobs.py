"""Job life, reports, exports, message lists and pacing on small tables."""

import datetime
import json

import pytest

from tessera.operators import export, jobs, messages
from tessera.streaming import frames

T0 = datetime.datetime(2024, 1, 1)
at = lambda n: T0 + datetime.timedelta(seconds=n)


def log(spark, *events):
    return spark.createDataFrame([(1, at(k), e, n) for k, (e, n) in enumerate(events)], "job_id int, at timestamp, event string, epoch int")


def test_job_life(spark):
    out = jobs.told(log(spark, ("claimed", None), ("created", None), ("claimed", None), ("progress", 99), ("created", None), ("paused", None), ("progress", 3), ("claimed", None), ("progress", 7), ("failed", None), ("retried", None), ("completed", None)))
    got = [(r.state, r.current_epoch, r.refused) for r in sorted(out.collect(), key=lambda r: r.at)]
    want = [("", 0, True), ("QUEUED", 0, False), ("RUNNING", 0, False), ("RUNNING", 60, False), ("RUNNING", 60, True), ("PAUSED_GPU", 60, False), ("PAUSED_GPU", 60, True), ("RUNNING", 60, False), ("RUNNING", 7, False), ("FAILED", 7, False), ("QUEUED", 7, False), ("QUEUED", 7, True)]
    assert got == want
    assert jobs.told(log(spark).where("false")).collect() == []


def test_reports(spark, tmp_path):
    ids = [f"{k:08d}-0000-0000-0000-000000000000" for k in range(5)]
    sha = "a" * 64
    texts = [{"outcome": "completed", "artifactPath": "a", "artifactSha256": sha, "accepted": True}, {"outcome": "completed", "artifactPath": "a", "artifactSha256": "b" * 64}, {"outcome": "paused", "reason": "x" * 300}, {"outcome": "completed", "artifactPath": "a", "artifactSha256": sha}]
    for i, t in zip(ids, texts):
        (tmp_path / f"{i}.json").write_text(json.dumps(t, indent=1))
    (tmp_path / "notes.json").write_text(json.dumps(texts[0]))
    (tmp_path / f"{ids[4]}.json").write_text("{no json")
    reports = jobs.read_reports(spark, str(tmp_path))
    assert sorted(r.job_id for r in reports.collect()) == ids[:4]
    have = spark.createDataFrame([(i, s, 5, "old", False) for i, s in zip(ids, ["RUNNING", "EVALUATING", "RUNNING", "QUEUED", "RUNNING"])], "job_id string, status string, current_epoch int, reason string, has_version boolean")
    changed, versions = jobs.reconciled(have, reports, spark.createDataFrame([("a", sha)], "path string, sha256 string"))
    got = {r.job_id: (r.status, r.current_epoch, r.reason, r.has_version) for r in changed.collect()}
    assert [got[i] for i in ids] == [("SUCCEEDED", 60, None, True), ("FAILED", 5, jobs.BROKEN, False), ("PAUSED_GPU", 5, "x" * 200, False), ("QUEUED", 5, "old", False), ("RUNNING", 5, "old", False)]
    assert [(r.version_key, r.status) for r in versions.collect()] == [("custom-00000000", "CANDIDATE")]
    # Reports that are merged again change nothing.
    again, more = jobs.reconciled(changed, reports.where("outcome = 'completed'"), spark.createDataFrame([("a", sha)], "path string, sha256 string"))
    assert {r.job_id: r.status for r in again.collect()} == {i: v[0] for i, v in got.items()} | {} and more.count() == 0


def test_use_of_a_version(spark):
    rows = [(1, "ACTIVE", at(0)), (2, "CANDIDATE", at(0)), (3, "CANDIDATE", None), (4, "REJECTED", at(0))]
    v = spark.createDataFrame(rows, "id int, status string, evaluated_at timestamp")
    status = lambda k: [r.status for r in jobs.used(v, k).orderBy("id").collect()]
    assert status(2) == ["INACTIVE", "ACTIVE", "CANDIDATE", "REJECTED"]
    for refused in (3, 4, 9):
        assert status(refused) == [s for _, s, _ in rows]


SAMPLES = "id long, label string, split string, source string, media_kind string, frame_ms long, x double, y double, w double, h double"


def picture(k, label="Xe", split="train", source="s1", kind="VIDEO", ms=0):
    return (k, label, split, source, kind, ms, 0.1, 0.2, 0.3, 0.4)


def test_label_files(spark):
    df = spark.createDataFrame([picture(1), picture(2, "An"), picture(3, ms=40), picture(4, source="s2", split="test", kind="IMAGE", ms=None)], SAMPLES)
    got = {(r.split, r.text) for r in export.label_files(df).collect()}
    line = " 0.250000 0.400000 0.300000 0.400000\n"
    assert got == {("train", f"1{line}0{line}"), ("train", f"1{line}"), ("test", f"1{line}")}
    for bad in (picture(9, split="dev"), picture(9, split="val")):
        with pytest.raises(Exception, match="split"):
            export.label_files(df.union(spark.createDataFrame([bad], SAMPLES))).collect()


def test_export_is_whole_or_nothing(spark, tmp_path):
    sets = export.Datasets(spark, str(tmp_path))
    df = spark.createDataFrame([picture(k, source=f"s{k}") for k in range(4)], SAMPLES)
    assert sets.registered().collect() == []
    # A run that ends after staging, or between the folder and its manifest, leaves no dataset.
    key = export.content_hash(df).first()[0]
    staged = sets.stage(df, key)
    assert sets.registered().collect() == []
    write, sets._write = sets._write, lambda *_: (_ for _ in ()).throw(OSError("killed"))
    with pytest.raises(OSError, match="killed"):
        sets.commit(staged, key, {"labels": ["Xe"]})
    sets._write = write
    assert sets.registered().collect() == []
    assert sets.export(df) == (key, False)
    assert sets.export(df.repartition(3)) == (key, True)
    (row,) = sets.registered().collect()
    assert row[:] == (key, 4, 4, ["Xe"])
    assert spark.read.parquet(f"{tmp_path}/{key}/labels").count() == 4
    assert (tmp_path / key / "data.yaml").read_text().endswith("names:\n  0: Xe\n")
    other, there = sets.export(df.union(spark.createDataFrame([picture(9, split="test", source="s9")], SAMPLES)))
    assert other != key and not there and sets.registered().count() == 2
    assert "test: images/test" in (tmp_path / other / "data.yaml").read_text()


MESSAGES = "id int, at timestamp, action string, label string, duration_seconds int, clip string"


def test_event_list(spark):
    rows = [(1, at(0), "STARTED", "a", None, None), (1, at(5), "STARTED", "b", 9, "z"), (1, at(9), "ENDED", None, 8, None), (2, at(0), "ENDED", None, 3, "c"), (2, at(1), "STARTED", "a", None, "d"), (3, at(0), "STARTED", "c", None, "e"), (3, at(2), "ENDED", None, 5, "f"), (3, at(4), "ENDED", None, None, None), (4, at(0), "ENDED", None, 1, None)]
    df = spark.createDataFrame(rows, MESSAGES)
    want = [(1, at(0), "a", 8, None, True), (2, at(1), "a", None, "d", False), (3, at(0), "c", None, "f", True)]
    assert sorted(map(tuple, messages.event_list(df).collect())) == want
    for cut in range(11):
        begun = df.where(f"second(at) < {cut}")
        assert sorted(map(tuple, messages.merged(messages.event_list(begun), df.where(f"second(at) >= {cut}")).collect())) == want


def test_event_list_as_a_stream(spark, tmp_path):
    """Messages in four batches, upserted by foreachBatch, give the list of all of them."""
    from tessera.streaming.jobs import merge_into

    df = spark.createDataFrame([(k % 7, at(k), "ENDED" if k % 3 == 2 else "STARTED", f"l{k}", k if k % 2 else None, f"c{k}" if k % 5 else None) for k in range(40)], MESSAGES)
    for part in range(4):
        df.where(f"second(at) BETWEEN {10 * part} AND {10 * part + 9}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = messages.event_list(df).schema

    def table(n):
        return spark.read.schema(schema).parquet(str(tmp_path / f"list-{n}")) if n >= 0 else spark.createDataFrame([], schema)

    def keep(batch, n):
        messages.merged(table(n - 1), batch).write.mode("overwrite").parquet(str(tmp_path / f"list-{n}"))

    stream = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    merge_into(stream, keep, str(tmp_path / "check")).awaitTermination(120)
    keep(df.where("second(at) >= 30"), 3)  # a batch that runs again
    assert sorted(map(tuple, table(3).collect())) == sorted(map(tuple, messages.event_list(df).collect()))


def test_paced(spark):
    ms = [0, 40, 120, 520, 921, 1040, 1100]
    reads = spark.createDataFrame([("a", T0 + datetime.timedelta(milliseconds=m)) for m in ms] + [("b", T0)], "camera_id string, at timestamp")
    got = [(r.skipped, r.position) for r in messages.paced(reads, 25, 5).where("camera_id = 'a'").orderBy("at").collect()]
    # 80 ms: one frame; 400 ms: nine, at most five; 401 ms: a pause, none; 119 ms: 2.975 frames, so one; 60 ms: none.
    assert got == [(0, 0), (0, 1), (1, 3), (5, 9), (0, 10), (1, 12), (0, 13)]


def test_versions_are_of_the_best_source():
    box = {"class": "forklift", "confidence": 0.4, "bbox": [80, 90, 260, 210], "source": "aux", "version": "v1"}
    truck = {"class": "truck", "confidence": 0.92, "bbox": [110, 110, 250, 205], "source": "primary"}
    assert frames.suppress([truck, box]) == [box]


def test_votes_are_forgotten():
    votes = lambda f: [n for _, n in frames.stable_classes([(1, "car", 9.0), (f, "truck", 0.5)])]
    assert votes(122) == ["car", "car"] and votes(123) == ["car", "truck"]
