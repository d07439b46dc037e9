"""Batch and streaming runners of the stateful steps.

A frame is a row (camera_id, frame_ts, detections); empty frames count, so frames are never exploded before the
state. State is keyed by camera: renumbered tracks are looked for among all tracks of a camera. A camera's state is a
few sessions; batch runs stream through a camera's frames in time order with only that state in memory.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from itertools import batched, groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from tessera.config import DEFAULT, Thresholds
from tessera.functions import geometry, labels
from tessera.operators.components import components
from tessera.operators.tables import written
from tessera.streaming.frames import plate_leads, told_plates
from tessera.streaming.zone_machine import Hit, Machine, Session, step

TRANSITIONS = "action string, violation_id string, camera_id string, track_id int, zone_id string, object_label string, entered_at timestamp, status string, exited_at timestamp, duration_seconds int"
HITS = "array<struct<track_id: int, zone_id: string, object_label: string, box: array<double>, inside: boolean>>"


def frame_hits(frames: DataFrame, zones: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """camera_id, frame_ts, hits, observed of each frame with detections <track_id, label, x1, y1, x2, y2>.

    Zones are few (a site's drawn areas) and are sent along as one array, so a frame stays one row.
    """
    # What a zone's test needs of it is worked out once: the box around it with the buffer, and its labels folded.
    sides, edge = geometry.envelope(F.col("polygon")), limits.edge_buffer
    around = [(sides[k] + (edge if k.startswith("max") else -edge)).alias(k) for k in ("min_x", "min_y", "max_x", "max_y")]
    allows = F.coalesce(F.col("rule_type") == "ALLOW_SPECIFIED", F.lit(False)).alias("allows")
    zone = F.struct("zone_id", *around, allows, F.transform("target_labels", labels.folded).alias("names"), "polygon")
    site = zones.groupBy("camera_id").agg(F.sort_array(F.collect_list(zone)).alias("zones"))
    joined = frames.join(site, "camera_id", "left")

    def hits_of(d):  # noqa: ANN001, ANN202
        x, y = (d["x1"] + d["x2"]) / 2, d["y2"]

        def hit(z):  # noqa: ANN001, ANN202
            box = F.array(d["x1"], d["y1"], d["x2"], d["y2"])
            return F.struct(d["track_id"].alias("track_id"), z["zone_id"].cast("string").alias("zone_id"), d["label"].alias("object_label"), box.alias("box"), geometry.covers(x, y, z["polygon"]).alias("inside"))

        def broken(z):  # noqa: ANN001, ANN202
            near = (x >= z["min_x"]) & (x <= z["max_x"]) & (y >= z["min_y"]) & (y <= z["max_y"])
            against = F.coalesce(F.array_contains(z["names"], labels.folded(d["label"])), F.lit(False)) != z["allows"]
            return near & against & geometry.near_covers(x, y, z["polygon"], edge)

        return F.transform(F.filter(F.col("zones"), broken), hit)

    tracked = F.filter("detections", lambda d: d["track_id"].isNotNull())
    found = F.when(F.col("zones").isNull(), F.array().cast(HITS)).otherwise(F.flatten(F.transform(tracked, hits_of)))
    return joined.select("camera_id", "frame_ts", found.cast(HITS).alias("hits"), F.transform(tracked, lambda d: d["track_id"]).alias("observed"))


#: Slots that a camera's frames are cut into to find where no session is open.
SLOT_SECONDS = 30


def quiet_cuts(hits: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """hits with `stretch`: between stretches of a camera no session is open, so each can be run alone. Frames of stretches without hits go.

    Every session has ended after a slot that holds no hit, and three frames or more at least missing_seconds after its begin:
    an unseen one by its time, a seen one by its frames without a hit. Slots are counted, frames only joined to them.
    """
    micros, width = F.unix_micros("frame_ts"), int(max(SLOT_SECONDS, 2 * limits.missing_seconds) * 1e6)
    slotted = hits.withColumn("__slot", F.floor(micros / width))
    late = F.pmod(micros, F.lit(width)) >= int(limits.missing_seconds * 1e6)
    found = F.size("hits") > 0
    slots = slotted.groupBy("camera_id", "__slot").agg(F.max(found).alias("__hit"), F.count_if(late).alias("__late"))
    order = Window.partitionBy("camera_id").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    closing = F.when(~F.col("__hit") & (F.col("__late") >= limits.outside_frames), 1).otherwise(0)
    slots = slots.withColumn("stretch", F.coalesce(F.sum(closing).over(order), F.lit(0)))
    live = slots.withColumn("__live", F.max("__hit").over(Window.partitionBy("camera_id", "stretch"))).where("__live").select("camera_id", "__slot", "stretch")
    return slotted.join(live, ["camera_id", "__slot"]).drop("__slot")


def _advance(machine: Machine, frames: Iterable[tuple[float, list[dict], list[int]]], limits: Thresholds) -> list[dict]:
    """The transitions of frames (seconds, hits, observed tracks) in the order of time."""
    out: list[dict] = []
    for at, hits, observed in frames:
        own = [Hit(int(h["track_id"]), h["zone_id"], h["object_label"], tuple(map(float, h["box"])), bool(h["inside"])) for h in hits]
        out += step(machine, at, own, set(observed), limits)
    return out


def _table(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in TRANSITIONS.split(", ")])
    for c in ("entered_at", "exited_at"):
        out[c] = pd.to_datetime(pd.to_numeric(out[c]), unit="s")
    out["duration_seconds"] = out["duration_seconds"].astype("Int32")
    return out


def zone_transitions(hits: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """Batch: the transitions of every camera, from frame_hits; stretches between which no session is open run apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, key = None, None
        for batch in batches:
            rows: list[dict] = []
            for camera, stretch, micros, found, observed in zip(*(c.to_pylist() for c in batch.columns)):
                if (camera, stretch) != key:
                    machine, key = Machine(camera), (camera, stretch)
                rows += _advance(machine, [(micros / 1e6, found, observed)], limits)
            for r in rows:
                r.update({c: None if r[c] is None else round(r[c] * 1e6) for c in ("entered_at", "exited_at")})
            yield pa.RecordBatch.from_pylist(rows, raw)

    whole = to_arrow_schema(hits.sparkSession.createDataFrame([], TRANSITIONS).schema)
    raw = pa.schema([pa.field(f.name, pa.int64() if pa.types.is_timestamp(f.type) else f.type) for f in whole])
    micros = TRANSITIONS.replace(" timestamp", " long")
    cut = quiet_cuts(hits, limits).select("camera_id", "stretch", F.unix_micros("frame_ts").alias("at"), "hits", "observed")
    out = cut.repartition("camera_id", "stretch").sortWithinPartitions("camera_id", "stretch", "at").mapInArrow(run, micros)
    return out.withColumns({c: F.timestamp_micros(c) for c in ("entered_at", "exited_at")})


def _session(t: dict) -> Session:
    """The session of a transition; where its box was is not told, so no other track is near."""
    seconds = lambda v: pd.Timestamp(v).timestamp()
    left = t["entered_at"] if pd.isna(t["exited_at"]) else t["exited_at"]
    return Session(int(t["track_id"]), t["zone_id"], t["object_label"], seconds(t["entered_at"]), seconds(left), (-9.0, -9.0, -9.0, -9.0), t["violation_id"])


class ZoneProcessor(StatefulProcessor):
    """Streaming: the same step with the machine in keyed state."""

    def __init__(self, limits: Thresholds = DEFAULT):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.machine = handle.getValueState("machine", StructType([StructField("json", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        machine = Machine.from_dict(json.loads(self.machine.get()[0])) if self.machine.exists() else Machine(key[0])
        frames = pd.concat(list(rows)).sort_values("frame_ts")
        if "returned" in frames:
            back = frames["returned"].notna()
            for t in frames.loc[back, "returned"]:
                machine.take_back(t["action"], _session(t), self.limits)
            frames = frames[~back]
        seconds = [pd.Timestamp(t).timestamp() for t in frames["frame_ts"]]
        out = _advance(machine, zip(seconds, frames["hits"], frames["observed"]), self.limits)
        self.machine.update((json.dumps(machine.to_dict()),))
        yield _table(out)

    def close(self) -> None:
        pass


def stream_zone_transitions(hits: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """Streaming: needs the RocksDB state store; frames of a micro-batch are put in time order. With a column `returned` (see
    sinks.with_returns) rows that hold a transition take it back before the frames of their batch."""
    return hits.groupBy("camera_id").transformWithStateInPandas(ZoneProcessor(limits), TRANSITIONS, "Append", "None")


GATE_EVENTS = "track_id long, at double, plate string, confidence double"


def _by_group(df: DataFrame, keys: list[str], order: list[str], schema: str, run: Callable[[tuple, Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """Rows of run(key, rows after the key) for the rows of each key in order, streamed."""
    made = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
    k = len(keys)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        out = (x for key, own in groupby(rows, key=lambda r: r[:k]) for x in run(key, (r[k:] for r in own)))
        for some in batched(out, 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), made)], schema=made)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(whole, schema)


def gate_told(reads: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """Batch: frames.gate_events of every camera, from reads (camera_id, track_id, id, at, plate, conf), at in seconds.

    A track's votes need its own reads only. What ties stays to each other are plates in their cooldown: reads of one
    leading plate without a gap of that length are an island, and a stay ties the islands of the plates that lead it
    in turn. A stay is told at the latest at a read that begins an island, so its later reads are left out before that.
    Stays tied so go through one task in the order of time, others apart. Reads without a camera, track or time are left out.
    """
    known = reads.dropna(subset=["camera_id", "track_id", "at"]).select("camera_id", "track_id", "id", "at", "plate", "conf")
    votes = lambda key, own: ((*key, *r) for r in plate_leads(own, limits))
    columns = "camera_id string, track_id long, id long, at double, begin double, plate string, conf double"
    leads = _by_group(known, ["camera_id", "track_id"], ["at", "id"], columns, votes)
    of_plate = Window.partitionBy("camera_id", "plate").orderBy("at", "id")
    of_stay = Window.partitionBy("camera_id", "track_id", "begin")
    begins = F.coalesce(F.col("at") - F.lag("at").over(of_plate) >= limits.plate_cooldown_seconds, F.lit(True))
    before = F.max("__begins").over(of_stay.orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1))
    still = leads.withColumn("__begins", begins).withColumn("__told", F.coalesce(before, F.lit(False))).where("NOT __told")
    since = F.max(F.when(begins, F.col("at"))).over(of_plate.rowsBetween(Window.unboundedPreceding, 0))
    still = still.drop("__begins", "__told").withColumn("__since", since)
    # Two islands of one number only go through one task.
    still = still.withColumn("island", F.xxhash64("camera_id", "plate", "__since")).drop("__since")
    still = written(still.withColumn("first", F.min("island").over(of_stay)))
    ties = still.where("island != first").select(F.col("island").alias("a"), F.col("first").alias("b"))
    tied = still.join(components(ties).withColumnRenamed("node", "island"), "island", "left")
    rows = tied.select("camera_id", F.coalesce("root", "island").alias("root"), "at", "track_id", "begin", "plate", "conf", "id")
    told = lambda key, own: ((t, a, p, c) for a, t, p, c in told_plates((r[:5] for r in own), limits))
    return _by_group(rows, ["camera_id", "root"], ["at", "id"], GATE_EVENTS, told)
