"""Batch and stream runners of steps over the frames of a camera.

A frame is a row (camera_id, frame_ts, boxes), one for each camera and time; frames without boxes count. A step is an
object with `frame(at, boxes) -> rows` whose fields are its state, as plain values. Batch and stream give the same rows.

A camera's frames are a sequence, so one task goes through them with a few boxes of state. What makes them parallel is
pauses: time is cut into slots of `pause_seconds`; after a slot without frames of a camera the step begins anew, as after
a reset of the source. Such stretches are found on the distinct slots alone, and dealt to tasks one by one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from tessera.config import DEFAULT, Thresholds

#: What every row of a fold begins with: the camera, when its stretch began (microseconds), the frame.
HEAD = "camera_id string, stretch long, frame_ts timestamp"


def stretches(frames: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """frames with `stretch`, when a camera's stretch of slots that all hold frames began. Where frames have an `epoch` (the number of
    source resets so far: seeks, loops), a new one begins a new stretch too."""
    micros = F.unix_micros("frame_ts")
    epoch = F.col("epoch").cast("long") if "epoch" in frames.columns else F.lit(0).cast("long")
    slotted = frames.withColumns({"__slot": F.floor(micros / int(limits.pause_seconds * 1e6)), "__epoch": F.coalesce(epoch, F.lit(0))})
    order = Window.partitionBy("camera_id").orderBy("__begin")
    slots = slotted.groupBy("camera_id", "__epoch", "__slot").agg(F.min(micros).alias("__begin"))
    same = (F.col("__slot") - F.lag("__slot").over(order) <= 1) & (F.col("__epoch") == F.lag("__epoch").over(order))
    slots = slots.withColumn("__first", F.when(~F.coalesce(same, F.lit(False)), F.col("__begin")))
    slots = slots.select("camera_id", "__epoch", "__slot", F.last("__first", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("stretch"))
    return slotted.join(slots, ["camera_id", "__epoch", "__slot"]).drop("__slot", "__epoch")


def fold(frames: DataFrame, step: type, columns: str, limits: Thresholds = DEFAULT) -> DataFrame:
    """Batch: the rows (HEAD and `columns`) of step(limits=...) over each stretch of each camera in the order of time."""
    out = f"{HEAD}, {columns}"
    schema = to_arrow_schema(frames.sparkSession.createDataFrame([], out).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in batches:
            rows: list[dict] = []
            for camera, stretch, ts, boxes in zip(*(c.to_pylist() for c in batch.columns)):
                if (camera, stretch) != at:
                    at, own = (camera, stretch), step(limits=limits)
                rows += [{"camera_id": camera, "stretch": stretch, "frame_ts": ts, **r} for r in own.frame(ts.timestamp(), boxes or [])]
            yield pa.RecordBatch.from_pylist(rows, schema)

    own = stretches(frames, limits).select("camera_id", "stretch", "frame_ts", "boxes")
    return own.repartition("camera_id", "stretch").sortWithinPartitions("camera_id", "stretch", "frame_ts").mapInArrow(run, out)


def _plain(x: object) -> object:
    """A value of a pandas cell as lists, dicts and scalars."""
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if hasattr(x, "asDict"):
        return _plain(x.asDict())
    if hasattr(x, "tolist"):
        x = x.tolist()
    return [_plain(v) for v in x] if isinstance(x, list) else x


class FoldProcessor(StatefulProcessor):
    """Streaming: the same step, its fields kept as keyed state."""

    def __init__(self, step: type, columns: str, limits: Thresholds):
        self.step, self.limits = step, limits
        self.names = [c.split()[0] for c in HEAD.split(", ")] + [c.split(" ")[0] for c in columns.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("step", StructType([StructField("json", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        held = json.loads(self.state.get()[0]) if self.state.exists() else {"last": None, "slot": None, "epoch": 0, "stretch": None, "step": None}
        own = self.step.revive(held["step"], self.limits) if held["step"] else self.step(limits=self.limits)
        out = []
        frames = pd.concat(list(rows)).sort_values("frame_ts")
        epochs = frames["epoch"].fillna(0).astype("int64") if "epoch" in frames else [0] * len(frames)
        for ts, boxes, epoch in zip(frames["frame_ts"], frames["boxes"], map(int, epochs)):
            at = pd.Timestamp(ts).tz_localize("UTC").timestamp() if pd.Timestamp(ts).tz is None else pd.Timestamp(ts).timestamp()
            if held["last"] is not None and at <= held["last"]:
                continue
            micros = round(at * 1e6)
            slot = micros // int(self.limits.pause_seconds * 1e6)
            if held["slot"] is None or slot - held["slot"] > 1 or epoch != held["epoch"]:
                own, held["stretch"] = self.step(limits=self.limits), micros
            held["last"], held["slot"], held["epoch"] = at, slot, epoch
            out += [{"camera_id": key[0], "stretch": held["stretch"], "frame_ts": ts, **r} for r in own.frame(at, _plain(boxes) if boxes is not None else [])]
        held["step"] = own.state()
        self.state.update((json.dumps(held),))
        yield pd.DataFrame(out, columns=self.names).astype(object) if out else pd.DataFrame({n: pd.Series([], dtype=object) for n in self.names})

    def close(self) -> None:
        pass


def stream_fold(frames: DataFrame, step: type, columns: str, limits: Thresholds = DEFAULT) -> DataFrame:
    """Streaming: as fold; needs the RocksDB state store. A frame that is not later than its camera's last one is left out."""
    processor = FoldProcessor(step, columns, limits)
    return frames.groupBy("camera_id").transformWithStateInPandas(processor, f"{HEAD}, {columns}", "Append", "None")


class Step:
    """Base of steps that are dataclasses with the field `limits`; all other fields are state."""

    def state(self) -> dict:
        return {k: v for k, v in asdict(self).items() if k != "limits"}

    @classmethod
    def revive(cls, state: dict, limits: Thresholds):  # noqa: ANN206
        return cls(limits=limits, **state)
