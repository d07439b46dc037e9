"""Sinks that survive failures and restarts, registries that keep their last good state, and timed clip jobs."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tessera.config import DEFAULT, Thresholds
from tessera.streaming.runners import TRANSITIONS

_SORTS = ["STARTED", "ENDED"]


def store_in(path: str) -> Callable[[DataFrame, int], None]:
    """Keeps a batch's transitions in the folder of its number: a batch that runs again replaces itself."""

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return keep


def stored(spark: SparkSession, path: str) -> DataFrame:
    """One row for each stored violation: its start, with the end's status and times if that is stored too. Ends without a start are nothing."""
    rows = spark.read.schema(TRANSITIONS).parquet(path)
    start = rows.where("action = 'STARTED'").groupBy("violation_id").agg(*[F.first(c).alias(c) for c in ("camera_id", "track_id", "zone_id", "object_label", "entered_at")])
    end = rows.where("action = 'ENDED'").groupBy("violation_id").agg(F.max(F.struct("exited_at", "duration_seconds")).alias("e"))
    joined = start.join(end, "violation_id", "left")
    return joined.select(*start.columns, F.when(F.col("e").isNotNull(), "CLOSED").otherwise("OPEN").alias("status"), "e.exited_at", "e.duration_seconds")


class ReturningSink:
    """For foreachBatch: hands each batch to keep(rows, batch); if that fails, its transitions go to the folder of returns.

    A stream that reads the returns (with_returns) takes them back into the state: a start is dropped and found anew, an
    end is told again. The rows of a batch are written down before they are handed on, so that both see the same ones. A
    batch that runs again is stored again under its number, unless it was returned before: then it stays returned.
    """

    def __init__(self, keep: Callable[[DataFrame, int], None], folder: str):
        self.keep, self.folder = keep, folder.rstrip("/")

    def __call__(self, rows: DataFrame, batch: int) -> None:
        spark, told, returned = rows.sparkSession, f"{self.folder}/told/batch={batch}", f"{self.folder}/returns/batch={batch}"
        if _exists(spark, f"{returned}/_SUCCESS"):
            return
        rows.write.mode("overwrite").parquet(told)
        same = spark.read.schema(rows.schema).parquet(told)
        try:
            self.keep(same, batch)
        except Exception as e:  # noqa: BLE001 (whatever the store does, its rows come back)
            _warn(spark, f"batch {batch} was not stored: {e}")
            same.write.mode("overwrite").parquet(returned)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _warn(spark: SparkSession, text: str) -> None:
    spark._jvm.org.apache.logging.log4j.LogManager.getLogger("tessera").warn(text)


def with_returns(hits: DataFrame, folder: str, schema: str = TRANSITIONS) -> DataFrame:
    """The stream of hits and the stream of a ReturningSink's returns as one, for stream_zone_transitions."""
    spark = hits.sparkSession
    back = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder.rstrip('/')}/returns")
    returned = F.struct("action", "violation_id", "track_id", "zone_id", "object_label", "entered_at", "exited_at")
    rows = back.select("camera_id", F.coalesce("exited_at", "entered_at").alias("frame_ts"), F.array().cast(hits.schema["hits"].dataType).alias("hits"), F.array().cast("array<int>").alias("observed"), returned.alias("returned"))
    none = F.lit(None).cast(rows.schema["returned"].dataType)
    return hits.select("camera_id", "frame_ts", "hits", "observed", none.alias("returned")).unionByName(rows)


class LastGood:
    """A small registry (zones, labels) read anew every few seconds, for use in foreachBatch; on an error the last good state stays.

    read() gives the registry as a DataFrame. Each new state is written to `folder` under the next version, so that a
    restart begins with the last good one. A registry of more than `most` rows is an error as others are: it is sent to all tasks.
    """

    def __init__(self, spark: SparkSession, read: Callable[[], DataFrame], schema: str, folder: str, every: float = 5.0, most: int = 10_000, clock: Callable[[], float] = time.monotonic):
        self.spark, self.read, self.schema, self.folder, self.every, self.most, self.clock = spark, read, schema, folder.rstrip("/"), every, most, clock
        self.read_at: float | None = None
        self.version = self._last()
        self.rows = spark.read.schema(schema).parquet(f"{self.folder}/version={self.version}").collect() if self.version else []

    def _last(self) -> int:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        pattern = path(f"{self.folder}/version=*/_SUCCESS")
        found = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(pattern)
        return max((int(f.getPath().getParent().getName().split("=")[1]) for f in found or []), default=0)

    def refresh(self) -> bool:
        """Whether the registry could be read."""
        try:
            rows = self.read().select([f.name for f in self.spark.createDataFrame([], self.schema).schema]).limit(self.most + 1).collect()
            if len(rows) > self.most:
                raise ValueError(f"over {self.most} rows")
        except Exception as e:  # noqa: BLE001 (a registry that cannot be read keeps its state)
            _warn(self.spark, f"registry kept as it was: {e}")
            return False
        if not self.version or sorted(map(str, rows)) != sorted(map(str, self.rows)):
            self.rows, self.version = rows, self.version + 1
            self.spark.createDataFrame(rows, self.schema).write.mode("overwrite").parquet(f"{self.folder}/version={self.version}")
        return True

    def table(self) -> DataFrame:
        now = self.clock()
        if self.read_at is None or now - self.read_at >= self.every:
            self.refresh()
            self.read_at = now
        return self.spark.createDataFrame(self.rows, self.schema)


CLIPS = "violation_id string, camera_id string, clip_from timestamp, clip_to timestamp, file_name string"


class ClipProcessor(StatefulProcessor):
    """A timer for each started session; when it goes off the clip's job is told. Ends change nothing."""

    def __init__(self, seconds: float):
        self.micros = int(seconds * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.started = handle.getValueState("started", StructType([StructField("camera", StringType()), StructField("at", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        for batch in rows:
            for camera, at in batch.loc[batch["action"] == "STARTED", ["camera_id", "entered_at"]].itertuples(index=False):
                if not self.started.exists():
                    micros = pd.Timestamp(at).value // 1000
                    self.started.update((camera, micros))
                    self.handle.registerTimer(-(-(micros + self.micros) // 1000))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        camera, at = self.started.get()
        begin = pd.to_datetime(at, unit="us")
        yield pd.DataFrame([(key[0], camera, begin, begin + pd.Timedelta(microseconds=self.micros), f"area_{key[0]}.mp4")], columns=[c.split()[0] for c in CLIPS.split(", ")])

    def close(self) -> None:
        pass


def clip_jobs(transitions: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """Streaming: one clip job for each started session, `clip_before_seconds` after its begin in event time, also if it has ended by then.

    transitions need a watermark on `told_at`, the time of the frame that told them. A job is told when the watermark has
    passed its end, so its frames are there; jobs that wait are timers in the state and outlive a restart.
    """
    processor = ClipProcessor(limits.clip_before_seconds)
    return transitions.groupBy("violation_id").transformWithStateInPandas(processor, CLIPS, "Append", "EventTime")
