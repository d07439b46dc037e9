"""Streaming jobs: sources, watermarks and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def frame_source(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """Frame rows from JSON files as they come; event time is frame_ts, 30 s of lateness (over the 12 s of a missing track)."""
    frames = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)
    return frames.withColumn("frame_ts", F.col("frame_ts").cast("timestamp")).withWatermark("frame_ts", "30 seconds")


def paced(frames: DataFrame, source_fps: float, target_fps: float) -> DataFrame:
    """Every n-th frame by number, n = round(source / target)."""
    return frames.where(F.col("frame_no") % max(1, round(source_fps / target_fps)) == 0)


def _frame_at(seconds: float, fps: float, duration: float | None) -> int:
    """The frame at a position, which is moved to the start or the end if it lies before or after."""
    return round(max(0.0, seconds if duration is None else min(seconds, duration)) * fps)


def seek(frames: DataFrame, seconds: float, fps: float, duration: float | None = None) -> DataFrame:
    """Frames from a position on."""
    return frames.where(F.col("frame_no") >= _frame_at(seconds, fps, duration))


def preview(frames: DataFrame, seconds: float, fps: float, duration: float | None = None) -> DataFrame:
    """The one frame at a position; whoever reads on is not moved."""
    return frames.where(F.col("frame_no") == _frame_at(seconds, fps, duration))


def epochs(frames: DataFrame) -> DataFrame:
    """Numbers the stretches between source resets of each camera."""
    from pyspark.sql import Window

    order = Window.partitionBy("camera_id").orderBy("frame_no")
    return frames.withColumn("epoch", F.sum(F.col("source_reset").cast("int")).over(order))


def latest_alerts(alerts: DataFrame) -> DataFrame:
    """Alerts once each, by id within the watermark."""
    return alerts.withWatermark("at", "30 seconds").dropDuplicatesWithinWatermark(["id"])


def to_channels(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Each channel's rows to its own partition of a folder, once each."""
    return stream.writeStream.partitionBy("channel").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_into(stream: DataFrame, keep, checkpoint: str) -> StreamingQuery:  # noqa: ANN001
    """Hands every micro-batch to keep(df, batch_id), for upserts."""
    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fps(frames: DataFrame) -> DataFrame:
    """Frames in each second of each camera."""
    return frames.groupBy("camera_id", F.window("frame_ts", "1 second")).agg(F.count("*").alias("frames"))
