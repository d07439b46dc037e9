"""Queries of the steps that carry boxes over frames; held against plain loops in the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import shapes
from tessera.plans.domain import view
from tessera.plans.registry import query
from tessera.streaming import tracking
from tessera.streaming.folds import fold

WIDTH, HEIGHT = 1280, 720


def camera_frames(spark: SparkSession, d: str) -> DataFrame:
    """camera_id, frame_ts, boxes of every frame, also those without boxes; boxes are in the order of their place."""
    seen = view(spark, d, "sightings")
    sides = F.struct(F.col("x1"), F.col("y1"), (F.col("x1") + F.col("wide")).alias("x2"), (F.col("y1") + F.col("high")).alias("y2"))
    corner = lambda x, y: (F.col(x) + F.col(y)).cast("int")
    bbox = F.array(F.col("x1").cast("int"), F.col("y1").cast("int"), corner("x1", "wide"), corner("y1", "high"))
    plate = F.array((F.col("x1") + 30).cast("int"), (F.col("y1") + 50).cast("int"), (F.col("x1") + 70 + F.col("step") % 4).cast("int"), (F.col("y1") + 64).cast("int"))
    box = F.struct(
        "slot", F.col("track_id").cast("int").alias("track_id"), "class", F.initcap("class").alias("label"), F.col("class").alias("raw_class"), "source", "version", "confirmed", "confidence", bbox.alias("bbox"),
        shapes.shape_ok(F.col("class"), sides, WIDTH, HEIGHT).alias("shape_ok"), shapes.share(sides, WIDTH, HEIGHT).alias("area"),
        F.when(F.col("zone").isNotNull(), F.array("zone")).otherwise(F.array().cast("array<string>")).alias("zones"),
        F.when(F.col("plate").isNotNull(), plate).alias("plate_box"), "plate", F.when(F.col("plate").isNotNull(), F.col("confidence")).alias("plate_confidence"),
    )
    frames = seen.groupBy("camera_id", "frame_no").agg(F.sort_array(F.collect_list(F.when(F.col("present"), box))).alias("boxes"))
    return frames.select("camera_id", F.timestamp_millis(F.col("frame_no") * 300).alias("frame_ts"), "boxes")


@query()
def retained_frames(spark: SparkSession, d: str) -> DataFrame:
    return fold(camera_frames(spark, d), tracking.Retention, tracking.KEPT)


@query()
def custom_labels(spark: SparkSession, d: str) -> DataFrame:
    return fold(camera_frames(spark, d), tracking.CustomLabels, tracking.KEPT)


@query()
def gate_tracks(spark: SparkSession, d: str) -> DataFrame:
    return fold(camera_frames(spark, d), tracking.GateTracks, tracking.GATE)


@query()
def shown_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Identities shown for the boxes in zones, sides as parts of the picture."""
    frames = camera_frames(spark, d)
    part = lambda b: F.transform(b["bbox"], lambda v, k: v / F.when(k % 2 == 0, float(WIDTH)).otherwise(float(HEIGHT)))
    scaled = F.transform("boxes", lambda b: F.struct(b["track_id"].alias("track_id"), b["class"].alias("class"), part(b).alias("bbox"), b["zones"].alias("zones")))
    return fold(frames.withColumn("boxes", scaled), tracking.Shown, tracking.SHOWN)
