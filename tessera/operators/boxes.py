"""Filters and changes of detection boxes, as columns and small joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import DEFAULT, Thresholds
from tessera.functions import geometry


def classes_only(boxes: DataFrame, names: list[str]) -> DataFrame:
    return boxes.where(F.col("class").isin(names))


def canonical_class(c: Column) -> Column:
    """Trains and buses count as trucks."""
    return F.when(c.isin("train", "bus"), "truck").otherwise(c)


def small_truck_is_car(cls: Column, share: Column, aspect: Column, height: Column) -> Column:
    return F.when((cls == "truck") & (share <= 0.008) & (aspect >= 1.30) & (height <= 110), "car").otherwise(cls)


def gate_vehicles(boxes: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """Cars, trucks and buses of at least the size that a gate camera can read (pixels)."""
    wide, high = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return boxes.where(F.col("class").isin("car", "truck", "bus") & (wide >= limits.vehicle_min_width) & (high >= limits.vehicle_min_height))


def plate_candidate(width: Column, height: Column, top: Column, vehicle_height: Column, confidence: Column) -> Column:
    """Whether a box in a vehicle's crop can be its plate: shape, place (low on the vehicle), confidence."""
    aspect = F.try_divide(width, height)
    low = (top >= F.floor(0.38 * vehicle_height)) & ((vehicle_height <= 100) | (top >= F.floor(0.55 * vehicle_height)))
    return F.coalesce(aspect.between(1.1, 6.0) & low & (confidence >= 0.20), F.lit(False))


def best_plate(candidates: Column) -> Column:
    """Of array<struct<text, confidence>> the longest text without spaces, then the surest."""
    rank = lambda x: F.struct(F.length(F.replace(x["text"], F.lit(" "), F.lit(""))).alias("n"), x["confidence"].alias("c"), x["text"].alias("text"))
    return F.array_max(F.transform(candidates, rank))["text"]


def best_targets(boxes: DataFrame, targets: DataFrame, keys: list[str], least: float = 0.18) -> DataFrame:
    """For each box the target of its frame with the greatest overlap (the first of equals), if that reaches `least`."""
    a = boxes.select(*keys, *[F.col(c).alias(f"a_{c}") for c in ("id", "x1", "y1", "x2", "y2")])
    b = targets.select(*keys, *[F.col(c).alias(f"b_{c}") for c in ("id", "x1", "y1", "x2", "y2")])
    pairs = a.join(b, keys).where("a_id <> b_id").withColumn("overlap", F.round(geometry.overlap(geometry.box("a_"), geometry.box("b_")), 9))
    best = pairs.where(F.col("overlap") >= least).groupBy(F.col("a_id").alias("id")).agg(F.max_by(F.struct("b_id", "overlap"), F.struct("overlap", -F.col("b_id"))).alias("r"))
    return best.select("id", F.col("r.b_id").alias("target_id"), "r.overlap")


def relative_plate(vehicle: geometry.Box, plate: geometry.Box) -> dict[str, Column]:
    """A plate box within its vehicle's, drawn into 0..1."""
    w, h = F.greatest(vehicle[2] - vehicle[0], F.lit(1)), F.greatest(vehicle[3] - vehicle[1], F.lit(1))
    part = lambda v, start, size: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - start) / size))
    return {"rx1": part(plate[0], vehicle[0], w), "ry1": part(plate[1], vehicle[1], h), "rx2": part(plate[2], vehicle[0], w), "ry2": part(plate[3], vehicle[1], h)}


def absolute_plate(vehicle: geometry.Box) -> dict[str, Column]:
    """The inverse, for the columns rx1..ry2."""
    w, h = vehicle[2] - vehicle[0], vehicle[3] - vehicle[1]
    return {"x1": (vehicle[0] + F.col("rx1") * w).cast("int"), "y1": (vehicle[1] + F.col("ry1") * h).cast("int"), "x2": (vehicle[0] + F.col("rx2") * w).cast("int"), "y2": (vehicle[1] + F.col("ry2") * h).cast("int")}


def unit_box(*sides: Column) -> list[Column]:
    """Sides as shares of one; if any is over 1 they are percents."""
    percent = F.greatest(*sides) > 1
    return [F.when(percent, s / 100).otherwise(s) for s in sides]


def unit_box_fits(*sides: Column) -> Column:
    """Whether x, y, width and height, in percents or parts, make a box within the picture; false if any is missing."""
    x, y, w, h = unit_box(*sides)
    known = F.greatest(*[F.isnull(s) | F.isnan(s) for s in sides])
    return F.coalesce(~known & (x >= 0) & (y >= 0) & (w > 0) & (h > 0) & (x + w <= 1) & (y + h <= 1), F.lit(False))


def faded(confidence: Column, progress: Column) -> Column:
    """The confidence of a box that is kept though it was missed."""
    return confidence * F.greatest(F.lit(0.5), 1 - 0.5 * progress)


def even_choice(items: Column, n: int) -> Column:
    """At most n of an array, evenly spaced from the first to the last."""
    size = F.size(items)
    at = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.floor(k * (size - 1) / max(n - 1, 1)).cast("int")))
    return F.when(size <= n, items).otherwise(F.transform(at, lambda k: F.get(items, k)))


def missed_frames(boxes: DataFrame, frames: int = 14) -> DataFrame:
    """Boxes with the number of frames for which they stand in for a missed one of their track, at most so many."""
    from pyspark.sql import Window

    order = Window.partitionBy("track_id").orderBy("frame_no")
    gap = F.lead("frame_no").over(order) - F.col("frame_no") - 1
    return boxes.withColumn("stands_for", F.least(F.coalesce(gap, F.lit(frames)), F.lit(frames)))
