"""Lists that messages keep up to date: the event list of a viewer, visits of plates, paced reading of a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def event_list(messages: DataFrame) -> DataFrame:
    """Messages (id, at, action, label, duration_seconds, clip) -> one row for each event that has begun.

    The first STARTED of an id makes its row, later ones change nothing. An ENDED after it (in the order of `at`, of one
    time STARTED first) sets the duration, null too, and the clip if it has one. What ends before it has begun is nothing.
    Rows of one id that arrive in parts give the same when merged again: see merged().
    """
    begun = F.col("action") == "STARTED"
    first = messages.where(begun).groupBy("id").agg(F.min("at").alias("at"), F.min_by(F.struct("label", F.col("duration_seconds").alias("d"), F.col("clip").alias("c")), "at").alias("s"))
    ends = messages.where(~begun).select("id", F.col("at").alias("end_at"), "duration_seconds", "clip")
    last = first.join(ends, "id").where("end_at >= at").groupBy("id").agg(F.max("end_at").alias("end_at"), F.max_by(F.struct("duration_seconds"), "end_at").alias("e"), F.max_by("clip", F.when(F.col("clip").isNotNull(), F.col("end_at"))).alias("clip"))
    joined = first.join(last, "id", "left")
    duration = F.when(F.col("end_at").isNotNull(), F.col("e.duration_seconds")).otherwise(F.col("s.d"))
    return joined.select("id", "at", F.col("s.label").alias("label"), duration.alias("duration_seconds"), F.coalesce("clip", "s.c").alias("clip"), F.col("end_at").isNotNull().alias("ended"))


def merged(rows: DataFrame, messages: DataFrame) -> DataFrame:
    """The event list `rows` after more messages, which are later than those that made it: for update-mode upserts."""
    columns = ["id", "at", "action", "label", "duration_seconds", "clip"]
    kept = rows.select("id", "at", F.lit("STARTED").alias("action"), "label", "duration_seconds", "clip")
    out = event_list(kept.unionByName(messages.select(columns)))
    ended = rows.where("ended").select("id", F.lit(True).alias("__ended"))
    return out.join(ended, "id", "left").withColumn("ended", F.col("ended") | F.coalesce("__ended", F.lit(False))).drop("__ended")


def visits(vehicles: DataFrame, events: DataFrame) -> DataFrame:
    """plate, visits, status: a known plate (plate, visits, status; no visits count as one) with one more visit for each event (plate, status,
    at), an unknown one with its events alone. The status that was first stays; events without a plate count for none."""
    seen = events.where("plate IS NOT NULL").groupBy("plate").agg(F.count("*").alias("more"), F.min_by("status", "at").alias("first"))
    joined = vehicles.select("plate", "visits", "status", F.lit(True).alias("known")).join(seen, "plate", "full")
    before = F.when(F.col("known"), F.coalesce(F.nullif("visits", F.lit(0)), F.lit(1))).otherwise(0)
    return joined.select("plate", (before + F.coalesce("more", F.lit(0))).cast("long").alias("visits"), F.coalesce("status", "first").alias("status"))


def paced(reads: DataFrame, source_fps: float, target_fps: float, longest: float = 0.4) -> DataFrame:
    """reads (camera_id, at) of a video file with `skipped`, the frames left out before each, and `position`, the frame read.

    A read skips as many frames as the time since the read before was longer than one frame, at most source / target of
    them; none if that time is over `longest` seconds (a pause or a seek) or there is no read before.
    """
    order = Window.partitionBy("camera_id").orderBy("at")
    gap = (F.unix_micros("at") - F.lag(F.unix_micros("at")).over(order)) / 1e6
    most = max(1, round(source_fps / max(1.0, target_fps)))
    skip = F.when(gap <= longest, F.least(F.lit(most), F.greatest(F.lit(0), F.floor(gap * source_fps - 1)))).otherwise(0).cast("int")
    out = reads.withColumn("skipped", F.coalesce(skip, F.lit(0)))
    return out.withColumn("position", F.sum(F.col("skipped") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
