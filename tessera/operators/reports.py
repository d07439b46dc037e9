"""Figures for a day or a site, and rows that break a table's constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gate_figures(events: DataFrame) -> DataFrame:
    """All, unread (no confidence), read, and the rate of those read in percent (100 without events)."""
    out = events.agg(F.count("*").alias("total"), F.count_if(F.col("confidence").isNull()).alias("unread"))
    out = out.withColumn("read", F.col("total") - F.col("unread"))
    return out.withColumn("read_rate", F.when(F.col("total") > 0, F.floor(F.try_divide(F.col("read") * 100, F.col("total")) + 0.5)).otherwise(100))


def daily_figures(events: DataFrame) -> DataFrame:
    """Of each day and camera: entries, plates read, unread, mean confidence of those read."""
    read = F.coalesce(F.col("confidence") > 0, F.lit(False))
    out = events.groupBy(F.to_date("ts").alias("day"), "camera_id").agg(F.count("*").alias("entries"), F.count_if(read).alias("plates_read"), F.avg(F.when(read, F.col("confidence"))).alias("mean"))
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "camera_id", "entries", "plates_read", (F.col("entries") - F.col("plates_read")).alias("unread"), F.round(F.coalesce("mean", F.lit(0.0)), 9).alias("mean_confidence"))


def zone_figures(violations: DataFrame, zones: DataFrame) -> DataFrame:
    """Violations, open ones and mean duration of every zone, also of those without any."""
    stats = violations.groupBy("zone_id").agg(F.count("*").alias("violations"), F.count_if(F.col("status") == "OPEN").alias("open"), F.avg("duration_seconds").alias("mean"))
    out = zones.select("zone_id", "name").join(stats, "zone_id", "left")
    return out.select("zone_id", "name", F.coalesce("violations", F.lit(0)).alias("violations"), F.coalesce("open", F.lit(0)).alias("open"), F.round(F.coalesce("mean", F.lit(0.0)), 6).alias("mean_duration"))


def constraints(table: str) -> dict[str, Column]:
    """Checks by name; null passes, as in SQL."""
    c = F.col
    return {
        "gate_events": {"lane": c("lane").isin("IN_1", "IN_2"), "status": c("status").isin("KNOWN", "STRANGER"), "confidence": c("confidence").between(0, 1), "plate length": F.length("license_plate") <= 20},
        "violations": {"status": c("status").isin("OPEN", "CLOSED"), "duration": c("duration_seconds") >= 0, "closed has duration": (c("status") != "CLOSED") | c("duration_seconds").isNotNull()},
        "vehicles": {"status": c("status").isin("KNOWN", "STRANGER")},
        "samples": {"media kind": c("media_kind").isin("IMAGE", "VIDEO"), "time of videos only": (c("media_kind") == "VIDEO") == c("frame_ms").isNotNull(), "box width": c("w") > 0},
    }[table]


def broken(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows that break each check, counted in one pass."""
    counts = df.agg(*[F.count_if(~F.coalesce(check, F.lit(True))).alias(name) for name, check in checks.items()])
    return counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, checks)), F.array(*[F.col(f"`{n}`") for n in checks]))).alias("check", "broken"))
