"""Computations over ordered rows: votes, motion, sessions by gaps, percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import DEFAULT, Thresholds
from tessera.functions.plates import plate_key


def plate_votes(reads: DataFrame, track: str = "track_id", plate: str = "plate") -> DataFrame:
    """Each track's plate by votes: completeness, best confidence and up to five reads; the first read of equals."""
    usable = reads.where(F.length(plate_key(F.col(plate))) >= 6)
    each = usable.groupBy(track, plate).agg(F.count("*").alias("n"), F.max("conf").alias("best"), F.min("id").alias("first"))
    full = F.when(F.length(plate_key(F.col(plate))).between(7, 9), 4.0).otherwise(2.0)
    scored = each.withColumn("score", F.round(2 * full + 2.5 * F.col("best") + 0.4 * F.least(F.lit(5), "n"), 6))
    return scored.groupBy(track).agg(F.max_by(F.struct(plate, "score"), F.struct("score", -F.col("first"))).alias("r")).select(track, "r.*")


def motion(points: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """Speed over the last `motion_window` points of a track (straight from the first to the last) and whether it stands still."""
    n = limits.motion_window
    order = Window.partitionBy("track_id").orderBy("frame_no")
    back = order.rowsBetween(-(n - 1), 0)
    first = lambda c: F.first(c).over(back)
    seen = F.count("*").over(back)
    speed = F.try_divide(F.hypot(F.col("px") - first("px"), F.col("py") - first("py")), seen - 1)
    return points.withColumns({"points": seen, "speed": F.coalesce(speed, F.lit(0.0))}).withColumn("is_static", (F.col("points") == n) & (F.col("speed") < limits.static_speed))


def islands(rows: DataFrame, keys: list[str], at: str, gap: int) -> DataFrame:
    """Stretches of rows in which no two neighbours are more than `gap` apart: first, last, n."""
    order = Window.partitionBy(*keys).orderBy(at)
    fresh = F.when(F.col(at) - F.lag(at).over(order) <= gap, 0).otherwise(1)
    marked = rows.withColumn("__new", fresh).withColumn("island", F.sum("__new").over(order))
    return marked.groupBy(*keys, "island").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))


def latency(df: DataFrame, keys: list[str], ms: str) -> DataFrame:
    """Mean, median and nearest-rank 95 % point (rank by half-even rounding), and frames a second by the mean.

    Rows are counted by value first, so that only distinct values are ranked. Null times do not count.
    """
    counts = df.where(F.col(ms).isNotNull()).groupBy(*keys, ms).agg(F.count("*").alias("__c"))
    key = Window.partitionBy(*keys)
    ranked = counts.withColumns({"__to": F.sum("__c").over(key.orderBy(ms)), "__n": F.sum("__c").over(key)})
    at = lambda rank: F.max(F.when((F.col("__to") - F.col("__c") <= rank) & (rank < F.col("__to")), F.col(ms)))
    last = F.col("__n") - 1
    mean = F.sum(F.col(ms) * F.col("__c")) / F.sum("__c")
    out = ranked.groupBy(*keys).agg(mean.alias("mean"), ((at(F.floor(last / 2)) + at(F.ceil(last / 2))) / 2).alias("median"), at(F.bround(0.95 * last, 0)).alias("p95"))
    return out.withColumn("fps", F.try_divide(F.lit(1000.0), F.col("mean")))


def smoothed(rows: DataFrame, key: str, at: str, value: str, alpha: float) -> DataFrame:
    """Exponential mean of each key's values in order, seeded by the first; a key's rows are one track's."""
    listed = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(at).alias("t"), F.col(value).alias("v")))).alias("s"))
    start = F.get("s", 0)["v"]
    level = F.aggregate(F.slice("s", F.lit(2), F.greatest(F.size("s") - 1, F.lit(0))), start, lambda a, x: a * (1 - alpha) + x["v"] * alpha)
    return listed.select(key, level.alias(value))


def palette(df: DataFrame, order: str, n: int) -> DataFrame:
    """A color number by place in the order; for short lists such as labels."""
    return df.withColumn("color", (F.row_number().over(Window.orderBy(order)) - 1) % n)
