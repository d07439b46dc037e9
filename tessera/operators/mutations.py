"""Row changes as functions from old to new tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def seconds_between(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0), F.floor((F.unix_micros(end) - F.unix_micros(start)) / 1e6)).cast("long")


def close_violations(violations: DataFrame, closing: DataFrame) -> DataFrame:
    """closing (id, exited_at, clip_path): those rows become CLOSED with their duration; a null clip keeps the old one."""
    new = closing.select("id", F.col("exited_at").alias("__exit"), F.col("clip_path").alias("__clip"), F.lit(True).alias("__hit"))
    joined = violations.join(new, "id", "left")
    hit = F.coalesce("__hit", F.lit(False))
    changed = {
        "status": F.when(hit, "CLOSED").otherwise(F.col("status")),
        "duration_seconds": F.when(hit, seconds_between(F.col("entered_at"), F.col("__exit"))).otherwise(F.col("duration_seconds")),
        "clip_path": F.coalesce(F.when(hit, F.col("__clip")), "clip_path"),
    }
    return joined.withColumns(changed).select(violations.columns)


def close_stale(violations: DataFrame, camera_id: str, at: str) -> DataFrame:
    """Open rows of a camera are closed at this time."""
    stale = (F.col("status") == "OPEN") & (F.col("camera_id") == camera_id)
    return violations.withColumns({"duration_seconds": F.when(stale, seconds_between(F.col("entered_at"), F.lit(at).cast("timestamp"))).otherwise(F.col("duration_seconds")), "status": F.when(stale, "CLOSED").otherwise(F.col("status"))})


def update(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Columns of changes replace those of equal key where they are given."""
    new = [c for c in changes.columns if c != key]
    joined = table.join(changes.select(key, *[F.col(c).alias(f"__{c}") for c in new]), key, "left")
    return joined.withColumns({c: F.coalesce(f"__{c}", c) for c in new}).select(table.columns)


def delete(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """Also for rows of other tables that refer to deleted ones."""
    return table.join(keys.select(key).distinct(), key, "left_anti")


def insert_absent(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return table.unionByName(rows.dropDuplicates([key]).join(table.select(key), key, "left_anti").select(table.columns))


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    from tessera.operators.events import alias_union

    return alias_union(table, rows.select(table.columns), key)


def claim(jobs: DataFrame, job_id: int, expected: str, new: str) -> tuple[DataFrame, int]:
    """Compare and set: the new table and the number of rows that changed."""
    hit = (F.col("id") == job_id) & (F.col("status") == expected)
    return jobs.withColumn("status", F.when(hit, new).otherwise(F.col("status"))), jobs.where(hit).count()


def activate(versions: DataFrame, version_id: int) -> DataFrame:
    """One version ACTIVE, whichever was so before REPLACED."""
    return versions.withColumn("status", F.when(F.col("id") == version_id, "ACTIVE").when(F.col("status") == "ACTIVE", "REPLACED").otherwise(F.col("status")))


def recover_jobs(jobs: DataFrame, reason: str) -> DataFrame:
    lost = F.col("status").isin("RUNNING", "EVALUATING")
    return jobs.withColumns({"failure_reason": F.when(lost, reason).otherwise(F.col("failure_reason")), "status": F.when(lost, "FAILED").otherwise(F.col("status"))})
