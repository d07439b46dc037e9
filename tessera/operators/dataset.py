"""Training samples: validity, splits without leakage, readiness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import DEFAULT, Thresholds

# Labels that the yard profile needs.
YARD = [("Container", "container", 60, 5), ("Xe tải", "truck", 60, 5), ("Xe nâng", "forklift", 60, 5)]


def checked(samples: DataFrame) -> DataFrame:
    """samples with the reason why one cannot be used (null: it can)."""
    box = (F.col("w") > 0) & (F.col("h") > 0) & (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") + F.col("w") <= 1) & (F.col("y") + F.col("h") <= 1)
    time_wrong = (F.col("media_kind") == "VIDEO") != F.col("frame_ms").isNotNull()
    reason = F.when(F.col("source_id").isNull(), "missing source").when(time_wrong, "bad timestamp").when(~box, "bad box").when(F.col("media_path").isNull(), "file gone")
    return samples.withColumn("reason", reason)


def split_sources(samples: DataFrame, test: bool) -> DataFrame:
    """samples with a split by source: sources in the order of their SHA-256, the first fifths to test (if asked) and val.

    Every sample of a source has its split. Ranks are those within a hash prefix after the counts of all prefixes before
    it; four hex digits bound that table to 65536 rows, which one task sums and which is broadcast.
    """
    sources = samples.where("source_id IS NOT NULL").select("source_id").distinct().withColumn("h", F.sha2("source_id", 256)).withColumn("prefix", F.substring("h", 1, 4))
    counts = sources.groupBy("prefix").agg(F.count("*").alias("c"))
    before = counts.select("prefix", (F.sum("c").over(Window.orderBy("prefix")) - F.col("c")).alias("before"), F.sum("c").over(Window.partitionBy()).alias("n"))
    ranked = sources.join(F.broadcast(before), "prefix").withColumn("k", F.col("before") + F.row_number().over(Window.partitionBy("prefix").orderBy("h")))
    fifth = F.greatest(F.lit(1), F.ceil(F.col("n") / 5))
    split = F.when(F.col("k") <= fifth, "test").when(F.col("k") <= 2 * fifth, "val") if test else F.when(F.col("k") <= fifth, "val")
    return samples.join(ranked.select("source_id", split.otherwise("train").alias("split")), "source_id")


def readiness(samples: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    good = F.col("reason").isNull()
    out = checked(samples).agg(F.count_if(good).alias("samples"), F.countDistinct(F.when(good, F.col("label"))).alias("labels"), F.countDistinct(F.when(good, F.col("source_id"))).alias("sources"), F.count_if(~good).alias("excluded"))
    return out.withColumn("ready", (F.col("samples") >= limits.ready_samples) & (F.col("labels") >= limits.ready_labels) & (F.col("sources") >= limits.ready_sources))


def yard_coverage(split: DataFrame) -> DataFrame:
    """For each label of the profile: samples, sources, samples in each split, and whether they are enough."""
    rules = split.sparkSession.createDataFrame(YARD, "label string, base_class string, need int, need_sources int")
    count = lambda s: F.count_if(F.col("split") == s).alias(s)
    have = split.groupBy("label", "base_class").agg(F.count("*").alias("samples"), F.countDistinct("source_id").alias("sources"), count("train"), count("val"), count("test"))
    out = rules.join(have, ["label", "base_class"], "left").na.fill(0, ["samples", "sources", "train", "val", "test"])
    enough = (F.col("samples") >= F.col("need")) & (F.col("sources") >= F.col("need_sources")) & (F.col("train") >= 30) & (F.col("val") >= 6) & (F.col("test") >= 6)
    return out.withColumn("ready", enough)


def leaks(split: DataFrame) -> DataFrame:
    """Sources in more than one split."""
    return split.groupBy("source_id").agg(F.countDistinct("split").alias("splits")).where("splits > 1")


def quality_gate(runs: DataFrame, map50: float = 0.65, precision: float = 0.65, recall: float = 0.55) -> DataFrame:
    """The names of the metrics under their thresholds, in this order."""
    low = lambda c, v: F.when(F.coalesce(F.col(c), F.lit(0.0)) < v, c)
    return runs.withColumn("failures", F.array_compact(F.array(low("map50", map50), low("precision", precision), low("recall", recall))))


def content_hash(samples: DataFrame) -> DataFrame:
    """SHA-256 over the sorted hashes of all samples: sums of 60-bit parts do not depend on the order or the partitions."""
    h = F.sha2(F.to_json(F.struct(*sorted(samples.columns))), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")) for k in range(4)]
    return samples.agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), *[p.cast("string") for p in parts]), 256).alias("content_hash"))
