"""Scans and sinks of the site's files: registries, manifests, label texts and archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ARCHIVE = 512 << 20


def read_registry(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array file as rows; a missing or unreadable file is an empty registry."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The samples of a manifest of version 2, one row each; other versions raise."""
    manifest = spark.read.option("multiLine", True).json(path)
    checked = manifest.withColumn("samples", F.when(F.col("schemaVersion") == 2, F.col("samples")).otherwise(F.raise_error(F.lit("manifest version is not 2"))))
    return checked.select(F.explode("samples").alias("s")).select("s.*")


def read_label_texts(spark: SparkSession, path: str) -> DataFrame:
    """Lines 'class n n n n' (a box) or 'class x y x y x y ...' (a polygon) as class_id and the box's corners."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return label_boxes(lines.select(F.split(F.trim("value"), r"\s+").alias("parts")))


def label_boxes(lines: DataFrame) -> DataFrame:
    """From `parts`: class_id, x1, y1, x2, y2; lines of neither form have nulls."""
    n = F.transform(F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0))), lambda x: x.try_cast("double"))
    out = lines.select(F.get("parts", 0).try_cast("int").alias("class_id"), n.alias("n"))
    at = lambda k: F.get("n", k)
    count = F.size("n")
    xs, ys = F.filter("n", lambda _, i: i % 2 == 0), F.filter("n", lambda _, i: i % 2 == 1)
    box, shape = count == 4, (count >= 6) & (count % 2 == 0)
    pick = lambda b, s: F.when(box, b).when(shape, s)
    return out.select("class_id", pick(at(0) - at(2) / 2, F.array_min(xs)).alias("x1"), pick(at(1) - at(3) / 2, F.array_min(ys)).alias("y1"), pick(at(0) + at(2) / 2, F.array_max(xs)).alias("x2"), pick(at(1) + at(3) / 2, F.array_max(ys)).alias("y2"))


def archive_entries(spark: SparkSession, path: str) -> DataFrame:
    """name, size and crc of the entries of zip archives, read where the archives lie."""
    from collections.abc import Iterator

    import pandas as pd

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"]):
                infos = zipfile.ZipFile(io.BytesIO(content)).infolist()
                yield pd.DataFrame([(archive, i.filename, i.file_size, i.CRC, (i.external_attr >> 16 & 0o170000) == 0o120000) for i in infos], columns=["archive", "name", "size", "crc", "is_link"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(listed, "archive string, name string, size long, crc long, is_link boolean")


def refused_entries(entries: DataFrame) -> DataFrame:
    """Entries that make an archive unfit, with the reason."""
    name = F.col("name")
    reason = F.when(name.startswith("/") | name.rlike("^[A-Za-z]:"), "absolute path").when(F.array_contains(F.split(name, "/"), ".."), "path leads out").when(name.contains("\\"), "backslash").when(F.col("is_link"), "link")
    single = entries.withColumn("reason", reason).where("reason IS NOT NULL").select("archive", "name", "reason")
    twice = entries.groupBy("archive", "name").agg(F.countDistinct("crc").alias("n")).where("n > 1").select("archive", "name", F.lit("conflicting entries").alias("reason"))
    large = entries.groupBy("archive").agg(F.sum("size").alias("size")).where(F.col("size") > MAX_ARCHIVE).select("archive", F.lit(None).cast("string").alias("name"), F.lit("too large").alias("reason"))
    return single.union(twice).union(large)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int = 8, **options: str) -> DataFrame:
    """A database table in ranges of a numeric key."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    return reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts).load()


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_labels(samples: DataFrame, path: str) -> None:
    """One label line for each sample, by split."""
    from tessera.functions.geometry import yolo_box

    line = F.concat_ws(" ", F.col("class_id").cast("string"), yolo_box(F.col("x"), F.col("y"), F.col("w"), F.col("h")))
    samples.select("split", line.alias("value")).write.mode("overwrite").partitionBy("split").text(path)


def decode_upload(df: DataFrame, content: str = "data_url", limit: int = 15 << 20) -> DataFrame:
    """mime, bytes, and a safe file name; bytes over the limit are null."""
    mime = F.regexp_extract(content, "^data:([^;,]+)", 1)
    data = F.unbase64(F.regexp_replace(content, "^data:[^,]*,", ""))
    name = F.regexp_replace(F.regexp_replace("file_name", r"^.*[\\/]", ""), r"[^A-Za-z0-9._-]", "_")
    return df.select("*", mime.alias("mime"), F.when(F.octet_length(data) <= limit, data).alias("bytes"), name.alias("safe_name"))
