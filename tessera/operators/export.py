"""Export of training samples: label files, names, and datasets that are written once for each content."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.geometry import yolo_box
from tessera.operators.dataset import content_hash

SPLITS = ("train", "val", "test")


def class_names(samples: DataFrame) -> DataFrame:
    """One row: the labels in order; a label's place is its number."""
    return samples.agg(F.sort_array(F.collect_set("label")).alias("names"))


def label_files(samples: DataFrame) -> DataFrame:
    """split, stem, text: the label file of each image or video frame, a line for each of its samples by id.

    samples: id, label, split, source (what the picture was taken from), media_kind, frame_ms, x, y, w, h. The stem is the
    sample's id, or for several ones `source-` and the beginning of the hash of their ids. A picture in two splits, or a
    split of another name, is an error. One picture's samples are few.
    """
    place = (F.array_position(class_names(samples).scalar(), F.col("label")) - 1).cast("string")
    line = F.concat_ws(" ", place, yolo_box(F.col("x"), F.col("y"), F.col("w"), F.col("h")))
    checked = samples.withColumn("split", F.when(F.col("split").isin(*SPLITS), F.col("split")).otherwise(F.raise_error(F.concat(F.lit("split "), F.coalesce("split", F.lit("none"))))))
    one = F.struct(F.col("id").cast("string").alias("id"), line.alias("line"))
    pictures = checked.groupBy("source", "media_kind", "frame_ms").agg(F.sort_array(F.collect_list(one)).alias("own"), F.min("split").alias("split"), F.max("split").alias("other"))
    ids = F.transform("own", lambda o: o["id"])
    stem = F.when(F.size("own") == 1, ids[0]).otherwise(F.concat(F.lit("source-"), F.substring(F.sha2(F.array_join(ids, "|"), 256), 1, 20)))
    split = F.when(F.col("split") == F.col("other"), F.col("split")).otherwise(F.raise_error(F.lit("one picture is in two splits")))
    return pictures.select(split.alias("split"), stem.alias("stem"), F.concat(F.array_join(F.transform("own", lambda o: o["line"]), "\n"), F.lit("\n")).alias("text"))


def summary(samples: DataFrame) -> DataFrame:
    """One row: samples, pictures' sources, samples of each split, and the labels in order with their number."""
    counts = [F.count_if(F.col("split") == s).alias(s) for s in SPLITS]
    return samples.agg(F.count("*").alias("samples"), F.countDistinct("source").alias("sources"), *counts, F.sort_array(F.collect_set("label")).alias("labels"))


def yaml(names: list[str], path: str, has_test: bool) -> str:
    listed = "\n".join(f"  {k}: {n}" for k, n in enumerate(names))
    return f"path: {path}\ntrain: images/train\nval: images/val\n{'test: images/test' + chr(10) if has_test else ''}names:\n{listed}\n"


class Datasets:
    """A folder of exported datasets, each named by the hash of its samples.

    An export writes into `_staging`, then renames the folder to its place; the manifest, which holds the hash and the
    counts, is the last file written there. What has no manifest is no dataset: a run that ends between the two leaves
    nothing that a reader sees, and the next export of these samples begins anew. Equal samples are exported once.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = path
        self._fs = path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}"))

    def _write(self, name: str, text: str) -> None:
        out = self._fs.create(self._path(f"{self.root}/{name}"), True)
        out.write(bytearray(text.encode()))
        out.close()

    def registered(self) -> DataFrame:
        """content_hash, samples, sources, labels of every dataset."""
        schema = "content_hash string, samples long, sources long, labels array<string>"
        if not self._fs.globStatus(self._path(f"{self.root}/*/manifest.json")):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(f"{self.root}/*/manifest.json")

    def stage(self, samples: DataFrame, key: str) -> str:
        """Writes all parts of a dataset but its manifest; the folder's name."""
        name = f"_staging/{key}-{uuid.uuid4().hex[:8]}"
        label_files(samples).write.partitionBy("split").parquet(f"{self.root}/{name}/labels")
        samples.write.parquet(f"{self.root}/{name}/samples")
        return name

    def commit(self, staged: str, key: str, figures: dict) -> None:
        if self._exists(key):  # left by a run that ended before its manifest
            self._fs.delete(self._path(f"{self.root}/{key}"), True)
        self._fs.rename(self._path(f"{self.root}/{staged}"), self._path(f"{self.root}/{key}"))
        has_test = self.spark.read.parquet(f"{self.root}/{key}/labels").where("split = 'test'").limit(1).count() > 0
        self._write(f"{key}/data.yaml", yaml(figures["labels"], f"{self.root}/{key}", has_test))
        self._write(f"{key}/manifest.json", json.dumps({"content_hash": key, **figures}, ensure_ascii=False))

    def export(self, samples: DataFrame) -> tuple[str, bool]:
        """The dataset's hash, and whether it was there before."""
        key = content_hash(samples).first()[0]
        if self._exists(f"{key}/manifest.json"):
            return key, True
        row = samples.agg(F.count("*").alias("n"), F.countDistinct("source").alias("s"), F.sort_array(F.collect_set("label")).alias("l")).first()
        self.commit(self.stage(samples, key), key, {"samples": row.n, "sources": row.s, "labels": row.l})
        return key, False
