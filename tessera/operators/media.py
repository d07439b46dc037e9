"""Media that are sent in and swept out: uploads as registry rows, files that go with deleted events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEGA = 1 << 20
# What goes with the events of a kind: folder, beginnings and ends of names (none: all).
SWEPT = {
    "area": [("clips", ["area_"], [".mp4"])],
    "gate": [("crops", ["gate_crop_"], [".jpg", ".png"]), ("clips", ["gate_clip_"], [])],
    "all": [("clips", [""], []), ("crops", [""], [])],
}


def _extension(mime: Column, video: Column) -> Column:
    known = F.regexp_extract(mime, "png|webp|webm|mov|quicktime", 0)
    return F.when(known == "", F.when(video, ".mp4").otherwise(".jpg")).when(known == "quicktime", ".mov").otherwise(F.concat(F.lit("."), known))


def uploads(sent: DataFrame, most_video: int = 120 * MEGA, most_image: int = 15 * MEGA) -> DataFrame:
    """sent (data, file_name, kind) with mime, media_kind, filename, name, url, bytes and `refused`, the reason if it cannot be kept.

    data is base64 text with or without the head of a data URI. Videos are told by kind or mime; the extension follows the
    mime and is added to the safe name unless it ends so. A null name becomes media and the hash of the data. Refused
    rows (no data, data that is no base64, more bytes than the kind may have) have null bytes and url.
    """
    head = F.substring_index("data", ",", 1)
    out = sent.withColumn("__head", F.when(head.rlike("^data:[A-Za-z0-9/-]+;base64$") & (F.length("data") > F.length(head) + 1), head))
    body = F.when(F.col("__head").isNotNull(), F.substring("data", F.length("__head") + 2, F.length("data"))).otherwise(F.col("data"))
    mime = F.coalesce(F.lower(F.regexp_extract("__head", "^data:(.*);base64$", 1)), F.lit("image/jpeg"))
    out = out.withColumns({"mime": mime, "__bytes": F.try_to_binary(body, F.lit("base64"))})
    video = F.coalesce(F.col("kind") == "video", F.lit(False)) | F.col("mime").rlike("video|mp4|webm")
    out = out.withColumn("media_kind", F.when(video, "video").otherwise("img"))
    safe = F.coalesce(F.regexp_replace(F.when(F.col("file_name") != "", F.col("file_name")), "[^a-zA-Z0-9_.-]", "_"), F.concat(F.lit("media_"), F.sha2("data", 256)))
    out = out.withColumns({"__safe": safe, "__ext": _extension(F.col("mime"), F.col("media_kind") == "video")})
    out = out.withColumn("filename", F.when(F.endswith("__safe", "__ext"), F.col("__safe")).otherwise(F.concat("__safe", "__ext")))
    raw = F.when(F.col("file_name") != "", F.col("file_name"))
    name = F.when(F.length(raw) > 22, F.concat(F.substring(raw, 1, 18), F.lit("..."))).otherwise(F.coalesce(raw, "filename"))
    most = F.when(F.col("media_kind") == "video", most_video).otherwise(most_image)
    refused = F.when(F.col("data").isNull() | (F.col("data") == ""), "no data").when(F.col("__bytes").isNull(), "no base64").when(F.octet_length("__bytes") > most, "too large")
    kept = lambda c: F.when(F.col("refused").isNull(), c)
    out = out.withColumns({"name": name, "refused": refused})
    return out.withColumns({"bytes": kept(F.col("__bytes")), "url": kept(F.concat(F.lit("/data/uploads/"), "filename"))}).drop("__head", "__bytes", "__safe", "__ext")


def registered(registry: DataFrame, new: DataFrame, at: str = "created_at") -> DataFrame:
    """The registry with new rows (of its columns): one row a filename, the last by time; a new one replaces an old one of equal time."""
    both = registry.withColumn("__new", F.lit(0)).unionByName(new.select(registry.columns).withColumn("__new", F.lit(1)))
    rest = [c for c in registry.columns if c != "filename"]
    last = both.groupBy("filename").agg(F.max_by(F.struct(*rest), F.struct("__new", F.col(at).alias("__at"), F.struct(*rest).alias("__all"))).alias("r"))
    return last.select("filename", "r.*").select(registry.columns)


def swept(files: DataFrame, events: str) -> DataFrame:
    """Of a listing (folder, name, is_file) what goes with the events `area`, `gate` or `all`; folders and .gitkeep stay."""
    rules = F.lit(False)
    for folder, starts, ends in SWEPT[events]:
        names = F.lit(False)
        for s in starts:
            names |= F.col("name").startswith(s)
        for e in ends:
            names |= F.col("name").endswith(e)
        rules |= (F.col("folder") == folder) & names
    return files.where(rules & F.col("is_file") & (F.col("name") != ".gitkeep"))


def active_version(versions: DataFrame) -> DataFrame:
    """The active version (of several the least key) with its metrics read; metrics that are no JSON object are an empty map."""
    metrics = F.coalesce(F.from_json("evaluation_metrics", "map<string, double>"), F.create_map().cast("map<string, double>"))
    return versions.where("status = 'ACTIVE'").orderBy("version_key").limit(1).withColumn("evaluation_metrics", metrics)
