"""Joins by place: boxes and zones, boxes and boxes, events and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import DEFAULT, Thresholds
from tessera.functions import geometry, labels


def zone_hits(points: DataFrame, zones: DataFrame, x: str = "px", y: str = "py") -> DataFrame:
    """Points with every zone that covers them; the box around a zone is tested before its sides. A site's zones are a short
    drawn list, which the planner sends to all tasks while it is short."""
    around = zones.withColumns({f"__{k}": c for k, c in geometry.envelope(F.col("polygon")).items()})
    near = F.col(x).between(F.col("__min_x"), F.col("__max_x")) & F.col(y).between(F.col("__min_y"), F.col("__max_y"))
    inside = points.join(around, near & geometry.covers(F.col(x), F.col(y), F.col("polygon")))
    return inside.drop(*[c for c in inside.columns if c.startswith("__")])


def ray_hits(points: DataFrame, zones: DataFrame, x: str = "px", y: str = "py") -> DataFrame:
    return points.join(zones, geometry.ray_cast(F.col(x), F.col(y), F.col("polygon")))


def first_zone(points: DataFrame, zones: DataFrame, key: str = "id") -> DataFrame:
    """Each point's first covering zone in the order of zone_id (null: none)."""
    first = zone_hits(points.select(key, "px", "py"), zones).groupBy(key).agg(F.min_by(F.struct("zone_id", "name"), "zone_id").alias("z"))
    return points.join(first, key, "left").select(points["*"], "z.zone_id", F.col("z.name").alias("zone_name"))


def class_map(names: DataFrame) -> DataFrame:
    """base_class -> sorted distinct names, with names of special vehicles moved to their own classes."""
    low = F.lower(F.trim("name"))
    base = F.when(low.contains("container"), "container").when(low.isin("xe nâng", "xe cẩu"), "forklift").when(low == "xe chở người", "personnel_carrier").otherwise(F.lower(F.trim("base_class")))
    return names.groupBy(base.alias("base_class")).agg(F.sort_array(F.collect_set("name")).alias("names"))


def with_candidates(boxes: DataFrame, names: DataFrame) -> DataFrame:
    """boxes with `configured` (whether there are any labels) and `candidates`, the names that a box may carry: those of its
    class, else of the classes that this one is an alias of, else its own label if that is a known name.

    A site's labels are one map from class to names, a scalar subquery, so boxes are neither joined nor shuffled.
    """
    whole = class_map(names).agg(F.map_from_entries(F.collect_list(F.struct("base_class", "names"))).alias("m")).scalar()
    label = F.col("label") if "label" in boxes.columns else F.lit("")
    mapped = boxes.withColumn("__map", whole)
    out = mapped.withColumns({"configured": F.size("__map") > 0, "candidates": labels.candidate_labels(F.col("class"), label, F.col("__map"))})
    return out.drop("__map")


def rule_matrix(hits: DataFrame, names: DataFrame) -> DataFrame:
    """hits with `candidates` of their class and the status by the zone's rule."""
    out = with_candidates(hits, names).drop("configured")
    return out.withColumn("status", labels.rule_status(F.col("rule_type"), F.col("target_labels"), F.col("candidates")))


def overlapping_pairs(boxes: DataFrame, keys: list[str], least: float) -> DataFrame:
    """Pairs of boxes with equal keys (one frame's boxes: few) and at least this overlap."""
    a = boxes.select(*keys, *[F.col(c).alias(f"a_{c}") for c in ("id", "x1", "y1", "x2", "y2")])
    b = boxes.select(*keys, *[F.col(c).alias(f"b_{c}") for c in ("id", "x1", "y1", "x2", "y2")])
    pairs = a.join(b, keys).where("a_id < b_id").withColumn("iou", geometry.iou(geometry.box("a_"), geometry.box("b_")))
    return pairs.where(F.col("iou") >= least)


def renumbered(boxes: DataFrame, frames: int, limits: Thresholds = DEFAULT) -> DataFrame:
    """Boxes and earlier ones of another track, at most so many frames before and close by: each box's best, the later of equals.

    Frames are cut into bins of `frames`, so the range join is an equi-join on the bin and the one before.
    """
    cols = ("id", "frame_no", "track_id", "x1", "y1", "x2", "y2")
    a = boxes.select(*[F.col(c).alias(f"a_{c}") for c in cols]).withColumn("bin", F.explode(F.array(F.floor(F.col("a_frame_no") / frames), F.floor(F.col("a_frame_no") / frames) - 1)))
    b = boxes.select(*[F.col(c).alias(f"b_{c}") for c in cols]).withColumn("bin", F.floor(F.col("b_frame_no") / frames))
    gap = F.col("a_frame_no") - F.col("b_frame_no")
    near = a.join(b, "bin").where((gap >= 1) & (gap <= frames) & (F.col("a_track_id") != F.col("b_track_id")))
    one, two = geometry.box("a_"), geometry.box("b_")
    near = near.withColumn("iou", geometry.iou(one, two)).where((F.col("iou") >= limits.reid_iou) | (geometry.center_distance(one, two) <= limits.reid_distance))
    return near.groupBy(F.col("a_id").alias("id")).agg(F.max_by(F.struct(F.col("b_id").alias("prior_id"), "iou"), F.struct("iou", "b_frame_no", "b_id")).alias("r")).select("id", "r.*")


def gate_hits(points: DataFrame, zones: DataFrame, x: str = "px", y: str = "py") -> DataFrame:
    """Points with every gate zone that holds them, corners in percents or parts."""
    return points.join(zones, geometry.gate_contains(F.col(x), F.col(y), F.col("polygon")))


def reidentified(hits: DataFrame, observed: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """id, prior_id, iou: hits that go on a session of another track instead of opening one.

    hits (id, camera_id, zone_id, track_id, frame_no, seconds, x1 to y2 as parts of the picture) are boxes in a zone,
    observed (camera_id, frame_no, track_id) all tracked boxes. A hit looks for a prior one if its track has none in the
    zone less than `missing_seconds` before. Its prior is the last hit of another track in that camera and zone, less than
    `missing_seconds` old, of a track that this frame does not show, and close by: the one of greatest overlap, of equals
    that whose session opened last. Classes and labels do not matter.

    Only ends of stretches can be priors and only openings look for one, so that few rows of each track are joined,
    by bins of `missing_seconds`.
    """
    grace, side = limits.missing_seconds, ("x1", "y1", "x2", "y2")
    track = Window.partitionBy("camera_id", "zone_id", "track_id").orderBy("frame_no", "id")
    fresh = F.coalesce(F.col("seconds") - F.lag("seconds").over(track) >= grace, F.lit(True))
    marked = hits.withColumns({"__fresh": fresh, "__next": F.lead("frame_no").over(track)})
    opened = F.last(F.when(F.col("__fresh"), F.struct("seconds", "id")), ignorenulls=True).over(track)
    marked = marked.withColumn("__opened", opened)
    looking = marked.where("__fresh").select("camera_id", "zone_id", F.floor(F.col("seconds") / grace).alias("bin"), "id", "frame_no", "seconds", F.col("track_id").alias("own"), *[F.col(c).alias(f"a_{c}") for c in side])
    at = F.floor(F.col("seconds") / grace)
    ends = marked.where("__next IS NULL OR __next > frame_no + 1").select("camera_id", "zone_id", F.explode(F.array(at, at + 1)).alias("bin"), F.col("id").alias("prior_id"), "track_id", F.col("seconds").alias("then"), F.col("__next").alias("until"), F.col("__opened").alias("opened"), *[F.col(c).alias(f"b_{c}") for c in side])
    one, two = geometry.box("a_"), geometry.box("b_")
    pairs = looking.join(ends, ["camera_id", "zone_id", "bin"]).where((F.col("then") < F.col("seconds")) & (F.col("seconds") - F.col("then") < grace) & (F.col("own") != F.col("track_id")) & (F.col("until").isNull() | (F.col("until") > F.col("frame_no"))))
    near = pairs.withColumn("iou", geometry.iou(one, two)).where((F.col("iou") >= limits.reid_iou) | (geometry.center_distance(one, two) <= limits.reid_distance))
    gone = near.join(observed.select("camera_id", "frame_no", "track_id"), ["camera_id", "frame_no", "track_id"], "left_anti")
    return gone.groupBy("id").agg(F.max_by(F.struct("prior_id", "iou"), F.struct("iou", "opened", "prior_id")).alias("r")).select("id", "r.*")


def clip_frames(events: DataFrame, frames: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """Frames of the clip of each event, [ts - before, ts + after]; joined by bins of the clip's length."""
    width = int((limits.clip_before_seconds + limits.clip_after_seconds) * 1e6)
    e = events.withColumn("__at", F.unix_micros("ts"))
    low, high = F.col("__at") - int(limits.clip_before_seconds * 1e6), F.col("__at") + int(limits.clip_after_seconds * 1e6)
    e = e.withColumn("__bin", F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))
    f = frames.withColumn("__t", F.unix_micros("frame_ts")).withColumn("__bin", F.floor(F.col("__t") / width))
    return e.join(f, "__bin").where((F.col("__t") >= low) & (F.col("__t") <= high)).drop("__at", "__t", "__bin")
