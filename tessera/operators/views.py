"""What viewers and editors see: overlays, zones as drawn, feeds with a cap, answers about a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import DEFAULT, Thresholds
from tessera.functions import geometry
from tessera.functions.geometry import in_unit  # noqa: F401 (drawn points of editors)
from tessera.operators import boxes, spatial, windows

# Classes that are never suppressed for standing still.
NEVER_STATIC = ["truck", "car", "bus", "motorcycle", "forklift", "container handler", "reach stacker", "container", "shipping container", "personnel carrier", "utility vehicle", "golf cart", "person"]


def moving(points: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """Points (track_id, frame_no, px, py, class, source) without those of tracks that stand still over a whole window;
    vehicles, persons, boxes of the custom model and points without a track stay."""
    held = F.lower(F.coalesce("class", F.lit(""))).isin(NEVER_STATIC) | F.coalesce(F.col("source") == "custom", F.lit(False)) | F.col("track_id").isNull()
    judged = windows.motion(points, limits)
    return judged.where(held | ~F.col("is_static")).select(points.columns)


def gate_vehicles_in_zone(found: DataFrame, zones: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """Vehicles that a gate camera can read and that stand in a zone (its first), with zone_id and zone_name. px, py is where they stand."""
    return spatial.first_zone(boxes.gate_vehicles(found, limits), zones).where("zone_id IS NOT NULL")


def overlay(points: DataFrame, zones: DataFrame) -> DataFrame:
    """id and `matches`, the zones (name, zone_id) that cover a point, by name and id; points in no zone are not shown."""
    hits = spatial.zone_hits(points.select("id", "px", "py"), zones)
    return hits.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("name", "zone_id"))).alias("matches"))


def unknown_labels(samples: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of samples that there is no label of, each with its first sample."""
    return samples.join(labels.select(F.col("name").alias("label")).distinct(), "label", "left_anti").groupBy("label").agg(F.min("id").alias("id"))


def zone_types(rule: Column, targets: Column, available: Column) -> Column:
    """Label -> whether a zone allows it (1 or 0), of all labels there are."""
    wanted = F.transform(targets, lambda x: F.lower(x))
    return F.map_from_arrays(available, F.transform(available, lambda x: (F.array_contains(wanted, F.lower(x)) == (rule == "ALLOW_SPECIFIED")).cast("int")))


def zone_rule(types: Column, available: Column) -> Column:
    """The shorter of the two rules that say the same: what is allowed, if that is no more than what is not."""
    on = lambda x: F.coalesce(F.try_element_at(types, x), F.lit(0)) != 0
    allowed, forbidden = F.filter(available, on), F.filter(available, lambda x: ~on(x))
    short = F.size(allowed) <= F.size(forbidden)
    return F.struct(F.when(short, "ALLOW_SPECIFIED").otherwise("PROHIBIT_SPECIFIED").alias("rule_type"), F.when(short, allowed).otherwise(forbidden).alias("target_labels"))


def moved(polygon: Column, dx: Column, dy: Column) -> Column:
    """A polygon in percents moved as a whole, at most so far that it stays within 1..99, to one decimal."""
    sides = geometry.envelope(polygon)
    x = F.greatest(1 - sides["min_x"], F.least(99 - sides["max_x"], dx))
    y = F.greatest(1 - sides["min_y"], F.least(99 - sides["max_y"], dy))
    within = lambda v: F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), v)), 1)
    return F.transform(polygon, lambda p: F.struct(within(p["x"] + x).alias("x"), within(p["y"] + y).alias("y")))


def latest(rows: DataFrame, at: str, n: int, key: str = "id") -> DataFrame:
    """The last n of the rows, each key once (its first by time)."""
    once = rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), at).alias("r")).select(key, "r.*")
    return once.orderBy(F.desc(at), F.desc(key)).limit(n).select(rows.columns)


def answers(gate: DataFrame, violations: DataFrame, day: str) -> DataFrame:
    """One row about a day: strangers, knowns, plates seen, violations, those still open, and the last clip."""
    today = lambda at: F.to_date(at) == F.lit(day).cast("date")
    seen = gate.where(today("ts")).agg(F.count_if(F.col("status") == "STRANGER").alias("strangers"), F.count_if(F.col("status") == "KNOWN").alias("knowns"), F.countDistinct("license_plate").alias("plates"))
    broken = violations.where(today("entered_at")).agg(F.count("*").alias("violations"), F.count_if(F.col("status") == "OPEN").alias("open"), F.max_by("clip_path", F.when(F.col("clip_path").isNotNull(), F.struct("entered_at", "id"))).alias("clip"))
    return seen.join(broken)  # one row each


def plate_history(gate: DataFrame, plate: str) -> DataFrame:
    """Events of a plate, whatever spaces, dashes and dots it is written with, the last one first."""
    from tessera.functions.plates import plate_key

    return gate.where(plate_key(F.col("license_plate")) == plate_key(F.lit(plate))).orderBy(F.desc("ts"), F.desc("id"))


def zone_counts(violations: DataFrame, zones: DataFrame, day: str) -> DataFrame:
    """Violations of a day by zone name, zones without any too."""
    own = violations.where(F.to_date("entered_at") == F.lit(day).cast("date")).groupBy("zone_id").agg(F.count("*").alias("n"))
    return zones.select("zone_id", "name").join(own, "zone_id", "left").select("zone_id", "name", F.coalesce("n", F.lit(0)).alias("n"))


def figures_now(points: DataFrame, zones: DataFrame, violations: DataFrame, day: str) -> DataFrame:
    """One row: objects in zones, forklifts and containers among all, active zones, violations of the day; zeros where there is nothing."""
    live = zones.where("is_active")
    inside = overlay(points, live).agg(F.count("*").alias("in_zones"))
    kinds = points.agg(F.count_if(F.lower("class") == "forklift").alias("forklifts"), F.count_if(F.lower("class").contains("container")).alias("containers"))
    broken = violations.agg(F.count_if(F.to_date("entered_at") == F.lit(day).cast("date")).alias("violations"))
    return inside.join(kinds).join(live.agg(F.count("*").alias("active_zones"))).join(broken)  # one row each


def any_active(health: Column) -> Column:
    """Whether any camera of a map name -> active is active; none in an empty or missing map."""
    return F.coalesce(F.exists(F.map_values(health), lambda v: F.coalesce(v, F.lit(False))), F.lit(False))


def class_names(names: Column) -> Column:
    """A list of class names as a map number -> trimmed name; an empty list or name is an error."""
    trimmed = F.transform(names, lambda n: F.trim(F.coalesce(n, F.lit(""))))
    bad = (F.size(trimmed) <= 0) | F.array_contains(trimmed, "")
    checked = F.when(bad, F.raise_error(F.lit("no class names, or an empty one")).cast("array<string>")).otherwise(trimmed)
    return F.map_from_entries(F.transform(checked, lambda n, k: F.struct(k.alias("id"), n.alias("name"))))


def times(at: Column) -> dict[str, Column]:
    """A time as viewers show it: hour and minute, with seconds, with day and month, and as ISO text in UTC to milliseconds."""
    forms = {"minute": "HH:mm", "second": "HH:mm:ss", "day": "dd/MM HH:mm", "iso": "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"}
    return {name: F.date_format(at, form) for name, form in forms.items()}


def safe_name(name: Column) -> Column:
    """The last part of a path with other signs than letters, digits, dot, dash and underscore replaced."""
    return F.regexp_replace(F.regexp_replace(name, r"(?s)^.*[\\/]", ""), "[^A-Za-z0-9._-]", "_")


def safe_path(path: Column) -> Column:
    """Whether a path stays below its folder: not empty, not absolute, no drive, no step up."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    out = path.startswith("/") | path.startswith("\\") | path.rlike("^[A-Za-z]:") | F.array_contains(parts, "..")
    return F.coalesce((path != "") & ~out, F.lit(False))
