"""Lists as a viewer sees them: filters, searches, orders, totals and small look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.labels import UNKNOWN
from tessera.functions.plates import plate_upper
from tessera.operators.spatial import with_candidates

UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
#: What the gate shows for an event without a plate.
NO_PLATE = "—"


def holds(search: str, *columns: str) -> Column:
    """Any of the columns holds the search text, in any case; an empty search fits all."""
    q = search.strip().lower()
    fits = F.lit(not q)
    for c in columns if q else ():
        fits = fits | F.coalesce(F.contains(F.lower(c), F.lit(q)), F.lit(False))
    return fits


def area_list(violations: DataFrame, allowed: DataFrame, mode: str = "all", search: str = "") -> DataFrame:
    """Violations and live allowed rows (columns obj, zone, time, st), of one kind if asked, that hold the search text."""
    rows = violations.withColumn("ok", F.lit(False)).unionByName(allowed.withColumn("ok", F.lit(True)))
    wanted = {"all": F.lit(True), "violation": ~F.col("ok"), "ok": F.col("ok")}[mode]
    return rows.where(wanted & holds(search, "obj", "zone", "time", "st"))


def gate_view(events: DataFrame, named: DataFrame, mode: str = "all", search: str = "") -> DataFrame:
    """Events (plate, zone, time, status) with the status of `named` (plate, label), else their own; unread plates are strangers too."""
    joined = events.join(named.select("plate", F.col("label").alias("__label")), "plate", "left")
    known = F.coalesce(F.nullif("__label", F.lit("")), "status") == "quen"
    wanted = {"all": F.lit(True), "la": ~known | (F.col("plate") == NO_PLATE), "quen": known}[mode]
    return joined.withColumn("known", known).where(wanted & holds(search, "plate", "zone", "time")).drop("__label")


def vehicle_view(vehicles: DataFrame, search: str = "", status: str = "all", kind: str = "all", sort: str = "visits", descending: bool = True) -> DataFrame:
    """Vehicles (plate, type, last, label, visits) by search, status (none: stranger) and type, in the order of a column."""
    if sort not in ("visits", "last", "plate"):
        raise ValueError("sort by visits, last or plate")
    wanted = holds(search, "plate", "type", "last")
    if status != "all":
        wanted = wanted & (F.coalesce(F.nullif("label", F.lit("")), F.lit("la")) == status)
    if kind != "all":
        wanted = wanted & (F.col("type") == kind)
    return vehicles.where(wanted).orderBy(F.desc(sort) if descending else F.asc(sort), "plate")


def with_total(matching: DataFrame, page: DataFrame) -> DataFrame:
    """A page with the count of all rows that match, by a scalar subquery over the same predicate."""
    return page.withColumn("total", matching.agg(F.count("*").alias("n")).scalar())


def zone_list(zones: DataFrame, camera: str | None = None, active: bool = True, search: str = "") -> DataFrame:
    """Zones of a camera (any if none), only active ones if asked, whose name holds the search text."""
    wanted = holds(search, "name")
    if camera and camera.strip():
        wanted = wanted & (F.col("camera_id") == camera.strip().upper())
    return zones.where(wanted & F.col("is_active") if active else wanted)


ZONE_KEY = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$"


def area_events(violations: DataFrame, zone_id: str | None = None, status: str | None = None, camera: str = "BAI-KIEM") -> DataFrame:
    """Violations of a camera, of one zone and one status if asked. A zone that is no UUID of versions 1 to 5, or a status other than OPEN and CLOSED, is refused."""
    import re

    if status is not None and status not in ("OPEN", "CLOSED"):
        raise ValueError("status must be OPEN or CLOSED")
    if zone_id is not None and not re.match(ZONE_KEY, zone_id):
        raise ValueError("zone_id must be a UUID")
    wanted = F.col("camera_id") == camera
    for column, value in (("zone_id", zone_id), ("status", status)):
        wanted = wanted if value is None else wanted & (F.col(column) == value)
    return violations.where(wanted)


def find_vehicle(vehicles: DataFrame, key: str) -> DataFrame:
    """By id where the key is a UUID, else by plate."""
    import re

    by_id = re.match(UUID, key.strip())
    return vehicles.where(F.col("id") == key.strip() if by_id else F.col("plate_number") == plate_upper(F.lit(key)))


def guarded(detections: DataFrame, names: DataFrame) -> DataFrame:
    """Detections that are not suppressed as static and, where labels (name, base_class) are configured, can carry one of them, also by an alias of their class."""
    kept = with_candidates(detections.where(~F.coalesce("suppressed_static", F.lit(False))), names)
    return kept.where(~F.col("configured") | (F.col("candidates") != F.array(F.lit(UNKNOWN)))).drop("configured", "candidates")


def top_boxes(detections: DataFrame, n: int = 6) -> DataFrame:
    """Each frame's n boxes of highest confidence, the lower id of equals (one frame's boxes are few)."""
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "id")))
    return detections.groupBy("frame_no").agg(F.slice(ranked, 1, n).alias("top")).select("frame_no", F.posexplode("top").alias("place", "t")).select("frame_no", "place", "t.id")


def rule_chips(targets: DataFrame, seen: DataFrame) -> DataFrame:
    """Labels of each zone in any case: its targets (zone_id, label, at), then those seen; the last spelling counts."""
    rows = targets.withColumn("__from", F.lit(0)).unionByName(seen.withColumn("__from", F.lit(1))).where("label <> ''")
    return rows.groupBy("zone_id", F.lower("label").alias("key")).agg(F.max_by("label", F.struct("__from", "at")).alias("label"))


def display_status(job: Column, version: Column) -> Column:
    """What a job is shown as: its version's state first, then its own."""
    shown = F.when(version == "ACTIVE", "active").when(version == "CANDIDATE", "candidate").when(version == "REJECTED", "failed")
    return shown.when(job.isin("QUEUED", "RUNNING", "PAUSED_GPU", "EVALUATING", "FAILED"), F.lower(job))


def failure_reason(log: Column) -> Column:
    """The last line that names an error, else the last line; at most 200 characters."""
    lines = F.filter(F.transform(F.split(F.coalesce(log, F.lit("")), r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    named = F.filter(lines, lambda x: x.rlike("(?i)error|exception|cuda|out of memory"))
    last = F.coalesce(F.try_element_at(named, F.lit(-1)), F.try_element_at(lines, F.lit(-1)), F.lit("Training runner failed"))
    return F.substring(F.translate(last, "\r\n", "  "), 1, 200)


def media_url(path: Column, base: str, folder: str, encode: bool = False) -> Column:
    """Empty stays empty, whole and data urls pass, else the file's name below the folder (percent-encoded if asked)."""
    name = F.regexp_replace(path, r"(?s)^.*[\\/]", "")
    if encode:
        name = F.url_encode(name)
        for code, sign in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
            name = F.replace(name, F.lit(code), F.lit(sign))
    whole = path.startswith("http") | path.startswith("data:")
    return F.when(F.coalesce(path, F.lit("")) == "", "").when(whole, path).otherwise(F.concat(F.lit(f"{base}/data/{folder}/"), name))


def metric(c: Column) -> Column:
    """A figure to five decimals, 0 for what is no number."""
    return F.round(F.coalesce(c.try_cast("double"), F.lit(0.0)), 5)


def evaluated(runs: DataFrame, labels: list[str]) -> DataFrame:
    """Metrics of a run as figures, and a figure for each label from the list per_class (0 beyond its end)."""
    each = [x for k, label in enumerate(labels) for x in (F.lit(label), metric(F.get("per_class", k)))]
    return runs.withColumns({**{c: metric(F.col(c)) for c in ("map50", "map", "precision", "recall")}, "per_class": F.create_map(*each)})


def gate_failures(labels: list[str], map50: float = 0.65, precision: float = 0.65, recall: float = 0.55, each: float = 0.55) -> Column:
    """Why a run is refused, in this order: its metrics, then each label of the profile that falls short."""
    low = [F.when(F.col(c) < least, f"{name} below required threshold") for c, name, least in (("map50", "mAP50", map50), ("precision", "precision", precision), ("recall", "recall", recall))]
    low += [F.when(F.coalesce(F.try_element_at("per_class", F.lit(x)), F.lit(0.0)) < each, f"{x} mAP below required threshold") for x in labels]
    return F.array_compact(F.array(*low))


def mean_of(values: Column) -> Column:
    """Mean of a list, 0 for an empty one."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.lit(1), F.size(values))
