"""Event queries: filters, pages, look-ups, counts and enrichment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import plates


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def find_plate(vehicles: DataFrame, plate: str) -> DataFrame:
    return vehicles.where(F.col("plate_number") == plate.strip().upper()).limit(1)


def newest(df: DataFrame, n: int, by: str = "ts", **equal: object) -> DataFrame:
    """The n newest rows with these values; the id breaks ties."""
    return df.where(_all([F.col(k) == v for k, v in equal.items() if v is not None])).orderBy(F.desc(by), F.desc("id")).limit(n)


def page(df: DataFrame, by: str, limit: int, offset: int = 0) -> DataFrame:
    """A page by (by desc, id desc); limits outside 1-100 or negative offsets are refused."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must be 1 to 100 and offset 0 or more")
    return df.orderBy(F.desc(by), F.desc("id")).offset(offset).limit(limit)


def clamped_page(df: DataFrame, by: str, limit: int, number: int = 1, offset: int | None = None) -> DataFrame:
    """A page by number or offset (which wins); the limit is drawn into 1-200."""
    limit = min(max(limit, 1), 200)
    return df.orderBy(F.desc(by), F.desc("id")).offset(offset if offset is not None else (max(number, 1) - 1) * limit).limit(limit)


def gate_list(events: DataFrame, camera: str = "GATE-01", status: str | None = None, plate: str | None = None, lane: str | None = None) -> DataFrame:
    wanted = [F.col("camera_id") == camera]
    if status:
        wanted.append(F.col("status") == ("STRANGER" if status.strip().upper() in ("LA", "STRANGER") else "KNOWN"))
    if plate:
        wanted.append(F.upper("license_plate").contains(plate.strip().upper()))
    if lane:
        wanted.append(F.col("lane") == lane)
    return events.where(_all(wanted))


def gate_rows(events: DataFrame) -> DataFrame:
    """As shown: status word, whole percent of confidence (none for 0), lane caption."""
    percent = F.when(F.coalesce(F.col("confidence"), F.lit(0.0)) != 0, half_up(F.col("confidence") * 100))
    lane = F.when(F.col("lane") == "IN_2", "Làn IN 2").otherwise("Làn IN 1")
    return events.select("id", F.when(F.col("status") == "KNOWN", "quen").otherwise("la").alias("status"), percent.alias("percent"), lane.alias("lane"), F.date_format("ts", "HH:mm").alias("time"), "license_plate")


def open_violations(violations: DataFrame, zone_id: int | None = None, camera_id: str | None = None) -> DataFrame:
    wanted = {"zone_id": zone_id, "camera_id": camera_id, "status": "OPEN"}
    return violations.where(_all([F.col(k) == v for k, v in wanted.items() if v is not None]))


def violation_rows(violations: DataFrame, zones: DataFrame) -> DataFrame:
    """With the zone's name and the clip's file name; zones are few, so the planner may broadcast them."""
    clip = F.regexp_replace("clip_path", r"^.*[\\/]", "")
    named = violations.join(zones.select("zone_id", F.col("name").alias("zone_name")), "zone_id", "left")
    return named.withColumns({"zone_name": F.coalesce("zone_name", F.lit("Zone không xác định")), "clip_file": F.replace(clip, F.lit(" "), F.lit("%20"))})


def count_between(events: DataFrame, start: str, end: str, **equal: object) -> DataFrame:
    inside = (F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp"))
    return events.where(inside & _all([F.col(k) == v for k, v in equal.items()])).agg(F.count("*").alias("n"))


def search_vehicles(vehicles: DataFrame, q: str) -> DataFrame:
    """Plate with the query as typed or compacted, or the note, in any case."""
    plate, note = F.lower("plate_number"), F.lower("note")
    compact = "".join(q.split()).lower()
    return vehicles.where(plate.contains(compact) | plate.contains(q.lower()) | F.coalesce(note.contains(q.lower()), F.lit(False)))


def with_visits(vehicles: DataFrame, events: DataFrame) -> DataFrame:
    """Visits and the last one; a vehicle without events has one visit."""
    stats = events.groupBy(F.col("license_plate").alias("plate_number")).agg(F.count("*").alias("visits"), F.max("ts").alias("last_seen"))
    return vehicles.join(stats, "plate_number", "left").withColumn("visits", F.coalesce("visits", F.lit(1)))


def unregistered(events: DataFrame, vehicles: DataFrame) -> DataFrame:
    """First event of every plate that no vehicle has (ts, then id)."""
    unknown = events.join(vehicles.select(F.col("plate_number").alias("license_plate")), "license_plate", "left_anti")
    return first_of_each(unknown, ["license_plate"], ["ts", "id"])


def auto_registered(told: DataFrame, vehicles: DataFrame) -> DataFrame:
    """New vehicles for events of plates that the registry does not hold, whatever spaces, dashes and dots either is written with: the
    plate in capitals as first told (ts, then id), a stranger. Events that run again add nothing to what they have added."""
    named = told.where("license_plate IS NOT NULL").withColumn("__key", plates.plate_key(F.col("license_plate")))
    unknown = named.join(vehicles.select(plates.plate_key(F.col("plate_number")).alias("__key")), "__key", "left_anti").where("__key <> ''")
    return first_of_each(unknown, ["__key"], ["ts", "id"]).select(plates.plate_upper(F.col("license_plate")).alias("plate_number"), F.lit("STRANGER").alias("status"), F.col("ts").alias("seen_at"))


def first_of_each(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; an aggregate, so that hot keys are summed up before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")
    return df.groupBy(*keys).agg(best).select(*keys, "__r.*")


def resolve_status(reads: DataFrame, vehicles: DataFrame, plate: str = "license_plate") -> DataFrame:
    """KNOWN or STRANGER by the exact plate, else by its key without separators (the least id of equals), else STRANGER."""
    exact = vehicles.select(F.col("plate_number").alias("__p"), F.col("status").alias("__exact"))
    loose = first_of_each(vehicles.select(plates.plate_key(F.col("plate_number")).alias("__k"), F.col("status").alias("__loose"), "id"), ["__k"], ["id"]).drop("id")
    joined = reads.withColumns({"__p": plates.plate_upper(F.col(plate)), "__k": plates.plate_key(F.col(plate))}).join(exact, "__p", "left").join(loose, "__k", "left")
    return joined.withColumn("resolved", F.coalesce("__exact", "__loose", F.lit("STRANGER"))).drop("__p", "__k", "__exact", "__loose")


def child_counts(parents: DataFrame, children: DataFrame, on: str) -> DataFrame:
    counts = children.groupBy(on).agg(F.count("*").alias("children"))
    return parents.join(counts, on, "left").withColumn("children", F.coalesce("children", F.lit(0)))


def cooled_down(events: DataFrame, seconds: float, key: str = "license_plate") -> DataFrame:
    """Events of a key, in the order of ts and id, at least so many seconds after the last one that was told.

    Rows are streamed in order with one time for the key at hand, so a key of any size needs no memory. Rows without a
    key or a time are one key, and are told last of all.
    """
    wait, columns = int(seconds * 1e6), list(events.columns)

    def told(batches):  # noqa: ANN001, ANN202
        now, last, first = None, 0, True
        for batch in batches:
            on = []
            for k, at in zip(batch["__key"], batch["__at"]):
                go = first or k != now or at - last >= wait
                now, first = k, False
                last = at if go else last
                on.append(go)
            yield batch.loc[on, columns]

    marked = events.withColumns({"__key": F.coalesce(F.col(key).cast("string"), F.lit("")), "__at": F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit((1 << 62)))})
    return marked.repartition("__key").sortWithinPartitions("__key", "__at", "id").mapInPandas(told, events.schema)


def alias_union(first: DataFrame, later: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; the later list wins."""
    both = first.withColumn("__n", F.lit(0)).unionByName(later.withColumn("__n", F.lit(1)))
    rest = [c for c in first.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), "__n").alias("__r")).select(key, "__r.*")


def answer(questions: DataFrame, rules: list[tuple[list[str], str]], fallback: str, text: str = "question") -> DataFrame:
    """The answer of the first rule of which a keyword stands in the question."""
    low = F.lower(text)
    out = None
    for keys, reply in rules:
        hit = reduce(lambda a, b: a | b, [low.contains(k.lower()) for k in keys])
        out = F.when(hit, reply) if out is None else out.when(hit, reply)
    return questions.withColumn("answer", out.otherwise(fallback) if out is not None else F.lit(fallback))
