"""Queries of what viewers and editors see, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import events, lists, views
from tessera.plans.domain import LABELS, ctes, view
from tessera.plans.registry import query

_COVERED = """, covered AS (SELECT d.id, e.zone_id FROM detections d, edges e GROUP BY ALL HAVING
  bool_or(abs((cx - ax) * (py - ay) - (cy - ay) * (px - ax)) <= 1e-12 AND px BETWEEN least(ax, cx) AND greatest(ax, cx) AND py BETWEEN least(ay, cy) AND greatest(ay, cy))
  OR count(*) FILTER (WHERE (ay > py) <> (cy > py) AND px < (cx - ax) * (py - ay) / (cy - ay) + ax) % 2 = 1)"""


def _marked(spark: SparkSession, d: str) -> DataFrame:
    crate = F.when(F.col("track_id") % 2 == 0, "crate").otherwise(F.col("class"))
    return view(spark, d, "detections").withColumns({"class": crate, "source": F.when(F.col("id") % 7 == 0, "custom").otherwise("primary")})


@query(ctes("detections") + """, judged AS (SELECT *, count(*) OVER w AS n, hypot_(px - first_value(px) OVER w, py - first_value(py) OVER w) / greatest(1, count(*) OVER w - 1) AS speed FROM detections WINDOW w AS (PARTITION BY track_id ORDER BY frame_no ROWS 39 PRECEDING))
SELECT id FROM judged WHERE track_id % 2 <> 0 OR id % 7 = 0 OR NOT (n = 40 AND speed < 0.005)""".replace("hypot_(px - first_value(px) OVER w, py - first_value(py) OVER w)", "sqrt((px - first_value(px) OVER w) ** 2 + (py - first_value(py) OVER w) ** 2)"))
def moving_boxes(spark: SparkSession, d: str) -> DataFrame:
    from tessera.config import Thresholds

    return views.moving(_marked(spark, d), Thresholds(static_speed=0.005)).select("id")


@query(ctes("detections", "edges", "zones") + _COVERED + """, first AS (SELECT id, min(zone_id) AS zone_id FROM covered GROUP BY id)
SELECT d.id, f.zone_id, z.name AS zone_name FROM detections d JOIN first f ON f.id = d.id JOIN zones z ON z.zone_id = f.zone_id WHERE class IN ('car', 'truck') AND round((x2 - x1) * 1000) >= 50 AND round((y2 - y1) * 1000) >= 30""")
def gate_vehicles_in_zone(spark: SparkSession, d: str) -> DataFrame:
    pixels = view(spark, d, "detections").withColumns({c: F.round(F.col(c) * 1000) for c in ("x1", "y1", "x2", "y2")})
    return views.gate_vehicles_in_zone(pixels, view(spark, d, "zones")).select("id", "zone_id", "zone_name")


@query(ctes("detections", "edges", "zones") + _COVERED + " SELECT c.id, string_agg(z.name || ':' || z.zone_id, '|' ORDER BY z.name, z.zone_id) AS matches FROM covered c JOIN zones z ON z.zone_id = c.zone_id GROUP BY c.id")
def overlay_matches(spark: SparkSession, d: str) -> DataFrame:
    shown = views.overlay(view(spark, d, "detections"), view(spark, d, "zones"))
    return shown.select("id", F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["name"], m["zone_id"])), "|").alias("matches"))


@query(ctes("samples", "labels") + " SELECT label, min(id) AS id FROM samples WHERE label NOT IN (SELECT name FROM labels_seed WHERE base_class <> 'truck') GROUP BY label")
def unknown_sample_labels(spark: SparkSession, d: str) -> DataFrame:
    return views.unknown_labels(view(spark, d, "samples"), view(spark, d, "labels").where("base_class <> 'truck'"))


_NAMES = [name for _, name in LABELS]
_ALL = "[" + ", ".join(f"'{n}'" for n in _NAMES) + "]"


@query(ctes("site_zones") + f""", drawn AS (SELECT zone_id, rule_type = 'ALLOW_SPECIFIED' AS allow, {_ALL}[1 : 1 + (zone_id % 9)::int] AS targets FROM site_zones),
split AS (SELECT *, list_filter({_ALL}, lambda x: list_contains(targets, x) = allow) AS allowed, list_filter({_ALL}, lambda x: list_contains(targets, x) <> allow) AS forbidden FROM drawn)
SELECT zone_id, CASE WHEN len(allowed) <= len(forbidden) THEN 'ALLOW_SPECIFIED' ELSE 'PROHIBIT_SPECIFIED' END AS rule_type, array_to_string(CASE WHEN len(allowed) <= len(forbidden) THEN allowed ELSE forbidden END, '|') AS target_labels FROM split""")
def zone_rules_as_saved(spark: SparkSession, d: str) -> DataFrame:
    """Rules of zones as an editor reads and saves them: labels in any case become what is allowed, that the shorter rule."""
    available = F.array(*map(F.lit, _NAMES))
    targets = F.transform(F.slice(available, 1, (1 + F.col("zone_id") % 9).cast("int")), lambda x: F.upper(x))
    types = view(spark, d, "site_zones").select("zone_id", views.zone_types(F.col("rule_type"), targets, available).alias("types"))
    return types.select("zone_id", views.zone_rule(F.col("types"), available).alias("r")).select("zone_id", "r.rule_type", F.array_join("r.target_labels", "|").alias("target_labels"))


@query(ctes("site_zones") + """, shape AS (SELECT zone_id, 5 + zone_id % 60 AS x, 3 + zone_id % 70 AS y, (zone_id * 37 % 160 - 80) / 2.0 AS dx, (zone_id * 53 % 160 - 80) / 3.0 AS dy FROM site_zones),
held AS (SELECT *, greatest(1 - x, least(99 - (x + 20), dx)) AS mx, greatest(1 - y, least(99 - (y + 15), dy)) AS my FROM shape)
SELECT zone_id, round(cast(x + mx as double), 1) AS left, round(cast(y + my as double), 1) AS top, round(cast(x + 20 + mx as double), 1) AS right, round(cast(y + 15 + my as double), 1) AS bottom FROM held""".replace(" AS left", ' AS "left"').replace(" AS right", ' AS "right"'))
def moved_zones(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles dragged by up to 40 percent, held within the picture."""
    key = F.col("zone_id")
    x, y = (5 + key % 60).cast("double"), (3 + key % 70).cast("double")
    corner = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    shape = F.array(corner(x, y), corner(x + 20, y), corner(x + 20, y + 15), corner(x, y + 15))
    out = view(spark, d, "site_zones").select("zone_id", shape.alias("p"), ((key * 37 % 160 - 80) / 2.0).alias("dx"), ((key * 53 % 160 - 80) / 3.0).alias("dy"))
    out = out.select("zone_id", views.moved(F.col("p"), F.col("dx"), F.col("dy")).alias("p"))
    return out.select("zone_id", F.get("p", 0)["x"].alias("left"), F.get("p", 0)["y"].alias("top"), F.get("p", 2)["x"].alias("right"), F.get("p", 2)["y"].alias("bottom"))


@query(ctes("area_messages") + """, once AS (SELECT id, min(epoch_us("at")) AS told FROM area_messages GROUP BY id) SELECT id, told FROM once ORDER BY told DESC, id DESC LIMIT 50""")
def alert_feed(spark: SparkSession, d: str) -> DataFrame:
    """The last 50 alerts, each id once."""
    return views.latest(view(spark, d, "area_messages").select("id", F.unix_micros("at").alias("told")), "told", 50)


_DAY = "1995-06-17"


@query(ctes("gate_events", "violations") + f""", g AS (SELECT * FROM gate_events WHERE cast(ts AS date) = '2024-01-02'), timed AS (SELECT *, make_timestamp((1704153600 + id * 97 % 172800) * 1000000) AS at_ FROM violations), v AS (SELECT * FROM timed WHERE cast(at_ AS date) = '2024-01-02')
SELECT (SELECT count(*) FROM g WHERE status = 'STRANGER') AS strangers, (SELECT count(*) FROM g WHERE status = 'KNOWN') AS knowns, (SELECT count(DISTINCT license_plate) FROM g) AS plates, (SELECT count(*) FROM v) AS violations,
(SELECT count(*) FROM v WHERE status = 'OPEN') AS open, (SELECT regexp_extract(clip_path, '[^/]*$') FROM v WHERE clip_path IS NOT NULL ORDER BY at_ DESC, id DESC LIMIT 1) AS clip""")
def answers_about_a_day(spark: SparkSession, d: str) -> DataFrame:
    """Violations are dealt over two days of the gate's events."""
    timed = view(spark, d, "violations").withColumn("entered_at", F.timestamp_seconds(1704153600 + F.col("id") * 97 % 172800))
    return views.answers(view(spark, d, "gate_events"), timed, "2024-01-02").withColumn("clip", F.regexp_extract("clip", "[^/]*$", 0))


@query(ctes("gate_events") + " SELECT id, license_plate FROM gate_events WHERE translate(upper(trim(license_plate)), ' -.', '') = '16B07919'")
def plate_history(spark: SparkSession, d: str) -> DataFrame:
    return views.plate_history(view(spark, d, "gate_events"), " 16b 07.919").select("id", "license_plate")


@query(ctes("violations", "zones") + f" SELECT z.zone_id, z.name, count(v.id) AS n FROM zones z LEFT JOIN violations v ON v.zone_id = z.zone_id AND cast(v.entered_at AS date) = '{_DAY}' GROUP BY z.zone_id, z.name")
def zone_counts_of_a_day(spark: SparkSession, d: str) -> DataFrame:
    return views.zone_counts(view(spark, d, "violations"), view(spark, d, "zones"), _DAY)


@query(ctes("detections", "edges", "zones", "violations") + _COVERED + f""" SELECT (SELECT count(DISTINCT id) FROM covered WHERE zone_id <> 1) AS in_zones, (SELECT count(*) FROM detections WHERE class = 'forklift') AS forklifts, (SELECT count(*) FROM detections WHERE contains(class, 'container')) AS containers,
(SELECT count(*) FROM zones WHERE zone_id <> 1) AS active_zones, (SELECT count(*) FROM violations WHERE cast(entered_at AS date) = '{_DAY}') AS violations""")
def area_figures(spark: SparkSession, d: str) -> DataFrame:
    zones = view(spark, d, "zones").withColumn("is_active", F.col("zone_id") != 1)
    return views.figures_now(view(spark, d, "detections"), zones, view(spark, d, "violations"), _DAY)


@query(ctes("violations") + """, keyed AS (SELECT *, concat('00000000-0000-4000-8000-', lpad(cast(zone_id AS varchar), 12, '0')) AS zone FROM violations), hits AS (SELECT * FROM keyed WHERE zone = '00000000-0000-4000-8000-000000000002' AND status = 'CLOSED')
SELECT id, zone, (SELECT count(*) FROM hits) AS total FROM hits ORDER BY entered_at DESC, id DESC LIMIT 50 OFFSET 10""")
def area_events_by_zone(spark: SparkSession, d: str) -> DataFrame:
    """A page of the closed violations of a zone, with the count of all."""
    zone = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.col("zone_id").cast("string"), 12, "0"))
    hits = lists.area_events(view(spark, d, "violations").withColumn("zone_id", zone), "00000000-0000-4000-8000-000000000002", "CLOSED")
    return lists.with_total(hits, events.page(hits, "entered_at", 50, 10)).select("id", F.col("zone_id").alias("zone"), "total")


@query(ctes("gate_events") + """ SELECT id, strftime(ts, '%H:%M') AS minute, strftime(ts, '%H:%M:%S') AS second, strftime(ts, '%d/%m %H:%M') AS day, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM gate_events""".replace(" AS minute", ' AS "minute"').replace(" AS second", ' AS "second"').replace(" AS day", ' AS "day"'))
def event_times(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "gate_events").select("id", *[c.alias(n) for n, c in views.times(F.col("ts")).items()])


@query(ctes("samples") + r""", p AS (SELECT id, CASE id % 6 WHEN 0 THEN media_path WHEN 1 THEN '/etc/' || media_path WHEN 2 THEN 'a/../' || media_path WHEN 3 THEN 'C:' || media_path WHEN 4 THEN '' ELSE 'a b/ỹ ' || media_path END AS path FROM samples)
SELECT id, coalesce(path <> '' AND NOT starts_with(path, '/') AND NOT regexp_matches(path, '^[A-Za-z]:') AND NOT list_contains(string_split(path, '/'), '..'), false) AS safe, regexp_replace(regexp_replace(path, '^.*[\\/]', ''), '[^A-Za-z0-9._-]', '_', 'g') AS name FROM p""")
def media_paths(spark: SparkSession, d: str) -> DataFrame:
    """Which media paths stay below their folder, and the names that files get."""
    n = F.col("id") % 6
    path = F.when(n == 0, F.col("media_path")).when(n == 1, F.concat(F.lit("/etc/"), "media_path")).when(n == 2, F.concat(F.lit("a/../"), "media_path")).when(n == 3, F.concat(F.lit("C:"), "media_path")).when(n == 4, F.lit("")).otherwise(F.concat(F.lit("a b/ỹ "), "media_path"))
    return view(spark, d, "samples").select("id", views.safe_path(path).alias("safe"), views.safe_name(path).alias("name"))
