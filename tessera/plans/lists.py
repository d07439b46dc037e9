"""Queries over lists as a viewer sees them, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import plates
from tessera.operators import events, lists, spatial
from tessera.operators.dataset import YARD
from tessera.plans.domain import ctes, view
from tessera.plans.registry import query


@query(ctes("violations", "detections", "zones") + """, rows AS (
  SELECT v.id, object_label AS obj, z.name AS zone, strftime(entered_at, '%H:%M') AS time, status AS st, false AS ok FROM violations v JOIN zones z USING (zone_id)
  UNION ALL SELECT id, class, 'Zone bãi kiểm', '08:15', 'OK', true FROM detections WHERE confidence >= 0.9)
SELECT * FROM rows WHERE contains(lower(obj), 'xe') OR contains(lower(zone), 'xe') OR contains(time, 'xe') OR contains(lower(st), 'xe')""")
def area_event_filter(spark: SparkSession, d: str) -> DataFrame:
    zones = view(spark, d, "zones").select("zone_id", F.col("name").alias("zone"))
    shown = view(spark, d, "violations").join(zones, "zone_id").select("id", F.col("object_label").alias("obj"), "zone", F.date_format("entered_at", "HH:mm").alias("time"), F.col("status").alias("st"))
    live = view(spark, d, "detections").where("confidence >= 0.9").select("id", F.col("class").alias("obj"), F.lit("Zone bãi kiểm").alias("zone"), F.lit("08:15").alias("time"), F.lit("OK").alias("st"))
    return lists.area_list(shown, live, "all", " XE ")


_GATE = """, shown AS (SELECT id, CASE WHEN id % 17 = 0 THEN '—' ELSE license_plate END AS plate, lane AS zone, strftime(ts, '%H:%M') AS time, CASE status WHEN 'KNOWN' THEN 'quen' ELSE 'la' END AS status FROM gate_events),
named AS (SELECT plate_number AS plate, max(CASE status WHEN 'KNOWN' THEN 'quen' ELSE 'la' END) AS label FROM vehicles GROUP BY plate_number)"""


@query(ctes("gate_events", "vehicles") + _GATE + """ SELECT s.id, s.plate, coalesce(n.label, s.status) = 'quen' AS known FROM shown s LEFT JOIN named n ON n.plate = s.plate WHERE coalesce(n.label, s.status) <> 'quen' OR s.plate = '—'""")
def gate_event_filter(spark: SparkSession, d: str) -> DataFrame:
    word = F.when(F.col("status") == "KNOWN", "quen").otherwise("la")
    shown = view(spark, d, "gate_events").select("id", F.when(F.col("id") % 17 == 0, lists.NO_PLATE).otherwise(F.col("license_plate")).alias("plate"), F.col("lane").alias("zone"), F.date_format("ts", "HH:mm").alias("time"), word.alias("status"))
    named = view(spark, d, "vehicles").groupBy(F.col("plate_number").alias("plate")).agg(F.max(word).alias("label"))
    return lists.gate_view(shown, named, "la").select("id", "plate", "known")


_VEHICLES = """, seen AS (SELECT license_plate AS plate, CASE WHEN regexp_matches(license_plate, '[RH]') THEN 'Container' WHEN contains(license_plate, 'C') THEN 'Xe tải' ELSE 'Xe con' END AS type,
  strftime(max(ts), '%Y-%m-%d') AS last, CASE WHEN max(id) % 3 = 0 THEN 'quen' WHEN max(id) % 3 = 1 THEN '' END AS label, count(*) AS visits FROM gate_events GROUP BY license_plate)"""


def _vehicles(spark: SparkSession, d: str) -> DataFrame:
    kept = view(spark, d, "gate_events").groupBy(F.col("license_plate").alias("plate")).agg(F.max("ts").alias("at"), F.max("id").alias("top"), F.count("*").alias("visits"))
    label = F.when(F.col("top") % 3 == 0, "quen").when(F.col("top") % 3 == 1, "")
    return kept.select("plate", plates.vehicle_type(F.col("plate")).alias("type"), F.date_format("at", "yyyy-MM-dd").alias("last"), label.alias("label"), "visits")


@query(ctes("gate_events") + _VEHICLES + " SELECT plate, type, last, visits FROM seen WHERE (contains(lower(plate), 'a') OR contains(lower(type), 'a') OR contains(last, 'a')) AND coalesce(nullif(label, ''), 'la') = 'la'")
def vehicle_view_filter(spark: SparkSession, d: str) -> DataFrame:
    return lists.vehicle_view(_vehicles(spark, d), "A", "la").select("plate", "type", "last", "visits")


@query(ctes("gate_events") + _VEHICLES + " SELECT DISTINCT type FROM seen")
def vehicle_types(spark: SparkSession, d: str) -> DataFrame:
    return _vehicles(spark, d).select("type").distinct()


@query(ctes("vehicles") + """, hits AS (SELECT * FROM vehicles WHERE status = 'KNOWN' AND (contains(lower(plate_number), '1') OR contains(lower(note), '1')))
SELECT id, plate_number, status, (SELECT count(*) FROM hits) AS total FROM hits ORDER BY updated_rank DESC, id DESC LIMIT 20 OFFSET 20""")
def vehicle_page_total(spark: SparkSession, d: str) -> DataFrame:
    hits = events.search_vehicles(view(spark, d, "vehicles").where("status = 'KNOWN'"), "1")
    return lists.with_total(hits, events.clamped_page(hits, "updated_rank", 20, 2)).select("id", "plate_number", "status", "total")


@query(ctes("gate_events") + """, hits AS (SELECT * FROM gate_events WHERE camera_id = 'GATE-01' AND status = 'STRANGER')
SELECT id, license_plate, (SELECT count(*) FROM hits) AS total FROM hits ORDER BY ts DESC, id DESC LIMIT 50""")
def gate_page_total(spark: SparkSession, d: str) -> DataFrame:
    hits = events.gate_list(view(spark, d, "gate_events"), status="la")
    return lists.with_total(hits, events.page(hits, "ts", 50)).select("id", "license_plate", "total")


@query(ctes("site_zones") + " SELECT zone_id, name FROM site_zones WHERE camera_id = 'CAM-3' AND is_active AND contains(lower(name), 'zone')")
def active_zones_by_camera(spark: SparkSession, d: str) -> DataFrame:
    return lists.zone_list(view(spark, d, "site_zones"), " cam-3 ", search="ZONE").select("zone_id", "name")


@query(ctes("vehicles") + """, keyed AS (SELECT concat('00000000-0000-0000-0000-', lpad(cast(id AS varchar), 12, '0')) AS id, plate_number FROM vehicles)
SELECT * FROM keyed WHERE id = '00000000-0000-0000-0000-000000000007' UNION ALL SELECT * FROM keyed WHERE plate_number = '16B-07919'""")
def vehicle_by_id_or_plate(spark: SparkSession, d: str) -> DataFrame:
    keyed = view(spark, d, "vehicles").select(F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(F.col("id").cast("string"), 12, "0")).alias("id"), "plate_number")
    return lists.find_vehicle(keyed, "00000000-0000-0000-0000-000000000007").unionByName(lists.find_vehicle(keyed, " 16b-07919 "))


@query(ctes("vehicles") + " SELECT plate_number AS plate, min_by(status, id) AS status FROM vehicles GROUP BY plate_number")
def registered_plates(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "vehicles").groupBy(F.col("plate_number").alias("plate")).agg(F.min_by("status", "id").alias("status"))


# The classes whose labels a class may carry, in this order, written from the table of aliases; a lifting vehicle looks under forklift first.
_ALIASES = """, alias AS (SELECT * FROM (VALUES ('reach stacker', 1, 'forklift'), ('reach stacker', 2, 'reach stacker'), ('reach stacker', 3, 'container handler'), ('golf cart', 1, 'personnel_carrier'), ('golf cart', 2, 'personnel carrier'),
  ('utility vehicle', 1, 'personnel_carrier'), ('utility vehicle', 2, 'personnel carrier'), ('container handler', 1, 'forklift'), ('container handler', 2, 'container handler'), ('shipping container', 1, 'container'), ('shipping container', 2, 'shipping container'),
  ('forklift', 1, 'forklift'), ('truck', 1, 'truck'), ('car', 1, 'car'), ('motorcycle', 1, 'motorcycle'), ('person', 1, 'person'), ('bus', 1, 'bus')) t(class, place, base_class)),
named AS (SELECT DISTINCT CASE WHEN lower(name) LIKE '%container%' THEN 'container' WHEN lower(name) IN ('xe nâng', 'xe cẩu') THEN 'forklift' WHEN lower(name) = 'xe chở người' THEN 'personnel_carrier' ELSE base_class END AS base_class, name FROM labels_seed),
found AS (SELECT a.class, a.place, list(n.name ORDER BY n.name) AS names FROM alias a JOIN named n ON n.base_class = a.base_class GROUP BY a.class, a.place),
by_class AS (SELECT class, min_by(names, place) AS names FROM found GROUP BY class),
resolved AS (SELECT d.id, d.class, d.rule_type, d.suppressed_static, CASE WHEN lower(trim(d.label)) IN ('xe nâng', 'xe cẩu') THEN (SELECT names FROM by_class WHERE class = 'forklift')
  WHEN b.names IS NOT NULL THEN b.names WHEN trim(d.label) IN (SELECT name FROM labels_seed) THEN [trim(d.label)] ELSE ['CHƯA XÁC ĐỊNH'] END AS candidates
  FROM aliased d LEFT JOIN by_class b ON b.class = lower(trim(d.class)))"""


@query(ctes("aliased", "labels") + _ALIASES + " SELECT id FROM resolved WHERE NOT suppressed_static AND candidates <> ['CHƯA XÁC ĐỊNH']")
def whitelisted_detections(spark: SparkSession, d: str) -> DataFrame:
    """Boxes whose class is configured, itself or by an alias, or whose label is."""
    return lists.guarded(view(spark, d, "aliased"), view(spark, d, "labels")).select("id")


@query(ctes("aliased", "labels") + _ALIASES + """ SELECT id, array_to_string(candidates, '|') AS candidates,
  CASE WHEN list_has_any(candidates, ['Xe nâng', 'Xe con', 'Xe chở người']) = (rule_type = 'ALLOW_SPECIFIED') THEN 'ALLOWED' ELSE 'VIOLATION' END AS status FROM resolved""")
def aliased_rule_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Candidates and status of boxes of any class under rules for three labels."""
    hits = view(spark, d, "aliased").withColumn("target_labels", F.array(F.lit(" xe NÂNG"), F.lit("Xe con"), F.lit("Xe chở người")))
    return spatial.rule_matrix(hits, view(spark, d, "labels")).select("id", F.array_join("candidates", "|").alias("candidates"), "status")


@query(ctes("detections") + " SELECT frame_no, cast(row_number() OVER w - 1 AS int) AS place, id FROM detections WINDOW w AS (PARTITION BY frame_no ORDER BY confidence DESC, id) QUALIFY row_number() OVER w <= 6")
def crop_targets(spark: SparkSession, d: str) -> DataFrame:
    return lists.top_boxes(view(spark, d, "detections"))


@query(ctes("violations", "targets") + """, rows AS (SELECT zone_id, label, 0 AS f, 0 AS n FROM targets UNION ALL SELECT zone_id, CASE WHEN id % 5 = 0 THEN upper(object_label) ELSE object_label END, 1, id FROM violations)
SELECT zone_id, lower(label) AS key, max_by(label, (f, n)) AS label FROM rows GROUP BY zone_id, lower(label)""")
def zone_rule_chips(spark: SparkSession, d: str) -> DataFrame:
    targets = view(spark, d, "zones").select(F.col("zone_id").cast("long"), F.posexplode("target_labels").alias("at", "label"))
    spelled = F.when(F.col("id") % 5 == 0, F.upper("object_label")).otherwise(F.col("object_label"))
    seen = view(spark, d, "violations").select("zone_id", spelled.alias("label"), F.col("id").alias("at"))
    return lists.rule_chips(targets, seen)


_JOBS = """, jobs AS (SELECT id, CASE id % 6 WHEN 0 THEN 'QUEUED' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'PAUSED_GPU' WHEN 3 THEN 'EVALUATING' WHEN 4 THEN 'FAILED' ELSE 'COMPLETED' END AS job,
  CASE id % 7 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'CANDIDATE' WHEN 2 THEN 'REJECTED' END AS version,
  CASE id % 4 WHEN 0 THEN 'epoch 1' || chr(10) || ' CUDA out of memory ' || chr(13) || chr(10) || 'bye' WHEN 1 THEN 'a' || chr(10) || chr(10) || 'stopped at ' || cast(id AS string) || chr(10) WHEN 2 THEN '' END AS log FROM vehicles)"""


@query(ctes("vehicles") + _JOBS + """ SELECT id, CASE version WHEN 'ACTIVE' THEN 'active' WHEN 'CANDIDATE' THEN 'candidate' WHEN 'REJECTED' THEN 'failed' ELSE CASE WHEN job <> 'COMPLETED' THEN lower(job) END END AS shown,
CASE id % 4 WHEN 0 THEN 'CUDA out of memory' WHEN 1 THEN concat('stopped at ', id) ELSE 'Training runner failed' END AS reason FROM jobs""")
def job_display(spark: SparkSession, d: str) -> DataFrame:
    jobs = spark.sql("WITH v AS (SELECT * FROM {vehicles})" + _JOBS.replace("FROM vehicles", "FROM v") + " SELECT * FROM jobs", vehicles=view(spark, d, "vehicles"))
    return jobs.select("id", lists.display_status(F.col("job"), F.col("version")).alias("shown"), lists.failure_reason(F.col("log")).alias("reason"))


@query(ctes("violations", "gate_events") + """ SELECT 'clip' AS kind, id, CASE WHEN clip_path IS NULL THEN '' ELSE concat('http://host/data/clips/area%20', id, '.mp4') END AS url FROM violations
UNION ALL SELECT 'crop', id, CASE WHEN crop_path IS NULL THEN '' WHEN id % 7 = 0 THEN concat('https://cdn/', crop_path) ELSE concat('http://host/data/crops/', id, '.jpg') END FROM gate_events""")
def media_urls(spark: SparkSession, d: str) -> DataFrame:
    clips = view(spark, d, "violations").select(F.lit("clip").alias("kind"), "id", lists.media_url(F.col("clip_path"), "http://host", "clips", encode=True).alias("url"))
    path = F.when(F.col("id") % 7 == 0, F.concat(F.lit("https://cdn/"), "crop_path")).otherwise(F.col("crop_path"))
    return clips.union(view(spark, d, "gate_events").select(F.lit("crop"), "id", lists.media_url(path, "http://host", "crops")))


@query(ctes("vehicles") + """, runs AS (SELECT id, CASE WHEN id % 11 = 0 THEN 0.0 ELSE (id * 37 % 1000) / 1000.0 END AS map50, (id * 41 % 1000) / 1000.0 AS precision, (id * 43 % 1000) / 1000.0 AS recall, (id * 47 % 1000) / 1000.0 AS c0, CASE WHEN id % 5 = 0 THEN 0.0 ELSE (id * 53 % 1000) / 1000.0 END AS c1 FROM vehicles)
SELECT id, cast(map50 AS double) AS map50, cast(c1 AS double) AS truck, concat_ws('|', CASE WHEN map50 < 0.65 THEN 'mAP50 below required threshold' END, CASE WHEN precision < 0.65 THEN 'precision below required threshold' END, CASE WHEN recall < 0.55 THEN 'recall below required threshold' END,
 CASE WHEN c0 < 0.55 THEN 'Container mAP below required threshold' END, CASE WHEN c1 < 0.55 THEN 'Xe tải mAP below required threshold' END, 'Xe nâng mAP below required threshold') AS failures FROM runs""")
def profile_quality_gate(spark: SparkSession, d: str) -> DataFrame:
    part = lambda k: (F.col("id") * k % 1000 / 1000).cast("string")
    each = F.when(F.col("id") % 5 == 0, F.array(part(47))).otherwise(F.array(part(47), part(53)))
    runs = view(spark, d, "vehicles").select("id", F.when(F.col("id") % 11 == 0, "none").otherwise(part(37)).alias("map50"), F.lit("x").alias("map"), part(41).alias("precision"), part(43).alias("recall"), each.alias("per_class"))
    labels = [x[0] for x in YARD]
    out = lists.evaluated(runs, labels)
    return out.select("id", "map50", F.col("per_class")["Xe tải"].alias("truck"), F.array_join(lists.gate_failures(labels), "|").alias("failures"))


@query(ctes("ocr_reads") + """ SELECT id, coalesce(round(list_sum([(id * k % 100) / 100.0::double FOR k IN range(1, 1 + id % 8)]) / greatest(1, id % 8), 6), 0) AS mean FROM ocr_reads""")
def mean_character_confidence(spark: SparkSession, d: str) -> DataFrame:
    n = (F.col("id") % 8).cast("int")
    each = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.col("id") * k % 100 / 100.0)).otherwise(F.array().cast("array<double>"))
    return view(spark, d, "ocr_reads").select("id", F.round(lists.mean_of(each), 6).alias("mean"))


@query(ctes("samples", "labels") + " SELECT s.id, s.label, l.base_class FROM samples s JOIN labels_seed l ON l.name = s.label")
def sample_label_attributes(spark: SparkSession, d: str) -> DataFrame:
    named = view(spark, d, "labels").select(F.col("name").alias("label"), "base_class")
    return view(spark, d, "samples").select("id", "label").join(named, "label").select("id", "label", "base_class")


@query(ctes("samples") + " SELECT label, cast(row_number() OVER (ORDER BY label) - 1 AS int) AS index, n FROM (SELECT label, count(*) AS n FROM samples GROUP BY label)")
def label_index(spark: SparkSession, d: str) -> DataFrame:
    counts = view(spark, d, "samples").groupBy("label").agg(F.count("*").alias("n"))
    return counts.agg(F.sort_array(F.collect_list(F.struct("label", "n"))).alias("all")).select(F.posexplode("all").alias("index", "x")).select("x.label", "index", "x.n")


@query(ctes("samples") + " SELECT count(*) AS saved, count(DISTINCT label) AS labels, count(*) >= 20 AND count(DISTINCT label) >= 2 AS ready FROM samples")
def viewer_readiness(spark: SparkSession, d: str) -> DataFrame:
    have = view(spark, d, "samples").agg(F.count("*").alias("saved"), F.countDistinct("label").alias("labels"))
    return have.withColumn("ready", (F.col("saved") >= 20) & (F.col("labels") >= 2))
