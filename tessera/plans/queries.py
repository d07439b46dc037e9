"""Registry of the engine's own queries, each with the SQL that its result is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geometry, labels, plates
from tessera.operators import boxes, dataset, events, mutations, reports, spatial, windows
from tessera.plans import jobs, lists, measures, media, tracks, views  # noqa: F401 (their queries register themselves)
from tessera.plans.domain import ctes, view
from tessera.plans.registry import ORACLES, QUERIES, query  # noqa: F401

_INSIDE = """covered AS (SELECT d.id, d.class, d.confidence, e.zone_id FROM detections d, edges e GROUP BY ALL HAVING
  bool_or(abs((cx - ax) * (py - ay) - (cy - ay) * (px - ax)) <= 1e-12 AND px BETWEEN least(ax, cx) AND greatest(ax, cx) AND py BETWEEN least(ay, cy) AND greatest(ay, cy))
  OR count(*) FILTER (WHERE (ay > py) <> (cy > py) AND px < (cx - ax) * (py - ay) / (cy - ay) + ax) % 2 = 1)"""


# --- zones ---------------------------------------------------------------------------------------------------

_STATUS = """names AS (SELECT CASE WHEN lower(name) LIKE '%container%' THEN 'container' WHEN lower(name) IN ('xe nâng', 'xe cẩu') THEN 'forklift' WHEN lower(name) = 'xe chở người' THEN 'personnel_carrier' ELSE base_class END AS base_class, name FROM labels_seed),
judged AS (SELECT c.id, z.name, z.rule_type, CASE WHEN bool_or(t.label IS NOT NULL) = (z.rule_type = 'ALLOW_SPECIFIED') THEN 'ALLOWED' ELSE 'VIOLATION' END AS status
  FROM covered c JOIN zones z ON z.zone_id = c.zone_id LEFT JOIN names n ON n.base_class = c.class LEFT JOIN targets t ON t.zone_id = c.zone_id AND lower(t.label) = lower(n.name) GROUP BY c.id, z.zone_id, z.name, z.rule_type)"""


@query(ctes("detections", "edges", "zones", "targets", "labels") + "," + _INSIDE + "," + _STATUS + " SELECT name, status, count(*) AS hits, cast(sum(id) AS bigint) AS id_sum FROM judged GROUP BY name, status")
def spatial_zone_hits(spark: SparkSession, d: str) -> DataFrame:
    hits = _judged(spark, d)
    return hits.groupBy("name", "status").agg(F.count("*").alias("hits"), F.sum("id").alias("id_sum"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    hits = spatial.zone_hits(view(spark, d, "detections"), view(spark, d, "zones")).withColumnRenamed("name", "zone_name")
    return spatial.rule_matrix(hits, view(spark, d, "labels")).select("id", F.col("zone_name").alias("name"), "rule_type", "status")


@query(ctes("detections", "edges", "zones", "targets", "labels") + "," + _INSIDE + "," + _STATUS + """
SELECT d.id, CASE WHEN bool_or(status = 'VIOLATION') THEN 'VIOLATION' WHEN count(status) > 0 THEN 'ALLOWED' ELSE 'OUTSIDE' END AS status FROM detections d LEFT JOIN judged j ON j.id = d.id GROUP BY d.id""")
def zone_rule_matrix(spark: SparkSession, d: str) -> DataFrame:
    status = _judged(spark, d).groupBy("id").agg(F.collect_list("status").alias("all"))
    out = view(spark, d, "detections").select("id").join(status, "id", "left")
    return out.select("id", labels.overall_status(F.coalesce("all", F.array().cast("array<string>"))).alias("status"))


@query(ctes("detections", "edges", "zones") + "," + _INSIDE + " SELECT d.id, min(zone_id) AS zone_id, (SELECT name FROM zones z WHERE z.zone_id = min(c.zone_id)) AS zone_name FROM detections d LEFT JOIN covered c ON c.id = d.id GROUP BY d.id")
def zone_first_match(spark: SparkSession, d: str) -> DataFrame:
    return spatial.first_zone(view(spark, d, "detections"), view(spark, d, "zones")).select("id", "zone_id", "zone_name")


@query(ctes("detections", "edges") + """, hits AS (SELECT d.id, e.zone_id FROM detections d, edges e GROUP BY ALL HAVING count(*) FILTER (WHERE (ay > py) <> (cy > py) AND px < (cx - ax) * (py - ay) / (cy - ay) + ax) % 2 = 1)
SELECT zone_id, count(*) AS hits, cast(sum(id) AS bigint) AS id_sum FROM hits GROUP BY zone_id""")
def ray_cast_hits(spark: SparkSession, d: str) -> DataFrame:
    return spatial.ray_hits(view(spark, d, "detections"), view(spark, d, "zones")).groupBy("zone_id").agg(F.count("*").alias("hits"), F.sum("id").alias("id_sum"))


@query(ctes("detections", "edges") + """, boxes AS (SELECT zone_id, min(ax) AS x0, min(ay) AS y0, max(ax) AS x1, max(ay) AS y1 FROM edges GROUP BY zone_id)
SELECT zone_id, count(*) AS hits FROM detections d, boxes b WHERE px BETWEEN b.x0 AND b.x1 AND py BETWEEN b.y0 AND b.y1 GROUP BY zone_id""")
def zone_edge_box_counts(spark: SparkSession, d: str) -> DataFrame:
    zones = view(spark, d, "zones").where(geometry.valid_polygon(F.col("polygon"))).select("zone_id", *[c.alias(k) for k, c in geometry.envelope(F.col("polygon")).items()])
    near = F.col("px").between(F.col("min_x"), F.col("max_x")) & F.col("py").between(F.col("min_y"), F.col("max_y"))
    return view(spark, d, "detections").join(zones, near).groupBy("zone_id").agg(F.count("*").alias("hits"))


@query(ctes("site_labels") + """, n AS (SELECT DISTINCT CASE WHEN lower(name) LIKE '%container%' THEN 'container' WHEN lower(name) IN ('xe nâng', 'xe cẩu') THEN 'forklift' WHEN lower(name) = 'xe chở người' THEN 'personnel_carrier' ELSE lower(trim(base_class)) END AS base_class, name FROM site_labels)
SELECT base_class, string_agg(name, '|' ORDER BY name) AS names FROM n GROUP BY base_class""")
def label_class_map(spark: SparkSession, d: str) -> DataFrame:
    return spatial.class_map(view(spark, d, "site_labels")).select("base_class", F.array_join("names", "|").alias("names"))


@query(ctes("detections", "labels") + """, n AS (SELECT base_class, string_agg(name, '|' ORDER BY name) AS names FROM labels_seed GROUP BY base_class)
SELECT class, coalesce(names, 'CHƯA XÁC ĐỊNH') AS candidates, count(*) AS n FROM detections LEFT JOIN n ON n.base_class = class GROUP BY ALL""")
def label_resolution(spark: SparkSession, d: str) -> DataFrame:
    whole = spatial.class_map(view(spark, d, "labels")).agg(F.map_from_entries(F.collect_list(F.struct("base_class", "names"))).alias("m"))
    out = view(spark, d, "detections").withColumn("m", whole.scalar())
    return out.groupBy("class", F.array_join(labels.candidate_labels(F.col("class"), F.lit(""), F.col("m")), "|").alias("candidates")).agg(F.count("*").alias("n"))


@query(ctes("detections", "labels", "targets", "zones") + """, n AS (SELECT base_class, list(name ORDER BY name) AS names FROM labels_seed GROUP BY base_class)
SELECT z.zone_id, class, coalesce((SELECT min_by(x, i) FROM (SELECT unnest(names) AS x, generate_subscripts(names, 1) AS i) u WHERE x IN (SELECT label FROM targets t WHERE t.zone_id = z.zone_id)), names[1]) AS label, count(*) AS n
FROM detections JOIN n ON n.base_class = class, zones z GROUP BY z.zone_id, class, names""")
def display_label(spark: SparkSession, d: str) -> DataFrame:
    named = view(spark, d, "detections").join(spatial.class_map(view(spark, d, "labels")), F.col("class") == F.col("base_class"))
    each = named.groupBy("class", "names").agg(F.count("*").alias("n")).join(view(spark, d, "zones").select("zone_id", "target_labels"))
    return each.select("zone_id", "class", labels.display_label(F.col("names"), F.col("target_labels"), F.lit(None).cast("string")).alias("label"), "n")


# --- plates --------------------------------------------------------------------------------------------------

@query(ctes("vehicles") + " SELECT id, plate_number, status FROM vehicles WHERE plate_number = '16B-07919' LIMIT 1")
def plate_lookup(spark: SparkSession, d: str) -> DataFrame:
    return events.find_plate(view(spark, d, "vehicles"), " 16b-07919 ").select("id", "plate_number", "status")


@query(ctes("ocr_reads") + r" SELECT id, regexp_replace(upper(trim(text)), '\s+', '', 'g') AS compact, upper(trim(text)) AS upper_plate, translate(upper(trim(text)), ' -.', '') AS key FROM ocr_reads")
def plate_normalize(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return view(spark, d, "ocr_reads").select("id", plates.plate_compact(t).alias("compact"), plates.plate_upper(t).alias("upper_plate"), plates.plate_key(t).alias("key"))


_WORDS = " AND ".join(f"NOT contains(c, '{w}')" for w in plates.SIGN_WORDS)
_FORMAT = (
    r"""cleaned AS (SELECT *, upper(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) AS c FROM ocr_reads),
fixed AS (SELECT *, regexp_replace(CASE WHEN regexp_matches(c, '^[LIT1][A-Z0-9]{2}[0-9]{2}[A-Z]{3}$') THEN substr(c, 2) ELSE c END, '^(IXA|1XA|XA|4A)', 'KA') AS f FROM cleaned),
texts AS (SELECT *, CASE WHEN f LIKE '02%' AND length(f) >= 8 THEN 'KA' || f ELSE f END AS t FROM fixed),
repaired AS (SELECT *, translate(substr(t, 1, 2), '01', 'OI') || translate(substr(t, 3, 2), 'OIS', '015') || ' ' || translate(substr(t, 5, 3), '01', 'OI') AS r FROM texts),
formatted AS (SELECT id, track_id, conf, CASE WHEN length(c) BETWEEN 5 AND 12 AND regexp_matches(c, '[0-9]') AND regexp_matches(c, '[A-Z]') AND """
    + _WORDS
    + r""" THEN CASE
  WHEN length(t) = 7 AND regexp_matches(r, '^[A-Z]{2}[0-9]{2} [A-Z]{3}$') THEN r
  WHEN regexp_matches(t, '^[0-9]{2}[A-Z]{1,2}[0-9]{5}$') THEN regexp_replace(t, '^([0-9]{2}[A-Z]{1,2})([0-9]{3})([0-9]{2})$', '\1-\2.\3')
  WHEN regexp_matches(t, '^[0-9]{2}[A-Z]{1,2}[0-9]{4}$') THEN regexp_replace(t, '^([0-9]{2}[A-Z]{1,2})([0-9]{4})$', '\1-\2')
  WHEN regexp_matches(t, '^([A-Z]{2})0?([1-9]|0[1-9]|[1-9][0-9])([A-Z]{1,3})([0-9]{3,4})$') THEN regexp_extract(t, '^([A-Z]{2})0?([1-9]|0[1-9]|[1-9][0-9])([A-Z]{1,3})([0-9]{3,4})$', 1) || '-' || lpad(regexp_extract(t, '^([A-Z]{2})0?([1-9]|0[1-9]|[1-9][0-9])([A-Z]{1,3})([0-9]{3,4})$', 2), 2, '0') || '-' || regexp_extract(t, '^([A-Z]{2})0?([1-9]|0[1-9]|[1-9][0-9])([A-Z]{1,3})([0-9]{3,4})$', 3) || '-' || regexp_extract(t, '^([A-Z]{2})0?([1-9]|0[1-9]|[1-9][0-9])([A-Z]{1,3})([0-9]{3,4})$', 4)
  WHEN regexp_matches(t, '^[A-Z0-9]{3,4}[0-9]{3,4}$') THEN regexp_replace(t, '^([A-Z0-9]{3,4})([0-9]{3,4})$', '\1-\2')
  WHEN length(t) = 7 THEN substr(t, 1, 4) || ' ' || substr(t, 5)
  WHEN length(t) BETWEEN 6 AND 8 THEN t END END AS plate FROM repaired)"""
)


@query(ctes("ocr_reads") + "," + _FORMAT + " SELECT id, plate FROM formatted")
def plate_validate_format(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "ocr_reads").withColumn("plate", plates.plate_format(F.col("text"))).select("id", "plate")


@query(ctes("ocr_reads") + "," + _FORMAT + """, votes AS (SELECT track_id, plate, count(*) AS n, max(conf) AS best, min(id) AS first, length(translate(upper(trim(plate)), ' -.', '')) AS size FROM formatted WHERE length(translate(upper(trim(plate)), ' -.', '')) >= 6 GROUP BY track_id, plate),
scored AS (SELECT *, round(2 * CASE WHEN size BETWEEN 7 AND 9 THEN 4.0::double ELSE 2.0::double END + 2.5::double * best + 0.4::double * least(5, n), 6) AS score FROM votes)
SELECT track_id, plate, score FROM scored QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY score DESC, first) = 1""")
def plate_vote(spark: SparkSession, d: str) -> DataFrame:
    reads = view(spark, d, "ocr_reads").withColumn("plate", plates.plate_format(F.col("text")))
    return windows.plate_votes(reads)


@query(ctes("gate_events", "zones") + """ SELECT license_plate, CASE WHEN regexp_matches(license_plate, '[RH]') THEN 'Container' WHEN contains(license_plate, 'C') THEN 'Xe tải' ELSE 'Xe con' END AS type,
 z.name, CASE WHEN contains(lower(z.name), '2') OR contains(lower(z.name), 'phụ') OR contains(lower(z.name), 'b') THEN 'IN_2' ELSE 'IN_1' END AS lane, count(*) AS n FROM gate_events, zones z GROUP BY ALL""")
def vehicle_type_lane(spark: SparkSession, d: str) -> DataFrame:
    each = view(spark, d, "gate_events").groupBy("license_plate").agg(F.count("*").alias("n"))
    zones = view(spark, d, "zones").select("name", plates.lane_of_zone(F.col("name")).alias("lane"))
    return each.join(zones).select("license_plate", plates.vehicle_type(F.col("license_plate")).alias("type"), "name", "lane", "n")


@query(ctes("gate_events", "vehicles") + """, reads AS (SELECT id, CASE WHEN id % 2 = 0 THEN replace(license_plate, '-', ' ') ELSE lower(license_plate) END AS license_plate FROM gate_events),
loose AS (SELECT translate(upper(trim(plate_number)), ' -.', '') AS k, min_by(status, id) AS status FROM vehicles GROUP BY k)
SELECT r.id, coalesce(v.status, l.status, 'STRANGER') AS resolved FROM reads r LEFT JOIN vehicles v ON v.plate_number = upper(trim(r.license_plate)) LEFT JOIN loose l ON l.k = translate(upper(trim(r.license_plate)), ' -.', '')""")
def plate_status_resolve(spark: SparkSession, d: str) -> DataFrame:
    reads = view(spark, d, "gate_events").select("id", F.when(F.col("id") % 2 == 0, F.translate("license_plate", "-", " ")).otherwise(F.lower("license_plate")).alias("license_plate"))
    return events.resolve_status(reads, view(spark, d, "vehicles")).select("id", "resolved")


@query(ctes("gate_events", "vehicles") + """ SELECT license_plate, min_by(id, (epoch_us(ts), id)) AS id FROM gate_events WHERE license_plate NOT IN (SELECT plate_number FROM vehicles WHERE id % 4 <> 0) GROUP BY license_plate""")
def unregistered_plates(spark: SparkSession, d: str) -> DataFrame:
    """Plates seen at the gate that a registry without every fourth vehicle does not know."""
    return events.unregistered(view(spark, d, "gate_events"), view(spark, d, "vehicles").where("id % 4 <> 0")).select("license_plate", "id")


@query(ctes("gate_events") + " SELECT license_plate, min_by(id, (epoch_us(ts), id)) AS id FROM gate_events GROUP BY license_plate")
def distinct_plate_first(spark: SparkSession, d: str) -> DataFrame:
    return events.first_of_each(view(spark, d, "gate_events"), ["license_plate"], ["ts", "id"]).select("license_plate", "id")


# --- events --------------------------------------------------------------------------------------------------

@query(ctes("gate_events") + " SELECT id, license_plate, lane, status FROM gate_events WHERE camera_id = 'GATE-01' ORDER BY ts DESC, id DESC LIMIT 20")
def recent_gate_events(spark: SparkSession, d: str) -> DataFrame:
    return events.newest(view(spark, d, "gate_events"), 20, camera_id="GATE-01").select("id", "license_plate", "lane", "status")


@query(ctes("gate_events") + " SELECT id, status FROM gate_events WHERE license_plate = '16B-07919' ORDER BY ts DESC, id DESC LIMIT 50")
def gate_events_by_plate(spark: SparkSession, d: str) -> DataFrame:
    return events.newest(view(spark, d, "gate_events"), 50, license_plate="16B-07919").select("id", "status")


@query(ctes("violations") + " SELECT id, object_label, status FROM violations ORDER BY entered_at DESC, id DESC LIMIT 20")
def recent_violations(spark: SparkSession, d: str) -> DataFrame:
    return events.newest(view(spark, d, "violations"), 20, by="entered_at").select("id", "object_label", "status")


@query(ctes("gate_events") + " SELECT count(*) AS n FROM gate_events WHERE status = 'STRANGER' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'")
def stranger_count_window(spark: SparkSession, d: str) -> DataFrame:
    return events.count_between(view(spark, d, "gate_events"), "2024-01-05", "2024-01-20", status="STRANGER")


@query(ctes("gate_events") + """ SELECT id, CASE WHEN status = 'KNOWN' THEN 'quen' ELSE 'la' END AS status, CASE WHEN coalesce(confidence, 0) <> 0 THEN cast(floor(confidence * 100 + 0.5::double) AS bigint) END AS percent,
 CASE WHEN lane = 'IN_2' THEN 'Làn IN 2' ELSE 'Làn IN 1' END AS lane, strftime(ts, '%H:%M') AS time, license_plate FROM gate_events WHERE camera_id = 'GATE-01' AND status = 'STRANGER' AND contains(license_plate, 'B-') ORDER BY ts DESC, id DESC LIMIT 50 OFFSET 50""")
def gate_event_page(spark: SparkSession, d: str) -> DataFrame:
    listed = events.gate_list(view(spark, d, "gate_events"), status="la", plate="b-")
    return events.gate_rows(events.clamped_page(listed, "ts", 50, number=2))


@query(ctes("violations", "zones") + r""" SELECT v.id, v.object_label, coalesce(z.name, 'Zone không xác định') AS zone_name, replace(regexp_replace(clip_path, '^.*[\\/]', ''), ' ', '%20') AS clip_file, v.duration_seconds
 FROM (SELECT * FROM violations WHERE status = 'CLOSED' AND zone_id = 1 ORDER BY entered_at DESC, id DESC LIMIT 25 OFFSET 5) v LEFT JOIN zones z ON z.zone_id = v.zone_id""")
def area_event_page(spark: SparkSession, d: str) -> DataFrame:
    listed = view(spark, d, "violations").where("status = 'CLOSED' AND zone_id = 1")
    return events.violation_rows(events.page(listed, "entered_at", 25, 5), view(spark, d, "zones")).select("id", "object_label", "zone_name", "clip_file", "duration_seconds")


@query(ctes("violations") + " SELECT id, zone_id FROM violations WHERE status = 'OPEN' AND zone_id = 2 AND camera_id = 'BAI-KIEM'")
def open_violations(spark: SparkSession, d: str) -> DataFrame:
    return events.open_violations(view(spark, d, "violations"), 2, "BAI-KIEM").select("id", "zone_id")


@query(ctes("vehicles") + " SELECT id, plate_number FROM vehicles WHERE contains(lower(plate_number), 'b-07') OR contains(lower(plate_number), 'b -07') OR coalesce(contains(lower(note), 'b -07'), false)")
def vehicle_search(spark: SparkSession, d: str) -> DataFrame:
    return events.search_vehicles(view(spark, d, "vehicles"), "B -07").select("id", "plate_number")


@query(ctes("vehicles", "gate_events") + """, s AS (SELECT license_plate, count(*) AS visits, max(ts) AS last FROM gate_events GROUP BY license_plate)
SELECT v.id, v.plate_number, coalesce(visits, 1) AS visits, strftime(last, '%Y-%m-%d %H:%M:%S') AS last_seen FROM vehicles v LEFT JOIN s ON s.license_plate = v.plate_number""")
def vehicle_list_stats(spark: SparkSession, d: str) -> DataFrame:
    out = events.with_visits(view(spark, d, "vehicles"), view(spark, d, "gate_events"))
    return out.select("id", "plate_number", "visits", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"))


@query(ctes("gate_events").replace("WITH", "WITH RECURSIVE", 1) + """, told AS (
SELECT license_plate, min(ts) AS ts FROM gate_events GROUP BY license_plate
UNION ALL
SELECT e.license_plate, min(e.ts) FROM told t JOIN gate_events e ON e.license_plate = t.license_plate AND e.ts >= t.ts + INTERVAL 20 SECOND GROUP BY e.license_plate)
SELECT min(e.id) AS id FROM told t JOIN gate_events e ON e.license_plate = t.license_plate AND e.ts = t.ts GROUP BY t.license_plate, t.ts""")
def cooldown_events(spark: SparkSession, d: str) -> DataFrame:
    return events.cooled_down(view(spark, d, "gate_events"), 20).select("id")


@query(ctes("labels", "samples") + " SELECT l.name, count(s.id) AS children FROM labels_seed l LEFT JOIN samples s ON s.label = l.name GROUP BY l.name")
def label_sample_counts(spark: SparkSession, d: str) -> DataFrame:
    return events.child_counts(view(spark, d, "labels").select("name"), view(spark, d, "samples").withColumnRenamed("label", "name"), "name")


@query(ctes("gate_events") + """ SELECT id, CASE id % 4 WHEN 0 THEN 'GATE-01' WHEN 1 THEN 'BAI-KIEM' WHEN 2 THEN 'GATE-01' ELSE 'YARD-7' END AS camera, CASE WHEN id % 3 = 1 THEN 'STRANGER' ELSE 'KNOWN' END AS status FROM gate_events""")
def camera_and_status_names(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("gate", " Bai_Kiem", "GATE_01 ", "yard-7")])
    words = F.array(*[F.lit(x) for x in ("", "la", "known")])
    return view(spark, d, "gate_events").select("id", plates.camera(F.get(names, (F.col("id") % 4).cast("int"))).alias("camera"), plates.normal_status(F.get(words, (F.col("id") % 3).cast("int"))).alias("status"))


# --- tracks and frames ---------------------------------------------------------------------------------------

@query(ctes("detections") + """, m AS (SELECT id, count(*) OVER w AS points, round(coalesce(sqrt((px - first(px) OVER w) ** 2 + (py - first(py) OVER w) ** 2) / nullif(count(*) OVER w - 1, 0), 0), 9) AS speed FROM detections WINDOW w AS (PARTITION BY track_id ORDER BY frame_no ROWS BETWEEN 39 PRECEDING AND CURRENT ROW))
SELECT id, points, speed, points = 40 AND speed < 0.3 AS is_static FROM m""")
def motion_static(spark: SparkSession, d: str) -> DataFrame:
    return windows.motion(view(spark, d, "detections")).select("id", "points", F.round("speed", 9).alias("speed"), "is_static")


@query(ctes("detections") + """ SELECT a.id AS a_id, b.id AS b_id, round((greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)) / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)), 6) AS iou
FROM detections a JOIN detections b ON a.frame_no = b.frame_no AND a.id < b.id WHERE iou >= 0.02""")
def iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    return spatial.overlapping_pairs(view(spark, d, "detections"), ["frame_no"], 0.02).select("a_id", "b_id", F.round("iou", 6).alias("iou"))


@query(ctes("detections") + """, p AS (SELECT a.id, b.id AS prior_id, b.frame_no AS f, (greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)) AS i, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s,
 sqrt(((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2) ** 2 + ((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2) ** 2) AS dist FROM detections a JOIN detections b ON b.frame_no BETWEEN a.frame_no - 5 AND a.frame_no - 1 AND a.track_id <> b.track_id)
SELECT id, prior_id FROM p WHERE i / (s - i) >= 0.2 OR dist <= 0.08 QUALIFY row_number() OVER (PARTITION BY id ORDER BY i / (s - i) DESC, f DESC, prior_id DESC) = 1""")
def reid_candidates(spark: SparkSession, d: str) -> DataFrame:
    return spatial.renumbered(view(spark, d, "detections"), 5).select("id", "prior_id")


@query(ctes("detections") + """, marked AS (SELECT track_id, frame_no, CASE WHEN frame_no - lag(frame_no) OVER (PARTITION BY track_id ORDER BY frame_no) <= 3 THEN 0 ELSE 1 END AS new FROM detections),
numbered AS (SELECT track_id, frame_no, sum(new) OVER (PARTITION BY track_id ORDER BY frame_no) AS island FROM marked)
SELECT track_id, cast(island AS bigint) AS island, min(frame_no) AS first, max(frame_no) AS last, count(*) AS n FROM numbered GROUP BY track_id, island""")
def violation_islands(spark: SparkSession, d: str) -> DataFrame:
    return windows.islands(view(spark, d, "detections"), ["track_id"], "frame_no", 3)


@query(ctes("gate_events") + """ SELECT e.id, count(*) AS frames FROM gate_events e JOIN gate_events f ON epoch_us(f.ts) BETWEEN epoch_us(e.ts) - 10000000 AND epoch_us(e.ts) + 500000 GROUP BY e.id""")
def clip_window_frames(spark: SparkSession, d: str) -> DataFrame:
    shots = view(spark, d, "gate_events")
    found = spatial.clip_frames(shots.select("id", "ts"), shots.select(F.col("ts").alias("frame_ts")))
    return found.groupBy("id").agg(F.count("*").alias("frames"))


@query(ctes("gate_events") + """, r AS (SELECT lane, confidence * 1000 AS ms, row_number() OVER (PARTITION BY lane ORDER BY confidence) - 1 AS k, count(*) OVER (PARTITION BY lane) AS n FROM gate_events WHERE confidence IS NOT NULL)
SELECT lane, round(avg(ms), 6) AS mean, round(median(ms), 6) AS median, round(max(ms) FILTER (WHERE k = round_even(0.95 * (n - 1), 0)), 6) AS p95 FROM r GROUP BY lane""")
def latency_percentile(spark: SparkSession, d: str) -> DataFrame:
    times = view(spark, d, "gate_events").where("confidence IS NOT NULL").select("lane", (F.col("confidence") * 1000).alias("ms"))
    return windows.latency(times, ["lane"], "ms").select("lane", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p95")])


@query(ctes("gate_events") + " SELECT camera_id, epoch_us(date_trunc('minute', ts)) AS minute, count(*) AS frames FROM gate_events GROUP BY ALL")
def fps_tumbling(spark: SparkSession, d: str) -> DataFrame:
    counted = view(spark, d, "gate_events").groupBy("camera_id", F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("frames"))
    return counted.select("camera_id", F.unix_micros("w.start").alias("minute"), "frames")


@query(ctes("detections") + " SELECT id FROM detections WHERE class IN ('car', 'truck', 'bus') AND round((x2 - x1) * 1000) >= 50 AND round((y2 - y1) * 1000) >= 30")
def gate_vehicle_filter(spark: SparkSession, d: str) -> DataFrame:
    det = view(spark, d, "detections")
    wide = det.withColumns({"x2": F.round((F.col("x2") - F.col("x1")) * 1000), "y2": F.round((F.col("y2") - F.col("y1")) * 1000), "x1": F.lit(0), "y1": F.lit(0)})
    return boxes.gate_vehicles(wide).select("id")


@query(ctes("detections") + """, p AS (SELECT a.id, b.id AS b, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS i, (a.x2 - a.x1) * (a.y2 - a.y1) AS s, (b.x2 - b.x1) * (b.y2 - b.y1) AS t FROM detections a JOIN detections b ON a.frame_no = b.frame_no AND a.id <> b.id),
o AS (SELECT id, b, round(greatest(i / (s + t - i), i / least(s, t)), 9) AS overlap FROM p)
SELECT id, b AS target_id, round(overlap, 6) AS overlap FROM o WHERE overlap >= 0.18 QUALIFY row_number() OVER (PARTITION BY id ORDER BY overlap DESC, b) = 1""")
def best_overlap_target(spark: SparkSession, d: str) -> DataFrame:
    det = view(spark, d, "detections")
    return boxes.best_targets(det, det, ["frame_no"]).withColumn("overlap", F.round("overlap", 6))


@query(ctes("detections") + " SELECT id, least(coalesce(lead(frame_no) OVER (PARTITION BY track_id ORDER BY frame_no) - frame_no - 1, 14), 14) AS stands_for FROM detections")
def retained_boxes(spark: SparkSession, d: str) -> DataFrame:
    return boxes.missed_frames(view(spark, d, "detections")).select("id", "stands_for")


@query(ctes("detections") + " SELECT id, CASE WHEN class IN ('train', 'bus') THEN 'truck' ELSE class END AS class, round(confidence * greatest(0.5, 1 - 0.5 * (id % 14) / 14), 6) AS confidence FROM detections")
def faded_confidence(spark: SparkSession, d: str) -> DataFrame:
    faded = boxes.faded(F.col("confidence"), (F.col("id") % 14) / 14)
    return view(spark, d, "detections").select("id", boxes.canonical_class(F.col("class")).alias("class"), F.round(faded, 6).alias("confidence"))


# --- datasets ------------------------------------------------------------------------------------------------

_CHECKED = """checked AS (SELECT *, CASE WHEN source_id IS NULL THEN 'missing source' WHEN (media_kind = 'VIDEO') <> (frame_ms IS NOT NULL) THEN 'bad timestamp'
  WHEN NOT (w > 0 AND h > 0 AND x >= 0 AND y >= 0 AND x + w <= 1 AND y + h <= 1) THEN 'bad box' WHEN media_path IS NULL THEN 'file gone' END AS reason FROM samples)"""
_SPLIT = """sources AS (SELECT source_id, row_number() OVER (ORDER BY sha256(source_id)) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT source_id FROM checked WHERE reason IS NULL)),
split AS (SELECT c.*, CASE WHEN k <= greatest(1, ceil(n / 5)) THEN 'test' WHEN k <= 2 * greatest(1, ceil(n / 5)) THEN 'val' ELSE 'train' END AS split FROM checked c JOIN sources USING (source_id) WHERE reason IS NULL)"""


@query(ctes("samples") + "," + _CHECKED + " SELECT id, reason FROM checked")
def sample_validity(spark: SparkSession, d: str) -> DataFrame:
    return dataset.checked(view(spark, d, "samples")).select("id", "reason")


def _split(spark: SparkSession, d: str) -> DataFrame:
    return dataset.split_sources(dataset.checked(view(spark, d, "samples")).where("reason IS NULL"), test=True)


@query(ctes("samples") + "," + _CHECKED + "," + _SPLIT + " SELECT id, split FROM split")
def dataset_split(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d).select("id", "split")


@query(ctes("samples") + "," + _CHECKED + """, r AS (SELECT count(*) FILTER (WHERE reason IS NULL) AS samples, count(DISTINCT label) FILTER (WHERE reason IS NULL) AS labels, count(DISTINCT source_id) FILTER (WHERE reason IS NULL) AS sources, count(*) FILTER (WHERE reason IS NOT NULL) AS excluded FROM checked)
SELECT *, samples >= 20 AND labels >= 1 AND sources >= 3 AS ready FROM r""")
def dataset_readiness(spark: SparkSession, d: str) -> DataFrame:
    return dataset.readiness(view(spark, d, "samples"))


@query(ctes("samples") + "," + _CHECKED + "," + _SPLIT + """, rules AS (SELECT * FROM (VALUES ('Container', 'container'), ('Xe tải', 'truck'), ('Xe nâng', 'forklift')) t(label, base_class)),
r AS (SELECT r.label, count(s.id) AS samples, count(DISTINCT s.source_id) AS sources, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'val') AS val, count(*) FILTER (WHERE split = 'test') AS test FROM rules r LEFT JOIN split s ON s.label = r.label AND s.base_class = r.base_class GROUP BY r.label)
SELECT *, samples >= 60 AND sources >= 5 AND train >= 30 AND val >= 6 AND test >= 6 AS ready FROM r""")
def yard_coverage(spark: SparkSession, d: str) -> DataFrame:
    return dataset.yard_coverage(_split(spark, d)).select("label", "samples", "sources", "train", "val", "test", "ready")


@query(ctes("samples") + "," + _CHECKED + "," + _SPLIT + " SELECT source_id, count(DISTINCT split) AS splits FROM split GROUP BY source_id HAVING splits > 1")
def split_leak_check(spark: SparkSession, d: str) -> DataFrame:
    return dataset.leaks(_split(spark, d))


@query(ctes("samples") + "," + _CHECKED + " SELECT id, printf('%.6f %.6f %.6f %.6f', x + w / 2, y + h / 2, w, h) AS line FROM checked WHERE reason IS NULL")
def yolo_label_lines(spark: SparkSession, d: str) -> DataFrame:
    good = dataset.checked(view(spark, d, "samples")).where("reason IS NULL")
    return good.select("id", geometry.yolo_box(*[F.col(c) for c in ("x", "y", "w", "h")]).alias("line"))


@query("""WITH runs AS (SELECT lang, round(avg(quality), 6) AS map50, round(1 - avg(toxic), 6) AS precision, round(avg(quality) - avg(toxic), 6) AS recall FROM documents JOIN labels USING (doc_id) GROUP BY lang)
SELECT lang, map50, precision, recall, concat_ws(',', CASE WHEN map50 < 0.65 THEN 'map50' END, CASE WHEN precision < 0.65 THEN 'precision' END, CASE WHEN recall < 0.55 THEN 'recall' END) AS failures FROM runs""")
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    rounded = lambda c, name: F.round(c, 6).alias(name)
    runs = rows.groupBy("lang").agg(rounded(F.avg("quality"), "map50"), rounded(1 - F.avg("toxic"), "precision"), rounded(F.avg("quality") - F.avg("toxic"), "recall"))
    return dataset.quality_gate(runs).withColumn("failures", F.array_join("failures", ","))


# --- changes and reports -------------------------------------------------------------------------------------

@query(ctes("violations") + """ SELECT id, CASE WHEN status = 'OPEN' THEN 'CLOSED' ELSE status END AS status, CASE WHEN status = 'OPEN' THEN greatest(0, cast(floor((epoch_us(TIMESTAMP '2000-01-01') - epoch_us(entered_at)) / 1e6) AS bigint)) ELSE duration_seconds END AS duration_seconds FROM violations""")
def closed_duration_repair(spark: SparkSession, d: str) -> DataFrame:
    return mutations.close_stale(view(spark, d, "violations"), "BAI-KIEM", "2000-01-01").select("id", "status", "duration_seconds")


@query(ctes("vehicles") + " SELECT plate_number, CASE WHEN id % 10 = 0 THEN 'KNOWN' ELSE status END AS status FROM vehicles UNION ALL SELECT 'NEW-1', 'STRANGER'")
def vehicle_upsert(spark: SparkSession, d: str) -> DataFrame:
    table = view(spark, d, "vehicles").select("plate_number", "status")
    changed = view(spark, d, "vehicles").where("id % 10 = 0").select("plate_number", F.lit("KNOWN").alias("status"))
    new = spark.createDataFrame([("NEW-1", "STRANGER")], "plate_number string, status string")
    return mutations.upsert(table, changed.union(new), "plate_number")


@query(ctes("violations", "zones") + " SELECT v.id FROM violations v WHERE v.zone_id <> 1")
def zone_delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    gone = view(spark, d, "zones").where("zone_id = 1").select("zone_id")
    return mutations.delete(view(spark, d, "violations"), gone, "zone_id").select("id")


@query(ctes("gate_events") + """ SELECT count(*) AS total, count(*) FILTER (WHERE confidence IS NULL) AS unread, count(confidence) AS read, CASE WHEN count(*) > 0 THEN cast(floor(count(confidence) * 100 / count(*) + 0.5) AS bigint) ELSE 100 END AS read_rate FROM gate_events""")
def gate_kpi(spark: SparkSession, d: str) -> DataFrame:
    return reports.gate_figures(view(spark, d, "gate_events")).withColumn("read_rate", F.col("read_rate").cast("long"))


@query(ctes("detections", "edges", "zones", "targets", "labels") + "," + _INSIDE + "," + _STATUS + """
SELECT (SELECT count(*) FROM judged WHERE status = 'VIOLATION') AS violations, (SELECT count(DISTINCT id) FROM judged) AS objects_in_zones, (SELECT count(*) FROM judged WHERE status = 'ALLOWED') AS allowed, (SELECT count(*) FROM zones) AS active_zones""")
def area_kpi(spark: SparkSession, d: str) -> DataFrame:
    zones = view(spark, d, "zones").agg(F.count("*").alias("n")).scalar()
    counts = _judged(spark, d).agg(F.count_if(F.col("status") == "VIOLATION").alias("violations"), F.countDistinct("id").alias("objects_in_zones"), F.count_if(F.col("status") == "ALLOWED").alias("allowed"))
    return counts.withColumn("active_zones", zones)


@query(ctes("gate_events") + """ SELECT strftime(ts, '%Y-%m-%d') AS day, camera_id, count(*) AS entries, count(*) FILTER (WHERE confidence > 0) AS plates_read, count(*) - count(*) FILTER (WHERE confidence > 0) AS unread, round(coalesce(avg(confidence) FILTER (WHERE confidence > 0), 0), 9) AS mean_confidence FROM gate_events GROUP BY day, camera_id""")
def daily_kpi_spec(spark: SparkSession, d: str) -> DataFrame:
    return reports.daily_figures(view(spark, d, "gate_events"))


@query(ctes("violations", "zones") + """ SELECT z.zone_id, z.name, count(v.id) AS violations, count(v.id) FILTER (WHERE status = 'OPEN') AS open, round(coalesce(avg(duration_seconds), 0), 6) AS mean_duration FROM zones z LEFT JOIN violations v ON v.zone_id = z.zone_id GROUP BY z.zone_id, z.name""")
def zone_violation_summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.zone_figures(view(spark, d, "violations"), view(spark, d, "zones"))


@query(ctes("samples") + """ SELECT 'media kind' AS "check", count(*) FILTER (WHERE media_kind NOT IN ('IMAGE', 'VIDEO')) AS broken FROM samples UNION ALL SELECT 'time of videos only', count(*) FILTER (WHERE (media_kind = 'VIDEO') <> (frame_ms IS NOT NULL)) FROM samples UNION ALL SELECT 'box width', count(*) FILTER (WHERE NOT w > 0) FROM samples""")
def constraint_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.broken(view(spark, d, "samples"), reports.constraints("samples"))


# --- stateful operators (no SQL form; golden tests) ------------------------------------------------------------

def _frames(spark: SparkSession, d: str) -> DataFrame:
    """Two cameras' frames of a fifth of a second, also those without named detections."""
    names = view(spark, d, "labels").groupBy(F.col("base_class").alias("class")).agg(F.min("name").alias("label"))
    named = view(spark, d, "detections").join(names, "class", "left")
    det = F.struct("track_id", "label", "x1", "y1", "x2", "y2")
    every = named.groupBy("frame_no").agg(F.sort_array(F.collect_list(F.when(F.col("label").isNotNull(), det))).alias("detections"))
    cameras = every.withColumn("camera_id", F.explode(F.array(F.lit("BAI-KIEM"), F.lit("GATE-01"))))
    return cameras.select("camera_id", F.timestamp_millis(F.col("frame_no") * 200).alias("frame_ts"), "detections")


@query()
def zone_machine_transitions(spark: SparkSession, d: str) -> DataFrame:
    from tessera.streaming.runners import frame_hits, zone_transitions

    return zone_transitions(frame_hits(_frames(spark, d), view(spark, d, "zones")))


def _per_group(df: DataFrame, key: str, order: list[str], schema: str, step) -> DataFrame:  # noqa: ANN001
    """Rows (dicts) of step on the rows of each key in order: both are streamed, a task holds what step holds."""
    from collections.abc import Iterator
    from itertools import batched, groupby

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for b in batches for r in b.itertuples(index=False))
        made = (x for value, own in groupby(rows, key=lambda r: getattr(r, key)) for x in step(value, own))
        for some in batched(made, 10_000):
            yield pd.DataFrame(list(some))

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def _pixels(r) -> list[int]:  # noqa: ANN001
    return [round(v * 1000) for v in (r.x1, r.y1, r.x2, r.y2)]


_RANKED = """, sized AS (SELECT id, frame_no, class, row_number() OVER (PARTITION BY frame_no ORDER BY confidence + CASE class WHEN 'forklift' THEN 0.25::double WHEN 'truck' THEN 0.12::double WHEN 'car' THEN 0.05::double ELSE 0.0::double END DESC, id) AS k,
  round(x1 * 1000)::int AS a, round(y1 * 1000)::int AS b, round(x2 * 1000)::int AS c, round(y2 * 1000)::int AS e FROM detections),
pairs AS (SELECT p.frame_no, p.k AS i, q.k AS j, greatest(0, least(p.c, q.c) - greatest(p.a, q.a)) * greatest(0, least(p.e, q.e) - greatest(p.b, q.b)) AS shared,
  greatest(1, (p.c - p.a) * (p.e - p.b)) AS s, greatest(1, (q.c - q.a) * (q.e - q.b)) AS t, p.class <> 'person' AND q.class <> 'person' AS vehicles FROM sized p JOIN sized q ON p.frame_no = q.frame_no AND p.k < q.k),
hides AS (SELECT frame_no, i, j FROM pairs WHERE shared::double / (s + t - shared) > CASE WHEN vehicles THEN 0.18 ELSE 0.35 END OR shared::double / least(s, t) > CASE WHEN vehicles THEN 0.42 ELSE 0.6 END),
one AS (SELECT frame_no, 1 AS k FROM sized WHERE k = 1),
two AS (SELECT frame_no, 2 AS k FROM sized s WHERE k = 2 AND NOT EXISTS (SELECT 1 FROM hides h JOIN one o ON o.frame_no = h.frame_no AND o.k = h.i WHERE h.frame_no = s.frame_no AND h.j = 2)),
kept2 AS (FROM one UNION ALL FROM two),
three AS (SELECT frame_no, 3 AS k FROM sized s WHERE k = 3 AND NOT EXISTS (SELECT 1 FROM hides h JOIN kept2 o ON o.frame_no = h.frame_no AND o.k = h.i WHERE h.frame_no = s.frame_no AND h.j = 3)),
kept3 AS (FROM kept2 UNION ALL FROM three),
four AS (SELECT frame_no, 4 AS k FROM sized s WHERE k = 4 AND NOT EXISTS (SELECT 1 FROM hides h JOIN kept3 o ON o.frame_no = h.frame_no AND o.k = h.i WHERE h.frame_no = s.frame_no AND h.j = 4))"""


@query(ctes("detections") + _RANKED + " SELECT s.frame_no, s.id FROM sized s JOIN (FROM kept3 UNION ALL FROM four) k ON k.frame_no = s.frame_no AND k.k = s.k")
def frame_nms(spark: SparkSession, d: str) -> DataFrame:
    from tessera.streaming.frames import suppress

    step = lambda f, rows: [{"frame_no": f, "id": k["id"]} for k in suppress([{"id": r.id, "class": r.cls, "confidence": r.confidence, "bbox": _pixels(r)} for r in rows])]
    found = view(spark, d, "detections").withColumnRenamed("class", "cls")
    return _per_group(found, "frame_no", ["id"], "frame_no long, id long", step)


@query()
def assembled_trucks(spark: SparkSession, d: str) -> DataFrame:
    from tessera.streaming.frames import assemble

    def step(frame: int, rows: list) -> list[dict]:
        made = assemble([{"class": r.cls, "confidence": r.confidence, "bbox": _pixels(r), "trackId": r.track_id} for r in rows])
        return [dict(zip(("frame_no", "track_id", "x1", "y1", "x2", "y2"), (frame, b["trackId"], *b["bbox"]))) for b in made if b.get("source") == "assembled"]

    found = view(spark, d, "detections").withColumnRenamed("class", "cls")
    return _per_group(found, "frame_no", ["id"], "frame_no long, track_id long, x1 long, y1 long, x2 long, y2 long", step)


_BY_TRACK = """, rows AS (SELECT track_id, frame_no, class, confidence, row_number() OVER (PARTITION BY track_id ORDER BY frame_no, id) AS n FROM detections)"""
_HYSTERESIS = _BY_TRACK + """, fold AS (SELECT DISTINCT track_id, 0::BIGINT AS n, NULL::DOUBLE AS level, 0::BIGINT AS last, 0::BIGINT AS frame_no, false AS shown FROM rows
  UNION ALL
  SELECT track_id, n, CASE WHEN NOT ok THEN had WHEN had IS NULL THEN c ELSE 0.4::double * c + (1 - 0.4::double) * had END, CASE WHEN ok THEN f ELSE last END, f, ok FROM (
    SELECT *, c >= CASE WHEN had IS NULL THEN 0.3::double ELSE 0.14::double END AS ok FROM (
      SELECT r.track_id, r.n, r.frame_no AS f, r.confidence AS c, o.last, CASE WHEN r.frame_no - 1 - o.last > 60 THEN NULL ELSE o.level END AS had FROM fold o JOIN rows r ON r.track_id = o.track_id AND r.n = o.n + 1) x) y)"""


@query(ctes("detections").replace("WITH", "WITH RECURSIVE", 1) + _HYSTERESIS + " SELECT track_id, frame_no, round(level, 3) AS confidence FROM fold WHERE shown")
def track_hysteresis(spark: SparkSession, d: str) -> DataFrame:
    from tessera.streaming.frames import hysteresis

    step = lambda t, rows: ({"track_id": t, "frame_no": f, "confidence": c} for f, c in hysteresis((r.frame_no, r.confidence) for r in rows))
    return _per_group(view(spark, d, "detections"), "track_id", ["frame_no", "id"], "track_id long, frame_no long, confidence double", step)


_CLASSES = ["motorcycle", "truck", "car", "person", "forklift"]
_VOTES = _BY_TRACK + ", fold AS (SELECT DISTINCT track_id, 0::BIGINT AS n, 0::BIGINT AS last, 0::BIGINT AS frame_no, '' AS class, " + ", ".join(f"0.0::double AS v_{c}" for c in _CLASSES) + """ FROM rows
  UNION ALL
  SELECT r.track_id, r.n, r.frame_no, r.frame_no, r.class, """ + ", ".join(
    f"CASE WHEN r.frame_no - 1 - o.last > 120 OR o.v_{c} * 0.78::double < 0.01 THEN 0.0::double ELSE o.v_{c} * 0.78::double END + CASE WHEN r.class = '{c}' THEN r.confidence ELSE 0.0::double END" for c in _CLASSES
) + " FROM fold o JOIN rows r ON r.track_id = o.track_id AND r.n = o.n + 1)"
_MOST = "greatest(" + ", ".join(f"v_{c}" for c in _CLASSES) + ")"


@query(ctes("detections").replace("WITH", "WITH RECURSIVE", 1) + _VOTES + " SELECT track_id, frame_no, CASE " + _MOST + " WHEN 0 THEN class " + " ".join(f"WHEN v_{c} THEN '{c}'" for c in _CLASSES) + " END AS class FROM fold WHERE n > 0")
def stable_track_classes(spark: SparkSession, d: str) -> DataFrame:
    from tessera.streaming.frames import stable_classes

    step = lambda t, rows: ({"track_id": t, "frame_no": f, "class": c} for f, c in stable_classes((r.frame_no, r.cls, r.confidence) for r in rows))
    found = view(spark, d, "detections").withColumnRenamed("class", "cls")
    return _per_group(found, "track_id", ["frame_no", "id"], "track_id long, frame_no long, class string", step)


@query()
def gate_emitted_events(spark: SparkSession, d: str) -> DataFrame:
    from tessera.streaming.runners import gate_told

    at = view(spark, d, "gate_events").select("id", "camera_id", (F.unix_micros("ts") / 1e6).alias("at"))
    reads = view(spark, d, "ocr_reads").withColumn("plate", plates.plate_format(F.col("text"))).join(at, "id").where("plate IS NOT NULL")
    return gate_told(reads)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone hits by status: points in polygons, rules, counts."""
    return spatial_zone_hits(spark, sf_dir)
