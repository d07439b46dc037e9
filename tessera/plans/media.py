"""Queries of media, gate zones, drawn shapes and renumbered tracks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geometry
from tessera.operators import boxes, media, spatial
from tessera.plans.domain import ctes, view
from tessera.plans.registry import query

# Sent files are the texts of documents; images may have 600 bytes here and videos 1200, so that some are refused.
_SENT = """sent AS (SELECT doc_id AS id, coalesce(text, '') AS body, CASE WHEN doc_id % 6 <> 0 THEN concat(CASE WHEN doc_id % 4 = 0 THEN 'ảnh bãi số ' ELSE 'cam/' END, cast(doc_id % 400 as string), CASE WHEN doc_id % 3 = 0 THEN '.png' ELSE '' END, CASE WHEN doc_id % 5 = 0 THEN ' with a longer name.mp4' ELSE '' END) END AS file_name,
  CASE WHEN doc_id % 7 = 0 THEN 'video' END AS kind, CASE doc_id % 5 WHEN 0 THEN 'video/mp4' WHEN 1 THEN 'image/PNG' WHEN 2 THEN 'image/webp' WHEN 3 THEN 'video/quicktime' END AS type FROM {table})"""


def _sent(spark: SparkSession, d: str) -> DataFrame:
    sent = spark.sql("WITH " + _SENT + " SELECT * FROM sent", table=spark.read.parquet(f"{d}/documents.parquet"))
    text = F.base64(F.encode("body", "UTF-8"))
    return sent.select("id", "file_name", "kind", F.when(F.col("type").isNotNull(), F.concat(F.lit("data:"), "type", F.lit(";base64,"), text)).otherwise(text).alias("data"))


_UPLOADS = "WITH " + _SENT.format(table="documents") + """, m AS (SELECT *, lower(coalesce(CASE WHEN body <> '' THEN type END, 'image/jpeg')) AS mime FROM sent),
k AS (SELECT *, CASE WHEN coalesce(kind, '') = 'video' OR mime LIKE 'video%' THEN 'video' ELSE 'img' END AS media_kind FROM m),
e AS (SELECT *, CASE mime WHEN 'image/png' THEN '.png' WHEN 'image/webp' THEN '.webp' WHEN 'video/quicktime' THEN '.mov' ELSE CASE media_kind WHEN 'video' THEN '.mp4' ELSE '.jpg' END END AS ext, regexp_replace(file_name, '[^a-zA-Z0-9_.-]', '_', 'g') AS safe FROM k WHERE file_name IS NOT NULL AND body <> ''),
u AS (SELECT *, CASE WHEN ends_with(safe, ext) THEN safe ELSE safe || ext END AS filename, strlen(body) > CASE media_kind WHEN 'video' THEN 1200 ELSE 600 END AS large FROM e)"""


@query(_UPLOADS + """ SELECT id, mime, media_kind, filename, CASE WHEN length(file_name) > 22 THEN substr(file_name, 1, 18) || '...' ELSE file_name END AS name, CASE WHEN large THEN 'too large' END AS refused,
  CASE WHEN NOT large THEN '/data/uploads/' || filename END AS url, CASE WHEN NOT large THEN md5(body) END AS md5 FROM u""")
def uploaded_media(spark: SparkSession, d: str) -> DataFrame:
    """Named files with data as they would be kept, or why they are refused."""
    kept = media.uploads(_sent(spark, d), 1200, 600).where("file_name IS NOT NULL AND refused IS DISTINCT FROM 'no data'").where(~F.col("data").endswith(";base64,"))
    return kept.select("id", "mime", "media_kind", "filename", "name", "refused", "url", F.md5("bytes").alias("md5"))


@query(_UPLOADS + """ SELECT filename, max_by(id, (id % 2 = 1, id)) AS id, max_by(media_kind, (id % 2 = 1, id)) AS media_kind FROM u WHERE NOT large GROUP BY filename""")
def media_registry(spark: SparkSession, d: str) -> DataFrame:
    """A registry of the even ids, into which the odd ones are put: one row a file name."""
    kept = media.uploads(_sent(spark, d), 1200, 600).where("file_name IS NOT NULL AND refused IS NULL").select("filename", "id", "media_kind")
    return media.registered(kept.where("id % 2 = 0"), kept.where("id % 2 = 1"), "id")


@query(ctes("media_files") + """, f AS (SELECT *, starts_with(name, 'area_') OR name LIKE '%.mp4' AS a, folder = 'crops' AND (starts_with(name, 'gate_crop_') OR name LIKE '%.jpg' OR name LIKE '%.png') OR folder = 'clips' AND starts_with(name, 'gate_clip_') AS g FROM media_files WHERE is_file AND name <> '.gitkeep')
SELECT 'area' AS events, id FROM f WHERE folder = 'clips' AND a UNION ALL SELECT 'gate', id FROM f WHERE g UNION ALL SELECT 'all', id FROM f""")
def swept_media(spark: SparkSession, d: str) -> DataFrame:
    """Files that go with the events of each kind."""
    area, gate, whole = (media.swept(view(spark, d, "media_files"), kind).select(F.lit(kind).alias("events"), "id") for kind in media.SWEPT)
    return area.union(gate).union(whole)


@query(ctes("detections", "edges") + """, u AS (SELECT zone_id, CASE WHEN zone_id % 2 = 1 THEN ax * 100 / 100 ELSE ax END AS ax, CASE WHEN zone_id % 2 = 1 THEN ay * 100 / 100 ELSE ay END AS ay, CASE WHEN zone_id % 2 = 1 THEN cx * 100 / 100 ELSE cx END AS cx, CASE WHEN zone_id % 2 = 1 THEN cy * 100 / 100 ELSE cy END AS cy FROM edges),
hits AS (SELECT d.id, zone_id FROM detections d, u GROUP BY ALL HAVING count(*) FILTER (WHERE py > least(ay, cy) AND py <= greatest(ay, cy) AND px <= greatest(ax, cx) AND (ax = cx OR px <= (py - ay) * (cx - ax) / (cy - ay) + ax)) % 2 = 1)
SELECT zone_id, count(*) AS hits, cast(sum(id) AS bigint) AS id_sum FROM hits GROUP BY zone_id""")
def gate_zone_hits(spark: SparkSession, d: str) -> DataFrame:
    """Points in gate zones, of which every second one is drawn in percents."""
    drawn = view(spark, d, "zones").withColumn("polygon", F.when(F.col("zone_id") % 2 == 1, F.transform("polygon", lambda p: F.struct((p["x"] * 100).alias("x"), (p["y"] * 100).alias("y")))).otherwise(F.col("polygon")))
    return spatial.gate_hits(view(spark, d, "detections"), drawn).groupBy("zone_id").agg(F.count("*").alias("hits"), F.sum("id").alias("id_sum"))


@query(ctes("samples") + """, p AS (SELECT id, CASE WHEN id % 4 < 2 THEN x ELSE x + w END AS tx, y, w, h FROM samples)
SELECT id, round(tx, 6) AS x, round(y, 6) AS y FROM p""")
def label_places(spark: SparkSession, d: str) -> DataFrame:
    """Where a drawn shape's name is written: its topmost corner, the first of equals. Shapes begin at their left or right upper corner."""
    left, right, x, y = F.col("x"), F.col("x") + F.col("w"), F.col("x"), F.col("y")
    corner = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    upper, lower = [corner(left, y), corner(right, y)], [corner(right, y + F.col("h")), corner(x, y + F.col("h"))]
    shape = F.when(F.col("id") % 4 < 2, F.array(*upper, *lower)).otherwise(F.array(upper[1], *lower, upper[0]))
    return view(spark, d, "samples").select("id", geometry.topmost(shape).alias("p")).select("id", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query(ctes("sightings") + """, c AS (SELECT id, greatest(0, least(639, x1)) AS x1, greatest(0, least(359, y1 - 100)) AS y1, x1 + wide AS x2, y1 - 100 + high AS y2 FROM sightings),
b AS (SELECT id, x1, y1, greatest(x1 + 1, least(640, x2)) AS x2, greatest(y1 + 1, least(360, y2)) AS y2 FROM c)
SELECT id, cast(x1 AS int) AS x1, cast(y1 AS int) AS y1, cast(x2 AS int) AS x2, cast(y2 AS int) AS y2, ((x1 * 20000 + 640) // 1280) / 10000 AS nx1, ((y1 * 20000 + 360) // 720) / 10000 AS ny1, ((x2 * 20000 + 640) // 1280) / 10000 AS nx2, ((y2 * 20000 + 360) // 720) / 10000 AS ny2 FROM b""")
def picture_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes cut to a picture of 640 by 360, some of which lie partly or wholly outside."""
    own = view(spark, d, "sightings")
    y = F.col("y1") - 100
    return own.select("id", *[c.alias(k) for k, c in geometry.picture_box((F.col("x1"), y, F.col("x1") + F.col("wide"), y + F.col("high")), 640, 360).items()])


@query(ctes("samples") + """, s AS (SELECT id, CASE WHEN id % 9 = 0 THEN NULL ELSE x END AS x, y, w, h, CASE WHEN id % 2 = 0 THEN 100.0::double ELSE 1.0::double END AS m FROM samples), t AS (SELECT id, x * m AS x, y * m AS y, w * m AS w, h * m AS h FROM s),
u AS (SELECT *, CASE WHEN greatest(x, y, w, h) > 1 THEN 100.0::double ELSE 1.0::double END AS unit FROM t)
SELECT id, coalesce(x IS NOT NULL AND x / unit >= 0 AND y / unit >= 0 AND w / unit > 0 AND h / unit > 0 AND x / unit + w / unit <= 1 AND y / unit + h / unit <= 1, false) AS fits FROM u""")
def sample_boxes_that_fit(spark: SparkSession, d: str) -> DataFrame:
    """Which samples' boxes lie within their picture; every second one is in percents, some lack a side."""
    given = view(spark, d, "samples").withColumn("x", F.when(F.col("id") % 9 != 0, F.col("x"))).withColumn("m", F.when(F.col("id") % 2 == 0, 100.0).otherwise(1.0))
    return given.select("id", boxes.unit_box_fits(*[F.col(c) * F.col("m") for c in "xywh"]).alias("fits"))


_HITS = """, seen AS (SELECT *, frame_no * 0.25::double AS seconds FROM sightings WHERE present AND track_id IS NOT NULL),
hits AS (SELECT id, camera_id, zone AS zone_id, track_id, frame_no, seconds, x1 / 1280::double AS x1, y1 / 720::double AS y1, (x1 + wide) / 1280::double AS x2, (y1 + high) / 720::double AS y2 FROM seen WHERE zone IS NOT NULL),
marked AS (SELECT *, coalesce(seconds - lag(seconds) OVER w >= 12, true) AS fresh FROM hits WINDOW w AS (PARTITION BY camera_id, zone_id, track_id ORDER BY frame_no, id)),
opened AS (SELECT *, max(CASE WHEN fresh THEN seconds END) OVER w AS opened, max(CASE WHEN fresh THEN id END) OVER w AS first FROM marked WINDOW w AS (PARTITION BY camera_id, zone_id, track_id ORDER BY frame_no, id)),
pairs AS (SELECT a.id, b.id AS prior_id, b.opened, b.first, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS i, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s, sqrt(((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2) ** 2 + ((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2) ** 2) AS dist
  FROM opened a JOIN opened b ON a.camera_id = b.camera_id AND a.zone_id = b.zone_id AND a.track_id <> b.track_id AND b.seconds < a.seconds AND a.seconds - b.seconds < 12
  WHERE a.fresh AND NOT EXISTS (SELECT 1 FROM hits q WHERE q.camera_id = b.camera_id AND q.zone_id = b.zone_id AND q.track_id = b.track_id AND q.frame_no > b.frame_no AND q.frame_no < a.frame_no)
    AND NOT EXISTS (SELECT 1 FROM seen o WHERE o.camera_id = a.camera_id AND o.frame_no = a.frame_no AND o.track_id = b.track_id))
SELECT id, prior_id, round(i / (s - i), 6) AS iou FROM pairs WHERE i / (s - i) >= 0.2 OR dist <= 0.08 QUALIFY row_number() OVER (PARTITION BY id ORDER BY i / (s - i) DESC, opened DESC, first DESC, prior_id DESC) = 1"""


@query(ctes("sightings") + _HITS)
def sessions_gone_on(spark: SparkSession, d: str) -> DataFrame:
    """Boxes that go on a session of a track that has just vanished from their zone. Four frames a second."""
    seen = view(spark, d, "sightings").where("present AND track_id IS NOT NULL").withColumn("seconds", F.col("frame_no") * 0.25)
    parts = [(F.col("x1") / 1280).alias("x1"), (F.col("y1") / 720).alias("y1"), ((F.col("x1") + F.col("wide")) / 1280).alias("x2"), ((F.col("y1") + F.col("high")) / 720).alias("y2")]
    hits = seen.where("zone IS NOT NULL").select("id", "camera_id", F.col("zone").alias("zone_id"), "track_id", "frame_no", "seconds", *parts)
    return spatial.reidentified(hits, seen).select("id", "prior_id", F.round("iou", 6).alias("iou"))
