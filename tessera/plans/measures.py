"""Queries of the measures of single boxes, labels and tracks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geometry, labels
from tessera.operators import boxes, windows
from tessera.plans.domain import ctes, view
from tessera.plans.registry import query


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    """Sightings with their corners in pixels."""
    seen = view(spark, d, "sightings")
    return seen.withColumns({"x2": F.col("x1") + F.col("wide"), "y2": F.col("y1") + F.col("high")})


@query(ctes("sightings") + """, p AS (SELECT id, x1, y1, wide AS w, high AS h, x1 + 30 AS a, y1 + 50 AS b, x1 + 70 + step % 90 AS c, y1 + 64 + step % 50 AS e FROM sightings),
r AS (SELECT *, greatest(0.0::double, least(1.0::double, (a - x1) / w::double)) AS rx1, greatest(0.0::double, least(1.0::double, (b - y1) / h::double)) AS ry1, greatest(0.0::double, least(1.0::double, (c - x1) / w::double)) AS rx2, greatest(0.0::double, least(1.0::double, (e - y1) / h::double)) AS ry2 FROM p)
SELECT id, round(rx1, 6) AS rx1, round(ry1, 6) AS ry1, round(rx2, 6) AS rx2, round(ry2, 6) AS ry2, trunc(x1 + rx1 * w)::int AS x1, trunc(y1 + ry1 * h)::int AS y1, trunc(x1 + rx2 * w)::int AS x2, trunc(y1 + ry2 * h)::int AS y2 FROM r""")
def plate_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Plates as parts of their vehicles' boxes, drawn into them, and back in pixels."""
    own = _pixels(spark, d)
    vehicle = geometry.box()
    plate = (F.col("x1") + 30, F.col("y1") + 50, F.col("x1") + 70 + F.col("step") % 90, F.col("y1") + 64 + F.col("step") % 50)
    parts = own.withColumns(boxes.relative_plate(vehicle, plate))
    back = {f"b{k}": c for k, c in boxes.absolute_plate(vehicle).items()}
    out = parts.withColumns(back).select("id", *[F.round(c, 6).alias(c) for c in ("rx1", "ry1", "rx2", "ry2")], *[F.col(f"b{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])
    return out


@query(ctes("sightings") + """, m AS (SELECT id, x1 + wide / 2.0::double AS px, y1 + high AS py, wide::double / high AS aspect, wide * high / (1280 * 720)::double AS share, lag(x1) OVER w AS ox, lag(y1) OVER w AS oy, x1, y1, (wide + high) / 2.0::double AS side FROM sightings WINDOW w AS (PARTITION BY camera_id, slot ORDER BY frame_no))
SELECT id, px, py, round(aspect, 6) AS aspect, round(share, 6) AS share, round(sqrt((x1 - ox) ** 2 + (y1 - oy) ** 2) / greatest(1, side), 6) AS moved FROM m""")
def box_measures(spark: SparkSession, d: str) -> DataFrame:
    """Where a box stands, its shape, its part of the picture, and how far it is from the box before in its own sides."""
    from pyspark.sql import Window

    from tessera.functions import shapes

    own, before = _pixels(spark, d), Window.partitionBy("camera_id", "slot").orderBy("frame_no")
    with_old = own.withColumns({f"o_{c}": F.lag(c).over(before) for c in ("x1", "y1", "x2", "y2")})
    box = F.struct("x1", "y1", "x2", "y2")
    x, y = geometry.bottom_center(geometry.box())
    far = geometry.distance_ratio(geometry.box(), geometry.box("o_"))
    return with_old.select("id", x.alias("px"), y.alias("py"), F.round(shapes.aspect(box), 6).alias("aspect"), F.round(shapes.share(box, 1280, 720), 6).alias("share"), F.round(far, 6).alias("moved"))


@query(ctes("samples") + """, s AS (SELECT id, CASE WHEN id % 2 = 0 THEN x * 100 ELSE x END AS x, CASE WHEN id % 2 = 0 THEN y * 100 ELSE y END AS y, CASE WHEN id % 2 = 0 THEN w * 100 ELSE w END AS w, CASE WHEN id % 2 = 0 THEN h * 100 ELSE h END AS h FROM samples),
u AS (SELECT id, CASE WHEN greatest(x, y, w, h) > 1 THEN 100.0::double ELSE 1.0::double END AS unit, x, y, w, h FROM s)
SELECT id, round(x / unit, 6) AS x, round(y / unit, 6) AS y, round(w / unit, 6) AS w, round(h / unit, 6) AS h FROM u""")
def sample_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of samples, every second one given in percents, as parts of one."""
    mixed = view(spark, d, "samples").select("id", *[F.when(F.col("id") % 2 == 0, F.col(c) * 100).otherwise(F.col(c)).alias(c) for c in ("x", "y", "w", "h")])
    return mixed.select("id", *[F.round(u, 6).alias(c) for c, u in zip("xywh", boxes.unit_box(*map(F.col, "xywh")))])


@query(ctes("ocr_reads") + """, l AS (SELECT id, range(0, id % 23) AS items FROM ocr_reads)
SELECT id, array_to_string(CASE WHEN len(items) <= 5 THEN items ELSE [items[1 + (k * (len(items) - 1) // 4)] FOR k IN range(0, 5)] END, ',') AS chosen FROM l""")
def even_choices(spark: SparkSession, d: str) -> DataFrame:
    """At most five of a list, evenly spaced from the first to the last."""
    n = (F.col("id") % 23).cast("int")
    items = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return view(spark, d, "ocr_reads").select("id", items.alias("items")).select("id", F.array_join(boxes.even_choice(F.col("items"), 5), ",").alias("chosen"))


@query(ctes("site_zones") + """, codes AS (SELECT zone_id, list_transform(string_split(name, ''), lambda c: ascii(c)::BIGINT) AS c FROM site_zones)
SELECT zone_id, cast(abs(list_reduce(list_prepend(0::BIGINT, c), lambda a, x: ((a * 31 + x + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)) % 12 AS int) AS color FROM codes""")
def zone_colors(spark: SparkSession, d: str) -> DataFrame:
    """Colors of zones by the hash of their names."""
    return view(spark, d, "site_zones").select("zone_id", labels.hash_color(F.col("name"), 12).cast("int").alias("color"))


@query(ctes("detections").replace("WITH", "WITH RECURSIVE", 1) + """, rows AS (SELECT track_id, confidence, row_number() OVER (PARTITION BY track_id ORDER BY frame_no) AS n FROM detections),
fold AS (SELECT track_id, n, confidence AS level FROM rows WHERE n = 1 UNION ALL SELECT r.track_id, r.n, f.level * (1 - 0.4::double) + r.confidence * 0.4::double FROM fold f JOIN rows r ON r.track_id = f.track_id AND r.n = f.n + 1)
SELECT track_id, round(max_by(level, n), 6) AS confidence FROM fold GROUP BY track_id""")
def smoothed_confidence(spark: SparkSession, d: str) -> DataFrame:
    out = windows.smoothed(view(spark, d, "detections"), "track_id", "frame_no", "confidence", 0.4)
    return out.select("track_id", F.round("confidence", 6).alias("confidence"))


@query(ctes("violations") + """ SELECT object_label, CASE WHEN contains(lower(object_label), 'người') OR contains(lower(object_label), 'person') THEN 'nguoi' ELSE 'xe' END AS kind, count(*) AS n FROM violations GROUP BY object_label""")
def label_kinds(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "violations").groupBy("object_label", labels.kind_of_label(F.col("object_label")).alias("kind")).agg(F.count("*").alias("n"))


@query(ctes("sightings") + """ SELECT id, CASE WHEN class = 'truck' AND wide * high / (1280 * 720)::double <= 0.008 AND wide::double / high >= 1.3 AND high <= 110 THEN 'car' ELSE class END AS class,
  coalesce(wide::double / high BETWEEN 1.1 AND 6.0 AND step >= floor(0.38 * high) AND step >= CASE WHEN high > 100 THEN floor(0.55 * high) ELSE 0 END AND confidence >= 0.2, false) AS may_be_plate FROM sightings""")
def box_classes(spark: SparkSession, d: str) -> DataFrame:
    """Small wide trucks are cars; which boxes could be a plate in a crop of their own height, by shape, place and confidence."""
    own = _pixels(spark, d)
    share, aspect = F.col("wide") * F.col("high") / (1280.0 * 720), F.col("wide") / F.col("high")
    plate = boxes.plate_candidate(F.col("wide"), F.col("high"), F.col("step"), F.col("high"), F.col("confidence"))
    return own.select("id", boxes.small_truck_is_car(boxes.canonical_class(F.col("class")), share, aspect, F.col("high")).alias("class"), plate.alias("may_be_plate"))
