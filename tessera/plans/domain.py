"""Site-event views over the star-schema tables, in SQL that Spark and DuckDB both read.

The tables hold no camera data, so every view is derived from them by integer arithmetic; the operators see only the
views. `view(spark, dir, name)` gives a DataFrame, `ctes(names)` the same views for an oracle's WITH clause.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _plate(key: str) -> str:
    return f"concat(lpad(cast(15 + {key} % 84 as string), 2, '0'), chr(cast(65 + {key} % 26 as int)), '-', lpad(cast({key} * 7919 % 100000 as string), 5, '0'))"


# Label names by base class.
LABELS = [
    ("container", "Container"),
    ("truck", "Xe tải"),
    ("forklift", "Xe nâng"),
    ("forklift", "Xe cẩu"),
    ("personnel_carrier", "Xe chở người"),
    ("car", "Xe con"),
    ("motorcycle", "Xe máy"),
    ("bicycle", "Xe đạp"),
    ("person", "Người"),
]

# Zones (id, camera, name, rule, labels, corners).
ZONES = [
    (0, "BAI-KIEM", "Zone cấm PT cá nhân", "PROHIBIT_SPECIFIED", ["Xe máy", "Xe đạp", "Xe con", "Người"], [(0.06, 0.30), (0.34, 0.28), (0.36, 0.60), (0.04, 0.66)]),
    (1, "BAI-KIEM", "Zone làn di chuyển", "ALLOW_SPECIFIED", ["Container", "Xe nâng", "Xe tải"], [(0.38, 0.42), (0.52, 0.42), (0.46, 0.94), (0.08, 0.94)]),
    (2, "BAI-KIEM", "Zone bãi kiểm", "ALLOW_SPECIFIED", ["Container", "Xe nâng", "Xe tải"], [(0.54, 0.52), (0.88, 0.58), (0.92, 0.90), (0.48, 0.92)]),
    (3, "GATE-01", "Làn IN 1", "ALLOW_SPECIFIED", ["Container", "Xe tải"], [(0.36, 0.54), (0.50, 0.54), (0.42, 0.95), (0.10, 0.95)]),
    (4, "GATE-01", "Làn IN 2", "ALLOW_SPECIFIED", ["Container", "Xe tải"], [(0.52, 0.54), (0.66, 0.54), (0.95, 0.95), (0.47, 0.95)]),
]

_CLASS = "CASE event_type WHEN 'view' THEN 'motorcycle' WHEN 'click' THEN 'truck' WHEN 'purchase' THEN 'car' WHEN 'signup' THEN 'person' ELSE 'forklift' END"

# name -> (source table or view, SQL with {table})
VIEWS: dict[str, tuple[str, str]] = {
    "gate_events": (
        "events",
        f"""SELECT event_id AS id, 'GATE-01' AS camera_id, CASE WHEN event_type IN ('click', 'view') THEN 'IN_1' ELSE 'IN_2' END AS lane,
          {_plate("user_id")} AS license_plate, CASE user_id % 3 WHEN 0 THEN 'STRANGER' ELSE 'KNOWN' END AS status,
          CASE WHEN event_id % 11 = 0 THEN NULL ELSE cast(event_id * 37 % 1000 as double) / 1000 END AS confidence,
          CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('media/crops/', cast(event_id as string), '.jpg') END AS crop_path,
          cast(ts as timestamp) AS ts, user_id % 6 AS track_id FROM {{table}}""",
    ),
    "vehicles": (
        "customer",
        f"""SELECT c_custkey AS id, {_plate("c_custkey")} AS plate_number,
          CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'KNOWN' ELSE 'STRANGER' END AS status,
          CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END AS note, c_custkey * 31 % 1009 AS updated_rank FROM {{table}}""",
    ),
    "detections": (
        "events",
        f"""SELECT id, frame_no, track_id, class, confidence, px, py, px - half AS x1, py - 2 * half AS y1, px + half AS x2, py AS y2 FROM (
          SELECT event_id AS id, cast(floor(event_id / 4) as bigint) AS frame_no, user_id % 6 AS track_id, {_CLASS} AS class,
            cast(event_id * 53 % 1000 as double) / 1000 AS confidence,
            cast(abs((cast(floor(event_id / 4) as bigint) * 7 + user_id % 6 * 331) % 2000 - 1000) as double) / 1000 AS px,
            cast(abs((cast(floor(event_id / 4) as bigint) * 11 + user_id % 6 * 211) % 2000 - 1000) as double) / 1000 AS py,
            cast(20 + user_id % 6 * 8 as double) / 1000 AS half,
            row_number() OVER (PARTITION BY cast(floor(event_id / 4) as bigint), user_id % 6 ORDER BY event_id) AS n FROM {{table}}) t WHERE n = 1""",
    ),
    "violations": (
        "orders",
        """SELECT o_orderkey AS id, 'BAI-KIEM' AS camera_id, o_custkey % 4 AS zone_id,
          CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Xe máy' WHEN '2' THEN 'Xe con' WHEN '3' THEN 'Xe tải' WHEN '4' THEN 'Người' ELSE 'Xe đạp' END AS object_label,
          CASE WHEN o_orderstatus = 'O' THEN 'OPEN' ELSE 'CLOSED' END AS status, cast(o_orderdate as timestamp) AS entered_at,
          CASE WHEN o_orderstatus = 'O' THEN NULL ELSE cast(o_orderkey % 600 as bigint) END AS duration_seconds,
          CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('media\\clips/area ', cast(o_orderkey as string), '.mp4') END AS clip_path FROM {table}""",
    ),
    "samples": (
        "documents",
        """SELECT doc_id AS id, CASE lang WHEN 'en' THEN 'Container' WHEN 'de' THEN 'Xe tải' WHEN 'fr' THEN 'Xe nâng' ELSE 'Xe con' END AS label,
          CASE lang WHEN 'en' THEN 'container' WHEN 'de' THEN 'truck' WHEN 'fr' THEN 'forklift' ELSE 'car' END AS base_class,
          CASE WHEN doc_id % 37 = 0 THEN NULL ELSE concat('source-', cast(doc_id % 40 as string)) END AS source_id,
          CASE WHEN doc_id % 2 = 0 THEN 'VIDEO' ELSE 'IMAGE' END AS media_kind,
          CASE WHEN doc_id % 2 = 0 AND doc_id % 34 <> 0 THEN doc_id * 40 ELSE NULL END AS frame_ms,
          cast(n_chars % 90 as double) / 100 AS x, cast(n_chars % 80 as double) / 100 AS y, cast(n_chars % 23 as double) / 100 AS w, cast(5 + n_chars % 15 as double) / 100 AS h,
          CASE WHEN doc_id % 41 = 0 THEN NULL ELSE concat('media/', cast(doc_id as string), '.png') END AS media_path FROM {table}""",
    ),
    "ocr_reads": (
        "events",
        """SELECT event_id AS id, user_id AS track_id, cast(event_id * 29 % 1000 as double) / 1000 AS conf,
          CASE event_id % 9 WHEN 0 THEN concat('L', chr(cast(65 + user_id % 26 as int)), 'K', lpad(cast(user_id % 90 + 10 as string), 2, '0'), 'ARD')
            WHEN 1 THEN concat(' 0k', lpad(cast(user_id % 90 + 10 as string), 2, '0'), 'a', 'bc')
            WHEN 2 THEN concat(lpad(cast(15 + user_id % 84 as string), 2, '0'), chr(cast(65 + user_id % 26 as int)), '-', lpad(cast(user_id * 7919 % 100000 as string), 5, '0'))
            WHEN 3 THEN concat(lpad(cast(15 + user_id % 84 as string), 2, '0'), chr(cast(65 + user_id % 26 as int)), '.', lpad(cast(user_id * 71 % 10000 as string), 4, '0'))
            WHEN 4 THEN concat('XA02MN', lpad(cast(user_id % 10000 as string), 4, '0'))
            WHEN 5 THEN concat('02MN', lpad(cast(user_id % 10000 as string), 4, '0'))
            WHEN 6 THEN concat('DL', cast(user_id % 9 + 1 as string), 'HH', lpad(cast(user_id * 3 % 1000 as string), 3, '0'))
            WHEN 7 THEN concat('ab', chr(cast(65 + user_id % 26 as int)), '-', lpad(cast(user_id % 10000 as string), 4, '0'))
            ELSE 'STOP' END AS text FROM {table}""",
    ),
    # A job's log: mostly created, then claimed, then any event, so that some are refused.
    "job_log": (
        "lineitem",
        """SELECT l_orderkey AS job_id, timestamp '2024-01-01 00:00:00' + l_linenumber * interval '1' minute + cast((l_partkey * 1000 + l_suppkey) * 50 + l_quantity as bigint) * interval '1' microsecond AS at, cast(l_quantity * 2 - 10 as int) AS epoch,
          CASE WHEN l_linenumber = 1 AND l_suppkey % 10 <> 0 THEN 'created' WHEN l_linenumber = 2 AND l_suppkey % 7 <> 0 THEN 'claimed' ELSE CASE (l_suppkey + l_linenumber * 5) % 7 WHEN 0 THEN 'progress' WHEN 1 THEN 'paused' WHEN 2 THEN 'claimed'
            WHEN 3 THEN 'evaluating' WHEN 4 THEN 'completed' WHEN 5 THEN 'failed' ELSE 'retried' END END AS event FROM {table}""",
    ),
    "run_jobs": (
        "orders",
        """SELECT o_orderkey AS job_id, CASE o_orderkey % 6 WHEN 0 THEN 'QUEUED' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'PAUSED_GPU' WHEN 3 THEN 'EVALUATING' WHEN 4 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status,
          cast(o_orderkey % 61 as int) AS current_epoch, CASE WHEN o_orderkey % 6 = 4 THEN 'bad' END AS reason, o_orderkey % 5 = 0 AS has_version FROM {table}""",
    ),
    "run_reports": (
        "orders",
        """SELECT o_orderkey AS job_id, CASE o_custkey % 4 WHEN 0 THEN 'paused' WHEN 1 THEN 'crashed' ELSE 'completed' END AS outcome, CASE WHEN o_custkey % 8 = 0 THEN 'LOW_SYSTEM_MEMORY' END AS reason,
          concat('models/', cast(o_orderkey as string), '/best.pt') AS artifactPath, CASE WHEN o_custkey % 11 = 0 THEN 'x' ELSE lpad(cast(o_orderkey as string), 64, '0') END AS artifactSha256, o_custkey % 3 <> 0 AS accepted FROM {table} WHERE o_orderkey % 9 <> 0""",
    ),
    "run_artifacts": (
        "orders",
        "SELECT concat('models/', cast(o_orderkey as string), '/best.pt') AS path, CASE WHEN o_custkey % 13 = 0 THEN 'gone' WHEN o_custkey % 11 = 0 THEN 'x' ELSE lpad(cast(o_orderkey as string), 64, '0') END AS sha256 FROM {table} WHERE o_custkey % 17 <> 0",
    ),
    # Messages of events, among them repeated starts, repeated ends, and ends before a start.
    "area_messages": (
        "lineitem",
        """SELECT l_orderkey AS id, timestamp '2024-01-01 00:00:00' + l_linenumber * interval '1' minute + cast((l_partkey * 1000 + l_suppkey) * 50 + l_quantity as bigint) * interval '1' microsecond AS at, CASE WHEN (l_partkey + l_linenumber) % 3 = 0 THEN 'ENDED' ELSE 'STARTED' END AS action, concat('obj ', cast(l_suppkey as string)) AS label,
          CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE cast(l_quantity as int) END AS duration_seconds, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE concat('clip ', cast(l_partkey as string)) END AS clip FROM {table}""",
    ),
    "file_reads": (
        "events",
        """SELECT event_id AS id, concat('FILE-', cast(cast(floor(event_id / 100) as bigint) % 4 as string)) AS camera_id,
          timestamp '2024-01-01 00:00:00' + cast(event_id * 200 + event_id * 7919 % 190 as bigint) * interval '1' millisecond AS at FROM {table}""",
    ),
    # Detections with classes that the site's labels know by an alias, or not at all.
    "aliased": (
        "events",
        f"""SELECT event_id AS id, CASE event_id % 11 WHEN 0 THEN 'reach stacker' WHEN 1 THEN 'golf cart' WHEN 2 THEN ' Container Handler ' WHEN 3 THEN 'shipping container' WHEN 4 THEN 'bus' WHEN 5 THEN 'alien' WHEN 6 THEN 'utility vehicle' ELSE {_CLASS} END AS class,
          CASE WHEN event_id % 11 = 5 AND event_id % 3 = 0 THEN ' Xe cẩu ' WHEN event_id % 11 = 5 AND event_id % 3 = 1 THEN 'Xe đạp' ELSE '' END AS label, event_id % 13 = 0 AS suppressed_static,
          CASE event_id % 3 WHEN 0 THEN 'ALLOW_SPECIFIED' WHEN 1 THEN 'PROHIBIT_SPECIFIED' ELSE 'OTHER' END AS rule_type FROM {{table}}""",
    ),
    "media_files": (
        "events",
        """SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'clips' ELSE 'crops' END AS folder, event_id % 11 <> 0 AS is_file,
          CASE event_id % 7 WHEN 0 THEN '.gitkeep' ELSE concat(CASE event_id % 7 WHEN 1 THEN 'area_' WHEN 2 THEN 'gate_clip_' WHEN 3 THEN 'gate_crop_' ELSE 'x' END, cast(event_id as string),
            CASE event_id % 5 WHEN 0 THEN '.mp4' WHEN 1 THEN '.jpg' WHEN 2 THEN '.png' WHEN 3 THEN '.webm' ELSE '.txt' END) END AS name FROM {table}""",
    ),
    "site_zones": (
        "supplier",
        """SELECT s_suppkey AS zone_id, concat('CAM-', cast(s_nationkey % 5 as string)) AS camera_id, concat(CASE WHEN s_suppkey % 3 = 0 THEN 'Lane ' ELSE 'Zone ' END, cast(s_suppkey as string)) AS name,
          CASE WHEN s_suppkey % 2 = 0 THEN 'ALLOW_SPECIFIED' ELSE 'PROHIBIT_SPECIFIED' END AS rule_type, s_suppkey % 4 <> 0 AS is_active, s_acctbal AS updated_rank FROM {table}""",
    ),
    "site_labels": (
        "part",
        """SELECT p_partkey AS id, CASE WHEN p_size % 8 = 0 THEN ' Truck' WHEN p_size % 8 = 1 THEN 'forklift' WHEN p_size % 8 = 2 THEN 'car' WHEN p_size % 8 = 3 THEN 'motorcycle' ELSE 'truck' END AS base_class,
          concat(CASE WHEN p_size % 5 = 0 THEN 'Container ' WHEN p_size % 5 = 1 THEN '' ELSE 'Xe ' END, CASE WHEN p_size = 6 THEN 'Xe nâng' ELSE p_brand END) AS name FROM {table}""",
    ),
    # One row for each place where a frame may hold a box: five cameras by turns of 60 frames, four boxes a frame. Boxes move
    # slowly, are missed singly and for some seconds, and change their track's number. Box 3 is the custom model's.
    "sightings": (
        "events",
        """SELECT event_id AS id, concat('CAM-', cast(block % 5 as string)) AS camera_id, frame_no, slot, block, step,
          (event_id * 7919 + block) % 100 >= 30 AND (cast(floor(step / 9) as bigint) + slot + block) % 5 <> 0 AS present,
          CASE WHEN slot = 3 OR event_id % 11 = 0 THEN NULL ELSE slot * 100 + block % 7 * 10 + cast(floor(step / 25) as bigint) END AS track_id,
          CASE slot WHEN 0 THEN 'truck' WHEN 1 THEN 'car' WHEN 2 THEN 'truck' ELSE 'reach stacker' END AS class,
          CASE WHEN slot = 3 THEN 'custom' ELSE 'primary' END AS source, CASE WHEN slot = 3 THEN 'v1' END AS version, slot = 3 AND block % 3 = 0 AS confirmed,
          cast(event_id * 53 % 1000 as double) / 1000 AS confidence,
          60 + slot % 3 * 260 + step * (1 + slot % 3) + CASE WHEN slot = 3 AND block % 2 = 1 THEN 500 ELSE 0 END AS x1,
          80 + slot % 3 * 60 + step * (slot + 2) % 40 AS y1, 120 + slot * 10 AS wide, 90 AS high,
          CASE WHEN (cast(floor(step / 10) as bigint) + slot) % 6 = 0 THEN NULL ELSE concat('z', cast(cast(floor((60 + slot % 3 * 260 + step * (1 + slot % 3)) / 300) as bigint) as string)) END AS zone,
          CASE WHEN slot < 3 AND event_id % 3 = 0 THEN concat(cast(15 + block % 7 as string), 'A-', lpad(cast(slot * 31 + CASE WHEN event_id % 5 = 0 THEN 7 ELSE 0 END + block % 11 as string), CASE WHEN event_id % 13 = 0 THEN 2 ELSE 5 END, '0')) END AS plate
        FROM (SELECT event_id, cast(floor(event_id / 4) as bigint) AS frame_no, event_id % 4 AS slot, cast(floor(event_id / 240) as bigint) AS block, cast(floor(event_id / 4) as bigint) % 60 AS step FROM {table}) t""",
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; `labels` and `zones` are literal tables."""
    if name == "labels":
        return spark.createDataFrame([(k, b, n) for k, (b, n) in enumerate(LABELS)], "id int, base_class string, name string")
    if name == "zones":
        rows = [(z[0], z[1], z[2], z[3], z[4], [{"x": x, "y": y} for x, y in z[5]]) for z in ZONES]
        return spark.createDataFrame(rows, "zone_id int, camera_id string, name string, rule_type string, target_labels array<string>, polygon array<struct<x: double, y: double>>")
    source, sql = VIEWS[name]
    return spark.sql(sql, table=spark.read.parquet(f"{sf_dir}/{source}.parquet"))


def _values(rows: list[tuple]) -> str:
    text = lambda v: str(v) if isinstance(v, int) else f"{v!r}::double" if isinstance(v, float) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)


def ctes(*names: str) -> str:
    """WITH clause for DuckDB; `edges` has a row for each side of a zone, `targets` one for each of its labels."""
    parts = []
    for name in names:
        if name == "labels":
            parts.append(f"labels_seed AS (SELECT * FROM (VALUES {_values([(k, b, n) for k, (b, n) in enumerate(LABELS)])}) t(id, base_class, name))")
        elif name == "zones":
            parts.append(f"zones AS (SELECT * FROM (VALUES {_values([z[:4] for z in ZONES])}) t(zone_id, camera_id, name, rule_type))")
        elif name == "targets":
            parts.append(f"targets AS (SELECT * FROM (VALUES {_values([(z[0], x) for z in ZONES for x in z[4]])}) t(zone_id, label))")
        elif name == "edges":
            rows = [(z[0], *z[5][k], *z[5][(k + 1) % len(z[5])]) for z in ZONES for k in range(len(z[5]))]
            parts.append(f"edges AS (SELECT * FROM (VALUES {_values(rows)}) t(zone_id, ax, ay, cx, cy))")
        else:
            source, sql = VIEWS[name]
            parts.append(f"{name} AS ({sql.format(table=source)})")
    return "WITH " + ",\n".join(parts) + "\n"
