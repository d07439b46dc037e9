"""Queries of jobs, exports and message lists, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import events, export, jobs, messages
from tessera.plans.domain import ctes, view
from tessera.plans.registry import query

_STEPS = ", steps AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{e}', '{n}')" for s, e, n in jobs.STEPS) + ") t(state, event, new_state))"
_FOLD = _STEPS + """, numbered AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY "at", event) AS n FROM job_log),
fold AS (SELECT DISTINCT job_id, 0::BIGINT AS n, '' AS state, 0 AS current_epoch, NULL::VARCHAR AS event, NULL::TIMESTAMP AS "at", false AS refused FROM job_log
  UNION ALL
  SELECT f.job_id, l.n, coalesce(s.new_state, f.state), CASE WHEN s.new_state IS NULL THEN f.current_epoch WHEN l.event = 'progress' THEN greatest(0, least(60, l.epoch)) WHEN l.event IN ('evaluating', 'completed') THEN 60 ELSE f.current_epoch END, l.event, l."at", s.new_state IS NULL
  FROM fold f JOIN numbered l ON l.job_id = f.job_id AND l.n = f.n + 1 LEFT JOIN steps s ON s.state = f.state AND s.event = l.event)"""


@query(ctes("job_log").replace("WITH", "WITH RECURSIVE", 1) + _FOLD + """ SELECT job_id, max_by(state, n) AS state, max_by(current_epoch, n) AS current_epoch, count(*) FILTER (WHERE refused) AS refused FROM fold WHERE n > 0 GROUP BY job_id""")
def job_states(spark: SparkSession, d: str) -> DataFrame:
    return jobs.states(view(spark, d, "job_log"))


@query(ctes("job_log").replace("WITH", "WITH RECURSIVE", 1) + _FOLD + ' SELECT job_id, "at", event, state FROM fold WHERE refused')
def refused_job_events(spark: SparkSession, d: str) -> DataFrame:
    return jobs.told(view(spark, d, "job_log")).where("refused").select("job_id", "at", "event", "state")


_REPORTS = """, merged AS (SELECT j.*, r.outcome, r.artifactSha256, r.accepted, r.artifactPath, r.reason AS told, coalesce(regexp_matches(r.artifactSha256, '^[0-9a-f]{64}$') AND r.artifactSha256 = a.sha256, false) AS whole,
  j.status IN ('RUNNING', 'EVALUATING', 'PAUSED_GPU') AND NOT has_version AS open FROM run_jobs j LEFT JOIN run_reports r USING (job_id) LEFT JOIN run_artifacts a ON a.path = r.artifactPath),
judged AS (SELECT *, CASE WHEN open AND outcome = 'paused' THEN 'PAUSED_GPU' WHEN open AND outcome = 'completed' THEN CASE WHEN whole THEN 'SUCCEEDED' ELSE 'FAILED' END END AS new FROM merged)"""


def _reconciled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return jobs.reconciled(view(spark, d, "run_jobs"), view(spark, d, "run_reports"), view(spark, d, "run_artifacts"))


@query(ctes("run_jobs", "run_reports", "run_artifacts") + _REPORTS + """ SELECT job_id, coalesce(new, status) AS status, CASE WHEN new = 'SUCCEEDED' THEN 60 ELSE current_epoch END AS current_epoch,
CASE new WHEN 'PAUSED_GPU' THEN coalesce(told, '') WHEN 'FAILED' THEN 'Training artifact integrity check failed' WHEN 'SUCCEEDED' THEN NULL ELSE reason END AS reason, has_version OR coalesce(new = 'SUCCEEDED', false) AS has_version FROM judged""")
def reconciled_jobs(spark: SparkSession, d: str) -> DataFrame:
    return _reconciled(spark, d)[0]


@query(ctes("run_jobs", "run_reports", "run_artifacts") + _REPORTS + """ SELECT job_id, 'custom-' || job_id AS version_key, CASE WHEN accepted THEN 'CANDIDATE' ELSE 'REJECTED' END AS status, artifactPath, artifactSha256 FROM judged WHERE new = 'SUCCEEDED'""")
def reconciled_versions(spark: SparkSession, d: str) -> DataFrame:
    return _reconciled(spark, d)[1]


@query(ctes("run_jobs") + " SELECT count(*) FILTER (WHERE status IN ('RUNNING', 'EVALUATING')) AS active, count(*) FILTER (WHERE status IN ('RUNNING', 'EVALUATING')) = 0 AS may_start FROM run_jobs")
def job_may_start(spark: SparkSession, d: str) -> DataFrame:
    return jobs.may_start(view(spark, d, "run_jobs"))


@query(ctes("run_jobs") + """, sets AS (SELECT DISTINCT cast(job_id % 50 as bigint) AS dataset_id FROM run_jobs), versions AS (SELECT job_id, 'v' || job_id AS key FROM run_jobs WHERE has_version)
SELECT j.job_id, concat('set-', s.dataset_id) AS dataset, v.key AS version FROM run_jobs j JOIN sets s ON s.dataset_id = j.job_id % 50 LEFT JOIN versions v ON v.job_id = j.job_id""")
def jobs_with_dataset(spark: SparkSession, d: str) -> DataFrame:
    have = view(spark, d, "run_jobs").withColumn("dataset_id", F.col("job_id") % 50)
    sets = have.select("dataset_id").distinct().withColumn("name", F.concat(F.lit("set-"), "dataset_id"))
    versions = have.where("has_version").select("job_id", F.concat(F.lit("v"), "job_id").alias("key"))
    return jobs.with_dataset(have, sets, versions).select("job_id", F.col("dataset.name").alias("dataset"), F.col("version.key").alias("version"))


@query(ctes("samples") + """, usable AS (SELECT *, CASE cast(substr(source_id, 8) AS int) % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split FROM samples WHERE source_id IS NOT NULL),
names AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS k FROM (SELECT DISTINCT label FROM usable) x),
lines AS (SELECT u.*, cast(id AS varchar) AS key, printf('%d %.6f %.6f %.6f %.6f', k, x + w / 2, y + h / 2, w, h) AS line FROM usable u JOIN names n USING (label)),
files AS (SELECT split, count(*) AS n, min(key) AS one, string_agg(key, '|' ORDER BY key) AS ids, string_agg(line, chr(10) ORDER BY key) || chr(10) AS text FROM lines GROUP BY source_id, media_kind, frame_ms, split)
SELECT split, CASE WHEN n = 1 THEN one ELSE 'source-' || substr(sha256(ids), 1, 20) END AS stem, text FROM files""")
def dataset_label_files(spark: SparkSession, d: str) -> DataFrame:
    return export.label_files(_split_samples(spark, d))


def _split_samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples with a source, a fifth of the sources in test and in val."""
    fifth = F.substring("source_id", 8, 9).cast("int") % 5
    split = F.when(fifth == 0, "test").when(fifth == 1, "val").otherwise("train")
    return view(spark, d, "samples").where("source_id IS NOT NULL").withColumns({"split": split, "source": F.col("source_id")})


@query(ctes("samples") + """, u AS (SELECT *, cast(substr(source_id, 8) AS int) % 5 AS k FROM samples WHERE source_id IS NOT NULL)
SELECT count(*) AS samples, count(DISTINCT source_id) AS sources, count(*) FILTER (WHERE k > 1) AS train, count(*) FILTER (WHERE k = 1) AS val, count(*) FILTER (WHERE k = 0) AS test, (SELECT string_agg(label, '|' ORDER BY label) FROM (SELECT DISTINCT label FROM u) x) AS labels FROM u""")
def dataset_summary(spark: SparkSession, d: str) -> DataFrame:
    return export.summary(_split_samples(spark, d)).withColumn("labels", F.array_join("labels", "|"))


@query(ctes("gate_events", "vehicles") + """, keyed AS (SELECT *, translate(upper(trim(license_plate)), ' -.', '') AS key FROM gate_events),
known AS (SELECT translate(upper(trim(plate_number)), ' -.', '') AS key FROM vehicles WHERE id % 4 <> 0)
SELECT min_by(upper(trim(license_plate)), (epoch_us(ts), id)) AS plate_number, 'STRANGER' AS status, min(ts) AS seen_at FROM keyed WHERE key NOT IN (SELECT key FROM known) GROUP BY key""")
def auto_registered_plates(spark: SparkSession, d: str) -> DataFrame:
    """Plates at the gate, every second one written otherwise, that a registry without every fourth vehicle does not hold."""
    told = view(spark, d, "gate_events").withColumn("license_plate", F.when(F.col("id") % 2 == 0, F.lower("license_plate")).otherwise(F.col("license_plate")))
    return events.auto_registered(told, view(spark, d, "vehicles").where("id % 4 <> 0"))


@query(ctes("area_messages") + """, first AS (SELECT id, min("at") AS "at", min_by(label, "at") AS label, arg_min_null(duration_seconds, "at") AS d, arg_min_null(clip, "at") AS c FROM area_messages WHERE action = 'STARTED' GROUP BY id),
ends AS (SELECT f.id, count(*) AS n, arg_max_null(m.duration_seconds, m."at") AS d, max_by(m.clip, m."at") FILTER (WHERE m.clip IS NOT NULL) AS c FROM first f JOIN area_messages m ON m.id = f.id AND m.action <> 'STARTED' AND m."at" >= f."at" GROUP BY f.id)
SELECT f.id, f."at", f.label, CASE WHEN e.n > 0 THEN e.d ELSE f.d END AS duration_seconds, coalesce(e.c, f.c) AS clip, coalesce(e.n, 0) > 0 AS ended FROM first f LEFT JOIN ends e ON e.id = f.id""")
def area_event_list(spark: SparkSession, d: str) -> DataFrame:
    return messages.event_list(view(spark, d, "area_messages"))


@query(ctes("vehicles", "gate_events") + """, known AS (SELECT plate_number AS plate, min_by(id, id) % 4 AS visits, min_by(status, id) AS status FROM vehicles WHERE id % 3 <> 0 GROUP BY plate_number),
seen AS (SELECT license_plate AS plate, count(*) AS more, arg_min(status, ts) AS first FROM gate_events GROUP BY license_plate)
SELECT coalesce(k.plate, s.plate) AS plate, cast(CASE WHEN k.plate IS NOT NULL THEN coalesce(nullif(visits, 0), 1) ELSE 0 END + coalesce(more, 0) AS bigint) AS visits, coalesce(k.status, s.first) AS status FROM known k FULL JOIN seen s ON s.plate = k.plate""")
def plate_visits(spark: SparkSession, d: str) -> DataFrame:
    known = view(spark, d, "vehicles").where("id % 3 <> 0").groupBy(F.col("plate_number").alias("plate")).agg((F.min("id") % 4).alias("visits"), F.min_by("status", "id").alias("status"))
    return messages.visits(known, view(spark, d, "gate_events").select(F.col("license_plate").alias("plate"), "status", F.col("ts").alias("at")))


@query(ctes("file_reads") + """, gaps AS (SELECT *, (epoch_us("at") - lag(epoch_us("at")) OVER w) / 1e6::double AS gap FROM file_reads WINDOW w AS (PARTITION BY camera_id ORDER BY "at")),
skips AS (SELECT *, cast(CASE WHEN gap <= 0.4 THEN least(3, greatest(0, floor(gap * 25 - 1))) ELSE 0 END AS int) AS skipped FROM gaps)
SELECT camera_id, "at", skipped, cast(sum(skipped + 1) OVER (PARTITION BY camera_id ORDER BY "at") - 1 AS bigint) AS position FROM skips""")
def paced_reads(spark: SparkSession, d: str) -> DataFrame:
    return messages.paced(view(spark, d, "file_reads"), 25, 8).select("camera_id", "at", "skipped", "position")
