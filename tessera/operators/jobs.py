"""Training jobs: their life as a fold of a log through a table of legal steps, and reports of runs merged by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The legal steps of a job, (state, event, new state). A job begins without a state.
STEPS = [
    ("", "created", "QUEUED"),
    ("QUEUED", "claimed", "RUNNING"),
    ("PAUSED_GPU", "claimed", "RUNNING"),
    ("RUNNING", "progress", "RUNNING"),
    ("RUNNING", "evaluating", "EVALUATING"),
    ("RUNNING", "paused", "PAUSED_GPU"),
    ("EVALUATING", "paused", "PAUSED_GPU"),
    ("RUNNING", "completed", "SUCCEEDED"),
    ("EVALUATING", "completed", "SUCCEEDED"),
    ("RUNNING", "failed", "FAILED"),
    ("EVALUATING", "failed", "FAILED"),
    ("FAILED", "retried", "QUEUED"),
]
REPORT = "outcome string, reason string, artifactPath string, artifactSha256 string, accepted boolean"
BROKEN = "Training artifact integrity check failed"


def _next(state: Column, event: Column) -> Column:
    """The state after an event; null where the step is not legal."""
    steps = F.create_map(*[F.lit(x) for s, e, n in STEPS for x in (f"{s} {e}", n)])
    return F.try_element_at(steps, F.concat_ws(" ", state, event))


def told(log: DataFrame, epochs: int = 60) -> DataFrame:
    """The log (job_id, at, event, epoch) with `state` after each event, `current_epoch`, and `refused` for events that are not
    legal in the job's state, which change nothing. Events of one time are in the order of their names.

    A progress event moves the epoch within 0 and `epochs`; completion and evaluation set it to the end, a retry keeps
    it. One job's log (some hundred events) is one array, folded in the JVM.
    """
    event = F.struct("at", "event", F.coalesce("epoch", F.lit(0)).alias("epoch"))
    jobs = log.groupBy("job_id").agg(F.sort_array(F.collect_list(event)).alias("events"))
    row = "array<struct<at: timestamp, event: string, state: string, current_epoch: int, refused: boolean>>"
    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("epoch"), F.array().cast(row).alias("rows"))

    def step(have: Column, e: Column) -> Column:
        after = _next(have["state"], e["event"])
        state = F.coalesce(after, have["state"])
        moved = F.when(after.isNull(), have["epoch"]).when(e["event"] == "progress", F.greatest(F.lit(0), F.least(F.lit(epochs), e["epoch"]))).when(e["event"].isin("evaluating", "completed"), F.lit(epochs)).otherwise(have["epoch"])
        done = F.struct(e["at"].cast("timestamp").alias("at"), e["event"].alias("event"), state.alias("state"), moved.cast("int").alias("current_epoch"), after.isNull().alias("refused"))
        return F.struct(state.alias("state"), moved.cast("int").alias("epoch"), F.concat(have["rows"], F.array(done)).alias("rows"))

    folded = jobs.select("job_id", F.aggregate("events", start, step, lambda have: have["rows"]).alias("rows"))
    return folded.select("job_id", F.explode("rows").alias("r")).select("job_id", "r.*")


def states(log: DataFrame, epochs: int = 60) -> DataFrame:
    """Each job's state and epoch at the end of its log, and how many events were refused."""
    last = F.max_by(F.struct("state", "current_epoch"), F.struct("at", "event"))
    return told(log, epochs).groupBy("job_id").agg(last.alias("s"), F.count_if("refused").alias("refused")).select("job_id", "s.*", "refused")


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """job_id and the report of each file `<uuid>.json`; files of other names and texts that are no JSON are left out."""
    rows = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^([0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})\.json$", 1).alias("job_id"), F.from_json("value", REPORT).alias("r"))
    return rows.where((F.col("job_id") != "") & F.col("r.outcome").isNotNull()).select("job_id", "r.*")


def reconciled(jobs: DataFrame, reports: DataFrame, artifacts: DataFrame, epochs: int = 60) -> tuple[DataFrame, DataFrame]:
    """Jobs (job_id, status, current_epoch, reason, has_version) after their reports, and the versions that these make.

    Only jobs that run, evaluate or pause and have no version yet take a report. A paused one gives its reason. A completed
    one must name an artifact whose stored hash (artifacts: path, sha256) is the one it tells, or the job fails; then
    there is a version, a candidate if the run was accepted. Other outcomes change nothing. Reports are one for each job.
    """
    stored = artifacts.select(F.col("path").alias("artifactPath"), F.col("sha256").alias("__stored"))
    own = reports.join(stored, "artifactPath", "left").withColumnRenamed("reason", "__reason")
    joined = jobs.join(own, "job_id", "left")
    open_ = F.col("status").isin("RUNNING", "EVALUATING", "PAUSED_GPU") & ~F.col("has_version")
    whole = F.coalesce(F.col("artifactSha256").rlike("^[0-9a-f]{64}$") & (F.col("artifactSha256") == F.col("__stored")), F.lit(False))
    verdict = F.when(open_ & (F.col("outcome") == "paused"), "PAUSED_GPU").when(open_ & (F.col("outcome") == "completed"), F.when(whole, "SUCCEEDED").otherwise("FAILED"))
    joined = joined.withColumn("__new", verdict)
    done = F.col("__new") == "SUCCEEDED"
    reason = F.when(F.col("__new") == "PAUSED_GPU", F.substring(F.coalesce("__reason", F.lit("")), 1, 200)).when(F.col("__new") == "FAILED", BROKEN).when(F.col("__new").isNull(), F.col("reason"))
    changed = joined.withColumns({"reason": reason, "status": F.coalesce("__new", "status"), "current_epoch": F.when(done, epochs).otherwise(F.col("current_epoch")), "has_version": F.col("has_version") | F.coalesce(done, F.lit(False))})
    versions = joined.where(done).select("job_id", F.concat(F.lit("custom-"), F.substring(F.col("job_id").cast("string"), 1, 8)).alias("version_key"), F.when(F.col("accepted"), "CANDIDATE").otherwise("REJECTED").alias("status"), "artifactPath", "artifactSha256")
    return changed.select(jobs.columns), versions


def may_start(jobs: DataFrame) -> DataFrame:
    """Whether a new job may begin: none runs or evaluates."""
    return jobs.agg(F.count_if(F.col("status").isin("RUNNING", "EVALUATING")).alias("active")).withColumn("may_start", F.col("active") == 0)


def with_dataset(jobs: DataFrame, datasets: DataFrame, versions: DataFrame) -> DataFrame:
    """Jobs with their dataset and, if they have one, version."""
    d = datasets.select("dataset_id", F.struct(*[c for c in datasets.columns]).alias("dataset"))
    v = versions.select("job_id", F.struct(*[c for c in versions.columns if c != "job_id"]).alias("version"))
    return jobs.join(d, "dataset_id").join(v, "job_id", "left")


def used(versions: DataFrame, version_id: int) -> DataFrame:
    """Puts a candidate or inactive, evaluated version to use: the active one becomes inactive. Another one is refused: nothing changes."""
    fit = versions.where((F.col("id") == version_id) & F.col("status").isin("CANDIDATE", "INACTIVE") & F.col("evaluated_at").isNotNull())
    ok = fit.agg(F.count("*").alias("n")).scalar() > 0
    new = F.when(F.col("id") == version_id, "ACTIVE").when(F.col("status") == "ACTIVE", "INACTIVE").otherwise(F.col("status"))
    return versions.withColumn("status", F.when(ok, new).otherwise(F.col("status")))
