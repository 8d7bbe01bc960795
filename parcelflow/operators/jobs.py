"""Job lifecycle: signs of life, stalled jobs, legal transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parcelflow.functions.text import json_logs

TIMEOUT_SECONDS = 900
STALE_MARGIN_SECONDS = 300
RECOVERABLE = ("running", "queued")

# Action, status it may start from, status it leads to.
TRANSITIONS = (
    ("claim", "queued", "running"),
    ("cancel_external", "queued", "cancelled"),
    ("cancel", "queued", "cancelled"),
    ("cancel", "running", "cancelled"),
    ("retry", "failed", "queued"),
    ("retry", "cancelled", "queued"),
)


def last_log_at(logs_json: Column) -> Column:
    """Latest readable time of a JSON log column. A zone is dropped, not converted."""
    at = lambda entry: F.regexp_replace(entry["at"], r"(Z|[+-]\d{2}:?\d{2})$", "").try_cast("timestamp_ntz")
    return F.array_max(F.transform(json_logs(logs_json), at))


def job_lifecycle(jobs: DataFrame, logs: DataFrame) -> DataFrame:
    """Latest log and last sign of life per job. ``logs(job_id, at)`` is combined before its shuffle."""
    last = logs.groupBy("job_id").agg(F.max("at").alias("last_log"))
    return jobs.join(last, "job_id", "left").withColumn("last_seen", F.greatest("created_at", "started_at", "last_log"))


def stalled_jobs(jobs: DataFrame, logs: DataFrame, now: Column, limit_seconds: int = TIMEOUT_SECONDS + STALE_MARGIN_SECONDS) -> DataFrame:
    """Recoverable jobs without a sign of life since the cutoff, with their new state.

    The cheap test on ``created_at`` comes first: no later sign of life can precede it.
    """
    cutoff = now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(limit_seconds))
    old = jobs.where(F.col("status").isin(*RECOVERABLE) & (F.col("created_at") < cutoff))
    relevant = logs.join(old.select("job_id"), "job_id", "left_semi")
    silent = job_lifecycle(old, relevant).where(F.col("last_seen") < cutoff)
    return silent.withColumns({
        "old_status": F.col("status"), "status": F.lit("failed"), "can_retry": F.lit(True),
        "finished_at": now, "error_message": F.lit(f"sem sinal de vida por mais de {max(1, limit_seconds // 60)} minutos"),
    })


def stalled_audit(stalled: DataFrame, limit_seconds: int = TIMEOUT_SECONDS + STALE_MARGIN_SECONDS) -> DataFrame:
    """Audit rows of the jobs given up."""
    details = F.to_json(F.struct(F.date_format("last_seen", "yyyy-MM-dd'T'HH:mm:ss").alias("last_sign_of_life"),
                                 F.lit(limit_seconds).alias("cutoff_seconds")))
    return stalled.select(F.lit("processing_job_stalled").alias("action"), F.lit("processing_job").alias("target_type"),
                          F.col("job_id").alias("target_id"), details.alias("details"))


def apply_transitions(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests(job_id, action)`` → new status, or a conflict for an illegal step."""
    spark = jobs.sparkSession
    table = spark.createDataFrame(list(TRANSITIONS), "action string, status string, new_status string")
    joined = requests.join(jobs, "job_id").join(table, ["action", "status"], "left")
    return joined.withColumn("conflict", F.col("new_status").isNull()).withColumn("new_status", F.coalesce("new_status", "status"))
