"""Structured Streaming jobs.

Every job writes its results per micro-batch below one folder, in a partition named after the batch
id. A repeated batch overwrites its own partition and reads only earlier ones, so each job is
exactly-once whatever restarts. Keyed state that must see several keys at once (an event id
and a unit) is kept in such tables and joined, which spreads a busy project over the cluster;
a state store would pin it to one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from parcelflow.operators import availability as A, jobs as J, limits as M, outbox as O
from parcelflow.schemas import INPUT_TABLES
from parcelflow.session import cut, merge_join, shared_path

ACCEPTED = "project_id bigint, system string, event_id string, digest string, unit_id bigint, revision bigint, status string, batch bigint"


class BatchTable:
    """A table of rows per micro-batch."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def write(self, rows: DataFrame, batch_id: int) -> None:
        columns = [c.split()[0] for c in self.schema.split(", ")]
        (rows.withColumn("batch", F.lit(batch_id).cast("bigint")).select(*columns).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self.path))

    def start(self) -> "BatchTable":
        """Creates the folder, so that the first batch finds a table to read."""
        self.spark.createDataFrame([], self.schema).drop("batch").write.mode("append").parquet(f"{self.path}/batch=-1")
        return self

    def read(self, before: int | None = None) -> DataFrame:
        rows = self.spark.read.schema(self.schema).parquet(self.path)
        return rows if before is None else rows.where(F.col("batch") < before)

    def latest(self, keys: list[str]) -> DataFrame:
        """Upsert view: the row of the last batch per key."""
        rows = self.read()
        rest = [c for c in rows.columns if c not in keys and c != "batch"]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")


def table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 16) -> DataFrame:
    """A given table as a stream of its files: ``name.parquet``, a file or a folder of part files."""
    return spark.readStream.schema(INPUT_TABLES[name]).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/{name}.parque[t]")  # a pattern, as a stream does not take the path of a single file


def run_to_end(stream: DataFrame, handle, checkpoint: str, mode: str = "append") -> None:
    """Processes what is there in micro-batches and stops."""
    query = (stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


class Job:
    """Folders of one streaming job: outputs beside the query checkpoint."""

    def __init__(self, spark: SparkSession, name: str, root: str | None = None):
        self.spark, self.root = spark, root or shared_path(spark, name)

    def table(self, name: str, schema: str) -> BatchTable:
        return BatchTable(self.spark, f"{self.root}/{name}", schema).start()

    @property
    def checkpoint(self) -> str:
        return f"{self.root}/checkpoint"


class KeyedState:
    """The latest row per key across batches. Every ``every``-th batch also writes a snapshot of all keys, so a batch reads that
    and the changes of less than ``every`` batches, however many came before. A repeated batch reads and writes the same."""

    def __init__(self, job: Job, name: str, schema: str, keys: list[str], every: int = 16):
        self.changes, self.snapshots = job.table(f"{name}-changes", schema), job.table(f"{name}-snapshots", schema)
        self.keys, self.every = keys, every

    def _merged(self, first: int, end: int) -> DataFrame:
        """Of the snapshot of batch ``first - 1`` and the changes of the batches from ``first`` to before ``end``."""
        batch = F.col("batch")
        rows = self.snapshots.read().where(batch == first - 1).unionByName(self.changes.read().where((batch >= first) & (batch < end)))
        rest = [c for c in rows.columns if c not in self.keys and c != "batch"]
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*self.keys, "_r.*")

    def before(self, batch_id: int) -> DataFrame:
        return self._merged(batch_id // self.every * self.every, batch_id)

    def write(self, rows: DataFrame, batch_id: int) -> None:
        self.changes.write(rows, batch_id)
        if (batch_id + 1) % self.every == 0:
            self.snapshots.write(self._merged(batch_id + 1 - self.every, batch_id + 1), batch_id)


def availability(spark: SparkSession, requests: DataFrame, root: str | None = None) -> DataFrame:
    """Revision-checked changes with replay, across micro-batches. ``requests`` as for ``apply_requests``."""
    job = Job(spark, "availability", root)
    accepted = job.table("accepted", ACCEPTED)
    outcomes = job.table("outcomes", "seq bigint, project_id bigint, outcome string, revision bigint, batch bigint")

    def handle(rows: DataFrame, batch_id: int) -> None:
        rows = cut(rows)
        before = accepted.read(batch_id)
        units = merge_join(before, rows.select("unit_id"), "unit_id", "left_semi").groupBy("unit_id").agg(F.max("revision").alias("revision"))
        ident = ["project_id", "system", "event_id"]
        recorded = merge_join(before, rows.select(*ident), ident, "left_semi").select(*ident, "digest", "revision")
        done = cut(A.apply_requests(rows, cut(units), cut(recorded)))
        outcomes.write(done, batch_id)
        accepted.write(done.where("outcome = 'applied'"), batch_id)

    run_to_end(requests, handle, job.checkpoint)
    return outcomes.read().select("seq", "project_id", "outcome", "revision")


def event_dedupe(spark: SparkSession, requests: DataFrame, root: str | None = None) -> DataFrame:
    """One row per (project, system, event id) however often it arrives; no watermark, nothing is forgotten."""
    job = Job(spark, "dedupe", root)
    out = job.table("rows", "project_id bigint, system string, event_id string, batch bigint")
    unique = requests.select("project_id", "system", "event_id").dropDuplicates()
    run_to_end(unique, out.write, job.checkpoint)
    return out.read().drop("batch")


def rate_minute(spark: SparkSession, requests: DataFrame, root: str | None = None) -> DataFrame:
    """Requests per key and minute, however late they come: every batch writes its own counts, the result adds them."""
    job = Job(spark, "rate-minute", root)
    out = job.table("counts", "key_id bigint, minute timestamp_ntz, requests bigint, batch bigint")

    def handle(rows: DataFrame, batch_id: int) -> None:
        minute = F.date_trunc("minute", "ts").cast("timestamp_ntz")
        out.write(rows.groupBy("key_id", minute.alias("minute")).agg(F.count("*").alias("requests")), batch_id)

    run_to_end(requests, handle, job.checkpoint)
    return out.read().groupBy("key_id", "minute").agg(F.sum("requests").alias("requests"))


def rate_sliding(spark: SparkSession, attempts: DataFrame, root: str | None = None, limit: int = M.FAILURE_LIMIT,
                 window: int = M.FAILURE_WINDOW_SECONDS) -> DataFrame:
    """Password attempts ``(key, seq, ts, ok)``: blocked at ``limit`` failures in the window, as ``limits.password_attempts`` has it.

    The failures that still count carry over in a keyed table, of which a batch reads the last snapshot and the few batches since.
    """
    job = Job(spark, "rate-sliding", root)
    state = KeyedState(job, "hits", "key string, hits array<bigint>, batch bigint", ["key"])
    out = job.table("attempts", "key string, seq bigint, blocked boolean, retry_after bigint, batch bigint")

    def handle(rows: DataFrame, batch_id: int) -> None:
        rows = cut(rows)
        carried = cut(state.before(batch_id).join(rows.select("key"), "key", "left_semi"))
        judged, last = M.password_attempts(rows, carried, limit, window)
        out.write(judged, batch_id)
        state.write(last, batch_id)

    run_to_end(attempts, handle, job.checkpoint)
    return out.read().drop("batch")


def last_signs(spark: SparkSession, logs: DataFrame, root: str | None = None) -> DataFrame:
    """Latest log time per job, kept by a streaming aggregate. ``logs(job_id, at)``."""
    job = Job(spark, "last-signs", root)
    out = job.table("last", "job_id bigint, at timestamp_ntz, batch bigint")
    run_to_end(logs.groupBy("job_id").agg(F.max("at").alias("at")), out.write, job.checkpoint, "update")
    return out.latest(["job_id"])


def stalled(spark: SparkSession, logs: DataFrame, jobs: DataFrame, now, root: str | None = None) -> DataFrame:
    """Jobs without a sign of life, judged against the streamed log."""
    return J.stalled_jobs(jobs, last_signs(spark, logs, root), now)


def outbox(spark: SparkSession, events: DataFrame, subscriptions: DataFrame, existing: DataFrame, root: str | None = None) -> DataFrame:
    """Deliveries for every wanted event of the active, valid subscriptions: exactly one per pair.

    The pair itself is the guard: late and low ids are delivered like any other.
    """
    job = Job(spark, "outbox", root)
    out = job.table("deliveries", "webhook_id bigint, event_id bigint, batch bigint")

    def handle(rows: DataFrame, batch_id: int) -> None:
        known = existing.select("webhook_id", "event_id").unionByName(out.read(batch_id).select("webhook_id", "event_id"))
        # There are far more pairs than events: events are told apart before they fan out, and only pairs of ids that come with several keys afterwards.
        events = cut(rows.groupBy("event_id").agg(F.collect_set(F.struct(*O.FAN_KEY)).alias("_keys")))
        once, several = (events.where(size).select("event_id", F.inline("_keys")) for size in ("size(_keys) = 1", "size(_keys) > 1"))
        pairs = O.materialize(subscriptions, once, known, limit=None)
        if not several.isEmpty():
            pairs = pairs.unionByName(O.materialize(subscriptions, several, known, limit=None).dropDuplicates(["webhook_id", "event_id"]))
        out.write(pairs, batch_id)

    run_to_end(events, handle, job.checkpoint)
    return out.read().drop("batch")


def unit_snapshot(spark: SparkSession, changes: DataFrame, root: str | None = None) -> DataFrame:
    """Current status and revision per unit. ``changes(unit_id, status, revision)``."""
    job = Job(spark, "units", root)
    out = job.table("units", "unit_id bigint, status string, revision bigint, batch bigint")
    current = changes.groupBy("unit_id").agg(F.max_by("status", "revision").alias("status"), F.max("revision").alias("revision"))
    run_to_end(current, out.write, job.checkpoint, "update")
    return out.latest(["unit_id"])


def audit_feed(spark: SparkSession, events: DataFrame, root: str | None = None) -> DataFrame:
    """Audit rows per action and hour, however late they come. ``events(action, created_at)``."""
    job = Job(spark, "audit", root)
    out = job.table("hours", "action string, hour timestamp_ntz, events bigint, batch bigint")

    def handle(rows: DataFrame, batch_id: int) -> None:
        hour = F.date_trunc("hour", "created_at").cast("timestamp_ntz")
        out.write(rows.groupBy("action", hour.alias("hour")).agg(F.count("*").alias("events")), batch_id)

    run_to_end(events, handle, job.checkpoint)
    return out.read().groupBy("action", "hour").agg(F.sum("events").alias("events"))
