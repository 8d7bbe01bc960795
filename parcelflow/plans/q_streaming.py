"""The streaming jobs over the event log, run until the given data is processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelflow.operators import availability as A
from parcelflow.plans.q_events import FAN_SQL, OWNER_SQL, subscription_validity
from parcelflow.plans.q_tenancy import now
from parcelflow.plans.registry import ORACLES, query
from parcelflow.session import cut
from parcelflow.streaming import jobs as J


def request_stream(events):
    kind = F.col("event_type")
    status = F.when(kind == "click", "reserved").when(kind == "purchase", "sold").when(kind == "error", "blocked").otherwise("available")
    r = events.select(F.col("event_id").alias("seq"), (F.col("user_id") % 25).alias("project_id"), F.col("user_id").alias("unit_id"),
                      F.when(F.col("value") > 100, "crm").otherwise("erp").alias("system"), F.concat(F.lit("e"), (F.col("event_id") % 700).cast("string")).alias("event_id"),
                      status.alias("status"), (F.col("event_id") % 4).alias("expected_revision"))
    digest = A.request_digest(F.col("unit_id"), F.col("status"), F.col("expected_revision"), F.col("event_id"), F.col("system"), F.lit(None).cast("string"))
    return r.withColumn("digest", digest)


def with_unit_system(requests, units):
    return A.with_system(requests.withColumnRenamed("system", "source"), units).drop("source")


@query("st_availability")
def _(t):
    # the units come from all events; without a table of them each batch would gather them anew
    return J.availability(t.spark, with_unit_system(request_stream(J.table_stream(t.spark, t.folder, "events")), cut(t.stock_units)))


@query("st_event_dedupe", "SELECT DISTINCT project_id, source AS system, request_event_id AS event_id FROM availability_requests")
def _(t):
    return J.event_dedupe(t.spark, request_stream(J.table_stream(t.spark, t.folder, "events")))


@query("st_rate_minute", "SELECT key_id, date_trunc('minute', ts)::timestamp AS minute, count(*) AS requests FROM key_requests GROUP BY 1, 2")
def _(t):
    e = J.table_stream(t.spark, t.folder, "events")
    return J.rate_minute(t.spark, e.select((F.col("user_id") % 5).alias("key_id"), F.col("ts").cast("timestamp").alias("ts")))


@query("st_rate_sliding", """
WITH RECURSIVE a AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, seq) AS i FROM (
    SELECT 'share:' || (user_id % 3) AS key, event_id AS seq, epoch_us(ts) // 20 AS t, event_type = 'purchase' AND event_id % 7 = 0 AS ok FROM events WHERE event_type IN ('error', 'purchase'))),
w AS (
  SELECT DISTINCT key, 0::bigint AS i, NULL::bigint AS seq, false AS blocked, NULL::bigint AS retry_after, []::bigint[] AS hits FROM a
  UNION ALL
  SELECT key, i, seq, len(live) >= 8, CASE WHEN len(live) >= 8 THEN greatest(1, cast(ceil((live[1] + 900000000 - t) / 1000000.0) AS bigint)) END, CASE WHEN len(live) >= 8 THEN live WHEN ok THEN [] ELSE list_append(live, t) END
  FROM (SELECT a.*, [h FOR h IN w.hits IF h > a.t - 900000000] AS live FROM w JOIN a ON a.key = w.key AND a.i = w.i + 1))
SELECT key, seq, blocked, retry_after FROM w WHERE i > 0""")
def _(t):
    e = J.table_stream(t.spark, t.folder, "events").where("event_type IN ('error', 'purchase')")
    fast = F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 20)).cast("timestamp_ntz")
    attempts = e.select(F.concat(F.lit("share:"), (F.col("user_id") % 3).cast("string")).alias("key"), F.col("event_id").alias("seq"), fast.alias("ts"),
                        ((F.col("event_type") == "purchase") & (F.col("event_id") % 7 == 0)).alias("ok"))
    return J.rate_sliding(t.spark, attempts)


@query("st_stalled_jobs")
def _(t):
    logs = J.table_stream(t.spark, t.folder, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), F.col("l_shipdate").alias("at"))
    return J.stalled(t.spark, logs, t.jobs, now()).select("job_id", "old_status", "status", "can_retry", "last_seen")


@query("st_outbox", f"""
WITH {FAN_SQL}, {OWNER_SQL} SELECT f.webhook_id, f.event_id FROM fan f JOIN owned o USING (webhook_id)
WHERE o.active AND o.valid AND NOT EXISTS (SELECT 1 FROM deliveries d WHERE d.webhook_id = f.webhook_id AND d.event_id = f.event_id)""")
def _(t):
    events = J.table_stream(t.spark, t.folder, "events").select("event_id", (F.col("user_id") % 25).alias("project_id"),
        ((F.col("user_id") + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0)) % 25).alias("organization_id"), "event_type", F.col("ts").alias("created_at"))
    return J.outbox(t.spark, events, subscription_validity(t), t.deliveries)


@query("st_unit_snapshot", "SELECT unit_id, arg_max(status, seq) AS status, max(seq) AS revision FROM availability_requests GROUP BY 1")
def _(t):
    changes = request_stream(J.table_stream(t.spark, t.folder, "events")).select("unit_id", "status", F.col("seq").alias("revision"))
    return J.unit_snapshot(t.spark, changes)


@query("st_audit_feed", "SELECT action, date_trunc('hour', created_at)::timestamp AS hour, count(*) AS events FROM audit_events GROUP BY 1, 2")
def _(t):
    kind = F.col("event_type")
    action = (F.when(kind == "purchase", "lot_updated").when(kind == "click", "share_link_created").when(kind == "error", "share_link_revoked")
              .when(kind == "view", "file_uploaded").otherwise("member_added"))
    e = J.table_stream(t.spark, t.folder, "events").select(action.alias("action"), F.col("ts").cast("timestamp").alias("created_at"))
    return J.audit_feed(t.spark, e)


# A stream gives what the batch gives.
ORACLES["st_availability"] = ORACLES["availability_apply"]
ORACLES["st_stalled_jobs"] = ORACLES["stalled_jobs"]
