"""Queries over availability requests, events, the outbox and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelflow.functions import codes as C, text as X
from parcelflow.operators import availability as A, jobs as J, lots as L, outbox as O
from parcelflow.plans.q_lots import PATCH_SQL, STATUS_SQL, batch_patches, status_lots
from parcelflow.plans.q_tenancy import ADMIN_SQL, KEYS_SQL, admins, api_keys, now
from parcelflow.plans.registry import query

CLAIM_AT = "2000-06-01 00:00:00"


def claim_at():
    return F.lit(CLAIM_AT).cast("timestamp_ntz")


def change_requests(t):
    r = A.with_system(t.availability_requests, t.stock_units)
    digest = A.request_digest(F.col("unit_id"), F.col("status"), F.col("expected_revision"), F.col("request_event_id"), F.col("source"), F.lit(None).cast("string"))
    return r.select("seq", "project_id", "unit_id", "system", F.col("request_event_id").alias("event_id"), "status",
                    "expected_revision", digest.alias("digest"))


DIGEST_SQL = """sha256('["' || unit_id || '","' || status || '",' || expected_revision || ',"' || request_event_id || '","' || source || '",null]')"""


@query("availability_digest", f"SELECT seq, {DIGEST_SQL} AS digest FROM availability_requests")
def _(t):
    return change_requests(t).select("seq", "digest")


# The oracle walks every project's requests one by one and carries the unit revisions and the
# accepted event ids as maps.
WALK_SQL = f"""req AS MATERIALIZED (SELECT r.project_id, seq, r.unit_id, coalesce(external_system, source) || '/' || request_event_id AS ident, expected_revision AS expected, {DIGEST_SQL.replace("unit_id", "r.unit_id").replace("status", "r.status")} AS digest,
    row_number() OVER (PARTITION BY r.project_id ORDER BY seq) AS n FROM availability_requests r JOIN stock_units u ON u.unit_id = r.unit_id),
walk AS (
  SELECT project_id, 0::bigint AS n, 0::bigint AS seq, 'none' AS outcome, 0::bigint AS rev, MAP{{}}::MAP(bigint, bigint) AS revs, MAP{{}}::MAP(varchar, varchar) AS seen, MAP{{}}::MAP(varchar, bigint) AS given FROM (SELECT DISTINCT project_id FROM req)
  UNION ALL
  SELECT project_id, n, seq, outcome, CASE WHEN outcome = 'applied' THEN cur + 1 WHEN outcome = 'replayed' THEN given[ident] END,
    CASE WHEN outcome = 'applied' THEN map_concat(revs, MAP{{unit_id: cur + 1}}) ELSE revs END,
    CASE WHEN outcome = 'applied' THEN map_concat(seen, MAP{{ident: digest}}) ELSE seen END,
    CASE WHEN outcome = 'applied' THEN map_concat(given, MAP{{ident: cur + 1}}) ELSE given END
  FROM (SELECT *, CASE WHEN old IS NOT NULL THEN CASE WHEN old = digest THEN 'replayed' ELSE 'conflict' END WHEN expected = cur THEN 'applied' ELSE 'stale' END AS outcome
    FROM (SELECT r.*, w.revs, w.seen, w.given, coalesce(w.revs[r.unit_id], 0) AS cur, w.seen[r.ident] AS old FROM walk w JOIN req r ON r.project_id = w.project_id AND r.n = w.n + 1)))"""


def applied_changes(t):
    done = A.apply_requests(change_requests(t), t.stock_units)
    return done.where("outcome = 'applied'").select("seq", "unit_id", "event_id", "status", "revision")


@query("availability_apply", f"WITH RECURSIVE {WALK_SQL} SELECT seq, project_id, outcome, rev AS revision FROM walk WHERE n > 0")
def _(t):
    return A.apply_requests(change_requests(t), t.stock_units).select("seq", "project_id", "outcome", "revision")


CHANGED_SQL = """changed AS (SELECT w.seq, w.rev, r.unit_id, r.request_event_id, r.status, r.source, r.ts FROM walk w JOIN availability_requests r ON r.seq = w.seq WHERE w.n > 0 AND w.outcome = 'applied')"""


@query("availability_events", f"""
WITH RECURSIVE {WALK_SQL}, {CHANGED_SQL},
before AS (SELECT c.*, u.external_system, u.external_unit_id, coalesce(lag(c.status) OVER (PARTITION BY c.unit_id ORDER BY c.rev), u.status) AS previous FROM changed c JOIN stock_units u ON u.unit_id = c.unit_id)
SELECT seq, previous AS previous_status, '{{"event_id":"' || request_event_id || '","unit_id":"' || unit_id || '","external_system":' || coalesce('"' || external_system || '"', 'null') ||
  ',"external_unit_id":' || coalesce('"' || external_unit_id || '"', 'null') || ',"previous_status":"' || previous || '","new_status":"' || status || '","revision":' || rev ||
  ',"source":"' || source || '","timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z"}}' AS payload_json FROM before""")
def _(t):
    """One event per applied change, with the unit's status before it."""
    events = A.with_previous_status(applied_changes(t), t.stock_units).join(t.availability_requests.select("seq", "source", "ts"), "seq")
    return A.event_payload(events.withColumn("unit_id", F.col("unit_id").cast("string"))).select("seq", "previous_status", "payload_json")


@query("availability_lots", f"""
WITH RECURSIVE {WALK_SQL}, {CHANGED_SQL},
now AS (SELECT c.unit_id, u.project_id, arg_max(c.status, c.rev) AS status FROM changed c JOIN stock_units u ON u.unit_id = c.unit_id GROUP BY 1, 2)
SELECT lot_id, l.project_id, coalesce((SELECT n.status FROM unit_lots k JOIN now n ON n.unit_id = k.unit_id WHERE k.lot_id = l.lot_id AND n.project_id = l.project_id), {STATUS_SQL}) AS status FROM lots l""")
def _(t):
    """The lots after all changes: each link of a changed unit takes its status."""
    return A.lots_after(status_lots(t), t.unit_lots, t.stock_units, applied_changes(t)).select("lot_id", "project_id", "status")


@query("availability_lot_edits", f"""
WITH RECURSIVE {PATCH_SQL},
edit AS (SELECT batch_id, h.lot_id, h.project_id, CASE batch_id % 4 WHEN 0 THEN 'sold' WHEN 1 THEN 'reserved' WHEN 2 THEN 'available' ELSE 'sold' END AS status, {STATUS_SQL} AS lot_status
  FROM hit h JOIN gate USING (batch_id) WHERE applied),
named AS (SELECT e.*, CASE WHEN k.unit_id IS NULL THEN 'lot-' || e.lot_id WHEN u.project_id = e.project_id THEN cast(k.unit_id AS varchar) END AS unit, coalesce(u.status, lot_status) AS start
  FROM edit e LEFT JOIN unit_lots k ON k.lot_id = e.lot_id LEFT JOIN stock_units u ON u.unit_id = k.unit_id),
seen AS (SELECT *, CASE WHEN unit IS NOT NULL THEN coalesce(lag(status) OVER (PARTITION BY unit ORDER BY batch_id, lot_id), start) END AS previous_status FROM named),
told AS (SELECT *, coalesce(previous_status <> status, false) AS changed FROM seen)
SELECT batch_id, lot_id, unit, previous_status, status, changed, CASE WHEN changed THEN cast(count(*) FILTER (changed) OVER (PARTITION BY unit ORDER BY batch_id, lot_id) AS bigint) END AS revision FROM told""")
def _(t):
    """Batch patches with a status, made through the units: changes and revisions, nothing where the unit has that status."""
    status = F.element_at(F.array(*map(F.lit, ("sold", "reserved", "available", "sold"))), (F.col("batch_id") % 4 + 1).cast("int"))
    patched = L.batch_patch(status_lots(t), batch_patches(t).withColumn("status", status)).where("applied")
    done = A.lot_edits(patched.select("batch_id", "lot_id", "status"), status_lots(t), t.unit_lots, t.stock_units, ["batch_id", "lot_id"])
    return done.select("batch_id", "lot_id", "unit", "previous_status", "status", "changed", "revision")


@query("lot_status_change_noop", """
SELECT seq, previous_status, status, previous_status <> status AS changed FROM (
  SELECT seq, status, coalesce(lag(status) OVER (PARTITION BY unit_id ORDER BY seq), 'available') AS previous_status FROM availability_requests)""")
def _(t):
    return A.internal_changes(t.availability_requests.select("seq", "unit_id", "status")).select("seq", "previous_status", "status", "changed")


@query("availability_event_payload", """
SELECT seq, '{"event_id":"' || request_event_id || '","unit_id":"' || unit_id || '","previous_status":"available","new_status":"' || status || '","revision":' || (expected_revision + 1) ||
  ',"source":"' || source || '","timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z"}' AS payload_json FROM availability_requests""")
def _(t):
    r = t.availability_requests.select("seq", F.col("request_event_id").alias("event_id"), F.col("unit_id").cast("string"), "status", "source", "ts",
                                       F.lit("available").alias("previous_status"), (F.col("expected_revision") + 1).alias("revision"))
    return A.event_payload(r).select("seq", "payload_json")


@query("unit_current_state", """
SELECT unit_id, arg_max(status, seq) AS status, max(seq) AS revision FROM availability_requests GROUP BY 1""")
def _(t):
    return A.unit_state(t.availability_requests.select("unit_id", "status", F.col("seq").alias("revision")))


@query("agg_job_lifecycle", """
SELECT job_id, (SELECT max(l."at") FROM job_logs l WHERE l.job_id = j.job_id) AS last_log,
  greatest(created_at, started_at, (SELECT max(l."at") FROM job_logs l WHERE l.job_id = j.job_id)) AS last_seen FROM jobs j""")
def _(t):
    return J.job_lifecycle(t.jobs, t.job_logs).select("job_id", "last_log", "last_seen")


@query("stalled_jobs", """
WITH c AS (SELECT TIMESTAMP '2000-01-01 00:00:00' - INTERVAL 1200 SECOND AS cutoff),
s AS (SELECT j.*, (SELECT max(l."at") FROM job_logs l WHERE l.job_id = j.job_id) AS last_log FROM jobs j WHERE status IN ('running', 'queued'))
SELECT job_id, status AS old_status, 'failed' AS status, true AS can_retry, greatest(created_at, started_at, last_log) AS last_seen FROM s, c
WHERE created_at < cutoff AND greatest(created_at, started_at, last_log) < cutoff""")
def _(t):
    return J.stalled_jobs(t.jobs, t.job_logs, now()).select("job_id", "old_status", "status", "can_retry", "last_seen")


@query("job_transitions", """
WITH r AS (SELECT o_orderkey AS job_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'claim' WHEN '2-HIGH' THEN 'cancel_external' WHEN '5-LOW' THEN 'retry' ELSE 'cancel' END AS action FROM orders)
SELECT job_id, action, status, CASE WHEN action = 'claim' AND status = 'queued' THEN 'running' WHEN action = 'cancel_external' AND status = 'queued' THEN 'cancelled'
  WHEN action = 'cancel' AND status IN ('queued', 'running') THEN 'cancelled' WHEN action = 'retry' AND status IN ('failed', 'cancelled') THEN 'queued' ELSE status END AS new_status,
  NOT ((action = 'claim' AND status = 'queued') OR (action = 'cancel_external' AND status = 'queued') OR (action = 'cancel' AND status IN ('queued', 'running')) OR (action = 'retry' AND status IN ('failed', 'cancelled'))) AS conflict
FROM r JOIN jobs USING (job_id)""")
def _(t):
    p = F.col("o_orderpriority")
    action = F.when(p == "1-URGENT", "claim").when(p == "2-HIGH", "cancel_external").when(p == "5-LOW", "retry").otherwise("cancel")
    requests = t.raw("orders").select(F.col("o_orderkey").alias("job_id"), action.alias("action"))
    return J.apply_transitions(t.jobs, requests).select("job_id", "action", "status", "new_status", "conflict")


def owned_subscriptions(t):
    s = t.subscriptions
    org = (F.col("webhook_id") * 3 + F.col("project_id")) % 25
    return s.select("webhook_id", "project_id", "active", "event_types_json", F.when(F.col("webhook_id") % 5 == 4, org).otherwise(F.col("project_id")).alias("organization_id"),
                    F.when(F.col("webhook_id") % 2 == 0, F.col("webhook_id")).alias("api_key_id"), F.when(F.col("webhook_id") % 2 == 1, (F.col("webhook_id") * 7) % 100).alias("owner_user_id"))


def subscription_validity(t):
    """The key of a subscription lives in the subscription's own organisation or another one."""
    projects = t.organizations.select(F.col("organization_id").alias("project_id"), "organization_id")
    keys = api_keys(t).withColumn("project_id", F.when(F.col("key_id") % 8 == 0, F.col("organization_id")))
    return O.owner_valid(owned_subscriptions(t), t.organizations, projects, keys, admins(t), now())


OWNER_SQL = f"""{KEYS_SQL}, {ADMIN_SQL},
subs AS (SELECT webhook_id, project_id, active, event_types_json, CASE WHEN webhook_id % 5 = 4 THEN (webhook_id * 3 + project_id) % 25 ELSE project_id END AS organization_id,
  CASE WHEN webhook_id % 2 = 0 THEN webhook_id END AS api_key_id, CASE WHEN webhook_id % 2 = 1 THEN (webhook_id * 7) % 100 END AS owner_user_id FROM subscriptions),
owned AS (SELECT s.*, coalesce(o.active AND s.organization_id = s.project_id AND coalesce(a.ok, false)
    AND (api_key_id IS NULL OR (k.key_id IS NOT NULL AND NOT k.revoked AND NOT k.expired AND k.organization_id = s.organization_id AND list_contains(k.scopes, 'webhooks:write'))), false) AS valid
  FROM subs s LEFT JOIN organizations o ON o.organization_id = s.organization_id LEFT JOIN keys k ON k.key_id = s.api_key_id
  LEFT JOIN admins a ON a.user_id = CASE WHEN api_key_id IS NULL THEN owner_user_id ELSE k.created_by_user_id END)"""


@query("join_subscription_owner", f"WITH {OWNER_SQL} SELECT webhook_id, valid FROM owned")
def _(t):
    return subscription_validity(t).select("webhook_id", "valid")


FAN_SQL = """fan AS (SELECT DISTINCT webhook_id, e.event_id FROM (SELECT *, CASE WHEN webhook_id % 5 = 4 THEN (webhook_id * 3 + project_id) % 25 ELSE project_id END AS organization_id FROM subscriptions) s
  JOIN integration_events e ON e.project_id = s.project_id AND e.organization_id = s.organization_id AND contains(event_types_json, '"' || e.event_type || '"'))"""


@query("join_cross_fanout", f"WITH {FAN_SQL} SELECT * FROM fan")
def _(t):
    return O.fan_out(owned_subscriptions(t), t.integration_events).select("webhook_id", "event_id")


@query("join_event_outbox_anti", f"WITH {FAN_SQL} SELECT * FROM fan f WHERE NOT EXISTS (SELECT 1 FROM deliveries d WHERE d.webhook_id = f.webhook_id AND d.event_id = f.event_id)")
def _(t):
    return O.pending_pairs(owned_subscriptions(t), t.integration_events, t.deliveries).select("webhook_id", "event_id")


@query("top_n_per_subscription", f"""
WITH {FAN_SQL} SELECT webhook_id, event_id, rn FROM (SELECT *, cast(row_number() OVER (PARTITION BY webhook_id ORDER BY event_id) AS int) AS rn FROM fan f
  WHERE NOT EXISTS (SELECT 1 FROM deliveries d WHERE d.webhook_id = f.webhook_id AND d.event_id = f.event_id)) WHERE rn <= 200""")
def _(t):
    return O.first_pending(owned_subscriptions(t), t.integration_events, t.deliveries, O.MATERIALIZE_LIMIT).select("webhook_id", "event_id", "rn")


@query("outbox_materialize", f"""
WITH {FAN_SQL}, {OWNER_SQL}
SELECT webhook_id, event_id FROM (SELECT f.*, row_number() OVER (PARTITION BY webhook_id ORDER BY event_id) AS rn FROM fan f JOIN owned o USING (webhook_id)
  WHERE o.active AND o.valid AND NOT EXISTS (SELECT 1 FROM deliveries d WHERE d.webhook_id = f.webhook_id AND d.event_id = f.event_id)) WHERE rn <= 200""")
def _(t):
    return O.materialize(subscription_validity(t), t.integration_events, t.deliveries)


ELIGIBLE_SQL = f"(status = 'pending' OR (status = 'sending' AND lease_until <= TIMESTAMP '{CLAIM_AT}'))"


@query("top_claimable", f"""
SELECT delivery_id, next_attempt_at FROM deliveries WHERE {ELIGIBLE_SQL} AND attempts < 8 AND next_attempt_at <= TIMESTAMP '{CLAIM_AT}' ORDER BY next_attempt_at, delivery_id LIMIT 100""")
def _(t):
    due = t.deliveries.where(O.eligible(claim_at()) & (F.col("attempts") < O.MAX_ATTEMPTS) & (F.col("next_attempt_at") <= claim_at()))
    return due.orderBy("next_attempt_at", "delivery_id").limit(O.CLAIM_LIMIT).select("delivery_id", "next_attempt_at")


@query("outbox_claim", f"""
WITH due AS (SELECT delivery_id, attempts FROM deliveries WHERE {ELIGIBLE_SQL} AND attempts < 8 AND next_attempt_at <= TIMESTAMP '{CLAIM_AT}' ORDER BY next_attempt_at, delivery_id LIMIT 100)
SELECT delivery_id, 'sending' AS status, cast(attempts + 1 AS int) AS attempts, TIMESTAMP '{CLAIM_AT}' + INTERVAL 60 SECOND AS lease_until, sha256(delivery_id || ':' || attempts || ':20000601000000') AS lease_token FROM due
UNION ALL SELECT delivery_id, 'failed', attempts, NULL, NULL FROM deliveries WHERE {ELIGIBLE_SQL} AND attempts >= 8""")
def _(t):
    return O.claim(t.deliveries, claim_at()).select("delivery_id", "status", F.col("attempts").cast("int").alias("attempts"), "lease_until", "lease_token")


@query("outbox_settle", f"""
WITH r AS (SELECT delivery_id, attempts, delivery_id % 4 AS k, CASE delivery_id % 4 WHEN 0 THEN 204 WHEN 1 THEN 503 WHEN 2 THEN 302 END AS code FROM deliveries WHERE status = 'sending' AND delivery_id % 5 <> 0)
SELECT delivery_id, CASE WHEN k = 0 THEN 'succeeded' WHEN attempts >= 8 THEN 'failed' ELSE 'pending' END AS status, cast(code AS int) AS last_http_status,
  TIMESTAMP '{CLAIM_AT}' + to_seconds(least(3600, cast(5 * pow(2, greatest(attempts - 1, 0)) AS bigint))) AS next_attempt_at FROM r""")
def _(t):
    token = F.concat(F.lit("t"), F.col("delivery_id").cast("string"))
    held = t.deliveries.withColumns({"lease_token": token, "last_http_status": F.lit(None).cast("int"), "last_error": F.lit(None).cast("string")})
    code = F.when(F.col("delivery_id") % 4 == 0, 204).when(F.col("delivery_id") % 4 == 1, 503).when(F.col("delivery_id") % 4 == 2, 302)
    stale = F.when(F.col("delivery_id") % 5 == 0, "old").otherwise(token)
    results = t.deliveries.select("delivery_id", stale.alias("lease_token"), code.cast("int").alias("http_status"))
    return O.settle(held, results, claim_at()).select("delivery_id", "status", "last_http_status", "next_attempt_at")


@query("outbox_envelope", r"""
WITH b AS (SELECT event_id, unhex(sha256('secret' || project_id) || repeat('00', 32))::BIT AS k, '{"id":' || event_id || ',"type":"' || event_type || '","organization_id":' || project_id || ',"project_id":' || project_id || ',"created_at":"' ||
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z","data":' || regexp_replace(props, '\s+', '', 'g') || '}' AS body FROM (SELECT *, user_id % 25 AS project_id FROM events))
SELECT event_id, body, 'v1=' || sha256(xor(k, unhex(repeat('5c', 64))::BIT)::BLOB || unhex(sha256(xor(k, unhex(repeat('36', 64))::BIT)::BLOB || encode('1767225600.' || body)))) AS signature FROM b""")
def _(t):
    e = t.raw("events").select("event_id", "event_type", (F.col("user_id") % 25).alias("organization_id"), (F.col("user_id") % 25).alias("project_id"),
                               F.col("ts").alias("created_at"), F.col("props").alias("payload_json"))
    key = F.sha2(F.concat(F.lit("secret"), F.col("project_id").cast("string")), 256)
    return O.envelope(e, key, F.lit("1767225600")).select("event_id", "body", "signature")


@query("outbox_signature")
def _(t):
    e = t.raw("events").select("event_id", "event_type", (F.col("user_id") % 25).alias("organization_id"), (F.col("user_id") % 25).alias("project_id"),
                               F.col("ts").alias("created_at"), F.col("props").alias("payload_json"))
    key = F.sha2(F.concat(F.lit("secret"), F.col("project_id").cast("string")), 256)
    return O.envelope(e, key, F.lit("1767225600")).select("event_id", "signature")


@query("outbox_requeue", f"""
SELECT delivery_id, 'pending' AS status, cast(CASE WHEN status = 'succeeded' THEN 0 ELSE attempts END AS int) AS attempts, CASE WHEN status = 'succeeded' THEN TIMESTAMP '{CLAIM_AT}' ELSE next_attempt_at END AS next_attempt_at
FROM deliveries WHERE status IN ('succeeded', 'pending') UNION ALL SELECT delivery_id, status, attempts, next_attempt_at FROM deliveries WHERE status = 'sending'""")
def _(t):
    # The given deliveries hold no failed ones; the finished ones stand in for them.
    d = t.deliveries.withColumn("status", F.when(F.col("status") == "succeeded", "failed").otherwise(F.col("status")))
    return O.requeue(d, claim_at()).select("delivery_id", "status", "attempts", "next_attempt_at")


@query("agg_delivery_stats", """
SELECT webhook_id, status, count(*) AS deliveries, cast(sum(count(*)) OVER (PARTITION BY webhook_id) AS bigint) AS total FROM deliveries GROUP BY 1, 2""")
def _(t):
    per = t.deliveries.groupBy("webhook_id", "status").agg(F.count("*").alias("deliveries"))
    total = per.groupBy("webhook_id").agg(F.sum("deliveries").alias("total"))
    return per.join(total, "webhook_id")
