"""Queries over organisations, projects, members, links, audit rows and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelflow.functions import codes as C, text as X
from parcelflow.operators import limits as M, tenancy as T
from parcelflow.operators.grouped import pick_row, previous_value
from parcelflow.plans.registry import query

NOW = "2000-01-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def _scope_sql(member: str) -> str:
    return f"""
WITH u AS (SELECT user_id, bool_or(platform_role IN ('platform_admin', 'operator')) AS platform FROM memberships GROUP BY 1),
v AS (SELECT DISTINCT m.user_id, p.project_id, p.status FROM memberships m JOIN projects p ON p.organization_id = m.organization_id WHERE {member})
SELECT u.user_id, platform, CASE WHEN platform THEN (SELECT count(*) FROM projects) ELSE (SELECT count(*) FROM v WHERE v.user_id = u.user_id) END AS projects,
  CASE WHEN platform THEN (SELECT count(*) FROM projects WHERE status = 'published') ELSE (SELECT count(*) FROM v WHERE v.user_id = u.user_id AND status = 'published') END AS published FROM u"""


def _project_measures():
    return {"projects": F.lit(1), "published": (F.col("status") == "published").cast("int")}


@query("access_scope", _scope_sql("true"))
def _(t):
    return T.visible_per_user(t.projects, t.memberships, _project_measures())


@query("manage_scope", _scope_sql("m.role = 'client_admin'"))
def _(t):
    return T.visible_per_user(t.projects, t.memberships, _project_measures(), role="client_admin")


def _rows_sql(member: str) -> str:
    return f"""
WITH u AS (SELECT user_id, bool_or(platform_role IN ('platform_admin', 'operator')) AS platform FROM memberships WHERE user_id IN (2, 3, 11) GROUP BY 1)
SELECT user_id, project_id, status FROM u, projects p
WHERE platform OR EXISTS (SELECT 1 FROM memberships m WHERE m.user_id = u.user_id AND m.organization_id = p.organization_id AND {member})"""


def _scoped_rows(t, role=None):
    """The projects that a member, an organisation's admin and a platform user see."""
    def of(user):
        mine = t.memberships.where(F.col("user_id") == user)
        return T.rows_for_user(t.projects, mine, role).select(F.lit(user).cast("bigint").alias("user_id"), "project_id", "status")

    return of(2).unionByName(of(3)).unionByName(of(11))


@query("access_scope_rows", _rows_sql("true"))
def _(t):
    return _scoped_rows(t)


@query("manage_scope_rows", _rows_sql("m.role = 'client_admin'"))
def _(t):
    return _scoped_rows(t, "client_admin")


def api_keys(t):
    s = t.raw("supplier")
    scopes = F.when(F.col("s_suppkey") % 3 == 0, '["units:read"]').when(F.col("s_suppkey") % 3 == 1, '["webhooks:write","units:read"]').otherwise('["webhooks:write"]')
    return s.select(
        F.col("s_suppkey").alias("key_id"), F.col("s_nationkey").cast("bigint").alias("organization_id"),
        (F.col("s_suppkey") % 17).alias("created_by_user_id"), scopes.alias("scopes_json"),
        F.when(F.col("s_suppkey") % 5 == 0, now()).alias("revoked_at"),
        F.when(F.col("s_suppkey") % 4 == 0, now() + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("s_acctbal") - 4000).cast("decimal(18,6)"))).alias("expires_at"))


KEYS_SQL = f"""keys AS (SELECT s_suppkey AS key_id, cast(s_nationkey AS bigint) AS organization_id, s_suppkey % 17 AS created_by_user_id,
  CASE s_suppkey % 3 WHEN 0 THEN ['units:read'] WHEN 1 THEN ['webhooks:write', 'units:read'] ELSE ['webhooks:write'] END AS scopes, s_suppkey % 5 = 0 AS revoked,
  s_suppkey % 4 = 0 AND s_acctbal <= 4000 AS expired FROM supplier)"""


def admins(t):
    return t.memberships.select("user_id", (F.col("user_id") % 4 != 3).alias("active"),
                                F.when(F.col("user_id") % 2 == 0, "platform_admin").otherwise(F.col("platform_role")).alias("platform_role"))


ADMIN_SQL = "admins AS (SELECT user_id, user_id % 4 <> 3 AND (user_id % 2 = 0 OR platform_role = 'platform_admin') AS ok FROM memberships)"


@query("api_key_effective", f"""
WITH {KEYS_SQL}, {ADMIN_SQL}
SELECT key_id, NOT revoked AND NOT expired AND coalesce(o.active, false) AND coalesce(a.ok, false) AND list_contains(scopes, 'units:read') AS effective
FROM keys k LEFT JOIN organizations o USING (organization_id) LEFT JOIN admins a ON a.user_id = created_by_user_id""")
def _(t):
    return T.effective_keys(api_keys(t), t.organizations, admins(t), "units:read", now()).select("key_id", "effective")


@query("project_publicly_visible", """
SELECT project_id, name FROM projects p WHERE status = 'published' AND access_mode = 'public' AND EXISTS (SELECT 1 FROM versions v WHERE v.project_id = p.project_id AND is_published)""")
def _(t):
    return T.publicly_visible(t.projects, t.versions).select("project_id", "name")


@query("join_members_orgs", """
SELECT m.user_id, o.organization_id, o.name AS organization, o.active, m.role FROM memberships m JOIN organizations o USING (organization_id)""")
def _(t):
    return t.memberships.join(t.organizations, "organization_id").select("user_id", "organization_id", F.col("name").alias("organization"), "active", "role")


@query("join_audit_actor", """
SELECT event_id, action, a.actor_user_id, coalesce(c_name, 'Sistema') AS actor FROM audit_events a LEFT JOIN customer ON c_custkey = a.actor_user_id""")
def _(t):
    users = t.raw("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return T.audit_with_actor(t.audit_events, users).select("event_id", "action", "actor_user_id", "actor")


@query("agg_org_rollup", """
SELECT organization_id, name, (SELECT count(*) FROM projects p WHERE p.organization_id = o.organization_id) AS project_count,
  (SELECT count(*) FROM memberships m WHERE m.organization_id = o.organization_id) AS contact_count FROM organizations o""")
def _(t):
    return T.organization_rollup(t.organizations, t.projects, t.memberships).select("organization_id", "name", "project_count", "contact_count")


@query("agg_dashboard_metrics", """
WITH p AS (SELECT pr.*, (SELECT count(*) FROM jobs j WHERE j.project_id = pr.project_id AND j.status = 'failed') AS failed FROM projects pr),
u AS (SELECT user_id, bool_or(platform_role IN ('platform_admin', 'operator')) AS platform FROM memberships GROUP BY 1),
v AS (SELECT DISTINCT u.user_id, platform, p.project_id, p.status, p.failed FROM u JOIN p ON platform OR p.organization_id IN (SELECT organization_id FROM memberships m WHERE m.user_id = u.user_id))
SELECT u.user_id, u.platform, count(project_id) AS projects, count(*) FILTER (v.status = 'review') AS in_review, count(*) FILTER (v.status = 'published') AS published,
  cast(coalesce(sum(failed), 0) AS bigint) AS failed_jobs, CASE WHEN u.platform THEN (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') ELSE 0 END AS pending_proposals
FROM u LEFT JOIN v ON v.user_id = u.user_id GROUP BY u.user_id, u.platform""")
def _(t):
    failed = t.jobs.where("status = 'failed'").groupBy("project_id").agg(F.count("*").alias("failed"))
    projects = t.projects.join(failed, "project_id", "left")
    is_status = lambda s: (F.col("status") == s).cast("int")
    seen = T.visible_per_user(projects, t.memberships, {
        "projects": F.lit(1), "in_review": is_status("review"), "published": is_status("published"), "failed_jobs": F.coalesce("failed", F.lit(0))})
    pending = t.raw("orders").where("o_orderstatus = 'P'").agg(F.count("*")).scalar()
    return seen.withColumn("pending_proposals", F.when(F.col("platform"), pending).otherwise(F.lit(0)).cast("bigint"))


@query("agg_link_access", """
SELECT user_id AS link_id, count(*) AS access_count, max(ts) AS last_used_at FROM events WHERE event_type = 'view' GROUP BY 1""")
def _(t):
    views = t.raw("events").where("event_type = 'view'")
    return views.groupBy(F.col("user_id").alias("link_id")).agg(F.count("*").alias("access_count"), F.max("ts").alias("last_used_at"))


@query("win_latest_version", """
SELECT project_id, max_by(version_id, (created_at, version_id)) AS version_id, max_by(version_id, (created_at, version_id)) FILTER (is_published) AS published_version_id FROM versions GROUP BY 1""")
def _(t):
    v = t.versions
    order = F.struct("created_at", "version_id")
    return v.groupBy("project_id").agg(F.max_by("version_id", order).alias("version_id"),
                                       F.max_by("version_id", F.when(F.col("is_published"), order)).alias("published_version_id"))


@query("win_latest_asset_job", """
WITH a AS (SELECT o_custkey AS project_id, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS asset_id FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1),
j AS (SELECT project_id, max_by(job_id, (created_at, job_id)) AS job_id, max_by(status, (created_at, job_id)) AS job_status FROM jobs GROUP BY 1)
SELECT project_id, asset_id, job_id, job_status FROM j FULL JOIN a USING (project_id)""")
def _(t):
    assets = t.raw("orders").where("o_orderpriority <> '5-LOW'").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("asset_id"), F.col("o_orderdate").alias("created_at"))
    a = T.latest_by(assets, "project_id", "created_at", "asset_id").select("project_id", "asset_id")
    j = T.latest_by(t.jobs, "project_id", "created_at", "job_id").select("project_id", "job_id", F.col("status").alias("job_status"))
    return j.join(a, "project_id", "full")


@query("win_project_workspace", """
WITH v AS (SELECT project_id, max_by(version_id, (created_at, version_id)) AS version_id, max(created_at) AS v_at, max_by(quality, (created_at, version_id)) AS q, count(*) AS n FROM versions GROUP BY 1),
j AS (SELECT project_id, max_by(job_id, (created_at, job_id)) AS job_id, max_by(status, (created_at, job_id)) AS st, max(created_at) AS j_at FROM jobs WHERE job_id % 5 < 3 GROUP BY 1),
s AS (SELECT DISTINCT o_custkey AS project_id FROM orders WHERE o_orderpriority = '1-URGENT'),
k AS (SELECT project_id, bool_or(has_password) AS pw FROM share_links WHERE active GROUP BY 1),
w AS (SELECT p.*, o.name AS client, v.*, j.job_id, j.st, coalesce(j.job_id IS NOT NULL AND (v.version_id IS NULL OR j_at >= v_at), false) AS cur, s.project_id IS NOT NULL AS has_source, coalesce(pw, false) AS pw
  FROM projects p LEFT JOIN organizations o USING (organization_id) LEFT JOIN v ON v.project_id = p.project_id LEFT JOIN j ON j.project_id = p.project_id LEFT JOIN s ON s.project_id = p.project_id LEFT JOIN k ON k.project_id = p.project_id)
SELECT project_id, client, cast(coalesce(version_id % 50, 0) AS int) AS lots, CASE WHEN q IN ('light', 'balanced', 'high') THEN q ELSE 'balanced' END AS quality,
  CASE WHEN cur AND st IN ('queued', 'running') THEN 'processing' WHEN cur AND st = 'failed' THEN 'failed' WHEN version_id IS NOT NULL THEN 'processed' WHEN has_source THEN 'ready' ELSE 'empty' END AS processing_status,
  cast(CASE WHEN cur THEN job_id % 100 WHEN version_id IS NOT NULL THEN 100 ELSE 0 END AS int) AS processing_progress,
  CASE WHEN access_mode IN ('link', 'token') THEN CASE WHEN pw THEN 'password' ELSE 'unlisted' END ELSE access_mode END AS visibility, pw AS password_enabled, coalesce(n, 0) AS version_count FROM w""")
def _(t):
    versions = t.versions.withColumn("lot_count", (F.col("version_id") % 50).cast("int"))
    jobs = t.jobs.where("job_id % 5 < 3").withColumn("progress", (F.col("job_id") % 100).cast("int"))
    sources = t.raw("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("asset_id"),
                                                                       F.lit("planta.pdf").alias("original_name"), F.col("o_orderdate").alias("created_at"))
    w = T.workspace(t.projects, t.organizations, versions, t.share_links, sources, jobs)
    return w.select("project_id", "client", "lots", "quality", "processing_status", "processing_progress", "visibility", "password_enabled", "version_count")


@query("win_published_switch", """
WITH a AS (SELECT o_custkey AS project_id, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS pub FROM orders WHERE o_totalprice > 400000 GROUP BY 1)
SELECT version_id, v.project_id, CASE WHEN pub IS NULL THEN is_published ELSE version_id = pub END AS is_published FROM versions v LEFT JOIN a ON a.project_id = v.project_id""")
def _(t):
    actions = t.raw("orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("version_id"), F.col("o_orderdate").alias("at"))
    return T.published_switch(t.versions, actions).select("version_id", "project_id", "is_published")


@query("win_link_resolution", f"""
WITH tgt AS (SELECT project_id, max_by(link_id, (created_at, link_id)) AS target FROM share_links WHERE active GROUP BY 1),
rev AS (SELECT DISTINCT l_orderkey AS link_id FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1)
SELECT l.link_id, CASE WHEN NOT active AND target IS NOT NULL AND rev.link_id IS NULL THEN 'redirect' WHEN NOT active THEN 'revoked' WHEN expires_at <= TIMESTAMP '{NOW}' THEN 'expired' ELSE 'ok' END AS state,
  CASE WHEN NOT active AND rev.link_id IS NULL THEN target END AS target_link_id
FROM share_links l LEFT JOIN tgt ON tgt.project_id = l.project_id LEFT JOIN rev ON rev.link_id = l.link_id""")
def _(t):
    revoked = t.raw("lineitem").where("l_returnflag = 'R' AND l_linenumber = 1").select(F.col("l_orderkey").alias("link_id"))
    return T.resolve_links(t.share_links, revoked, now()).select("link_id", "state", "target_link_id")


@query("win_fixed_minute_budget", """
WITH f AS (SELECT seq, key_id, TIMESTAMP '2024-01-01 00:00:00' + to_microseconds(cast(epoch_us(ts) / 60 AS bigint) - cast(epoch_us(TIMESTAMP '2024-01-01 00:00:00') / 60 AS bigint)) AS mts FROM key_requests),
r AS (SELECT *, row_number() OVER (PARTITION BY key_id, date_trunc('minute', mts) ORDER BY seq) AS rn FROM f)
SELECT seq, rn <= 2 AS allowed, cast(CASE WHEN rn > 2 THEN greatest(1, 60 - cast(extract(second FROM mts) AS int)) END AS int) AS retry_after FROM r""")
def _(t):
    # The log is slowed to one request in a few minutes; at 60 times the pace the budget bites.
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    start = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    fast = (F.round(us / 60).cast("bigint") - F.round(start / 60).cast("bigint")) + start
    requests = t.key_requests.select("seq", "key_id", F.timestamp_micros(fast).cast("timestamp_ntz").alias("ts"))
    return M.minute_budget(requests, 2).select("seq", "allowed", "retry_after")


@query("win_sliding_failures", """
WITH f AS (SELECT event_id, user_id % 3 AS scope, epoch_us(ts) // 20 AS us FROM events WHERE event_type = 'error'),
c AS (SELECT event_id, us, count(*) OVER w AS failures, min(us) OVER w AS oldest FROM f WINDOW w AS (PARTITION BY scope ORDER BY us RANGE BETWEEN 899999999 PRECEDING AND CURRENT ROW))
SELECT event_id, failures, failures >= 8 AS blocked, cast(CASE WHEN failures >= 8 THEN greatest(1, ceil((oldest + 900000000 - us) / 1000000.0)) END AS bigint) AS retry_after FROM c""")
def _(t):
    us = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 20)
    f = t.raw("events").where("event_type = 'error'").select("event_id", (F.col("user_id") % 3).alias("scope"), F.timestamp_micros(us).cast("timestamp_ntz").alias("ts"))
    return M.sliding_failures(f, ["scope"]).select("event_id", "failures", "blocked", "retry_after")


@query("win_idempotent_uploads", """
WITH f AS (SELECT api_key_id, project_id, idem_key, min(seq) AS s0, arg_min(request_hash, seq) AS h0, arg_min_null(job_id, seq) AS j0 FROM upload_requests GROUP BY 1, 2, 3),
c AS (SELECT seq, CASE WHEN seq = s0 THEN 'first' WHEN request_hash <> h0 THEN 'conflict' WHEN j0 IS NULL THEN 'pending' ELSE 'replay' END AS outcome, j0 FROM upload_requests JOIN f USING (api_key_id, project_id, idem_key))
SELECT seq, outcome, CASE WHEN outcome = 'replay' THEN j0 END AS replayed_job_id FROM c""")
def _(t):
    return M.classify_uploads(t.upload_requests).select("seq", "outcome", "replayed_job_id")


@query("top_recent_projects", """
SELECT o_custkey AS project_id, max(o_orderdate) AS updated_at FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 8""")
def _(t):
    updated = t.raw("orders").groupBy(F.col("o_custkey").alias("project_id")).agg(F.max("o_orderdate").alias("updated_at"))
    return updated.orderBy(F.col("updated_at").desc(), F.col("project_id").desc()).limit(8)


@query("top_audit_feed", """
SELECT event_id, created_at, action, actor_user_id FROM audit_events ORDER BY created_at DESC, event_id DESC LIMIT 200""")
def _(t):
    return t.audit_events.orderBy(F.col("created_at").desc(), F.col("event_id").desc()).limit(200).select("event_id", "created_at", "action", "actor_user_id")


@query("page_offset", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (SELECT count(*) FROM lineitem) AS total, CASE WHEN 150 < (SELECT count(*) FROM lineitem) THEN 150::bigint END AS next_offset
FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate LIMIT 50 OFFSET 100""")
def _(t):
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")]
    return T.offset_page(t.raw("lineitem"), order, 50, 100).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "total", "next_offset")


@query("page_keyset", """
WITH p AS (SELECT event_id, project_id, event_type FROM integration_events WHERE event_id > 120 ORDER BY 1 LIMIT 50)
SELECT *, (SELECT count(*) FROM integration_events WHERE event_id > 120) > 50 AS has_more, (SELECT max(event_id) FROM p) AS next_cursor FROM p""")
def _(t):
    return T.keyset_page(t.integration_events.select("event_id", "project_id", "event_type"), "event_id", 120, 50)


@query("proposal_queue", """
SELECT o_orderkey AS proposal_id, o_custkey AS project_id, CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'accepted' ELSE 'rejected' END AS status,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL 1 DAY END AS decided_at, base_version_id
FROM orders LEFT JOIN (SELECT project_id, max_by(version_id, (created_at, version_id)) AS base_version_id FROM versions WHERE is_published GROUP BY 1) b ON b.project_id = o_custkey""")
def _(t):
    from parcelflow.operators.proposals import decide, with_base_version
    o = t.raw("orders")
    proposals = o.select(F.col("o_orderkey").alias("proposal_id"), F.col("o_custkey").alias("project_id"), F.lit("pending").alias("status"),
                         F.lit(None).cast("timestamp_ntz").alias("decided_at"), F.lit(None).cast("string").alias("review_notes"))
    decisions = o.where("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("proposal_id"), F.when(F.col("o_orderstatus") == "F", "accepted").otherwise("rejected").alias("decision"),
        F.lit(None).cast("string").alias("notes"), (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("at"))
    return with_base_version(decide(proposals, decisions), t.versions).select("proposal_id", "project_id", "status", "decided_at", "base_version_id")


@query("slug_assign", """
WITH b AS (SELECT p_partkey AS id, trim(regexp_replace(lower(strip_accents(p_name || ' ' || p_type)), '[^a-z0-9]+', '-', 'g'), '-') AS base FROM part),
r AS (SELECT id, base, row_number() OVER (PARTITION BY base ORDER BY id) AS rn FROM b WHERE length(base) >= 3)
SELECT id, CASE WHEN rn = 1 THEN base ELSE base || '-' || rn END AS slug FROM r""")
def _(t):
    from parcelflow.operators.proposals import assign_slugs
    p = t.raw("part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("name"))
    taken = p.limit(0).select(F.lit("").alias("slug"))
    return assign_slugs(p, taken)
