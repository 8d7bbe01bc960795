"""Row scoping, rollups, dashboards, workspace rows and share links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parcelflow.functions import codes as C
from parcelflow.operators.grouped import pick_row

PLATFORM_ROLES = ("platform_admin", "operator")


def is_platform(role: Column) -> Column:
    return role.isin(*PLATFORM_ROLES)


def rows_for_user(rows: DataFrame, memberships: DataFrame, role: str | None = None, org: str = "organization_id") -> DataFrame:
    """Rows visible to the one user whose ``memberships`` are given: all of them for a platform
    role, else those of the user's organisations (with ``role``, when one is required)."""
    bypass = memberships.agg(F.coalesce(F.bool_or(is_platform(F.col("platform_role"))), F.lit(False))).scalar()
    granted = memberships if role is None else memberships.where(F.col("role") == role)
    orgs = granted.select(F.col("organization_id").alias("_o"))
    scoped = rows.where(~bypass).join(orgs, F.col(org) == F.col("_o"), "left_semi")
    return rows.where(bypass).unionByName(scoped)


def visible_per_user(rows: DataFrame, memberships: DataFrame, measures: dict[str, Column], role: str | None = None) -> DataFrame:
    """``measures`` (sums) over the rows each user sees.

    Rows are first summed per organisation, so a user's total is a join of small tables, and
    platform users take the grand total without being paired with any row.
    """
    names = list(measures)
    per_org = rows.groupBy("organization_id").agg(*[F.sum(m).alias(n) for n, m in measures.items()])
    grand = per_org.agg(F.struct(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]).alias("g"))
    users = memberships.groupBy("user_id").agg(F.bool_or(is_platform(F.col("platform_role"))).alias("platform"))
    granted = memberships if role is None else memberships.where(F.col("role") == role)
    own = granted.select("user_id", "organization_id").distinct().join(per_org, "organization_id").groupBy("user_id").agg(
        *[F.sum(n).alias(n) for n in names])
    joined = users.join(own, "user_id", "left").withColumn("_g", grand.scalar())
    value = lambda n: F.when(F.col("platform"), F.col("_g")[n]).otherwise(F.coalesce(n, F.lit(0))).cast("bigint").alias(n)
    return joined.select("user_id", "platform", *[value(n) for n in names])


def effective_keys(keys: DataFrame, organizations: DataFrame, users: DataFrame, scope: str, now: Column) -> DataFrame:
    """Adds ``effective`` to API keys: live, active organisation, active platform-admin owner, scope held."""
    scopes = F.from_json("scopes_json", "array<string>")
    orgs = organizations.select(F.col("organization_id"), F.col("active").alias("_org_active"))
    owners = users.select(F.col("user_id").alias("created_by_user_id"), (
        F.col("active") & (F.col("platform_role") == "platform_admin")).alias("_owner_ok")).groupBy("created_by_user_id").agg(
        F.bool_or("_owner_ok").alias("_owner_ok"))
    live = F.col("revoked_at").isNull() & ~C.is_expired(F.col("expires_at"), now)
    ok = live & F.col("_org_active") & F.col("_owner_ok") & F.array_contains(scopes, scope)
    return keys.join(orgs, "organization_id", "left").join(owners, "created_by_user_id", "left").withColumn(
        "effective", F.coalesce(ok, F.lit(False))).drop("_org_active", "_owner_ok")


def publicly_visible(projects: DataFrame, versions: DataFrame) -> DataFrame:
    """Published, public projects with a published version."""
    published = versions.where("is_published").select("project_id")
    return projects.where((F.col("status") == "published") & (F.col("access_mode") == "public")).join(
        published, "project_id", "left_semi")


def organization_rollup(organizations: DataFrame, projects: DataFrame, memberships: DataFrame) -> DataFrame:
    """Project and contact counts per organisation, zeros included."""
    p = projects.groupBy("organization_id").agg(F.count("*").alias("project_count"))
    m = memberships.groupBy("organization_id").agg(F.count("*").alias("contact_count"))
    joined = organizations.join(p, "organization_id", "left").join(m, "organization_id", "left")
    return joined.na.fill(0, ["project_count", "contact_count"])


def audit_with_actor(events: DataFrame, users: DataFrame) -> DataFrame:
    """Audit rows with the actor's name; without one the system acted."""
    named = events.join(users.select(F.col("user_id").alias("actor_user_id"), F.col("name").alias("_n")), "actor_user_id", "left")
    return named.withColumn("actor", F.coalesce("_n", F.lit("Sistema"))).drop("_n")


def latest_by(rows: DataFrame, key: str, created: str, row_id: str) -> DataFrame:
    """Latest row per key; equal times fall back to the greater id."""
    return pick_row(rows, [key], F.struct(created, row_id))


def workspace(projects: DataFrame, organizations: DataFrame, versions: DataFrame, links: DataFrame,
              sources: DataFrame, jobs: DataFrame) -> DataFrame:
    """One wide row per project: client, lots, file, quality, processing state, visibility.

    The latest job counts only when no version exists or the job is at least as new as it.
    """
    v = latest_by(versions, "project_id", "created_at", "version_id").select(
        "project_id", "version_id", "lot_count", F.col("quality").alias("_q"), F.col("created_at").alias("_v_at"))
    n = versions.groupBy("project_id").agg(F.count("*").alias("version_count"))
    j = latest_by(jobs, "project_id", "created_at", "job_id").select(
        "project_id", "job_id", F.col("status").alias("_j_status"), F.col("progress").alias("_j_progress"), F.col("created_at").alias("_j_at"))
    s = latest_by(sources, "project_id", "created_at", "asset_id").select("project_id", "asset_id", F.col("original_name").alias("pdf_name"))
    p = links.where("active").groupBy("project_id").agg(F.bool_or("has_password").alias("has_password"))
    o = organizations.select("organization_id", F.col("name").alias("_client"))
    row = projects.join(o, "organization_id", "left")
    for side in (v, n, j, s, p):
        row = row.join(side, "project_id", "left")
    has_version, current = F.col("version_id").isNotNull(), F.col("job_id").isNotNull() & (
        F.col("version_id").isNull() | (F.col("_j_at") >= F.col("_v_at")))
    password = F.coalesce("has_password", F.lit(False))
    busy = F.col("_j_status").isin("queued", "running")
    return row.withColumn("_current", F.coalesce(current, F.lit(False))).select(
        *projects.columns,
        F.coalesce("_client", F.lit("Cliente nao encontrado")).alias("client"),
        F.coalesce("lot_count", F.lit(0)).alias("lots"),
        "pdf_name",
        F.when(F.col("_q").isin("light", "balanced", "high"), F.col("_q")).otherwise("balanced").alias("quality"),
        F.when(F.col("_current") & busy, "processing").when(F.col("_current") & (F.col("_j_status") == "failed"), "failed")
        .when(has_version, "processed").when(F.col("asset_id").isNotNull(), "ready").otherwise("empty").alias("processing_status"),
        F.when(F.col("_current"), F.col("_j_progress")).when(has_version, 100).otherwise(0).alias("processing_progress"),
        C.visibility(F.col("access_mode"), password).alias("visibility"),
        password.alias("password_enabled"),
        F.coalesce("version_count", F.lit(0)).alias("version_count"),
    )


def published_switch(versions: DataFrame, actions: DataFrame) -> DataFrame:
    """Publishing clears the flag of every other version of the project.

    ``actions(project_id, version_id, at)``: the last one decides; projects without an action keep their flags.
    """
    last = actions.groupBy("project_id").agg(F.max_by("version_id", F.struct("at", "version_id")).alias("_pub"))
    joined = versions.join(last, "project_id", "left")
    return joined.withColumn("is_published", F.when(F.col("_pub").isNotNull(), F.col("version_id") == F.col("_pub")).otherwise(
        F.col("is_published"))).drop("_pub")


def resolve_links(links: DataFrame, revocations: DataFrame, now: Column) -> DataFrame:
    """``ok``, ``expired``, ``revoked`` or ``redirect`` to the latest active link of the project.

    ``revocations(link_id)``: an explicit revocation blocks the redirect.
    """
    target = latest_by(links.where("active"), "project_id", "created_at", "link_id").select(
        "project_id", F.col("link_id").alias("_target"))
    revoked = revocations.select("link_id").distinct().withColumn("_revoked", F.lit(True))
    row = links.join(target, "project_id", "left").join(revoked, "link_id", "left")
    redirect = ~F.col("active") & F.col("_target").isNotNull() & F.col("_revoked").isNull()
    state = F.when(redirect, "redirect").when(~F.col("active"), "revoked").when(
        C.is_expired(F.col("expires_at"), now), "expired").otherwise("ok")
    return row.withColumn("state", state).withColumn("target_link_id", F.when(redirect, F.col("_target"))).drop("_target", "_revoked")


def offset_page(rows: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """One page with the total and the next offset (null on the last page)."""
    total = rows.agg(F.count("*")).scalar()
    page = rows.orderBy(*order).offset(offset).limit(limit)
    following = F.lit(offset + limit).cast("bigint")
    return page.withColumn("total", total).withColumn("next_offset", F.when(following < F.col("total"), following))


def keyset_page(rows: DataFrame, id_col: str, after: int, limit: int) -> DataFrame:
    """Rows with id greater than ``after``, with the next cursor and whether more follow."""
    probe = rows.where(F.col(id_col) > after).orderBy(id_col).limit(limit + 1)
    page = probe.orderBy(id_col).limit(limit)
    more = probe.agg(F.count("*") > limit).scalar()
    return page.withColumn("has_more", more).withColumn("next_cursor", page.agg(F.max(id_col)).scalar())
