"""Queries over validation, identity and unit operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelflow.functions import codes as C, text as X
from parcelflow.operators import identity as I, validation as V
from parcelflow.plans.q_lots import PRINTED, STATUS_SQL, status_lots
from parcelflow.plans.registry import query


def lots_to_validate(t):
    area = F.when(F.col("lot_id") % 43 == 0, F.lit(-1.0)).otherwise(X.parse_area_simple(F.col("area_text")))
    return t.lots.select("version_id", "lot_id", F.col("k").alias("sort_order"), "name", "geometry_json", area.alias("area_m2"))


ISSUES_SQL = """dup AS (SELECT version_id, name FROM lots WHERE name <> '' GROUP BY 1, 2 HAVING count(*) > 1),
issues AS (
  SELECT version_id, lot_id, k, 0 AS seq, 'missing_name' AS type, 'warning' AS severity FROM lots WHERE coalesce(name, '') = ''
  UNION ALL SELECT l.version_id, lot_id, k, 1, 'duplicate_name', 'warning' FROM lots l JOIN dup USING (version_id, name)
  UNION ALL SELECT version_id, lot_id, k, 2, 'invalid_geometry_json', 'error' FROM lots WHERE NOT json_valid(geometry_json)
  UNION ALL SELECT version_id, lot_id, k, 3, 'invalid_geometry', 'error' FROM lots WHERE json_valid(geometry_json) AND coalesce(json_array_length(CASE WHEN json_valid(geometry_json) THEN geometry_json END, '$.points'), 0) < 3
  UNION ALL SELECT version_id, lot_id, k, 4, 'invalid_area', 'warning' FROM lots WHERE json_valid(geometry_json) AND lot_id % 43 = 0)"""


@query("validate_lots", f"WITH {ISSUES_SQL} SELECT version_id, lot_id, type, severity FROM issues")
def _(t):
    return V.validate_lots(lots_to_validate(t)).select("version_id", "lot_id", "type", "severity")


@query("win_duplicate_names", """
SELECT lot_id, count(*) OVER (PARTITION BY version_id, name) > 1 AND name IS NOT NULL AS duplicated FROM lots""")
def _(t):
    lots = t.lots.select("version_id", "lot_id", "name")
    copies = lots.where(F.coalesce("name", F.lit("")) != "").groupBy("version_id", "name").agg((F.count("*") > 1).alias("d"))
    return lots.join(copies, ["version_id", "name"], "left").select("lot_id", F.coalesce("d", F.lit(False)).alias("duplicated"))


@query("win_ambiguous_names", """
SELECT version_id, lot_id FROM (SELECT *, row_number() OVER (PARTITION BY version_id, coalesce(name, ''), block ORDER BY lot_id) AS rn FROM lots) WHERE rn > 1""")
def _(t):
    lots = t.lots.select("version_id", "lot_id", F.coalesce("name", F.lit("")).alias("name"), "block")
    first = lots.groupBy("version_id", "name", "block").agg(F.min("lot_id").alias("first"))
    return lots.join(first, ["version_id", "name", "block"]).where("lot_id > first").select("version_id", "lot_id")


SUMMARY_SQL = """summary AS (SELECT l.version_id, count(*) AS lot_count, (SELECT count(*) FROM issues i WHERE i.version_id = l.version_id) AS issue_count,
  (SELECT count(*) FROM issues i WHERE i.version_id = l.version_id AND severity = 'error') AS error_count, (SELECT count(*) FROM issues i WHERE i.version_id = l.version_id AND severity = 'warning') AS warning_count
  FROM lots l GROUP BY 1)"""


@query("agg_validation_summary", f"""
WITH {ISSUES_SQL}, {SUMMARY_SQL}, listed AS (SELECT *, row_number() OVER (PARTITION BY version_id ORDER BY k, lot_id, seq) AS rn FROM issues)
SELECT s.*, (SELECT string_agg(lot_id || ':' || type, ',' ORDER BY rn) FROM listed l WHERE l.version_id = s.version_id AND rn <= 500) AS issues FROM summary s""")
def _(t):
    lots = lots_to_validate(t)
    issues = V.validate_lots(lots)
    listed = V.listed_issues(issues).groupBy("version_id").agg(F.array_sort(F.collect_list(F.struct(
        "rn", F.concat(F.col("lot_id").cast("string"), F.lit(":"), "type").alias("x")))).alias("xs"))
    listed = listed.select("version_id", F.array_join(F.transform("xs", lambda x: x["x"]), ",").alias("issues"))
    return V.validation_summary(lots, issues).join(listed, "version_id", "left")


@query("agg_issue_groups", f"""
WITH {ISSUES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY version_id, type ORDER BY k, lot_id) AS rn FROM issues)
SELECT version_id, type, count(*) AS total, CASE WHEN bool_or(severity = 'error') THEN 'error' ELSE 'warning' END AS severity, string_agg(lot_id::varchar, ',' ORDER BY rn) FILTER (rn <= 20) AS samples FROM r GROUP BY 1, 2""")
def _(t):
    return V.issue_groups(V.validate_lots(lots_to_validate(t)))


@query("publish_gate", f"WITH {ISSUES_SQL}, {SUMMARY_SQL} SELECT version_id, error_count, error_count = 0 AS publishable FROM summary")
def _(t):
    lots = lots_to_validate(t)
    return V.publish_gate(V.validation_summary(lots, V.validate_lots(lots))).select("version_id", "error_count", "publishable")


def units_of_first_version(t):
    """Every even version is the old one: its lots are units; some units carry several links."""
    old = status_lots(t).where("version_id % 2 = 0")
    return old.select("project_id", F.col("lot_id").alias("unit_id"), "block", "name", "status",
                      F.when(F.col("lot_id") % 3 == 0, "needs_reconciliation").otherwise("mapped").alias("mapping_state"), "lot_id")


def bridge_rows(t):
    """Links of the old version, plus links of some new lots through their lineitem supplier."""
    old = t.lots.where("version_id % 2 = 0").select(F.col("lot_id").alias("unit_id"), "lot_id", "version_id")
    new = t.lots.where("version_id % 2 = 1 AND lot_id % 5 = 0").select((F.col("lot_id") - 25).alias("unit_id"), "lot_id", "version_id").where("unit_id >= 0")
    return old.unionByName(new)


RECONCILE_SQL = f"""lab AS (SELECT *, {STATUS_SQL} AS status, CASE WHEN trim(coalesce(block, '')) <> '' AND trim(coalesce(name, '')) <> '' AND NOT regexp_full_match(trim(name), 'Lote\\s+\\d+', 'i') THEN trim(block) || '/' || trim(name) END AS label FROM lots),
u AS (SELECT *, CASE WHEN lot_id % 3 = 0 THEN 'needs_reconciliation' ELSE 'mapped' END AS state, count(*) OVER (PARTITION BY project_id, label) AS same FROM lab WHERE version_id % 2 = 0),
n AS (SELECT *, count(*) OVER (PARTITION BY version_id, label) AS same FROM lab WHERE version_id % 2 = 1),
br AS (SELECT lot_id AS unit_id, lot_id, version_id FROM u UNION ALL SELECT lot_id - 25, lot_id, version_id FROM n WHERE lot_id % 5 = 0 AND lot_id >= 25),
pick AS (SELECT n.*, coalesce(b.unit_id, CASE WHEN n.same = 1 AND u.same = 1 AND NOT EXISTS (SELECT 1 FROM br x WHERE x.unit_id = u.lot_id AND x.version_id = n.version_id AND x.lot_id <> n.lot_id) THEN u.lot_id END) AS unit
  FROM n LEFT JOIN br b ON b.lot_id = n.lot_id LEFT JOIN u ON u.project_id = n.project_id AND u.label = n.label AND u.same = 1 AND n.same = 1),
rec AS (SELECT p.lot_id, p.project_id, p.version_id, coalesce(unit::varchar, sha256(p.version_id || ':' || p.lot_id)) AS unit_id, unit IS NULL AS created,
  CASE WHEN unit IS NOT NULL THEN u.status ELSE 'blocked' END AS status, CASE WHEN unit IS NOT NULL THEN u.state ELSE 'needs_reconciliation' END AS mapping_state FROM pick p LEFT JOIN u ON u.lot_id = p.unit)"""


def reconciled(t):
    new = status_lots(t).where("version_id % 2 = 1")
    return I.reconcile_version(new, units_of_first_version(t), bridge_rows(t), converted=True)


@query("join_unique_label_match", f"""
WITH {RECONCILE_SQL} SELECT n.project_id, n.version_id, n.lot_id, u.lot_id AS unit_id FROM n JOIN u ON u.project_id = n.project_id AND u.label = n.label WHERE n.same = 1 AND u.same = 1""")
def _(t):
    return I.unique_label_match(t.lots.where("version_id % 2 = 1"), units_of_first_version(t))


@query("unit_reconcile_version", f"WITH {RECONCILE_SQL} SELECT lot_id, unit_id, created, status, mapping_state FROM rec")
def _(t):
    return reconciled(t).select("lot_id", "unit_id", "created", "status", "mapping_state")


@query("set_unseen_units", f"""
WITH {RECONCILE_SQL} SELECT lot_id::varchar AS unit_id, 'needs_reconciliation' AS mapping_state FROM u WHERE lot_id::varchar NOT IN (SELECT unit_id FROM rec)""")
def _(t):
    return I.unseen_units(units_of_first_version(t), reconciled(t)).select("unit_id", F.lit("needs_reconciliation").alias("mapping_state"))


BACKFILL_SQL = f"""b AS (SELECT l.*, CASE s WHEN 0 THEN 'available' WHEN 1 THEN 'sold' WHEN 2 THEN 'reserved' WHEN 3 THEN 'blocked' ELSE 'unknown' END AS status, CASE s WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS rk,
  CASE WHEN trim(coalesce(block, '')) <> '' AND trim(coalesce(name, '')) <> '' AND NOT regexp_full_match(trim(name), 'Lote\\s+\\d+', 'i') THEN '{{"block":"' || trim(block) || '","name":"' || trim(name) || '"}}' END AS label FROM lots l),
g AS (SELECT *, CASE WHEN label IS NOT NULL AND count(*) OVER (PARTITION BY version_id, label) = 1 THEN 'label:' || label ELSE 'lot:' || lot_id END AS grp FROM b),
bu AS (SELECT project_id, sha256('backfill:' || project_id || ':' || grp) AS unit_id, grp, CASE max(rk) WHEN 0 THEN 'available' WHEN 1 THEN 'reserved' WHEN 2 THEN 'blocked' ELSE 'sold' END AS status,
  arg_min(lot_id, (version_id, k, lot_id)) AS first_lot, arg_max(lot_id, (version_id, k, lot_id)) AS lot_id, count(*) AS lots FROM g GROUP BY project_id, grp)"""


@query("unit_backfill", f"""
WITH {BACKFILL_SQL} SELECT bu.unit_id, x.block, x.name, bu.status, 'needs_reconciliation' AS mapping_state, 0 AS revision, bu.lot_id, lots FROM bu JOIN b x ON x.lot_id = first_lot""")
def _(t):
    status = F.when(F.col("s") == 4, "unknown").otherwise(C.ingest_status(F.col("s")))
    lots = t.lots.withColumns({"status": status, "created_at": F.lit("2020-01-01 00:00:00").cast("timestamp_ntz"), "sort_order": F.col("k")})
    units, _bridge = I.backfill_units(lots)
    return units.select("unit_id", "block", "name", "status", "mapping_state", "revision", "lot_id", "lots")


@query("unit_bind_plan", f"""
WITH RECURSIVE un AS (SELECT l.lot_id AS unit_id, project_id, version_id, {STATUS_SQL} AS status, CASE WHEN l.lot_id % 2 = 0 THEN 'crm' END AS sys, 'U' || l.lot_id AS ext, l.lot_id % 4 AS rev, l.lot_id % 3 = 0 AS needs FROM lots l WHERE version_id % 2 = 0),
br AS (SELECT unit_id, unit_id AS lot_id, version_id FROM un UNION ALL SELECT lot_id - 25, lot_id, version_id FROM lots WHERE version_id % 2 = 1 AND lot_id % 5 = 0 AND lot_id >= 25),
rq AS (SELECT seq, lot_id % 25 AS project_id, sys, ext, lot_id FROM (SELECT l_orderkey * 10 + l_linenumber AS seq, min(l_partkey) AS lot_id, 'crm' AS sys, 'U' || (min(l_partkey) + 25 * (min(l_suppkey) % 3 - 1)) AS ext FROM lineitem GROUP BY 1)),
q AS (
  SELECT rq.*, lt.version_id AS ver, coalesce('u' || li.unit_id, 'l' || rq.lot_id) AS taker, li.unit_id IS NOT NULL AS linked, lu.sys IS NOT NULL AS has_ref, lu.status AS lst, {STATUS_SQL.replace(' s ', ' lt.s ')} AS lot_st,
    coalesce(lu.sys IS NULL AND lu.rev = 0 AND lu.needs AND (SELECT count(*) FROM br x WHERE x.unit_id = li.unit_id) = 1, false) AS prov,
    (SELECT map(list(x.version_id::varchar ORDER BY x.version_id), list(x.lot_id ORDER BY x.version_id)) FROM br x WHERE x.unit_id = li.unit_id) AS along,
    row_number() OVER (PARTITION BY rq.project_id ORDER BY rq.seq) AS i
  FROM rq LEFT JOIN lots lt ON lt.lot_id = rq.lot_id AND lt.project_id = rq.project_id LEFT JOIN br li ON li.lot_id = rq.lot_id LEFT JOIN un lu ON lu.unit_id = li.unit_id),
z AS (SELECT project_id, map(list('u' || unit_id), list(ext)) AS refs, map(list(ext), list(status)) AS named FROM un WHERE sys IS NOT NULL GROUP BY project_id),
y AS (SELECT project_id, map(list(k), list(lot_id)) AS held FROM (SELECT u.project_id, u.ext || ':' || x.version_id AS k, max(x.lot_id) AS lot_id FROM un u JOIN br x USING (unit_id) WHERE sys IS NOT NULL GROUP BY ALL) GROUP BY project_id),
w AS (
  SELECT project_id, 0::bigint AS i, NULL::bigint AS seq, NULL::varchar AS outcome, coalesce(refs, map([]::varchar[], []::varchar[])) AS refs,
    coalesce(named, map([]::varchar[], []::varchar[])) AS named, coalesce(held, map([]::varchar[], []::bigint[])) AS held
  FROM (SELECT DISTINCT project_id FROM rq) LEFT JOIN z USING (project_id) LEFT JOIN y USING (project_id)
  UNION ALL
  SELECT project_id, i, seq, outcome, CASE WHEN ok THEN map_concat(refs, MAP {{taker: ext}}) ELSE refs END,
    CASE WHEN ok AND n IS NULL THEN map_concat(named, MAP {{ext: CASE WHEN linked THEN lst ELSE lot_st END}}) ELSE named END,
    CASE WHEN ok AND n IS NULL AND linked THEN map_concat(held, map([ext || ':' || v FOR v IN map_keys(along)], map_values(along))) WHEN ok THEN map_concat(held, MAP {{ext || ':' || ver: lot_id}}) ELSE held END
  FROM (SELECT *, b IS NULL AND outcome IN ('create', 'reuse', 'absorb') AS ok FROM (
    SELECT *, CASE WHEN ver IS NULL THEN 'not_found' WHEN b IS NOT NULL THEN CASE WHEN b = ext THEN 'reuse' WHEN n IS NOT NULL THEN 'conflict_lot_bound' ELSE 'conflict_reference' END
      WHEN n IS NULL THEN CASE WHEN linked THEN 'reuse' ELSE 'create' END
      WHEN linked AND (NOT prov OR (lst IN ('sold', 'reserved') AND n <> lst)) THEN 'conflict_lot_bound' WHEN h IS NOT NULL THEN 'conflict_version' WHEN linked THEN 'absorb' ELSE 'reuse' END AS outcome
    FROM (SELECT q.*, w.refs, w.named, w.held, w.refs[q.taker] AS b, w.named[q.ext] AS n, w.held[q.ext || ':' || q.ver] AS h FROM w JOIN q ON q.project_id = w.project_id AND q.i = w.i + 1))))
SELECT seq, outcome FROM w WHERE i > 0""")
def _(t):
    units = units_of_first_version(t).withColumns({
        "external_system": F.when(F.col("unit_id") % 2 == 0, "crm"), "external_unit_id": F.concat(F.lit("U"), F.col("unit_id").cast("string")),
        "revision": (F.col("unit_id") % 4).cast("int")})
    li = t.raw("lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq")).agg(F.min("l_partkey").alias("lot_id"), F.min("l_suppkey").alias("sup"))
    requests = li.select("seq", (F.col("lot_id") % 25).alias("project_id"), F.lit("crm").alias("system"),
                         F.concat(F.lit("U"), (F.col("lot_id") + 25 * (F.col("sup") % 3 - 1)).cast("string")).alias("external_unit_id"), "lot_id")
    return I.bind_plan(requests, status_lots(t), units, bridge_rows(t)).select("seq", "outcome")


@query("join_base_version_carry", f"""
WITH base AS (SELECT project_id, external_id, lot_id, {STATUS_SQL} AS status FROM lots WHERE version_id % 2 = 0 AND lot_id % 11 <> 0),
e AS (SELECT l.lot_id, l.s, b.lot_id AS base_lot_id, b.lot_id % 4 AS revision, CASE WHEN b.lot_id % 6 <> 0 THEN b.lot_id END AS unit_id, CASE WHEN b.lot_id % 6 <> 0 THEN CASE WHEN b.lot_id % 7 = 0 THEN 'sold' ELSE b.status END ELSE b.status END AS current_status,
    CASE WHEN b.lot_id % 6 <> 0 AND b.lot_id % 3 <> 0 THEN b.lot_id % 5 END AS expected FROM lots l LEFT JOIN base b USING (project_id, external_id) WHERE l.version_id % 2 = 1),
d AS (SELECT *, CASE s WHEN 0 THEN 'available' WHEN 1 THEN 'sold' WHEN 2 THEN 'reserved' ELSE 'blocked' END AS desired_status FROM e)
SELECT lot_id, base_lot_id, unit_id, desired_status, current_status, CASE WHEN base_lot_id IS NULL THEN 'new_lot' WHEN desired_status = current_status THEN CASE WHEN unit_id IS NULL THEN 'new_unit' ELSE 'carry' END
  WHEN expected IS NULL THEN 'missing_revision' WHEN expected <> revision THEN 'stale' ELSE 'change' END AS action FROM d""")
def _(t):
    lots = status_lots(t)
    base = lots.where("version_id % 2 = 0 AND lot_id % 11 <> 0").select("project_id", "external_id", "lot_id", "status")
    linked = base.where("lot_id % 6 <> 0")
    bridge = linked.select("lot_id", F.col("lot_id").alias("unit_id"))
    units = linked.select(F.col("lot_id").alias("unit_id"), F.when(F.col("lot_id") % 7 == 0, "sold").otherwise(F.col("status")).alias("status"), (F.col("lot_id") % 4).alias("revision"))
    expected = linked.where("lot_id % 3 <> 0").select(F.col("lot_id").alias("unit_id"), (F.col("lot_id") % 5).alias("expected_revision"))
    edited = lots.where("version_id % 2 = 1").select("project_id", "external_id", "s", F.col("lot_id"))
    out = I.carry_from_base(edited, base, bridge, units, expected)
    return out.select("lot_id", "base_lot_id", "unit_id", "desired_status", "current_status", "action")
