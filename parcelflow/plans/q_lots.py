"""Queries over lot records: projections, filters, patches, live status."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelflow.functions import codes as C, text as X
from parcelflow.operators import lots as L, quality as Q
from parcelflow.plans.q_sources import lot_documents
from parcelflow.plans.registry import query
from parcelflow.sources import readers as R

# Shared oracle text: printed area of a lot (locale parse of "1234,56 m²"), and its pixel area.
PRINTED = "CASE WHEN area_text = '' THEN NULL ELSE cast(replace(replace(area_text, ' m²', ''), ',', '.') AS double) END"
SCALE_SQL = f"""measured AS (SELECT *, 300.0::double AS px, {PRINTED} AS printed FROM lots),
ranked AS (SELECT version_id, px / printed AS ratio, row_number() OVER (PARTITION BY version_id ORDER BY px / printed) AS rn,
  count(*) OVER (PARTITION BY version_id) AS samples FROM measured WHERE printed > 0),
scale AS (SELECT version_id, samples, CASE WHEN samples >= 20 THEN ratio END AS px_per_m2 FROM ranked WHERE rn = samples // 2 + 1)"""
STATUS_SQL = "CASE s WHEN 1 THEN 'sold' WHEN 2 THEN 'reserved' WHEN 3 THEN 'blocked' ELSE 'available' END"


def measured_lots(t):
    return t.lot_rings().withColumn("printed", X.parse_area_locale(F.col("area_text"))).withColumn(
        "printed", F.when(F.col("printed") > 0, F.col("printed")))


@query("flagship_project_report", f"""
WITH {SCALE_SQL},
judged AS (SELECT m.project_id, m.s, abs((px / printed) / px_per_m2 - 1) > 0.05 AS off FROM measured m LEFT JOIN scale USING (version_id))
SELECT project_id, count(*) AS lots, cast(count(*) FILTER (s NOT IN (1, 2, 3)) AS bigint) AS available, count(*) FILTER (s = 1) AS sold, count(*) FILTER (s = 2) AS reserved,
  count(*) FILTER (s = 3) AS blocked, count(*) FILTER (coalesce(off, false)) AS divergent FROM judged GROUP BY 1""")
def _(t):
    judged = Q.area_deviation(measured_lots(t), "version_id")
    status = C.ingest_status(F.col("s"))
    return judged.groupBy("project_id").agg(
        F.count("*").alias("lots"), *[F.count_if(status == s).alias(s) for s in C.STATUSES], F.count_if("off").alias("divergent"))


@query("lots_normalize", """
SELECT version_id, cast(k AS int) AS pos, cast(least(s, 3) AS int) AS s, pts,
  CASE s WHEN 1 THEN '#6e6d67' WHEN 2 THEN '#e0613b' WHEN 3 THEN '#7c838b' ELSE '#26d07c' END AS color,
  CASE WHEN lot_id % 3 = 0 THEN 'Lote ' || (k + 1) ELSE coalesce(name, 'Lote ' || (k + 1)) END AS nome,
  CASE WHEN lot_id % 3 = 0 THEN '' ELSE block END AS quadra, CASE WHEN lot_id % 3 = 0 THEN '' ELSE area_text END AS area, lot_id % 3 <> 0 AS extraido FROM lots""")
def _(t):
    pair = F.to_json(F.array(F.col("s").cast("string"), F.col("pts")))
    record = F.to_json(F.struct("s", "pts", F.col("name").alias("nome"), F.col("block").alias("quadra"), F.col("area_text").alias("area")))
    rows = t.lots.select("version_id", F.col("k").cast("int").alias("position"), F.when(F.col("lot_id") % 3 == 0, pair).otherwise(record).alias("record_json"))
    return L.normalize_lots(rows).select("version_id", F.col("position").alias("pos"), "s", "pts", "color", "nome", "quadra", "area", "extraido")


def loaded_lots(t):
    """The given lots, written as JSON documents and loaded back."""
    rows = R.explode_lot_json(lot_documents(t), ["project_id", "version_id"])
    return L.lots_from_records(rows, ["project_id", "version_id"])


@query("lots_from_records", f"""
SELECT project_id, version_id, external_id, name, nullif(block, '') AS block, {PRINTED} AS area_m2, {STATUS_SQL} AS status,
  '{{"points":[[' || x0 || '.0,' || y0 || '.0],[' || (x0 + 20) || '.0,' || y0 || '.0],[' || (x0 + 20) || '.0,' || (y0 + 15) || '.0],[' || x0 || '.0,' || (y0 + 15) || '.0]]}}' AS geometry_json
FROM lots""")
def _(t):
    return loaded_lots(t).select("project_id", "version_id", "external_id", "name", "block", "area_m2", "status", "geometry_json")


@query("lots_contract_check", """
WITH n AS (SELECT l_orderkey AS id, count(*) AS produced FROM lineitem GROUP BY 1)
SELECT o_orderkey AS id, cast(o_orderkey % 3 AS int) AS lot_count, coalesce(produced, 0) AS produced, o_orderkey % 3 > 0 AND produced IS NULL AS broken
FROM orders LEFT JOIN n ON id = o_orderkey""")
def _(t):
    declared = t.raw("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3).cast("int").alias("lot_count"))
    return L.contract_check(declared, t.raw("lineitem").select(F.col("l_orderkey").alias("id")), "id")


def status_lots(t):
    return t.lots.withColumn("status", C.ingest_status(F.col("s")))


@query("lots_search", f"""
SELECT version_id, lot_id, k, name, block, {STATUS_SQL} AS status FROM lots
WHERE (name ILIKE '%l00%' OR block ILIKE '%l00%') AND {STATUS_SQL} = 'reserved'""")
def _(t):
    return L.search_lots(status_lots(t), "l00", "reserved").select("version_id", "lot_id", "k", "name", "block", "status")


@query("lots_list_filter", """
SELECT lot_id, 'missing' AS mode FROM lots WHERE (coalesce(name, '') || ' ' || block || ' ' || area_text || ' ' || CASE s WHEN 0 THEN 'Disponivel' WHEN 1 THEN 'Vendido' WHEN 2 THEN 'Reservado' WHEN 3 THEN 'Bloqueado' ELSE '' END) ILIKE '%lote%'
  AND (name IS NULL OR regexp_matches(name, '^Lote \\d+$'))
UNION ALL SELECT lot_id, 'sold' AS mode FROM lots WHERE s = 1 AND (coalesce(name, '') || ' ' || block || ' ' || area_text || ' Vendido') ILIKE '%q1%'""")
def _(t):
    lots = t.lots.withColumn("extracted", F.col("name").isNotNull())
    missing = L.list_filter(lots, "lote", "missing").select("lot_id", F.lit("missing").alias("mode"))
    return missing.unionByName(L.list_filter(lots, "q1", "1").select("lot_id", F.lit("sold").alias("mode")))


@query("label_trusted", """
SELECT lot_id, CASE WHEN trim(coalesce(block, '')) <> '' AND trim(coalesce(name, '')) <> '' AND NOT regexp_full_match(trim(name), 'Lote\\s+\\d+', 'i') THEN trim(block) || '/' || trim(name) END AS label FROM lots""")
def _(t):
    return t.lots.withColumn("l", L.trusted_label(F.col("block"), F.col("name"))).select(
        "lot_id", F.when(F.col("l").isNotNull(), F.concat("l.block", F.lit("/"), "l.name")).alias("label"))


@query("text_is_non_lot_area", r"""
SELECT doc_id, regexp_matches(strip_accents(text), '(\bA\s*\.?\s*V\s*\.?\s*\d|\bOPUB\s*\d*|\bAPP\b)', 'i') AS common_area FROM documents""")
def _(t):
    return t.raw("documents").select("doc_id", X.is_non_lot_area(F.col("text")).alias("common_area"))


@query("layer_filter", """
WITH d AS (SELECT event_id, CASE event_type WHEN 'click' THEN ' LOTE ' WHEN 'purchase' THEN '4_FNC_divisa_' || user_id WHEN 'error' THEN 'TXT_Símbolos' WHEN 'view' THEN 'Vegetação ' || user_id ELSE 'BASE 2024' END AS layer FROM events)
SELECT event_id, layer, lower(trim(layer)) = 'lote' OR starts_with(lower(trim(layer)), '4_fnc_') AS cadastral,
  regexp_matches(lower(trim(strip_accents(layer))), 'veget|texto|text|txt|label|simbol|symbol|dim|sector|lake|area_net|app lagoa|etapa') AS auxiliary FROM d""")
def _(t):
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    layer = (F.when(kind == "click", " LOTE ").when(kind == "purchase", F.concat(F.lit("4_FNC_divisa_"), user)).when(kind == "error", "TXT_Símbolos")
             .when(kind == "view", F.concat(F.lit("Vegetação "), user)).otherwise("BASE 2024"))
    d = t.raw("events").select("event_id", layer.alias("layer"))
    return d.select("event_id", "layer", L.is_cadastral_layer(F.col("layer")).alias("cadastral"), L.is_auxiliary_layer(F.col("layer")).alias("auxiliary"))


PATCH_SQL = """req AS (SELECT DISTINCT l_orderkey AS batch_id, CASE WHEN l_orderkey % 3 = 0 THEN (l_partkey // 25) * 25 ELSE l_partkey + CASE WHEN l_orderkey % 7 = 0 THEN 1 ELSE 0 END END AS lot_id FROM lineitem),
hit AS (SELECT r.batch_id, r.lot_id, l.project_id, l.name, l.s FROM req r LEFT JOIN lots l USING (lot_id)),
gate AS (SELECT batch_id, count(*) = count(project_id) AND min(project_id) = max(project_id) AS applied FROM hit GROUP BY 1)"""


def batch_patches(t):
    li = t.raw("lineitem")
    lot = F.when(F.col("l_orderkey") % 3 == 0, F.floor(F.col("l_partkey") / 25) * 25).otherwise(
        F.col("l_partkey") + F.when(F.col("l_orderkey") % 7 == 0, 1).otherwise(0))
    return li.select(F.col("l_orderkey").alias("batch_id"), lot.cast("bigint").alias("lot_id"))


@query("lots_batch_patch", f"""
WITH {PATCH_SQL}
SELECT batch_id, lot_id, name, CASE WHEN applied THEN 'sold' ELSE {STATUS_SQL} END AS status, applied FROM hit JOIN gate USING (batch_id) WHERE project_id IS NOT NULL""")
def _(t):
    return L.batch_patch(status_lots(t), batch_patches(t).withColumn("status", F.lit("sold"))).select("batch_id", "lot_id", "name", "status", "applied")


@query("join_live_status", """
WITH cur AS (SELECT version_id, external_id, CASE l_returnflag WHEN 'A' THEN 'sold' WHEN 'R' THEN 'retired' ELSE 'reserved' END AS status
  FROM lots JOIN (SELECT l_partkey, arg_min(l_returnflag, (l_orderkey, l_linenumber, l_shipdate, l_quantity)) AS l_returnflag FROM lineitem GROUP BY 1) ON l_partkey = lot_id WHERE s <> 4)
SELECT l.version_id, cast(l.k AS int) AS pos, cast(CASE WHEN c.status IS NULL THEN l.s WHEN c.status = 'sold' THEN 1 WHEN c.status = 'reserved' THEN 2 ELSE 3 END AS int) AS s,
  CASE WHEN c.status IS NULL THEN '#123456' WHEN c.status = 'sold' THEN '#6e6d67' WHEN c.status = 'reserved' THEN '#e0613b' ELSE '#7c8594' END AS color, c.status AS availability
FROM lots l LEFT JOIN cur c ON c.version_id = l.version_id AND c.external_id = l.external_id""")
def _(t):
    lots = t.lots
    records = lots.select("version_id", F.col("k").cast("int").alias("position"), F.when(F.col("lot_id") % 2 == 0, F.col("external_id")).alias("idx"),
                          "s", F.lit("#123456").alias("color"))
    flag = t.raw("lineitem").groupBy(F.col("l_partkey").alias("lot_id")).agg(
        F.min_by("l_returnflag", F.struct("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")).alias("f"))
    status = F.when(F.col("f") == "A", "sold").when(F.col("f") == "R", "retired").otherwise("reserved")
    current = lots.where("s <> 4").join(flag, "lot_id").select("version_id", "external_id", status.alias("status"))
    return L.live_status(records, current, "version_id").select("version_id", F.col("position").alias("pos"), "s", "color", "availability")


@query("agg_status_counts", """
SELECT version_id, count(*) FILTER (s = 0) AS available, count(*) FILTER (s = 1) AS sold, count(*) FILTER (s = 2) AS reserved, count(*) FILTER (s = 3) AS blocked FROM lots GROUP BY 1""")
def _(t):
    return L.status_counts(t.lots, ["version_id"])


@query("agg_version_summary", """
SELECT version_id, count(*) AS lots, count(*) FILTER (name LIKE 'L0%' OR area_text <> '') AS with_text,
  count(*) FILTER (s = 0) AS available, count(*) FILTER (s = 1) AS sold, count(*) FILTER (s = 2) AS reserved, count(*) FILTER (s >= 3) AS blocked FROM lots GROUP BY 1""")
def _(t):
    text = (X.lot_label(F.col("name")) != "") | (X.area_text(F.col("area_text")) != "")
    lots = t.lots.withColumn("s", F.least("s", F.lit(3)))
    return lots.groupBy("version_id").agg(F.count("*").alias("lots"), F.count_if(text).alias("with_text"),
                                          *[F.count_if(F.col("s") == i).alias(n) for i, n in enumerate(C.STATUSES)])


@query("agg_sheet_scale", f"""
WITH {SCALE_SQL} SELECT version_id, samples, px_per_m2, sqrt(px_per_m2) AS px_per_m FROM scale""")
def _(t):
    return Q.sheet_scale(measured_lots(t), "version_id")


@query("area_check_flags", f"""
WITH {SCALE_SQL}
SELECT lot_id, round((px / printed) / px_per_m2 - 1, 9) AS deviation, coalesce(abs((px / printed) / px_per_m2 - 1) > 0.05, false) AS off FROM measured LEFT JOIN scale USING (version_id)""")
def _(t):
    return Q.area_deviation(measured_lots(t), "version_id").select("lot_id", F.round("deviation", 9).alias("deviation"), "off")


@query("agg_distinct_blocks", """
SELECT version_id, block, cast(row_number() OVER (PARTITION BY version_id ORDER BY cast(substr(block, 2) AS int)) AS int) AS ord
FROM (SELECT DISTINCT version_id, trim(block) AS block FROM lots WHERE trim(block) <> '')""")
def _(t):
    from parcelflow.operators.selection import block_options
    return block_options(t.lots, "version_id")


@query("agg_duplicate_external_ids", """
SELECT l_orderkey AS version_id, cast(l_linenumber AS varchar) AS external_id, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def _(t):
    li = t.raw("lineitem").select(F.col("l_orderkey").alias("version_id"), F.col("l_linenumber").cast("string").alias("external_id"))
    return li.groupBy("version_id", "external_id").agg(F.count("*").alias("copies")).where("copies > 1")


@query("sort_lots_list", """
SELECT version_id, lot_id, k, cast(row_number() OVER (ORDER BY version_id, k, lot_id) AS bigint) AS list_pos FROM lots""")
def _(t):
    from parcelflow.operators.grouped import group_rank
    lots = t.lots.select("version_id", "lot_id", "k").withColumn("_all", F.lit(0))
    return group_rank(lots, ["_all"], [F.col("version_id"), F.col("k"), F.col("lot_id")], "list_pos").drop("_all")
