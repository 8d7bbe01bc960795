"""Queries over the sources and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from parcelflow.functions import codes as C, geometry as G, text as X
from parcelflow.plans.registry import query
from parcelflow.schemas import INPUT_TABLES, LOT_RECORD
from parcelflow.session import shared_path
from parcelflow.sources import readers as R, sinks as S

_TABLES = sorted(INPUT_TABLES)


@query("src_table_parquet", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count, cast({len(INPUT_TABLES[t].split(','))} AS int) AS column_count FROM {t}"
    for t in _TABLES))
def _(t):
    one = lambda n: t.raw(n).agg(F.count("*").alias("row_count")).select(
        F.lit(n).alias("table_name"), "row_count", F.lit(len(t.raw(n).columns)).alias("column_count"))
    return reduce(lambda a, b: a.unionByName(b), [one(n) for n in _TABLES])


@query("src_status_csv", """
WITH csv AS (SELECT event_id AS seq, CASE WHEN event_id % 9 = 0 THEN 'x' || event_id ELSE cast(user_id * 3 AS varchar) END AS idx,
    CASE event_type WHEN 'click' THEN ' Reservado ' WHEN 'purchase' THEN 'vendido' WHEN 'error' THEN 'bloqueado' WHEN 'view' THEN 'outro' ELSE 'disponivel' END AS st FROM events),
last AS (SELECT try_cast(idx AS bigint) AS i, arg_max(st, seq) AS st FROM csv WHERE try_cast(idx AS bigint) IS NOT NULL GROUP BY 1)
SELECT p_partkey AS i, cast(CASE lower(trim(st)) WHEN 'vendido' THEN 1 WHEN 'reservado' THEN 2 WHEN 'bloqueado' THEN 3 ELSE 0 END AS int) AS s
FROM part LEFT JOIN last ON last.i = p_partkey""")
def _(t):
    e = t.raw("events")
    status = (F.when(F.col("event_type") == "click", " Reservado ").when(F.col("event_type") == "purchase", "vendido")
              .when(F.col("event_type") == "error", "bloqueado").when(F.col("event_type") == "view", "outro").otherwise("disponivel"))
    index = F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("x"), F.col("event_id").cast("string"))).otherwise(
        (F.col("user_id") * 3).cast("string"))
    path = shared_path(t.spark, "status-csv")
    # files with the two columns of a status file, whose order is that of the names and the rows in them
    e.repartitionByRange(8, "event_id").sortWithinPartitions("event_id").select(index.alias("index"), status.alias("status")).write.option("header", True).csv(path)
    return R.status_from_csv(R.read_status_csv(t.spark, path), t.raw("part").select(F.col("p_partkey").alias("i")))


@query("src_demo_status", """
SELECT p_partkey AS i, cast(CASE WHEN (p_partkey * 73) % 100 < 10 THEN 2 WHEN (p_partkey * 73) % 100 < 33 THEN 1 ELSE 0 END AS int) AS s FROM part""")
def _(t):
    return t.raw("part").select(F.col("p_partkey").alias("i"), R.demo_status(F.col("p_partkey")).alias("s"))


def lot_documents(t):
    """JSON documents of up to 20 lot records; some use the other key or hold a stray number."""
    lots = t.lots.withColumn("part", F.floor(F.col("k") / 20).cast("bigint"))
    record = F.to_json(F.struct(F.col("k").alias("index"), "s", F.col("name").alias("nome"), F.col("block").alias("quadra"),
                                F.col("area_text").alias("area"), "pts"))
    docs = lots.groupBy("version_id", "project_id", "part").agg(F.array_sort(F.collect_list(F.struct("k", record.alias("r")))).alias("rs"))
    body = F.array_join(F.transform("rs", lambda r: r["r"]), ",")
    stray = F.when(F.col("version_id") % 2 == 1, "7,").otherwise("")
    name = F.when(F.col("part") % 2 == 1, "lots").otherwise("data")
    return docs.select("version_id", "project_id", "part", F.concat(F.lit('{"'), name, F.lit('":['), stray, body, F.lit("]}")).alias("doc"))


@query("src_lot_json", """
SELECT version_id, cast(floor(k / 20) AS bigint) AS part,
  cast(row_number() OVER (PARTITION BY version_id, floor(k / 20) ORDER BY k) - 1 + version_id % 2 AS int) AS pos,
  cast(k AS varchar) AS idx, cast(s AS varchar) AS s, name AS nome FROM lots""")
def _(t):
    rows = R.explode_lot_json(lot_documents(t), ["version_id", "part"])
    r = F.from_json("record_json", LOT_RECORD)
    return rows.select("version_id", "part", F.col("position").alias("pos"), r["index"].alias("idx"), r["s"].alias("s"), r["nome"].alias("nome"))


@query("src_html_embedded_json", """
SELECT page_id, cast(unnest([0, 1]) AS int) AS pos, unnest(['0', '1']) AS idx, unnest([cast(page_id % 5 AS varchar), '1']) AS s,
  unnest(['L001', NULL]) AS nome FROM html_maps WHERE regexp_matches(html, '\\bINIT\\s*=\\s*\\[')""")
def _(t):
    rows = R.lots_from_html(t.html_maps, ["page_id"])
    return rows.select("page_id", F.col("position").alias("pos"), F.col("record.index").alias("idx"), F.col("record.s").alias("s"),
                       F.col("record.nome").alias("nome"))


def _files(t):
    d = t.raw("documents")
    path = F.concat(F.lit("uploads/"), d["source"], F.lit("/doc "), d["doc_id"].cast("string"),
                    F.when(d["doc_id"] % 3 == 0, ".PDF").when(d["doc_id"] % 3 == 1, ".txt").otherwise(""))
    head = F.when(d["doc_id"] % 2 == 0, "%PDF-").otherwise("")
    return d.select("doc_id", path.alias("path"), F.encode(F.concat(head, d["text"]), "UTF-8").alias("content")).withColumn(
        "length", F.length("content").cast("bigint"))


_FILES_SQL = """files AS (SELECT doc_id, 'uploads/' || source || '/doc ' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.PDF' WHEN doc_id % 3 = 1 THEN '.txt' ELSE '' END AS path,
  CASE WHEN doc_id % 2 = 0 THEN '%PDF-' ELSE '' END || text AS body FROM documents)"""


@query("src_file_manifest", f"""
WITH {_FILES_SQL}
SELECT path, regexp_extract(path, '([^/]*)$', 1) AS name,
  CASE WHEN path LIKE '%.PDF' THEN 'application/pdf' WHEN path LIKE '%.txt' THEN 'text/plain' ELSE 'application/octet-stream' END AS content_type,
  cast(octet_length(encode(body)) AS bigint) AS size_bytes, sha256(body) AS checksum_sha256 FROM files""")
def _(t):
    return R.file_manifest(_files(t))


@query("src_file_intake_check", f"""
WITH {_FILES_SQL}
SELECT doc_id, CASE WHEN NOT lower(path) LIKE '%.pdf' THEN 'not_pdf_name' WHEN NOT starts_with(body, '%PDF-') THEN 'bad_signature'
  WHEN octet_length(encode(body)) > 20000 THEN 'too_large' ELSE 'ok' END AS verdict FROM files""")
def _(t):
    return R.file_intake(_files(t), limit=20000).select("doc_id", "verdict")


def export_rows(t):
    label = C.by_index(C.STATUSES, F.col("s"), "available")
    return t.lots.select("lot_id", F.col("k").alias("index"), F.col("block").alias("quadra"), F.col("name").alias("lote"),
                         F.concat(F.col("area_text"), F.when(F.col("lot_id") % 41 == 0, ' "x"').otherwise("")).alias("area"),
                         label.alias("status"), C.by_index(C.INGEST_COLORS, F.col("s"), "#26d07c").alias("cor"),
                         F.lit(None).cast("string").alias("grupo"), F.col("pts").alias("pontos"))


@query("sink_lot_csv", """
SELECT lot_id, concat_ws(',', '"' || k || '"', '"' || block || '"', '"' || coalesce(name, '') || '"',
  '"' || area_text || CASE WHEN lot_id % 41 = 0 THEN ' ""x""' ELSE '' END || '"',
  '"' || CASE s WHEN 1 THEN 'sold' WHEN 2 THEN 'reserved' WHEN 3 THEN 'blocked' ELSE 'available' END || '"',
  '"' || CASE s WHEN 1 THEN '#6e6d67' WHEN 2 THEN '#e0613b' WHEN 3 THEN '#7c838b' ELSE '#26d07c' END || '"', '""', '"' || pts || '"') AS line FROM lots""")
def _(t):
    return S.lot_csv_lines(export_rows(t), ["lot_id"])


@query("sink_lot_csv_files", """
SELECT concat_ws(',', '"' || k || '"', '"' || block || '"', '"' || coalesce(name, '') || '"',
  '"' || area_text || CASE WHEN lot_id % 41 = 0 THEN ' ""x""' ELSE '' END || '"',
  '"' || CASE s WHEN 1 THEN 'sold' WHEN 2 THEN 'reserved' WHEN 3 THEN 'blocked' ELSE 'available' END || '"',
  '"' || CASE s WHEN 1 THEN '#6e6d67' WHEN 2 THEN '#e0613b' WHEN 3 THEN '#7c838b' ELSE '#26d07c' END || '"', '""', '"' || pts || '"') AS line FROM lots""")
def _(t):
    """The files as written, without their header lines."""
    path = shared_path(t.spark, "lots-csv")
    S.write_lot_csv(export_rows(t).withColumn("index", F.col("index").cast("string")), path)
    header = ",".join(f'"{c}"' for c in S.CSV_COLUMNS)
    lines = t.spark.read.text(path).select(F.col("value").alias("line"))
    return lines.where(~F.col("line").isin(header, ",".join(S.CSV_COLUMNS)))


@query("sink_geojson_features", """
SELECT lot_id, lot_id % 29 <> 0 AND lot_id % 31 <> 0 AS has_geometry,
  CASE WHEN lot_id % 29 <> 0 AND lot_id % 31 <> 0 THEN 5 ELSE NULL END AS ring_points,
  '{"type":"Feature","id":' || lot_id || ',"properties":{"k":' || k || ',"block":"' || block || '"},"geometry":' ||
  CASE WHEN lot_id % 29 <> 0 AND lot_id % 31 <> 0 THEN '{"type":"Polygon","coordinates":[[[' || x0 || '.0,' || y0 || '.0],[' || (x0 + 20) || '.0,' || y0 || '.0],[' ||
    (x0 + 20) || '.0,' || (y0 + 15) || '.0],[' || x0 || '.0,' || (y0 + 15) || '.0],[' || x0 || '.0,' || y0 || '.0]]]}' ELSE 'null' END || '}' AS feature FROM lots""")
def _(t):
    f = S.geojson_features(t.lots, "lot_id", ["k", "block"])
    return f.select("lot_id", F.col("ring").isNotNull().alias("has_geometry"), F.when(F.col("ring").isNotNull(), F.size("ring")).alias("ring_points"), "feature")


@query("sink_lot_payload_json", """
SELECT version_id, cast(floor(k / 5000) AS bigint) AS part, count(*) AS lots,
  string_agg('{"k":' || k || ',"block":"' || block || '","mark":"\\u003cb' || s || '\\u003e\\u0026"}', ',' ORDER BY k) AS payload
FROM lots GROUP BY 1, 2""")
def _(t):
    lots = t.lots.withColumn("mark", F.concat(F.lit("<b"), F.col("s").cast("string"), F.lit(">&")))
    return S.lot_payload(lots, "version_id", "k", ["k", "block", "mark"])


@query("sink_versioned_table", """
SELECT project_id, version_id AS project_version_id, count(*) AS lots, cast(sum(k) AS bigint) AS order_sum FROM lots GROUP BY 1, 2""")
def _(t):
    rows = t.lots.select("project_id", F.col("version_id").alias("project_version_id"), "lot_id", "name", "block", "s", "pts",
                         F.col("k").cast("int").alias("sort_order"))
    path = shared_path(t.spark, "lots")
    S.write_versioned_lots(rows, path)
    return t.spark.read.schema("lot_id bigint, name string, block string, s int, pts string, sort_order int, project_id bigint, project_version_id bigint").parquet(
        path).groupBy("project_id", "project_version_id").agg(F.count("*").alias("lots"), F.sum("sort_order").cast("bigint").alias("order_sum"))
