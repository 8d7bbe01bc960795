"""The domain tables as views over the given tables, one SQL text for Spark and DuckDB.

A text names its inputs in braces (``{part}``); Spark binds them to DataFrames and the oracle
to the registered views. Two dialect points are filled per engine: ``{slice}`` (array base)
and ``{sha256}``.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from parcelflow.functions import geometry as G
from parcelflow.sources.readers import load_table
from parcelflow.schemas import INPUT_TABLES

SPREAD_ROWS = 25_000

_TEXT = {}
_TEXT["organizations"] = """
SELECT cast(n_nationkey AS bigint) AS organization_id, n_name AS name, n_nationkey % 7 <> 0 AS active FROM {nation}"""
_TEXT["projects"] = """
SELECT c_custkey AS project_id, cast(c_nationkey AS bigint) AS organization_id, c_name AS name,
  CASE c_custkey % 5 WHEN 0 THEN 'draft' WHEN 1 THEN 'review' WHEN 2 THEN 'published' WHEN 3 THEN 'paused' ELSE 'archived' END AS status,
  CASE c_custkey % 6 WHEN 0 THEN 'private' WHEN 1 THEN 'password' WHEN 2 THEN 'unlisted' WHEN 3 THEN 'public' WHEN 4 THEN 'link' ELSE 'token' END AS access_mode
FROM {customer}"""
_TEXT["memberships"] = """
SELECT s_suppkey AS user_id, cast(s_nationkey AS bigint) AS organization_id,
  CASE WHEN s_suppkey % 3 = 0 THEN 'client_admin' ELSE 'client_member' END AS role,
  CASE WHEN s_suppkey % 11 = 0 THEN 'platform_admin' WHEN s_suppkey % 13 = 0 THEN 'operator' ELSE 'none' END AS platform_role
FROM {supplier}"""
_TEXT["versions"] = """
SELECT o_orderkey AS version_id, o_custkey AS project_id, o_orderdate AS created_at, o_orderstatus = 'F' AS is_published,
  CASE o_orderkey % 4 WHEN 0 THEN 'light' WHEN 1 THEN 'balanced' WHEN 2 THEN 'high' ELSE 'editor' END AS quality
FROM {orders}"""
_TEXT["jobs"] = """
SELECT o_orderkey AS job_id, o_custkey AS project_id, o_orderdate AS created_at,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END AS started_at,
  CASE o_orderkey % 6 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'running' WHEN 3 THEN 'succeeded' WHEN 4 THEN 'failed' ELSE 'cancelled' END AS status
FROM {orders}"""
_TEXT["job_logs"] = """
SELECT l_orderkey AS job_id, cast(l_linenumber AS int) AS seq, l_shipdate AS at FROM {lineitem}"""
_TEXT["lots"] = """
SELECT lot_id, project_id, version_id, k, s, name, block, area_text, external_id, x0, y0,
  concat(cast(x0 AS string), ',', cast(y0 AS string), ' ', cast(x0 + 20 AS string), ',', cast(y0 AS string), ' ',
         cast(x0 + 20 AS string), ',', cast(y0 + 15 AS string), ' ', cast(x0 AS string), ',', cast(y0 + 15 AS string)) AS pts,
  CASE WHEN lot_id % 29 = 0 THEN '{bad'
       WHEN lot_id % 31 = 0 THEN concat('{"points":[[', cast(x0 AS string), ',', cast(y0 AS string), ']]}')
       ELSE concat('{"points":[[', cast(x0 AS string), ',', cast(y0 AS string), '],[', cast(x0 + 20 AS string), ',', cast(y0 AS string), '],[',
                   cast(x0 + 20 AS string), ',', cast(y0 + 15 AS string), '],[', cast(x0 AS string), ',', cast(y0 + 15 AS string), ']]}') END AS geometry_json
FROM (
  SELECT p_partkey AS lot_id, p_partkey % 25 AS project_id,
    (p_partkey % 25) * 10 + cast(floor(p_partkey / 25) AS bigint) % 2 AS version_id,
    cast(floor(p_partkey / 50) AS bigint) AS k, cast((p_partkey + cast(floor(p_partkey / 50) AS bigint)) % 5 AS int) AS s,
    cast(cast(floor(p_partkey / 50) AS bigint) AS string) AS external_id,
    20 * (cast(floor(p_partkey / 50) AS bigint) % 8) AS x0,
    15 * cast(floor(floor(p_partkey / 50) / 8) AS bigint) AS y0,
    CASE WHEN p_partkey % 17 = 0 THEN concat('Lote ', cast(p_partkey AS string))
         WHEN p_partkey % 23 = 0 THEN NULL
         ELSE concat('L', lpad(cast(cast(floor(p_partkey / 50) AS bigint) % 30 AS string), 3, '0')) END AS name,
    CASE WHEN p_partkey % 19 = 0 THEN '' ELSE concat('Q', cast(p_size AS string)) END AS block,
    CASE WHEN p_partkey % 37 = 0 THEN ''
         ELSE concat(replace(cast(cast(CASE WHEN p_partkey % 13 = 0 THEN p_retailprice * 1.5 ELSE p_retailprice END AS decimal(10,2)) AS string), '.', ','), ' m²') END AS area_text
  FROM {part}) t"""
_TEXT["plots"] = """
SELECT p_partkey AS lot_id, p_partkey % 25 AS sheet_id, cast(floor(p_partkey / 25) AS bigint) AS k,
  cast(24 * (cast(floor(p_partkey / 25) AS bigint) % 9) AS double) AS xa,
  cast(18 * cast(floor(floor(p_partkey / 25) / 9) AS bigint) AS double) AS ya,
  cast(24 * (cast(floor(p_partkey / 25) AS bigint) % 9) AS double) + 16 + (p_size % 8) / 2.0 AS xb,
  cast(18 * cast(floor(floor(p_partkey / 25) / 9) AS bigint) AS double) + (p_size % 3) / 4.0 AS yb,
  cast(24 * (cast(floor(p_partkey / 25) AS bigint) % 9) AS double) + 16 + (p_partkey % 7) / 2.0 AS xc,
  cast(18 * cast(floor(floor(p_partkey / 25) / 9) AS bigint) AS double) + 12 + (p_partkey % 5) / 2.0 AS yc,
  cast(24 * (cast(floor(p_partkey / 25) AS bigint) % 9) AS double) + (p_partkey % 4) / 2.0 AS xd,
  cast(18 * cast(floor(floor(p_partkey / 25) / 9) AS bigint) AS double) + 12 + (p_size % 5) / 2.0 AS yd
FROM {part}"""
_TEXT["lot_anchors"] = """
SELECT cast(vec_id AS bigint) AS point_id, vec_id % 25 AS project_id,
  round(cast(embedding[1] AS double) * 200 + 80, 3) AS x, round(cast(embedding[2] AS double) * 100 + 40, 3) AS y
FROM (SELECT vec_id, {slice} AS embedding FROM {embeddings}) e"""
_TEXT["availability_requests"] = """
SELECT event_id AS seq, user_id AS unit_id, user_id % 25 AS project_id,
  concat('e', cast(event_id % 700 AS string)) AS request_event_id,
  CASE event_type WHEN 'click' THEN 'reserved' WHEN 'purchase' THEN 'sold' WHEN 'error' THEN 'blocked' ELSE 'available' END AS status,
  event_id % 4 AS expected_revision, CASE WHEN value > 100 THEN 'crm' ELSE 'erp' END AS source, ts
FROM {events}"""
_TEXT["stock_units"] = """
SELECT unit_id, unit_id % 25 AS project_id, CASE WHEN unit_id % 3 = 0 THEN 'sap' END AS external_system,
  CASE WHEN unit_id % 3 = 0 THEN concat('x', cast(unit_id AS string)) END AS external_unit_id,
  CASE unit_id % 4 WHEN 0 THEN 'reserved' WHEN 1 THEN 'sold' ELSE 'available' END AS status, cast(0 AS bigint) AS revision
FROM (SELECT DISTINCT user_id AS unit_id FROM {events}) u"""
_TEXT["unit_lots"] = """
SELECT p_partkey AS lot_id, (p_partkey + CASE WHEN p_partkey % 50 = 7 THEN 1 ELSE 0 END) % 150 AS unit_id FROM {part} WHERE p_partkey % 6 <> 5"""
_TEXT["integration_events"] = """
SELECT event_id, user_id % 25 AS project_id, (user_id + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END) % 25 AS organization_id, event_type, ts AS created_at FROM {events}"""
_TEXT["subscriptions"] = """
SELECT s_suppkey AS webhook_id, cast(s_nationkey AS bigint) AS project_id, s_suppkey % 9 <> 0 AS active,
  CASE WHEN s_suppkey % 2 = 0 THEN '["purchase","click"]' ELSE '["purchase"]' END AS event_types_json
FROM {supplier}"""
_TEXT["deliveries"] = """
SELECT l_suppkey * 1000000 + l_partkey AS delivery_id, l_suppkey AS webhook_id, l_partkey AS event_id,
  CASE l_returnflag WHEN 'A' THEN 'pending' WHEN 'R' THEN 'sending' ELSE 'succeeded' END AS status,
  cast(l_quantity AS int) % 10 AS attempts, l_shipdate AS next_attempt_at,
  CASE WHEN l_returnflag = 'R' THEN l_shipdate ELSE NULL END AS lease_until
FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber, l_shipdate, l_quantity, l_returnflag) AS rn FROM {lineitem}) d
WHERE rn = 1"""
_TEXT["audit_events"] = """
SELECT event_id, ts AS created_at, CASE WHEN user_id % 8 = 0 THEN NULL ELSE user_id END AS actor_user_id,
  user_id % 25 AS organization_id, CASE event_type WHEN 'purchase' THEN 'lot_updated' WHEN 'click' THEN 'share_link_created' WHEN 'error' THEN 'share_link_revoked' WHEN 'view' THEN 'file_uploaded' ELSE 'member_added' END AS action
FROM {events}"""
_TEXT["share_links"] = """
SELECT o_orderkey AS link_id, o_custkey AS project_id, o_orderstatus <> 'P' AS active,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END AS expires_at, o_orderkey % 4 = 0 AS has_password, o_orderdate AS created_at
FROM {orders}"""
_TEXT["key_requests"] = """
SELECT event_id AS seq, user_id % 5 AS key_id, ts FROM {events}"""
_TEXT["upload_requests"] = """
SELECT event_id AS seq, user_id % 5 AS api_key_id, user_id % 25 AS project_id, concat('idem', cast(event_id % 40 AS string)) AS idem_key,
  {sha256} AS request_hash, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id END AS job_id
FROM {events}"""
_TEXT["html_maps"] = """
SELECT page_id, concat(html, '<script>var INIT = [{"index":0,"s":', cast(page_id % 5 AS string), ',"nome":"L001"},{"index":1,"s":1}];</script>') AS html FROM {pages}"""

_DIALECT = {
    "spark": {"slice": "array(0f, embedding[0], embedding[1])",
              "sha256": "sha2(concat(event_type, '|', cast(user_id % 2 AS string)), 256)"},
    "duckdb": {"slice": "embedding", "sha256": "sha256(concat(event_type, '|', cast(user_id % 2 AS string)))"},
}

ADAPTERS = tuple(_TEXT)
_INPUT = re.compile(r"\{(" + "|".join(INPUT_TABLES) + r")\}")


def _fill(name: str, engine: str) -> str:
    return reduce(lambda text, kv: text.replace("{" + kv[0] + "}", kv[1]), _DIALECT[engine].items(), _TEXT[name])


def duckdb_cte(name: str) -> str:
    return f"{name} AS ({_INPUT.sub(lambda m: m.group(1), _fill(name, 'duckdb')).strip()})"


class Tables:
    """Given and derived tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return load_table(self.spark, self.folder, name)

    def __getattr__(self, name: str):
        if name not in _TEXT:
            raise AttributeError(name)
        text = _fill(name, "spark")
        inputs = sorted(set(_INPUT.findall(text)))
        views = {}
        for table in inputs:
            views[table] = f"pf_in_{table}"
            self.raw(table).createOrReplaceTempView(views[table])
        return self.spark.sql(_INPUT.sub(lambda m: views[m.group(1)], text))

    def spread(self, rows: DataFrame) -> DataFrame:
        """``lots`` or ``plots`` over all cores. The table behind them is a few MB a million rows, which one or two tasks would read; the
        geometry made of every row takes far longer than reading it. A task gets ``SPREAD_ROWS`` of them at most, however many there are."""
        parts = max(2 * self.spark.sparkContext.defaultParallelism, math.ceil(self.raw("part").count() / SPREAD_ROWS))
        return rows.repartition(parts, "lot_id")

    def lot_rings(self) -> DataFrame:
        """Lots with their ring parsed, its area and its bounding box."""
        lots = self.spread(self.lots).drop("x0", "y0").withColumn("ring", G.parse_points(F.col("pts")))
        return with_shape(lots)

    def plot_rings(self) -> DataFrame:
        p = self.spread(self.plots)
        ring = F.array(*[G.point(F.col("x" + c), F.col("y" + c)) for c in "abcd"])
        return with_shape(p.select("lot_id", "sheet_id", "k", ring.alias("ring")))

    def text_items(self) -> DataFrame:
        """A label text at the centre of every lot."""
        lots = self.lots
        return lots.select(
            F.col("version_id").alias("sheet_id"), F.col("lot_id").alias("seq"),
            F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("area_text", F.lit(""))).alias("text"),
            (F.col("x0") + 10.0).alias("x"), (F.col("y0") + 7.5).alias("y"))

    def block_labels(self) -> DataFrame:
        """A block label per (version, block), at the mean lot centre."""
        lots = self.lots.where(F.col("block") != "")
        return lots.groupBy(F.col("version_id").alias("sheet_id"), "block").agg(
            F.avg(F.col("x0") + 10.0).alias("x"), F.avg(F.col("y0") + 7.5).alias("y"))

    def segments(self) -> DataFrame:
        """The four sides of every lot rectangle."""
        lots = self.spread(self.lots.select("lot_id", F.col("version_id").alias("sheet_id"), F.col("x0").cast("double"), F.col("y0").cast("double")))
        x0, y0 = F.col("x0"), F.col("y0")
        side = lambda a, b, c, d: F.struct(a.alias("ax"), b.alias("ay"), c.alias("bx"), d.alias("by"))
        sides = F.array(side(x0, y0, x0 + 20, y0), side(x0 + 20, y0, x0 + 20, y0 + 15),
                        side(x0 + 20, y0 + 15, x0, y0 + 15), side(x0, y0 + 15, x0, y0))
        return lots.select("sheet_id", F.inline(sides))


def with_shape(rings: DataFrame) -> DataFrame:
    """Adds ``area_px`` (without ``holes``, if there is that column) and the bounding box ``bx0,by0,bx1,by1`` of ``ring``.

    An empty ring has a NaN box, which touches nothing. As the box is then never null, no
    null check of it is pushed down, where it would parse the geometry once more per column.
    """
    area = G.holed_area(F.col("ring"), F.col("holes")) if "holes" in rings.columns else G.area(F.col("ring"))
    boxed = rings.withColumn("_b", G.bbox(F.col("ring"))).withColumn("area_px", area)
    side = lambda c: F.coalesce(F.col("_b")[c], F.lit(float("nan"))).alias("b" + c)
    return boxed.select(*rings.columns, "area_px", *[side(c) for c in ("x0", "y0", "x1", "y1")])
