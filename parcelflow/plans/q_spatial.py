"""Queries over spatial joins, selections and geometry edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelflow.functions import codes as C, geometry as G, text as X
from parcelflow.operators import faces as Fc, pipelines as P, quality as Q, selection as S, spatial as Sp, transform as Tr
from parcelflow.plans.q_lots import PRINTED, SCALE_SQL, measured_lots
from parcelflow.plans.q_quality import sheet_lots
from parcelflow.plans.q_scalars import RECT_SQL
from parcelflow.plans.registry import query

BOX = ("bx0", "by0", "bx1", "by1")


def rect_lots(t, *extra):
    return t.lot_rings().select("version_id", "project_id", "lot_id", "ring", "area_px", *BOX, *extra)


@query("join_point_in_polygon", """
SELECT a.point_id, l.lot_id, x > x0 AND x < x0 + 20 AND y > y0 AND y < y0 + 15 AS strict FROM lot_anchors a JOIN lots l USING (project_id) WHERE x BETWEEN x0 AND x0 + 20 AND y BETWEEN y0 AND y0 + 15""")
def _(t):
    pairs = Sp.points_in_rings(t.lot_anchors, rect_lots(t).drop("area_px"), "project_id")
    strict = ~G.on_boundary(F.col("l.x"), F.col("l.y"), F.col("r.ring"))
    return pairs.select("l.point_id", "r.lot_id", strict.alias("strict"))


BLOCKS_SQL = """blk AS (SELECT version_id, block, cast(substr(block, 2) AS bigint) AS seq, avg(x0 + 10.0::double) AS bx, avg(y0 + 7.5::double) AS b_y FROM lots WHERE block <> '' GROUP BY 1, 2, 3),
near AS (SELECT l.version_id, l.lot_id, b.block, round(sqrt((x0 + 10.0 - bx) ** 2 + (y0 + 7.5 - b_y) ** 2), 9) AS dist, row_number() OVER (PARTITION BY lot_id ORDER BY round(sqrt((x0 + 10.0 - bx) ** 2 + (y0 + 7.5 - b_y) ** 2), 9), seq) AS rn FROM lots l JOIN blk b USING (version_id))"""


def blocks(t):
    return t.block_labels().withColumn("seq", F.substring("block", 2, 9).cast("bigint"))


@query("join_nearest_label", f"""
WITH {BLOCKS_SQL} SELECT l.lot_id, CASE WHEN dist <= 12 * sqrt(300) THEN n.block ELSE '' END AS block, CASE WHEN dist <= 12 * sqrt(300) THEN round(dist, 6) END AS dist FROM lots l LEFT JOIN near n ON n.lot_id = l.lot_id AND rn = 1""")
def _(t):
    near = P.nearest_block(sheet_lots(t), blocks(t), "sheet_id", "lot_id")
    return near.select("lot_id", "block", F.round("dist", 6).alias("dist"))


@query("join_within_distance", """
SELECT a.lot_id, b.lot_id AS other, round(sqrt(greatest(0, abs(a.x0 - b.x0) - 20) ** 2 + greatest(0, abs(a.y0 - b.y0) - 15) ** 2), 6) AS gap
FROM lots a JOIN lots b ON a.version_id = b.version_id AND a.lot_id < b.lot_id WHERE sqrt(greatest(0, abs(a.x0 - b.x0) - 20) ** 2 + greatest(0, abs(a.y0 - b.y0) - 15) ** 2) <= 16""")
def _(t):
    lots = rect_lots(t)
    pairs = Sp.rings_within(lots, lots, "version_id", 16.0, F.col("l.lot_id") < F.col("r.lot_id"))
    return pairs.select("l.lot_id", F.col("r.lot_id").alias("other"), F.round("gap", 6).alias("gap"))


@query("join_overlap_ratio", """
WITH p AS (SELECT a.lot_id, b.lot_id AS other, greatest(0, 20 - abs(a.x0 + 7 - b.x0)) * greatest(0, 15 - abs(a.y0 + 4 - b.y0)) AS i FROM lots a JOIN lots b ON a.version_id = b.version_id)
SELECT lot_id, other, round(i::double, 6) AS inter_area, round(i / 300.0, 6)::double AS ratio_min, round(i / 300.0, 6)::double AS ratio_left FROM p WHERE i / 300.0 > 0.08""")
def _(t):
    lots = rect_lots(t)
    moved = lots.withColumn("ring", G.translate(F.col("ring"), F.lit(7.0), F.lit(4.0))).withColumns(
        {"bx0": F.col("bx0") + 7, "bx1": F.col("bx1") + 7, "by0": F.col("by0") + 4, "by1": F.col("by1") + 4})
    pairs = Sp.overlaps(moved, lots, "version_id").where("ratio_min > 0.08")
    return pairs.select("l.lot_id", F.col("r.lot_id").alias("other"), *[F.round(c, 6).alias(c) for c in ("inter_area", "ratio_min", "ratio_left")])


# An L-shaped ring is two rectangles; the common area of two of them is the sum over the rectangles.
@query("join_overlap_concave", """
WITH part AS (SELECT 0 AS dx0, 20 AS dx1, 0 AS dy0, 6 AS dy1 UNION ALL SELECT 0, 8, 6, 15),
p AS (SELECT a.lot_id, b.lot_id AS other, sum(greatest(0, least(a.x0 + 7 + p.dx1, b.x0 + q.dx1) - greatest(a.x0 + 7 + p.dx0, b.x0 + q.dx0))
    * greatest(0, least(a.y0 + 4 + p.dy1, b.y0 + q.dy1) - greatest(a.y0 + 4 + p.dy0, b.y0 + q.dy0))) AS i
  FROM lots a JOIN lots b ON a.version_id = b.version_id AND abs(a.x0 + 7 - b.x0) <= 20 AND abs(a.y0 + 4 - b.y0) <= 15, part p, part q GROUP BY 1, 2)
SELECT lot_id, other, round(i::double, 6) AS inter_area, round(i / 192.0, 6)::double AS ratio_min FROM p WHERE i > 0""")
def _(t):
    lots = rect_lots(t)
    corner = lambda dx, dy: G.point(F.col("bx0") + dx, F.col("by0") + dy)
    angled = F.array(corner(0.0, 0.0), corner(20.0, 0.0), corner(20.0, 6.0), corner(8.0, 6.0), corner(8.0, 15.0), corner(0.0, 15.0))
    lots = lots.withColumn("ring", angled).withColumn("area_px", F.lit(192.0))
    moved = lots.withColumn("ring", G.translate(F.col("ring"), F.lit(7.0), F.lit(4.0))).withColumns(
        {"bx0": F.col("bx0") + 7, "bx1": F.col("bx1") + 7, "by0": F.col("by0") + 4, "by1": F.col("by1") + 4})
    pairs = Sp.overlaps(moved, lots, "version_id").where("inter_area > 1e-6")
    return pairs.select("l.lot_id", F.col("r.lot_id").alias("other"), F.round("inter_area", 6).alias("inter_area"), F.round("ratio_min", 6).alias("ratio_min"))


@query("join_neighbour_in_direction", """
WITH s AS (SELECT 0 AS axis, 1 AS sign, 20 AS sx, 0 AS sy UNION ALL SELECT 0, -1, -20, 0 UNION ALL SELECT 1, 1, 0, 15 UNION ALL SELECT 1, -1, 0, -15)
SELECT a.lot_id, axis, sign, b.lot_id AS other, 0.0::double AS gap FROM lots a CROSS JOIN s JOIN lots b ON b.version_id = a.version_id AND b.x0 = a.x0 + sx AND b.y0 = a.y0 + sy""")
def _(t):
    n = Sp.neighbours(rect_lots(t).drop("project_id", "area_px"), "version_id", "lot_id")
    return n.select("lot_id", "axis", "sign", "other", (F.round("gap", 6) + F.lit(0.0)).alias("gap"))


@query("join_snap_point_to_edges", """
WITH e AS (SELECT project_id, lot_id, unnest([0, 1, 2, 3]) AS edge, unnest([x0, x0 + 20, x0 + 20, x0])::double AS ax, unnest([y0, y0, y0 + 15, y0 + 15])::double AS ay, unnest([x0 + 20, x0 + 20, x0, x0])::double AS bx, unnest([y0, y0 + 15, y0 + 15, y0])::double AS b_y FROM lots),
p AS (SELECT *, ((x - ax) * (bx - ax) + (y - ay) * (b_y - ay)) / ((bx - ax) ** 2 + (b_y - ay) ** 2) AS t FROM lot_anchors a JOIN e USING (project_id)),
o AS (SELECT point_id, lot_id, edge, 0 AS kind, sqrt((x - ax) ** 2 + (y - ay) ** 2) AS d FROM p UNION ALL SELECT point_id, lot_id, edge, 1, sqrt((x - (ax + bx) / 2) ** 2 + (y - (ay + b_y) / 2) ** 2) FROM p
  UNION ALL SELECT point_id, lot_id, edge, 2, sqrt((x - (ax + (bx - ax) * greatest(0, least(1, t)))) ** 2 + (y - (ay + (b_y - ay) * greatest(0, least(1, t)))) ** 2) FROM p WHERE t > 0.02 AND t < 0.98),
r AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY kind, round(d, 9), lot_id, edge) AS rn FROM o WHERE d <= 5)
SELECT point_id, CASE kind WHEN 0 THEN 'vertex' WHEN 1 THEN 'mid' ELSE 'edge' END AS kind, lot_id AS ring_id, cast(edge AS int) AS edge, round(d, 6) AS dist FROM r WHERE rn = 1""")
def _(t):
    edges = Sp.ring_edges(rect_lots(t), "project_id", "lot_id")
    s = Sp.snap_points(t.lot_anchors, edges, "project_id", "point_id", "lot_id", 5.0)
    return s.select("point_id", "kind", "ring_id", "edge", F.round("dist", 6).alias("dist"))


@query("join_segments_crossing", """
WITH s AS (SELECT lot_id * 2 AS id, sheet_id, xa AS ax, ya AS ay, xc + 9 AS bx, yc AS b_y FROM plots UNION ALL SELECT lot_id * 2 + 1, sheet_id, xb + 8, yb, xd, yd FROM plots),
p AS (SELECT a.id AS id1, b.id AS id2, a.ax, a.ay, a.bx - a.ax AS r1, a.b_y - a.ay AS r2, b.bx - b.ax AS s1, b.b_y - b.ay AS s2, b.ax - a.ax AS qx, b.ay - a.ay AS qy FROM s a JOIN s b ON a.sheet_id = b.sheet_id AND a.id < b.id),
c AS (SELECT *, (qx * s2 - qy * s1) / nullif(r1 * s2 - r2 * s1, 0) AS t, (qx * r2 - qy * r1) / nullif(r1 * s2 - r2 * s1, 0) AS u FROM p WHERE abs(r1 * s2 - r2 * s1) >= 1e-12)
SELECT id1, id2, round(ax + r1 * t, 6) AS x, round(ay + r2 * t, 6) AS y FROM c WHERE t BETWEEN 1e-9 AND 1 - 1e-9 AND u BETWEEN 1e-9 AND 1 - 1e-9""")
def _(t):
    p = t.plots
    one = p.select((p.lot_id * 2).alias("id"), "sheet_id", p.xa.alias("ax"), p.ya.alias("ay"), (p.xc + 9).alias("bx"), p.yc.alias("by"))
    two = p.select((p.lot_id * 2 + 1).alias("id"), "sheet_id", (p.xb + 8).alias("ax"), p.yb.alias("ay"), p.xd.alias("bx"), p.yd.alias("by"))
    c = Sp.segment_crossings(Fc.segment_boxes(one.unionByName(two)), "sheet_id", "id")
    return c.select(F.col("l.id").alias("id1"), F.col("r.id").alias("id2"), F.round("hit.x", 6).alias("x"), F.round("hit.y", 6).alias("y"))


@query("win_dedupe_centroid", """
SELECT project_id, lot_id FROM (SELECT *, row_number() OVER (PARTITION BY project_id, round_even((x0 + 10) / 1.0, 0), round_even((y0 + 7.5::double) / 1.0, 0) ORDER BY lot_id) AS rn FROM lots) WHERE rn = 1""")
def _(t):
    return Fc.dedupe_by_centroid(rect_lots(t), "project_id", 1.0, "lot_id").select("project_id", "lot_id")


@query("win_rows_reading_order", """
SELECT lot_id, row_number() OVER (PARTITION BY version_id ORDER BY y0, x0, lot_id) AS position FROM lots""")
def _(t):
    l = t.lots
    points = l.select("version_id", "lot_id", l.x0.cast("double").alias("x"), (l.y0 + (l.lot_id * 7) % 5).cast("double").alias("y"), F.lit(10.0).alias("band"))
    return S.reading_order(points, "version_id", "lot_id").select("lot_id", "position")


@query("win_distribute_gaps", """
WITH b AS (SELECT lot_id, sheet_id, xa + k * 0.37::double AS lo, xb + k * 0.37::double AS hi FROM plots),
r AS (SELECT *, row_number() OVER w AS rn, coalesce(sum(hi - lo) OVER (PARTITION BY sheet_id ORDER BY lo, lot_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, min(lo) OVER g AS glo, max(hi) OVER g AS ghi, sum(hi - lo) OVER g AS total, count(*) OVER g AS n
  FROM b WINDOW w AS (PARTITION BY sheet_id ORDER BY lo, lot_id), g AS (PARTITION BY sheet_id))
SELECT lot_id, round((ghi - glo - total) / (n - 1), 5) AS gap, round(glo + before + (rn - 1) * (ghi - glo - total) / (n - 1) - lo, 5) AS delta FROM r""")
def _(t):
    p = t.plots
    boxes = p.select("lot_id", "sheet_id", (p.xa + p.k * 0.37).alias("lo"), (p.xb + p.k * 0.37).alias("hi"))
    d = Tr.distribute(boxes, ["sheet_id"], "lot_id")
    return d.select("lot_id", F.round("gap", 5).alias("gap"), F.round("delta", 5).alias("delta"))


@query("top_nearest_k_areas", """
WITH c AS (SELECT *, ((xa*yb - xb*ya) + (xb*yc - xc*yb) + (xc*yd - xd*yc) + (xd*ya - xa*yd)) / 2 AS s FROM plots),
g AS (SELECT sheet_id, lot_id, abs(s) AS area, ((xa+xb)*(xa*yb - xb*ya) + (xb+xc)*(xb*yc - xc*yb) + (xc+xd)*(xc*yd - xd*yc) + (xd+xa)*(xd*ya - xa*yd)) / (6*s) AS gx, ((ya+yb)*(xa*yb - xb*ya) + (yb+yc)*(xb*yc - xc*yb) + (yc+yd)*(xc*yd - xd*yc) + (yd+ya)*(xd*ya - xa*yd)) / (6*s) AS gy FROM c),
r AS (SELECT point_id, area, row_number() OVER (PARTITION BY point_id ORDER BY round(sqrt((x - gx) ** 2 + (y - gy) ** 2), 9), lot_id) AS rn FROM lot_anchors a JOIN g ON g.sheet_id = a.project_id)
SELECT point_id, count(*) AS neighbours, round(median(area), 6) AS median_area FROM r WHERE rn <= 8 GROUP BY 1""")
def _(t):
    anchors = t.lot_anchors.withColumnRenamed("project_id", "sheet_id")
    m = P.nearest_area_median(anchors, t.plot_rings(), "sheet_id", "point_id", "lot_id")
    return m.select("point_id", "neighbours", F.round("median_area", 6).alias("median_area"))


# ---- selection --------------------------------------------------------------------------------


@query("lots_select_criteria", f"""
WITH {SCALE_SQL}, v AS (SELECT m.*, CASE WHEN px_per_m2 > 0 THEN coalesce(printed, px / px_per_m2) ELSE px END AS v FROM measured m LEFT JOIN scale USING (version_id))
SELECT lot_id, 'area' AS rule FROM v WHERE v BETWEEN 950 AND 1200 AND s = 1
UNION ALL SELECT lot_id, 'name' FROM lots WHERE regexp_full_match(coalesce(name, ''), 'l0.1.*', 'is') AND lower(block) = 'q7' UNION ALL SELECT lot_id, 'regex' FROM lots WHERE regexp_matches(coalesce(name, ''), '^L0[12]\\d$', 'i')""")
def _(t):
    lots = measured_lots(t)
    tag = lambda df, rule: df.select("lot_id", F.lit(rule).alias("rule"))
    area = S.select_criteria(lots, "version_id", status=1, area_min=950, area_max=1200)
    name = S.select_criteria(lots, "version_id", block="q7", name="l0?1*")
    regex = S.select_criteria(lots, "version_id", name=r"/^L0[12]\d$/")
    return tag(area, "area").unionByName(tag(name, "name")).unionByName(tag(regex, "regex"))


@query("lots_similar", f"""
WITH {SCALE_SQL}, v AS (SELECT m.*, CASE WHEN px_per_m2 > 0 THEN coalesce(printed, px / px_per_m2) ELSE px END AS v FROM measured m LEFT JOIN scale USING (version_id)),
r AS (SELECT version_id, min(lot_id) AS ref FROM lots GROUP BY 1), f AS (SELECT v.* FROM v JOIN r ON ref = lot_id)
SELECT v.lot_id, 'area' AS kind FROM v JOIN f USING (version_id) WHERE abs(v.v / f.v - 1) <= 0.05 UNION ALL SELECT v.lot_id, 'status' FROM v JOIN f USING (version_id) WHERE v.s = f.s
UNION ALL SELECT v.lot_id, 'block' FROM v JOIN f USING (version_id) WHERE f.block <> '' AND lower(v.block) = lower(f.block)""")
def _(t):
    lots = measured_lots(t)
    refs = lots.groupBy("version_id").agg(F.min("lot_id").alias("lot_id"))
    tag = lambda kind: S.similar_lots(lots, refs, "version_id", kind).select("lot_id", F.lit(kind).alias("kind"))
    return tag("area").unionByName(tag("status")).unionByName(tag("block"))


@query("agg_selection_sum", f"""
WITH {SCALE_SQL}, v AS (SELECT m.*, CASE WHEN px_per_m2 > 0 THEN coalesce(printed, px / px_per_m2) END AS m2 FROM measured m LEFT JOIN scale USING (version_id))
SELECT version_id * 10 + s AS selection_id, count(*) AS lots, sum(px) AS px, round(sum(m2), 4) AS m2, round(coalesce(sum(printed), 0), 4) AS printed, count(printed) AS with_area FROM v GROUP BY 1""")
def _(t):
    lots = measured_lots(t)
    selection = t.lots.select("version_id", "lot_id", (F.col("version_id") * 10 + F.col("s")).alias("selection_id"))
    s = S.selection_sums(lots, selection, "version_id")
    return s.select("selection_id", "lots", "px", F.round("m2", 4).alias("m2"), F.round("printed", 4).alias("printed"), "with_area")


@query("agg_bbox", """
SELECT sheet_id, min(least(xa, xb, xc, xd)) AS gx0, min(least(ya, yb, yc, yd)) AS gy0, max(greatest(xa, xb, xc, xd)) AS gx1, max(greatest(ya, yb, yc, yd)) AS gy1 FROM plots GROUP BY 1""")
def _(t):
    return Tr.group_extent(t.plot_rings(), ["sheet_id"])


@query("set_selection_combine", """
SELECT lot_id, 'add' AS mode FROM lots WHERE s = 0 OR block = 'Q3' UNION ALL SELECT lot_id, 'sub' FROM lots WHERE s = 0 AND block <> 'Q3' UNION ALL SELECT lot_id, 'set' FROM lots WHERE block = 'Q3'""")
def _(t):
    cur, hits = t.lots.where("s = 0"), t.lots.where("block = 'Q3'")
    tag = lambda mode: S.combine(cur, hits, mode, ["lot_id"]).select("lot_id", F.lit(mode).alias("mode"))
    return tag("add").unionByName(tag("sub")).unionByName(tag("set"))


@query("set_invert", "SELECT version_id, lot_id FROM lots WHERE s <> 0")
def _(t):
    return S.invert(t.lots, t.lots.where("s = 0"), ["version_id", "lot_id"])


@query("set_expand_groups", """
WITH g AS (SELECT *, CASE WHEN k % 3 = 0 THEN '' ELSE 'g' || (k // 10) END AS grp FROM lots), c AS (SELECT * FROM g WHERE s = 1 AND block LIKE 'Q1%')
SELECT version_id, lot_id FROM g WHERE (grp <> '' AND EXISTS (SELECT 1 FROM c WHERE c.version_id = g.version_id AND c.grp = g.grp)) OR (grp = '' AND lot_id IN (SELECT lot_id FROM c))""")
def _(t):
    g = F.when(F.col("k") % 3 == 0, "").otherwise(F.concat(F.lit("g"), F.floor(F.col("k") / 10).cast("string")))
    lots = t.lots.withColumn("group_name", g)
    return S.expand_groups(lots, lots.where("s = 1 AND block LIKE 'Q1%'"), "version_id")


@query("set_candidate_pool", """
SELECT version_id AS sheet_id, lot_id, e AS engine FROM lots CROSS JOIN (VALUES (0), (1), (2)) x(e) WHERE e <> version_id % 3""")
def _(t):
    from functools import reduce
    lots = t.lots.select(F.col("version_id").alias("sheet_id"), "lot_id")
    sets = [lots.withColumn("engine", F.lit(e)) for e in range(3)]
    winner = lots.select("sheet_id").distinct().withColumn("engine", (F.col("sheet_id") % 3).cast("int"))
    return reduce(lambda a, b: a.unionByName(b), sets).join(winner, ["sheet_id", "engine"], "left_anti")


def triangles(t):
    a = t.lot_anchors
    ring = F.array(G.point(a.x - 40, a.y - 30), G.point(a.x + 40, a.y - 30), G.point(a.x, a.y + 50))
    return a.select("project_id", F.col("point_id").alias("region_id"), ring.alias("ring"), (a.x - 40).alias("bx0"), (a.y - 30).alias("by0"), (a.x + 40).alias("bx1"), (a.y + 50).alias("by1"))


@query("geo_lasso", """
SELECT project_id, point_id AS region_id, lot_id FROM (SELECT *, x0 + 10 - x AS u, y0 + 7.5::double - y AS v FROM lot_anchors JOIN lots USING (project_id)) WHERE v > -30 AND 80 * (40 - u) - 40 * (v + 30) > 0 AND 80 * (u + 40) - 40 * (v + 30) > 0""")
def _(t):
    return S.lasso(rect_lots(t), triangles(t), "project_id")


@query("geo_box", """
SELECT project_id, point_id AS region_id, lot_id FROM lot_anchors JOIN lots USING (project_id) WHERE x0 + 10 BETWEEN x - 35 AND x + 35 AND y0 + 7.5::double BETWEEN y - 25 AND y + 25""")
def _(t):
    a = t.lot_anchors
    boxes = a.select("project_id", F.col("point_id").alias("region_id"), (a.x - 35).alias("bx0"), (a.y - 25).alias("by0"), (a.x + 35).alias("bx1"), (a.y + 25).alias("by1"))
    return S.box_select(rect_lots(t), boxes, "project_id")


# ---- geometry edits ---------------------------------------------------------------------------


@query("geo_profile_compatible", f"""
WITH {RECT_SQL}, ang AS (SELECT lot_id, arg_min(CASE WHEN w >= h THEN degrees(atan2(d.y, d.x)) ELSE degrees(atan2(d.y, d.x)) + 90 END, w * h / n) AS a FROM ext GROUP BY 1),
r AS (SELECT lot_id, short, long, ((a % 180) + 180) % 180 AS a FROM rect JOIN ang USING (lot_id)),
p AS (SELECT c.lot_id, least(c.short / f.short, f.short / c.short) AS rs, least(c.long / f.long, f.long / c.long) AS rl, least(abs(c.a - f.a) % 180, 180 - abs(c.a - f.a) % 180) AS turn FROM r c JOIN r f ON f.lot_id = c.lot_id + 25)
SELECT lot_id, rs >= 0.75 AND rl >= 0.70 AND turn <= 14 AS strict, rs >= 0.60 AND rl >= 0.60 AND turn <= 20 AS loose FROM p""")
def _(t):
    r = t.plot_rings().select("lot_id", G.oriented_rect(F.col("ring")).alias("c"))
    pairs = r.join(r.select((F.col("lot_id") - 25).alias("lot_id"), F.col("c").alias("f")), "lot_id")
    return pairs.select("lot_id", P.compatible_profile(F.lit(True)).alias("strict"), P.compatible_profile(F.lit(False)).alias("loose"))


@query("geo_fit_canvas", """
WITH e AS (SELECT version_id, min(x0) - 30.0::double AS gx0, max(x0) - 10.0::double AS gx1, min(y0) + 5.0::double AS gy0, max(y0) + 20.0::double AS gy1 FROM lots GROUP BY 1),
d AS (SELECT *, CASE WHEN gx1 - gx0 > 500 THEN (500 - (gx1 - gx0)) / 2 - gx0 WHEN gx0 < 0 THEN -gx0 WHEN gx1 > 500 THEN 500 - gx1 ELSE 0 END AS dx,
  CASE WHEN gy1 - gy0 > 60 THEN (60 - (gy1 - gy0)) / 2 - gy0 WHEN gy0 < 0 THEN -gy0 WHEN gy1 > 60 THEN 60 - gy1 ELSE 0 END AS dy FROM e)
SELECT lot_id, round(x0 - 30 + dx, 2) AS x, round(y0 + 5 + dy, 2) AS y FROM lots JOIN d USING (version_id)""")
def _(t):
    lots = rect_lots(t)
    moved = lots.withColumn("ring", G.translate(F.col("ring"), F.lit(-30.0), F.lit(5.0))).withColumns(
        {"bx0": F.col("bx0") - 30, "bx1": F.col("bx1") - 30, "by0": F.col("by0") + 5, "by1": F.col("by1") + 5})
    fitted = Tr.fit_to_canvas(moved, "version_id", 500, 60).select("lot_id", F.get("ring", F.lit(0)).alias("p"))
    return fitted.select("lot_id", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


@query("geo_ruler", f"""
WITH {SCALE_SQL} SELECT point_id, round(sqrt((y * 2 - x) ** 2 + (x - y) ** 2), 6) AS px, round(sqrt((y * 2 - x) ** 2 + (x - y) ** 2) / sqrt(px_per_m2), 6) AS m, round(degrees(atan2(y - x, y * 2 - x)), 6) AS angle
FROM lot_anchors LEFT JOIN scale ON version_id = project_id * 10""")
def _(t):
    scale = Q.sheet_scale(measured_lots(t), "version_id").select(F.col("version_id").alias("_v"), "px_per_m")
    a = t.lot_anchors
    pairs = a.join(scale, F.col("_v") == a.project_id * 10, "left").select("point_id", a.x.alias("ax"), a.y.alias("ay"), (a.y * 2).alias("bx"), a.x.alias("by"), "px_per_m")
    r = Tr.ruler(pairs)
    return r.select("point_id", F.round("px", 6).alias("px"), F.round("m", 6).alias("m"), F.round("angle", 6).alias("angle"))


@query("geo_align", """
WITH b AS (SELECT sheet_id, lot_id, xa, ya, least(xa, xb, xc, xd) AS x0, greatest(xa, xb, xc, xd) AS x1, least(ya, yb, yc, yd) AS y0, greatest(ya, yb, yc, yd) AS y1 FROM plots),
g AS (SELECT sheet_id, min(x0) AS gx0, max(x1) AS gx1, min(y0) AS gy0, max(y1) AS gy1 FROM b GROUP BY 1)
SELECT lot_id, m AS mode, round(xa + CASE m WHEN 'left' THEN gx0 - x0 WHEN 'right' THEN gx1 - x1 WHEN 'centerx' THEN (gx0 + gx1) / 2 - (x0 + x1) / 2 ELSE 0 END, 6) AS x,
  round(ya + CASE m WHEN 'top' THEN gy0 - y0 WHEN 'bottom' THEN gy1 - y1 WHEN 'middley' THEN (gy0 + gy1) / 2 - (y0 + y1) / 2 ELSE 0 END, 6) AS y
FROM b JOIN g USING (sheet_id) CROSS JOIN (VALUES ('left'), ('right'), ('centerx'), ('top'), ('bottom'), ('middley')) v(m)""")
def _(t):
    from functools import reduce
    plots = t.plot_rings()

    def one(mode):
        first = Tr.align(plots, ["sheet_id"], mode).select("lot_id", F.get("ring", F.lit(0)).alias("p"))
        return first.select("lot_id", F.lit(mode).alias("mode"), F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))

    return reduce(lambda a, b: a.unionByName(b), [one(m) for m in ("left", "right", "centerx", "top", "bottom", "middley")])


@query("geo_fit_gap", """
WITH n AS (SELECT a.lot_id, a.x0 * 1.2::double AS x, a.y0 / 15 * 20.0::double AS y, l.lot_id IS NOT NULL AS l, r.lot_id IS NOT NULL AS r, u.lot_id IS NOT NULL AS u, d.lot_id IS NOT NULL AS d FROM lots a
  LEFT JOIN lots l ON l.version_id = a.version_id AND l.x0 = a.x0 - 20 AND l.y0 = a.y0 LEFT JOIN lots r ON r.version_id = a.version_id AND r.x0 = a.x0 + 20 AND r.y0 = a.y0
  LEFT JOIN lots u ON u.version_id = a.version_id AND u.y0 = a.y0 - 15 AND u.x0 = a.x0 LEFT JOIN lots d ON d.version_id = a.version_id AND d.y0 = a.y0 + 15 AND d.x0 = a.x0),
c AS (SELECT *, l::int + r::int AS fx, u::int + d::int AS fy FROM n), b AS (SELECT *, CASE WHEN fx >= fy THEN 0 ELSE 1 END AS axis FROM c WHERE fx + fy > 0)
SELECT lot_id, axis, cast(CASE WHEN axis = 0 THEN fx ELSE fy END AS bigint) AS found, round(CASE WHEN axis = 0 THEN CASE WHEN fx = 2 THEN 28 / 20.0 ELSE 1 END ELSE CASE WHEN fy = 2 THEN 25 / 15.0 ELSE 1 END END, 6)::double AS stretch,
  round(x + CASE WHEN axis = 0 THEN CASE WHEN l THEN -4 ELSE 4 END ELSE 0 END, 4) AS min_x, round(y + CASE WHEN axis = 1 THEN CASE WHEN u THEN -5 ELSE 5 END ELSE 0 END, 4) AS min_y FROM b""")
def _(t):
    from parcelflow.adapters import with_shape
    l = t.spread(t.lots.select("version_id", "lot_id", "x0", "y0"))
    x, y = l.x0 * 1.2, l.y0 / 15 * 20.0
    rings = with_shape(l.select("version_id", "lot_id", F.array(G.point(x, y), G.point(x + 20, y), G.point(x + 20, y + 15), G.point(x, y + 15)).alias("ring")))
    f = Tr.fit_gap(rings, "version_id", "lot_id")
    low = lambda c: F.round(F.array_min(F.transform("ring", lambda p: p[c])), 4)
    return f.select("lot_id", "axis", "found", F.round("stretch", 6).alias("stretch"), low("x").alias("min_x"), low("y").alias("min_y"))


@query("geo_replicate", """
SELECT lot_id, copy, round(x0 + 21.5 * copy, 4)::double AS x, y0::double AS y, CASE WHEN name IS NULL THEN ' ' || (copy + 1) WHEN name LIKE 'Lote %' THEN 'Lote ' || (cast(substr(name, 6) AS bigint) + copy)
  ELSE 'L' || lpad((cast(substr(name, 2) AS int) + copy)::varchar, 3, '0') END AS name FROM lots CROSS JOIN (VALUES (1), (2), (3)) v(copy)""")
def _(t):
    c = Tr.replicate(t.lot_rings().select("lot_id", "name", "ring"), 3, F.lit(0.0), 1.5).select("lot_id", "copy", "name", F.get("ring", F.lit(0)).alias("p"))
    return c.select("lot_id", "copy", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"), "name")


@query("geo_replicate_selection", """
WITH g AS (SELECT *, lot_id % 3 = 0 AS third, max(x0 + 20) OVER w - min(x0) OVER w + 1.5 AS step, count(*) OVER w AS n FROM lots WINDOW w AS (PARTITION BY version_id, lot_id % 3 = 0))
SELECT lot_id, cast(copy AS int) AS copy, round(x0 + step * copy, 4)::double AS x, y0::double AS y FROM g CROSS JOIN range(1, 41) v(copy) WHERE n * 40 <= 800""")
def _(t):
    r = t.lot_rings().select("version_id", (F.col("lot_id") % 3 == 0).alias("third"), "lot_id", "name", "ring")
    c = Tr.replicate(r, 40, F.lit(0.0), 1.5, ["version_id", "third"]).select("lot_id", "copy", F.get("ring", F.lit(0)).alias("p"))
    return c.select("lot_id", "copy", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"))


@query("geo_split_line", f"""
SELECT lot_id, p AS part, CASE p WHEN '-A' THEN 75 ELSE 225 END::double AS area, coalesce(name, '') || p AS name, CASE WHEN area_text = '' THEN '' ELSE replace(printf('%.2f', {PRINTED} * CASE p WHEN '-A' THEN 75.0 ELSE 225.0 END / 300), '.', ',') || ' m²' END AS area_text
FROM lots CROSS JOIN (VALUES ('-A'), ('-B')) v(p)""")
def _(t):
    lots = t.lot_rings().withColumn("name", F.coalesce("name", F.lit("")))
    x = F.col("bx0") + 5
    s = Tr.split_by_line(lots, x, F.col("by0") - 1, x, F.col("by0") + 20)
    return s.select("lot_id", "part", F.round("area_px", 6).alias("area"), "name", "area_text")


@query("geo_merge_adjacent", f"""
WITH m AS (SELECT version_id, k // 2 AS pair, count(*) AS members, min(lot_id) AS kept_id, sum(300.0::double) AS area, min(x0)::double AS x, min(y0)::double AS y FROM lots GROUP BY 1, 2 HAVING count(*) > 1)
SELECT version_id * 100000 + pair AS group_id, members, kept_id, area, 4 AS corners, x, y FROM m""")
def _(t):
    lots = t.lot_rings().select((F.col("version_id") * 100000 + F.floor(F.col("k") / 2)).alias("group_id"), "lot_id", "ring", "area_px")
    m = Fc.merge_adjacent(lots, "group_id", "lot_id")
    low = lambda c: F.array_min(F.transform("ring", lambda p: p[c]))
    return m.select("group_id", "members", "kept_id", F.round("area", 4).alias("area"), F.size("ring").alias("corners"), low("x").alias("x"), low("y").alias("y"))


@query("geo_trace_faces", """
SELECT version_id AS sheet_id, x0::double AS x, y0::double AS y, 300.0::double AS area, 4 AS corners FROM lots""")
def _(t):
    f = Fc.trace_faces(t.segments(), "sheet_id")
    return f.select("sheet_id", F.col("bx0").alias("x"), F.col("by0").alias("y"), F.round("area_px", 6).alias("area"), F.size("ring").alias("corners"))


@query("win_best_face_per_anchor", """
SELECT version_id AS sheet_id, lot_id AS label_id, 0 AS rank, 300.0::double AS area, x0::double AS x, y0::double AS y FROM lots WHERE name LIKE 'L0%'""")
def _(t):
    from parcelflow.plans.q_quality import lot_labels
    best = Fc.best_face_per_anchor(t.segments(), lot_labels(t), "sheet_id", "label_id", 20, 400)
    return best.select("sheet_id", "label_id", "rank", F.round("area_px", 4).alias("area"), F.round("bx0", 4).alias("x"), F.round("by0", 4).alias("y"))


#: Rectangles drawn inside lots, by lot_id % 4, relative to the lot's corner: one hole; two holes; a hole with a lot in it.
INNER = [(1, 5, 5, 10, 10), (2, 2, 2, 4, 4), (2, 10, 6, 13, 9), (3, 4, 3, 14, 12), (3, 6, 5, 9, 8)]


def nested_segments(t):
    lots = t.spread(t.lots.select(F.col("version_id").alias("sheet_id"), "lot_id", F.col("x0").cast("double").alias("x"), F.col("y0").cast("double").alias("y")))
    inner = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("kind", "x0", "y0", "x1", "y1"), r)]) for r in [(-1, 0, 0, 20, 15), *INNER]])
    r = lots.select("*", F.inline(inner)).where("kind = -1 or kind = lot_id % 4")
    corner = lambda a, b: G.point(F.col("x") + F.col(a), F.col("y") + F.col(b))
    ring = F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"))
    return r.select("sheet_id", F.inline(G.edges(ring)))


@query("geo_trace_faces_nested", """
WITH f(kind, dx, dy, area, holes) AS (VALUES (0, 0, 0, 300, 0), (1, 0, 0, 275, 1), (1, 5, 5, 25, 0), (2, 0, 0, 287, 2), (2, 2, 2, 4, 0), (2, 10, 6, 9, 0),
  (3, 0, 0, 210, 1), (3, 4, 3, 81, 1), (3, 6, 5, 9, 0))
SELECT version_id AS sheet_id, (x0 + dx)::double AS x, (y0 + dy)::double AS y, area::double AS area, cast(holes AS int) AS holes FROM lots JOIN f ON kind = lot_id % 4""")
def _(t):
    f = Fc.trace_faces(nested_segments(t), "sheet_id")
    return f.select("sheet_id", F.col("bx0").alias("x"), F.col("by0").alias("y"), F.round("area_px", 6).alias("area"), F.size("holes").alias("holes"))


@query("win_best_face_nested", """
SELECT version_id AS sheet_id, lot_id AS label_id, CASE lot_id % 4 WHEN 0 THEN 300 WHEN 1 THEN 25 WHEN 2 THEN 287 ELSE 9 END::double AS area FROM lots WHERE name LIKE 'L0%'""")
def _(t):
    labels = t.lots.where("name like 'L0%'").select(F.col("version_id").alias("sheet_id"), F.col("lot_id").alias("label_id"), (F.col("x0") + 7.5).alias("x"), (F.col("y0") + 6.5).alias("y"))
    best = Fc.best_face_per_anchor(nested_segments(t), labels, "sheet_id", "label_id", 5, 400, snaps=(None, 0.5))
    return best.select("sheet_id", "label_id", F.round("area_px", 4).alias("area"))
