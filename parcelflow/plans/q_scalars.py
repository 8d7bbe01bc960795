"""Queries over the row-level text, number, date and geometry functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelflow.functions import codes as C, geometry as G, text as X
from parcelflow.plans.q_lots import PRINTED
from parcelflow.plans.q_tenancy import NOW, now
from parcelflow.plans.registry import query

@query("fn_parse_points", """
SELECT lot_id, 4 AS n, cast(x0 + (x0 + 20) * 2 + x0 AS double) AS sum_x, cast(y0 * 2 + (y0 + 15) * 2 AS double) AS sum_y, '[' || x0 || '.0,' || y0 || '.0]' AS first_point FROM lots""")
def _(t):
    noisy = F.concat(F.col("pts"), F.lit(" abc 1, ,2 x,y"))
    p = t.lots.select("lot_id", G.parse_points(noisy).alias("p"))
    total = lambda c: F.aggregate("p", F.lit(0.0), lambda a, q: a + q[c])
    first = F.to_json(F.array(F.get("p", F.lit(0))["x"], F.get("p", F.lit(0))["y"]))
    return p.select("lot_id", F.size("p").alias("n"), total("x").alias("sum_x"), total("y").alias("sum_y"), first.alias("first_point"))


@query("fn_format_points", """
SELECT lot_id, printf('%.1f,%.1f %.1f,%.1f', xa, ya, xc, yc) AS pts FROM (SELECT lot_id, xa, ya, round(xc, 1) AS xc, round(yc, 1) AS yc FROM plots)""")
def _(t):
    p = t.plots
    return p.select("lot_id", G.format_points(F.array(G.point(p.xa, p.ya), G.point(p.xc, p.yc))).alias("pts"))


@query("fn_parse_area_simple", f"""
SELECT lot_id, {PRINTED} AS area, cast(nullif(regexp_extract(coalesce(name, ''), '\\d+(?:[.,]\\d+)?'), '') AS double) AS from_name FROM lots""".replace(
    "cast(nullif(regexp_extract(coalesce(name, ''), '\\d+(?:[.,]\\d+)?'), '') AS double)", "nullif(cast(nullif(regexp_extract(coalesce(name, ''), '\\d+(?:[.,]\\d+)?'), '') AS double), 0)"))
def _(t):
    return t.lots.select("lot_id", X.parse_area_simple(F.col("area_text")).alias("area"), X.parse_area_simple(F.col("name")).alias("from_name"))


THOUSANDS = "'~' || (p_partkey // 10 + 1) || '.' || lpad((p_partkey % 1000)::varchar, 3, '0') || CASE p_partkey % 3 WHEN 0 THEN ',5' WHEN 1 THEN '' ELSE ',25 m²' END"


@query("fn_parse_area_locale", f"""
SELECT p_partkey AS id, {THOUSANDS} AS txt, (p_partkey // 10 + 1) * 1000 + p_partkey % 1000 + CASE p_partkey % 3 WHEN 0 THEN 0.5::double WHEN 1 THEN 0::double ELSE 0.25::double END AS area,
  cast(printf('%.2f', p_retailprice) AS double) AS plain FROM part""")
def _(t):
    p = t.raw("part")
    tail = F.when(F.col("p_partkey") % 3 == 0, ",5").when(F.col("p_partkey") % 3 == 1, "").otherwise(",25 m²")
    text = F.concat(F.lit("~"), (F.floor(F.col("p_partkey") / 10) + 1).cast("string"), F.lit("."), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"), tail)
    plain = F.concat(X.fixed(F.col("p_retailprice"), 2), F.lit("m2"))
    return p.select(F.col("p_partkey").alias("id"), text.alias("txt"), X.parse_area_locale(text).alias("area"), X.parse_area_locale(plain).alias("plain"))


@query("fn_format_area", """
SELECT lot_id, CASE WHEN area_text = '' THEN '' ELSE replace(printf('%.2f', cast(k AS double) + 0.25), '.', ',') || ' m²' END AS txt FROM lots""")
def _(t):
    return t.lots.select("lot_id", X.format_area_like(F.col("area_text"), F.col("k") + F.lit(0.25)).alias("txt"))


@query("fn_format_br", """
SELECT o_orderkey AS id, translate(format('{:,.2f}', o_totalprice), ',.', '.,') AS money, translate(format('{:,}', cast(round(o_totalprice) AS bigint)), ',', '.') AS short FROM orders""")
def _(t):
    o = t.raw("orders")
    return o.select(F.col("o_orderkey").alias("id"), X.format_br(o.o_totalprice, 2).alias("money"), X.format_br(F.round(o.o_totalprice)).alias("short"))


@query("fn_lot_label", r"""
SELECT doc_id, upper(regexp_replace(regexp_extract(text, '(?i)\bL\s*\d{1,3}[A-Z]?'), '\s+', '', 'g')) AS label FROM documents
UNION ALL SELECT -1 - lot_id AS doc_id, CASE WHEN name LIKE 'L0%' THEN name ELSE '' END FROM lots""")
def _(t):
    texts = t.raw("documents").select("doc_id", "text").unionByName(t.lots.select((-1 - F.col("lot_id")).alias("doc_id"), F.lower("name").alias("text")))
    return texts.select("doc_id", X.lot_label(F.col("text")).alias("label"))


@query("fn_area_text", """
SELECT lot_id, replace(area_text, ' ', '') AS area FROM lots""")
def _(t):
    text = F.concat(F.lit("12 m2 "), F.lit("L 7B "), F.col("area_text"))
    return t.lots.select("lot_id", X.area_text(text).alias("area"))


@query("fn_normalize_block", """
SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'Q' || p_size WHEN 1 THEN 'E' || p_size WHEN 2 THEN 'Q' || p_size WHEN 3 THEN 'Q' || p_size || 'C' WHEN 4 THEN '' ELSE 'Q' || p_size END AS block FROM part""")
def _(t):
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 6
    text = (F.when(k == 0, F.concat(F.lit(" qd-"), size)).when(k == 1, F.concat(F.lit("e "), size)).when(k == 2, size)
            .when(k == 3, F.concat(F.lit("Quadra "), size, F.lit("c"))).when(k == 4, F.concat(F.lit("Rua "), size)).otherwise(F.concat(F.lit("Q"), size)))
    return t.raw("part").select(F.col("p_partkey").alias("id"), X.normalize_block(text).alias("block"))


@query("fn_lot_number", "SELECT lot_id, coalesce(try_cast(nullif(regexp_extract(coalesce(name, ''), '\\d+'), '') AS bigint), 0) AS number FROM lots")
def _(t):
    return t.lots.select("lot_id", X.lot_number(F.col("name")).alias("number"))


@query("fn_clean_text", r"SELECT doc_id, sha256(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')) AS cleaned FROM documents")
def _(t):
    return t.raw("documents").select("doc_id", F.sha2(X.clean_text(F.col("text")), 256).alias("cleaned"))


@query("fn_next_name", """
SELECT lot_id, CASE WHEN name IS NULL THEN ' 4' WHEN name LIKE 'Lote %' THEN 'Lote ' || (cast(substr(name, 6) AS bigint) + 3)
  ELSE 'L' || lpad((cast(substr(name, 2) AS int) + 3)::varchar, cast(greatest(3, length((cast(substr(name, 2) AS int) + 3)::varchar)) AS int), '0') END AS next_name FROM lots""")
def _(t):
    return t.lots.select("lot_id", X.next_name(F.col("name"), F.lit(3)).alias("next_name"))


@query("fn_name_pattern", """
SELECT lot_id, block || '-' || CASE s WHEN 0 THEN 'Disponivel' WHEN 1 THEN 'Vendido' WHEN 2 THEN 'Reservado' WHEN 3 THEN 'Bloqueado' ELSE '' END || '-L' || CASE WHEN k < 100 THEN lpad(k::varchar, 2, '0') ELSE k::varchar END AS new_name FROM lots""")
def _(t):
    label = C.by_index(C.STATUS_LABELS, F.col("s"), "")
    return t.lots.select("lot_id", X.name_from_pattern("{q}-{s}-L{n}", F.col("k"), 2, F.col("block"), label).alias("new_name"))


@query("fn_clamp_style", """
SELECT event_id, greatest(0.2, least(1.0, value / 50))::double AS opacity, greatest(0.2, least(2.5, CASE WHEN event_type = 'error' THEN 0.6 ELSE value END))::double AS stroke,
  CASE WHEN event_type = 'click' THEN 'always' WHEN event_type = 'view' THEN 'hidden' ELSE 'auto' END AS label_mode, CASE WHEN event_type = 'purchase' THEN 'high' ELSE 'balanced' END AS quality FROM events""")
def _(t):
    kind = F.col("event_type")
    mode = F.when(kind == "click", " Always ").when(kind == "view", "HIDDEN").otherwise(kind)
    stroke = F.when(kind == "error", "thick").otherwise(F.col("value").cast("string"))
    return t.raw("events").select(
        "event_id", X.clamp_opacity((F.col("value") / 50).cast("string")).alias("opacity"), X.clamp_stroke(stroke).alias("stroke"),
        X.label_mode(mode).alias("label_mode"), X.quality_preset(F.when(kind == "purchase", " HIGH").otherwise("unknown")).alias("quality"))


@query("fn_text_box", """
SELECT l_orderkey AS line_id, min(l_quantity) AS x0, min(l_discount) AS y0, max(l_quantity + 5) AS x1, max(l_discount + 1) AS y1, round((min(l_quantity) + max(l_quantity + 5)) / 2, 9) AS cx, round((min(l_discount) + max(l_discount + 1)) / 2, 9) AS cy
FROM lineitem WHERE trim(l_returnflag) <> '' GROUP BY 1""")
def _(t):
    from parcelflow.operators.pipelines import text_boxes
    spans = t.raw("lineitem").select(F.col("l_orderkey").alias("line_id"), F.col("l_linenumber").alias("seq"), F.col("l_returnflag").alias("text"), F.col("l_quantity").alias("x0"),
                                     F.col("l_discount").alias("y0"), (F.col("l_quantity") + 5).alias("x1"), (F.col("l_discount") + 1).alias("y1"))
    b = text_boxes(spans, ["line_id"])
    return b.select("line_id", "x0", "y0", "x1", "y1", F.round("cx", 9).alias("cx"), F.round("cy", 9).alias("cy"))


@query("fn_audit_label", """
SELECT event_id, CASE action WHEN 'lot_updated' THEN 'editou um lote' WHEN 'share_link_created' THEN 'criou um link de compartilhamento' WHEN 'share_link_revoked' THEN 'revogou um link de compartilhamento'
  WHEN 'file_uploaded' THEN 'enviou um arquivo' ELSE 'executou ' || action END AS label FROM audit_events""")
def _(t):
    return t.audit_events.select("event_id", C.audit_phrase(F.col("action")).alias("label"))


@query("fn_visibility", """
SELECT l.link_id, CASE WHEN access_mode IN ('link', 'token') THEN CASE WHEN has_password THEN 'password' ELSE 'unlisted' END ELSE access_mode END AS visibility FROM share_links l JOIN projects USING (project_id)""")
def _(t):
    j = t.share_links.join(t.projects, "project_id")
    return j.select("link_id", C.visibility(F.col("access_mode"), F.col("has_password")).alias("visibility"))


@query("fn_expiry_state", f"SELECT link_id, expires_at IS NOT NULL AND expires_at <= TIMESTAMP '{NOW}' AS expired FROM share_links")
def _(t):
    return t.share_links.select("link_id", C.is_expired(F.col("expires_at"), now()).alias("expired"))


@query("fn_backoff", "SELECT delivery_id, cast(least(3600, 5 * pow(2, attempts)) AS bigint) AS wait_seconds FROM deliveries")
def _(t):
    return t.deliveries.select("delivery_id", C.backoff_seconds(F.col("attempts") + 1).alias("wait_seconds"))


@query("fn_url_allowed", r"""
WITH u AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^http:', 'https:') WHEN 2 THEN url || '#top' WHEN 3 THEN 'https://user:pw@host.example/x' WHEN 4 THEN 'https://10.0.' || page_id % 200 || '.7/hook' ELSE 'https://host.example:443/hook/' || page_id END AS url FROM pages)
SELECT page_id, regexp_full_match(url, '(?i)https://[^/?:@\[\]]+(:(443)?)?([/?].*)?') AND NOT regexp_matches(url, '[\x00-\x20\x7F\\#]') AND page_id % 6 <> 4 AS allowed FROM u""")
def _(t):
    k = F.col("page_id") % 6
    url = (F.when(k == 0, F.col("url")).when(k == 1, F.regexp_replace("url", "^http:", "https:")).when(k == 2, F.concat("url", F.lit("#top")))
           .when(k == 3, "https://user:pw@host.example/x").when(k == 4, F.concat(F.lit("https://10.0."), (F.col("page_id") % 200).cast("string"), F.lit(".7/hook")))
           .otherwise(F.concat(F.lit("https://host.example:443/hook/"), F.col("page_id").cast("string"))))
    return t.raw("pages").select("page_id", X.url_allowed(url).alias("allowed"))


@query("fn_token_hash", "SELECT doc_id, sha256(text) AS token_hash FROM documents")
def _(t):
    return t.raw("documents").select("doc_id", X.token_hash(F.col("text")).alias("token_hash"))


@query("fn_normalize_email", "SELECT c_custkey, lower(c_name) || '@example.com' AS email FROM customer")
def _(t):
    raw = F.concat(F.lit("  "), F.col("c_name"), F.lit("@Example.com "))
    return t.raw("customer").select("c_custkey", X.normalize_email(raw).alias("email"))


@query("fn_json_logs", """
SELECT event_id, cast(CASE event_id % 4 WHEN 0 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS int) AS entries, CASE event_id % 4 WHEN 0 THEN event_type WHEN 3 THEN 'b' END AS last_message FROM events""")
def _(t):
    k = F.col("event_id") % 4
    doc = (F.when(k == 0, F.concat(F.lit('[{"at":"2024-01-01T00:00:00","message":"'), F.col("event_type"), F.lit('"}]'))).when(k == 1, '[{"at": broken')
           .when(k == 2, '{"at":"x"}').otherwise('[{"message":"a"},{"message":"b"}]'))
    logs = t.raw("events").select("event_id", X.json_logs(doc).alias("logs"))
    return logs.select("event_id", F.size("logs").alias("entries"), F.try_element_at("logs", F.lit(-1))["message"].alias("last_message"))


# ---- ring expressions -------------------------------------------------------------------------

SHOELACE = "((xa*yb - xb*ya) + (xb*yc - xc*yb) + (xc*yd - xd*yc) + (xd*ya - xa*yd)) / 2"


@query("geo_open_ring", "SELECT lot_id, 4 AS open_points, round(xa + xb + xc + xd, 6) AS sum_x FROM plots")
def _(t):
    p = t.plot_rings()
    closed = F.concat("ring", F.slice("ring", 1, 1), F.slice("ring", 1, 1))
    p = p.select("lot_id", G.open_ring(closed).alias("r"))
    return p.select("lot_id", F.size("r").alias("open_points"), F.round(F.aggregate("r", F.lit(0.0), lambda a, q: a + q["x"]), 6).alias("sum_x"))


@query("geo_area", f"SELECT lot_id, round(abs({SHOELACE}), 6) AS area FROM plots")
def _(t):
    return t.plot_rings().select("lot_id", F.round(G.area(F.reverse("ring")), 6).alias("area"))


@query("geo_centroid", f"""
WITH a AS (SELECT *, {SHOELACE} AS s FROM plots)
SELECT lot_id, round(((xa+xb)*(xa*yb - xb*ya) + (xb+xc)*(xb*yc - xc*yb) + (xc+xd)*(xc*yd - xd*yc) + (xd+xa)*(xd*ya - xa*yd)) / (6*s), 6) AS x,
  round(((ya+yb)*(xa*yb - xb*ya) + (yb+yc)*(xb*yc - xc*yb) + (yc+yd)*(xc*yd - xd*yc) + (yd+ya)*(xd*ya - xa*yd)) / (6*s), 6) AS y FROM a""")
def _(t):
    p = t.plot_rings().select("lot_id", G.centroid(F.col("ring")).alias("c"))
    return p.select("lot_id", F.round("c.x", 6).alias("x"), F.round("c.y", 6).alias("y"))


@query("geo_vertex_mean", "SELECT lot_id, round((xa+xb+xc+xd)/4, 6) AS x, round((ya+yb+yc+yd)/4, 6) AS y FROM plots")
def _(t):
    p = t.plot_rings().select("lot_id", G.vertex_mean(F.col("ring")).alias("c"))
    return p.select("lot_id", F.round("c.x", 6).alias("x"), F.round("c.y", 6).alias("y"))


@query("geo_point_in_ring", """
WITH q AS (SELECT *, xa + 8.3 AS px, ya - 1 + (lot_id % 16) AS py FROM plots),
e AS (SELECT lot_id, px, py, unnest([{'xa': xa, 'ya': ya, 'xb': xb, 'yb': yb}, {'xa': xb, 'ya': yb, 'xb': xc, 'yb': yc}, {'xa': xc, 'ya': yc, 'xb': xd, 'yb': yd}, {'xa': xd, 'ya': yd, 'xb': xa, 'yb': ya}], recursive := true) FROM q)
SELECT lot_id, count(*) FILTER ((ya > py) <> (yb > py) AND px < (xb - xa) * (py - ya) / nullif(yb - ya, 0) + xa) % 2 = 1 AS inside FROM e GROUP BY lot_id""")
def _(t):
    p = t.plot_rings()
    first = F.get("ring", F.lit(0))
    px, py = first["x"] + 8.3, first["y"] - 1 + (F.col("lot_id") % 16)
    return p.select("lot_id", G.point_in_ring(px, py, F.col("ring")).alias("inside"))


@query("geo_point_segment", """
WITH q AS (SELECT lot_id, xa + (lot_id % 30) - 4 AS px, ya - 3.0 AS py, xa, ya, xb, yb, ((xa + (lot_id % 30) - 4 - xa) * (xb - xa) + (ya - 3.0 - ya) * (yb - ya)) / ((xb - xa) * (xb - xa) + (yb - ya) * (yb - ya)) AS t FROM plots)
SELECT lot_id, round(t, 6) AS t, round(sqrt(pow(px - (xa + (xb - xa) * greatest(0, least(1, t))), 2) + pow(py - (ya + (yb - ya) * greatest(0, least(1, t))), 2)), 6) AS d FROM q""")
def _(t):
    p = t.plots
    f = p.select("lot_id", G.segment_foot(p.xa + (p.lot_id % 30) - 4, p.ya - 3.0, p.xa, p.ya, p.xb, p.yb).alias("f"))
    return f.select("lot_id", F.round("f.t", 6).alias("t"), F.round("f.d", 6).alias("d"))


@query("geo_edge_angle", """
WITH e AS (SELECT lot_id, unnest([{'i': 0, 'x': xb - xa, 'y': yb - ya}, {'i': 1, 'x': xc - xb, 'y': yc - yb}, {'i': 2, 'x': xd - xc, 'y': yd - yc}, {'i': 3, 'x': xa - xd, 'y': ya - yd}]) AS e FROM plots),
m AS (SELECT lot_id, arg_max(e, (sqrt(e.x * e.x + e.y * e.y), -e.i)) AS e FROM e GROUP BY 1), d AS (SELECT lot_id, degrees(atan2(e.y, e.x)) AS deg FROM m)
SELECT lot_id, round(CASE WHEN deg <= -90 THEN deg + 180 WHEN deg > 90 THEN deg - 180 ELSE deg END, 6) + 0.0 AS angle FROM d""")
def _(t):
    return t.plot_rings().select("lot_id", (F.round(G.edge_angle(F.col("ring")), 6) + F.lit(0.0)).alias("angle"))


RECT_SQL = """v AS (SELECT lot_id, sheet_id, unnest([{'x': xa, 'y': ya}, {'x': xb, 'y': yb}, {'x': xc, 'y': yc}, {'x': xd, 'y': yd}]) AS p FROM plots),
dirs AS (SELECT lot_id, unnest([{'x': xb - xa, 'y': yb - ya}, {'x': xc - xb, 'y': yc - yb}, {'x': xd - xc, 'y': yd - yc}, {'x': xa - xd, 'y': ya - yd}, {'x': xc - xa, 'y': yc - ya}, {'x': xd - xb, 'y': yd - yb}]) AS d FROM plots),
ext AS (SELECT lot_id, d, max(p.x * d.x + p.y * d.y) - min(p.x * d.x + p.y * d.y) AS w, max(p.y * d.x - p.x * d.y) - min(p.y * d.x - p.x * d.y) AS h, d.x * d.x + d.y * d.y AS n FROM dirs JOIN v USING (lot_id) GROUP BY ALL),
rect AS (SELECT lot_id, arg_min(least(w, h) / sqrt(n), w * h / n) AS short, arg_min(greatest(w, h) / sqrt(n), w * h / n) AS long, min(w * h / n) AS area FROM ext GROUP BY 1)"""


@query("geo_oriented_rect", f"WITH {RECT_SQL} SELECT lot_id, round(area, 5) AS area FROM rect")
def _(t):
    r = t.plot_rings().select("lot_id", G.oriented_rect(F.col("ring")).alias("r"))
    return r.select("lot_id", F.round("r.area", 5).alias("area"))


@query("geo_angle_distance", "SELECT event_id, round(least((value * 7) % 180, 180 - (value * 7) % 180), 6) AS distance FROM events")
def _(t):
    d = G.angle_distance(F.col("value") * 8 + 360, F.col("value"))
    return t.raw("events").select("event_id", F.round(d, 6).alias("distance"))


@query("geo_corner_count", "SELECT lot_id, 5 AS corners FROM plots")
def _(t):
    # A midpoint on every side must not count as a corner.
    mids = F.flatten(F.transform(G.edges(F.col("ring")), lambda e: F.array(
        G.point(e["ax"], e["ay"]), G.point((e["ax"] + e["bx"]) / 2, (e["ay"] + e["by"]) / 2))))
    return t.plot_rings().select("lot_id", mids.alias("ring")).select("lot_id", G.corner_count(F.col("ring")).alias("corners"))


@query("geo_looks_like_lot", f"WITH {RECT_SQL} SELECT lot_id, round(abs({SHOELACE}) / area, 6) AS fill, abs({SHOELACE}) / area >= 0.62 AS looks_like_lot FROM plots JOIN rect USING (lot_id)")
def _(t):
    p = t.plot_rings().withColumn("r", G.oriented_rect(F.col("ring")))
    return p.select("lot_id", F.round(F.col("area_px") / F.col("r.area"), 6).alias("fill"), G.looks_like_lot(F.col("ring"), F.col("area_px"), F.col("r")).alias("looks_like_lot"))


@query("geo_translate_rotate", """
SELECT lot_id, round(1000 - (yc + 4.5 - 10), 4) AS rx, round(10 + (xc - 3.25 - 1000), 4) AS ry FROM plots""")
def _(t):
    p = t.plot_rings()
    moved = G.translate(F.col("ring"), F.lit(-3.25), F.lit(4.5))
    p = p.select("lot_id", moved.alias("m")).select("lot_id", G.rotate(F.col("m"), 90.0, F.lit(1000.0), F.lit(10.0)).alias("r"))
    third = F.get("r", F.lit(2))
    return p.select("lot_id", F.round(third["x"], 4).alias("rx"), F.round(third["y"], 4).alias("ry"))


@query("geo_scale_flip", """
WITH b AS (SELECT lot_id, xc, yc, least(xa, xb, xc, xd) AS x0, greatest(xa, xb, xc, xd) AS x1, least(ya, yb, yc, yd) AS y0, greatest(ya, yb, yc, yd) AS y1 FROM plots)
SELECT lot_id, round((x0 + x1) / 2 + (xc - (x0 + x1) / 2) * 2, 6) AS sx, round((y0 + y1) / 2 + (yc - (y0 + y1) / 2) * 0.5, 6) AS sy, round(x0 + x1 - xc, 6) AS fx, round(y0 + y1 - yc, 6) AS fy, round(x0 + (xc - x0) * 40 / (x1 - x0), 6) AS wx FROM b""")
def _(t):
    p = t.plot_rings()
    box = {c[1:]: F.col(c) for c in ("bx0", "by0", "bx1", "by1")}
    ox, oy = G.origin(box)
    lx, ly = G.origin(box, "tl")
    width = F.lit(40.0) / (box["x1"] - box["x0"])
    p = p.select("lot_id", F.get(G.scale(F.col("ring"), F.lit(2.0), F.lit(0.5), ox, oy), F.lit(2)).alias("s"), F.get(G.flip(F.col("ring"), "h", ox, oy), F.lit(2)).alias("h"),
                 F.get(G.flip(F.col("ring"), "v", ox, oy), F.lit(2)).alias("v"), F.get(G.scale(F.col("ring"), width, width, lx, ly), F.lit(2)).alias("w"))
    r = lambda c, n: F.round(c, 6).alias(n)
    return p.select("lot_id", r("s.x", "sx"), r("s.y", "sy"), r("h.x", "fx"), r("v.y", "fy"), r("w.x", "wx"))


@query("geo_page_to_canvas", "SELECT lot_id, round((xc - 5) * 1.5 - 12, 4) AS x, round((yc - 7) * 1.5 - 20, 4) AS y FROM plots")
def _(t):
    p = t.plot_rings().select("lot_id", F.get(G.page_to_canvas(F.col("ring"), 5, 7, 1.5, 12, 20), F.lit(2)).alias("p"))
    return p.select("lot_id", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"))


@query("geo_snap_grid", """
WITH s AS (SELECT lot_id, round_even(xa / 2.5, 0) * 2.5 AS ax, round_even(ya / 2.5, 0) * 2.5 AS ay, round_even(xd / 2.5, 0) * 2.5 AS bx, round_even((ya + (lot_id % 4)) / 2.5, 0) * 2.5 AS b_y FROM plots)
SELECT lot_id, ax, ay, bx, b_y AS "by" FROM s WHERE (ax - bx) * (ax - bx) + (ay - b_y) * (ay - b_y) > 1""")
def _(t):
    from parcelflow.operators.faces import snap_segments
    p = t.plots
    seg = p.select("lot_id", p.xa.alias("ax"), p.ya.alias("ay"), p.xd.alias("bx"), (p.ya + (p.lot_id % 4)).alias("by"))
    return snap_segments(seg, F.lit(2.5))


@query("geo_tessellate", """
WITH c AS (SELECT lot_id, sqrt((xd - xa)**2 + (yd - ya)**2) AS chord, abs((xb - xa) * (yd - ya) - (yb - ya) * (xd - xa)) AS f1, abs((xc - xa) * (yd - ya) - (yc - ya) * (xd - xa)) AS f2 FROM plots)
SELECT lot_id, cast(least(64, greatest(2, ceil(sqrt((f1 + f2) / chord / 0.08) * 4))) AS int) AS steps FROM c""")
def _(t):
    p = t.spread(t.plots)
    coords = F.array(*[F.col(b + a) for a in "abcd" for b in "xy"])
    return p.select("lot_id", coords.alias("c")).select("lot_id", F.size(G.path_segments(G.drawing_path(F.lit("c"), F.col("c")))).alias("steps"))
