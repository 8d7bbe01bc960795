"""Planar faces of line drawings, by half-edges and pointer doubling.

A sheet is never assembled in one task: segments are cut where they meet (a spatial
self-join), every half-edge learns its successor from the angles at its end node, and the
half-edges of a face find their common smallest id in log2(longest face) joins. The outline of a
part that touches nothing else becomes a hole of the smallest face around it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelflow.adapters import with_shape
from parcelflow.functions import geometry as G
from parcelflow.functions.let import once
from parcelflow.operators.grouped import pick_row
from parcelflow.operators.spatial import as_points, box_join, boxes_at_points, grow, points_in_rings
from parcelflow.session import cut

NODE_SCALE = 1_000_000
SNAP_STEPS = (None, 0.50, 0.75, 1.00, 1.25, 1.75)


def snap_segments(segments: DataFrame, grid: Column, min_length_sq: float = 1.0) -> DataFrame:
    """End points rounded to the grid (half to even), without what becomes too short. A null grid changes nothing."""
    # like bround, which goes through decimal texts; adding zero makes -0.0 0.0
    snap = lambda c: F.coalesce((F.rint(F.col(c) / grid) + 0.0) * grid, F.col(c)).alias(c)
    ends = ("ax", "ay", "bx", "by")
    rows = segments.select(*[c for c in segments.columns if c not in ends], *[snap(c) for c in ends], grid.isNull().alias("_raw"))
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    return rows.where(F.col("_raw") | (dx * dx + dy * dy > min_length_sq)).drop("_raw")


def segment_boxes(segments: DataFrame) -> DataFrame:
    return segments.withColumns({"bx0": F.least("ax", "bx"), "by0": F.least("ay", "by"), "bx1": F.greatest("ax", "bx"), "by1": F.greatest("ay", "by")})


def _node(x: Column, y: Column) -> list[Column]:
    """Coordinates in millionths, half away from zero, as ``round`` gives them by way of decimal texts."""
    # the number below 0.5, so that a sum that is itself rounded lifts nothing below a half; from 2^52 on every number is whole
    up = lambda v: F.when(F.abs(v) < 2.0 ** 52, F.signum(v) * F.floor(F.abs(v) + 0.49999999999999994)).otherwise(v).cast("bigint")
    return [up(x * NODE_SCALE), up(y * NODE_SCALE)]


def _undirected(segments: DataFrame, key: str) -> DataFrame:
    """Every segment from its smaller to its larger end."""
    turned = (F.col("ax") > F.col("bx")) | ((F.col("ax") == F.col("bx")) & (F.col("ay") > F.col("by")))
    end = lambda c, other: F.when(turned, F.col(other)).otherwise(F.col(c)).alias(c)
    return segments.select(key, end("ax", "bx"), end("ay", "by"), end("bx", "ax"), end("by", "ay"))


def _cut_points(pairs: DataFrame, ident: list[str], tolerance: float) -> DataFrame:
    """Parameters ``t`` at which the left segments are crossed, or touched by an end of the right one (``crossing_params``, ``foot_inside``).

    Column by column: as one expression, every product is written out many times, and the JVM does not compile code of that length.
    """
    c = F.col
    rows = pairs.select(*[c(f"l.{name}").alias(name) for name in ident], *[c(f"r.{old}").alias(new) for old, new in (("ax", "cx"), ("ay", "cy"), ("bx", "dx"), ("by", "dy"))])
    rows = rows.withColumns({"rx": c("bx") - c("ax"), "ry": c("by") - c("ay"), "sx": c("dx") - c("cx"), "sy": c("dy") - c("cy"),
                             "px": c("cx") - c("ax"), "py": c("cy") - c("ay"), "qx": c("dx") - c("ax"), "qy": c("dy") - c("ay")})
    product = lambda a, b, d, e: c(a) * c(b) - c(d) * c(e)
    rows = rows.withColumns({"den": product("rx", "sy", "ry", "sx"), "tn": product("px", "sy", "py", "sx"), "po": product("px", "ry", "py", "rx"), "qo": product("qx", "ry", "qy", "rx"),
                             "length": c("rx") * c("rx") + c("ry") * c("ry"), "pt": c("px") * c("rx") + c("py") * c("ry"), "qt": c("qx") * c("rx") + c("qy") * c("ry")})
    rows = rows.withColumns({"size": F.abs("den"), "side": F.signum("den"), "pu": c("pt") / F.nullif(c("length"), F.lit(0.0)), "qu": c("qt") / F.nullif(c("length"), F.lit(0.0))})
    within = lambda v: (c(v) * c("side") >= c("size") * 1e-9) & (c(v) * c("side") <= c("size") * (1 - 1e-9))
    crossing = F.when((c("size") >= 1e-12) & within("tn") & within("po"), c("tn") / F.nullif(c("den"), F.lit(0.0)))
    touch = lambda off, u: F.when((c(off) * c(off) <= c("length") * (tolerance * tolerance)) & (c(u) >= 1e-6) & (c(u) <= 1 - 1e-6), c(u))
    return rows.select(*ident, F.explode(F.array(crossing, touch("po", "pu"), touch("qo", "qu"))).alias("t")).where("t is not null")


def noded_edges(segments: DataFrame, key: str, tolerance: float = 1e-6) -> DataFrame:
    """Undirected edges between nodes after cutting every segment at crossings and touching ends.

    Nodes are coordinates in millionths. The pieces of a segment come from a window over its cut
    points, which spills when a line is crossed very often; nothing is collected into arrays. A segment drawn both ways,
    as the common side of two rings is, counts once.
    """
    once = cut(_undirected(segments, key).where((F.col("ax") != F.col("bx")) | (F.col("ay") != F.col("by"))).distinct())
    boxed = segment_boxes(once)
    pairs = box_join(boxed, boxed, key, written=True)
    ident = [key, "ax", "ay", "bx", "by"]
    found = _cut_points(pairs, ident, tolerance)
    marks = once.select(*ident, F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t")).unionByName(found)
    at = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * F.col("t")
    node = _node(at("ax", "bx"), at("ay", "by"))
    marks = marks.withColumns({"nx": node[0], "ny": node[1]})
    follow = Window.partitionBy(*ident).orderBy("t")
    pieces = marks.withColumns({"mx": F.lead("nx").over(follow), "my": F.lead("ny").over(follow)}).where(F.col("mx").isNotNull())
    u, v = F.struct(F.col("nx").alias("x"), F.col("ny").alias("y")), F.struct(F.col("mx").alias("x"), F.col("my").alias("y"))
    return pieces.where(u != v).select(key, F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).distinct()


def _half_edges(edges: DataFrame, key: str) -> DataFrame:
    """Both directions of every edge with the id of its successor around the face on its left."""
    both = edges.select(key, "u", "v").unionByName(edges.select(key, F.col("v").alias("u"), F.col("u").alias("v")))
    ident = lambda a, b: F.unhex(F.md5(F.to_json(F.struct(F.col(key).alias("k"), a.alias("a"), b.alias("b")))))
    heading = F.atan2((F.col("v.y") - F.col("u.y")).cast("double"), (F.col("v.x") - F.col("u.x")).cast("double"))
    around = Window.partitionBy(key, "u").orderBy("_h")
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = both.withColumn("_h", heading).withColumn("_cw", F.coalesce(F.lag("v").over(around), F.last("v").over(whole)))
    # A row u→v describes its twin v→u: that one arrives at u and leaves along the clockwise next edge.
    return rows.select(key, ident(F.col("v"), F.col("u")).alias("id"), ident(F.col("u"), F.col("_cw")).alias("ptr"),
                       ident(F.col("u"), F.col("v")).alias("twin"), F.col("v").alias("a"), F.col("u").alias("b"))


def _label_cycles(half: DataFrame) -> DataFrame:
    """Adds the cycle's smallest id (``face``) and the steps to it (``off``).

    Each round doubles the steps that a half-edge has seen. Where the stretch ahead has the same smallest id, the half-edge has seen its
    whole cycle: it is done. The others of its cycle are so a round later at most, so it is looked up once more and then
    left out. Small faces, nearly all there are, thus leave after a few rounds, and only long outlines go on.
    """
    state = cut(half.select("id", "ptr", F.col("id").alias("face"), F.lit(0).cast("bigint").alias("off"), F.lit(False).alias("done")))
    step, seen = 1, []
    while True:
        ahead = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("_p"), F.col("face").alias("_f"), F.col("off").alias("_o"))
        joined = state.where("NOT done").drop("done").join(ahead, "ptr")
        state = cut(joined.select("id", F.col("_p").alias("ptr"), F.least("face", "_f").alias("face"),
                                  F.when(F.col("_f") < F.col("face"), F.lit(step) + F.col("_o")).otherwise(F.col("off")).alias("off"),
                                  (F.col("_f") == F.col("face")).alias("done")))
        seen.append(state.where("done").select("id", "face", "off"))
        if state.where("NOT done").isEmpty():
            return reduce(DataFrame.unionByName, seen)
        step *= 2


def _faces_of(half: DataFrame) -> DataFrame:
    half = cut(half)
    return half.drop("ptr").join(_label_cycles(half), "id").withColumn("face", F.lower(F.hex("face")))


def face_cycles(segments: DataFrame, key: str, prune: bool = True) -> DataFrame:
    """Half-edges (``a`` → ``b``) with the ``face`` they go around and their place ``off`` in it.

    An edge with the same face on both sides bounds nothing (a loose end or a bridge). Such edges
    are dropped and the faces that they lay in traced again; that removes them all. Other faces do not change: a half-edge
    whose successor is dropped goes around the face of that successor.
    """
    edges = cut(noded_edges(segments, key))
    labelled = cut(_faces_of(_half_edges(edges, key)))
    if not prune:
        return labelled
    other = labelled.select(F.col("id").alias("twin"), F.col("face").alias("_tf"))
    useless = cut(labelled.join(other, "twin").where(F.col("face") == F.col("_tf")).select(
        key, "face", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    if useless.isEmpty():
        return labelled
    broken, dropped = useless.select(key, "face").distinct(), useless.select(key, "u", "v")
    again = labelled.join(broken, [key, "face"], "left_semi").select(key, "id", "b", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    again = cut(again.join(dropped, [key, "u", "v"], "left_anti").select(key, "id", "b"))
    # the edges around every node that such a half-edge arrives at
    nodes = again.select(key, F.col("b").alias("n")).distinct()
    at = lambda end: edges.withColumn("n", F.col(end)).join(nodes, [key, "n"], "left_semi").select(key, "u", "v")
    around = at("u").unionByName(at("v")).distinct().join(dropped, [key, "u", "v"], "left_anti")
    retraced = _faces_of(_half_edges(around, key).join(again.select("id"), "id", "left_semi"))
    return cut(labelled.join(broken, [key, "face"], "left_anti").unionByName(retraced.select(*labelled.columns)))


def _real(c: str) -> Column:
    return F.col(c).cast("double") / NODE_SCALE


def cycle_areas(labelled: DataFrame, key: str) -> DataFrame:
    """Signed area per cycle: positive for faces, negative for the outline around a component."""
    cross = _real("a.x") * _real("b.y") - _real("b.x") * _real("a.y")
    return labelled.groupBy(key, "face").agg((F.sum(cross) / 2).alias("cycle_area"))


def cycle_rings(labelled: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rings of the wanted cycles ``(key, face)``."""
    parts = labelled.join(wanted.select(key, "face"), [key, "face"], "left_semi")
    vertex = F.struct((-F.col("off")).alias("o"), _real("a.x").alias("x"), _real("a.y").alias("y"))
    rings = parts.groupBy(key, "face").agg(F.array_sort(F.collect_list(vertex)).alias("_v"))
    ring = F.transform("_v", lambda p: G.point(p["x"], p["y"]))
    return with_shape(rings.select(key, F.col("face").alias("face_id"), without_straight(ring).alias("ring")))


def cycle_boxes(labelled: DataFrame, key: str) -> DataFrame:
    """Signed area (as ``cycle_areas``) and box per cycle."""
    return labelled.groupBy(key, "face").agg(
        (F.sum(_real("a.x") * _real("b.y") - _real("b.x") * _real("a.y")) / 2).alias("cycle_area"),
        F.min(_real("a.x")).alias("bx0"), F.min(_real("a.y")).alias("by0"), F.max(_real("a.x")).alias("bx1"), F.max(_real("a.y")).alias("by1"))


def hole_parents(labelled: DataFrame, cycles: DataFrame, key: str) -> DataFrame:
    """(key, hole, hole_area, face): every outline that lies inside a face, with the smallest such face. ``cycles``: ``cycle_boxes``.

    Parts of a drawing do not touch, so one vertex tells: the leftmost one of the outline, seen along a ray to the
    left, is outside all faces of its own part. Boxes find the few faces that may hold it, and rings are
    joined to these pairs of ids afterwards.
    """
    outside = cycles.where("cycle_area < 0").select(key, "face", (-F.col("cycle_area")).alias("hole_area"))
    # a least pair is aggregated by sorting, so only the outlines' half-edges get there
    leftmost = labelled.join(outside.select(key, "face"), [key, "face"], "left_semi").groupBy(key, "face").agg(F.min(F.struct(_real("a.x").alias("x"), _real("a.y").alias("y"))).alias("p"))
    outlines = outside.join(leftmost, [key, "face"]).select(key, F.col("face").alias("hole"), F.col("p.x").alias("x"), F.col("p.y").alias("y"), "hole_area")
    around = cycles.where("cycle_area > 0").select(key, "face", "cycle_area", "bx0", "by0", "bx1", "by1")
    pairs = boxes_at_points(outlines, around, key).where(F.col("r.cycle_area") > F.col("l.hole_area"))
    pairs = cut(pairs.select(F.col(f"l.{key}").alias(key), "l.hole", "l.hole_area", "l.x", "l.y", "r.face", "r.cycle_area"))
    rings = cycle_rings(labelled, pairs.select(key, "face").distinct(), key).select(key, F.col("face_id").alias("face"), "ring")
    inside = pairs.join(rings, [key, "face"]).where(G.left_of_outline(F.col("ring"), F.col("x"), F.col("y")))
    return inside.groupBy(key, "hole", "hole_area").agg(F.min_by("face", F.struct("cycle_area", "face")).alias("face"))


def trace_faces(segments: DataFrame, key: str, min_area: float = 1e-6, max_area: float | None = None,
                prune: bool = True) -> DataFrame:
    """Bounded faces per key with their ring, ``holes`` (rings), area without these, and box.

    Only faces inside the area window, and faces that may be around a hole, are put together as rings, so the outer
    face never is.
    """
    labelled = face_cycles(segments, key, prune)
    cycles = cut(cycle_boxes(labelled, key))
    parents = cut(hole_parents(labelled, cycles, key))
    lost = parents.groupBy(key, "face").agg(F.sum("hole_area").alias("_lost"))
    sizes = cycles.where("cycle_area > 0").select(key, "face", "cycle_area").join(lost, [key, "face"], "left")
    net = F.col("cycle_area") - F.coalesce("_lost", F.lit(0.0))
    wanted = sizes.where(net >= min_area if max_area is None else net.between(min_area, max_area))
    rings = cycle_rings(labelled, wanted, key).drop("area_px", "bx0", "by0", "bx1", "by1")
    outlines = cycle_rings(labelled, parents.select(key, F.col("hole").alias("face")), key).select(key, F.col("face_id").alias("hole"), F.col("ring").alias("_r"))
    holes = parents.join(outlines, [key, "hole"]).groupBy(key, F.col("face").alias("face_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("hole", "_r"))), lambda h: h["_r"]).alias("holes"))
    none = F.filter(F.array("ring"), lambda r: F.lit(False))
    return with_shape(rings.join(holes, [key, "face_id"], "left").withColumn("holes", F.coalesce("holes", none)))


WELD_STEPS = (0.25, 0.6, 1.2)


def welded_sides(rings: DataFrame, key: str, ring_id: str) -> DataFrame:
    """Sides of the rings with every vertex moved to the first vertex within the weld distance, for
    each rung of the ladder. ``mesh`` = (key, rank)."""
    ladder = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(e).alias("eps")) for i, e in enumerate(WELD_STEPS)])
    mesh = F.struct(F.col(key).alias("sheet"), F.col("_s.rank").alias("rank")).alias("mesh")
    corners = rings.select(key, ring_id, F.posexplode("ring").alias("i", "p")).groupBy(key, F.col("p.x").alias("x"), F.col("p.y").alias("y")).agg(
        F.min(F.struct(F.col(ring_id).alias("r"), "i")).alias("ord"))
    corners = cut(corners.withColumn("_s", F.explode(ladder)).select(mesh, "x", "y", "ord", F.col("_s.eps").alias("eps")))
    near = box_join(grow(as_points(corners), F.col("eps")), as_points(corners.drop("eps")), "mesh")
    moved = near.groupBy(F.col("l.mesh").alias("mesh"), F.col("l.x").alias("x"), F.col("l.y").alias("y")).agg(
        F.min(F.struct("r.ord", "r.x", "r.y")).alias("n")).select("mesh", "x", "y", F.col("n.x").alias("nx"), F.col("n.y").alias("ny"))
    moved = cut(moved)
    sides = rings.select(key, F.explode(G.edges(F.col("ring"))).alias("e"), ladder.alias("_l")).select(key, "e.*", F.explode("_l").alias("_s")).select(mesh, "ax", "ay", "bx", "by")
    at = lambda end: moved.select("mesh", F.col("x").alias(end + "x"), F.col("y").alias(end + "y"), F.col("nx").alias(f"_{end}x"), F.col("ny").alias(f"_{end}y"))
    joined = sides.join(at("a"), ["mesh", "ax", "ay"]).join(at("b"), ["mesh", "bx", "by"])
    return joined.select("mesh", F.col("_ax").alias("ax"), F.col("_ay").alias("ay"), F.col("_bx").alias("bx"), F.col("_by").alias("by"))


def merge_adjacent(rings: DataFrame, key: str, ring_id: str) -> DataFrame:
    """Dissolves the rings of each ``key`` into one outline, or tells why not.

    Vertices are welded and the sides cut where they meet; the outline is the cycle around the
    whole. A merge stands if there is one outline and its area is at least 0.999 of the largest
    ring and at most 1.003 of the sum. The finest weld that works is used.
    """
    cycles = face_cycles(welded_sides(rings, key, ring_id), "mesh", prune=False)
    outlines = cut(cycle_areas(cycles, "mesh").where(F.col("cycle_area") < 0))
    sizes = rings.groupBy(key).agg(F.count("*").alias("members"), F.sum("area_px").alias("_sum"), F.max("area_px").alias("_max"), F.min(ring_id).alias("kept_id"))
    per = outlines.groupBy("mesh").agg(F.count("*").alias("_n"), F.sum(-F.col("cycle_area")).alias("area"), F.min("face").alias("face"))
    per = per.withColumns({key: F.col("mesh.sheet"), "rank": F.col("mesh.rank")}).join(sizes, key)
    good = (F.col("_n") == 1) & (F.col("area") >= F.col("_max") * 0.999) & (F.col("area") <= F.col("_sum") * 1.003)
    best = pick_row(per.where(good).select(key, "rank", "mesh", "face", "area"), [key], F.col("rank"), latest=False)
    outline = cycle_rings(cycles, best.select("mesh", "face"), "mesh").select(F.col("mesh.sheet").alias(key), F.reverse("ring").alias("ring"))
    judged = sizes.where("members >= 2").select(key, "members", "kept_id").join(best.select(key, "area"), key, "left").join(outline, key, "left")
    return judged.withColumn("reason", F.when(F.col("area").isNull(), "not_adjacent"))


@once
def without_straight(ring: Column, tolerance: float = 1e-7) -> Column:
    """The ring without vertices that lie on the line between their neighbours."""
    n = F.size(ring)

    def bends(p: Column, i: Column) -> Column:
        a, b = F.get(ring, (i + n - 1) % n), F.get(ring, (i + 1) % n)
        return G.segment_distance(p["x"], p["y"], a["x"], a["y"], b["x"], b["y"]) > tolerance

    return F.filter(ring, bends)


def dedupe_by_centroid(rings: DataFrame, key: str, tolerance: float, id_col: str) -> DataFrame:
    """One ring per rounded centroid: the largest, then the lowest id. Rounding is half to even."""
    c = G.holed_centroid(F.col("ring"), F.col("holes")) if "holes" in rings.columns else G.centroid(F.col("ring"))
    rows = rings.withColumn("_c", c).withColumns({"_kx": F.bround(F.col("_c.x") / tolerance), "_ky": F.bround(F.col("_c.y") / tolerance)})
    return pick_row(rows, [key, "_kx", "_ky"], F.struct((-F.col("area_px")).alias("a"), F.col(id_col).alias("i")), latest=False).drop("_kx", "_ky", "_c")


def meshes(segments: DataFrame, key: str, snaps: tuple, min_length_sq: float = 0.0001, first: int = 0) -> DataFrame:
    """All rungs of a snap ladder as one relation, keyed by ``mesh`` = (key, rank); ranks count from ``first``."""
    ladder = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(g).cast("double").alias("grid")) for i, g in enumerate(snaps, first)])
    rows = segments.select(key, "ax", "ay", "bx", "by", F.explode(ladder).alias("_s"))
    rows = rows.select(F.struct(F.col(key).alias("sheet"), F.col("_s.rank").alias("rank")).alias("mesh"), "ax", "ay", "bx", "by", F.col("_s.grid").alias("grid"))
    return snap_segments(rows, F.col("grid"), min_length_sq).drop("grid")


def face_labels(faces: DataFrame, labels: DataFrame, key: str, label_id: str, boundary: bool) -> DataFrame:
    """(face, label) pairs; ``labels`` are keyed by sheet and repeated for every mesh of ``faces``."""
    return points_in_rings(labels, faces, key, boundary)


def best_face_per_anchor(segments: DataFrame, labels: DataFrame, key: str, label_id: str, area_min: float, area_max: float,
                         snaps: tuple = SNAP_STEPS) -> DataFrame:
    """At most one compact face per label: lowest (snap rung, |1 − fill|, off-centre, corners, area).

    A face must hold exactly one label, fill 55 % of its oriented rectangle, have at most 32
    corners and its centre near the label.
    """
    low, high = min(float(area_min), 80.0), max(float(area_max), 15000.0)
    faces = trace_faces(meshes(segments, key, snaps), "mesh", low, high)
    faces = faces.withColumns({"sheet": F.col("mesh.sheet"), "rank": F.col("mesh.rank")})
    named = labels.select(F.col(key).alias("sheet"), label_id, "x", "y")
    pairs = points_in_rings(named, faces.select("sheet", "rank", "face_id", "ring", "holes", "area_px", "bx0", "by0", "bx1", "by1"), "sheet")
    per_face = pairs.groupBy("r.sheet", "r.rank", "r.face_id").agg(
        F.count("*").alias("n"), F.first("l").alias("l"), F.first("r").alias("f")).where("n = 1")
    shaped = per_face.select(F.col("f.sheet").alias("sheet"), F.col(f"l.{label_id}").alias(label_id), F.col("f.rank").alias("rank"), F.col("f.ring").alias("ring"), F.col("f.holes").alias("holes"),
                             F.col("f.area_px").alias("area_px"), F.col("l.x").alias("x"), F.col("l.y").alias("y")).withColumns({
        "_rect": G.oriented_rect(F.col("ring")), "_c": G.holed_centroid(F.col("ring"), F.col("holes")), "corners": G.corner_count(F.col("ring"))})
    shaped = shaped.withColumns({
        "fill": G.fill_ratio(F.col("area_px"), F.col("_rect")),
        "centred": F.hypot(F.col("_c.x") - F.col("x"), F.col("_c.y") - F.col("y")) / F.greatest(F.sqrt("area_px"), F.lit(1.0))})
    fit = shaped.where((F.col("fill") >= 0.55) & (F.col("corners") <= 32) & (F.col("centred") <= 0.65))
    score = F.struct("rank", F.abs(1 - F.col("fill")).alias("off_fill"), "centred", "corners", "area_px")
    best = pick_row(fit.select("sheet", label_id, "rank", "ring", "holes", "area_px", "fill", "centred", "corners"), ["sheet", label_id], score, latest=False)
    return with_shape(best.drop("area_px").withColumnRenamed("sheet", key))
