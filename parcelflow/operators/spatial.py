"""Spatial joins as equi-joins on grid cells plus an exact test.

A box is filed at the level whose cell side (a power of two) is at least its own longer side,
so it covers four cells at most, whatever its size. The other side looks it up at every level in use. A
giant polygon among small ones therefore costs four rows, and no group is ever paired with
itself in full. Rows pair up in the one cell that holds the lower-left corner of the common
box, so there is nothing to de-duplicate afterwards. A crowded cell is dealt into tiles by
the number of its pairs.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from parcelflow.functions import geometry as G
from parcelflow.functions.let import with_computed
from parcelflow.operators.grouped import first_rows
from parcelflow.session import at_once, cut

MIN_LEVEL = -20
TILE = 4096
BOX = ("bx0", "by0", "bx1", "by1")


def shape_columns(df: DataFrame) -> list[str]:
    """What a ring relation is read by: ring, holes where it has them, and box."""
    return ["ring", *(["holes"] if "holes" in df.columns else []), *BOX]


def as_points(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    return df.withColumns({"bx0": px, "by0": py, "bx1": px, "by1": py})


def grow(df: DataFrame, margin: Column | float) -> DataFrame:
    m = F.lit(margin) if isinstance(margin, (int, float)) else margin
    return df.withColumns({"bx0": F.col("bx0") - m, "by0": F.col("by0") - m,
                           "bx1": F.col("bx1") + m, "by1": F.col("by1") + m})


def _level() -> Column:
    side = F.greatest(F.col("bx1") - F.col("bx0"), F.col("by1") - F.col("by0"), F.lit(2.0 ** MIN_LEVEL))
    return F.coalesce(F.ceil(F.log2(side)).cast("int"), F.lit(0))


def _file_in_cells(rows: DataFrame) -> DataFrame:
    size = F.pow(F.lit(2.0), F.col("_level"))
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size))
    return rows.withColumn("_cx", F.explode(span("bx0", "bx1"))).withColumn("_cy", F.explode(span("by0", "by1")))


def _levels_of(*sides: DataFrame) -> list[list[int]]:
    """The levels in use on each side, found by one job over the box columns alone.

    There are a few of them at most (one per power of two between the smallest and the largest
    box), and as literals they keep the join's plan free of a second copy of its input.
    """
    tagged = [rows.select(F.lit(i).alias("i"), _level().alias("l")) for i, rows in enumerate(sides)]
    found = reduce(DataFrame.union, tagged).distinct().collect()
    return [sorted(r.l for r in found if r.i == i) for i in range(len(sides))]


def _cells(filed: DataFrame, lookup: DataFrame, levels: list[int], flipped: bool) -> tuple[DataFrame, DataFrame]:
    """Both sides in their cells: ``filed`` at its own level, ``lookup`` at that level (or only above its own level)."""
    used = F.array(*[F.lit(v) for v in levels]).cast("array<int>")
    wanted = F.filter(used, lambda v: (v > F.col("_own")) if flipped else (v >= F.col("_own")))
    probes = lookup.withColumn("_own", _level()).withColumn("_level", F.explode(wanted))
    return _file_in_cells(filed.withColumn("_level", _level())), _file_in_cells(probes)


def _tiled(a: DataFrame, b: DataFrame, key: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Deals the rows of crowded cells into tiles of at most ``TILE`` rows a side, so that no task gets more than ``TILE`` squared pairs of one cell.
    A row's tile is a hash of the row, so a repeated task deals alike.

    Adaptive execution splits a skewed cell by its bytes; boxes are small, and a cell of few MB can hold billions of pairs.
    """
    cell = [key, "_level", "_cx", "_cy"]
    count = lambda df, name: df.groupBy(*cell).agg(F.count("*").alias(name)).where(F.col(name) > 1)
    full = count(a, "_na").hint("merge").join(count(b, "_nb"), cell).where(F.col("_na") * F.col("_nb") > TILE * TILE)
    full = cut(full.select(*cell, F.ceil(F.col("_na") / TILE).alias("_pa"), F.ceil(F.col("_nb") / TILE).alias("_pb")))
    if full.isEmpty():
        return a, b, cell

    def dealt(df: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        rows = df.join(full, cell, "left")
        parts, spread = F.coalesce(own, F.lit(1)), F.coalesce(other, F.lit(1))
        return rows.withColumn(mine, F.pmod(F.xxhash64(*df.columns), parts)).withColumn(
            theirs, F.explode(F.sequence(F.lit(0).cast("bigint"), spread - 1))).drop("_pa", "_pb")

    return dealt(a, "_pa", "_pb", "_ta", "_tb"), dealt(b, "_pb", "_pa", "_tb", "_ta"), [*cell, "_ta", "_tb"]


def _one_way(filed: DataFrame, lookup: DataFrame, key: str, flipped: bool, levels: list[int] | None = None, tiles: bool = False) -> DataFrame:
    """``filed`` at its own level against ``lookup`` at that level (or only above its own level)."""
    a, b = _cells(filed, lookup, _levels_of(filed)[0] if levels is None else levels, flipped)
    a, b, on = _tiled(a, b, key) if tiles else (a, b, [key, "_level", "_cx", "_cy"])
    # Columns keep their own names until after the join, so Catalyst prunes those nobody reads.
    tagged = lambda df, tag, names: df.select(*on, *[F.col(c).alias(tag + c) for c in names])
    a, b = tagged(a, "_a_", filed.columns), tagged(b, "_b_", lookup.columns)
    size = F.pow(F.lit(2.0), F.col("_level"))
    corner = lambda c: F.floor(F.greatest("_a_" + c, "_b_" + c) / size)
    below = lambda lo, hi: F.col(lo) <= F.col(hi)
    touching = (below("_a_bx0", "_b_bx1") & below("_b_bx0", "_a_bx1") & below("_a_by0", "_b_by1") & below("_b_by0", "_a_by1"))
    # Rows multiply as they are filed, which size estimates do not see: a broadcast would take many times its limit through the driver.
    pairs = a.hint("merge").join(b, on).where(touching & (F.col("_cx") == corner("bx0")) & (F.col("_cy") == corner("by0")))
    of_a = F.struct(*[F.col("_a_" + c).alias(c) for c in filed.columns])
    of_b = F.struct(*[F.col("_b_" + c).alias(c) for c in lookup.columns])
    left, right = (of_a, of_b) if flipped else (of_b, of_a)
    return pairs.select(left.alias("l"), right.alias("r"))


def box_join(left: DataFrame, right: DataFrame, key: str, written: bool = False) -> DataFrame:
    """All (left, right) pairs of one ``key`` whose boxes touch, as structs ``l`` and ``r``.

    Both sides are written once and read from there by everything below, unless the caller says that they already are (``written``).
    """
    if not written:
        same = left is right
        a, b = left, right
        left, right = [cut(a)] * 2 if same else at_once(lambda: cut(a), lambda: cut(b))
    levels = _levels_of(left, right)
    ways = at_once(lambda: _one_way(right, left, key, False, levels[1], True), lambda: _one_way(left, right, key, True, levels[0], True))
    return ways[0].unionByName(ways[1])


def boxes_at_points(points: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """Pairs of a point (``x``, ``y``) and a box that holds it, sides included."""
    return _one_way(boxes, as_points(points), key, flipped=False)


def points_in_rings(points: DataFrame, rings: DataFrame, key: str, boundary: bool = True) -> DataFrame:
    """Pairs of a point (``x``, ``y``) and a ring that holds it. ``boundary`` tells whether a point
    on the outline counts. Where the rings have ``holes``, a point in a hole is not held."""
    pairs = boxes_at_points(points, rings, key)
    test, hole_test = (G.covers, G.contains_strict) if boundary else (G.contains_strict, G.covers)
    x, y = F.col("l.x"), F.col("l.y")
    held = test(x, y, F.col("r.ring"))
    if "holes" in rings.columns:
        held = held & ~F.exists("r.holes", lambda h: hole_test(x, y, h))
    return pairs.where(held)


def rings_within(left: DataFrame, right: DataFrame, key: str, distance: float, not_self: Column | None = None) -> DataFrame:
    """Pairs of rings at most ``distance`` apart, with their ``gap``."""
    pairs = box_join(grow(left, distance), right, key)
    if not_self is not None:
        pairs = pairs.where(not_self)
    return with_computed(pairs, "gap", G.ring_gap(F.col("l.ring"), F.col("r.ring")), lambda g: g <= distance)


def overlaps(left: DataFrame, right: DataFrame, key: str, not_self: Column | None = None) -> DataFrame:
    """Pairs with a common area: intersection, ratio to the smaller ring and to the left ring.

    Exact for simple rings of any shape, and without their ``holes`` where there are such.
    """
    pairs = box_join(left, right, key)
    if not_self is not None:
        pairs = pairs.where(not_self)
    shared = G.common_area(F.col("l.ring"), F.col("r.ring"))
    if "holes" in left.columns or "holes" in right.columns:
        holes = lambda df, side: F.col(f"{side}.holes") if "holes" in df.columns else F.filter(F.array(F.col(f"{side}.ring")), lambda h: F.lit(False))
        l_holes, r_holes = holes(left, "l"), holes(right, "r")
        shared = F.when((F.size(l_holes) == 0) & (F.size(r_holes) == 0), shared).otherwise(
            G.common_area_holed(F.col("l.ring"), l_holes, F.col("r.ring"), r_holes))
    meets = lambda lo, hi: (F.col(f"l.{lo}") < F.col(f"r.{hi}")) & (F.col(f"r.{lo}") < F.col(f"l.{hi}"))
    # boxes that only touch share no area
    pairs = with_computed(pairs, "inter_area", F.when(meets("bx0", "bx1") & meets("by0", "by1"), shared).otherwise(F.lit(0.0)))
    la, ra = F.col("l.area_px"), F.col("r.area_px")
    return pairs.select(
        "l", "r", "inter_area",
        (F.col("inter_area") / F.greatest(F.lit(1.0), F.least(la, ra))).alias("ratio_min"),
        (F.col("inter_area") / F.nullif(la, F.lit(0.0))).alias("ratio_left"))


def nearest_k(queries: DataFrame, points: DataFrame, key: str, query_id: str, point_id: str, k: int,
              max_distance: str | None = None) -> DataFrame:
    """The ``k`` nearest points (columns ``x``, ``y``) of every query point: pairs ``l``, ``r`` with ``dist``.

    Points are counted per cell on a ladder of levels. The first level at which the query's own
    cell and its eight neighbours hold ``k`` points bounds their distance by two cell diagonals, and only
    points within that bound are compared. The ladder starts at the spacing of the densest cells, not of the
    average. A query in a group with fewer than ``k`` points sees all of them.
    """
    # Both sides are read several times below.
    queries, points = cut(queries), cut(points)
    stats = points.groupBy(key).agg(
        F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))
    spacing = F.sqrt(F.greatest(F.col("w") * F.col("h"), F.lit(1.0)) / F.col("n"))
    span = lambda df: df.agg(F.coalesce(F.max(F.abs("x")) + F.max(F.abs("y")), F.lit(0.0)).alias("m")).first().m
    reach = span(queries) + span(points)
    average = stats.agg(F.floor(F.log2(F.min(spacing))).cast("int").alias("l")).first().l or 0
    # in the fullest cell of that level the points are so much closer: a level less for each factor of four
    at = lambda c: F.floor(F.col(c) / 2.0 ** average)
    fullest = points.groupBy(key, at("x"), at("y")).count().agg(F.coalesce(F.max("count"), F.lit(1)).alias("n")).first().n
    low = average - max(0, math.ceil(math.log2(max(1, fullest / k)) / 2))
    # A given maximum distance makes coarser levels pointless: they could not tighten the bound.
    farthest = queries.agg(F.max(max_distance).alias("m")).first().m if max_distance else reach
    top = math.ceil(math.log2(max(min(reach, farthest or reach), 1.0))) + 1
    ladder = F.array(*[F.lit(v) for v in range(min(low, top), top + 1)])
    cell = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_lv")))
    counts = points.select(key, "x", "y", F.explode(ladder).alias("_lv")).groupBy(
        key, "_lv", cell("x").alias("_cx"), cell("y").alias("_cy")).agg(F.count("*").alias("_n"))
    # a cell's count goes to the nine cells around it, where queries find the sum
    beside = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)).alias(c)
    around = counts.select(key, "_lv", "_n", "_cx", beside("_cy")).select(key, "_lv", "_n", "_cy", beside("_cx")).groupBy(
        key, "_lv", "_cx", "_cy").agg(F.sum("_n").alias("_n")).where(F.col("_n") >= k)
    own = queries.select(key, query_id, "x", "y", F.explode(ladder).alias("_lv")).select(
        key, query_id, "_lv", cell("x").alias("_cx"), cell("y").alias("_cy"))
    level = own.join(around, [key, "_lv", "_cx", "_cy"]).groupBy(key, query_id).agg(F.min("_lv").alias("_lv"))
    bound = F.coalesce(F.pow(F.lit(2.0), F.col("_lv")) * 2.8284271247462, F.lit(2 * reach))
    if max_distance:
        bound = F.least(bound, F.col(max_distance))
    sized = cut(queries.join(level, [key, query_id], "left").withColumn("_r", bound * 1.0000001))
    around = grow(as_points(sized), F.col("_r"))
    pairs = box_join(around, as_points(points), key).withColumn(
        "dist", F.round(F.hypot(F.col("l.x") - F.col("r.x"), F.col("l.y") - F.col("r.y")), 9)).where(F.col("dist") <= F.col("l._r"))
    ranked = pairs.withColumns({"_k": F.col(f"l.{key}"), "_q": F.col(f"l.{query_id}")})
    return first_rows(ranked, ["_k", "_q"], [F.col("dist"), F.col(f"r.{point_id}")], k).drop("_k", "_q")


def ring_edges(rings: DataFrame, key: str, ring_id: str) -> DataFrame:
    """One row per side of every ring, with its box."""
    e = rings.select(key, ring_id, F.posexplode(G.edges(F.col("ring"))).alias("edge", "e")).select(key, ring_id, "edge", "e.*")
    return e.withColumns({"bx0": F.least("ax", "bx"), "by0": F.least("ay", "by"),
                          "bx1": F.greatest("ax", "bx"), "by1": F.greatest("ay", "by")})


# Fixed order of the snap kinds.
SNAP_KINDS = ("vertex", "mid", "edge")


def snap_points(points: DataFrame, edges: DataFrame, key: str, point_id: str, ring_id: str, tolerance: float) -> DataFrame:
    """Best snap per point: vertices before midpoints before edges, then the nearest, then the lower ring and edge."""
    pairs = box_join(grow(as_points(points), tolerance), edges, key)
    px, py = F.col("l.x"), F.col("l.y")
    ax, ay, bx, by = (F.col(f"r.{c}") for c in ("ax", "ay", "bx", "by"))
    mx, my = (ax + bx) / 2, (ay + by) / 2
    foot = G.segment_foot(px, py, ax, ay, bx, by)
    pairs = pairs.withColumn("_f", foot)
    option = lambda kind, x, y, d, ok: F.when(ok & (d <= tolerance), F.struct(
        F.lit(kind).alias("kind"), F.round(d, 9).alias("d"), F.col(f"r.{ring_id}").alias("ring"), F.col("r.edge").alias("edge"),
        x.alias("x"), y.alias("y")))
    t = F.col("_f.t")
    options = F.array_compact(F.array(
        option(0, ax, ay, F.hypot(px - ax, py - ay), F.lit(True)),
        option(1, mx, my, F.hypot(px - mx, py - my), F.lit(True)),
        option(2, F.col("_f.x"), F.col("_f.y"), F.col("_f.d"), (t > 0.02) & (t < 0.98))))
    best = pairs.select(F.col(f"l.{key}").alias(key), F.col(f"l.{point_id}").alias(point_id), F.explode(options).alias("o"))
    return best.groupBy(key, point_id).agg(F.min("o").alias("o")).select(
        key, point_id, F.get(F.array(*[F.lit(k) for k in SNAP_KINDS]), F.col("o.kind")).alias("kind"),
        F.col("o.ring").alias("ring_id"), F.col("o.edge").alias("edge"), F.col("o.x").alias("sx"),
        F.col("o.y").alias("sy"), F.col("o.d").alias("dist"))


def segment_crossings(segments: DataFrame, key: str, segment_id: str) -> DataFrame:
    """Proper crossings of two segments, each pair once."""
    pairs = box_join(segments, segments, key).where(F.col(f"l.{segment_id}") < F.col(f"r.{segment_id}"))
    c = [F.col(f"{s}.{v}") for s in ("l", "r") for v in ("ax", "ay", "bx", "by")]
    return pairs.withColumn("hit", G.crossing_params(*c)).where(F.col("hit").isNotNull())


def project(ring: Column, ux: Column, uy: Column) -> Column:
    """Extent of a ring along the direction (ux, uy)."""
    d = F.transform(ring, lambda p: p["x"] * ux + p["y"] * uy)
    return F.struct(F.array_min(d).alias("lo"), F.array_max(d).alias("hi"))


def with_axes(rings: DataFrame) -> DataFrame:
    """One row per own axis of a ring (0: longest edge, 1: across), with its extents along and across."""
    angle = F.radians(G.edge_angle(F.col("ring")))
    axes = F.array(F.struct(F.lit(0).alias("axis"), F.cos("_a").alias("ux"), F.sin("_a").alias("uy")),
                   F.struct(F.lit(1).alias("axis"), (-F.sin("_a")).alias("ux"), F.cos("_a").alias("uy")))
    rows = rings.withColumn("_a", angle).withColumn("_ax", F.explode(axes)).select(*rings.columns, "_ax.*")
    rows = rows.withColumn("_pu", project(F.col("ring"), F.col("ux"), F.col("uy"))).withColumn(
        "_pv", project(F.col("ring"), -F.col("uy"), F.col("ux")))
    return rows.select(*rings.columns, "axis", "ux", "uy", F.col("_pu.lo").alias("ulo"), F.col("_pu.hi").alias("uhi"),
                       F.col("_pv.lo").alias("vlo"), F.col("_pv.hi").alias("vhi"))


def neighbours(rings: DataFrame, key: str, ring_id: str) -> DataFrame:
    """Next ring of the same row along each own axis, in both directions.

    Same row: the extents across overlap by 35 % of the smaller one. The neighbour lies on the
    wanted side and its gap is within reach; the smallest absolute gap wins, then the lower id.
    """
    axes = with_axes(rings)
    reach = F.greatest((F.col("uhi") - F.col("ulo")) * 2.5, F.col("vhi") - F.col("vlo"), F.lit(4.0))
    pairs = box_join(grow(axes.withColumn("reach", reach), F.col("reach")), rings, key).where(
        F.col(f"l.{ring_id}") != F.col(f"r.{ring_id}"))
    # the box around the other ring, seen across the axis: most candidates are not in the row at all, and no ring is touched for them
    half = (F.abs("l.uy") * (F.col("r.bx1") - F.col("r.bx0")) + F.abs("l.ux") * (F.col("r.by1") - F.col("r.by0"))) / 2
    across = (F.col("l.ux") * (F.col("r.by0") + F.col("r.by1")) - F.col("l.uy") * (F.col("r.bx0") + F.col("r.bx1"))) / 2
    pairs = pairs.where((across + half > F.col("l.vlo") + 1e-9) & (across - half < F.col("l.vhi") - 1e-9))
    extents = F.struct(project(F.col("r.ring"), F.col("l.ux"), F.col("l.uy")).alias("u"), project(F.col("r.ring"), -F.col("l.uy"), F.col("l.ux")).alias("v"))

    def same_row(q: Column) -> Column:
        shared = F.least("l.vhi", q["v"]["hi"]) - F.greatest("l.vlo", q["v"]["lo"])
        return shared >= F.least(F.col("l.vhi") - F.col("l.vlo"), q["v"]["hi"] - q["v"]["lo"]) * 0.35

    pairs = with_computed(pairs, "_q", extents, same_row)
    lo, hi = F.col("_q.u.lo"), F.col("_q.u.hi")
    side = F.signum((lo + hi) - (F.col("l.ulo") + F.col("l.uhi"))).cast("int")
    pairs = pairs.withColumn("sign", side).where(F.col("sign") != 0)
    gap = F.when(F.col("sign") > 0, lo - F.col("l.uhi")).otherwise(F.col("l.ulo") - hi)
    edge = F.when(F.col("sign") > 0, lo).otherwise(hi)
    kept = pairs.withColumn("gap", gap).where(F.col("gap") <= F.col("l.reach"))
    best = F.struct(F.abs("gap").alias("score"), F.col(f"r.{ring_id}").alias("other"), F.col("gap").alias("gap"), edge.alias("edge"))
    return kept.groupBy(F.col(f"l.{key}").alias(key), F.col(f"l.{ring_id}").alias(ring_id), F.col("l.axis").alias("axis"), "sign").agg(
        F.min(best).alias("b")).select(key, ring_id, "axis", "sign", "b.other", "b.gap", "b.edge")
