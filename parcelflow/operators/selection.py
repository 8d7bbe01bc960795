"""Bulk selection: criteria, similarity, regions, set algebra, sums, reading order, renaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelflow.functions import codes as C, geometry as G, text as X
from parcelflow.operators import quality as Q
from parcelflow.operators.grouped import group_rank, upper_median
from parcelflow.operators.spatial import as_points, points_in_rings
from parcelflow.session import cut


def lot_measures(lots: DataFrame, key: str) -> DataFrame:
    """Adds ``px_per_m2`` and ``m2``: the printed area, else pixels over the scale, else null."""
    scaled = lots.join(Q.sheet_scale(lots, key).select(key, "px_per_m2"), key, "left")
    m2 = F.when(F.col("px_per_m2") > 0, F.coalesce("printed", F.col("area_px") / F.col("px_per_m2")))
    return scaled.withColumn("m2", m2)


def select_criteria(lots: DataFrame, key: str, status: int | None = None, block: str | None = None, name: str | None = None,
                    area_min: float | None = None, area_max: float | None = None, unit: str = "m2") -> DataFrame:
    """All given criteria together. Areas are in m² where the sheet has a scale, else in px²."""
    if status is not None:
        matched = F.col("s") == status
    else:
        matched = F.lit(True)
    if block:
        matched = matched & (F.lower(F.coalesce("block", F.lit(""))) == block.lower())
    regex = X.name_search_regex(name)
    if regex:
        matched = matched & F.coalesce("name", F.lit("")).rlike(regex)
    if area_min is None and area_max is None:
        return lots.where(matched)
    # The scale comes from all lots of the sheet, so it is joined before filtering.
    rows = lot_measures(lots, key)
    value = F.when(F.col("px_per_m2").isNotNull() & F.lit(unit != "px"), F.col("m2")).otherwise(F.col("area_px"))
    if area_min is not None:
        matched = matched & (value >= area_min)
    if area_max is not None:
        matched = matched & (value <= area_max)
    return rows.where(matched).drop("px_per_m2", "m2")


def similar_lots(lots: DataFrame, references: DataFrame, key: str, kind: str, tolerance_pct: float = 5.0) -> DataFrame:
    """Lots like the reference lot of their sheet: ``block``, ``status`` or ``area`` within the tolerance.

    ``references(key, lot_id)`` names one lot per sheet.
    """
    measured = lot_measures(lots, key) if kind == "area" else lots
    value = F.coalesce("m2", "area_px") if kind == "area" else F.col("block" if kind == "block" else "s")
    measured = measured.withColumn("_v", value)
    ref = measured.join(references, [key, "lot_id"], "left_semi").select(key, F.col("_v").alias("_ref"))
    both = measured.join(ref, key)
    if kind == "block":
        return both.where((F.trim("_ref") != "") & (F.lower("_v") == F.lower("_ref"))).drop("_v", "_ref")
    if kind == "status":
        return both.where(F.col("_v") == F.col("_ref")).drop("_v", "_ref")
    tol = max(0.0, min(100.0, tolerance_pct)) / 100
    near = (F.col("_ref") > 0) & (F.col("_v") > 0) & (F.abs(F.col("_v") / F.col("_ref") - 1) <= tol)
    return both.where(near).drop("_v", "_ref")


def selection_sums(lots: DataFrame, selection: DataFrame, key: str) -> DataFrame:
    """Per selection: lots, px², m², printed sum and how many have a printed area."""
    chosen = lot_measures(lots, key).join(selection, [key, "lot_id"])
    return chosen.groupBy("selection_id").agg(
        F.count("*").alias("lots"), F.sum("area_px").alias("px"), F.sum("m2").alias("m2"),
        F.coalesce(F.sum("printed"), F.lit(0.0)).alias("printed"), F.count("printed").alias("with_area"))


def combine(current: DataFrame, hits: DataFrame, mode: str, ids: list[str]) -> DataFrame:
    """``set``, ``add`` or ``sub`` a hit list against the current selection."""
    cur, new = current.select(*ids).distinct(), hits.select(*ids).distinct()
    if mode == "sub":
        return cur.join(new, ids, "left_anti")
    return cur.unionByName(new).distinct() if mode == "add" else new


def invert(lots: DataFrame, selection: DataFrame, ids: list[str]) -> DataFrame:
    return lots.select(*ids).join(selection, ids, "left_anti")


def expand_groups(lots: DataFrame, selection: DataFrame, key: str, group: str = "group_name") -> DataFrame:
    """Selecting one member selects its whole group."""
    chosen = lots.join(selection.select(key, "lot_id"), [key, "lot_id"], "left_semi")
    grouped = F.coalesce(group, F.lit("")) != ""
    groups = chosen.where(grouped).select(key, group).distinct()
    members = lots.where(grouped).join(groups, [key, group], "left_semi")
    return members.select(key, "lot_id").unionByName(chosen.where(~grouped).select(key, "lot_id"))


def block_options(lots: DataFrame, key: str, block: str = "block") -> DataFrame:
    """Distinct block names in natural order (text before the digits, then the number)."""
    names = lots.select(key, F.trim(block).alias("block")).where(F.coalesce("block", F.lit("")) != "").distinct()
    prefix, number = F.regexp_extract("block", r"^(\D*)", 1), F.regexp_extract("block", r"(\d+)", 1).try_cast("bigint")
    ordered = names.withColumns({"_p": F.lower(prefix), "_n": F.coalesce(number, F.lit(-1))})
    rank = F.row_number().over(Window.partitionBy(key).orderBy("_p", "_n", "block"))
    return ordered.select(key, "block", rank.alias("ord"))


def lasso(lots: DataFrame, regions: DataFrame, key: str) -> DataFrame:
    """Lots whose vertex mean lies in a region ring: pairs of region and lot."""
    centre = G.vertex_mean(G.open_ring(F.col("ring")))
    points = lots.select(key, "lot_id", centre.alias("c")).select(key, "lot_id", F.col("c.x").alias("x"), F.col("c.y").alias("y"))
    from parcelflow.operators.spatial import _one_way
    pairs = _one_way(regions, as_points(points), key, flipped=False)
    inside = G.point_in_ring(F.col("l.x"), F.col("l.y"), F.col("r.ring"))
    return pairs.where(inside).select(F.col(f"l.{key}").alias(key), F.col("r.region_id").alias("region_id"), F.col("l.lot_id").alias("lot_id"))


def box_select(lots: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """Lots whose vertex mean lies in a rectangle (``bx0,by0,bx1,by1``), borders included."""
    from parcelflow.operators.spatial import _one_way
    centre = G.vertex_mean(F.col("ring"))
    points = lots.select(key, "lot_id", centre.alias("c")).select(key, "lot_id", F.col("c.x").alias("x"), F.col("c.y").alias("y"))
    pairs = _one_way(boxes, as_points(points), key, flipped=False)
    return pairs.select(F.col(f"l.{key}").alias(key), F.col("r.region_id").alias("region_id"), F.col("l.lot_id").alias("lot_id"))


def row_bases(points: DataFrame, key: str) -> DataFrame:
    """Start ``y`` of every text row: a row begins where ``y`` exceeds the current start by more than ``band``.

    ``points(key, y, band)``. The rule is a running fold, but rows are never folded in one task.
    A point with nothing in the band above it starts a row for certain; from there each start
    leads to the first y beyond its band. That successor is found through strips one band high,
    and chains of starts grow by pointer doubling until nothing is added, usually at once.
    """
    ys = points.select(key, "y", "band").distinct().withColumn("_b", F.floor(F.col("y") / F.col("band")))
    strips = ys.groupBy(key, "_b").agg(F.max("y").alias("_top"), F.min("y").alias("_low"))
    before = strips.select(key, (F.col("_b") + 1).alias("_b"), F.col("_top").alias("_prev_top"))
    inner = Window.partitionBy(key, "_b").orderBy("y")
    ranked = ys.withColumn("_lag", F.lag("y").over(inner)).join(before, [key, "_b"], "left")
    previous = F.coalesce("_lag", "_prev_top")
    starts = ranked.withColumn("start", previous.isNull() | (F.col("y") - previous > F.col("band")))
    # Successor: inside the next strip beyond the band, else the lowest y of the next strip in use.
    ahead = strips.select(key, F.col("_b"), F.lead("_low", 1).over(Window.partitionBy(key).orderBy("_b")).alias("_next_low"),
                          F.lead("_b", 1).over(Window.partitionBy(key).orderBy("_b")).alias("_next_b"),
                          F.lead("_low", 2).over(Window.partitionBy(key).orderBy("_b")).alias("_after_low"))
    pairs = ys.select(key, F.col("y").alias("y0"), "band", (F.col("_b") + 1).alias("_b")).join(
        ys.select(key, "_b", F.col("y").alias("y1")), [key, "_b"]).where(F.col("y1") - F.col("y0") > F.col("band"))
    near = pairs.groupBy(key, F.col("y0").alias("y")).agg(F.min("y1").alias("_near"))
    step = ys.join(near, [key, "y"], "left").join(ahead, [key, "_b"], "left")
    beyond = F.when(F.col("_next_b") == F.col("_b") + 1, F.col("_after_low")).otherwise(F.col("_next_low"))
    jump = cut(step.select(key, "y", F.coalesce("_near", beyond).alias("nxt")))
    reached = cut(starts.where("start").select(key, "y"))
    size = reached.count()
    while True:
        hop = reached.join(jump, [key, "y"]).where(F.col("nxt").isNotNull()).select(key, F.col("nxt").alias("y"))
        grown = cut(reached.unionByName(hop).distinct())
        new_size = grown.count()
        if new_size == size:
            return reached
        reached, size = grown, new_size
        twice = jump.alias("a").join(jump.select(key, F.col("y").alias("nxt"), F.col("nxt").alias("n2")), [key, "nxt"], "left")
        jump = cut(twice.select(key, F.col("a.y").alias("y"), F.col("n2").alias("nxt")))


def reading_order(points: DataFrame, key: str, point_id: str) -> DataFrame:
    """Left to right, top to bottom, with rows as tolerance bands. ``points(key, id, x, y, band)``."""
    bases = row_bases(points, key)
    width = points.select(key, "band").distinct()
    filed = bases.join(width, key).withColumn("_b", F.floor(F.col("y") / F.col("band")))
    filed = filed.select(key, F.col("y").alias("base"), F.explode(F.array("_b", F.col("_b") + 1)).alias("_b"))
    placed = points.withColumn("_b", F.floor(F.col("y") / F.col("band"))).join(filed, [key, "_b"]).where(F.col("base") <= F.col("y"))
    best = placed.groupBy(*points.columns).agg(F.max("base").alias("base"))
    return group_rank(best, [key], [F.col("base"), F.col("x"), F.col("y"), F.col(point_id)], "position").drop("base")


def selection_points(lots: DataFrame, key: str) -> DataFrame:
    """Lot centres with the sheet's row band: 0.7 of the upper-median height."""
    rows = lots.select(key, "lot_id", G.vertex_mean(F.col("ring")).alias("c"), (F.col("by1") - F.col("by0")).alias("h"))
    median = upper_median(rows, [key], "h").select(key, (F.col("median") * 0.7).alias("_m"))
    band = F.when(F.col("_m") > 0, F.col("_m")).otherwise(1.0)
    return rows.join(median, key).select(key, "lot_id", F.col("c.x").alias("x"), F.col("c.y").alias("y"), band.alias("band"))


def rename_plan(lots: DataFrame, selection: DataFrame, key: str, pattern: str, start: int = 1, pad: int = 0) -> DataFrame:
    """Old and new names in reading order, with clashes: ``conflict`` with a lot outside the
    selection, ``repeated`` within the plan. Names compare without case."""
    chosen = lots.join(selection.select(key, "lot_id"), [key, "lot_id"], "left_semi")
    ordered = reading_order(selection_points(chosen, key), key, "lot_id").select(key, "lot_id", "position")
    label = C.by_index(C.STATUS_LABELS, F.col("s"), "")
    plan = chosen.join(ordered, [key, "lot_id"]).withColumn(
        "new_name", X.name_from_pattern(pattern, F.col("position") - 1 + start, pad, F.col("block"), label))
    plan = plan.select(key, "lot_id", "position", F.coalesce("name", F.lit("")).alias("old_name"), "new_name").withColumn(
        "_fold", F.lower("new_name"))
    others = lots.join(selection.select(key, "lot_id"), [key, "lot_id"], "left_anti").select(
        key, F.lower(F.coalesce("name", F.lit(""))).alias("_fold")).distinct().withColumn("conflict", F.lit(True))
    repeats = plan.groupBy(key, "_fold").agg((F.count("*") > 1).alias("repeated"))
    out = plan.join(others, [key, "_fold"], "left").join(repeats, [key, "_fold"])
    return out.withColumn("conflict", F.coalesce("conflict", F.lit(False))).withColumn(
        "changed", F.col("old_name") != F.col("new_name")).drop("_fold")
