"""Ring expressions over ``array<struct<x double, y double>>`` columns.

Everything here runs inside the JVM as higher-order array functions. A ring is one row's
value; relations between rings live in the spatial joins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from parcelflow.functions.let import bind, once
from parcelflow.schemas import RING

CURVE_FLATNESS = 0.08
CURVE_MAX_STEPS = 64


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def empty_ring() -> Column:
    return F.array().cast(RING)


def parse_points(text: Column) -> Column:
    """``"x,y x,y"`` → ring; pairs that do not parse are dropped."""
    pairs = F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+")

    def to_point(pair: Column) -> Column:
        comma = F.instr(pair, ",")
        x = F.when(comma > 0, F.substr(pair, F.lit(1), comma - 1)).try_cast("double")
        y = F.when(comma > 0, F.substr(pair, comma + 1)).try_cast("double")
        return point(x, y)

    return F.filter(F.transform(pairs, to_point), lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def parse_points_json(text: Column) -> Column:
    """``[[x,y],…]`` → ring; entries shorter than two numbers are dropped."""
    pairs = F.from_json(text, "array<array<double>>")
    return F.transform(F.filter(pairs, lambda p: F.size(p) >= 2), lambda p: point(F.get(p, F.lit(0)), F.get(p, F.lit(1))))


def format_points(ring: Column, decimals: int = 1) -> Column:
    number = lambda v: F.replace(F.format_number(v, decimals), F.lit(","), F.lit(""))
    return F.array_join(F.transform(ring, lambda p: F.concat(number(p["x"]), F.lit(","), number(p["y"]))), " ")


@once
def open_ring(ring: Column) -> Column:
    """Drops the points at the end that repeat the first one."""
    first = F.get(ring, F.lit(0))
    keep = F.array_max(F.transform(ring, lambda p, i: F.when(
        (F.abs(p["x"] - first["x"]) >= 1e-6) | (F.abs(p["y"] - first["y"]) >= 1e-6), i + 1).otherwise(1)))
    return F.when(F.size(ring) > 0, F.slice(ring, F.lit(1), keep)).otherwise(ring)


@once
def edges(ring: Column) -> Column:
    n = F.size(ring)

    def edge(p: Column, i: Column) -> Column:
        q = F.get(ring, (i + 1) % n)
        return F.struct(p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by"))

    return F.transform(ring, edge)


def signed_area(ring: Column) -> Column:
    total = F.aggregate(edges(ring), F.lit(0.0), lambda a, e: a + e["ax"] * e["by"] - e["bx"] * e["ay"])
    return total / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


@once
def vertex_mean(ring: Column) -> Column:
    total = F.aggregate(ring, point(F.lit(0.0), F.lit(0.0)), lambda a, p: point(a["x"] + p["x"], a["y"] + p["y"]))
    n = F.nullif(F.size(ring), F.lit(0))
    return point(total["x"] / n, total["y"] / n)


@once
def centroid(ring: Column) -> Column:
    """Area-weighted centre; the mean of the vertices when the ring has no area."""
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"))

    def add(s: Column, e: Column) -> Column:
        f = e["ax"] * e["by"] - e["bx"] * e["ay"]
        return F.struct((s["a"] + f).alias("a"), (s["cx"] + (e["ax"] + e["bx"]) * f).alias("cx"),
                        (s["cy"] + (e["ay"] + e["by"]) * f).alias("cy"))

    def finish(s: Column) -> Column:
        flat = F.abs(s["a"]) < 2e-9
        mean = vertex_mean(ring)
        weight = F.nullif(3 * s["a"], F.lit(0.0))
        return F.when(flat, mean).otherwise(point(s["cx"] / weight, s["cy"] / weight))

    return F.aggregate(edges(ring), zero, add, finish)


@once
def bbox(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"),
                    F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def _cross(ax, ay, bx, by, px, py):
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def _inside(x: Column, y: Column, sides: Column) -> Column:
    def flip(inside: Column, e: Column) -> Column:
        spans = (e["ay"] > y) != (e["by"] > y)
        rise = F.nullif(e["by"] - e["ay"], F.lit(0.0))
        crosses = x < (e["bx"] - e["ax"]) * (y - e["ay"]) / rise + e["ax"]
        return F.when(spans & crosses, ~inside).otherwise(inside)

    return F.aggregate(sides, F.lit(False), flip)


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule; points on the boundary may fall on either side."""
    return _inside(x, y, edges(ring))


@once
def left_of_outline(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule along the ray to the left, for a point that is not on the ring or is its leftmost one, which counts as outside."""
    def flip(inside: Column, e: Column) -> Column:
        spans = (e["ay"] > y) != (e["by"] > y)
        rise = F.nullif(e["by"] - e["ay"], F.lit(0.0))
        return F.when(spans & ((e["bx"] - e["ax"]) * (y - e["ay"]) / rise + e["ax"] < x - 1e-9), ~inside).otherwise(inside)

    return F.aggregate(edges(ring), F.lit(False), flip)


def holed_area(ring: Column, holes: Column) -> Column:
    """Area of a ring without its holes, which lie inside and apart from each other."""
    return area(ring) - F.aggregate(F.transform(holes, area), F.lit(0.0), lambda total, a: total + a)


def holed_centroid(ring: Column, holes: Column) -> Column:
    """Area-weighted centre of a ring without its holes."""
    def moment(r: Column, sign: int) -> Column:
        return bind(centroid(r), lambda c: bind(sign * area(r), lambda a: F.struct((a * c["x"]).alias("x"), (a * c["y"]).alias("y"), a.alias("a"))))

    start = moment(ring, 1)
    total = F.aggregate(F.transform(holes, lambda h: moment(h, -1)), start, lambda s, m: F.struct(
        (s["x"] + m["x"]).alias("x"), (s["y"] + m["y"]).alias("y"), (s["a"] + m["a"]).alias("a")))
    weighted = bind(total, lambda s: point(s["x"] / F.nullif(s["a"], F.lit(0.0)), s["y"] / F.nullif(s["a"], F.lit(0.0))))
    return F.when(F.size(holes) == 0, centroid(ring)).otherwise(weighted)


def interior_point(ring: Column, holes: Column) -> Column:
    """A point inside the ring and outside its holes: in the middle of the widest stretch at half the height of the widest
    gap between the heights of two vertices."""
    def at_height(rings: Column, y: Column) -> Column:
        crossing = lambda e: F.when((e["ay"] > y) != (e["by"] > y), (e["bx"] - e["ax"]) * (y - e["ay"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0)) + e["ax"])
        xs = F.array_sort(F.array_compact(F.transform(F.flatten(F.transform(rings, edges)), crossing)))

        def widest(xs: Column) -> Column:
            stretch = lambda i: F.struct((F.get(xs, 2 * i + 1) - F.get(xs, 2 * i)).alias("w"), ((F.get(xs, 2 * i + 1) + F.get(xs, 2 * i)) / 2).alias("x"))
            return F.array_max(F.transform(F.sequence(F.lit(0), F.greatest(F.size(xs) / 2 - 1, F.lit(0)).cast("int")), stretch))["x"]

        return point(bind(xs, widest), y)

    def middle(ys: Column) -> Column:
        gap = lambda i: F.struct((F.get(ys, i + 1) - F.get(ys, i)).alias("w"), ((F.get(ys, i + 1) + F.get(ys, i)) / 2).alias("y"))
        return F.array_max(F.transform(F.sequence(F.lit(0), F.greatest(F.size(ys) - 2, F.lit(0))), gap))["y"]

    def place(rings: Column) -> Column:
        ys = F.array_sort(F.array_distinct(F.transform(F.flatten(rings), lambda p: p["y"])))
        return bind(bind(ys, middle), lambda y: at_height(rings, y))

    return bind(F.concat(F.array(ring), holes), place)


def segment_foot(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance, unclamped parameter and foot of the point on the segment."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length < 1e-9, F.lit(0.0)).otherwise(((px - ax) * dx + (py - ay) * dy) / F.nullif(length, F.lit(0.0)))
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    x, y = ax + dx * clamped, ay + dy * clamped
    return F.struct(F.hypot(px - x, py - y).alias("d"), t.alias("t"), x.alias("x"), y.alias("y"))


def foot_inside(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column, tolerance: float) -> Column:
    """Parameter of the point's foot when it lies on the open segment, else null. Plain arithmetic, no struct."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = ((px - ax) * dx + (py - ay) * dy) / F.nullif(length, F.lit(0.0))
    off = (px - ax) * dy - (py - ay) * dx
    near = off * off <= length * (tolerance * tolerance)
    return F.when(near & (t >= 1e-6) & (t <= 1 - 1e-6), t)


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of ``segment_foot`` alone, with length and parameter evaluated once."""
    dx, dy = bx - ax, by - ay
    along = lambda length: F.when(length < 1e-9, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / length)))
    return bind(bind(dx * dx + dy * dy, along), lambda t: F.hypot(px - (ax + dx * t), py - (ay + dy * t)))


@once
def sides(ring: Column) -> Column:
    """``edges`` with what a distance to them needs: their extent and squared length (null: no length)."""
    def side(e: Column) -> Column:
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        return bind(dx * dx + dy * dy, lambda length: F.struct(
            e["ax"].alias("ax"), e["ay"].alias("ay"), e["bx"].alias("bx"), e["by"].alias("by"), dx.alias("dx"), dy.alias("dy"), F.when(~(length < 1e-9), length).alias("length")))

    return F.transform(edges(ring), side)


def _side_distance(x: Column, y: Column, e: Column) -> Column:
    """``segment_distance`` to one of ``sides``."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(((x - e["ax"]) * e["dx"] + (y - e["ay"]) * e["dy"]) / e["length"], F.lit(0.0))))
    return bind(t, lambda t: F.hypot(x - (e["ax"] + e["dx"] * t), y - (e["ay"] + e["dy"] * t)))


def _sides_distance(x: Column, y: Column, around: Column) -> Column:
    return F.array_min(F.transform(around, lambda e: _side_distance(x, y, e)))


def point_edge_distance(x: Column, y: Column, ring: Column) -> Column:
    return _sides_distance(x, y, sides(ring))


def on_boundary(x: Column, y: Column, ring: Column, eps: float = 1e-9) -> Column:
    return point_edge_distance(x, y, ring) <= eps


def contains_strict(x: Column, y: Column, ring: Column) -> Column:
    return bind(sides(ring), lambda around: _inside(x, y, around) & ~(_sides_distance(x, y, around) <= 1e-9))


def covers(x: Column, y: Column, ring: Column) -> Column:
    return bind(sides(ring), lambda around: _inside(x, y, around) | (_sides_distance(x, y, around) <= 1e-9))


def edge_angle(ring: Column) -> Column:
    """Direction in degrees of the longest edge, in (-90, 90]; the first of equal edges counts."""
    best = F.struct(F.lit(-1.0).alias("d"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"))

    def pick(s: Column, e: Column) -> Column:
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        d = F.hypot(dx, dy)
        return F.when(d > s["d"], F.struct(d.alias("d"), dx.alias("dx"), dy.alias("dy"))).otherwise(s)

    def finish(s: Column) -> Column:
        deg = F.degrees(F.atan2(s["dy"], s["dx"]))
        return F.when(deg <= -90, deg + 180).when(deg > 90, deg - 180).otherwise(deg)

    return F.aggregate(edges(ring), best, pick, finish)


@once
def convex_hull(ring: Column) -> Column:
    """Corners of the convex hull, counter-clockwise, without points on its sides: two chains over the points in order of x and y.

    A chain is a fold: of the points so far, those up to the last one that keeps turning left before the new point stay.
    """
    def step(chain: Column, p: Column) -> Column:
        a, b = (lambda k: F.get(chain, k - 2)), (lambda k: F.get(chain, k - 1))
        turns_left = lambda k: F.when(_cross(a(k)["x"], a(k)["y"], b(k)["x"], b(k)["y"], p["x"], p["y"]) > 0, k)
        last = F.array_max(F.transform(F.sequence(F.lit(2), F.size(chain)), turns_left))
        kept = F.when(F.size(chain) < 2, F.size(chain)).otherwise(F.coalesce(last, F.lit(1)))
        return F.concat(F.slice(chain, F.lit(1), kept), F.array(p))

    def half(points: Column) -> Column:
        return bind(F.aggregate(points, F.slice(points, 1, 0), step), lambda c: F.slice(c, F.lit(1), F.size(c) - 1))

    return bind(F.array_sort(F.array_distinct(ring)), lambda points: F.concat(half(points), bind(F.reverse(points), half)))


@once
def oriented_rect(ring: Column) -> Column:
    """Minimum-area rotated rectangle as short side, long side, long-side angle (mod 180) and area.

    The best rectangle has a side along an edge of the hull.
    """
    n = F.size(ring)
    direction = lambda e: F.struct((e["bx"] - e["ax"]).alias("dx"), (e["by"] - e["ay"]).alias("dy"))
    corner = lambda i: F.get(ring, i % n)
    turns = F.transform(ring, lambda p, i: _cross(p["x"], p["y"], corner(i + 1)["x"], corner(i + 1)["y"], corner(i + 2)["x"], corner(i + 2)["y"]))
    # a ring of four corners that clearly turns one way all around is its own hull
    own = lambda t: F.when(F.array_min(t) > 1e-6, ring).when(F.array_max(t) < -1e-6, F.reverse(ring))
    hull = F.coalesce(F.when(n == 4, bind(turns, own)), convex_hull(ring))
    return F.when(n >= 3, bind(hull, lambda hull: _best_rect(hull, F.transform(edges(hull), direction))))


def _best_rect(ring: Column, directions: Column) -> Column:
    long = F.transform(directions, lambda d: F.struct(d["dx"].alias("dx"), d["dy"].alias("dy"), F.hypot(d["dx"], d["dy"]).alias("d")))
    unit = F.transform(F.filter(long, lambda d: d["d"] > 1e-9), lambda d: F.struct((d["dx"] / d["d"]).alias("ux"), (d["dy"] / d["d"]).alias("uy")))
    extent = lambda values: bind(values, lambda v: F.array_max(v) - F.array_min(v))

    def measure(u: Column) -> Column:
        along = F.transform(ring, lambda p: p["x"] * u["ux"] + p["y"] * u["uy"])
        across = F.transform(ring, lambda p: p["y"] * u["ux"] - p["x"] * u["uy"])

        def rect(size: Column) -> Column:
            w, h = size["w"], size["h"]
            heading = F.degrees(F.atan2(u["uy"], u["ux"]))
            angle = F.pmod(F.when(w >= h, heading).otherwise(heading + 90), F.lit(180.0))
            return F.struct((w * h).alias("area"), F.least(w, h).alias("short"), F.greatest(w, h).alias("long"),
                            angle.alias("angle"))

        return bind(F.struct(extent(along).alias("w"), extent(across).alias("h")), rect)

    return F.array_min(F.transform(unit, measure))


def fill_ratio(ring_area: Column, rect: Column) -> Column:
    return ring_area / F.greatest(rect["area"], F.lit(1.0))


def angle_distance(first: Column, second: Column) -> Column:
    difference = F.pmod(F.abs(first - second), F.lit(180.0))
    return F.least(difference, 180.0 - difference)


@once
def corner_count(ring: Column, tolerance: float = 0.5) -> Column:
    """Vertices that stand out from the chord between their neighbours, plus the closing one."""
    n = F.size(ring)

    def stands_out(p: Column, i: Column) -> Column:
        a, b = F.get(ring, (i + n - 1) % n), F.get(ring, (i + 1) % n)
        return segment_distance(p["x"], p["y"], a["x"], a["y"], b["x"], b["y"]) > tolerance

    return F.size(F.filter(ring, stands_out)) + 1


def looks_like_lot(ring: Column, ring_area: Column, rect: Column) -> Column:
    return (rect["area"] > 0) & (corner_count(ring) <= 20) & (ring_area / F.nullif(rect["area"], F.lit(0.0)) >= 0.62)


def map_points(ring: Column, fx, fy, decimals: int | None = None) -> Column:
    """New ring from ``fx(x, y)`` and ``fy(x, y)``."""

    def move(p: Column) -> Column:
        x, y = fx(p["x"], p["y"]), fy(p["x"], p["y"])
        if decimals is not None:
            x, y = F.bround(x, decimals), F.bround(y, decimals)
        return point(x, y)

    return F.transform(ring, move)


def translate(ring: Column, dx: Column, dy: Column, decimals: int | None = 2) -> Column:
    return map_points(ring, lambda x, y: x + dx, lambda x, y: y + dy, decimals)


def rotate(ring: Column, degrees: float, cx: Column, cy: Column, decimals: int | None = 2) -> Column:
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return map_points(ring, lambda x, y: cx + (x - cx) * c - (y - cy) * s,
                      lambda x, y: cy + (x - cx) * s + (y - cy) * c, decimals)


def scale(ring: Column, sx: Column, sy: Column, ox: Column, oy: Column) -> Column:
    return map_points(ring, lambda x, y: ox + (x - ox) * sx, lambda x, y: oy + (y - oy) * sy)


def flip(ring: Column, axis: str, cx: Column, cy: Column) -> Column:
    if axis == "v":
        return map_points(ring, lambda x, y: x, lambda x, y: 2 * cy - y)
    return map_points(ring, lambda x, y: 2 * cx - x, lambda x, y: y)


def origin(box: Column, name: str = "center") -> tuple[Column, Column]:
    """Anchor point of a transform: a corner (``tl``, ``tr``, ``bl``, ``br``) or the centre."""
    x = {"tl": box["x0"], "bl": box["x0"], "tr": box["x1"], "br": box["x1"]}.get(name, (box["x0"] + box["x1"]) / 2)
    y = {"tl": box["y0"], "tr": box["y0"], "bl": box["y1"], "br": box["y1"]}.get(name, (box["y0"] + box["y1"]) / 2)
    return x, y


def page_to_canvas(ring: Column, ox: float, oy: float, zoom: float, left: float, top: float) -> Column:
    return map_points(ring, lambda x, y: (x - ox) * zoom - left, lambda x, y: (y - oy) * zoom - top, 2)


@once
def clip_half_plane(ring: Column, ax, ay, bx, by, side: int) -> Column:
    """Part of the ring on one side of the line a→b (``side`` 1: left of it, -1: right of it)."""
    n = F.size(ring)

    def cut(p: Column, i: Column) -> Column:
        q = F.get(ring, (i + 1) % n)
        dp = _cross(ax, ay, bx, by, p["x"], p["y"]) * side
        dq = _cross(ax, ay, bx, by, q["x"], q["y"]) * side
        t = dp / F.nullif(dp - dq, F.lit(0.0))
        crossing = point(p["x"] + (q["x"] - p["x"]) * t, p["y"] + (q["y"] - p["y"]) * t)
        kept = F.when(dp >= 0, F.array(point(p["x"], p["y"]))).otherwise(empty_ring())
        return F.when(((dp > 0) & (dq < 0)) | ((dp < 0) & (dq > 0)), F.concat(kept, F.array(crossing))).otherwise(kept)

    return F.flatten(F.transform(ring, cut))


def common_area(a: Column, b: Column) -> Column:
    """Area that two simple rings of any shape and direction share.

    A ring is the signed sum of the strips below its sides, and two strips share the integral of the lower one of two lines over
    their common stretch of x. The signed sum over all pairs of sides is the common area; upright sides have no strip.
    Coordinates are taken from the first point, which keeps the sums small.
    """
    def strips(ring: Column, first: Column) -> Column:
        strip = lambda e: F.struct(
            (F.least(e["ax"], e["bx"]) - first["x"]).alias("x0"), (F.greatest(e["ax"], e["bx"]) - first["x"]).alias("x1"),
            (F.when(e["ax"] < e["bx"], e["ay"]).otherwise(e["by"]) - first["y"]).alias("y0"),
            ((e["by"] - e["ay"]) / (e["bx"] - e["ax"])).alias("rise"), F.signum(e["bx"] - e["ax"]).alias("s"))
        return F.transform(F.filter(edges(ring), lambda e: e["ax"] != e["bx"]), strip)

    def below_both(e: Column, f: Column) -> Column:
        lo, hi = F.greatest(e["x0"], f["x0"]), F.least(e["x1"], f["x1"])

        def integral(c: Column) -> Column:
            # p, q: by how much the first line is above the second at both ends; the lower line is the first one less what is above
            p, q = c["e0"] - c["f0"], c["e1"] - c["f1"]
            parted = F.when((p >= 0) & (q >= 0), (p + q) / 2).when((p <= 0) & (q <= 0), F.lit(0.0)).when(p > 0, p * p / (p - q) / 2).otherwise(q * q / (q - p) / 2)
            return c["w"] * ((c["e0"] + c["e1"]) / 2 - parted)

        at = lambda line, x: line["y0"] + line["rise"] * (x - line["x0"])
        ends = F.struct((hi - lo).alias("w"), at(e, lo).alias("e0"), at(e, hi).alias("e1"), at(f, lo).alias("f0"), at(f, hi).alias("f1"))
        return F.when(lo < hi, e["s"] * f["s"] * bind(ends, integral)).otherwise(F.lit(0.0))

    def total(sa: Column, sb: Column) -> Column:
        return F.aggregate(sa, F.lit(0.0), lambda t, e: t + F.aggregate(sb, F.lit(0.0), lambda u, f: u + below_both(e, f)))

    shared = bind(F.get(a, F.lit(0)), lambda first: bind(strips(a, first), lambda sa: bind(strips(b, first), lambda sb: F.abs(total(sa, sb)))))
    return F.when(F.least(F.size(a), F.size(b)) < 3, F.lit(0.0)).otherwise(shared)


def common_area_holed(a: Column, a_holes: Column, b: Column, b_holes: Column) -> Column:
    """Area that two rings without their holes share."""
    signed = lambda ring, holes: F.concat(F.array(F.struct(ring.alias("r"), F.lit(1.0).alias("s"))),
                                          F.transform(holes, lambda h: F.struct(h.alias("r"), F.lit(-1.0).alias("s"))))

    def total(left: Column, right: Column) -> Column:
        against = lambda l: F.aggregate(F.transform(right, lambda r: l["s"] * r["s"] * common_area(l["r"], r["r"])), F.lit(0.0), lambda t, v: t + v)
        return F.aggregate(F.transform(left, against), F.lit(0.0), lambda t, v: t + v)

    return bind(signed(a, a_holes), lambda left: bind(signed(b, b_holes), lambda right: total(left, right)))


@once
def line_crossings(ring: Column, ax, ay, bx, by) -> Column:
    """How often the boundary changes side of the line, vertices on the line ignored."""
    sides = F.filter(F.transform(ring, lambda p: _cross(ax, ay, bx, by, p["x"], p["y"])), lambda d: F.abs(d) > 1e-7)
    n = F.size(sides)
    changes = F.filter(F.transform(sides, lambda d, i: F.signum(d) != F.signum(F.get(sides, (i + 1) % n))), lambda c: c)
    return F.when(n < 2, 0).otherwise(F.size(changes))


@once
def drop_repeats(ring: Column, eps: float = 1e-6) -> Column:
    """Consecutive points closer than ``eps`` on both axes collapse to the first of them."""
    near = lambda p, q: (F.abs(p["x"] - q["x"]) <= eps) & (F.abs(p["y"] - q["y"]) <= eps)
    add = lambda out, p: F.when((F.size(out) > 0) & near(F.element_at(out, -1), p), out).otherwise(F.concat(out, F.array(p)))
    kept = F.aggregate(ring, empty_ring(), lambda out, p: F.when(F.size(out) == 0, F.array(p)).otherwise(add(out, p)))
    return open_ring(kept)


def ring_gap(a: Column, b: Column) -> Column:
    """Distance between two rings: 0 when they share a vertex, one covers a vertex of the other or their edges cross."""
    def vertex_gap(ring: Column, around: Column) -> Column:
        return F.array_min(F.transform(ring, lambda p: _sides_distance(p["x"], p["y"], around)))

    def measure(ea: Column, eb: Column) -> Column:
        inside = F.exists(a, lambda p: _inside(p["x"], p["y"], eb)) | F.exists(b, lambda p: _inside(p["x"], p["y"], ea))
        crossing = F.exists(ea, lambda e: F.exists(eb, lambda f: segments_cross(e, f)))
        return F.when(inside | crossing, F.lit(0.0)).otherwise(F.least(vertex_gap(a, eb), vertex_gap(b, ea)))

    measured = bind(sides(a), lambda ea: bind(sides(b), lambda eb: measure(ea, eb)))
    return F.when(F.arrays_overlap(a, b), F.lit(0.0)).otherwise(measured)


def segments_cross(e: Column, f: Column) -> Column:
    d1 = _cross(f["ax"], f["ay"], f["bx"], f["by"], e["ax"], e["ay"])
    d2 = _cross(f["ax"], f["ay"], f["bx"], f["by"], e["bx"], e["by"])
    d3 = _cross(e["ax"], e["ay"], e["bx"], e["by"], f["ax"], f["ay"])
    d4 = _cross(e["ax"], e["ay"], e["bx"], e["by"], f["bx"], f["by"])
    return (d1 * d2 < 0) & (d3 * d4 < 0)


def crossing_params(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Parameters of the proper crossing of a→b and c→d, null when they do not cross inside."""
    r1, r2, s1, s2 = bx - ax, by - ay, dx - cx, dy - cy
    den = r1 * s2 - r2 * s1
    tn, un = (cx - ax) * s2 - (cy - ay) * s1, (cx - ax) * r2 - (cy - ay) * r1
    # The tests multiply by |den| instead of dividing, so most pairs end at the first comparison.
    within = lambda v: (v * F.signum(den) >= F.abs(den) * 1e-9) & (v * F.signum(den) <= F.abs(den) * (1 - 1e-9))
    hit = (F.abs(den) >= 1e-12) & within(tn) & within(un)
    t = tn / F.nullif(den, F.lit(0.0))
    return F.when(hit, F.struct(t.alias("t"), (un / F.nullif(den, F.lit(0.0))).alias("u"), (ax + r1 * t).alias("x"), (ay + r2 * t).alias("y")))


def bezier_steps(c: list[Column]) -> Column:
    """Chords that keep a cubic curve within the flatness tolerance."""
    x0, y0, x1, y1, x2, y2, x3, y3 = c
    chord = F.hypot(x3 - x0, y3 - y0)
    first = F.abs((x1 - x0) * (y3 - y0) - (y1 - y0) * (x3 - x0))
    second = F.abs((x2 - x0) * (y3 - y0) - (y2 - y0) * (x3 - x0))
    sag = (first + second) / F.nullif(chord, F.lit(0.0))
    needed = F.least(F.lit(CURVE_MAX_STEPS), F.greatest(F.lit(2), F.ceil(F.sqrt(sag / CURVE_FLATNESS) * 4)))
    return F.when((chord <= 1e-6) | (sag <= CURVE_FLATNESS), 1).otherwise(needed).cast("int")


def drawing_path(kind: Column, coords: Column, curve_steps: int | None = None) -> Column:
    """Points of a drawing item in order: line, rectangle, quad (closed) or flattened cubic."""
    c = [F.get(coords, F.lit(i)) for i in range(8)]
    line = F.array(point(c[0], c[1]), point(c[2], c[3]))
    rect = F.array(point(c[0], c[1]), point(c[2], c[1]), point(c[2], c[3]), point(c[0], c[3]), point(c[0], c[1]))
    quad = F.array(point(c[0], c[1]), point(c[2], c[3]), point(c[4], c[5]), point(c[6], c[7]), point(c[0], c[1]))
    steps = F.lit(curve_steps) if curve_steps else bezier_steps(c)

    def at(i: Column, steps: Column) -> Column:
        t = i / steps
        u = 1 - t
        blend = lambda p0, p1, p2, p3: u * u * u * p0 + 3 * u * u * t * p1 + 3 * u * t * t * p2 + t * t * t * p3
        return point(blend(c[0], c[2], c[4], c[6]), blend(c[1], c[3], c[5], c[7]))

    curve = bind(steps, lambda n: F.concat(F.array(point(c[0], c[1])), F.transform(F.sequence(F.lit(1), n), lambda i: at(i, n))))
    return F.when(kind == "l", line).when(kind == "re", rect).when(kind == "qu", quad).when(kind == "c", curve)


@once
def path_segments(path: Column, min_length_sq: float = 0.0001) -> Column:
    """Segments between consecutive points, without the degenerate ones."""
    pairs = F.transform(F.slice(path, F.lit(2), F.size(path) - 1), lambda q, i: F.struct(
        F.get(path, i)["x"].alias("ax"), F.get(path, i)["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by")))
    squared = lambda s: (s["ax"] - s["bx"]) * (s["ax"] - s["bx"]) + (s["ay"] - s["by"]) * (s["ay"] - s["by"])
    return F.filter(pairs, lambda s: squared(s) > min_length_sq)
