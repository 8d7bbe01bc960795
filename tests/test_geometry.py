"""Ring expressions, exact group primitives, spatial joins and faces against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from parcelflow.adapters import Tables, with_shape
from parcelflow.functions import geometry as G
from parcelflow.operators import faces as Fc, grouped as Gr, pipelines as P, quality as Q, selection as S, spatial as Sp, transform as Tr
from parcelflow.session import cut, with_true_sizes

RECT = [(0.0, 0.0), (20.0, 0.0), (20.0, 10.0), (0.0, 10.0)]


def rings(spark, items, key="sheet bigint, lot_id bigint"):
    return with_shape(spark.createDataFrame(items, f"{key}, ring array<struct<x:double,y:double>>"))


def turned(points, deg):
    c, s = math.cos(math.radians(deg)), math.sin(math.radians(deg))
    return [(x * c - y * s, x * s + y * c) for x, y in points]


def test_ring_functions(spark):
    rows = rings(spark, [(1, 1, RECT), (1, 2, RECT[::-1]), (1, 3, turned([(0, 0), (100, 0), (100, 20), (0, 20)], 30)), (1, 4, RECT + RECT[:1])])
    r = {x.lot_id: x for x in rows.select(
        "lot_id", "area_px", G.point_in_ring(F.lit(10.0), F.lit(5.0), F.col("ring")).alias("inside"), G.point_in_ring(F.lit(30.0), F.lit(5.0), F.col("ring")).alias("outside"),
        G.edge_angle(F.col("ring")).alias("angle"), F.size(G.open_ring(F.col("ring"))).alias("n"), G.oriented_rect(F.col("ring")).alias("rect")).collect()}
    assert r[1].area_px == r[2].area_px == 200 and r[1].inside and not r[1].outside
    assert r[1].angle == 0 and abs(r[3].angle - 30) < 1e-6 and r[4].n == 4
    assert abs(r[3].rect.short - 20) < 1e-6 and abs(r[3].rect.long - 100) < 1e-6 and abs(r[3].rect.angle - 30) < 1e-6


@pytest.mark.parametrize("values, wanted", [([5, 1, 4, 2, 3], 3), ([1, 2, 3, 4], 3), ([7], 7), ([2, 2, 2, 1], 2)])
def test_upper_median(spark, values, wanted):
    df = spark.createDataFrame([(1, float(v)) for v in values], "k int, v double")
    assert Gr.upper_median(df, ["k"], "v").first().median == wanted


def test_medians_and_ranks_match_sorting(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 3]), rng.choice([rng.uniform(-5, 5), rng.uniform(0, 1e6), 4.25]), i) for i in range(700)]
    df = spark.createDataFrame(rows, "k int, v double, id int").repartition(5)
    up = {r.k: (r.median, r.samples) for r in Gr.upper_median(df, ["k"], "v").collect()}
    true = {r.k: r.median for r in Gr.upper_median(df, ["k"], "v", true_median=True).collect()}
    ranks = {r.id: r["rank"] for r in Gr.group_rank(df, ["k"], [F.col("v"), F.col("id")]).collect()}
    for k in (1, 2, 3):
        mine = sorted((v, i) for kk, v, i in rows if kk == k)
        n = len(mine)
        assert up[k] == (mine[n // 2][0], n)
        assert true[k] == pytest.approx((mine[(n - 1) // 2][0] + mine[n // 2][0]) / 2)
        assert [ranks[i] for _, i in mine] == list(range(1, n + 1))


def test_previous_value_across_ranges(spark):
    """One group over all partitions, gaps of any size, a null that is a value of its own, and small groups."""
    rows = [(1, s, None if s == 3 else f"s{s}") for s in (0, 3, 4, 10**9, 10**18)] + [(2, s, f"t{s}") for s in range(0, 4000, 7)] + [(3, 5, "u")]
    df = spark.createDataFrame(rows, "k int, seq bigint, st string").repartition(5)
    got = {(r.k, r.seq): r.p for r in Gr.previous_value(df, ["k"], ["seq"], "st", "p").collect()}
    want = {}
    for k, s, _ in rows:
        before = [v for j, q, v in sorted(rows, key=lambda r: r[:2]) if j == k and q < s]
        want[k, s] = before[-1] if before else None
    assert got == want


def test_reading_order(spark):
    points = [(3, 30, 101), (1, 10, 100), (2, 20, 99), (6, 30, 160), (4, 10, 161), (5, 20, 159)]
    for band, same in ((20.0, True), (0.5, False)):
        df = spark.createDataFrame([(1, i, float(x), float(y), band) for i, x, y in points], "k int, id int, x double, y double, band double")
        order = [r.id for r in S.reading_order(df, "k", "id").orderBy("position").collect()]
        assert (order == [1, 2, 3, 4, 5, 6]) is same


def test_row_bases_match_the_fold(spark):
    rng = random.Random(5)
    ys = sorted(round(rng.uniform(0, 60), 2) for _ in range(120))
    df = spark.createDataFrame([(1, y, 4.0) for y in ys], "k int, y double, band double")
    wanted, base = [], None
    for y in ys:
        if base is None or y - base > 4.0:
            base = y
            wanted.append(y)
    assert sorted(r.y for r in S.row_bases(df, "k").collect()) == wanted


def test_distribute_and_align(spark):
    boxes = spark.createDataFrame([(1, 0, 0.0, 10.0), (1, 1, 50.0, 54.0), (1, 2, 18.0, 30.0), (1, 3, 90.0, 100.0)], "k int, id int, lo double, hi double")
    rows = sorted((r.lo + r.delta, r.hi + r.delta, r.gap) for r in Tr.distribute(boxes, ["k"], "id").collect())
    assert rows[0][0] == 0 and rows[-1][1] == pytest.approx(100)
    assert all(b[0] - a[1] == pytest.approx((100 - 36) / 3) for a, b in zip(rows, rows[1:]))
    box = spark.createDataFrame([(10.0, 100.0, 50.0, 140.0, 0.0, 0.0, 20.0, 10.0)], "gx0 double, gy0 double, gx1 double, gy1 double, bx0 double, by0 double, bx1 double, by1 double")
    shift = lambda m: tuple(box.select(*[c.alias(n) for c, n in zip(Tr.align_delta(m), "xy")]).first())
    assert [shift(m) for m in ("left", "right", "centerx", "top", "bottom", "middley")] == [(10, 0), (30, 0), (20, 0), (0, 100), (0, 130), (0, 115)]


def test_fit_map(spark):
    df = spark.createDataFrame([(10.0, 30.0, 12.0, 34.0), (10.0, 30.0, 12.0, 90.0), (10.0, 10.0, 0.0, 5.0)], "lo double, hi double, a double, b double")
    m = [r.m for r in df.select(Tr.fit_map(F.col("lo"), F.col("hi"), F.col("a"), F.col("b")).alias("m")).collect()]
    assert m[0].s == pytest.approx(1.1) and m[1] is None and m[2] is None


def random_boxes(rng, n):
    out = []
    for i in range(n):
        size = rng.choice([1, 1, 1, 30, 200])
        x, y, w, h = rng.uniform(-50, 100), rng.uniform(-50, 100), rng.uniform(0.1, size), rng.uniform(0.1, size)
        out.append((1, i, x, y, x + w, y + h))
    return out


def test_box_join_matches_brute_force(spark):
    rng = random.Random(1)
    a, b = random_boxes(rng, 60), random_boxes(rng, 80)
    schema = "k int, id int, bx0 double, by0 double, bx1 double, by1 double"
    pairs = Sp.box_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "k").select("l.id", F.col("r.id").alias("o")).collect()
    wanted = {(p[1], q[1]) for p in a for q in b if p[2] <= q[4] and q[2] <= p[4] and p[3] <= q[5] and q[3] <= p[5]}
    assert len(pairs) == len(wanted) and {tuple(p) for p in pairs} == wanted


def test_nearest_k_matches_brute_force(spark):
    rng = random.Random(2)
    pts = [(1, i, rng.choice([rng.uniform(0, 5), rng.uniform(0, 500)]), rng.uniform(0, 300)) for i in range(150)]
    qs = [(1, i, rng.uniform(-50, 600), rng.uniform(0, 300)) for i in range(25)]
    got = {}
    near = Sp.nearest_k(spark.createDataFrame(qs, "k int, q int, x double, y double"), spark.createDataFrame(pts, "k int, p int, x double, y double"), "k", "q", "p", 4)
    for r in near.select("l.q", "r.p").collect():
        got.setdefault(r.q, set()).add(r.p)
    for _, q, x, y in qs:
        assert got[q] == {p[1] for p in sorted(pts, key=lambda p: math.hypot(p[2] - x, p[3] - y))[:4]}


def sides(x0, y0, x1, y1):
    c = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    return [(1, *c[i], *c[(i + 1) % 4]) for i in range(4)]


def segments(spark, rows):
    return spark.createDataFrame([(k, *map(float, r)) for k, *r in rows], "sheet bigint, ax double, ay double, bx double, by double")


def points(spark, rows):
    return spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate(rows)], "sheet bigint, label_id bigint, x double, y double")


def test_anchored_faces(spark):
    lines = sides(0, 0, 10, 10) + sides(10, 0, 20, 10) + sides(20, 0, 30, 10)
    best = Fc.best_face_per_anchor(segments(spark, lines), points(spark, [(5, 5), (15, 5)]), "sheet", "label_id", 20, 200, snaps=(None,)).collect()
    assert len(best) == 2 and all(abs(r.area_px - 100) < 1e-6 for r in best)


def test_small_gap_closes_with_snap(spark):
    lines = [(1, 0, 0, 10, 0), (1, 10, 0, 10, 10), (1, 10, 10, 0, 10), (1, 0, 10, 0, 0.2)]
    best = Fc.best_face_per_anchor(segments(spark, lines), points(spark, [(5, 5)]), "sheet", "label_id", 20, 200, snaps=(None, 0.5)).collect()
    assert len(best) == 1 and best[0]["rank"] == 1


def test_crossing_lines_and_loose_ends(spark):
    lines = sides(0, 0, 20, 10) + [(1, 10, -5, 10, 15), (1, 3, 3, 6, 6)]
    faces = Fc.trace_faces(segments(spark, lines), "sheet").collect()
    assert sorted(round(f.area_px, 6) for f in faces) == [100, 100]
    assert all(len(f.ring) == 4 for f in faces)


def grid_lots(spark, boxes):
    ring = lambda x0, y0, x1, y1: [(float(x0), float(y0)), (float(x1), float(y0)), (float(x1), float(y1)), (float(x0), float(y1))]
    return rings(spark, [(1, i, ring(*b)) for i, b in enumerate(boxes)])


@pytest.mark.parametrize("middle_top, found", [(10, 1), (5.5, 0)])
def test_recovers_whole_lots_only(spark, middle_top, found):
    boxes = [(0, 0, 10, 10), (10, 0, 20, middle_top), (20, 0, 30, 10)]
    lots = grid_lots(spark, boxes)
    faces = lots.withColumn("face_id", F.concat(F.lit("f"), F.col("lot_id").cast("string"))).drop("lot_id")
    none = points(spark, [(500, 500)]).where("false")
    got = P.recover_neighbours(lots.where("lot_id <> 1"), faces, points(spark, [(5, 5), (25, 5)]), none, "sheet", "lot_id", "label_id")
    assert got.count() == found


def test_merge_needs_neighbours(spark):
    lots = grid_lots(spark, [(0, 0, 10, 10), (10.02, 0, 20, 10)]).unionByName(
        grid_lots(spark, [(0, 0, 10, 10), (40, 0, 50, 10)]).withColumn("sheet", F.lit(2).cast("bigint")))
    got = {r.sheet: r for r in Fc.merge_adjacent(lots, "sheet", "lot_id").collect()}
    assert got[1].reason is None and abs(got[1].area - 200) < 1e-6 and got[2].reason == "not_adjacent"


def test_fill_from_pool_matches_the_ordered_walk(spark):
    rng = random.Random(7)
    winner = [(0, 0, 10, 10)]
    pool = [(x := rng.uniform(8, 60), y := rng.uniform(0, 40), x + rng.uniform(4, 16), y + rng.uniform(4, 16)) for _ in range(40)]
    marks = [(rng.uniform(8, 70), rng.uniform(0, 50)) for _ in range(25)]
    faces = grid_lots(spark, pool).withColumn("face_id", F.format_string("f%03d", "lot_id")).drop("lot_id")
    none = spark.createDataFrame([], "sheet bigint, x double, y double, value double")
    got = {r.face_id: r.label_id for r in P.fill_from_pool(grid_lots(spark, winner), faces, points(spark, marks), none, "sheet", "lot_id", "label_id").collect()}
    inter = lambda a, b: max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    covers = lambda b, p: b[0] <= p[0] <= b[2] and b[1] <= p[1] <= b[3]
    pending = [i for i, m in enumerate(marks) if not any(covers(w, m) for w in winner)]
    done, wanted = list(winner), {}
    for f in sorted(range(len(pool)), key=lambda f: area(pool[f])):
        hits = [i for i in pending if covers(pool[f], marks[i])]
        if len(hits) == 1 and max(inter(pool[f], d) / max(1, min(area(pool[f]), area(d))) for d in done) <= 0.10:
            done.append(pool[f])
            pending.remove(hits[0])
            wanted[f"f{f:03d}"] = hits[0]
    assert got == wanted


def test_refine_blocks_walk(spark):
    metas = spark.createDataFrame([(1, i, f"L{n:03d}", "Q1", x, 0.0) for i, (n, x) in enumerate([(1, 0.0), (9, 5.0), (4, 6.0), (2, 1.0)])],
                                  "sheet bigint, lot_id bigint, lote string, quadra string, cx double, cy double")
    blocks = spark.createDataFrame([(1, 0, "Q1", 0.0, 0.0), (1, 1, "Q2", 8.0, 0.0), (1, 2, "Q3", 30.0, 0.0)], "sheet bigint, seq bigint, block string, x double, y double")
    declared = spark.createDataFrame([(1, "Q1", 3), (1, "Q2", 5), (1, "Q3", 12)], "sheet bigint, block string, declared int")
    got = {r.lot_id: r.quadra for r in P.refine_blocks(metas, blocks, declared, "sheet", "lot_id").collect()}
    assert got == {0: "Q1", 1: "Q3", 2: "Q2", 3: "Q1"}


def test_nearest_across_zero_and_in_clusters(spark):
    rng = random.Random(8)
    points = [(1, i, rng.uniform(-400, 400), rng.uniform(-400, 400)) for i in range(300)] + [(1, 300 + i, rng.gauss(50, 0.05), rng.gauss(-3, 0.05)) for i in range(300)]
    points += [(2, 900, 0.0, 0.0)]
    queries = [(1, 0, -0.01, -0.01), (1, 1, 501.0, 2.0), (1, 2, -430.0, -1.0), (1, 3, 50.0, -3.0), (2, 4, 1e6, 5.0)]
    schema = "k bigint, id bigint, x double, y double"
    got = Sp.nearest_k(spark.createDataFrame(queries, schema.replace("id", "q")), spark.createDataFrame(points, schema), "k", "q", "id", 5).collect()
    for k, q, x, y in queries:
        near = sorted((round(((px - x) ** 2 + (py - y) ** 2) ** 0.5, 9), i) for kk, i, px, py in points if kk == k)[:5]
        assert sorted((r.dist, r.r.id) for r in got if r.l.q == q) == near


def test_candidate_choice(spark):
    table = [(1603, 0.9042, 0.9980), (1496, 1.0, 0.9914), (1508, 0.9947, 0.9993), (1570, 0.9054, 0.9973)]
    df = spark.createDataFrame([(1, i, n, a, c) for i, (n, a, c) in enumerate(table)], "sheet int, rank int, n int, agreement double, coverage double")
    best = Q.choose_candidate(Q.score_candidates(df), "sheet").first()
    assert best.n == 1508 and best.score == pytest.approx(0.9958, abs=1e-4)


def holed(faces):
    return sorted((round(f.area_px, 6), round(f.bx0, 6), len(f.holes)) for f in faces.collect())


def test_holes_go_to_the_smallest_face_around(spark):
    """A lot with two holes, one of them with a lot and a lot in that; a neighbour; a hole that touches its frame; another sheet."""
    lines = sides(0, 0, 100, 50) + sides(10, 10, 40, 40) + sides(15, 15, 35, 35) + sides(20, 20, 25, 25) + sides(60, 10, 80, 30)
    lines += [(1, 70, 10, 70, 30)] + sides(100, 0, 150, 50) + sides(110, 0, 120, 10) + sides(-50, 0, -40, 10)
    lines += [(2, *r[1:]) for r in sides(30, 20, 50, 45)]
    want = [(5000 - 900 - 400, 0, 2), (900 - 400, 10, 1), (400 - 25, 15, 1), (25, 20, 0), (200, 60, 0), (200, 70, 0), (2500 - 100, 100, 0), (100, 110, 0), (100, -50, 0), (500, 30, 0)]
    assert holed(Fc.trace_faces(segments(spark, lines), "sheet")) == sorted((float(a), float(x), n) for a, x, n in want)
    # the window is on the area without holes, and a face below it still takes its hole
    assert [f[0] for f in holed(Fc.trace_faces(segments(spark, lines), "sheet", 401, 2500))] == [500, 500, 2400]


def test_round_holes_at_awkward_places(spark):
    """Hexagons in hexagons, turned so that no side is level, against polygon areas."""
    ring = lambda x, y, r, turn: [(x + r * math.cos(turn + i * math.pi / 3), y + r * math.sin(turn + i * math.pi / 3)) for i in range(6)]
    outlines = [ring(0, 0, 40, 0.1)] + [ring(x, y, 6, 0.3 * x) for x, y in ((-20, 0), (0, 0), (20, 0), (0, 20))] + [ring(0, 0, 3, 0.7), ring(100, 0, 10, 0.2), ring(45, 0, 3, 0.0)]
    lines = [(1, *r[i], *r[(i + 1) % 6]) for r in outlines for i in range(6)]
    size = lambda r: 1.5 * math.sqrt(3) * r * r
    want = [size(40) - 4 * size(6), *[size(6)] * 3, size(6) - size(3), size(3), size(10), size(3)]
    got = Fc.trace_faces(segments(spark, lines), "sheet").collect()
    assert sorted(round(f.area_px, 2) for f in got) == sorted(round(a, 2) for a in want)
    inner = {round(f.area_px, 2): f for f in got}
    assert len(inner[round(want[0], 2)].holes) == 4 and len(inner[round(want[4], 2)].holes) == 1


def test_labels_see_holes(spark):
    lines = sides(0, 0, 40, 20) + sides(10, 5, 20, 15)
    best = Fc.best_face_per_anchor(segments(spark, lines), points(spark, [(28, 10), (15, 10)]), "sheet", "label_id", 20, 900, snaps=(None,)).collect()
    assert {r.label_id: round(r.area_px, 6) for r in best} == {0: 700, 1: 100}


def test_interior_points_and_holed_areas(spark):
    shapes = [([(0, 0), (10, 0), (10, 10), (0, 10)], [[(1, 1), (9, 1), (9, 9), (1, 9)]]), ([(0, 0), (9, 0), (9, 1), (1, 1), (1, 9), (0, 9)], []),
              ([(0, 0), (8, 0), (4, 7)], [[(3, 1), (5, 1), (4, 3)]])]
    kind = "i int, ring array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>"
    fl = lambda r: [(float(x), float(y)) for x, y in r]
    rows = spark.createDataFrame([(i, fl(r), [fl(h) for h in hs]) for i, (r, hs) in enumerate(shapes)], kind)
    for r in rows.select("i", G.interior_point(F.col("ring"), F.col("holes")).alias("p"), G.holed_area(F.col("ring"), F.col("holes")).alias("a"),
                         G.holed_centroid(F.col("ring"), F.col("holes")).alias("c")).collect():
        ring, holes = shapes[r.i]
        inside = lambda poly: sum((a[1] > r.p.y) != (b[1] > r.p.y) and r.p.x < (b[0] - a[0]) * (r.p.y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(poly, poly[1:] + poly[:1])) % 2
        assert inside(ring) and not any(map(inside, holes))
        assert abs(r.a - [36, 17, 26][r.i]) < 1e-9
        assert r.i != 0 or abs(r.c.x - 5) + abs(r.c.y - 5) < 1e-9


def test_crowded_cell_is_tiled(spark, monkeypatch):
    """More pairs in one cell than a tile holds, on sides of unlike size, against brute force."""
    monkeypatch.setattr(Sp, "TILE", 16)
    rnd = random.Random(12)
    small = lambda n: [(x, y, x + rnd.random(), y + rnd.random()) for x, y in ((rnd.random() * 3, rnd.random() * 3) for _ in range(n))]
    left, right = small(90) + [(-50, -50, 50, 50)], small(300)
    make = lambda rows: spark.createDataFrame([(1, i, *map(float, r)) for i, r in enumerate(rows)], "k bigint, i bigint, bx0 double, by0 double, bx1 double, by1 double")
    got = [(r.a, r.b) for r in Sp.box_join(make(left), make(right), "k").select(F.col("l.i").alias("a"), F.col("r.i").alias("b")).collect()]
    want = {(i, j) for i, a in enumerate(left) for j, b in enumerate(right) if a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]}
    assert len(got) == len(set(got)) and set(got) == want


def test_hull_and_rectangle_of_large_rings(spark):
    """Hulls against the definition; rectangles against all directions between vertices; 2,000 vertices in a moment."""
    rnd = random.Random(21)
    rows = [[(rnd.uniform(0, 50), rnd.uniform(0, 50)) for _ in range(rnd.randint(3, 25))] for _ in range(30)]
    rows += [[(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (2.0, 3.0), (0.0, 3.0)], [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)], [(1.0, 1.0)] * 4, [(float(i % 5), float(i // 5)) for i in range(25)]]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, ring array<struct<x:double,y:double>>")
    for r in df.select("i", G.convex_hull(F.col("ring")).alias("h"), G.oriented_rect(F.col("ring")).alias("b")).collect():
        pts, hull = sorted(set(rows[r.i])), [(p.x, p.y) for p in r.h]
        cross = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
        if len(hull) > 2:
            assert all(cross(a, b, p) >= -1e-9 for a, b in zip(hull, hull[1:] + hull[:1]) for p in pts) and set(hull) <= set(pts)
        sides = [(b[0] - a[0], b[1] - a[1]) for a in pts for b in pts if a < b]
        if not sides:
            assert r.b is None
            continue
        extent = lambda u, v: max(p[0] * u + p[1] * v for p in pts) - min(p[0] * u + p[1] * v for p in pts)
        want = min(extent(u / math.hypot(u, v), v / math.hypot(u, v)) * extent(-v / math.hypot(u, v), u / math.hypot(u, v)) for u, v in sides)
        assert abs(r.b.area - want) < 1e-6
    ring = [(100 * math.cos(i * math.pi / 1000) + rnd.random(), 60 * math.sin(i * math.pi / 1000)) for i in range(2000)]
    big = spark.createDataFrame([(ring,)], "ring array<struct<x:double,y:double>>")
    assert abs(big.select(G.oriented_rect(F.col("ring"))["area"]).first()[0] - 200 * 120) < 300


def test_replicated_selections(spark):
    """The step is the selection's extent; rings times copies above 800 are refused; copies stay between 1 and 200."""
    box = lambda x, y: [(x, y), (x + 2.0, y), (x + 2.0, y + 1.0), (x, y + 1.0)]
    rows = [("a", 1, "L009", box(0.0, 0.0)), ("a", 2, "L010", box(5.0, 0.0))] + [("b", i, "L1", box(3.0 * i, 9.0)) for i in range(401)]
    df = spark.createDataFrame(rows, "k string, i int, name string, ring array<struct<x:double,y:double>>")
    got = {(r.k, r.i, r.copy): (r.name, r.ring[0].x) for r in Tr.replicate(df, 2, F.lit(0.0), 1.0, ["k"]).collect()}
    assert got == {("a", 1, 1): ("L010", 8.0), ("a", 1, 2): ("L011", 16.0), ("a", 2, 1): ("L011", 13.0), ("a", 2, 2): ("L012", 21.0)}
    assert Tr.replicate(df, 1, F.lit(0.0), 1.0, ["k"]).count() == 403
    assert Tr.replicate(df.where("k = 'a'"), 9999, F.lit(0.0), 1.0, ["k"]).count() == 400
    assert Tr.replicate(df, 3, F.lit(0.0), 1.0).count() == 3 * 403


def test_spatial_pairs_are_not_broadcast(spark):
    boxes = spark.createDataFrame([(1, i, float(i), 0.0, i + 1.0, 1.0) for i in range(6)], "sheet bigint, id bigint, bx0 double, by0 double, bx1 double, by1 double")
    pairs = Sp.box_join(boxes, boxes, "sheet").select("l.id", F.col("r.id").alias("other"))
    assert pairs.count() == 6 + 2 * 5
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_small_cycles_leave_the_doubling_early(spark, monkeypatch):
    rows = [(f"s{c:03d}.{i}", f"s{c:03d}.{(i + 1) % 4}") for c in range(50) for i in range(4)] + [(f"t{i:03d}", f"t{(i + 1) % 100:03d}") for i in range(100)]
    written = []
    monkeypatch.setattr(Fc, "cut", lambda df: written.append(cut(df)) or written[-1])
    found = Fc._label_cycles(spark.createDataFrame(rows, "id string, ptr string")).collect()
    assert len(found) == 300 and len(written) > 5
    assert written[-1].count() <= 100
    ahead = dict(rows)
    for r in found:
        at = r.id
        for _ in range(r.off):
            at = ahead[at]
        assert at == r.face == ("t000" if r.id[0] == "t" else r.id[:5] + "0")


def test_sizes_of_files_and_rings_over_all_tasks(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.sources.fileCompressionFactor", "1.0")
    assert with_true_sizes(session).conf.get("spark.sql.sources.fileCompressionFactor") == "16.0"
    session.conf.set("spark.sql.sources.fileCompressionFactor", "3.0")
    assert with_true_sizes(session).conf.get("spark.sql.sources.fileCompressionFactor") == "3.0"
    rings = Tables(spark, "/root/testdata/sf0.001").lot_rings()
    assert "RepartitionByExpression" in rings._jdf.queryExecution().optimizedPlan().toString()


def test_common_area_far_from_the_origin_in_any_direction(spark):
    """Angled and slanted rings, both ways round, at page corners where squared coordinates would eat the digits."""
    angled = [(0.0, 0.0), (20.0, 0.0), (20.0, 6.0), (8.0, 6.0), (8.0, 15.0), (0.0, 15.0)]
    slanted = [(0.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    cases = [(angled, angled, 7, 4, 35.0), (angled, RECT, 0, 0, 152.0), (RECT, angled, 0, -5, 92.0), (slanted, slanted, 2, 0, 32.0), (slanted, RECT, 0, 5, 37.5), (RECT, RECT, 30, 0, 0.0)]
    rows = []
    for base in (0.0, 1e6, -3e6):
        for i, (a, b, dx, dy, wanted) in enumerate(cases):
            for way in (1, -1):
                rows.append(([(x + base, y + base) for x, y in a][::way], [(x + base + dx, y + base + dy) for x, y in b], wanted))
    ring = "array<struct<x:double,y:double>>"
    found = spark.createDataFrame(rows, f"a {ring}, b {ring}, wanted double").select(G.common_area(F.col("a"), F.col("b")).alias("area"), "wanted").collect()
    assert [(r.area, r.wanted) for r in found if abs(r.area - r.wanted) > 1e-9] == []


def test_shares_of_a_task_do_not_grow_with_the_input(spark, monkeypatch):
    """Shuffles and files come in shares of 8 MB unless the session says otherwise; rows that geometry is made of in parts of a fixed size."""
    from parcelflow import adapters
    session, share = spark.newSession(), "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    for key in (share, "spark.sql.files.maxPartitionBytes"):
        session.conf.unset(key)
        assert with_true_sizes(session).conf.get(key) == "8m"
    session.conf.set(share, "32m")
    assert with_true_sizes(session).conf.get(share) == "32m"
    monkeypatch.setattr(adapters, "SPREAD_ROWS", 2)
    t = Tables(spark, "/root/testdata/sf0.001")
    n = t.lots.count()
    assert f"RepartitionByExpression [lot_id" in (plan := t.lot_rings()._jdf.queryExecution().optimizedPlan().toString()) and f", {-(-n // 2)}" in plan


def test_tessellation_is_spread_over_all_tasks(spark):
    from parcelflow.plans.all_queries import QUERIES
    steps = QUERIES["geo_tessellate"](spark, "/root/testdata/sf0.001")
    assert "RepartitionByExpression [lot_id" in steps._jdf.queryExecution().optimizedPlan().toString() and steps.where("steps > 1").count() == steps.count() > 0


def test_settled_sheets_are_traced_on_one_rung(spark, monkeypatch):
    """Only the sheet whose sides do not meet on the first grid goes on to the others; a sheet with one layer is not traced."""
    lot = lambda key, end: [(key, 0, 0, 10, 0), (key, 10, 0, 10, 10), (key, 10, 10, 0, 10), (key, 0, 10, 0, end)]
    lines = segments(spark, lot(1, 0) + lot(2, 0.9) + lot(3, 0))
    labels = spark.createDataFrame([(i, i, 5.0, 5.0) for i in (1, 2, 3)], "sheet bigint, label_id bigint, x double, y double")
    layers = spark.createDataFrame([(1, 2), (2, 2), (3, 1)], "sheet bigint, layer_count int")
    asked, meshes = [], Fc.meshes

    def seen(rows, *args, **kwargs):
        asked.append(sorted(meshes(rows, *args, **kwargs).select("mesh.sheet", "mesh.rank").distinct().collect()))
        return meshes(rows, *args, **kwargs)

    monkeypatch.setattr(Fc, "meshes", seen)
    got = P.layered_lots(lines, labels, layers, "sheet", "label_id", 20, 6000, minimum=1).collect()
    assert sorted(r.label_id for r in got) == [1, 2]
    assert asked == [[(1, 0), (2, 0)], [(2, r) for r in range(1, len(P.LAYER_SNAPS))]]


def test_a_side_drawn_both_ways_counts_once(spark, monkeypatch):
    counts, join = [], Fc.box_join
    monkeypatch.setattr(Fc, "box_join", lambda l, r, key: counts.append(l.count()) or join(l, r, key))
    both = [(1, 0, 0, 10, 0), (1, 10, 0, 10, 10), (1, 10, 10, 0, 0)]
    lines = segments(spark, both + [(k, c, d, a, b) for k, a, b, c, d in both])
    assert Fc.noded_edges(lines, "sheet").count() == 3 and counts == [3]


def test_only_faces_with_loose_ends_are_traced_again(spark, monkeypatch):
    """A far lot without loose ends keeps its first tracing; what is left is the drawing without loose ends."""
    lines = sides(0, 0, 20, 10) + sides(100, 0, 110, 10) + [(1, 3, 3, 6, 6), (1, 6, 6, 9, 3), (1, 20, 10, 25, 15)]
    sizes, half = [], Fc._half_edges
    monkeypatch.setattr(Fc, "_half_edges", lambda edges, key: sizes.append(edges.count()) or half(edges, key))
    of = lambda rows: sorted((r.face, r.off, tuple(r.a), tuple(r.b)) for r in Fc.face_cycles(segments(spark, rows), "sheet").collect())
    got = of(lines)
    assert sizes == [11, 4]
    assert got == of(sides(0, 0, 20, 10) + sides(100, 0, 110, 10)) and len(got) == 16
