"""Costly values are made once: gaps of rings, traced faces, products of crossing tests."""

import random

from pyspark.sql import functions as F

from parcelflow.functions import geometry as G
from parcelflow.operators import faces as Fc, pipelines as P
from parcelflow.plans.q_pipelines import BOX, boxes


def _row_of_lots(spark, n):
    return boxes(spark.range(n).select(F.lit(1).alias("sheet_id"), F.col("id").alias("lot_id")), "lot_id * 20", "0", "lot_id * 20 + 20", "15")


def test_recovery_measures_gaps_once(spark, monkeypatch):
    lots = _row_of_lots(spark, 5)
    faces = lots.select("sheet_id", F.concat(F.lit("f"), F.col("lot_id").cast("string")).alias("face_id"), "ring", "area_px", *BOX)
    trusted = lots.where("lot_id in (0, 4)")
    labels = lots.select("sheet_id", F.col("lot_id").alias("label_id"), (F.col("bx0") + 10).alias("x"), F.lit(7.5).alias("y"))
    calls, real = [], P.rings_within
    monkeypatch.setattr(P, "rings_within", lambda *a: calls.append(a) or real(*a))
    found = P.recover_neighbours(trusted, faces, labels, labels.where("false").select("sheet_id", "x", "y"), "sheet_id", "lot_id", "label_id")
    # f2 is too far from every trusted lot to be a candidate
    assert sorted(r.face_id for r in found.collect()) == ["f1", "f3"]
    assert len(calls) == 2


def test_repair_makes_faces_once(spark):
    made = spark.sparkContext.accumulator(0)

    def name(v):
        made.add(1)
        return f"f{v}"

    lots = _row_of_lots(spark, 6)
    faces = lots.select("sheet_id", F.udf(name)("lot_id").alias("face_id"), "ring", "area_px", *BOX)
    labels = lots.select("sheet_id", F.col("lot_id").alias("label_id"), (F.col("bx0") + 10).alias("x"), F.lit(7.5).alias("y"))
    added = P.repair_gaps(lots.where("lot_id < 4"), faces, labels, "sheet_id", "label_id", "lot_id")
    assert sorted(r.face_id for r in added.collect()) == ["f4", "f5"]
    assert made.value == 6


def test_cut_points_equal_the_single_tests(spark):
    draw = random.Random(5)
    rows = [(i, *[float(draw.randint(0, 6)) for _ in range(8)]) for i in range(400)]
    side = lambda *names: F.struct(F.col("k"), *[F.col(n).alias(c) for n, c in zip(names, ("ax", "ay", "bx", "by"))])
    flat = spark.createDataFrame(rows, "k int, a double, b double, c double, d double, e double, f double, g double, h double")
    pairs = flat.where("a <> c or b <> d").select(side("a", "b", "c", "d").alias("l"), side("e", "f", "g", "h").alias("r"))
    got = Fc._cut_points(pairs, ["k", "ax", "ay", "bx", "by"], 1e-6)
    ends = [[F.col(f"{s}.{c}") for c in ("ax", "ay", "bx", "by")] for s in ("l", "r")]
    touch = lambda x, y: G.foot_inside(x, y, *ends[0], 1e-6)
    cuts = F.array_compact(F.array(G.crossing_params(*ends[0], *ends[1])["t"], touch(*ends[1][:2]), touch(*ends[1][2:])))
    expected = pairs.select("l.k", F.explode(cuts).alias("t"))
    assert sorted((r.k, r.t) for r in got.collect()) == sorted((r.k, r.t) for r in expected.collect())
    assert expected.count() > 50


def test_grids_and_nodes_round_as_before(spark):
    values = [0.5, 1.5, -0.5, -2.5, 0.25, -0.2, 0.49999999999999994, 1234567.5, -7.0000005, 12.3456785, 4503599627.370497]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    node = Fc._node(F.col("v"), F.col("v"))[0]
    both = rows.select(node.alias("n"), F.round(F.col("v") * Fc.NODE_SCALE).cast("bigint").alias("m")).collect()
    assert [r.n for r in both] == [r.m for r in both]
    lines = rows.select(F.col("v").alias("ax"), F.lit(0.0).alias("ay"), F.lit(9e9).alias("bx"), F.lit(0.0).alias("by"), F.bround(F.col("v") / 1.0).alias("want"))
    assert all(str(r.ax) == str(r.want) for r in Fc.snap_segments(lines, F.lit(1.0)).collect())


def test_rectangles_and_gaps_by_either_path(spark):
    quad = [(0.0, 0.0), (8.0, 2.0), (7.0, 6.0), (-1.0, 4.0)]
    dented = [(0.0, 0.0), (8.0, 0.0), (2.0, 2.0), (0.0, 8.0)]
    rect = lambda p: spark.createDataFrame([([dict(x=x, y=y) for x, y in p],)], "ring array<struct<x:double,y:double>>").select(
        G.oriented_rect(F.col("ring")).alias("r"), G._best_rect(*[f(G.convex_hull(F.col("ring"))) for f in (
            lambda h: h, lambda h: F.transform(G.edges(h), lambda e: F.struct((e["bx"] - e["ax"]).alias("dx"), (e["by"] - e["ay"]).alias("dy"))))]).alias("h")).first()
    for ring in (quad, quad[::-1], dented, dented[::-1]):
        got = rect(ring)
        assert got.r == got.h
    pair = spark.createDataFrame([([dict(x=0.0, y=0.0), dict(x=1.0, y=0.0), dict(x=0.0, y=1.0)], [dict(x=1.0, y=0.0), dict(x=5.0, y=0.0), dict(x=5.0, y=1.0)]),
                                  ([dict(x=0.0, y=0.0), dict(x=1.0, y=0.0), dict(x=0.0, y=1.0)], [dict(x=3.0, y=0.0), dict(x=5.0, y=0.0), dict(x=5.0, y=1.0)])],
                                 "a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>")
    assert [r.g for r in pair.select(G.ring_gap(F.col("a"), F.col("b")).alias("g")).collect()] == [0.0, 2.0]
