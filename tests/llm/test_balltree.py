import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelflow.llm import balltree


def plain_top_k(rows, k):
    """rows of (id, vector); queries are those whose id is divisible by 5; a query meets all rows but itself."""
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for own, (q, qv) in enumerate(sound):
        if q % 5:
            continue
        scored = sorted((-sum(a * b for a, b in zip(qv, v)), i) for n, (i, v) in enumerate(sound) if n != own)[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def make_rows(n):
    rng = np.random.default_rng(n)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.3, 8)]) for i in range(n)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)]  # ties
    rows += [(2000, None), (2005, [0.1, None]), (2010, [float("nan")] * 8), (2015, [float("inf")] * 8), (None, [1.0] * 8),
             (2020, [0.5, -0.5]), (2025, [])]
    rows += [(5, rows[5][1]), (5, rows[5][1]), (10, rows[11][1]), (11, rows[10][1])]  # repeated ids, equal rows too
    return rows


@pytest.mark.parametrize("shard_rows", [40, 10_000])
def test_equals_brute_force(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(balltree, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(balltree, "BLOCK_QUERIES", 25)
    rows = make_rows(230)
    df = spark.createDataFrame([(i, v, "s", 0) for i, v in rows], "vec_id long, embedding array<float>, shard string, rank int")
    got = balltree.top_k(df, F.col("vec_id") % 5 == 0, k=4).collect()
    assert sorted(tuple(r) for r in got) == plain_top_k(rows, 4)


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (5, [-1.0]), (6, [0.5])], "vec_id long, embedding array<float>")
    got = {tuple(r) for r in balltree.top_k(df, F.col("vec_id") % 5 == 0).collect()}
    assert got == {(0, 1, 6, 256 * 128), (0, 2, 5, -65536), (5, 1, 6, -256 * 128), (5, 2, 0, -65536)}
    assert balltree.top_k(df.where("false"), F.col("vec_id") % 5 == 0).count() == 0
    twice = spark.createDataFrame([(5, [1.0]), (5, [2.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in balltree.top_k(twice, F.lit(True)).collect()) == [(5, 1, 5, 131072)] * 2
    with pytest.raises(ValueError):
        balltree.top_k(spark.createDataFrame([(1, [3e14])], "vec_id long, embedding array<double>"), F.lit(True))


def test_tree_prunes():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 400, (40, 6))
    vectors = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(0, 4, (4000, 6))).astype(np.int64)
    tree = balltree.BallTree(vectors)
    asked = []
    tree.vectors = type("Seen", (), {"__getitem__": lambda self, s, v=tree.vectors: asked.append(s.stop - s.start) or v[s]})()
    ids = np.arange(4000)
    best = tree.search(vectors[0], ids, 0, 5, None)
    assert sum(asked) < 2000
    want = sorted((-int(s), int(i)) for i, s in enumerate(vectors @ vectors[0]) if i)[:5]
    assert sorted((-s, i) for s, i in best) == want
