"""Exact top-k search by inner product: a ball tree per shard, branch and bound per query.

A node's ball (centre c, radius r) bounds every inner product inside it by q.c + |q| r. Nodes are visited
by falling bound, and the search of a shard ends when the bound falls below the query's current k-th
score. That score is shared: each query first searches its home shard, and all other shards start from
the k-th score found there.

Shards and query blocks have a fixed size, so a task holds one shard and one block, whatever the table.

Defined results: vectors that are null or hold a null or non-finite component, and rows without an id,
take no part; shorter vectors count as padded with zeros; only the query's own row is left out of its
candidates, so rows of a repeated id are each other's candidates, and each is answered as a query of its
own; equal scores rank by smaller id. No rows give no rows. A table with vectors so long that a product
could leave 64 bits is refused.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelflow.session import cut

LEAF = 64
SHARD_ROWS = 8192
BLOCK_QUERIES = 2048
ANSWER = "query_no long, query_id long, vec_id long, score long"


class BallTree:
    """A binary tree of balls over integer vectors; leaves hold at most ``LEAF`` rows."""

    def __init__(self, vectors: np.ndarray):
        self.order = np.arange(len(vectors))
        self.centre, self.radius, self.span, self.children = [], [], [], []
        floats = vectors.astype(np.float64)
        todo = [(0, len(vectors), None, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            rows = floats[self.order[lo:hi]]
            centre = rows.mean(axis=0)
            gap = np.sqrt(((rows - centre) ** 2).sum(axis=1))
            node = len(self.centre)
            self.centre.append(centre)
            self.radius.append(gap.max())
            self.span.append((lo, hi))
            self.children.append([])
            if parent is not None:
                self.children[parent].append(node)
            if hi - lo > LEAF:
                # halve along the line between two far points; equal points halve as well
                far = rows[gap.argmax()]
                other = rows[((rows - far) ** 2).sum(axis=1).argmax()]
                half = (hi - lo) // 2
                self.order[lo:hi] = self.order[lo:hi][np.argpartition(rows @ (other - far), half)]
                todo += [(lo, lo + half, node, 0), (lo + half, hi, node, 1)]
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)
        self.vectors = vectors[self.order]

    def search(self, query: np.ndarray, ids: np.ndarray, own: int | None, k: int, floor: int | None) -> list[tuple[int, int]]:
        """The k best (score, id) of this tree, smaller ids first among equals; only scores of ``floor`` or more.

        ``own`` is the position of the query's own vector, if it is in this tree.
        """
        q = query.astype(np.float64)
        norm = np.sqrt(q @ q)
        bounds = self.centre @ q + norm * self.radius
        bounds += 1e-9 * (np.abs(bounds) + norm * (self.radius + 1)) + 1e-6  # rounding must not cut a node off
        best: list[tuple[int, int]] = []  # heap of (score, -id)
        front = [(-bounds[0], 0)]
        while front:
            bound, node = heapq.heappop(front)
            limit = best[0][0] if len(best) == k else floor
            if limit is not None and -bound < limit:
                break
            if self.children[node]:
                for child in self.children[node]:
                    if limit is None or bounds[child] >= limit:
                        heapq.heappush(front, (-bounds[child], child))
                continue
            lo, hi = self.span[node]
            scores = self.vectors[lo:hi] @ query
            for i in (np.arange(hi - lo) if limit is None else np.flatnonzero(scores >= limit)):
                if self.order[lo + i] == own:
                    continue
                entry = (int(scores[i]), -int(ids[self.order[lo + i]]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return [(s, -i) for s, i in best]


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for i, v in enumerate(column):
        out[i, :len(v)] = v
    return out


def _search_cells(k: int):
    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(vectors) and len(queries):
            width = max(1, max(map(len, vectors.v)), max(map(len, queries.v)))
            tree, ids = BallTree(_matrix(vectors.v, width)), vectors.vec_id.to_numpy()
            places = {number: i for i, number in enumerate(vectors.row_no.tolist())}
            for number, query_id, query, floor in zip(queries.query_no.tolist(), queries.vec_id, _matrix(queries.v, width), queries.floor):
                floor = None if pd.isna(floor) else int(floor)
                found += [(number, query_id, i, s) for s, i in tree.search(query, ids, places.get(number), k, floor)]
        return pd.DataFrame(found, columns=["query_no", "query_id", "vec_id", "score"])

    return run


def _best(answers: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_no").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(table: DataFrame, is_query: Column, id_column: str = "vec_id", vector: str = "embedding", k: int = 5,
          scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` largest integer inner products over the whole table.

    Components are ``floor(scale * x)`` with x as double. ``is_query`` is a condition on ``table``'s columns.
    """
    x = F.col(vector)
    sound = x.isNotNull() & F.col(id_column).isNotNull() & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = cut(table.where(sound).select(
        F.col(id_column).cast("long").alias("vec_id"), is_query.alias("q"),
        F.monotonically_increasing_id().alias("row_no"),
        F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long")).alias("v")))
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    total, asked, longest = rows.agg(F.count("*"), F.count_if("q"), F.coalesce(F.max(square), F.lit(0.0))).first()
    if longest >= 2.0 ** 62:
        raise ValueError("vectors too long for products of 64 bits")
    shards, blocks = max(1, -(-total // SHARD_ROWS)), max(1, -(-asked // BLOCK_QUERIES))
    home = F.pmod(F.xxhash64("row_no"), F.lit(shards))
    stored = rows.select("vec_id", "v", "row_no", home.alias("shard"))
    queries = rows.where("q").select("vec_id", "v", F.col("row_no").alias("query_no"), home.alias("home"))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("query_no", F.lit("block")), F.lit(blocks)))
    queries = cut(queries)
    cells = stored.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def search(asked_: DataFrame) -> DataFrame:
        return cells.groupBy("shard", "block").cogroup(asked_.groupBy("shard", "block")).applyInPandas(_search_cells(k), ANSWER)

    first = queries.select("vec_id", "v", "query_no", "block", F.col("home").alias("shard"), F.lit(None).cast("long").alias("floor"))
    at_home = cut(search(first))
    floors = at_home.groupBy("query_no").agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    rest = queries.join(floors, "query_no", "left").withColumn("shard", every).where("shard <> home").select(
        "vec_id", "v", "query_no", "block", "shard", "floor")
    answers = _best(at_home.unionByName(search(rest)), k)
    return answers.select("query_id", "rank", "vec_id", "score")
