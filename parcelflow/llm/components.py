"""Connected components of a link table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parcelflow.session import cut


def _starred(edges: DataFrame, larger: bool) -> DataFrame:
    """Links every node's (larger or smaller) neighbours to the smallest one around it."""
    if larger:
        sides = edges.union(edges.select("v", "u")).toDF("u", "v")
    else:
        sides = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    if larger:
        out = sides.join(least, sides.u == least.k).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = sides.join(least, sides.u == least.k).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("k", "m"))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links of longs → (u, root): the smallest node reachable; nodes that are their own root are left out.

    Alternates two star operations, each a grouped minimum (combined before the shuffle) and a join,
    until the links no longer change; every round's links are written, so a lost executor costs its
    running tasks only. No node's neighbours are ever gathered. An empty table gives an empty table.
    """
    spark = edges.sparkSession
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(edges)
    while before[0]:
        large = cut(_starred(edges, True))
        edges = cut(_starred(large, False))
        after = mark(edges)
        if after == before:
            break
        before = after
    return spark.createDataFrame([], "u long, root long") if not before[0] else edges.select("u", F.col("v").alias("root"))
