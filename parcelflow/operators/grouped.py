"""Grouped primitives that stay exact and distributed when one group holds most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelflow.session import cut

BUCKETS_PER_E = 65536


def order_statistic(df: DataFrame, keys: list[str], value: str, rank, low_rank=None, out: str = "value",
                    count: str = "samples") -> DataFrame:
    """Exact value at 1-based position ``rank(n)`` of each group, with the group size ``n``.

    With ``low_rank`` the mean of the values at both positions (the same or neighbours). A logarithmic
    histogram (combined before the shuffle) finds the bucket of the wanted position; only the
    values of that bucket are then ranked. No group is ever sorted whole.
    """
    rows = df.select(*keys, F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    bucket = F.floor(F.signum("_v") * F.log1p(F.abs("_v")) * BUCKETS_PER_E)
    rows = rows.withColumn("_b", bucket)
    histogram = rows.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    ordered = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    ranks = histogram.select(
        *keys, "_b", (F.sum("_n").over(ordered) - F.col("_n")).alias("_before"), "_n",
        F.sum("_n").over(whole).alias(count))
    high = rank(F.col(count))
    low = low_rank(F.col(count)) if low_rank else high
    wanted = ranks.where((F.col("_before") < high) & (low <= F.col("_before") + F.col("_n"))).select(
        *keys, "_b", (low - F.col("_before")).alias("_lo"), (high - F.col("_before")).alias("_hi"), count)
    values = rows.join(wanted, [*keys, "_b"]).groupBy(*keys, "_b", "_v").agg(
        F.count("*").alias("_n"), F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.max(count).alias(count))
    upto = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    values = values.withColumn("_upto", F.sum("_n").over(upto))
    at = lambda r: F.max(F.when((F.col("_upto") - F.col("_n") < F.col(r)) & (F.col(r) <= F.col("_upto")), F.col("_v")))
    return values.groupBy(*keys).agg(((at("_lo") + at("_hi")) / 2).alias(out), F.max(count).alias(count))


def upper_median(df: DataFrame, keys: list[str], value: str, out: str = "median", count: str = "samples",
                 true_median: bool = False) -> DataFrame:
    """Exact ``sorted(v)[len // 2]`` per group; ``true_median`` averages the two middle values instead."""
    low = (lambda n: F.floor((n + 1) / 2)) if true_median else None
    return order_statistic(df, keys, value, lambda n: F.floor(n / 2) + 1, low, out, count)


def group_rank(df: DataFrame, keys: list[str], order: list[Column | str], out: str = "rank") -> DataFrame:
    """1-based position in the group, for groups too large to be sorted by one task.

    One range shuffle on (keys, order) sorts everything; a group that spans partitions gets its
    offsets from the per-partition counts. ``order`` must be unique within the group. The sorted
    rows are checkpointed, so both reads see the same partitioning.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    placed = cut(ranged.withColumn("_mid", F.monotonically_increasing_id()))
    placed = placed.withColumn("_pid", F.shiftright("_mid", 33))
    runs = placed.groupBy(*keys, "_pid").agg(F.min("_mid").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*keys, "_pid", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    ranked = placed.join(runs, [*keys, "_pid"])
    position = F.col("_base") + F.col("_mid") - F.col("_first") + 1
    return ranked.select(*df.columns, position.alias(out))


def first_rows(df: DataFrame, keys: list[str], order: list[Column], limit: int, rank: str = "rn") -> DataFrame:
    """The first ``limit`` rows per group. Spark keeps only that many per group and task before
    the shuffle, so a huge group costs no more than a small one."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= limit)


def pick_row(df: DataFrame, keys: list[str], order: Column, latest: bool = True) -> DataFrame:
    """The whole row with the greatest (or smallest) ``order`` per group, as a combining aggregate."""
    row = F.struct(*[c for c in df.columns if c not in keys])
    best = F.max_by(row, order) if latest else F.min_by(row, order)
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*")


def previous_value(df: DataFrame, keys: list[str], order: list[Column | str], value: str, out: str) -> DataFrame:
    """``lag(value)`` per group in ``order``, for groups too large to be sorted by one task.

    One range shuffle on (keys, order) sorts everything. Inside a partition it is a window; the first row of a group in a
    partition takes the group's last value of the partition before, found over one summary row per group and partition.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    placed = cut(ranged.withColumn("_mid", F.monotonically_increasing_id()))
    placed = placed.withColumn("_pid", F.shiftright("_mid", 33))
    inner = Window.partitionBy(*keys, "_pid").orderBy("_mid")
    lagged = placed.withColumns({"_lag": F.lag(value).over(inner), "_rn": F.row_number().over(inner)})
    last = placed.groupBy(*keys, "_pid").agg(F.max_by(value, "_mid").alias("_last"))
    carried = last.select(*keys, "_pid", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_pid")).alias("_carry"))
    joined = lagged.join(carried, [*keys, "_pid"])
    return joined.select(*df.columns, F.when(F.col("_rn") == 1, F.col("_carry")).otherwise(F.col("_lag")).alias(out))
