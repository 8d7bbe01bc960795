"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``replicas`` points of the ring. A key's hash falls into an arc between two points; the
arc's clockwise order of distinct shards is the key's order of preference. Keys arrive one after another
and take the first shard of their order that is not full, so an overflowing key continues clockwise.

All keys of an arc share their order, so nothing is walked key by key: keys arrive in ``BUCKETS`` rounds
(by a second hash), inside a round arc by arc. Keys of one arc and round are a *cell*, and a cell is dealt
as a whole: so many to its first shard, the overflow to the next. The plan needs the cells' counts only,
``shards * replicas * BUCKETS`` numbers at most, whatever the number of keys.

Defined results: keys are (id, size, checksum); a null id or checksum is a value like any other; repeated
keys share an arc, and more than ``SPREAD`` of one are dealt over all rounds, so no cell holds them alone;
equal texts under different ids are different keys. No rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from parcelflow.llm.arrow import free_name
from parcelflow.session import cut

BUCKETS = 16
SPREAD = 1000


def ring(shards: int, replicas: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted points of the ring (unsigned 64 bit) and the shard that owns each."""
    points = sorted((xxhash.xxh64_intdigest(f"shard {s} point {r}".encode(), 7), s)
                    for s in range(shards) for r in range(replicas))
    return np.array([p for p, _ in points], np.uint64), np.array([s for _, s in points])


def preferences(owners: np.ndarray, shards: int) -> np.ndarray:
    """For each arc (it ends at the point of the same index): all shards in clockwise order."""
    out = np.empty((len(owners), shards), np.int64)
    for arc in range(len(owners)):
        turn = np.concatenate([owners[arc:], owners[:arc]])
        _, first = np.unique(turn, return_index=True)
        out[arc] = turn[np.sort(first)]
    return out


def capacities(total: int, shards: int, slack: float) -> list[int]:
    """Rows a shard may hold: with no slack the counts add up to ``total`` and are at most one apart."""
    if slack:
        return [-(-int(total * (1 + slack)) // shards)] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def deal(cells: dict[tuple[int, int], int], order: np.ndarray, limits: list[int]) -> list[tuple[int, int, int, int, int, int]]:
    """Cells (round, arc) → count, dealt in order: (round, arc, first, end, shard, slot of the first)."""
    used = [0] * len(limits)
    pieces = []
    for (bucket, arc), count in sorted(cells.items()):
        at = 0
        for shard in order[arc].tolist():
            take = min(count - at, limits[shard] - used[shard])
            if take:
                pieces.append((bucket, arc, at, at + take, shard, used[shard]))
                used[shard] += take
                at += take
            if at == count:
                break
    return pieces


def with_arcs(keys: DataFrame, points: np.ndarray) -> DataFrame:
    """Adds ``arc`` to rows with the long column ``h``: the first point at or after the hash, around the ring."""

    def run(batches):
        for batch in batches:
            h = batch.column("h").to_numpy().view(np.uint64)
            arc = (np.searchsorted(points, h) % len(points)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(arc)], names=[*batch.schema.names, "arc"])

    return keys.mapInArrow(run, f"{', '.join(f'{n} {t}' for n, t in keys.dtypes)}, arc int")


def assign(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shards: int = 24, replicas: int = 64,
           slack: float = 0.0) -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes plus 8), text_crc32, ``shard`` and ``slot`` (gapless from 0).

    With ``slack`` 0 the shards' row counts are at most one apart; otherwise a shard holds at most
    ``(1 + slack)`` times the mean and fewer keys move when a shard is added.
    """
    spark = docs.sparkSession
    points, owners = ring(shards, replicas)
    body = F.col(text).cast("string")
    keys = docs.select(F.col(id_column).alias("doc_id"), (F.coalesce(F.octet_length(body), F.lit(0)) + 8).cast("long").alias("size"),
                       F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"))
    keys = keys.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    keys = with_arcs(keys.withColumn("h", F.xxhash64("doc_id")), points)
    second = F.pmod(F.xxhash64("doc_id", "size", "text_crc32", F.lit("round")), F.lit(BUCKETS)).cast("int")
    parts = F.when(F.col("copies") <= SPREAD, F.array(F.struct(second.alias("bucket"), F.col("copies").alias("m")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.struct(
            b.alias("bucket"), F.floor((F.col("copies") + BUCKETS - 1 - b) / BUCKETS).cast("long").alias("m"))))
    keys = cut(keys.select("doc_id", "size", "text_crc32", "h", "arc", F.inline(parts)))
    counted = keys.groupBy("bucket", "arc").agg(F.sum("m").alias("n")).collect()  # bounded by the ring, not by the keys
    cells = {(r.bucket, r.arc): r.n for r in counted}
    pieces = deal(cells, preferences(owners, shards), capacities(sum(cells.values()), shards, slack))
    plan = spark.createDataFrame(pieces, "bucket int, arc int, first long, end long, shard int, base long")
    within = Window.partitionBy("bucket", "arc").orderBy("h", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, 0)
    ranked = keys.withColumn("hi", F.sum("m").over(within)).withColumn("lo", F.col("hi") - F.col("m"))
    met = ranked.join(plan, ["bucket", "arc"]).where((F.col("lo") < F.col("end")) & (F.col("first") < F.col("hi")))
    span = F.sequence(F.greatest("lo", "first"), F.least("hi", "end") - 1)
    return met.withColumn("rank", F.explode(span)).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", **options) -> None:
    """Writes the whole documents, one folder ``shard=N`` each; a document's copies take their shards in slot order.

    Copies that differ in other columns are ordered by a hash of the whole row, so a repeated task deals them alike.
    If there is a column ``shard`` already, it stays, and the folders are named ``_shard=N``.
    """
    body = F.col(text).cast("string")
    ident, size, crc, copy = [free_name(docs, n) for n in ("_id", "_size", "_crc", "_copy")]
    full = docs.select("*", F.col(id_column).alias(ident), (F.coalesce(F.octet_length(body), F.lit(0)) + 8).cast("long").alias(size),
                       F.crc32(F.encode(body, "UTF-8")).alias(crc), F.xxhash64(F.to_json(F.struct("*"))).alias(copy))
    full = full.withColumn(copy, F.row_number().over(Window.partitionBy(ident, size, crc).orderBy(copy)))
    where = assign(docs, id_column, text, **options).withColumn(
        "copy", F.row_number().over(Window.partitionBy("doc_id", "size", "text_crc32").orderBy("shard", "slot")))
    there = {c: free_name(full, f"_w_{c}") for c in ("doc_id", "size", "text_crc32", "copy")}
    folder = free_name(full, "shard")
    where = where.select(*[F.col(c).alias(n) for c, n in there.items()], F.col("shard").alias(folder))
    same = (full[ident].eqNullSafe(where[there["doc_id"]]) & (full[size] == where[there["size"]])
            & full[crc].eqNullSafe(where[there["text_crc32"]]) & (full[copy] == where[there["copy"]]))
    full.join(where, same).drop(ident, size, crc, copy, *there.values()).write.partitionBy(folder).parquet(path)
