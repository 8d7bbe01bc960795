"""Request budgets, failure windows and idempotency classes, in batch form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from parcelflow.operators.grouped import first_rows
from parcelflow.session import cut

FAILURE_LIMIT = 8
FAILURE_WINDOW_SECONDS = 900


def minute_budget(requests: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` requests of a key per minute are allowed, the rest get ``retry_after``.

    ``requests(seq, key_id, ts)``. Only the first ``limit`` rows per key and minute are ranked;
    every other row just compares itself with the last allowed one.
    """
    minute = F.date_trunc("minute", F.col("ts")).cast("timestamp_ntz")
    rows = requests.withColumn("minute", minute)
    allowed = first_rows(rows.select("key_id", "minute", "seq"), ["key_id", "minute"], [F.col("seq")], limit)
    last = allowed.groupBy("key_id", "minute").agg(F.max("seq").alias("_last"))
    joined = rows.join(last, ["key_id", "minute"])
    ok = F.col("seq") <= F.col("_last")
    wait = F.greatest(F.lit(1), 60 - F.second("ts")).cast("int")
    return joined.select(*requests.columns, ok.alias("allowed"), F.when(~ok, wait).alias("retry_after"))


def sliding_failures(failures: DataFrame, keys: list[str], limit: int = FAILURE_LIMIT,
                     window_seconds: int = FAILURE_WINDOW_SECONDS) -> DataFrame:
    """Failures of the key in the trailing window at every failure, and the wait when it is full.

    Time is cut into strips one window long, and a strip sees the failures of the one before it, so a busy
    key is spread over its strips. In a strip every failure asks twice: how many failures there are up to
    now, and up to one window ago. Both are running sums, so the cost does not grow with the
    failures inside a window.
    """
    span = window_seconds * 1_000_000
    rows = cut(failures.withColumns({"_t": F.unix_micros(F.col("ts").cast("timestamp")), "_id": F.monotonically_increasing_id()}))
    strip = F.floor(F.col("_t") / span)
    mark = lambda at, hit, ask, shift=0: F.struct((strip + shift).alias("strip"), at.alias("at"), F.lit(hit).alias("hit"), F.lit(ask).alias("ask"))
    now, past = mark(F.col("_t"), 0, 1), mark(F.col("_t") - span, 0, 2)
    marks = rows.select(*keys, "_id", F.explode(F.array(mark(F.col("_t"), 1, 0), mark(F.col("_t"), 1, 0, 1), now, past)).alias("m")).select(*keys, "_id", "m.*")
    # The window is open at its old end: a failure exactly one window ago no longer counts.
    upto = Window.partitionBy(*keys, "strip").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys, "strip").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, -1)
    answered = marks.withColumns({"n": F.sum("hit").over(upto), "next": F.min(F.when(F.col("hit") == 1, F.col("at"))).over(after)}).where("ask > 0")
    of = lambda ask, c: F.max(F.when(F.col("ask") == ask, F.col(c)))
    found = answered.groupBy("_id").agg((of(1, "n") - of(2, "n")).alias("failures"), of(2, "next").alias("_oldest"))
    counted = rows.join(found, "_id")
    wait = F.greatest(F.lit(1), F.ceil((F.col("_oldest") + span - F.col("_t")) / 1_000_000)).cast("bigint")
    full = F.col("failures") >= limit
    return counted.select(*failures.columns, "failures", full.alias("blocked"), F.when(full, wait).alias("retry_after"))


def walk_attempts(t: np.ndarray, ok: np.ndarray, hits: list[int], limit: int, span: int) -> tuple[np.ndarray, list[int]]:
    """When each attempt's block ends (0: not blocked) and the failures that count after the last one.

    ``t`` rises. Only failures that count and successes that clear take a step: a block is left by one search for its end,
    and what follows a cleared state up to the next failure changes nothing.
    """
    until = np.zeros(len(t), np.int64)
    failures = np.flatnonzero(~ok)
    at = 0
    while at < len(t):
        now = int(t[at])
        hits = [h for h in hits if h > now - span]
        if len(hits) >= limit:
            end = min(hits) + span
            after = int(np.searchsorted(t, end))
            until[at:after] = end
            at = after
        elif ok[at]:
            hits = []
            k = int(np.searchsorted(failures, at))
            at = int(failures[k]) if k < len(failures) else len(t)
        else:
            hits.append(now)
            at += 1
    return until, hits


_WALKED = "key string, chunk bigint, seq bigint, blocked boolean, retry_after bigint, hits array<bigint>"


def _walked(rows: DataFrame, starts: DataFrame, limit: int, span: int, emit: bool) -> DataFrame:
    """Walks chunks of ``rows(key, chunk, t, seq, ok)`` from ``starts(key, chunk, hits)``: a row per attempt if asked, and the hits at each chunk's end."""
    none = F.lit(None)
    heads = starts.select("key", "chunk", F.lit(0).alias("kind"), none.cast("bigint").alias("t"), none.cast("bigint").alias("seq"), none.cast("boolean").alias("ok"), "hits")
    tails = rows.join(starts.select("key", "chunk"), ["key", "chunk"], "left_semi").select(
        "key", "chunk", F.lit(1).alias("kind"), "t", "seq", "ok", none.cast("array<bigint>").alias("hits"))
    ordered = heads.unionByName(tails).repartition("key", "chunk").sortWithinPartitions("key", "chunk", "kind", "t", "seq")
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64())]
    names = ["key", "chunk", "seq", "blocked", "retry_after", "hits"]

    def made(*columns):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def run(batches):
        key, chunk, hits = None, None, None
        for batch in batches:
            keys, chunks = batch.column("key").to_pylist(), batch.column("chunk").to_pylist()
            is_head = batch.column("kind").to_numpy() == 0
            heads = np.flatnonzero(is_head).tolist()
            t, ok = batch.column("t").fill_null(0).to_numpy(), batch.column("ok").fill_null(False).to_numpy(zero_copy_only=False)
            for start, end in zip(sorted({0, *heads}), [*[h for h in heads if h], batch.num_rows]):
                if start < batch.num_rows and is_head[start]:
                    if hits is not None:
                        yield made([key], [chunk], [None], [None], [None], [hits])
                    key, chunk, hits = keys[start], chunks[start], batch.column("hits")[start].as_py()
                    start += 1
                if start >= end:
                    continue
                until, hits = walk_attempts(t[start:end], ok[start:end], hits, limit, span)
                if emit:
                    blocked = until > 0
                    wait = np.maximum(1, -((t[start:end] - until) // 1_000_000))
                    n = end - start
                    yield made([key] * n, [chunk] * n, batch.column("seq").slice(start, n).to_pylist(), blocked, pa.array(wait, pa.int64(), mask=~blocked), [None] * n)
        if hits is not None:
            yield made([key], [chunk], [None], [None], [None], [hits])

    return ordered.mapInArrow(run, _WALKED)


def password_attempts(attempts: DataFrame, carried: DataFrame | None = None, limit: int = FAILURE_LIMIT,
                      window_seconds: int = FAILURE_WINDOW_SECONDS, windows: int = 32) -> tuple[DataFrame, DataFrame]:
    """Attempts ``(key, seq, ts, ok)`` in order of time and seq: blocked while ``limit`` counted failures are in the window. A success that is not
    blocked clears the key; a blocked attempt counts for nothing. → (key, seq, blocked, retry_after) and (key, hits) at the end.

    A key's time is cut into chunks of ``windows`` windows, walked side by side in constant memory. What a chunk needs of
    the one before are at most ``limit`` times. First every chunk starts from none; then those whose predecessor ends
    otherwise than assumed are walked again, until none is. A chunk in which a success clears the key or a window passes without failures ends the
    same whatever came before, so there are few rounds, at most one more than the longest run of chunks without such a moment.
    ``carried(key, hits)``: failures that still count from before.
    """
    span = window_seconds * 1_000_000
    rows = attempts.select(F.col("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("seq"), F.col("ok"))
    rows = cut(rows.withColumn("chunk", F.floor(F.col("t") / (span * windows))))
    own = Window.partitionBy("key").orderBy("chunk")
    chunks = cut(rows.groupBy("key", "chunk").agg(F.min("t").alias("first")).withColumn("prev", F.lag("chunk").over(own)))
    none = F.array().cast("array<bigint>")
    old = attempts.select("key", none.alias("_old")).limit(0) if carried is None else carried.select("key", F.col("hits").alias("_old"))
    fresh = lambda hits: F.filter(F.coalesce(hits, none), lambda h: h > F.col("first") - span)
    based = chunks.join(old, "key", "left").withColumn("_old", F.when(F.col("prev").isNull(), F.col("_old")))
    starts = cut(based.select("key", "chunk", fresh(F.col("_old")).alias("hits")))
    todo, ends = starts, None
    while True:
        found = _walked(rows, todo, limit, span, False).select("key", F.col("chunk").alias("prev"), F.col("hits").alias("_end"))
        ends = cut(found if ends is None else ends.join(found.select("key", "prev"), ["key", "prev"], "left_anti").unionByName(found))
        wanted = based.join(ends, ["key", "prev"], "left").select("key", "chunk", fresh(F.coalesce("_end", "_old")).alias("hits"))
        changed = cut(wanted.join(starts.withColumnRenamed("hits", "_used"), ["key", "chunk"]).where("hits <> _used").drop("_used"))
        if changed.isEmpty():
            break
        starts = cut(starts.join(changed.select("key", "chunk"), ["key", "chunk"], "left_anti").unionByName(changed))
        todo = changed
    last = ends.groupBy("key").agg(F.max_by("_end", "prev").alias("hits"))
    return _walked(rows, starts, limit, span, True).where("seq is not null").select("key", "seq", "blocked", "retry_after"), last


def classify_uploads(requests: DataFrame) -> DataFrame:
    """``first``, ``replay`` (same content), ``conflict`` (other content) or ``pending`` (no job yet).

    The first request per (key, project, idempotency key) is found as a combining aggregate and
    joined back, so a key that is used without end needs no sort.
    """
    keys = ["api_key_id", "project_id", "idem_key"]
    first = requests.groupBy(*keys).agg(F.min_by(F.struct("seq", "request_hash", "job_id"), "seq").alias("_f"))
    joined = requests.join(first, keys)
    outcome = (F.when(F.col("seq") == F.col("_f.seq"), "first").when(F.col("request_hash") != F.col("_f.request_hash"), "conflict")
               .when(F.col("_f.job_id").isNull(), "pending").otherwise("replay"))
    return joined.select(*requests.columns, outcome.alias("outcome"), F.when(outcome == "replay", F.col("_f.job_id")).alias("replayed_job_id"))
