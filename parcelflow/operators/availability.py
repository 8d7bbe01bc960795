"""Availability changes: digests, revision-checked application with replay, event payloads, current state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelflow.operators.grouped import group_rank, previous_value
from parcelflow.session import cut, merge_join

CHUNK_ROWS = 200_000
OUTCOMES = ("applied", "replayed", "conflict", "stale")


def _json_text(value: Column) -> Column:
    """A JSON string literal, non-ASCII kept."""
    return F.coalesce(F.regexp_extract(F.to_json(F.array(value)), r"(?s)^\[(.*)\]$", 1), F.lit("null"))


def request_digest(unit: Column, status: Column, expected: Column, event: Column, source: Column, reason: Column) -> Column:
    """SHA-256 of the compact JSON array of the request."""
    parts = [_json_text(unit.cast("string")), _json_text(status), F.coalesce(expected.cast("string"), F.lit("null")),
             _json_text(event), _json_text(source), F.when(reason.isNull(), F.lit("null")).otherwise(_json_text(reason))]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")), 256)


def _chunk_effects(batches):
    """What each run of requests does to the revision, for every revision it could start from.

    The rows of a run come latest first: a request that expects ``e`` sends a unit at ``e`` to wherever
    ``e + 1`` ends up. Revisions that are not listed pass through unchanged.
    """
    run, ends = None, {}
    for batch in batches:
        out = []
        for unit, chunk, expected in zip(batch["unit_id"].tolist(), batch["chunk"].tolist(), batch["expected_revision"].tolist()):
            if (unit, chunk) != run:
                if run is not None:
                    out += [(*run, *e) for e in ends.items()]
                run, ends = (unit, chunk), {}
            ends[expected] = ends.get(expected + 1, expected + 1)
        yield pd.DataFrame(out, columns=["unit_id", "chunk", "start", "final"])
    if run is not None:
        yield pd.DataFrame([(*run, *e) for e in ends.items()], columns=["unit_id", "chunk", "start", "final"])


def _chunk_replay(batches):
    """Outcome of every request of a run, given the revision the unit has at its start."""
    run, revision = None, 0
    for batch in batches:
        accepted, after = [], []
        for unit, chunk, expected, start in zip(batch["unit_id"].tolist(), batch["chunk"].tolist(),
                                                batch["expected_revision"].tolist(), batch["revision_in"].tolist()):
            if (unit, chunk) != run:
                run, revision = (unit, chunk), start
            ok = expected == revision
            revision += ok
            accepted.append(ok)
            after.append(revision)
        yield pd.DataFrame({"seq": batch["seq"], "unit_id": batch["unit_id"], "accepted": accepted, "revision": after})


def _composed(maps: DataFrame) -> DataFrame:
    """Maps of pairs of neighbouring chunks, as rows: the even one's finals go through the odd one's starts."""
    pair = F.shiftright("chunk", 1)
    first = maps.where("chunk % 2 = 0").select("unit_id", pair.alias("pair"), "start", "final")
    second = maps.where("chunk % 2 = 1").select("unit_id", pair.alias("pair"), F.col("start").alias("s"), F.col("final").alias("f"))
    through = merge_join(first, second.withColumnRenamed("s", "final"), ["unit_id", "pair", "final"], "left").select(
        "unit_id", F.col("pair").alias("chunk"), "start", F.coalesce("f", "final").alias("final"))
    past = merge_join(second.select("unit_id", "pair", F.col("s").alias("start"), "f"), first, ["unit_id", "pair", "start"], "left_anti")
    return through.union(past.select("unit_id", "pair", "start", "f"))


def _chunk_starts(maps: DataFrame, units: DataFrame) -> DataFrame:
    """unit_id, chunk, revision_in: the revision of every unit before each of its chunks, from maps (unit_id, chunk, start, final).

    Maps are composed pairwise in log2(chunks) rounds of joins; going back, a pair's revision is that of its first chunk,
    and through the first one's map that of its second. No row holds more than one entry of a map.
    """
    ends = maps.agg(F.min("chunk"), F.max("chunk")).first()
    base = ends[0] or 0
    levels = [maps.withColumn("chunk", F.col("chunk") - base)]
    for _ in range(((ends[1] or 0) - base).bit_length() - 1):
        levels.append(cut(_composed(levels[-1])))
    blocks = levels[0].select("unit_id", "chunk").distinct()
    rounds = ((ends[1] or 0) - base).bit_length()
    known = merge_join(blocks.select("unit_id").distinct(), units.select("unit_id", "revision"), "unit_id", "left").select(
        "unit_id", F.lit(0).cast("bigint").alias("chunk"), F.coalesce("revision", F.lit(0)).cast("bigint").alias("revision_in"))
    for level in range(rounds - 1, -1, -1):
        here = blocks.select("unit_id", F.shiftright("chunk", level).alias("chunk")).distinct()
        above = merge_join(here.withColumn("pair", F.shiftright("chunk", 1)), known.select("unit_id", F.col("chunk").alias("pair"), "revision_in"), ["unit_id", "pair"])
        even = above.where("chunk % 2 = 0")
        first = levels[level].select("unit_id", (F.col("chunk") + 1).alias("chunk"), F.col("start").alias("revision_in"), "final")
        odd = merge_join(above.where("chunk % 2 = 1"), first, ["unit_id", "chunk", "revision_in"], "left").withColumn(
            "revision_in", F.coalesce("final", "revision_in"))
        known = cut(even.select("unit_id", "chunk", "revision_in").union(odd.select("unit_id", "chunk", "revision_in")))
    return known.withColumn("chunk", F.col("chunk") + base)


def _run_units(open_requests: DataFrame, units: DataFrame) -> DataFrame:
    """Accepted flag and revision after each request, unit by unit, as a scan over bounded chunks.

    A unit with up to ``CHUNK_ROWS`` requests is one chunk, which starts with the unit's revision. The requests of a busier
    one are cut into chunks of consecutive ``seq``. Their effects are composed pairwise, which gives every chunk its
    starting revision; then all chunks run at the same time. A unit with most of the traffic is spread like any other.
    """
    run = ["unit_id", "chunk"]
    rows = open_requests.where("unit_id IS NOT NULL").select("unit_id", "seq", "expected_revision")
    busy = cut(rows.groupBy("unit_id").count().where(F.col("count") > CHUNK_ROWS).select("unit_id", F.lit(True).alias("_busy")))
    start = units.select("unit_id", F.coalesce("revision", F.lit(0)).cast("bigint").alias("revision_in"))
    if busy.isEmpty():
        ready = merge_join(rows.withColumn("chunk", F.lit(0).cast("bigint")), start, "unit_id", "left")
    else:
        rows = merge_join(rows, busy, "unit_id", "left").withColumn("chunk", F.when(F.col("_busy"), F.floor(F.col("seq") / CHUNK_ROWS)).otherwise(0).cast("bigint"))
        effects = rows.where("_busy").repartition(*run).sortWithinPartitions(*run, F.col("seq").desc()).select(*run, "expected_revision").mapInPandas(
            _chunk_effects, "unit_id bigint, chunk bigint, start bigint, final bigint")
        calm = merge_join(rows.where("_busy IS NULL"), start, "unit_id", "left").drop("_busy")
        spread = merge_join(rows.where("_busy"), _chunk_starts(cut(effects), units), run).drop("_busy")
        ready = calm.unionByName(spread)
    ready = ready.select("seq", *run, "expected_revision", F.coalesce("revision_in", F.lit(0).cast("bigint")).alias("revision_in"))
    return ready.repartition(*run).sortWithinPartitions(*run, "seq").mapInPandas(
        _chunk_replay, "seq bigint, unit_id bigint, accepted boolean, revision bigint")


def apply_requests(requests: DataFrame, units: DataFrame, recorded: DataFrame | None = None) -> DataFrame:
    """Outcome of every change request, as if they had been applied one by one in ``seq`` order.

    ``requests(seq, project_id, unit_id, system, event_id, status, expected_revision, digest)``;
    ``units(unit_id, revision)`` gives the revisions before (0 when absent); ``recorded(project_id,
    system, event_id, digest, revision)`` the requests accepted earlier. An event id that was accepted
    before replays (same digest), with the revision recorded then, or conflicts; otherwise the expected revision must be current.
    Rejected requests are not recorded and may be sent again.

    Units meet only through event ids. Given a guess of each event id's first accepted request,
    every unit can be run by itself; the runs give a better guess. A request depends on earlier
    requests only, so each round settles at least one more of them and the outcome that no longer
    changes is the sequential one. A handful of rounds is usual.
    """
    ident = ["project_id", "system", "event_id"]
    base = cut(requests.select("seq", *ident, "unit_id", "status", "expected_revision", "digest"))
    old = None if recorded is None else recorded.select(*ident, F.col("digest").alias("_old"), F.col("revision").alias("_old_revision")).dropDuplicates(ident)
    judged = base if old is None else merge_join(base, old, ident, "left")
    if old is None:
        judged = judged.withColumns({"_old": F.lit(None).cast("string"), "_old_revision": F.lit(None).cast("bigint")})
    fresh = cut(judged.where(F.col("_old").isNull()).drop("_old", "_old_revision"))
    winners = cut(fresh.groupBy(*ident).agg(F.min("seq").alias("win")).limit(0))
    runs, stale_units = None, None
    while True:
        guess = merge_join(fresh, winners, ident, "left")
        if stale_units is not None:
            guess = merge_join(guess, stale_units, "unit_id", "left_semi")
        open_rows = guess.where(F.col("win").isNull() | (F.col("seq") <= F.col("win")))
        rerun = _run_units(open_rows, units)
        if runs is not None:
            # Units whose event ids kept their winners cannot come out differently.
            rerun = rerun.unionByName(merge_join(runs, stale_units, "unit_id", "left_anti"))
        runs = cut(rerun)
        found = cut(merge_join(fresh, runs.where("accepted").select("seq"), "seq", "left_semi").groupBy(*ident).agg(F.min("seq").alias("win")))
        moved = merge_join(found, winners.withColumnRenamed("win", "_w"), ident, "full").where(~F.col("win").eqNullSafe(F.col("_w")))
        stale_units = cut(merge_join(fresh, moved.select(*ident), ident, "left_semi").select("unit_id").distinct())
        winners = found
        if stale_units.isEmpty():
            break
    runs = runs.drop("unit_id")
    won = merge_join(fresh, winners.select(F.col("win").alias("seq")), "seq", "left_semi")
    digests = merge_join(won, runs.select("seq", F.col("revision").alias("_won_revision")), "seq").select(*ident, F.col("digest").alias("_won"), "_won_revision")
    decided = merge_join(merge_join(merge_join(fresh, winners, ident, "left"), runs, "seq", "left"), digests, ident, "left")
    outcome = (F.when(F.col("seq") > F.col("win"), F.when(F.col("digest") == F.col("_won"), "replayed").otherwise("conflict"))
               .when(F.col("accepted"), "applied").otherwise("stale"))
    columns = [*base.columns, "outcome", "revision"]
    new = decided.withColumn("outcome", outcome).withColumn(
        "revision", F.when(F.col("outcome") == "applied", F.col("revision")).when(F.col("outcome") == "replayed", F.col("_won_revision"))).select(*columns)
    earlier = judged.where(F.col("_old").isNotNull()).withColumn(
        "outcome", F.when(F.col("digest") == F.col("_old"), "replayed").otherwise("conflict")).withColumn(
        "revision", F.when(F.col("outcome") == "replayed", F.col("_old_revision"))).select(*columns)
    return new.unionByName(earlier)


def with_system(requests: DataFrame, units: DataFrame) -> DataFrame:
    """Adds ``system``, under which a request's event id is known: the unit's external system, or else the request's ``source``."""
    known = units.select("unit_id", F.col("external_system").alias("_external"))
    return merge_join(requests, known, "unit_id", "left").withColumn("system", F.coalesce("_external", "source")).drop("_external")


def unit_state(applied: DataFrame) -> DataFrame:
    """Current status and revision per unit from the applied changes."""
    return applied.groupBy("unit_id").agg(F.max_by("status", "revision").alias("status"), F.max("revision").alias("revision"))


def units_after(units: DataFrame, changes: DataFrame) -> DataFrame:
    """The units with status and revision after the applied ``changes(unit_id, status, revision)``."""
    now = unit_state(changes).select("unit_id", F.col("status").alias("_status"), F.col("revision").alias("_revision"))
    return units.join(now, "unit_id", "left").withColumns({
        "status": F.coalesce("_status", "status"), "revision": F.coalesce("_revision", "revision")}).drop("_status", "_revision")


def with_previous_status(changes: DataFrame, units: DataFrame) -> DataFrame:
    """Adds ``previous_status`` to applied changes, and the unit's project and external ids.

    Revisions of a unit have no gaps, so the status before is that of the change to the revision before, or the unit's
    own: an equi-join, in which a unit with most of the changes is spread by its revisions.
    """
    before = changes.select("unit_id", (F.col("revision") + 1).alias("revision"), F.col("status").alias("_before"))
    own = units.select("unit_id", "external_system", "external_unit_id", F.col("status").alias("_own"))
    joined = merge_join(merge_join(changes, before, ["unit_id", "revision"], "left"), own, "unit_id", "left")
    return joined.withColumn("previous_status", F.coalesce("_before", "_own")).drop("_before", "_own")


def lots_after(lots: DataFrame, links: DataFrame, units: DataFrame, changes: DataFrame) -> DataFrame:
    """``lots`` with the status of the changed unit they are linked to; ``links(unit_id, lot_id)``, one per lot.

    A change writes to the lots of its unit's project only.
    """
    now = unit_state(changes).join(units.select("unit_id", "project_id"), "unit_id").select(
        "unit_id", "project_id", F.col("status").alias("_status"))
    new = links.join(now, "unit_id").select("lot_id", "project_id", "_status")
    return lots.join(new, ["lot_id", "project_id"], "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")


def lot_edits(edits: DataFrame, lots: DataFrame, links: DataFrame, units: DataFrame, order: list[str]) -> DataFrame:
    """Status edits of lots, each made through the lot's unit: unit, previous_status, ``changed`` and the revision after it.

    ``edits(lot_id, status)`` with columns ``order``, unique together. A lot without a link gets a unit of its own, with
    its status and revision 0; it is named ``lot-`` and the lot's id. An edit to the status that the unit has by then changes nothing
    and leaves no event. Edits through a unit of another project than the lot's are left out; their lots come with ``unit`` null.
    """
    own = lots.select("lot_id", "project_id", F.col("status").alias("_lot_status"))
    known = units.select("unit_id", F.col("project_id").alias("_unit_project"), F.col("status").alias("_unit_status"), "revision")
    joined = edits.join(own, "lot_id").join(links.select("lot_id", "unit_id"), "lot_id", "left").join(known, "unit_id", "left")
    linked = F.col("unit_id").isNotNull()
    unit = F.when(~linked, F.concat(F.lit("lot-"), F.col("lot_id").cast("string"))).when(
        F.col("_unit_project") == F.col("project_id"), F.col("unit_id").cast("string"))
    named = cut(joined.select(*edits.columns, unit.alias("unit"), F.coalesce("_unit_status", "_lot_status").alias("_start"),
                              F.coalesce("revision", F.lit(0)).cast("bigint").alias("_revision")))
    sound = previous_value(named.where("unit IS NOT NULL"), ["unit"], order, "status", "previous_status")
    sound = sound.withColumn("previous_status", F.coalesce("previous_status", "_start"))
    sound = cut(sound.withColumn("changed", F.col("previous_status") != F.col("status")))
    counted = group_rank(sound.where("changed"), ["unit"], order, "_n").withColumn("revision", F.col("_revision") + F.col("_n"))
    refused = named.where("unit IS NULL").select(*edits.columns, "unit", F.lit(None).cast("string").alias("previous_status"),
                                                 F.lit(False).alias("changed"), F.lit(None).cast("bigint").alias("revision"))
    columns = refused.columns
    same = sound.where("NOT changed").withColumn("revision", F.lit(None).cast("bigint"))
    return counted.select(*columns).unionByName(same.select(*columns)).unionByName(refused)


def internal_changes(edits: DataFrame) -> DataFrame:
    """Internal edits produce a change only when the status differs from the one before.

    ``edits(seq, unit_id, status)``; the first edit of a unit is compared with ``available``.
    """
    lagged = previous_value(edits, ["unit_id"], ["seq"], "status", "previous_status")
    lagged = lagged.withColumn("previous_status", F.coalesce("previous_status", F.lit("available")))
    return lagged.withColumn("changed", F.col("previous_status") != F.col("status"))


def event_payload(changes: DataFrame) -> DataFrame:
    """The envelope stored with a change: the unit's external ids where given, previous and new status, revision, source, time."""
    stamp = F.concat(F.regexp_replace(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", ""), F.lit("Z"))
    external = [c for c in ("external_system", "external_unit_id") if c in changes.columns]
    body = F.to_json(F.struct("event_id", "unit_id", *external, "previous_status", F.col("status").alias("new_status"), "revision", "source",
                              stamp.alias("timestamp")), {"ignoreNullFields": "false"})
    return changes.withColumn("payload_json", body)
