"""Units behind lots: reconciliation across versions, backfill, binding, editor saves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parcelflow.functions import codes as C
from parcelflow.operators.grouped import pick_row
from parcelflow.operators.lots import trusted_label
from parcelflow.session import cut

# The stronger status wins when legacy lots merge.
BACKFILL_RANK = {"available": 0, "reserved": 1, "blocked": 2, "sold": 3}


def with_label(rows: DataFrame) -> DataFrame:
    return rows.withColumn("label", trusted_label(F.col("block"), F.col("name")))


def unique_labels(rows: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Labels that occur once per key, with the one row that has them."""
    return rows.where(F.col("label").isNotNull()).groupBy(*keys, "label").agg(
        F.count("*").alias("_n"), F.min(id_col).alias(id_col)).where(F.col("_n") == 1).drop("_n")


def unique_label_match(lots: DataFrame, units: DataFrame) -> DataFrame:
    """Lots and units of a project whose label is unique on both sides (lots: within their version)."""
    l = unique_labels(with_label(lots), ["project_id", "version_id"], "lot_id")
    u = unique_labels(with_label(units), ["project_id"], "unit_id")
    return l.join(u, ["project_id", "label"]).select("project_id", "version_id", "lot_id", "unit_id")


def new_unit_id(version: Column, lot: Column) -> Column:
    """Derived, not random: running the job again gives the same unit."""
    return F.sha2(F.concat_ws(":", version.cast("string"), lot.cast("string")), 256)


def reconcile_version(lots: DataFrame, units: DataFrame, bridge: DataFrame, converted: bool) -> DataFrame:
    """One row per lot of the new versions with its unit.

    ``lots(project_id, version_id, lot_id, block, name, status)``: one new version per project.
    ``units(project_id, unit_id, block, name, status, mapping_state)`` and ``bridge(unit_id,
    lot_id, version_id)`` hold what exists. An existing link wins; then a label that is unique on
    both sides, unless that unit already has another lot in the version; else a new unit, blocked
    when uncertain.
    """
    keyed = units.withColumn("unit_id", F.col("unit_id").cast("string"))
    links = bridge.withColumn("unit_id", F.col("unit_id").cast("string"))
    linked = links.select("lot_id", F.col("unit_id").alias("_linked")).join(lots.select("lot_id"), "lot_id", "left_semi")
    # A unit that already has another lot in the version cannot take a second one.
    busy = links.select("unit_id", "version_id", F.col("lot_id").alias("_other")).groupBy("unit_id", "version_id").agg(
        F.max("_other").alias("_other"))
    match = unique_label_match(lots, keyed).join(busy, ["unit_id", "version_id"], "left").where(
        F.col("_other").isNull() | (F.col("_other") == F.col("lot_id"))).select("lot_id", F.col("unit_id").alias("_matched"))
    has_units = units.groupBy("project_id").agg(F.lit(True).alias("_has_units"))
    labelled = with_label(lots)
    counts = labelled.groupBy("version_id", "label").agg(F.count("*").alias("_same"))
    # A null label never joins, which leaves its count null: uncertain either way.
    row = labelled.join(linked, "lot_id", "left").join(match, "lot_id", "left").join(has_units, "project_id", "left").join(
        counts, ["version_id", "label"], "left")
    uncertain = F.coalesce("_has_units", F.lit(False)) | F.col("label").isNull() | (F.col("_same") != 1)
    first = F.when(uncertain, "blocked").otherwise("available") if converted else F.col("status")
    fresh_status = F.when(uncertain & (first == "available"), "blocked").otherwise(first)
    row = row.withColumns({"_found": F.coalesce("_linked", "_matched"), "_uncertain": uncertain, "_fresh": fresh_status})
    old = keyed.select(F.col("unit_id").alias("_found"), F.col("status").alias("_u_status"), F.col("mapping_state").alias("_u_state"))
    row = row.join(old, "_found", "left")
    known = F.col("_found").isNotNull()
    return row.select(
        "project_id", "version_id", "lot_id", "block", "name",
        F.when(known, F.col("_found")).otherwise(new_unit_id(F.col("version_id"), F.col("lot_id"))).alias("unit_id"),
        (~known).alias("created"),
        F.when(known, F.col("_u_status")).otherwise(F.col("_fresh")).alias("status"),
        F.when(known, F.col("_u_state")).when(F.col("_uncertain"), "needs_reconciliation").otherwise("mapped").alias("mapping_state"))


def unseen_units(units: DataFrame, reconciled: DataFrame) -> DataFrame:
    """Units of the touched projects without a lot in the new version."""
    keyed = units.withColumn("unit_id", F.col("unit_id").cast("string"))
    touched = keyed.join(reconciled.select("project_id"), "project_id", "left_semi")
    return touched.join(reconciled.select("unit_id"), "unit_id", "left_anti")


def units_after(units: DataFrame, reconciled: DataFrame) -> DataFrame:
    """The unit table after a reconciliation: matched units follow their lot, unseen ones lose it, new ones appear."""
    keyed = units.withColumn("unit_id", F.col("unit_id").cast("string"))
    now = reconciled.select("unit_id", F.col("lot_id").alias("_lot"), F.col("created").alias("_c"))
    touched = reconciled.select("project_id").distinct().withColumn("_touched", F.lit(True))
    old = keyed.join(now.where(~F.col("_c")).drop("_c"), "unit_id", "left").join(touched, "project_id", "left")
    lost = F.col("_touched") & F.col("_lot").isNull()
    state = F.when(lost, "needs_reconciliation").otherwise(F.col("mapping_state"))
    lot = F.when(F.col("_lot").isNotNull(), F.col("_lot")).when(~F.coalesce(lost, F.lit(False)), F.col("lot_id"))
    kept = old.select("project_id", "unit_id", "block", "name", "status", state.alias("mapping_state"), lot.alias("lot_id"))
    made = reconciled.where("created").select("project_id", "unit_id", "block", "name", "status", "mapping_state", "lot_id")
    return kept.unionByName(made)


def backfill_units(lots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Legacy lots → (units, bridge). A label that is unique in each of its versions joins them into one unit.

    The strongest status wins (unknown counts as blocked); the first lot gives block and name, the
    last one is the current lot, in the order of version time, version, position and id.
    ``lots(project_id, version_id, lot_id, created_at, sort_order, block, name, status)``.
    """
    labelled = with_label(lots)
    unique = unique_labels(labelled, ["version_id"], "lot_id").select("lot_id", F.lit(True).alias("_unique"))
    rank = F.lit(BACKFILL_RANK["blocked"])
    for status, value in BACKFILL_RANK.items():
        rank = F.when(F.col("status") == status, value).otherwise(rank)
    alone = F.concat(F.lit("lot:"), F.col("lot_id").cast("string"))
    shared = F.concat(F.lit("label:"), F.to_json("label"))
    rows = labelled.join(unique, "lot_id", "left").withColumn(
        "_group", F.when(F.col("_unique"), shared).otherwise(alone)).withColumn("_rank", rank)
    order = F.struct("created_at", "version_id", "sort_order", "lot_id")
    grouped = rows.groupBy("project_id", "_group").agg(
        F.max("_rank").alias("_rank"), F.min_by("block", order).alias("block"), F.min_by("name", order).alias("name"),
        F.min_by("lot_id", order).alias("_first"), F.max_by("lot_id", order).alias("lot_id"), F.count("*").alias("lots"))
    names = F.array(*[F.lit(s) for s, _ in sorted(BACKFILL_RANK.items(), key=lambda kv: kv[1])])
    units = grouped.select("project_id", "_group", F.sha2(F.concat_ws(":", F.lit("backfill"), "project_id", "_group"), 256).alias("unit_id"),
                           "block", "name", F.get(names, F.col("_rank")).alias("status"), F.lit("needs_reconciliation").alias("mapping_state"),
                           F.lit(0).alias("revision"), "lot_id", "lots")
    bridge = rows.select("project_id", "_group", "version_id", F.col("lot_id").alias("linked_lot")).join(
        units.select("project_id", "_group", "unit_id", "status"), ["project_id", "_group"])
    return units.drop("_group"), bridge.drop("_group")


def bind_plan(requests: DataFrame, lots: DataFrame, units: DataFrame, bridge: DataFrame) -> DataFrame:
    """Outcome per bind request as if all were handled in the order of ``seq``: ``create``, ``reuse``, ``absorb``, ``conflict_lot_bound``,
    ``conflict_reference``, ``conflict_version`` or ``not_found``; with the unit, or the request that made it (``created_by``).

    ``requests(seq, project_id, system, external_unit_id, lot_id)`` start from ``units(unit_id, project_id, external_system,
    external_unit_id, status, revision, mapping_state)`` and ``bridge(lot_id, unit_id, version_id)``.

    Requests meet in two places only. A lot, or all lots of its unit, takes one reference for good; a reference has room for one lot in
    each version, and the first request that succeeds names its unit. So the requests that change anything are an ordered
    matching of lots to places, built in rounds: one that is the earliest open of both succeeds, and whatever wants a taken lot or
    place is out at once, so a lot or reference with any number of requests takes no more rounds. Rounds are at most half of the
    longest chain of requests in which each shares a lot or a place with the next, later one; in other orders few.
    The outcomes of all other requests then follow from what was taken before them.
    """
    spark = requests.sparkSession
    links = bridge.groupBy("unit_id").agg(F.count("*").alias("_links"))
    of_lot = bridge.select("lot_id", F.col("unit_id").alias("_linked")).join(
        units.select(F.col("unit_id").alias("_linked"), "external_system", F.col("external_unit_id").alias("_ext"), F.col("status").alias("_l_status"), "revision", "mapping_state"), "_linked").join(
        links.withColumnRenamed("unit_id", "_linked"), "_linked", "left")
    ref = F.struct("project_id", F.col("system"), F.col("external_unit_id")).alias("ref")
    unit_ref = F.struct("project_id", F.col("external_system").alias("system"), "external_unit_id").alias("ref")
    rows = requests.join(lots.select("lot_id", F.col("project_id").alias("_lot_project"), F.col("version_id").alias("version"), F.col("status").alias("_lot_status")), "lot_id", "left").join(of_lot, "lot_id", "left")
    linked = F.col("_linked").isNotNull()
    taker = F.when(linked, F.concat(F.lit("unit:"), F.col("_linked").cast("string"))).otherwise(F.concat(F.lit("lot:"), F.col("lot_id").cast("string")))
    provisional = F.col("external_system").isNull() & (F.col("revision") == 0) & (F.col("mapping_state") == "needs_reconciliation") & (F.col("_links") == 1)
    rows = rows.select(
        "seq", "lot_id", ref, F.coalesce(F.col("_lot_project") == F.col("project_id"), F.lit(False)).alias("found"), "version", taker.alias("taker"), linked.alias("linked"), "_linked",
        F.coalesce(provisional, F.lit(False)).alias("provisional"), F.coalesce("_l_status", "_lot_status").alias("status"),
        F.when(F.col("external_system").isNotNull(), F.struct("project_id", F.col("external_system").alias("system"), F.col("_ext").alias("external_unit_id"))).alias("own_ref"))
    rows = cut(rows)
    # what is there before the first request: seq null
    start = units.where(F.col("external_system").isNotNull())
    never = F.lit(None).cast(requests.schema["seq"].dataType).alias("since")
    named = cut(start.select(unit_ref, never, F.col("status").alias("named_status"), F.col("unit_id").alias("named_unit")))
    places = cut(start.select("unit_id", unit_ref).join(bridge, "unit_id").groupBy("ref", F.col("version_id").alias("version")).agg(F.max("lot_id").alias("held_by")).withColumn("since", never))
    bound = cut(rows.where("false").select("taker", F.col("seq").alias("since"), F.col("ref").alias("bound_ref")))
    keeps_sale = F.col("status").isin("sold", "reserved") & (F.col("named_status") != F.col("status"))
    barred = F.col("named_status").isNotNull() & F.col("linked") & (~F.col("provisional") | keeps_sale)
    open_ = rows.where(F.col("found") & F.col("own_ref").isNull())
    while True:
        free = open_.join(bound.select("taker"), "taker", "left_anti").join(places.select("ref", "version"), ["ref", "version"], "left_anti")
        open_ = cut(free.join(named.select("ref", "named_status"), "ref", "left").where(~barred).drop("named_status"))
        if open_.isEmpty():
            break
        first = lambda *keys: open_.groupBy(*keys).agg(F.min("seq").alias("seq"))
        ready = open_.join(first("taker"), ["taker", "seq"], "left_semi").join(named.select("ref", F.lit(True).alias("is_named")), "ref", "left")
        # a reference without a unit may get one for several versions, so its earliest request of all goes first
        ready = ready.join(first("ref", "version").withColumn("_v", F.lit(True)), ["ref", "version", "seq"], "left").join(
            first("ref").withColumn("_r", F.lit(True)), ["ref", "seq"], "left")
        won = cut(ready.where(F.when(F.col("is_named"), F.col("_v")).otherwise(F.col("_r"))))
        made = won.where("is_named is null")
        bound = cut(bound.unionByName(won.select("taker", F.col("seq").alias("since"), F.col("ref").alias("bound_ref"))))
        named = cut(named.unionByName(made.select("ref", F.col("seq").alias("since"), F.col("status").alias("named_status"), F.col("_linked").alias("named_unit"))))
        taken = won.select("ref", "version", F.col("lot_id").alias("held_by"), F.col("seq").alias("since"))
        along = made.where("linked").select("ref", F.col("_linked").alias("unit_id"), F.col("seq").alias("since")).join(bridge, "unit_id").select(
            "ref", F.col("version_id").alias("version"), F.col("lot_id").alias("held_by"), "since")
        places = cut(places.unionByName(taken.unionByName(along).dropDuplicates(["ref", "version"])))
        open_ = open_.join(won.select("seq"), "seq", "left_anti")

    full = rows.join(bound.withColumnRenamed("since", "_bound"), "taker", "left").join(named.withColumnRenamed("since", "_named"), "ref", "left")
    there = F.col("named_status").isNotNull() & (F.col("_named").isNull() | (F.col("_named") < F.col("seq")))
    before = F.when(F.col("own_ref").isNotNull(), F.col("own_ref")).when(F.col("_bound") < F.col("seq"), F.col("bound_ref"))
    wins = F.coalesce(F.col("_bound") == F.col("seq"), F.lit(False))
    outcome = (
        F.when(~F.col("found"), "not_found")
        .when(before.isNotNull(), F.when(before == F.col("ref"), "reuse").when(there, "conflict_lot_bound").otherwise("conflict_reference"))
        .when(wins, F.when(there, F.when(F.col("linked"), "absorb").otherwise("reuse")).otherwise(F.when(F.col("linked"), "reuse").otherwise("create")))
        .when(barred, "conflict_lot_bound").otherwise("conflict_version"))
    done = full.select("seq", "lot_id", "ref.*", outcome.alias("outcome"), "named_unit", "_named")
    good = F.col("outcome").isin("create", "reuse", "absorb")
    return done.select(*requests.columns, "outcome", F.when(good, F.col("named_unit")).alias("unit_id"), F.when(good & F.col("named_unit").isNull(), F.col("_named")).alias("created_by"))


def carry_from_base(lots: DataFrame, base: DataFrame, bridge: DataFrame, units: DataFrame, expected: DataFrame) -> DataFrame:
    """Editor save: lots inherit the unit of the base lot with the same external id.

    ``lots(project_id, external_id, s)``; ``base(project_id, external_id, lot_id, status)``;
    ``expected(unit_id, expected_revision)``. A status change needs the right revision:
    ``missing_revision`` or ``stale`` otherwise.
    """
    b = base.select("project_id", "external_id", F.col("lot_id").alias("base_lot_id"), F.col("status").alias("_b_status"))
    link = bridge.select(F.col("lot_id").alias("base_lot_id"), "unit_id")
    u = units.select("unit_id", F.col("status").alias("_u_status"), "revision")
    row = lots.join(b, ["project_id", "external_id"], "left").join(link, "base_lot_id", "left").join(u, "unit_id", "left").join(expected, "unit_id", "left")
    # A base lot without a unit gets one first, in the base lot's own status.
    row = row.withColumn("current_status", F.coalesce("_u_status", "_b_status"))
    desired = C.editor_status(F.col("s"))
    action = (F.when(F.col("base_lot_id").isNull(), "new_lot")
              .when(desired == F.col("current_status"), F.when(F.col("unit_id").isNull(), "new_unit").otherwise("carry"))
              .when(F.col("expected_revision").isNull(), "missing_revision")
              .when(F.col("expected_revision") != F.col("revision"), "stale").otherwise("change"))
    return row.withColumn("desired_status", desired).withColumn("action", action).drop("_u_status", "_b_status")
