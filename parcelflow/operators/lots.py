"""Lot records: normalising, loading, searching, filtering and patching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parcelflow.functions import codes as C, geometry as G, text as X
from parcelflow.schemas import LOT_RECORD


def _or_text(*values: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def normalize_lots(rows: DataFrame, position: str = "position", record_json: str = "record_json") -> DataFrame:
    """Lot objects, or ``[status, points]`` pairs, in the editor's contract.

    The status is clamped to 0..3; the colour follows the *unclamped* index when it is valid.
    """
    r = F.from_json(record_json, LOT_RECORD)
    pair = F.from_json(record_json, "array<string>")
    is_pair = F.ltrim(record_json).startswith("[")
    base = rows.withColumns({"_r": F.when(~is_pair, r), "_p": F.when(is_pair, pair), "_pair": is_pair})
    raw = F.when(F.col("_pair"), F.get("_p", F.lit(0))).otherwise(F.coalesce("_r.s", "_r.status_index"))
    index = F.coalesce(F.nullif(raw, F.lit("")).try_cast("double").cast("int"), F.lit(0))
    fallback = F.concat(F.lit("Lote "), (F.col(position) + 1).cast("string"))
    own_index = F.col("_r.index").try_cast("int")
    return base.withColumn("_s", index).select(
        *[c for c in rows.columns if c != record_json],
        F.greatest(F.lit(0), F.least(F.col("_s"), F.lit(3))).alias("s"),
        F.when(F.col("_pair"), F.get("_p", F.lit(1))).otherwise(F.coalesce("_r.pts", "_r.points", F.lit(""))).alias("pts"),
        F.coalesce(F.nullif(F.col("_r.color"), F.lit("")), C.by_index(C.INGEST_COLORS, F.col("_s"), C.INGEST_COLORS[0])).alias("color"),
        F.coalesce(_or_text(F.col("_r.nome"), F.col("_r.name")), fallback).alias("nome"),
        F.coalesce("_r.quadra", F.lit("")).alias("quadra"),
        F.coalesce("_r.area", F.lit("")).alias("area"),
        F.coalesce("_r.group", F.lit("")).alias("group_name"),
        F.when(F.col("_pair"), False).otherwise(F.coalesce("_r.extraido", F.lit(True))).alias("extraido"),
        F.when(own_index.isNull() | (own_index == 0), F.col(position)).otherwise(own_index).cast("int").alias("lot_index"),
    )


def lots_from_records(rows: DataFrame, key_cols: list[str]) -> DataFrame:
    """Record objects at a ``position`` → rows of the lots table.

    A bad status index reads as available, and the external id is the record's own index or
    else its position.
    """
    r = rows.withColumn("_r", F.from_json("record_json", LOT_RECORD))
    index = F.coalesce(F.nullif(F.col("_r.s"), F.lit("")).try_cast("double").cast("int"), F.lit(0))
    points_text = _or_text(F.col("_r.pts"), F.col("_r.points"))
    ring = F.when(F.ltrim(points_text).startswith("["), G.parse_points_json(points_text)).otherwise(G.parse_points(points_text))
    area_source = _or_text(F.nullif(F.col("_r.area_m2"), F.lit("0")), F.col("_r.area"))
    return r.select(
        *key_cols,
        F.coalesce("_r.index", F.col("position").cast("string")).alias("external_id"),
        _or_text(F.col("_r.nome"), F.col("_r.name")).alias("name"),
        _or_text(F.col("_r.quadra"), F.col("_r.block")).alias("block"),
        X.parse_area_simple(area_source).alias("area_m2"),
        C.ingest_status(index).alias("status"),
        _or_text(F.col("_r.color"), F.col("_r.cor")).alias("color"),
        ring.alias("ring"),
        F.to_json(F.struct(F.transform(ring, lambda p: F.array(p["x"], p["y"])).alias("points"))).alias("geometry_json"),
        F.col("record_json").alias("properties_json"),
        F.col("position").cast("int").alias("sort_order"),
    )


def contract_check(declared: DataFrame, lots: DataFrame, key: str) -> DataFrame:
    """Versions that declare lots but delivered none are broken. ``declared(key, lot_count)``."""
    produced = lots.groupBy(key).agg(F.count("*").alias("produced"))
    checked = declared.join(produced, key, "left").withColumn("produced", F.coalesce("produced", F.lit(0)))
    return checked.withColumn("broken", (F.col("lot_count") > 0) & (F.col("produced") == 0))


def raise_on_broken(checked: DataFrame) -> DataFrame:
    """Fails the job on the first broken version instead of publishing an empty map."""
    message = F.raise_error(F.concat(F.lit("declared lots were not delivered: "), F.col("lot_count").cast("string")))
    return checked.withColumn("broken", F.when(F.col("broken"), message.cast("boolean")).otherwise(F.col("broken")))


def like_literal(text: str) -> str:
    """The text as a LIKE pattern. User wildcards keep their meaning, as in the search box."""
    return f"%{text}%"


def search_lots(lots: DataFrame, q: str | None = None, status: str | None = None) -> DataFrame:
    """Substring of the name or block, ignoring case, and an exact status; in order of version and position."""
    if q:
        lots = lots.where(F.col("name").ilike(like_literal(q)) | F.col("block").ilike(like_literal(q)))
    if status:
        lots = lots.where(F.col("status") == status)
    return lots.orderBy("version_id", "k", "lot_id")


def is_missing_label(name: Column, extracted: Column) -> Column:
    return ~F.coalesce(extracted, F.lit(False)) | F.coalesce(name.rlike(r"^Lote \d+$"), F.lit(False))


def list_filter(lots: DataFrame, text: str = "", mode: str = "all") -> DataFrame:
    """The list panel: text in "name block area status", then all, one status or missing labels."""
    label = C.by_index(C.STATUS_LABELS, F.col("s"), "")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    hay = F.lower(F.concat_ws(" ", blank("name"), blank("block"), blank("area_text"), label))
    if text:
        lots = lots.where(hay.contains(text.lower()))
    if mode == "missing":
        return lots.where(is_missing_label(F.col("name"), F.col("extracted")))
    return lots if mode == "all" else lots.where(F.col("s") == int(mode))


def trusted_label(block: Column, name: Column) -> Column:
    """(block, name) when both are real; names made up for unlabelled lots are no identity."""
    b, n = F.trim(F.coalesce(block, F.lit(""))), F.trim(F.coalesce(name, F.lit("")))
    real = (b != "") & (n != "") & ~n.rlike(X.SYNTHETIC_NAME)
    return F.when(real, F.struct(b.alias("block"), n.alias("name")))


# Layers that hold lots, and name parts of layers that only annotate.
CADASTRAL_LAYERS = ("lote",)
CADASTRAL_PREFIXES = ("4_fnc_",)
AUXILIARY_MARKERS = (
    "veget", "texto", "text", "txt", "label", "simbol", "symbol", "dim",
    "sector", "lake", "area_net", "app lagoa", "etapa",
)


def is_cadastral_layer(layer: Column) -> Column:
    name = F.lower(F.trim(F.coalesce(layer, F.lit(""))))
    match = name.isin(*CADASTRAL_LAYERS)
    for prefix in CADASTRAL_PREFIXES:
        match = match | name.startswith(prefix)
    return match


def is_auxiliary_layer(layer: Column) -> Column:
    name = F.lower(F.trim(X.fold_ascii(F.coalesce(layer, F.lit("")))))
    return name.rlike("|".join(AUXILIARY_MARKERS))


def batch_patch(lots: DataFrame, patch: DataFrame, batch_col: str = "batch_id", clear_col: str | None = None,
                order: str | None = None) -> DataFrame:
    """Applies ``patch(batch_id, lot_id, name, block, status, …)`` to the lots; null fields are left alone.

    ``clear_col`` names an array column of fields to set to null. When a batch names a lot more than once, the
    row of the greatest ``order`` counts, or of the greatest values without one. A batch is rejected whole
    when an id is unknown or its lots belong to several projects. Rows come back per patched lot with
    ``applied`` and the values after the batch.
    """
    fields = [c for c in patch.columns if c not in (batch_col, "lot_id", clear_col, order)]
    values = F.struct(*fields, *([F.array_sort(clear_col).alias(clear_col)] if clear_col else []))
    ranked = F.struct(*([F.col(order).alias("_o")] if order else []), values.alias("v"))
    wanted = patch.groupBy(batch_col, "lot_id").agg(F.max(ranked).alias("_r")).select(batch_col, "lot_id", "_r.v.*")
    cleared = wanted.select(batch_col, "lot_id", F.col(clear_col).alias("_clear")) if clear_col else None
    joined = wanted.select(batch_col, "lot_id", *[F.col(c).alias(f"_new_{c}") for c in fields]).join(lots, "lot_id", "left")
    gate = joined.groupBy(batch_col).agg(
        ((F.count_if(F.col("project_id").isNull()) == 0) & (F.min("project_id") == F.max("project_id"))).alias("applied"))
    out = joined.where(F.col("project_id").isNotNull()).join(gate, batch_col)
    if cleared is not None:
        out = out.join(cleared, [batch_col, "lot_id"])
    for c in fields:
        new = F.coalesce(f"_new_{c}", c)
        if cleared is not None:
            new = F.when(~F.coalesce(F.array_contains("_clear", c), F.lit(False)), new)
        out = out.withColumn(c, F.when(F.col("applied"), new).otherwise(F.col(c)))
    return out.drop("_clear", *[f"_new_{c}" for c in fields])


def live_status(records: DataFrame, lots: DataFrame, key: str) -> DataFrame:
    """Embedded records (``key``, ``position``, ``idx``, ``s``, ``color``) with the current lot status laid over.

    A record without a current lot keeps its own values; an unknown status shows as blocked.
    """
    current = lots.select(key, F.col("external_id").alias("_ext"), F.col("status").alias("_status"))
    ext = F.coalesce("idx", F.col("position").cast("string"))
    joined = records.withColumn("_ext", ext).join(current, [key, "_ext"], "left")
    index = C.index_of(C.STATUSES, F.col("_status"), 3)
    found = F.col("_status").isNotNull()
    return joined.withColumns({
        "s": F.when(found, index).otherwise(F.col("s")),
        "color": F.when(found, C.by_index(C.LIVE_COLORS, index, C.LIVE_COLORS[3])).otherwise(F.col("color")),
        "availability": F.col("_status"),
    }).drop("_ext", "_status")


def status_counts(lots: DataFrame, keys: list[str], status: str = "s") -> DataFrame:
    """Four buckets per version, zero filled."""
    return lots.groupBy(*keys).agg(*[F.count_if(F.col(status) == i).alias(name) for i, name in enumerate(C.STATUSES)])
