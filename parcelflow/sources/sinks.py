"""CSV, GeoJSON, JSON-payload and versioned-table sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

CSV_COLUMNS = ("index", "quadra", "lote", "area", "status", "cor", "grupo", "pontos")
PAYLOAD_PART = 5000


def _quoted(value: Column) -> Column:
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def lot_csv_lines(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Export rows with one fully quoted CSV ``line`` each."""
    return rows.select(*keep, F.concat_ws(",", *[_quoted(F.col(c)) for c in CSV_COLUMNS]).alias("line"))


def write_lot_csv(rows: DataFrame, path: str) -> None:
    (rows.select(*CSV_COLUMNS).na.fill("").write.mode("overwrite")
        .option("header", True).option("quoteAll", True).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def geojson_features(lots: DataFrame, id_col: str, properties: list[str], geometry_col: str = "geometry_json") -> DataFrame:
    """One Feature row per lot. A ring needs three points or more, all pairs of finite numbers;
    it is closed when open, and anything else stays visible as a null geometry."""
    points = F.try_variant_get(F.try_parse_json(geometry_col), "$.points", "array<variant>")
    pairs = F.transform(points, lambda p: F.try_variant_get(p, "$", "array<double>"))
    typed = lots.withColumn("_pairs", pairs)
    usable = (F.size("_pairs") >= 3) & F.forall("_pairs", lambda p: F.coalesce(
        (F.size(p) == 2) & F.forall(p, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)))
    closed = F.when(F.get("_pairs", F.lit(0)) == F.element_at("_pairs", -1), F.col("_pairs")).otherwise(
        F.concat("_pairs", F.slice("_pairs", 1, 1)))
    ring = F.when(F.coalesce(usable, F.lit(False)), closed)
    shaped = typed.withColumn("ring", ring)
    geometry = F.when(F.col("ring").isNotNull(), F.struct(
        F.lit("Polygon").alias("type"), F.array("ring").alias("coordinates")))
    feature = F.to_json(F.struct(
        F.lit("Feature").alias("type"), F.col(id_col).alias("id"),
        F.struct(*[F.col(p) for p in properties]).alias("properties"), geometry.alias("geometry"),
    ), {"ignoreNullFields": "false"})
    return shaped.withColumn("feature", feature).drop("_pairs")


def script_safe(text: Column) -> Column:
    """JSON that can sit inside a script element."""
    for raw, code in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def lot_payload(lots: DataFrame, version_col: str, order_col: str, fields: list[str],
                part_size: int = PAYLOAD_PART) -> DataFrame:
    """JSON array text per version, cut into parts of consecutive positions.

    A version of any size stays distributed: each part is a bounded piece, and joining the
    parts of a version in order with commas between ``[`` and ``]`` gives the document.
    """
    item = F.struct(F.col(order_col).alias("o"), script_safe(F.to_json(F.struct(*fields))).alias("j"))
    part = F.floor(F.col(order_col) / part_size).cast("bigint")
    grouped = lots.groupBy(version_col, part.alias("part")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return grouped.select(
        version_col, "part", F.size("items").cast("bigint").alias("lots"),
        F.array_join(F.transform("items", lambda i: i["j"]), ",").alias("payload"),
    )


def write_versioned_lots(lots: DataFrame, path: str, rows_per_file: int = 2_000_000) -> None:
    """Lots by project and version. Only the partitions present in ``lots`` are replaced.

    Repartitioning on the partition columns plus a position stripe gives each version a few
    files, and splits a version that holds many rows over several writers.
    """
    stripe = F.floor(F.col("sort_order") / rows_per_file)
    (lots.repartition("project_id", "project_version_id", stripe)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("project_id", "project_version_id").parquet(path))
