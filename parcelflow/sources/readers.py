"""Table, CSV, JSON, HTML and binary-file sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from parcelflow.schemas import INPUT_TABLES, LOT_RECORD

# Fixed vocabulary, Portuguese, in status-index order.
STATUS_NAMES_PT = ("disponivel", "vendido", "reservado", "bloqueado")

PDF_SIZE_LIMIT = 80 * 1024 * 1024


def load_table(spark: SparkSession, folder: str, name: str, schema: str | None = None) -> DataFrame:
    """Parquet table by name with a declared schema; a mismatch fails before any job runs."""
    declared = StructType.fromDDL(schema or INPUT_TABLES[name])
    return spark.read.schema(declared).parquet(f"{folder}/{name}.parquet")


def status_from_csv(rows: DataFrame, lots: DataFrame) -> DataFrame:
    """``rows(seq, index, status)`` as strings → status index for every lot position ``i``.

    A row without a numeric index is skipped, an unknown status reads as 0, the last row
    of an index wins and a lot without a row gets 0.
    """
    status = F.lower(F.trim(F.coalesce(F.col("status"), F.lit(""))))
    position = F.array_position(F.array(*[F.lit(s) for s in STATUS_NAMES_PT]), status)
    parsed = rows.select(
        F.expr("try_cast(trim(index) AS bigint)").alias("i"),
        F.when(position > 0, position - 1).otherwise(0).cast("int").alias("s"),
        "seq",
    ).where(F.col("i").isNotNull())
    last = parsed.groupBy("i").agg(F.max_by("s", "seq").alias("s"))
    return lots.join(last, "i", "left").withColumn("s", F.coalesce("s", F.lit(0)))


def read_status_csv(spark: SparkSession, path: str) -> DataFrame:
    """Status files with the columns ``index`` and ``status`` by header, in any order and among others → (seq, index, status).

    ``seq`` orders the rows as the files have them: by file name, then by place in the file, across the splits of a large one. A
    column ``seq`` of the files themselves goes first. Files of one folder share their header, or reading fails.
    """
    raw = spark.read.option("header", True).option("escape", '"').option("enforceSchema", False).csv(path)
    text = lambda name: (F.col(name) if name in raw.columns else F.lit(None)).cast("string").alias(name)
    place = F.struct(F.expr("try_cast(seq AS bigint)").alias("own") if "seq" in raw.columns else F.lit(0).cast("bigint").alias("own"),
                     F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return raw.select(place.alias("seq"), text("index"), text("status"))


def demo_status(i: Column) -> Column:
    """Status index shown when there is no status file."""
    bucket = (i * 73) % 100
    return F.when(bucket < 10, 2).when(bucket < 33, 1).otherwise(0)


def explode_lot_json(documents: DataFrame, key_cols: list[str], json_col: str = "doc") -> DataFrame:
    """One JSON document per version → one row per lot object, with its position.

    The array is under ``data``, or ``lots`` when ``data`` is missing or empty; entries that
    are not objects are dropped, but still count in the position.
    """
    # try_parse_json keeps one malformed document from failing the job.
    parsed = documents.select(*key_cols, F.try_parse_json(F.col(json_col)).alias("v"))
    data = F.try_variant_get("v", "$.data", "array<variant>")
    lots = F.try_variant_get("v", "$.lots", "array<variant>")
    items = F.when(F.size(data) > 0, data).otherwise(lots)
    rows = parsed.select(*key_cols, F.posexplode(items).alias("position", "item"))
    text = F.to_json("item")
    return rows.select(*key_cols, "position", text.alias("record_json")).where(F.col("record_json").startswith("{"))


def html_embedded_array(html: Column) -> Column:
    """Text that starts at the JSON array assigned to ``INIT``; null when there is none.

    Only JSON is decoded downstream: script text is never evaluated.
    """
    tail = F.regexp_extract(html, r"(?s)\bINIT\s*=\s*(\[.*)$", 1)
    first = F.regexp_extract(html, r"\bINIT\s*=\s*(.)", 1)
    return F.when(first == "[", tail)


def lots_from_html(pages: DataFrame, key_cols: list[str], html_col: str = "html") -> DataFrame:
    """Lot records embedded in map pages: the parser stops after the first JSON value."""
    array = html_embedded_array(F.col(html_col))
    records = F.from_json(array, f"array<{LOT_RECORD}>")
    return (
        pages.select(*key_cols, records.alias("records"))
        .where(F.col("records").isNotNull())
        .select(*key_cols, F.posexplode("records").alias("position", "record"))
        .where(F.col("record").isNotNull())
    )


def register_html_table_function(spark: SparkSession) -> None:
    """SQL table function ``lots_from_html(html)`` over the same extraction."""
    spark.sql(rf"""
        CREATE OR REPLACE TEMPORARY FUNCTION lots_from_html(html STRING)
        RETURNS TABLE (position INT, record {LOT_RECORD})
        RETURN SELECT position, record FROM (
          SELECT posexplode(from_json(regexp_extract(html, r'(?s)\bINIT\s*=\s*(\[.*)$', 1),
                 'array<{LOT_RECORD}>')) AS (position, record)) WHERE record IS NOT NULL
    """)


def clean_file_name(name: Column) -> Column:
    base = F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/]*)$", 1)
    cleaned = F.substring(F.replace(F.trim(base), F.lit("\\"), F.lit("-")), 1, 180)
    return F.when(cleaned == "", "arquivo").otherwise(cleaned)


def guess_content_type(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return (
        F.when(ext == "pdf", "application/pdf").when(ext == "html", "text/html")
        .when(ext == "csv", "text/csv").when(ext == "json", "application/json")
        .when(ext == "txt", "text/plain").otherwise("application/octet-stream")
    )


def file_manifest(files: DataFrame) -> DataFrame:
    """``files(path, content)`` → cleaned name, content type, size and SHA-256."""
    named = files.withColumn("name", clean_file_name(F.col("path")))
    return named.select(
        "path", "name", guess_content_type(F.col("name")).alias("content_type"),
        F.length("content").cast("bigint").alias("size_bytes"), F.sha2("content", 256).alias("checksum_sha256"),
    )


def read_binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content", "length")


def file_intake(files: DataFrame, limit: int = PDF_SIZE_LIMIT) -> DataFrame:
    """Classify uploads ``(path, content, length)``, in the order in which the checks reject them.

    A file beyond the limit is judged by its length alone: ``content`` may be null there.
    """
    verdict = (
        F.when(~F.lower("path").endswith(".pdf"), "not_pdf_name")
        .when(F.col("content").isNotNull() & (F.substring("content", 1, 5) != F.lit(b"%PDF-")), "bad_signature")
        .when(F.col("length") > limit, "too_large")
        .otherwise("ok")
    )
    return files.withColumn("verdict", verdict)


def read_uploads(spark: SparkSession, path: str, glob: str = "*", limit: int = PDF_SIZE_LIMIT) -> DataFrame:
    """Files of a folder as (path, content, length); files beyond ``limit`` are listed and not opened, so their
    size is no matter."""
    source = lambda: spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    small = source().where(F.col("length") <= limit).select("path", "content", "length")
    large = source().where(F.col("length") > limit).select("path", F.lit(None).cast("binary").alias("content"), "length")
    return small.unionByName(large)
