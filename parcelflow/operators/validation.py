"""Rule-based lot validation, its summaries and the publish gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parcelflow.operators.grouped import first_rows

LISTED_ISSUES = 500
ISSUES_PER_GROUP = 20


def validate_lots(lots: DataFrame, version: str = "version_id", lot_id: str = "lot_id") -> DataFrame:
    """Issue rows of ``lots(version, lot_id, sort_order, name, geometry_json, area_m2)``.

    Broken geometry JSON ends the checks of that lot. ``seq`` is the rule's place in the lot.
    """
    repeated = lots.where(F.coalesce("name", F.lit("")) != "").groupBy(version, "name").agg((F.count("*") > 1).alias("_dup"))
    rows = lots.join(repeated, [version, "name"], "left")
    doc = F.try_parse_json("geometry_json")
    size = lambda path: F.coalesce(F.size(F.try_variant_get("_g", path, "array<variant>")), F.lit(0))
    rows = rows.withColumn("_g", doc).withColumn("_pts", F.when(size("$.points") > 0, size("$.points")).otherwise(size("$.coordinates")))
    issue = lambda seq, kind, severity, cond: F.when(cond, F.struct(
        F.lit(seq).alias("seq"), F.lit(kind).alias("type"), F.lit(severity).alias("severity")))
    parsed = F.col("_g").isNotNull()
    issues = F.array_compact(F.array(
        issue(0, "missing_name", "warning", F.coalesce("name", F.lit("")) == ""),
        issue(1, "duplicate_name", "warning", F.coalesce("_dup", F.lit(False))),
        issue(2, "invalid_geometry_json", "error", ~parsed),
        issue(3, "invalid_geometry", "error", parsed & (F.col("_pts") < 3)),
        issue(4, "invalid_area", "warning", parsed & (F.col("area_m2") <= 0))))
    return rows.select(version, lot_id, "sort_order", "name", F.inline(issues))


def validation_summary(lots: DataFrame, issues: DataFrame, version: str = "version_id") -> DataFrame:
    """Counts over all issues of a version."""
    n = lots.groupBy(version).agg(F.count("*").alias("lot_count"))
    i = issues.groupBy(version).agg(
        F.count("*").alias("issue_count"), F.count_if(F.col("severity") == "error").alias("error_count"),
        F.count_if(F.col("severity") == "warning").alias("warning_count"))
    return n.join(i, version, "left").na.fill(0, ["issue_count", "error_count", "warning_count"])


def listed_issues(issues: DataFrame, version: str = "version_id", lot_id: str = "lot_id") -> DataFrame:
    """The first 500 issues of each version, in lot order, as the summary shows them."""
    return first_rows(issues, [version], [F.col("sort_order"), F.col(lot_id), F.col("seq")], LISTED_ISSUES)


def issue_groups(issues: DataFrame, version: str = "version_id", lot_id: str = "lot_id") -> DataFrame:
    """Per type: total, the severity (one error makes the group an error) and the first 20 lots."""
    totals = issues.groupBy(version, "type").agg(
        F.count("*").alias("total"), F.when(F.bool_or(F.col("severity") == "error"), "error").otherwise("warning").alias("severity"))
    shown = first_rows(issues, [version, "type"], [F.col("sort_order"), F.col(lot_id)], ISSUES_PER_GROUP)
    samples = shown.groupBy(version, "type").agg(F.array_sort(F.collect_list(F.struct("rn", lot_id))).alias("_s"))
    listed = F.array_join(F.transform("_s", lambda s: s[lot_id].cast("string")), ",")
    return totals.join(samples.select(version, "type", listed.alias("samples")), [version, "type"])


def issue_group_order() -> list:
    """Errors first, then the largest groups."""
    return [F.when(F.col("severity") == "error", 0).otherwise(1), F.col("total").desc()]


def publish_gate(summary: DataFrame, require_clean: bool = True) -> DataFrame:
    allowed = (F.col("error_count") == 0) if require_clean else F.lit(True)
    return summary.withColumn("publishable", allowed)
