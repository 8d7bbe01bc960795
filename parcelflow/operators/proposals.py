"""Edit proposals and unique project identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parcelflow.functions.text import slug_base
from parcelflow.operators.grouped import group_rank, pick_row
from parcelflow.session import cut


def with_base_version(proposals: DataFrame, versions: DataFrame) -> DataFrame:
    """The latest published version of the project is the one a proposal is about."""
    base = versions.where("is_published").groupBy("project_id").agg(
        F.max_by("version_id", F.struct("created_at", "version_id")).alias("base_version_id"))
    return proposals.join(base, "project_id", "left")


def decide(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """Applies ``decisions(proposal_id, decision, notes, at)``; the last decision counts."""
    last = pick_row(decisions, ["proposal_id"], F.struct("at", "decision"))
    row = proposals.join(last, "proposal_id", "left")
    decided = F.col("decision").isNotNull()
    return row.withColumns({
        "status": F.coalesce("decision", "status"), "decided_at": F.coalesce("at", "decided_at"),
        "review_notes": F.when(decided, F.col("notes")).otherwise(F.col("review_notes"))}).drop("decision", "notes", "at")


def queue(proposals: DataFrame, status: str = "pending") -> DataFrame:
    return proposals.where(F.col("status") == status).orderBy(F.col("created_at").desc(), F.col("proposal_id").desc())


def assign_slugs(rows: DataFrame, taken: DataFrame, max_length: int = 64) -> DataFrame:
    """``rows(id, name)`` → unique slugs: the base, then ``-2``, ``-3`` …, in id order.

    Every pass hands out consecutive suffixes per base and keeps those that nobody has; the few
    that collide with a taken slug (a base that itself ends in ``-2``, say) move on in the next pass.
    """
    pending = rows.select("id", slug_base(F.col("name"), max_length).alias("base")).where(F.col("base").isNotNull())
    pending = pending.withColumn("_skip", F.lit(0).cast("bigint"))
    used, done = taken.select("slug"), None
    while True:
        ranked = group_rank(pending, ["base"], [F.col("id")], "_n")
        number = F.col("_n") + F.col("_skip")
        named = ranked.withColumn("slug", F.when(number == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), number.cast("string"))))
        first = named.groupBy("slug").agg(F.min("id").alias("_owner"))
        judged = cut(named.join(first, "slug").join(used.withColumn("_taken", F.lit(True)), "slug", "left").withColumn(
            "_ok", F.col("_taken").isNull() & (F.col("_owner") == F.col("id"))))
        fresh = judged.where("_ok").select("id", "slug")
        done = fresh if done is None else done.unionByName(fresh)
        used = used.unionByName(fresh.select("slug"))
        rest = judged.where("NOT _ok")
        if rest.isEmpty():
            return done
        # Later numbers of a base start behind the highest one given out or found taken.
        top = judged.groupBy("base").agg(F.max(F.col("_n") + F.col("_skip")).alias("_top"))
        pending = rest.select("id", "base").join(top, "base").select("id", "base", F.col("_top").alias("_skip"))
