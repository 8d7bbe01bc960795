"""Scale, area agreement, label coverage, candidate ranking and regression reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelflow.functions import text as X
from parcelflow.operators.grouped import pick_row, upper_median
from parcelflow.operators.spatial import points_in_rings

MIN_SAMPLES = 20
AREA_TOLERANCE = 0.05


def sheet_scale(lots: DataFrame, key: str) -> DataFrame:
    """px² per m² of a sheet: the upper median over lots with both areas (``area_px``, ``printed``).

    Fewer than 20 samples give no scale.
    """
    both = lots.where((F.col("area_px") > 0) & (F.col("printed") > 0)).select(key, (F.col("area_px") / F.col("printed")).alias("ratio"))
    m = upper_median(both, [key], "ratio")
    ok = (F.col("samples") >= MIN_SAMPLES) & (F.col("median") > 0)
    return m.select(key, "samples", F.when(ok, F.col("median")).alias("px_per_m2"),
                    F.when(ok, F.sqrt("median")).alias("px_per_m"))


def area_deviation(lots: DataFrame, key: str) -> DataFrame:
    """Lots with their signed deviation from the sheet scale; null where it cannot be measured."""
    joined = lots.join(sheet_scale(lots, key), key, "left")
    measurable = (F.col("area_px") > 0) & (F.col("printed") > 0)
    deviation = F.when(measurable, (F.col("area_px") / F.col("printed")) / F.col("px_per_m2") - 1)
    return joined.withColumn("deviation", deviation).withColumn(
        "off", F.coalesce(F.abs("deviation") > AREA_TOLERANCE, F.lit(False)))


def single_printed_area(lots: DataFrame, areas: DataFrame, key: str, lot_id: str) -> DataFrame:
    """``ratio`` of the lots that hold exactly one printed area (``areas(key, x, y, value)``)."""
    pairs = points_in_rings(areas, lots, key)
    per_lot = pairs.groupBy(F.col(f"r.{key}").alias(key), F.col(f"r.{lot_id}").alias(lot_id)).agg(
        F.count("*").alias("n"), F.max("l.value").alias("value"), F.max("r.area_px").alias("area_px"))
    return per_lot.where((F.col("n") == 1) & (F.col("value") > 0)).select(
        key, lot_id, "value", (F.col("area_px") / F.col("value")).alias("ratio"))


def area_agreement(lots: DataFrame, areas: DataFrame, key: str, lot_id: str) -> DataFrame:
    """Share of measured lots within 5 % of the median ratio, null below 20 printed areas or 20 measured lots."""
    printed = areas.groupBy(key).agg(F.count("*").alias("printed"))
    ratios = single_printed_area(lots, areas, key, lot_id)
    median = upper_median(ratios, [key], "ratio")
    good = ratios.join(median, key).groupBy(key).agg(
        F.avg((F.abs(F.col("ratio") / F.col("median") - 1) <= AREA_TOLERANCE).cast("double")).alias("agreement"),
        F.count("*").alias("measured"))
    sheets = lots.select(key).distinct()
    joined = sheets.join(printed, key, "left").join(good, key, "left")
    enough = (F.col("printed") >= MIN_SAMPLES) & (F.col("measured") >= MIN_SAMPLES)
    return joined.select(key, F.coalesce("measured", F.lit(0)).alias("measured"), F.when(enough, F.col("agreement")).alias("agreement"))


def all_sheets(key: str, *tables: DataFrame) -> DataFrame:
    """Every key of any of the tables, once."""
    return reduce(DataFrame.union, [t.select(key) for t in tables]).distinct()


def label_hits(lots: DataFrame, labels: DataFrame, key: str, label_id: str) -> DataFrame:
    """Number of lots over every label, zeros included."""
    pairs = points_in_rings(labels, lots, key)
    hits = pairs.groupBy(F.col(f"l.{key}").alias(key), F.col(f"l.{label_id}").alias(label_id)).agg(F.count("*").alias("hits"))
    return labels.select(key, label_id).join(hits, [key, label_id], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))


def label_coverage(lots: DataFrame, labels: DataFrame, key: str, label_id: str) -> DataFrame:
    """Share of labels covered by exactly one lot; 0 for a sheet without labels or without lots."""
    found = label_hits(lots, labels, key, label_id).groupBy(key).agg(
        F.count("*").alias("labels"), F.avg((F.col("hits") == 1).cast("double")).alias("coverage"))
    return all_sheets(key, lots, labels).join(found, key, "left").select(
        key, F.coalesce("labels", F.lit(0)).alias("labels"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def score_candidates(metrics: DataFrame) -> DataFrame:
    """``metrics(sheet, engine, n, agreement, coverage)`` → score: 0.75·agreement + 0.25·coverage,
    0 without agreement, −1 for an empty set."""
    score = F.when(F.col("n") == 0, -1.0).when(F.col("agreement").isNull(), 0.0).otherwise(
        F.col("agreement") * 0.75 + F.col("coverage") * 0.25)
    return metrics.withColumn("score", score)


def choose_candidate(scored: DataFrame, key: str) -> DataFrame:
    """Within one point of the best score, coverage decides, then score, then size.

    A sheet has a handful of candidate sets; the order of ``rank`` breaks full ties.
    """
    best = F.max("score").over(Window.partitionBy(key))
    close = scored.withColumn("_best", best).where(F.col("score") >= F.col("_best") - 0.01).drop("_best")
    return pick_row(close, [key], F.struct("coverage", "score", "n", -F.col("rank")))


def area_band(lots: DataFrame, key: str) -> DataFrame:
    """Drops lots outside 0.75–1.25 of the median ratio, where the sheet has enough evidence.

    Needs 20 lots and at least max(30, 60 %) measured; unmeasured lots stay, and when fewer
    than 75 % would remain the sheet is left alone. ``lots(key, area_px, printed)``.
    """
    ratio = F.when(F.col("printed") > 0, F.col("area_px") / F.col("printed"))
    rows = lots.withColumn("_ratio", ratio)
    median = upper_median(rows, [key], "_ratio")
    size = rows.groupBy(key).agg(F.count("*").alias("_n"))
    active = (F.col("_n") >= 20) & (F.col("samples") >= F.greatest(F.lit(30), F.floor(F.col("_n") * 0.60))) & (F.col("median") > 0)
    sheet = size.join(median, key, "left").withColumn("_active", F.coalesce(active, F.lit(False)))
    judged = rows.join(sheet, key)
    inside = F.col("_ratio").isNull() | F.col("_ratio").between(F.col("median") * 0.75, F.col("median") * 1.25)
    judged = judged.withColumn("_in", ~F.col("_active") | inside)
    kept = judged.groupBy(key).agg(F.count_if("_in").alias("_kept"))
    final = judged.join(kept, key).withColumn(
        "kept", F.col("_in") | (F.col("_kept") < F.floor(F.col("_n") * 0.75)))
    return final.select(*lots.columns, "kept")


def declared_pairs(texts: DataFrame, pattern: str, keys: list[str], text: str, order: Column) -> DataFrame:
    """All (name, total) matches of a two-group pattern, in text order."""
    names = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))
    totals = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(2))
    return texts.select(*keys, order.alias("_o"), F.posexplode(F.arrays_zip(names.alias("n"), totals.alias("t"))).alias("_i", "p")).select(
        *keys, F.struct("_o", "_i").alias("_at"), F.col("p.n").alias("raw"), F.col("p.t").cast("int").alias("total"))


def declared_counts(texts: DataFrame, keys: list[str], text: str, order: Column) -> DataFrame:
    """Declared lots per block; the last statement about a block wins."""
    found = declared_pairs(texts, X.DECLARED_LOTS, keys, text, order).withColumn("block", X.normalize_block(F.col("raw")))
    return found.where(F.col("block") != "").groupBy(*keys, "block").agg(F.max_by("total", "_at").alias("declared"))


def declared_groups(texts: DataFrame, keys: list[str], text: str, order: Column) -> DataFrame:
    """Declared totals of named groups, without the block declarations."""
    found = declared_pairs(texts, X.DECLARED_GROUP, keys, text, order)
    name = X.clean_text(F.col("raw"))
    statement = F.concat(name, F.lit(" - "), F.col("total").cast("string"), F.lit(" LOTES"))
    return found.where(~statement.rlike(X.DECLARED_BLOCK_NAME)).groupBy(*keys, F.upper(name).alias("group_name")).agg(
        F.max_by("total", "_at").alias("declared"))


# Metrics of the regression report by direction.
HIGHER_IS_BETTER = ("cobertura_pct", "area_ate_3pct", "area_ate_5pct", "quadras_preenchidas_pct")
LOWER_IS_BETTER = ("area_acima_20pct", "lotes_com_nome_ambiguo")


def qa_report(lots: DataFrame, labels: DataFrame, areas: DataFrame, declared: DataFrame, key: str, lot_id: str,
              label_id: str) -> DataFrame:
    """One row of quality metrics per sheet of lots, labels or declarations.

    A sheet without lots or without labels is reported as wholly uncovered and wrong.

    ``lots(key, lot_id, ring, area_px, name, block)``, ``labels(key, label_id, x, y)``,
    ``areas(key, x, y, value)``, ``declared(key, block, declared)``. The deviation is measured
    against the true median here, unlike everywhere else.
    """
    pct = lambda share: F.round(F.lit(100.0) * share, 1)
    hits = label_hits(lots, labels, key, label_id).groupBy(key).agg(
        F.count("*").alias("rotulos_na_planta"), pct(F.avg((F.col("hits") == 1).cast("double"))).alias("cobertura_pct"),
        F.count_if(F.col("hits") > 1).alias("rotulos_em_lote_duplicado"))
    ratios = single_printed_area(lots, areas, key, lot_id)
    median = upper_median(ratios, [key], "ratio", true_median=True)
    deviation = F.abs(F.col("ratio") / F.col("median") - 1)
    under = lambda limit: F.avg((deviation <= limit).cast("double"))
    shape = ratios.join(median, key).groupBy(key).agg(
        F.count("*").alias("lotes_com_area_impressa"), pct(under(0.03)).alias("area_ate_3pct"),
        pct(under(0.05)).alias("area_ate_5pct"), F.round(100.0 - 100.0 * under(0.20), 1).alias("area_acima_20pct"))
    shape = shape.where(F.col("lotes_com_area_impressa") >= MIN_SAMPLES)
    block = F.trim(F.coalesce("block", F.lit("")))
    by_name = lots.groupBy(key, F.coalesce("name", F.lit("")).alias("_name"), block.alias("_block")).agg(F.count("*").alias("_n"))
    names = by_name.groupBy(key).agg(
        F.sum("_n").alias("lotes_extraidos"),
        pct(F.sum(F.when(F.col("_block") != "", F.col("_n")).otherwise(0)) / F.sum("_n")).alias("quadras_preenchidas_pct"),
        F.sum(F.col("_n") - 1).alias("lotes_com_nome_ambiguo"))
    per_block = by_name.where(F.col("_block") != "").groupBy(key, F.upper("_block").alias("block")).agg(F.sum("_n").alias("_found"))
    exact = declared.join(per_block, [key, "block"], "left").groupBy(key).agg(
        F.count("*").alias("quadras_declaradas"), F.count_if(F.col("_found") == F.col("declared")).alias("quadras_com_contagem_exata"))
    report = all_sheets(key, lots, labels, declared).join(names, key, "left").join(hits, key, "left").join(shape, key, "left").join(exact, key, "left")
    report = report.withColumn("lotes_a_mais_que_rotulos", F.col("lotes_extraidos") - F.col("rotulos_na_planta"))
    report = report.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("lotes_extraidos", "rotulos_na_planta")})
    empty = (F.col("lotes_extraidos") == 0) | (F.col("rotulos_na_planta") == 0)
    fixed = {"cobertura_pct": 0.0, "area_ate_3pct": 0.0, "area_ate_5pct": 0.0, "area_acima_20pct": 100.0, "quadras_preenchidas_pct": 0.0}
    unknown = ("rotulos_em_lote_duplicado", "lotes_com_area_impressa", "lotes_com_nome_ambiguo", "quadras_com_contagem_exata", "lotes_a_mais_que_rotulos")
    return report.withColumns({**{c: F.when(empty, F.lit(v)).otherwise(F.col(c)) for c, v in fixed.items()},
                               **{c: F.when(~empty, F.col(c)) for c in unknown}})


def qa_compare(current: DataFrame, baseline: DataFrame, key: str, tolerance: float = 0.5) -> DataFrame:
    """Metrics that got worse than the baseline by more than the tolerance."""
    metrics = [*HIGHER_IS_BETTER, *LOWER_IS_BETTER]
    tall = lambda df, value: df.select(key, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        [key], metrics, "metric", value).where(F.col(value).isNotNull())
    both = tall(current, "current_value").join(tall(baseline, "baseline_value"), [key, "metric"])
    fell = F.col("metric").isin(*HIGHER_IS_BETTER) & (F.col("current_value") < F.col("baseline_value") - tolerance)
    rose = F.col("metric").isin(*LOWER_IS_BETTER) & (F.col("current_value") > F.col("baseline_value") + tolerance)
    return both.where(fell | rose)
