"""Queries over scale, agreement, coverage, ranking and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelflow.functions import text as X
from parcelflow.operators import quality as Q
from parcelflow.plans.q_lots import PRINTED, SCALE_SQL, measured_lots
from parcelflow.plans.registry import query


def printed_areas(t):
    """Printed areas as points. Some lots hold a second one."""
    items = t.text_items()
    value = X.parse_area_simple(X.area_text(F.col("text")))
    found = items.select("sheet_id", "seq", "x", "y", value.alias("value")).where("value > 0")
    extra = found.where("seq % 14 = 0").withColumn("y", F.col("y") + 2)
    return found.unionByName(extra)


AREAS_SQL = f"""areas AS (SELECT version_id AS sheet_id, lot_id, {PRINTED} AS value FROM lots WHERE area_text <> ''),
ratios AS (SELECT sheet_id, lot_id, 300.0 / value AS ratio FROM areas WHERE lot_id % 14 <> 0)"""


def lot_labels(t):
    items = t.text_items()
    return items.where(X.lot_label(F.col("text")) != "").select("sheet_id", F.col("seq").alias("label_id"), "x", "y")


def sheet_lots(t):
    return t.lot_rings().withColumnRenamed("version_id", "sheet_id")


def kept_lots(t):
    """A lot set with gaps and a few doubled lots."""
    lots = sheet_lots(t).where("lot_id % 9 <> 0")
    return lots.unionByName(lots.where("lot_id % 16 = 0").withColumn("lot_id", F.col("lot_id") + 10_000_000))


LABELS_SQL = "labels AS (SELECT version_id AS sheet_id, lot_id AS label_id, CASE WHEN lot_id % 9 = 0 THEN 0 WHEN lot_id % 16 = 0 THEN 2 ELSE 1 END AS hits FROM lots WHERE name LIKE 'L0%')"


@query("agg_area_agreement", f"""
WITH {AREAS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY ratio) AS rn, count(*) OVER (PARTITION BY sheet_id) AS n FROM ratios),
p AS (SELECT sheet_id, count(*) + count(*) FILTER (lot_id % 14 = 0) AS printed FROM areas GROUP BY 1),
m AS (SELECT sheet_id, n, ratio AS median FROM r WHERE rn = n // 2 + 1)
SELECT v.sheet_id, coalesce(m.n, 0) AS measured, CASE WHEN printed >= 20 AND m.n >= 20 THEN round((SELECT avg(CASE WHEN abs(ratio / median - 1) <= 0.05 THEN 1.0 ELSE 0.0 END) FROM r WHERE r.sheet_id = v.sheet_id), 9) END AS agreement
FROM (SELECT DISTINCT version_id AS sheet_id FROM lots) v LEFT JOIN m USING (sheet_id) LEFT JOIN p USING (sheet_id)""")
def _(t):
    a = Q.area_agreement(sheet_lots(t), printed_areas(t), "sheet_id", "lot_id")
    return a.withColumn("agreement", F.round("agreement", 9))


@query("agg_label_coverage", f"""
WITH {LABELS_SQL}, found AS (SELECT sheet_id, count(*) AS labels, round(avg(CASE WHEN hits = 1 AND sheet_id <> 20 THEN 1.0 ELSE 0.0 END), 9) AS coverage FROM labels WHERE sheet_id <> 10 GROUP BY 1)
SELECT sheet_id, coalesce(labels, 0) AS labels, coalesce(coverage, 0.0)::double AS coverage
FROM (SELECT version_id AS sheet_id FROM lots WHERE lot_id % 9 <> 0 AND version_id <> 20 UNION SELECT sheet_id FROM found) LEFT JOIN found USING (sheet_id)""")
def _(t):
    # sheet 20 has lost its lots, sheet 10 its labels
    return Q.label_coverage(kept_lots(t).where("sheet_id <> 20"), lot_labels(t).where("sheet_id <> 10"), "sheet_id", "label_id").withColumn("coverage", F.round("coverage", 9))


@query("set_missing_labels", f"WITH {LABELS_SQL} SELECT sheet_id, label_id FROM labels WHERE hits = 0")
def _(t):
    hits = Q.label_hits(kept_lots(t), lot_labels(t), "sheet_id", "label_id")
    return hits.where("hits = 0").select("sheet_id", "label_id")


def candidate_metrics(t):
    """Candidate sets of a sheet come from a table of measured sets."""
    o = t.raw("lineitem")
    agree = F.when(F.col("l_tax") > 0.07, None).otherwise(F.round(0.9 + F.col("l_discount"), 4))
    n = F.when(F.col("l_quantity") == 1, 0).otherwise(F.col("l_quantity").cast("int") * 10)
    return o.groupBy(F.col("l_orderkey").alias("sheet_id"), F.col("l_linenumber").alias("rank")).agg(F.max_by(F.struct(
        agree.alias("agreement"), F.round(1 - F.col("l_tax"), 4).alias("coverage"), n.alias("n")), F.struct("l_partkey", "l_suppkey", "l_shipdate")).alias("m")).select(
        "sheet_id", "rank", "m.*")


@query("win_rank_candidates", """
WITH c AS (SELECT l_orderkey AS sheet_id, l_linenumber AS rank, max_by({'agreement': CASE WHEN l_tax > 0.07 THEN NULL ELSE round(0.9 + l_discount, 4) END, 'coverage': round(1 - l_tax, 4), 'n': CASE WHEN l_quantity = 1 THEN 0 ELSE cast(l_quantity AS int) * 10 END}, (l_partkey, l_suppkey, l_shipdate)) AS m FROM lineitem GROUP BY 1, 2),
s AS (SELECT sheet_id, rank, m.n AS n, m.coverage AS coverage, CASE WHEN m.n = 0 THEN -1.0 WHEN m.agreement IS NULL THEN 0.0 ELSE m.agreement * 0.75::double + m.coverage * 0.25::double END AS score FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY coverage DESC, score DESC, n DESC, rank) AS rn FROM (SELECT *, max(score) OVER (PARTITION BY sheet_id) AS best FROM s) WHERE score >= best - 0.01::double)
SELECT sheet_id, rank, n, coverage, cast(round(score, 9) AS double) AS score FROM k WHERE rn = 1""")
def _(t):
    chosen = Q.choose_candidate(Q.score_candidates(candidate_metrics(t)), "sheet_id")
    return chosen.select("sheet_id", "rank", "n", "coverage", F.round("score", 9).alias("score"))


@query("filter_area_band", f"""
WITH {SCALE_SQL}, n AS (SELECT version_id, count(*) AS n FROM lots GROUP BY 1),
j AS (SELECT m.lot_id, m.version_id, n, coalesce(n >= 20 AND r.samples >= greatest(30, floor(n * 0.6)), false) AS active, m.printed IS NULL OR (px / m.printed BETWEEN r.ratio * 0.75 AND r.ratio * 1.25) AS inside
  FROM measured m JOIN n USING (version_id) LEFT JOIN (SELECT * FROM ranked WHERE rn = samples // 2 + 1) r ON r.version_id = m.version_id),
w AS (SELECT *, count(*) FILTER (NOT active OR inside) OVER (PARTITION BY version_id) AS remaining FROM j)
SELECT lot_id, (NOT active OR inside) OR remaining < floor(n * 0.75) AS kept FROM w""")
def _(t):
    return Q.area_band(measured_lots(t).select("version_id", "lot_id", "area_px", "printed"), "version_id").select("lot_id", "kept")


def declarations(t):
    """Texts that declare lot counts: per part one statement, some about a named group."""
    p = t.raw("part")
    word = F.when(F.col("p_size") % 4 == 0, "QD-").when(F.col("p_size") % 4 == 1, "Quadra ").when(F.col("p_size") % 4 == 2, "E").otherwise("Q")
    block = F.concat(word, F.col("p_size").cast("string"))
    text = F.concat(F.lit("Planta "), block, F.lit(" - "), (F.col("p_partkey") % 40 + 1).cast("string"), F.lit(" LOTES; JARDIM "),
                    F.upper(F.regexp_extract("p_name", r"^(\w+)", 1)), F.lit(" - "), (F.col("p_partkey") % 90 + 10).cast("string"), F.lit(" lotes"))
    return p.select((F.col("p_partkey") % 25).alias("sheet_id"), F.col("p_partkey").alias("seq"), text.alias("text"))


@query("agg_declared_counts", """
WITH d AS (SELECT p_partkey % 25 AS sheet_id, p_partkey AS seq, CASE p_size % 4 WHEN 2 THEN 'E' ELSE 'Q' END || p_size AS block, cast(p_partkey % 40 + 1 AS int) AS n FROM part)
SELECT sheet_id, block, arg_max(n, seq) AS declared FROM d GROUP BY 1, 2""")
def _(t):
    return Q.declared_counts(declarations(t), ["sheet_id"], "text", F.col("seq"))


@query("agg_declared_groups", """
SELECT p_partkey % 25 AS sheet_id, 'JARDIM ' || upper(regexp_extract(p_name, '^(\\w+)', 1)) AS group_name, arg_max(cast(p_partkey % 90 + 10 AS int), p_partkey) AS declared FROM part GROUP BY 1, 2""")
def _(t):
    return Q.declared_groups(declarations(t), ["sheet_id"], "text", F.col("seq"))


def qa_inputs(t):
    declared = t.lots.where("block <> ''").groupBy(F.col("version_id").alias("sheet_id"), "block").agg(
        (F.count("*") + F.max("k") % 2).cast("int").alias("declared"))
    areas = printed_areas(t)
    # sheet 20 has lost its lots, sheet 10 its labels
    return sheet_lots(t).where("lot_id % 9 <> 0 and sheet_id <> 20"), lot_labels(t).where("sheet_id <> 10"), areas, declared


QA_SQL = f"""{AREAS_SQL}, kept AS (SELECT version_id AS sheet_id, * FROM lots WHERE lot_id % 9 <> 0 AND version_id <> 20),
lab AS (SELECT version_id AS sheet_id, count(*) AS n, round(100.0 * avg(CASE WHEN lot_id % 9 <> 0 THEN 1.0 ELSE 0.0 END), 1) AS cov FROM lots WHERE name LIKE 'L0%' AND version_id <> 10 GROUP BY 1),
q AS (SELECT * FROM ratios WHERE lot_id % 9 <> 0 AND sheet_id <> 20), med AS (SELECT sheet_id, median(ratio) AS m, count(*) AS n FROM q GROUP BY 1),
dev AS (SELECT q.sheet_id, count(*) AS n, round(100.0 * avg(CASE WHEN abs(ratio / m - 1) <= 0.03 THEN 1.0 ELSE 0.0 END), 1) AS a3, round(100.0 * avg(CASE WHEN abs(ratio / m - 1) <= 0.05 THEN 1.0 ELSE 0.0 END), 1) AS a5,
  round(100.0 - 100.0 * avg(CASE WHEN abs(ratio / m - 1) <= 0.2 THEN 1.0 ELSE 0.0 END), 1) AS a20 FROM q JOIN med USING (sheet_id) GROUP BY 1 HAVING count(*) >= 20),
nm AS (SELECT sheet_id, count(*) AS n, round(100.0 * avg(CASE WHEN trim(block) <> '' THEN 1.0 ELSE 0.0 END), 1) AS qp, count(*) - count(DISTINCT coalesce(name, '') || '|' || trim(block)) AS amb FROM kept GROUP BY 1),
de AS (SELECT version_id AS sheet_id, block, count(*) + max(k) % 2 AS declared, count(*) FILTER (lot_id % 9 <> 0 AND version_id <> 20) AS found FROM lots WHERE block <> '' GROUP BY 1, 2),
ex AS (SELECT sheet_id, count(*) AS n, count(*) FILTER (declared = found) AS exact FROM de GROUP BY 1),
sheets AS (SELECT sheet_id FROM nm UNION SELECT sheet_id FROM lab UNION SELECT sheet_id FROM ex),
report AS (SELECT sheet_id, coalesce(nm.n, 0) AS lotes_extraidos, CASE WHEN nm.n > 0 AND lab.n > 0 THEN qp ELSE 0.0 END::double AS quadras_preenchidas_pct, CASE WHEN lab.n > 0 THEN amb END AS lotes_com_nome_ambiguo,
  coalesce(lab.n, 0) AS rotulos_na_planta, CASE WHEN nm.n > 0 AND lab.n > 0 THEN cov ELSE 0.0 END::double AS cobertura_pct, CASE WHEN nm.n > 0 AND lab.n > 0 THEN 0::bigint END AS rotulos_em_lote_duplicado,
  CASE WHEN lab.n > 0 THEN dev.n END AS lotes_com_area_impressa, CASE WHEN nm.n > 0 AND lab.n > 0 THEN a3 ELSE 0.0 END::double AS area_ate_3pct, CASE WHEN nm.n > 0 AND lab.n > 0 THEN a5 ELSE 0.0 END::double AS area_ate_5pct,
  CASE WHEN nm.n > 0 AND lab.n > 0 THEN a20 ELSE 100.0 END::double AS area_acima_20pct, ex.n AS quadras_declaradas, CASE WHEN nm.n > 0 AND lab.n > 0 THEN ex.exact END AS quadras_com_contagem_exata, nm.n - lab.n AS lotes_a_mais_que_rotulos
  FROM sheets LEFT JOIN nm USING (sheet_id) LEFT JOIN lab USING (sheet_id) LEFT JOIN dev USING (sheet_id) LEFT JOIN ex USING (sheet_id))"""


@query("agg_qa_report", f"WITH {QA_SQL} SELECT * FROM report")
def _(t):
    return Q.qa_report(*qa_inputs(t), "sheet_id", "lot_id", "label_id")


@query("qa_regression_compare", f"""
WITH {QA_SQL}, cur AS (UNPIVOT (SELECT sheet_id, cobertura_pct, cast(area_ate_3pct AS double) AS area_ate_3pct, area_ate_5pct, quadras_preenchidas_pct, area_acima_20pct, cast(lotes_com_nome_ambiguo AS double) AS lotes_com_nome_ambiguo FROM report)
  ON cobertura_pct, area_ate_3pct, area_ate_5pct, quadras_preenchidas_pct, area_acima_20pct, lotes_com_nome_ambiguo INTO NAME metric VALUE current_value),
base AS (SELECT sheet_id, metric, current_value, CASE WHEN metric IN ('area_acima_20pct', 'lotes_com_nome_ambiguo') THEN current_value - (sheet_id % 3) * 0.4::double ELSE current_value + (sheet_id % 3) * 0.4::double END AS baseline_value FROM cur)
SELECT sheet_id, metric, current_value, baseline_value FROM base WHERE (metric NOT IN ('area_acima_20pct', 'lotes_com_nome_ambiguo') AND current_value < baseline_value - 0.5::double) OR (metric IN ('area_acima_20pct', 'lotes_com_nome_ambiguo') AND current_value > baseline_value + 0.5::double)""")
def _(t):
    from parcelflow.session import cut
    report = cut(Q.qa_report(*qa_inputs(t), "sheet_id", "lot_id", "label_id"))
    shift = (F.col("sheet_id") % 3) * 0.4
    baseline = report.withColumns({**{m: F.col(m) + shift for m in Q.HIGHER_IS_BETTER}, **{m: F.col(m) - shift for m in Q.LOWER_IS_BETTER}})
    return Q.qa_compare(report, baseline, "sheet_id").select("sheet_id", "metric", "current_value", "baseline_value")
