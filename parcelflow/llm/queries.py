"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from parcelflow.llm import balltree, decontaminate, filteraudit, licenses, pieces, pii, quality, sharding, simhash, tokenalign, tokengroups, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"), size=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.assign(table(spark, folder, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"),
                         F.lit(None).cast("int").alias("grown_shard"))


@query
def op5_balltree(spark: SparkSession, folder: str) -> DataFrame:
    return balltree.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


ORACLES["op5_balltree"] = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS n, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.n, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM (SELECT * FROM v WHERE vec_id % 50 = 0) q JOIN v c ON q.n <> c.n),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS "rank" FROM s)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 5
"""

#: Fixed values of the URL filter: verdict, host, path.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


@query
def op9_urls(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages"), URL_RULES)


@query
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.grade_documents(table(spark, folder, "documents"), quality.label_grades(table(spark, folder, "labels")))


@query
def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    counts = [number(k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


@query
def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


_TOKENS = """SELECT {key}, [w FOR w IN regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+') IF w <> ''] AS h FROM {table}"""
ORACLES["op3_decontaminate"] = f"""
WITH docs AS (SELECT DISTINCT * FROM ({_TOKENS.format(key="doc_id", table="documents")})),
bench AS (SELECT DISTINCT * FROM ({_TOKENS.format(key="item_id", table="benchmark")})),
d AS (SELECT row_number() OVER () AS d, * FROM docs),
b AS (SELECT row_number() OVER () AS b, * FROM bench WHERE len(h) >= 5),
dw AS (SELECT d, unnest(h) AS w, unnest(range(len(h))) AS p FROM d),
bw AS (SELECT b, len(h) AS n, unnest(h) AS w, unnest(range(len(h))) AS q FROM b),
same AS (SELECT d, b, n, p - q AS diagonal, q FROM dw JOIN bw USING (w)),
busy AS (SELECT d, b, diagonal FROM same GROUP BY ALL HAVING count(*) >= least(11, min(n))),
counted AS (
  SELECT d, b, n, count(*) OVER (PARTITION BY d, b, diagonal ORDER BY q RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS m
  FROM same SEMI JOIN busy USING (d, b, diagonal)),
best AS (SELECT d, b, max(m) AS m FROM counted WHERE m >= CASE WHEN n >= 13 THEN 11 ELSE n END GROUP BY d, b)
SELECT doc_id, item_id, CAST(max(m) AS INTEGER) AS matched FROM best JOIN d USING (d) JOIN b USING (b) GROUP BY doc_id, item_id
"""


@query
def op7_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode(table(spark, folder, "documents"), k=2, checksum=True)


#: Documents as files: a path of source and number blocks; every tenth is the license file of a directory.
_PATH = """concat(coalesce(source, 'unknown'), CASE
  WHEN doc_id % 1000 = 0 THEN '/LICENSE'
  WHEN doc_id % 100 = 0 THEN concat('/k', cast({thousand} AS {text}), '/LICENSE')
  WHEN doc_id % 10 = 0 THEN concat('/k', cast({thousand} AS {text}), '/h', cast({hundred} AS {text}), '/LICENSE')
  ELSE concat('/k', cast({thousand} AS {text}), '/h', cast({hundred} AS {text}), '/', cast(doc_id AS {text}), '.txt') END)"""


@query
def op4_licenses(spark: SparkSession, folder: str) -> DataFrame:
    path = _PATH.format(thousand="doc_id div 1000", hundred="doc_id div 100", text="string")
    found = licenses.scan(table(spark, folder, "documents").withColumn("path", F.expr(path)), "doc_id")
    return found.withColumn("similarity", F.round("similarity", 6)).withColumnRenamed("id", "doc_id")


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = "[w FOR w IN regexp_split_to_array(" + _LOWER + ", '[^a-z0-9]+') IF w <> '']"
_NOTICES = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(licenses.TEMPLATES))
ORACLES["op4_licenses"] = f"""
WITH t AS (SELECT col0 AS t, col1 AS name, {_TERMS.format("col2")} AS terms FROM (VALUES {_NOTICES})),
tt AS (SELECT t, w, count(*) AS n FROM (SELECT t, unnest(terms) AS w FROM t) GROUP BY t, w),
f AS (SELECT row_number() OVER () AS f, doc_id, {_PATH.format(thousand="doc_id // 1000", hundred="doc_id // 100", text="varchar")} AS path, text FROM documents),
total AS (SELECT count(*) AS total FROM f),
lines AS (SELECT f, row_number() OVER () AS l, line FROM (SELECT f, unnest(string_split(text, chr(10))) AS line FROM f)),
lt AS (SELECT f, l, w, count(*) AS n FROM (SELECT f, l, unnest({_TERMS.format("line")}) AS w FROM lines) GROUP BY f, l, w),
df AS (SELECT w, count(DISTINCT f) AS df FROM lt WHERE w IN (SELECT w FROM tt) GROUP BY w),
weights AS (SELECT w, CAST(floor(1000 * (1 + ln((total + 1) / (coalesce(df, 0) + 1)))) AS BIGINT) AS weight
            FROM (SELECT DISTINCT w FROM tt) LEFT JOIN df USING (w), total),
other AS (SELECT CAST(floor(1000 * (1 + ln(total + 1))) AS BIGINT) AS weight FROM total),
tv AS (SELECT t, w, n * weight AS x FROM tt JOIN weights USING (w)),
tn AS (SELECT t, CAST(sum(x * x) AS DOUBLE) AS norm FROM tv GROUP BY t),
lv AS (SELECT f, l, w, n * coalesce(weights.weight, other.weight) AS x FROM lt LEFT JOIN weights USING (w), other),
ln AS (SELECT f, l, CAST(sum(x * x) AS DOUBLE) AS norm FROM lv GROUP BY f, l),
dots AS (SELECT f, l, t, CAST(sum(lv.x * tv.x) AS DOUBLE) AS dot FROM lv JOIN tv USING (w) GROUP BY f, l, t),
sims AS (SELECT f, t, max(dot / sqrt(ln.norm * tn.norm)) AS s FROM dots JOIN ln USING (f, l) JOIN tn USING (t) GROUP BY f, t),
own AS (SELECT f, name AS own, s FROM sims JOIN t USING (t) WHERE s >= {licenses.THRESHOLD}
        QUALIFY row_number() OVER (PARTITION BY f ORDER BY s DESC, t) = 1),
files AS (SELECT f, doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir, own, s FROM f LEFT JOIN own USING (f)),
grants AS (SELECT dir AS granted_by, own AS given, s AS given_s FROM files WHERE own IS NOT NULL AND path LIKE '%/LICENSE'
           QUALIFY row_number() OVER (PARTITION BY dir ORDER BY s DESC, own) = 1),
nearest AS (SELECT d.dir, granted_by, given, given_s FROM (SELECT DISTINCT dir FROM files WHERE own IS NULL) d JOIN grants
            ON d.dir = granted_by OR starts_with(d.dir, granted_by || '/')
            QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY length(granted_by) DESC) = 1)
SELECT doc_id, path, coalesce(own, given) AS license, round(CASE WHEN own IS NULL THEN given_s ELSE s END, 6) AS similarity,
  CASE WHEN own IS NOT NULL THEN 'own' WHEN given IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN own IS NULL THEN granted_by END AS granted_by
FROM files LEFT JOIN nearest USING (dir)
"""


@query
def op12_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filteraudit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


#: Walks all 120 orders one by one over the counts of failure masks.
ORACLES["op12_audit"] = """
WITH known AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, [x FOR x IN regexp_split_to_array(text, '[\x20\x09-\x0D]+') IF x <> ''] AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CAST(len(words) < 100 AS INTEGER) + 2 * CAST(100 * len(list_distinct(words)) < 80 * len(words) AS INTEGER)
    + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS INTEGER)
    + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER) + 16 * CAST(coalesce(doc_id > first, false) AS INTEGER) AS fails
  FROM w LEFT JOIN known USING (doc_id)),
m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS filter, CAST(1 << (ascii(filter_order[step]) - 65) AS INTEGER) AS bit,
    CAST(coalesce(list_sum([1 << (ascii(x) - 65) FOR x IN string_split(filter_order[:step - 1], '') IF x <> '']), 0) AS INTEGER) AS before
  FROM orders, range(1, 6) t(step)),
walked AS (
  SELECT part, filter_order, step, filter,
    sum(CASE WHEN fails & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN fails & before = 0 AND fails & bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails & before <> 0 AND fails & bit <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails & before = 0 AND fails & bit <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN fails & before = 0 AND fails & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM m, steps GROUP BY part, filter_order, step, filter)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM walked
"""


@query
def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return tokenalign.align_documents(table(spark, folder, "documents"))


@query
def op13_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return tokengroups.join_components(table(spark, folder, "documents"), size=3, percent=90)
