"""Audit of how text filters overlap, for every order in which they could run.

A document's failures are a mask, one bit a filter. The filters already applied are a state of the subset
lattice; applying one more is an edge. What an edge removes depends on its state only, not on the order that
led there, so each edge's counts are added up once, from the counts of the masks. Forward-backward counting gives
the number of orders that reach a state (``forward``) and that lead from it to the end (``backward``); an edge
lies on ``forward * backward`` orders, which weighs its removals in the Shapley total. One order's steps are five
of the same edges.

Documents are reduced to (part, mask) counts before anything else is shuffled by part, so a hot part is a few
rows a task. "Repeats an earlier text" compares by SHA-256 with the smallest id of each text, joined on text
and id, so a text that a third of all rows hold is no hot key.

Defined results: a null text counts as empty; a null part is the empty string; a row with a null id repeats
nothing and is repeated by nothing; rows that repeat the smallest id of their text do not fail; an id's
labels are "any row says 1"; parts without rows do not appear, so an empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

SPACES = r"[\x20\x09-\x0D]+"
FILTERS = "ABCDE"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def text_failures(text: Column) -> list[Column]:
    """Failures of A (few words), B (repeated words), C (capitals) and D (symbols) of a text that is not null."""
    words = F.array_remove(F.split(text, SPACES), "")
    return [F.size(words) < 100,
            100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
            100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 10 * F.length(text),
            text.rlike("[#$%&*|]")]


def document_masks(docs: DataFrame, labels: DataFrame, part: str = "lang", id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, part, mask (bit i: fails the i-th of ``FILTERS``), good, toxic."""
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                         F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    own = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(text_failures(F.col("text")))), F.lit(0))
    rows = source.select("doc_id", "part", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), own.alias("own"))
    first = source.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    first = first.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = rows.join(first, ["digest", "doc_id"], "left").join(known, "doc_id", "left")
    repeats = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    said = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("long").alias(c)
    return rows.select("doc_id", "part", (F.col("own") + F.when(repeats, 16).otherwise(0)).alias("mask"), said("good"), said("toxic"))


def mask_counts(rows: DataFrame) -> DataFrame:
    """(part, mask) → n, good, toxic."""
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def lattice(filters: str = FILTERS) -> list[tuple[int, str, int, int]]:
    """All edges (state, filter, forward, backward): orders that reach the state, orders from the next state to the end."""
    whole = (1 << len(filters)) - 1
    forward, backward = [0] * (whole + 1), [0] * (whole + 1)
    forward[0] = backward[whole] = 1
    nexts = lambda s: [(i, s | 1 << i) for i in range(len(filters)) if not s >> i & 1]
    for state in range(whole + 1):  # a subset's number is below those of its supersets
        for _, after in nexts(state):
            forward[after] += forward[state]
    for state in range(whole, -1, -1):
        for _, after in nexts(state):
            backward[state] += backward[after]
    return [(s, filters[i], forward[s], backward[after]) for s in range(whole + 1) for i, after in nexts(s)]


def edge_counts(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, state, filter) → ``COUNTS`` and weight, zeros included; ``masks`` as ``mask_counts`` gives them.

    The lattice is a constant of ``len(filters) * 2 ** (len(filters) - 1)`` edges; every mask row meets each of them once.
    """
    edges = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(f).alias("filter"), F.lit(1 << filters.index(f)).alias("bit"),
                               F.lit(forward * backward).cast("long").alias("weight")) for s, f, forward, backward in lattice(filters)])
    met = masks.select("*", F.explode(edges).alias("e")).select("part", "mask", "n", "good", "toxic", "e.*")
    reaches = F.col("mask").bitwiseAND(F.col("state")) == 0
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    of = lambda when, what, name: F.sum(F.when(when, F.col(what)).otherwise(0)).alias(name)
    return met.groupBy("part", "state", "filter", "weight").agg(
        of(reaches & ~fails, "n", "kept"), of(reaches & fails, "n", "removed"), of(~reaches & fails, "n", "redundant"),
        of(F.col("mask") == F.col("bit"), "n", "unique_fails"), of(reaches & fails, "good", "good_lost"), of(reaches & fails, "toxic", "toxic_lost"))


def shapley(edges: DataFrame) -> DataFrame:
    """(part, filter) → the filter's removals summed over all orders; divided by their number, its Shapley value."""
    return edges.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("weight")).alias("shapley"))


def order_steps(edges: DataFrame, filters: str = FILTERS, orders: list[str] | None = None) -> DataFrame:
    """One row per part, order and step, read from the edges; ``orders`` is all of them unless named."""
    steps = []
    for order in orders or ["".join(p) for p in permutations(filters)]:
        state = 0
        for i, f in enumerate(order):
            steps.append((order, i + 1, state, f))
            state |= 1 << filters.index(f)
    table = edges.sparkSession.createDataFrame(steps, "filter_order string, step int, state int, filter string")
    counts = [F.col(c).cast("long") for c in COUNTS]
    return edges.join(shapley(edges), ["part", "filter"]).join(table, ["state", "filter"]).select("part", "filter_order", "step", *counts, F.col("shapley").cast("long"))


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """part, filter_order, step, ``COUNTS``, shapley for all orders of the five filters over all documents."""
    return order_steps(edge_counts(mask_counts(document_masks(docs, labels, part, id_column, text))))
