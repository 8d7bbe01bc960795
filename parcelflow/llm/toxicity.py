"""Toxicity by weak supervision.

Many voters look at a text: short hand-written lexicons, lexicons of words and of word beginnings mined from
labelled rows (dealt into several voters each), and patterns. A generative label model estimates the voters'
accuracies and correlations from their agreement; its posteriors are the targets of a linear classifier over
hashed words and word beginnings, which scores every whole text.

Defined results: a null or empty text has no features and gets the classifier's base rate; repeated rows score
equally; labels that are null, or without a document, are not used; without usable labels the hand-written
lexicons and patterns vote alone, and without any labelled rows every score is 0.5. No documents give no rows.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from parcelflow.llm import labelmodel
from parcelflow.llm.arrow import with_arrow_columns
from parcelflow.llm.linear import Sparse, fit_logistic, sigmoid

WIDTH = 1 << 20
#: Most labelled rows of each label that the voters and the classifier are fitted on (the first by hash).
SAMPLE = {1: 2500, 0: 5000}
MOST_CACHED = 150_000
#: Hand-written lexicons, one voter each.
LEXICONS = (
    ("idiot", "idiots", "moron", "morons", "stupid", "dumb", "imbecile", "fool", "cretin"),
    ("loser", "losers", "worthless", "pathetic", "useless", "failure"),
    ("scum", "trash", "garbage", "vermin", "filth", "disgusting", "vile"),
    ("clown", "clowns", "joke", "laughable", "ridiculous", "freak"),
    ("hate", "kill", "die", "destroy", "shut"),
)
STEMS = (4, 5, 6)
DEALT = 4
_WORD = re.compile(r"[^\W\d_]+")
_SHOUTED = re.compile(r"\b[^\W\d_a-zß-ÿ]{3,}!")


def words_of(text: str | None) -> set[str]:
    """The different words (runs of letters, lower case) of a whole text."""
    return set(_WORD.findall((text or "").lower()))


def _place(kind: int, part: str) -> int:
    return zlib.crc32(bytes([kind]) + part.encode("utf-8", "surrogatepass")) % WIDTH


def places(word: str) -> list[int]:
    """Hashed features of a word: itself and its beginnings."""
    return [_place(0, word), *[_place(n, word[:n]) for n in STEMS if len(word) > n]]


def _fired(text: str | None, words: set[str]) -> list[bool]:
    """Votes of the hand-written lexicons and of the patterns."""
    raw = text or ""
    letters = sum(map(str.isupper, raw))
    return [*[not words.isdisjoint(lexicon) for lexicon in LEXICONS],
            bool(re.search(r"\byou(?:'re| are) (?:such )?an? ", raw, re.I)),
            letters > 20 and letters > 0.6 * sum(map(str.isalpha, raw)) and bool(_SHOUTED.search(raw))]


def copy_weights(rows: list[np.ndarray]) -> np.ndarray:
    """1 / number of rows that share a row's first rare feature: copies of one text count once together."""
    frequency = np.bincount(np.concatenate(rows), minlength=WIDTH)
    rare = frequency <= max(3, 0.01 * len(rows))
    mixed = lambda c: c.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)
    keys = [int(mixed(r[rare[r]]).min()) if rare[r].any() else -1 - i for i, r in enumerate(rows)]
    size: dict[int, int] = {}
    for k in keys:
        size[k] = size.get(k, 0) + 1
    return np.array([1 / size[k] for k in keys])


def mine(rows: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Features that are far more frequent in toxic rows: in three different texts at least, and 20 times as often."""
    count = [np.zeros(WIDTH), np.zeros(WIDTH)]
    for columns, label, w in zip(rows, toxic, weight):
        count[int(label)][columns] += w
    n_clean, n_toxic = (max(1.0, weight[toxic == k].sum()) for k in (0, 1))
    lift = (count[1] / n_toxic) / ((count[0] + 0.5) / n_clean)
    return (count[1] > 2.5) & (lift >= 20)


@dataclass
class Toxicity:
    weights: np.ndarray
    intercept: float
    label_model: labelmodel.LabelModel


def _votes(rows: list[np.ndarray], kinds: list[np.ndarray], fired: np.ndarray, mined: np.ndarray) -> np.ndarray:
    """All voters on all rows: lexicons and patterns, mined words in ``DEALT`` voters, mined beginnings by length."""
    out = np.zeros((len(rows), DEALT + len(STEMS)))
    for i, (columns, kind) in enumerate(zip(rows, kinds)):
        hit = mined[columns]
        for c, k in zip(columns[hit].tolist(), kind[hit].tolist()):
            out[i, c % DEALT if k == 0 else DEALT + STEMS.index(k)] = 1
    return np.hstack([fired.astype(float), out])


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text",
        sample: dict[int, int] | None = None) -> Toxicity:
    """Voters, label model and classifier from labelled rows (id_column, toxic), at most ``sample`` of each label.

    An id that stands in several rows gives its least text.

    Labels serve to mine the voters' lexicons and to weigh the two samples; the classifier's targets are the
    label model's posteriors.
    """
    sample = sample or SAMPLE
    usable = labels.select(F.col(id_column).alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
    usable = usable.where(F.col("_id").isNotNull() & F.col("_toxic").isin(0, 1)).distinct()
    totals = {r._toxic: r["count"] for r in usable.groupBy("_toxic").count().collect()}
    first = lambda label: usable.where(F.col("_toxic") == label).orderBy(F.xxhash64("_id"), "_id").limit(sample[label])
    chosen = first(0).union(first(1))
    texts = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text")).join(chosen, "_id")
    texts = texts.groupBy("_id", "_toxic").agg(F.min("_text").alias("_text")).drop("_id")

    def make():
        def work(values):
            out, kinds, fired = [], [], []
            for v in values:
                words = words_of(v)
                found = {_place(0, w): 0 for w in words} | {_place(n, w[:n]): n for n in STEMS for w in words if len(w) > n}
                out.append(np.fromiter(found, np.int32, len(found)))
                kinds.append(np.fromiter(found.values(), np.int8, len(found)))
                fired.append(_fired(v, words))
            return [pa.array(out, pa.list_(pa.int32())), pa.array(kinds, pa.list_(pa.int8())), pa.array(fired, pa.list_(pa.bool_()))]

        return work

    added = [("columns", T.ArrayType(T.IntegerType())), ("kinds", T.ArrayType(T.ByteType())), ("fired", T.ArrayType(T.BooleanType()))]
    back = with_arrow_columns(texts, "_text", added, make, keep=["_toxic"]).toArrow()
    flat = lambda name: [np.asarray(x.values.to_numpy(zero_copy_only=False)) for x in back.column(name)]
    rows, kinds = flat("columns"), flat("kinds")
    order = [np.argsort(r, kind="stable") for r in rows]
    rows, kinds = [r[o] for r, o in zip(rows, order)], [k[o] for k, o in zip(kinds, order)]
    toxic = np.array(back.column("_toxic").to_pylist(), np.int64)
    fired = np.array(back.column("fired").to_pylist(), bool).reshape(len(rows), len(LEXICONS) + 2)
    steady = sorted(range(len(rows)), key=lambda i: (int(toxic[i]), rows[i].tobytes()))
    rows, kinds, toxic, fired = [rows[i] for i in steady], [kinds[i] for i in steady], toxic[steady], fired[steady]
    return fit_rows(rows, kinds, fired, toxic, totals)


def fit_rows(rows, kinds, fired, toxic, totals: dict[int, int]) -> Toxicity:
    if not len(rows):
        return Toxicity(np.zeros(WIDTH), 0.0, labelmodel.fit(np.zeros((0, 1)), np.zeros(0)))
    once = copy_weights(rows)
    votes = _votes(rows, kinds, fired, mine(rows, toxic, once))
    lexical = np.delete(votes, [len(LEXICONS), len(LEXICONS) + 1], axis=1).sum(1)
    model = labelmodel.fit(votes, np.where(lexical > 0, 0.9, 0.05))
    target = model.posterior(votes)
    # each label's sample stands for all its rows, copies of a text for one
    weight = np.array([totals.get(int(t), 1) / max(1, (toxic == t).sum()) for t in toxic], float) * once
    # only features of at least three rows, and twice as frequent where the posterior is high, can gain a weight
    flat, of = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    mass = np.bincount(flat, weight[of], WIDTH)
    high = np.bincount(flat, (weight * target)[of], WIDTH)
    useful = (np.bincount(flat, minlength=WIDTH) >= 3) & (high >= 2 * mass * (weight * target).sum() / weight.sum())
    x = Sparse([(r[useful[r]].astype(np.int64), np.ones(int(useful[r].sum()))) for r in rows], WIDTH)
    # no word makes a text less toxic: a long text must not outweigh what it says once
    weights, intercept = fit_logistic(x, target, weight, l1=1.0 / len(rows), l2=1e-6, rounds=400, nonnegative=True)
    return Toxicity(weights, intercept, model)


class _Weights(dict):
    """Word → summed weight of its features, remembered for words seen before."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.known = dict(zip((at := np.flatnonzero(weights)).tolist(), weights[at].tolist()))

    def __missing__(self, word: str) -> float:
        if len(self) >= MOST_CACHED:
            self.clear()
        found = self[word] = sum(self.known.get(p, 0.0) for p in places(word))
        return found


def score_texts(texts: list, weight_of: _Weights, intercept: float) -> np.ndarray:
    """Beginnings shared by several words of a text count once for each of these words."""
    total = [sum(map(weight_of.__getitem__, words_of(t))) for t in texts]
    return sigmoid(np.array(total, float) + intercept)


def with_score(docs: DataFrame, model: Toxicity, text: str = "text", name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Adds the score (0 to 1) of every whole text; one pass, no shuffle."""
    known, intercept = np.flatnonzero(model.weights), model.intercept
    values = model.weights[known]

    def make():
        weights = np.zeros(WIDTH)
        weights[known] = values
        weight_of = _Weights(weights)
        return lambda texts: [pa.array(score_texts(texts, weight_of, intercept))]

    return with_arrow_columns(docs, text, [(name, T.DoubleType())], make, keep)


def is_held_out(id_column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted; labels of held-out documents (crc32 of the id mod 5 is 0) are not used."""
    model = fit(docs, labels.where(~is_held_out(id_column)), id_column, text)
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    scored = with_score(narrow, model, "text", keep=["doc_id"])
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
