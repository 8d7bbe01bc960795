"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text is shared by all grades: P(grade <= k) = sigmoid(threshold_k - w.x) with
rising thresholds. Features are square roots of shares of a text's words: hashed words, hashed shapes (case
pattern and closing punctuation), repetition of the word before, and the text's length class.

Defined results: a null or empty text has the intercept-like length class only and gets a score like any
other; repeated rows score equally; a rating that is null or outside 0 .. grades - 1 or whose document is
missing is not used; several ratings of a document are several observations; without any rating all
grades are equally likely. No documents give no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from parcelflow.llm.arrow import free_name, with_arrow_columns
from parcelflow.llm.linear import Sparse, sigmoid

WORDS, SHAPES = 1 << 12, 1 << 10
REPEATED, FIRST_LENGTH = WORDS + SHAPES, WORDS + SHAPES + 1
WIDTH = FIRST_LENGTH + 24
#: Most ratings that a model is fitted on (the first by hash).
SAMPLE = 6000
MOST_CACHED = 100_000
_DIGITS = str.maketrans("0123456789", "0" * 10)


def _shape(word: str) -> str:
    core = word.rstrip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    tail = word[len(core):][-4:]
    if not core:
        return f"-{tail}"
    case = "A" if core.isupper() and len(core) > 1 else "a" if core.islower() else "Aa" if core.istitle() else "0" if core.isdigit() else "x"
    return f"{case}{min(len(core), 12) if case == 'A' else ''}{tail}"


class _Places(dict):
    """Word → (its hashed word feature, its hashed shape feature), remembered for words seen before."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) >= MOST_CACHED:
            self.clear()
        plain = word.lower().translate(_DIGITS).encode("utf-8", "surrogatepass")
        shape = _shape(word).encode("utf-8", "surrogatepass")
        found = self[word] = (zlib.crc32(plain) % WORDS, WORDS + zlib.crc32(shape) % SHAPES)
        return found


def features(text: str | None, places: _Places) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of a whole text."""
    words = (text or "").split()
    length = FIRST_LENGTH + min(23, len(words).bit_length())
    if not words:
        return np.array([length]), np.array([1.0])
    counts = Counter(words)
    at = np.array([places[w] for w in counts])
    times = np.fromiter(counts.values(), np.float64, len(counts))
    total = np.bincount(at[:, 0], times, WIDTH) + np.bincount(at[:, 1], times, WIDTH)
    total[REPEATED] = sum(map(str.__eq__, words, words[1:]))
    columns = np.flatnonzero(total)
    return np.append(columns, length), np.append(np.sqrt(total[columns] / len(words)), 1.0)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, x: Sparse) -> np.ndarray:
        """P(grade >= k) for k = 1 .. grades - 1, one row per text."""
        return sigmoid(x.dot(self.weights)[:, None] - self.thresholds[None, :])


def fit_ordinal(x: Sparse, grades: np.ndarray, levels: int, l2: float = 1e-4, rounds: int = 300, rate: float = 0.05) -> Model:
    """Maximum likelihood of the cumulative-link model, by Adam steps on weights and log-gaps of the thresholds.

    The thresholds start at the logits of the cumulated shares, so without text evidence the model gives
    the shares of the grades.
    """
    counts = np.bincount(grades, minlength=levels) + 1.0
    below = np.clip(np.cumsum(counts)[:-1] / counts.sum(), 1e-6, 1 - 1e-6)
    start = np.log(below / (1 - below))
    params = np.concatenate([np.zeros(x.width), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    first, second = np.zeros_like(params), np.zeros_like(params)
    thresholds_of = lambda p: np.cumsum(np.concatenate([p[x.width:x.width + 1], np.exp(p[x.width + 1:])]))
    n = max(1, x.count)
    for turn in range(1, rounds + 1 if x.count else 1):
        w, theta = params[:x.width], thresholds_of(params)
        cumulative = sigmoid(theta[None, :] - x.dot(w)[:, None])
        padded = np.hstack([np.zeros((x.count, 1)), cumulative, np.ones((x.count, 1))])
        rows = np.arange(x.count)
        hi, lo = padded[rows, grades + 1], padded[rows, grades]
        chance = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / chance, lo * (1 - lo) / chance
        gradient = np.zeros_like(params)
        gradient[:x.width] = x.transposed_dot((d_hi - d_lo) / n) + l2 * w
        by_theta = np.bincount(grades, d_lo, levels)[1:] - np.bincount(grades, d_hi, levels)[:-1]
        by_theta = by_theta / n
        tail = np.cumsum(by_theta[::-1])[::-1]
        gradient[x.width] = tail[0]
        gradient[x.width + 1:] = tail[1:] * np.exp(params[x.width + 1:])
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient ** 2
        step = rate if turn < 0.7 * rounds else rate * 0.2
        params -= step * (first / (1 - 0.9 ** turn)) / (np.sqrt(second / (1 - 0.999 ** turn)) + 1e-9)
    return Model(params[:x.width], thresholds_of(params))


def fit(docs: DataFrame, ratings: DataFrame, levels: int = 3, id_column: str = "doc_id", text: str = "text",
        sample: int = SAMPLE) -> Model:
    """A model from ratings (id_column, grade): features are made where the texts are, at most ``sample`` come back.

    An id that stands in several rows gives its least text.
    """
    rated = ratings.select(F.col(id_column).alias("_id"), F.col("grade").cast("int").alias("_grade"))
    rated = rated.where(F.col("_id").isNotNull() & F.col("_grade").between(0, levels - 1))
    rated = rated.orderBy(F.xxhash64("_id"), "_id", "_grade").limit(sample)
    texts = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text")).join(rated.distinct(), "_id")
    texts = texts.groupBy("_id", "_grade").agg(F.min("_text").alias("_text")).drop("_id")

    def make():
        places = _Places()

        def work(values):
            found = [features(v, places) for v in values]
            return [pa.array([c.astype(np.int32) for c, _ in found], pa.list_(pa.int32())),
                    pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32()))]

        return work

    added = [("columns", T.ArrayType(T.IntegerType())), ("values", T.ArrayType(T.FloatType()))]
    back = with_arrow_columns(texts, "_text", added, make, keep=["_grade"]).toArrow()
    rows = [(np.asarray(c, np.int64), np.asarray(v, np.float64)) for c, v in
            zip((x.values.to_numpy() for x in back.column("columns")), (x.values.to_numpy() for x in back.column("values")))]
    grades = np.array(back.column("_grade").to_pylist(), np.int64)
    order = sorted(range(len(rows)), key=lambda i: (int(grades[i]), rows[i][0].tobytes(), rows[i][1].tobytes()))
    return fit_ordinal(Sparse([rows[i] for i in order], WIDTH), grades[order].astype(np.int64), levels)


def with_grades(docs: DataFrame, model: Model, text: str = "text", names: list[str] | None = None,
                keep: list[str] | None = None) -> DataFrame:
    """Adds P(grade >= 1), P(grade >= 2), ... as double columns ``names``; one pass over whole texts, no shuffle."""
    levels = len(model.thresholds)
    names = names or [free_name(docs, f"p_ge_{k}") for k in range(1, levels + 1)]

    def make():
        places = _Places()

        def work(values):
            tails = model.at_least(Sparse([features(v, places) for v in values], WIDTH))
            return [pa.array(tails[:, k]) for k in range(levels)]

        return work

    return with_arrow_columns(docs, text, [(n, T.DoubleType()) for n in names], make, keep)


def label_grades(labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Graded ratings from the label table: 0 bad, 1 good but toxic, 2 good."""
    grade = F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when(F.col("quality") == 1, 2)
    return labels.select(id_column, grade.alias("grade"))


def grade_documents(docs: DataFrame, ratings: DataFrame, levels: int = 3, least: int = 1, chance: float = 0.5,
                    id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, expected_grade, p_ge_1 .., keep: selected where P(grade >= ``least``) is at least ``chance``."""
    model = fit(docs, ratings, levels, id_column, text)
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    tails = [f"p_ge_{k}" for k in range(1, levels)]
    graded = with_grades(narrow, model, "text", tails, keep=["doc_id"])
    expected = sum((F.col(t) for t in tails[1:]), F.col(tails[0]))
    return graded.select("doc_id", expected.alias("expected_grade"), *tails, (F.col(f"p_ge_{least}") >= chance).alias("keep"))


def select_documents(docs: DataFrame, ratings: DataFrame, levels: int = 3, least: int = 1, chance: float = 0.5,
                     id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that ``grade_documents`` keeps."""
    model = fit(docs, ratings, levels, id_column, text)
    names = [free_name(docs, f"_tail{k}") for k in range(1, levels)]
    graded = with_grades(docs, model, text, names)
    return graded.where(F.col(names[least - 1]) >= chance).select(*[f"`{c}`" for c in docs.columns])
