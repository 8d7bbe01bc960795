import numpy as np
import pytest

from parcelflow.llm import quality
from parcelflow.llm.linear import Sparse, sigmoid

WORDS = "the of and river stone light over under many small trees walk quiet morning garden paper".split()


def make(n, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = list(rng.choice(WORDS, int(rng.integers(20, 120))))
        grade = int(rng.choice([0, 1, 2], p=[0.2, 0.15, 0.65]))
        if grade == 0:
            words = [w.upper() + "!!" for w in words] if i % 2 else [words[0]] * len(words)
        elif grade == 1:
            words[::6] = ["nasty"] * len(words[::6])
        rows.append((i, " ".join(words), grade))
    return rows


def test_ordinal_fit_reaches_the_optimum():
    rng = np.random.default_rng(3)
    rows = [(np.sort(rng.choice(12, 4, replace=False)), rng.normal(0, 1, 4)) for _ in range(300)]
    x, true = Sparse(rows, 12), rng.normal(0, 1, 12)
    latent = x.dot(true) + rng.logistic(0, 1, 300)
    grades = np.digitize(latent, [-1.0, 0.5, 2.0])
    model = quality.fit_ordinal(x, grades, 4, l2=1e-3, rounds=3000)
    assert (np.diff(model.thresholds) > 0).all()

    def loss(w, t):
        c = np.hstack([np.zeros((300, 1)), sigmoid(t[None] - x.dot(w)[:, None]), np.ones((300, 1))])
        return -np.log(c[np.arange(300), grades + 1] - c[np.arange(300), grades]).mean() + 0.5e-3 * w @ w

    best = loss(model.weights, model.thresholds)
    for j in range(12):
        for d in (-1e-2, 1e-2):
            assert loss(model.weights + d * np.eye(12)[j], model.thresholds) > best - 1e-6
    for j in range(3):
        for d in (-1e-2, 1e-2):
            assert loss(model.weights, model.thresholds + d * np.eye(3)[j]) > best - 1e-6


def test_grades_held_out_and_by_hand(spark):
    rows = make(900)
    docs = spark.createDataFrame([(i, t, "k", 0.5) for i, t, _ in rows], "doc_id long, text string, grade string, p_ge_1 double")
    ratings = spark.createDataFrame([(i, g) for i, _, g in rows[:600]] + [(None, 1), (3, None), (4, 9), (10**9, 2)], "doc_id long, grade int")
    model = quality.fit(docs, ratings)
    got = {r.doc_id: r for r in quality.grade_documents(docs, ratings).collect()}
    right = sum(got[i].keep == (g > 0) for i, _, g in rows[600:])
    assert right >= 295
    high = sum((got[i].p_ge_2 >= 0.5) == (g == 2) for i, _, g in rows[600:])
    assert high >= 270
    places = quality._Places()
    for i, t, _ in rows[:50]:
        tails = model.at_least(Sparse([quality.features(t, places)], quality.WIDTH))[0]
        assert got[i].p_ge_1 == pytest.approx(tails[0], abs=1e-6) and got[i].expected_grade == pytest.approx(tails.sum(), abs=1e-6)
        assert got[i].p_ge_1 >= got[i].p_ge_2


def test_odd_rows(spark):
    odd = [(5000, None), (5001, ""), (None, "the of and"), (5002, "river stone " * 50_000), (5002, "river stone " * 50_000), (5003, "  \t")]
    rows = [(i, t) for i, t, _ in make(200)] + odd
    docs = spark.createDataFrame([(t, i, "k") for i, t in rows], "text string, doc_id long, grade string")
    ratings = spark.createDataFrame([(i, g) for i, _, g in make(200)], "doc_id long, grade int")
    got = quality.grade_documents(docs, ratings).collect()
    assert len(got) == len(rows)
    twice = [r for r in got if r.doc_id == 5002]
    assert len(twice) == 2 and twice[0] == twice[1]
    kept = quality.select_documents(docs, ratings)
    assert kept.columns == docs.columns and kept.count() == sum(r.keep for r in got)
    none = quality.grade_documents(docs, ratings.where("false")).collect()
    assert len({round(r.p_ge_1, 9) for r in none}) == 1 and abs(none[0].p_ge_1 - 2 / 3) < 1e-6
    assert quality.grade_documents(docs.where("false"), ratings).count() == 0


def test_repetition_and_length_features():
    columns, values = quality.features("a a a b", quality._Places())
    assert values[list(columns).index(quality.REPEATED)] == pytest.approx(np.sqrt(2 / 4))
    assert quality.features(None, quality._Places())[0].tolist() == [quality.FIRST_LENGTH]


def test_a_repeated_id_counts_once(spark):
    rows = [(i, t) for i, t, _ in make(60)]
    ratings = spark.createDataFrame([(i, g) for i, _, g in make(60)] * 2, "doc_id long, grade int")
    fitted = [quality.fit(spark.createDataFrame(d, "doc_id long, text string"), ratings) for d in (rows, rows + [rows[3]] * 500)]
    assert np.array_equal(fitted[0].weights, fitted[1].weights)
