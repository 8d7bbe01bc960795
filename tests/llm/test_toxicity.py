import zlib

import numpy as np

from parcelflow.llm import labelmodel, toxicity

WORDS = "the of and river stone light over under many small trees walk quiet morning garden paper".split()
BAD = "grolak grolup zintar zintol".split()


def make(n, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = list(rng.choice(WORDS, int(rng.integers(10, 80))))
        toxic = int(rng.random() < 0.2)
        for w in rng.choice([*BAD, "idiot"], 2) if toxic else []:
            words[int(rng.integers(len(words)))] = w
        rows.append((i, " ".join(words), toxic))
    return rows


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(2)
    n = 6000
    truth = rng.random(n) < 0.3
    hit, false = [0.8, 0.6, 0.7, 0.5, 0.65], [0.05, 0.1, 0.02, 0.15, 0.08]
    votes = np.stack([np.where(truth, rng.random(n) < h, rng.random(n) < f) for h, f in zip(hit, false)], 1).astype(float)
    copied = np.where(rng.random(n) < 0.9, votes[:, 1], rng.random(n) < 0.3)
    votes = np.column_stack([votes, copied])
    model = labelmodel.fit(votes, np.where(votes[:, 0] > 0, 0.9, 0.1))
    assert np.abs(model.accuracies(votes)[0, :5] - hit).max() < 0.08
    assert np.abs(1 - model.accuracies(votes)[1, :5] - false).max() < 0.05
    assert abs(model.prior - 0.3) < 0.05
    assert model.parents[5] == 1 or model.parents[1] == 5
    assert model.correlations.argmax() in (1 * 6 + 5, 5 * 6 + 1)
    best = ((model.posterior(votes) >= 0.5) == truth).mean()
    blind = labelmodel.LabelModel(model.prior, [-1] * 6, labelmodel._rates(votes, model.posterior(votes), [-1] * 6), model.correlations)
    assert best >= ((blind.posterior(votes) >= 0.5) == truth).mean() - 1e-3


def test_posterior_equals_bayes():
    votes = np.array([[0, 0, 1], [1, 1, 0], [1, 0, 1.0]])
    rates = np.random.default_rng(3).uniform(0.1, 0.9, (2, 3, 2))
    parents = [-1, 0, 1]
    got = labelmodel.LabelModel(0.3, parents, rates, np.zeros((3, 3))).posterior(votes)
    for v, q in zip(votes.astype(int), got):
        p = []
        for c in (0, 1):
            r = [rates[c, j, 0 if parents[j] < 0 else v[parents[j]]] for j in range(3)]
            p.append((0.7, 0.3)[c] * np.prod([x if y else 1 - x for x, y in zip(r, v)]))
        assert abs(q - p[1] / sum(p)) < 1e-9


def test_held_out_rows(spark):
    rows = make(1500)
    docs = spark.createDataFrame([(t, i, "en", 1.0) for i, t, _ in rows], "text string, doc_id long, lang string, score double")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i in got if got[i].held_out} == set(held)
    truth = {i: y for i, _, y in rows}
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.97 * len(held)
    # labels of held-out rows change nothing
    turned = spark.createDataFrame([(i, 1, 1 - y if i in set(held) else y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    again = {r.doc_id: r for r in toxicity.score_documents(docs, turned).collect()}
    assert again == got
    model = toxicity.fit(docs, labels.where(~toxicity.is_held_out()))
    weight_of = toxicity._Weights(model.weights)
    for i, t, _ in rows[:40]:
        by_hand = model.intercept + sum(model.weights[p] for w in set(t.split()) for p in toxicity.places(w))
        assert abs(1 / (1 + np.exp(-by_hand)) - got[i].score) < 1e-9
        assert abs(toxicity.score_texts([t], weight_of, model.intercept)[0] - got[i].score) < 1e-12


def test_odd_rows(spark):
    rows = make(300) + [(9000, None, None), (9001, "", None), (None, "idiot", None), (9002, "river " * 100_000 + "idiot grolak", 1), (9003, "123 \n", 0)]
    docs = spark.createDataFrame([(t, i) for i, t, _ in rows] + [rows[0][1::-1]], "text string, doc_id long")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, 1), (10**9, 1)], "doc_id long, toxic int")
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == len(rows) + 1 and all(0 <= r.score <= 1 for r in got)
    scores = {r.doc_id: r.score for r in got}
    assert scores[9000] == scores[9001] == scores[9003] and scores[9002] >= 0.5
    assert {r.score for r in toxicity.score_documents(docs, labels.where("false")).collect()} == {0.5}
    assert toxicity.score_documents(docs.where("false"), labels).count() == 0


def test_a_repeated_id_counts_once(spark):
    rows = make(200)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    docs = [(i, t) for i, t, _ in rows]
    fitted = [toxicity.fit(spark.createDataFrame(d, "doc_id long, text string"), labels) for d in (docs, docs + [docs[3]] * 500)]
    assert np.array_equal(fitted[0].weights, fitted[1].weights) and fitted[0].intercept == fitted[1].intercept
