import re

import numpy as np
import pytest

from parcelflow.llm import tokengroups

SCHEMA = "doc_id long, text string, node long, n int, `group` string, tokens string"


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def expected(docs):
    sets = [plain_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 90 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), d if not s else least.get(find(i))) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=repr)


def run(spark, docs, **limits):
    table = spark.createDataFrame([(d, t, 5, 1, "g", "t") for d, t in docs], SCHEMA).repartition(3)
    rows = tokengroups.join_components(table, **limits).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=repr)


def copies(rng, words, base, count, edits):
    """``count`` texts with up to ``edits`` words of ``base`` changed."""
    for _ in range(count):
        text = list(base)
        for at in rng.integers(0, len(base), rng.integers(0, edits + 1)):
            text[at] = words[rng.integers(0, len(words))]
        yield " ".join(text)


@pytest.mark.parametrize("limits", [{}, {"members": 3, "most": 500, "crowd": 2}])
def test_equals_brute_force(spark, limits):
    rng = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(60)])
    texts = [None, "", " \n\t", "one", "One", "two words", "two  WORDS", "three of them", "a b c d", "a b c d", "é É", "É É"]
    common = " ".join(rng.choice(words, 40))  # a passage that many texts share
    for length in (4, 12, 20, 21, 40, 120, 300):
        base = rng.choice(words, length)
        texts += copies(rng, words, base, 14, max(1, length // 50))
    for _ in range(40):
        texts.append(common + " " + " ".join(rng.choice(words, rng.integers(1, 60))))
    drift = list(rng.choice(words, 200))  # a chain: neighbours are similar, its ends are not
    for i in range(0, 60, 3):
        drift[i] = f"new{i}"
        texts.append(" ".join(drift))
    texts.append("x y z " * 9000 + common)
    docs = [(int(i), t) for i, t in zip(rng.permutation(len(texts)) + 100, texts)]
    docs += [docs[3], docs[8], (None, texts[20]), (None, "only without id"), (7, texts[60]), (7, "another text of the same id")]
    assert run(spark, docs, **limits) == expected(docs)


def test_crowded_group_is_dealt_out(spark):
    """Many near copies, none of them linked to the smallest of all, and queries beyond one task's share."""
    rng = np.random.default_rng(6)
    words = np.array([f"v{i}" for i in range(4000)])
    base = rng.choice(words, 80)
    docs = [(i, t) for i, t in enumerate(copies(rng, words, base, 150, 5))]
    sets = spark.createDataFrame([(i, tokengroups.Shingles(3).of(t).view(np.int64).tolist()) for i, t in docs], "node long, tokens array<long>")
    members = spark.createDataFrame([(0 if i < 40 else 1, i, i % 2) for i, _ in docs[:80]], "`group` long, node long, comp long")
    queries = spark.createDataFrame([(g, i) for i, _ in docs for g in (0, 1)], "`group` long, node long")
    found = tokengroups.opened(tokengroups.matrix(members, sets), queries, sets, 90, spread=16).collect()
    plain = [plain_set(t) for _, t in docs]
    similar = lambda i, j: i != j and 100 * len(plain[i] & plain[j]) >= 90 * len(plain[i] | plain[j])
    want = {(i, g, c) for i, _ in docs for g in (0, 1) for c in (0, 1) if any(similar(i, j) for j in range(40 * g + c, 40 * g + 40, 2))}
    assert {(r.u, int(r.v >= 40), r.v % 2) for r in found} == want and all(similar(r.u, r.v) for r in found)
    assert run(spark, docs) == expected(docs)


def test_threshold_is_exact(spark):
    """19 of 21 shingles is above 90 %, 18 of 20 is 90 %, 17 of 19 is below."""
    base = [f"b{i}" for i in range(40)]
    for whole, shared, linked in ((20, 18, True), (19, 17, False), (21, 19, True), (10, 9, True), (9, 8, False)):
        a, b = base[:whole + 2], base[:shared + 2]
        docs = [(1, " ".join(a)), (2, " ".join(b))]
        assert run(spark, docs) == expected(docs) == [(1, whole, 1), (2, shared, 1 if linked else 2)]


def test_empty_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(4, None), (4, "")]) == [(4, 0, 4), (4, 0, 4)]


def test_texts_of_other_nodes_are_not_shuffled(spark):
    docs = spark.range(2000).selectExpr("xxhash64(id, 1) AS k0", "xxhash64(id, 2) AS k1", "concat('a b c d', id) AS text", "id AS node")
    wanted = docs.where("node % 500 = 0").select("node", "k0", "k1")
    assert 4 <= tokengroups.sifted(docs.drop("node"), wanted).count() < 8
    got = tokengroups.token_sets(docs.drop("node"), wanted, 3).collect()
    assert sorted(r.node for r in got) == [0, 500, 1000, 1500] and all(len(r.tokens) == 2 for r in got)
    assert tokengroups.sifted(docs.drop("node"), wanted.where("false")).count() == 0
