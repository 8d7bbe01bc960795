from itertools import combinations

import numpy as np

from parcelflow.llm import decontaminate as D


def test_masks_are_lossless():
    masks = [m for i, m in enumerate(D.MASKS) if i != D.SHORT]
    for n in range(D.WINDOW - D.NEEDED + 1):
        for wrong in combinations(range(D.WINDOW), n):
            assert any(not set(wrong) & {at + o for o in m} for m in masks for at in range(D.WINDOW - m[-1]))


def words(text):
    out, word = [], ""
    for c in (text or "").lower() + " ":
        if c.isalnum():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def plain(docs, items):
    found = {}
    for d, text in docs:
        a = words(text)
        for i, item in items:
            b = words(item)
            if len(b) < 5:
                continue
            n = min(13, len(b))
            best = 0
            for x in range(len(a)):
                for y in range(len(b) - n + 1):
                    if x + n <= len(a):
                        best = max(best, sum(p == q for p, q in zip(a[x:x + n], b[y:y + n])))
            if best >= (11 if n == 13 else n):
                found[d, i] = max(best, found.get((d, i), 0))
    return found


def make():
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "of", "été", "Straße"] * 20
    text = lambda n: list(rng.choice(vocabulary, n))
    items = [(i, text(int(rng.integers(4, 40)))) for i in range(25)]
    docs = []
    for i in range(120):
        body = text(int(rng.integers(0, 120)))
        if i % 2:
            passage = list(items[i % 25][1])
            for _ in range(i % 5):
                passage[int(rng.integers(len(passage)))] = "other"
            cut = int(rng.integers(0, max(1, len(passage) - 12))) if i % 3 else 0
            at = int(rng.integers(0, len(body) + 1))
            body[at:at] = passage[cut:]
        docs.append((i, (", " if i % 7 else "! ").join(body).upper() if i % 4 == 1 else " ".join(body)))
    items = [(i, " ".join(w).title()) for i, w in items] + [(90, None), (91, ""), (92, "one two three four"), (93, docs[3][1]), (93, docs[5][1]), (None, docs[7][1])]
    docs += [(200, None), (201, ""), (202, "...!"), (None, docs[7][1]), (5, docs[9][1]), (5, docs[9][1]), (203, "w1 " * 30_000 + docs[3][1])]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = make()
    df = spark.createDataFrame([(t, d, "k", 1) for d, t in docs], "text string, doc_id long, key string, seed int")
    bench = spark.createDataFrame([(t, i, "x") for i, t in items], "text string, item_id long, h string")
    got = {(r.doc_id, r.item_id): r.matched for r in D.contaminated(df, bench).collect()}
    short = [(d, t) for d, t in docs if d != 203]
    want = plain(short, items) | {(203, i): m for (d, i), m in plain([(203, docs[-1][1][-900:])], items).items()}
    assert len(want) > 40 and got == want
    clean = D.clean_documents(df, bench)
    assert clean.columns == df.columns
    bad = {d for d, t in docs if any((d2, i) in want for d2, i in want if d2 == d)}
    texts = {t for d, t in docs if plain([(d, t[-900:] if t else t)], items)}
    assert sorted(map(str, (r.doc_id for r in clean.collect()))) == sorted(str(d) for d, t in docs if t not in texts)
    assert bad


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert D.contaminated(df, bench.where("false")).count() == 0 and D.contaminated(df.where("false"), bench).count() == 0
    assert D.clean_documents(df, bench.where("false")).count() == 1 and D.clean_documents(df, bench).count() == 0
