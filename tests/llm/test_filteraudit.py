import re
from itertools import permutations
from math import factorial

from parcelflow.llm import filteraudit

DOCS = "doc_id long, text string, lang string, mask int, state string, n int, part string"
LABELS = "doc_id long, quality int, toxic int"


def walk(docs, labels):
    """Applies all orders to all documents, one by one."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
                 "D": bool(re.search(r"[#$%&*|]", text)),
                 "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)}
        rows.append((lang or "", fails, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                failing = [r for r in rows if r[0] == part and r[1][f]]
                shapley[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(sum(r[1].values()) == 1 for r in failing),
                                          sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(shapley[order[step - 1]])
    return out


def run(spark, docs, labels):
    table = spark.createDataFrame([(*d, 7, "x", 3, "clash") for d in docs], DOCS)
    found = filteraudit.audit(table, spark.createDataFrame(labels, LABELS))
    got = {}
    for r in found.collect():
        key = (r.part, r.filter_order, r.step)
        assert key not in got
        got[key] = [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley]
    return got


def test_equals_a_walk_of_all_orders(spark):
    clean = " ".join(f"w{i}" for i in range(120))
    docs = [(1, clean, "en"), (2, clean, "en"), (2, clean, "en"), (3, clean + " #", "fr"), (4, None, "en"), (5, "", None), (6, "", ""), (None, clean, "en"),
            (None, None, None), (7, "SHOUTING " * 150, "en"), (8, "Word word " * 80, "fr"), (9, "a b \x0b c\x1fd", "de"), (10, clean.upper(), "en"), (1, clean, "fr"),
            (11, "x y\n" * 40000 + "|", "en"), (12, clean.upper() + " $", "en"), (13, "É" * 50 + "ABCDEF", "fr")]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (7, 0, 1), (8, 1, None), (None, 1, 1), (99, 1, 1), (12, 1, 0)]
    assert run(spark, docs, labels) == walk(docs, labels)


def test_empty_table_and_single_part(spark):
    assert run(spark, [], [(1, 1, 1)]) == {}
    got = run(spark, [(1, "a", None)], [])
    assert len(got) == 600 and got["", "BCDEA", 5][:2] == [0, 1] and got["", "ABCDE", 1][-1] == 120


def test_lattice_counts_orders():
    for names in ("A", "AB", "ABCDE"):
        edges = filteraudit.lattice(names)
        assert len(edges) == len(names) * 2 ** (len(names) - 1)
        for f in names:
            assert sum(forward * backward for _, g, forward, backward in edges if g == f) == factorial(len(names))
