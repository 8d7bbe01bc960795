import re

import numpy as np
from hypothesis import given, settings, strategies as st

from parcelflow.llm import pii

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def sound(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == 1:
        return all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in s.split("."))
    if kind == 2:
        turned = [int(d) for d in digits[::-1]]
        return 14 <= len(digits) <= 19 and (sum(turned[::2]) + sum(sum(divmod(2 * d, 10)) for d in turned[1::2])) % 10 == 0
    return kind == 0 or 10 <= len(digits) <= 15


def plain_base(text):
    return sorted((m.start(), m.end(), k) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if sound(k, m.group()))


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a@.-+_ 0125(9)é\n%", max_size=60))
def test_base_equals_patterns(text):
    assert pii.base_spans(text) == plain_base(text)


def test_base_cases():
    for text in ("x 4111 1111-1111 1111 y", "4111111111111112", "+1 (988) 555-2485.", "a@b a@b.c@d.e", "a@b.c.@d.e-f", "1.2.3.4.5.6.7.8 300.1.1.1",
                 "0" * 6000 + ".1.1.1", "9" * 5000, "@" * 50, "a" * 100_000, "a." * 20_000 + "@", "+" * 40, "1 " * 30, "café@münchen.de x@y.zz"):
        assert pii.base_spans(text) == plain_base(text)


def test_long_runs_take_linear_time():
    for text in ("7" * 1_000_000, "1." * 500_000, "a@b.c," * 100_000, "+1 " * 300_000):
        pii.tokens_of(text, pii.base_spans(text))


def test_lists_without_white_space_are_cut():
    text = "ann@x.com,maria.c@y.com;+15551234567|(maria.c@y.com),1.2.3.4/ann@x.com,plain"
    base = pii.base_spans(text)
    tokens = pii.tokens_of(text, base)
    assert list(zip(tokens.text, tokens.fixed)) == [("ann@x.com", 0), ("maria.c@y.com", 0), ("+15551234567", 3), ("maria.c@y.com", 0),
                                                    ("1.2.3.4", 1), ("ann@x.com", 0)]
    mixed = pii.tokens_of("a1,b2;;c3|d", [])
    assert mixed.text == ["a1", "b2", "c3"] and mixed.start == [0, 3, 7]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a@.-+ 012(9),;|", max_size=60))
def test_tokens_lie_apart_and_keep_base_spans(text):
    base = pii.base_spans(text)
    tokens = pii.tokens_of(text, base)
    assert all(e <= s for e, s in zip(tokens.end, tokens.start[1:]))
    assert all(text[s:e] == t for s, e, t in zip(tokens.start, tokens.end, tokens.text))
    covered = {i for s, e in zip(tokens.start, tokens.end) for i in range(s, e)}
    assert all(i in covered for s, e, _ in base for i in range(s, e) if text[i] in "0129@")


def exact_marginals(field, tokens, edges):
    n, labels = len(tokens.text), len(pii.KINDS) + 1
    local = np.stack([field.weights[:, pii.token_features(t)].sum(1) for t in tokens.text])
    total = np.zeros((n, labels))
    for number in range(labels ** n):
        y = [number // labels ** i % labels for i in range(n)]
        if any(f >= 0 and f != v for f, v in zip(tokens.fixed, y)):
            continue
        weight = np.exp(sum(local[i, v] for i, v in enumerate(y)) + sum(field.agree[k] for a, b, k in edges if y[a] == y[b]))
        total[np.arange(n), y] += weight
    return total / total.sum(axis=1, keepdims=True)


def test_propagation_is_exact_on_trees_and_close_on_loops():
    rng = np.random.default_rng(1)
    tokens = pii.Tokens([0] * 5, [1] * 5, ["1-2", "a@b", "12.3", "+1", "(988)"], [-1, 0, -1, -1, 3])
    field = pii.Field(rng.normal(0, 0.4, (5, pii.FEATURES)), np.array([0.7, 1.1]))
    tree = [(0, 1, 0), (1, 2, 1), (1, 3, 1), (3, 4, 0)]
    assert np.abs(field.marginals(tokens, tree) - exact_marginals(field, tokens, tree)).max() < 1e-3
    loop = [*tree, (0, 2, 1), (2, 3, 0)]
    assert np.abs(field.marginals(tokens, loop) - exact_marginals(field, tokens, loop)).max() < 0.1
    assert np.allclose(field.marginals(tokens, []), exact_marginals(field, tokens, []), atol=1e-6)


def make_texts(n=400):
    rng = np.random.default_rng(2)
    number = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    out = []
    for i in range(n):
        phone = f"+1 ({number(3)}) 555-{number(4)}"
        mail = f"name{number(2)}.{number(2)}@mail{i % 9}.example.com"
        address = ".".join(str(x) for x in rng.integers(10, 200, 4))
        out.append(f"Some words {phone} and {mail}, then {address} or version 2.0. of {i % 13} and 3. More words (4.0) in {1990 + i % 30}.")
    return out


def test_consistency_over_distance():
    field = pii.train(make_texts())
    filler = " of the words" * 300
    text = f"Call +1 (321) 555-0188 now.{filler} Again: 555-0188 today, mail anna.77@mail1.example.com{filler} and anna.77 there, 2.0. is not."
    spans = [(text[s:e], pii.KINDS[k], base) for s, e, k, base in pii.spans_of(text, field)]
    assert ("+1 (321) 555-0188", "phone", True) in spans and ("anna.77@mail1.example.com", "email", True) in spans
    assert ("555-0188", "phone", False) in spans and ("anna.77", "email", False) in spans
    assert len(spans) == 4
    for clean in ("Version 2.0. of 17 and 3. in 1999.", "no digits at all", "", None, "12 24 36 404 (500)"):
        assert pii.spans_of(clean, field) == []


def test_consistency_within_joined_lists():
    field = pii.train(make_texts())
    filler = " of the words" * 300
    text = f"To ann.77@mail1.example.com,maria.55@mail2.example.com;+1 (321) 555-0188.{filler} Later: maria.55,and,more;555-0188|ann.77 end"
    spans = {(text[s:e], pii.KINDS[k], base) for s, e, k, base in pii.spans_of(text, field)}
    assert {("maria.55", "email", False), ("ann.77", "email", False), ("555-0188", "phone", False)} <= spans and len(spans) == 6


def test_mask_and_columns(spark):
    rows = [(i, t, len(t), "s") for i, t in enumerate(make_texts(50))] + [(90, None, None, None), (91, "", 0, "x"), (None, "clean é", 7, "k"),
            (92, "é +1 (321) 555-0188 " * 3000, 60_000, "long"), (0, "a@b.cc a@b.cc", 13, "twice"), (0, "a@b.cc a@b.cc", 13, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    out = pii.mask_documents(df)
    assert out.dtypes == df.dtypes
    back = {(r.doc_id, r.spans): r for r in out.collect()}
    assert back[90, None].text is None and back[91, "x"].text == "" and back[None, "k"].text == "clean é"
    assert back[0, "twice"].text == "<EMAIL> <EMAIL>" and back[0, "twice"].n_chars == 15
    assert back[92, "long"].text == "é <PHONE> " * 3000
    found = pii.find(df).collect()
    assert len(found) == len(rows)
    field = pii.fit(df)
    for r in found:
        if r.doc_id == 92:
            assert len(r.spans) == 3000
    assert pii.find(df.where("false")).count() == 0 and pii.mask_documents(df.where("false")).count() == 0
    assert field.agree.shape == (2,)
