"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans (email, ip, card, phone). Tokens that hold a digit or an ``@`` are the nodes of
a graph per document: neighbours in the text are linked (chain), and so are tokens that repeat or resemble
each other anywhere in the document (skip: equal text, equal digits, equal local part of an address). Base
spans fix the labels of their tokens; loopy belief propagation spreads them, so that another mention of the
same number or address gets the same label although no pattern matches it there. Confident labels outside
base spans become further spans.

Training is piecewise: token weights by logistic regression per kind, link weights from how often linked
tokens agree, both on the base labels of a bounded sample of documents. Links join consecutive occurrences
only, so a token repeated n times has n - 1 links, never n * n.

Defined results: a null text counts as empty; no spans give an empty string (and the digest of it); repeated
rows get equal spans; overlapping base spans of different kinds are all kept. No documents give no rows.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from parcelflow.llm.arrow import free_name, with_arrow_columns
from parcelflow.llm.linear import Sparse, fit_logistic

KINDS = ("email", "ip", "card", "phone")
#: Most documents that the field is trained on (the first by hash).
SAMPLE, LONGEST = 3000, 20_000
#: Least chance of a token's label: linked to a base span of that label, and on its own.
LIKELY, CONFIDENT = 0.5, 0.9
LEAST_DIGITS = 7
ROUNDS, DAMPING = 30, 0.3

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match starts where a run of digits does, so the other digits of a run are no starts to try.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")
_PIECE = re.compile(r"[^,;|]+")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_EDGE = "\"'`.,;:!?()[]{}<>|*#$&%="
LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _part(digits: str) -> bool:
    """Whether a part of an address is at most 255; leading zeros of any number are fine."""
    plain = digits.lstrip("0")
    return len(plain) <= 3 and int(plain or "0") <= 255


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses. Each is found from its ``@``: the name before it reaches back to the
    last other character or the end of the match before."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARACTERS:
            start -= 1
        tail = _DOMAIN.match(text, at + 1) if start < at else None
        if tail:
            out.append((start, tail.end()))
            done = tail.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the patterns' matches, by start and kind."""
    found = [(s, e, 0) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(_part(p) for p in m.group().split(".")):
            found.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group()) if m.end() - m.start() <= 40 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            found.append((m.start(), m.end(), 3))
    return sorted(found)


@dataclass
class Tokens:
    start: list[int]
    end: list[int]
    text: list[str]
    #: label fixed by a base span, else -1
    fixed: list[int]


def tokens_of(text: str, base: list[tuple[int, int, int]]) -> Tokens:
    """Tokens with a digit or ``@``, without quotes and punctuation around them.

    A run without white space is cut at every base span, and what lies between at commas, semicolons and bars.
    """
    out = Tokens([], [], [], [])

    def add(start: int, end: int, label: int):
        out.start.append(start)
        out.end.append(end)
        out.text.append(text[start:end])
        out.fixed.append(label)

    def add_plain(start: int, end: int):
        for m in _PIECE.finditer(text, start, end):
            core = m.group()
            lo, hi = m.start() + len(core) - len(core.lstrip(_EDGE)), m.end() - len(core) + len(core.rstrip(_EDGE))
            if lo < hi and _TOKEN.match(text[lo:hi]):
                add(lo, hi, -1)

    at = 0
    for m in _TOKEN.finditer(text):
        floor, end = m.span()
        while at < len(base) and base[at][1] <= floor:
            at += 1
        i = at
        while i < len(base) and base[i][0] < end:
            lo, hi = max(base[i][0], floor), min(base[i][1], end)
            if lo < hi:
                add_plain(floor, lo)
                add(lo, hi, base[i][2])
                floor = hi
            i += 1
        add_plain(floor, end)
    return out


def token_features(token: str) -> list[int]:
    """Numbers of a token's features in ``range(FEATURES)``."""
    digits = sum(map(str.isdigit, token))
    dots, ats, hyphens = token.count("."), token.count("@"), token.count("-")
    parts = token.split(".")
    letters = sum(map(str.isalpha, token))
    return [0, 1 + min(digits, 20), 22 + min(dots, 5), 28 + min(ats, 2), 31 + min(hyphens, 3), 35 + min(letters, 9),
            45 + (token[:1] == "+"), 47 + (digits == len(token)), 49 + (len(parts) == 4 and all(p.isascii() and p.isdigit() and _part(p) for p in parts)),
            51 + (14 <= digits <= 19 and not letters and luhn("".join(c for c in token if "0" <= c <= "9"))),
            53 + bool(re.fullmatch(r"[0-9]{3}-[0-9]{4}", token)), 55 + bool(re.fullmatch(r"\(?[0-9]{3}\)?", token))]


FEATURES = 57
TESTED = frozenset([*range(28, 31), *range(45, 47), *range(49, 53)])
PRIOR_AGREE = ((5.0, 1.0), (100.0, 1.0))


def links(tokens: Tokens, text: str) -> list[tuple[int, int, int]]:
    """(a, b, type): neighbours with only white space between them (0), repeated or similar tokens (1)."""
    out = []
    last: dict[tuple[str, str], int] = {}
    for i, token in enumerate(tokens.text):
        if i and not text[tokens.end[i - 1]:tokens.start[i]].strip(" \t()-"):
            out.append((i - 1, i, 0))
        digits = _NOT_DIGIT.sub("", token)
        local = token.split("@")[0].lower()
        keys = {("text", token.lower())} | ({("digits", digits)} if len(digits) >= 6 else set())
        if len(local) >= 5 and any(c.isalpha() for c in local):
            keys.add(("local", local))
        near = {last[k] for k in keys if k in last}
        out += [(j, i, 1) for j in sorted(near)]
        for k in keys:
            last[k] = i
    return out


@dataclass
class Field:
    #: log-odds weights [kinds + 1, features]; the last row is "none"
    weights: np.ndarray
    #: log-odds that two linked tokens agree: chain, skip
    agree: np.ndarray

    def marginals(self, tokens: Tokens, edges: list[tuple[int, int, int]]) -> np.ndarray:
        """Loopy belief propagation: each token's label chances ``[n, kinds + 1]``, base labels fixed."""
        n, labels = len(tokens.text), len(KINDS) + 1
        local = np.stack([self.weights[:, token_features(t)].sum(axis=1) for t in tokens.text])
        fixed = np.array(tokens.fixed)
        local[fixed >= 0] = -50.0
        local[np.flatnonzero(fixed >= 0), fixed[fixed >= 0]] = 50.0
        if edges:
            a, b, kind = (np.array(x) for x in zip(*edges))
            source, target = np.concatenate([a, b]), np.concatenate([b, a])
            back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
            strength = np.exp(self.agree[np.concatenate([kind, kind])])[:, None]
            message = np.zeros((len(source), labels))
            for _ in range(ROUNDS):
                belief = local.copy()
                np.add.at(belief, target, message)
                out = belief[source] - message[back]
                out -= out.max(axis=1, keepdims=True)
                out = np.exp(out)
                # potential exp(agree) for equal labels, 1 for others
                new = np.log(out.sum(axis=1, keepdims=True) + (strength - 1) * out)
                new -= new.mean(axis=1, keepdims=True)
                moved = np.abs(new - message).max()
                message = DAMPING * message + (1 - DAMPING) * new
                if moved < 1e-4:
                    break
            np.add.at(local, target, message)
        local -= local.max(axis=1, keepdims=True)
        chance = np.exp(local)
        return chance / chance.sum(axis=1, keepdims=True)

    def further_spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Spans of tokens outside base spans that the field labels with confidence; neighbours of a kind are one.

        A span is kept if one of its tokens repeats or resembles a token of a base span of that kind, or if
        it has ``LEAST_DIGITS`` digits: a short number alone is no personal data.
        """
        tokens = tokens_of(text, base)
        if not any(f < 0 for f in tokens.fixed):
            return []
        edges = links(tokens, text)
        chance = self.marginals(tokens, edges)
        best = chance.argmax(axis=1)
        joined = {i for i, j, kind in edges if kind == 0 and j == i + 1}
        backed = {x for i, j, kind in edges if kind for x, y in ((i, j), (j, i)) if tokens.fixed[y] == best[x]}
        out: list[list[int]] = []
        sure: list[bool] = []
        last = -2
        for i, label in enumerate(best.tolist()):
            if tokens.fixed[i] >= 0 or label == len(KINDS) or chance[i, label] < (LIKELY if i in backed else CONFIDENT):
                continue
            if out and last == i - 1 and i - 1 in joined and out[-1][2] == label:
                out[-1][1] = tokens.end[i]
                sure[-1] |= i in backed
            else:
                out.append([tokens.start[i], tokens.end[i], label])
                sure.append(i in backed)
            last = i
        digits = lambda s, e: len(_NOT_DIGIT.sub("", text[s:e]))
        return [tuple(x) for x, held in zip(out, sure) if held or digits(*x[:2]) >= LEAST_DIGITS]


def train(texts: list[str]) -> Field:
    """Piecewise training on the base labels of some documents.

    Every token is seen in two ways: as it is, and once more without the features that the patterns test
    (``@``, leading plus, validity), so that the weights of the rest do not vanish beside them. The counts
    of links that agree start from ``PRIOR_AGREE``: repeats are rare in most documents.
    """
    rows, labels = [], []
    agree = np.array(PRIOR_AGREE)  # [link type, agree or not]
    for text in texts:
        tokens = tokens_of(text, base_spans(text))
        marks = [len(KINDS) if f < 0 else f for f in tokens.fixed]
        seen = [token_features(t) for t in tokens.text]
        rows += seen + [[f for f in r if f not in TESTED] for r in seen]
        labels += marks + marks
        for i, j, kind in links(tokens, text):
            if marks[i] != len(KINDS) or marks[j] != len(KINDS):
                agree[kind, int(marks[i] != marks[j])] += 1
    labels = np.array(labels, np.int64)
    x = Sparse([(np.array(r), np.ones(len(r))) for r in rows], FEATURES)
    weights = np.zeros((len(KINDS) + 1, FEATURES))
    weights[-1, 0] = 3.0
    for k in range(len(KINDS)):
        if (labels == k).any():
            weights[k], shift = fit_logistic(x, (labels == k).astype(float), l2=1e-3, rounds=300)
            weights[k, 0] += shift + 3.0
        else:
            weights[k, 0] = -3.0
    return Field(weights, np.clip(np.log(agree[:, 0] / agree[:, 1]), 0.0, 5.0))


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE, longest: int = LONGEST) -> Field:
    """A field trained on at most ``sample`` different texts that have a candidate token, of ``longest`` characters at most."""
    body = F.col(text).cast("string")
    able = docs.select(body.alias("t")).where(F.col("t").rlike("[0-9@]") & (F.length("t") <= longest)).withColumn("h", F.xxhash64("t"))
    hashes = able.select("h").distinct().orderBy("h").limit(sample)
    chosen = able.join(hashes, "h").groupBy("h").agg(F.min("t").alias("t"))
    return train([r.t for r in sorted(chosen.collect(), key=lambda r: r.h)])


def spans_of(text: str | None, field: Field) -> list[tuple[int, int, int, bool]]:
    """All spans of a text: (start, end, kind number, whether it is a base span), by start and kind."""
    body = text or ""
    base = base_spans(body)
    further = field.further_spans(body, base) if _has_candidate(body) else []
    return sorted([*[(*b, True) for b in base], *[(*f, False) for f in further]], key=lambda s: (s[0], s[2], s[1]))


def _has_candidate(body: str) -> bool:
    return _CANDIDATE.search(body) is not None


_CANDIDATE = re.compile(r"[0-9@]")
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                                 T.StructField("kind", T.StringType()), T.StructField("base", T.BooleanType())]))


def masked(text: str | None, spans: list[tuple[int, int, int, bool]]) -> str | None:
    """The text with each span, overlapping ones together, replaced by its kind in capitals and angle brackets."""
    if not spans:
        return text
    out, done, i = [], 0, 0
    while i < len(spans):
        start, end, kind, _ = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][1])
            i += 1
        out += [text[done:start], f"<{KINDS[kind].upper()}>"]
        done = end
    return "".join([*out, text[done:]])


def with_spans(docs: DataFrame, field: Field, text: str = "text", spans: str = "spans", mask: str | None = None,
               keep: list[str] | None = None) -> DataFrame:
    """Adds the spans of every whole text (code points, end exclusive) and, if named, the masked text; one pass, no shuffle."""

    def make():
        def work(values):
            found = [spans_of(v, field) for v in values]
            columns = [pa.array([[{"start": s, "end": e, "kind": KINDS[k], "base": b} for s, e, k, b in f] for f in found],
                                pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_())])))]
            return columns + ([pa.array([masked(v, f) for v, f in zip(values, found)], pa.string())] if mask else [])

        return work

    return with_arrow_columns(docs, text, [(spans, SPAN), *([(mask, T.StringType())] if mask else [])], make, keep)


def find(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ``spans``, with the field trained on these documents."""
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return with_spans(narrow, fit(narrow), "text", keep=["doc_id"])


def mask_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with personal data masked in the text; ``n_chars``, if there, counts the new text."""
    spans, mask = free_name(docs, "_spans"), free_name(docs, "_masked")
    found = with_spans(docs, fit(docs, text), text, spans, mask)
    columns = []
    for name, kind in docs.dtypes:
        if name == text:
            columns.append(F.col(mask).alias(name))
        elif name == "n_chars":
            changed = F.size(spans) > 0
            columns.append(F.when(changed, F.length(mask)).otherwise(F.col(name)).cast(kind).alias(name))
        else:
            columns.append(F.col(f"`{name}`"))
    return found.select(*columns)


def digest(spans: list[tuple[int, int, int]]) -> str:
    """``kind:start:end`` of (start, end, kind number), comma-joined, as SHA-256."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans).encode()).hexdigest()
