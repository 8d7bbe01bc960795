"""Golden values of the text and number functions."""

import hashlib
import hmac
import random
import re

import pytest
from pyspark.sql import functions as F

from parcelflow.functions import codes as C, geometry as G, text as X
from parcelflow.operators import lots as L


def test_area_locale(column):
    cases = {"96.4 m2": 96.4, "12.050,75": 12050.75, "7.300": 7300, "18,25 m²": 18.25, "600": 600, " ": None, "none": None, "10.900,10 m2": 10900.1, None: None}
    assert column(list(cases), X.parse_area_locale) == list(cases.values())


def test_area_simple(column):
    assert column(["1234,56 m²", "", "sem numero", "0", "1.234,56"], X.parse_area_simple) == [1234.56, None, None, None, 1.234]


def test_format_area_keeps_shape(column):
    shapes = ["312,50 m²", "1.234 m2", "45", "a 7.5 b", "sem"]
    assert column(shapes, lambda c: X.format_area_like(c, F.lit(1234.5))) == ["1234,50 m²", "1234 m2", "1234", "a 1234.5 b", ""]


def test_number_format(column):
    one = lambda v, d: column([v], lambda c: X.format_br(c, d), "double")[0]
    cases = [(7.0, 0, "7"), (1000.0, 0, "1.000"), (1234567.891, 2, "1.234.567,89"), (-0.75, 1, "-0,8"), (99.5, 3, "99,500"), (float("nan"), 1, "-")]
    assert [one(v, d) for v, d, _ in cases] == [text for *_, text in cases]


def test_next_name(column):
    cases = [("B02/14", 1, "B02/15"), ("B02/14", 6, "B02/20"), ("x099", 1, "x100"), ("Unit 8 east", 4, "Unit 12 east"), ("Gate", 2, "Gate 3"), ("", 1, " 2"), ("7", 0, "7")]
    for name, step, wanted in cases:
        assert column([name], lambda c: X.next_name(c, F.lit(step)))[0] == wanted


def test_names_from_patterns_follow_the_rules(column):
    """Random patterns: every placeholder is replaced, wherever and however often it stands; nothing else changes."""
    rnd = random.Random(31)
    for pad in (-3, 0, 1, 6, 8, 40):
        pattern = "".join(rnd.choice(["{n}", "{q}", "{s}", "{N}", "{", "}", "x", " ", "$1", "\\"]) for _ in range(12))
        values = [rnd.randrange(-10 ** 6, 10 ** 6) for _ in range(20)] + [0, -1, 123456789]
        got = column(values, lambda c: X.name_from_pattern(pattern, c, pad, F.lit("Q-{s}"), F.lit(None).cast("string")), "int")
        for v, text in zip(values, got):
            number = ("-" if v < 0 else "") + str(abs(v)).zfill(max(0, min(8, pad)))
            assert text == pattern.replace("{n}", number).replace("{q}", "Q-{s}").replace("{s}", "")


def matches(column, search, names):
    found = column(names, lambda c: c.rlike(X.name_search_regex(search)))
    return [n for n, ok in zip(names, found) if ok]


def test_searches_as_parts_globs_and_expressions(column):
    """Random names: a part is found in any case; a star takes any run, a question mark one character, and both hold the whole name."""
    rnd = random.Random(32)
    names = ["".join(rnd.choice("aAbB1. +-") for _ in range(rnd.randint(1, 7))) for _ in range(120)]
    for part in ("ab", "1.", "b+", "-A", "."):
        assert matches(column, part, names) == [n for n in names if part.lower() in n.lower()]
    for glob in ("a*", "*1", "?b*", "a?", "*.*"):
        plain = "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in glob)
        assert matches(column, glob, names) == [n for n in names if re.fullmatch(plain, n, re.I)]
    for inner in ("^[ab]+$", "1{2}", "a|b$"):
        assert matches(column, f"/{inner}/", names) == [n for n in names if re.search(inner, n, re.I)]
    assert [X.name_search_regex(t) for t in ("", "   ", None)] == [None] * 3


def test_block_and_common_area(column):
    assert column(["QD-14", "E12", "14", "Quadra 7b", "Rua 1", None], X.normalize_block) == ["Q14", "E12", "Q14", "Q7B", "", ""]
    assert column(["A.V.252", "OPUB04", "APP Lagoa", "LT03 150m2"], X.is_non_lot_area) == [True, True, True, False]


def test_layers(column):
    layers = ["TXT_LOTES_NUMERACAO", "6_block_id_label", "CL_SIMBOLOS", "BASE 2024", "Vegetação"]
    assert column(layers, L.is_auxiliary_layer) == [True, True, True, False, True]
    assert column([" LOTE ", "4_fnc_x", "RUA"], L.is_cadastral_layer) == [True, True, False]


def test_urls(column):
    urls = ["https://hooks.example/x", "http://hooks.example/x", "https://u:p@hooks.example", "https://hooks.example:8443/", "https://hooks.example/#a",
            "https://127.0.0.1/", "https://10.1.2.3/", "https://8.8.8.8/", "https://[::1]/", "https://[2606:4700::1111]/", "https://a b/", "https://hooks.example:443"]
    assert column(urls, X.url_allowed) == [True, False, False, False, False, False, False, True, False, True, False, True]


def test_hmac_matches_standard_library(column):
    key = bytes(range(40))
    wanted = [hmac.new(key, m.encode(), hashlib.sha256).hexdigest() for m in ("1.{}", "é")]
    assert column(["1.{}", "é"], lambda c: X.hmac_sha256(F.lit(key.hex()), c)) == wanted
    long_key = bytes(range(100))
    assert column(["m"], lambda c: X.hmac_sha256(F.lit(long_key.hex()), c)) == [hmac.new(long_key, b"m", hashlib.sha256).hexdigest()]


def test_points_and_logs(column):
    assert [[tuple(p) for p in r] for r in column(["1,2 3,4", "", "1,2 x,y 5"], G.parse_points)] == [[(1, 2), (3, 4)], [], [(1, 2)]]
    assert [[tuple(p) for p in r] for r in column(["[[1,2],[3,4]]"], G.parse_points_json)] == [[(1, 2), (3, 4)]]
    assert [len(r) for r in column(['[{"at":"x"}]', '[{"at"', '{"a":1}', None], X.json_logs)] == [1, 0, 0, 0]


def test_codes(column):
    assert column([0, 3, 7, -1, None], C.ingest_status, "int") == ["available", "blocked", "available", "available", "available"]
    assert column([0, 7, -1], C.editor_status, "int") == ["available", "blocked", "blocked"]
    assert column([1, 2, 3, 8, 12, 400], C.backoff_seconds, "int") == [5, 10, 20, 640, 3600, 3600]
    assert column(["share_link_revoked", "other"], C.audit_phrase) == ["revogou um link de compartilhamento", "executou other"]
