import zlib
import os
from collections import Counter

import numpy as np
import pytest

from parcelflow.llm import pieces as P

MODEL = P.MODEL.removeprefix("file://")
needs_model = pytest.mark.skipif(not os.path.exists(MODEL), reason="no tokenizer files")


def small_vocabulary():
    names = ["▁", "a", "b", "ab", "▁a", "aba", "ba", "▁▁", "▁ab"]
    as_bytes = [n.replace("▁", " ").encode() for n in names] + [bytes([b]) for b in range(256)]
    return P.Vocabulary(names, np.arange(9, dtype=np.int32), np.log(np.array([4, 3, 2, 5, 1, 2, 3, 1, 2.0])),
                        np.arange(9, 265).astype(np.int32), float(np.log(0.5)), as_bytes)


def segmentations(text, v):
    """{ids: weight} of all ways to write the text in pieces, in plain recursion."""
    out = Counter()

    def walk(rest, ids, weight):
        if not rest:
            out[ids] += weight
            return
        for n, w in zip(v.pieces, v.weights):
            if rest.startswith(n):
                walk(rest[len(n):], (*ids, v.pieces.index(n)), weight * np.exp(w))
        if rest[0] not in v.pieces:
            raw = rest[0].encode()
            walk(rest[1:], (*ids, *(9 + b for b in raw)), weight * np.exp(v.byte_weight) ** len(raw))

    walk("▁" + text.replace(" ", "▁"), (), 1.0)
    total = sum(out.values())
    return {k: x / total for k, x in out.items()}


@pytest.mark.parametrize("text", ["abab", "a ba", "aéb", "b", "ab  a"])
def test_samples_are_exact(text):
    v = small_vocabulary()
    exact = segmentations(text, v)
    sampler = P.Sampler(v, 3)
    runs, k = 6000, min(3, len(exact))
    results = sampler.sample([text] * runs, list(range(runs)), 3)
    firsts, pairs, included = Counter(), Counter(), Counter()
    estimate = 0.0
    for found in results:
        ids = [tuple(s.ids.tolist()) for s in found]
        assert len(set(ids)) == len(ids) == k
        assert all(abs(s.log_chance - np.log(exact[i])) < 1e-9 for s, i in zip(found, ids))
        values = [s.perturbed for s in found]
        assert values == sorted(values, reverse=True)
        assert all(v.decode(i) == text for i in ids)
        firsts[ids[0]] += 1
        pairs[tuple(ids[:2])] += 1
        included.update(ids)
        # with inclusion scores, the sample estimates a sum over all segmentations without bias
        estimate += sum(np.exp(s.log_chance - s.log_inclusion) * len(i) for s, i in zip(found, ids))
    for x, p in exact.items():
        assert abs(firsts[x] / runs - p) < 4.5 * np.sqrt(p * (1 - p) / runs) + 1e-9
        for y, q in exact.items():
            if x != y:
                want = p * q / (1 - p)
                assert abs(pairs[x, y] / runs - want) < 4.5 * np.sqrt(want * (1 - want) / runs) + 2e-3
    assert estimate / runs == pytest.approx(sum(p * len(x) for x, p in exact.items()), rel=0.03)


def test_exhausts_small_lattices():
    v = small_vocabulary()
    for text in ("b", "ab", "abab", "a b"):
        exact = segmentations(text, v)
        found = P.Sampler(v).sample([text], [1], 500)[0]
        assert {tuple(s.ids.tolist()) for s in found} == set(exact)
        assert all(s.log_inclusion == 0.0 for s in found)


def test_plain_and_odd_texts():
    v = small_vocabulary()
    texts = ["", None, "a", "x" * 30_000, "a▁b", " ", "\n\n", "ab " * 2000, "é▁ \n a", "😀a"]
    sampler = P.Sampler(v)
    found = sampler.sample(texts, list(range(len(texts))), 2)
    assert found[1] == [] and len(found[0]) == 1 and len(found[0][0].ids) == 0
    for t, f in zip(texts, found):
        assert all(v.decode(s.ids.tolist()) == t for s in f)
    assert len(found[3]) == 1 and len(found[7]) == 2
    # texts are sampled alike alone and together
    for i in (2, 4, 7, 9):
        alone = P.Sampler(v).sample([texts[i]], [i], 2)[0]
        assert [(s.ids.tolist(), s.perturbed, s.log_inclusion) for s in alone] == [(s.ids.tolist(), s.perturbed, s.log_inclusion) for s in found[i]]


@needs_model
def test_round_trip_over_a_table(spark):
    rng = np.random.default_rng(1)
    words = "the Quick brown  fox über naïve 東京 😀 | 12.5 a▁b été\nline ,,,, ññ".split(" ")
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(1, 60)))), "k") for i in range(60)]
    rows += [(900, None, "k"), (901, "", "k"), (902, "word " * 20_000, "k"), (None, "the fox", "k"), (903, "\t \r\n x", "k"), (700, "same", "k"), (700, "same", "k")]
    df = spark.createDataFrame([(t, i, k, 1) for i, t, k in rows], "text string, doc_id long, ids string, rank int")
    encoded = P.encode(df, k=3)
    back = P.with_decoded(encoded).collect()
    texts = {i: t for i, t, _ in rows}
    assert all(r.text == texts[r.doc_id] for r in back if r.doc_id != 700)
    per = Counter(r.doc_id for r in back)
    assert per[900] == 0 and per[901] == 1 and per[902] == 3 and per[700] in (4, 6)
    same = sorted((r["rank"], tuple(r.ids)) for r in back if r.doc_id == 700 and r.text == "same")
    assert same[0::2] == same[1::2]
    other = {(r.doc_id, r["rank"], tuple(r.ids)) for r in P.encode(df.repartition(3), k=3).collect()}
    assert other == {(r.doc_id, r["rank"], tuple(r.ids)) for r in back}
    short = {(r.doc_id, r["rank"]): r for r in P.digests(df, k=3).collect()}
    import zlib
    for r in back:
        d = short[r.doc_id, r["rank"]]
        if r.doc_id != 700:
            assert d.pieces == len(r.ids) and d.text_crc32 == zlib.crc32(r.text.encode())
            assert d.ids_crc32 == zlib.crc32(np.array(r.ids, "<i4").tobytes())
    assert P.encode(df.where("false")).count() == 0


@needs_model
def test_pieces_are_those_of_the_library():
    import sentencepiece

    made = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    v = P.Vocabulary.of(open(MODEL, "rb").read())
    for text in ("Hello world, this is it", "über naïve 東京", "  two  spaces", "a\nb"):
        ids = made.encode(text)
        assert v.decode(ids) == text
        found = P.Sampler(v).sample([text], [1], 1)[0][0]
        assert made.decode(found.ids.tolist()) == text


@needs_model
def test_query_returns_the_ids(spark):
    import zlib

    from parcelflow.llm.queries import op7_pieces
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = P.with_decoded(op7_pieces(spark, folder)).collect()
    assert {r.doc_id for r in rows} == {i for i, t in texts.items() if t is not None}
    assert {r["rank"] for r in rows} == {1, 2}
    for r in rows:
        assert r.text == texts[r.doc_id] and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())


def test_checksum_of_the_same_pass_is_that_of_the_decoded_text(spark):
    texts = [(1, "Hello  world\n\nand ▁ more"), (2, ""), (3, None), (4, "ünï🙂 " * 50)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = {(r.doc_id, r["rank"]): r for r in P.encode(df, k=2, checksum=True).collect()}
    plain = {(r.doc_id, r["rank"]): r for r in P.with_decoded(P.encode(df, k=2), name="decoded").collect()}
    assert rows.keys() == plain.keys() and len(rows) == 5
    for at, r in rows.items():
        assert r.ids == plain[at].ids and r.log_chance == plain[at].log_chance
        assert r.text_crc32 == zlib.crc32(dict(texts)[at[0]].encode()) == zlib.crc32(plain[at].decoded.encode())
