import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from parcelflow.llm import tokenalign

ODD = ["", None, "a", " ", "\n\n  two  spaces ", "<|endoftext|> and <s> <unk> </s>", "naïve café – „quoted“ 日本語 🙂🙂", "under▁score", "tab\there\x00\x0b", "é" * 7,
       "same text here", "same text here", "same other text", "internationalisation antidisestablishmentarianism"]


def plain(texts):
    """Every document's tokens, groups and links, by comparing all spans."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = {}
    other = 256
    for x in range(256):
        if chr(x).isprintable() and x != 32 and x != 0xAD:
            letters[chr(x)] = x
        else:
            letters[chr(other)] = x
            other += 1
    out = []
    for text in texts:
        raw = (" " + (text or "")).encode()
        x, y = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        xs = [bytes(letters[c] for c in a.id_to_token(i)) for i in x]
        ys = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not text or b"".join(xs) != raw or b"".join(ys) != raw:
            out.append(([], [], []))
            continue
        spans = []
        for parts in (xs, ys):
            ends = np.cumsum([len(p) for p in parts]).tolist()
            spans.append([(e - len(p), e) for e, p in zip(ends, parts)])
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = [[[i for i, (s, e) in zip(ids, at) if lo <= s and e <= hi] for ids, at in zip((x, y), spans)] for lo, hi in zip([0, *cuts], cuts)]
        links = [(m, n) for m, (s, e) in enumerate(spans[0]) for n, (u, v) in enumerate(spans[1]) if s < v and u < e]
        out.append((groups, links, [(x[m], y[n]) for m, n in links]))
    return out


def expected(texts):
    found = plain(texts)
    count = Counter(p for _, _, pairs in found for p in set(pairs))
    best = {}
    for (a, _), c in count.items():
        best[a] = max(best.get(a, 0), c)
    rows = []
    for groups, links, pairs in found:
        said = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        rows.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(count[p] == best[p[0]] for p in pairs),
                     sum(count[p] for p in pairs), hashlib.sha256(said.encode()).hexdigest() if said else ""))
    return rows


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("batch", [1, 300, 1 << 20])
def test_equals_all_spans_compared(spark, batch):
    rng = np.random.default_rng(3)
    words = ["the", "over", "tokenisation", "Übergröße", "résumé", "x9", "--", "1234567", "\n", "don't", "日本", "zzzz"]
    texts = ODD + [" ".join(rng.choice(words, rng.integers(1, 30))) for _ in range(40)] + ["word " * 3000 + "end"]
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in enumerate(texts)], "doc_id long, text string, chunk string, n_a int, codes string").repartition(3)
    found = tokenalign.align_documents(docs, batch=batch)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in found.collect()}
    assert got == dict(enumerate(expected(texts)))


def test_groups_and_links(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, groups string")
    found = {r.doc_id: r for r in tokenalign.with_alignment(docs).collect()}
    for i, (groups, links, _) in enumerate(plain(ODD)):
        assert [[g.a, g.b] for g in found[i]["_groups"]] == groups
        assert [(x.a, x.b) for x in found[i].links] == links and found[i].groups == "x"


def test_empty_null_and_repeated(spark):
    schema = "doc_id long, text string"
    assert tokenalign.align_documents(spark.createDataFrame([], schema)).count() == 0
    rows = tokenalign.align_documents(spark.createDataFrame([(None, None), (5, ""), (5, "one"), (5, "one"), (None, "one")], schema)).collect()
    assert sorted(r.count_sum for r in rows) == [0, 0, 3, 3, 3]
    assert all(r.n_best == r.n_links for r in rows)


def test_lockstep_of_documents_of_unlike_length():
    a_ends, b_ends = np.array([2, 3, 6, 4, 1, 2, 3]), np.array([1, 6, 4, 3])
    links, a_cut, b_cut = tokenalign.lockstep(a_ends, b_ends, np.array([0, 3, 3, 4, 7]), np.array([0, 2, 2, 3, 4]))
    assert sorted(zip(*links.tolist())) == [(0, 0), (0, 1), (1, 1), (2, 1), (3, 2), (4, 3), (5, 3), (6, 3)]
    assert a_cut.tolist() == [False, False, True, True, False, False, True] and b_cut.tolist() == [False, True, True, True]


def test_fast_encoder_equals_the_vocabulary_file():
    """Random strings over letters, marks, digits, spaces and symbols of many scripts."""
    model = open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read()
    side = tokenalign.byte_side(model)
    made = Tokenizer.from_str(model.decode())
    made.encode_special_tokens = True
    rng = np.random.default_rng(8)
    ranges = [(0, 128), (0, 128), (128, 0x250), (0x250, 0x3100), (0x3000, 0xD7FF), (0xE000, 0xFFFF), (0x10000, 0x1FFFF), (9, 33), (0x2000, 0x2070)]
    texts = ["", "<|endoftext|>", "it's we'll I'M  x\u00a0\u2003y\u3000 \u200b", "a" * 3000, " " * 500 + "x", "\n\n\t x"]
    for _ in range(1500):
        spans = [ranges[i] for i in rng.integers(0, len(ranges), rng.integers(1, 4))]
        texts.append("".join(chr(rng.integers(*spans[i])) for i in rng.integers(0, len(spans), rng.integers(1, 40))))
    want = [e.ids for e in made.encode_batch([f" {t}" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in side.encode(texts)] == want
    assert b"".join(side.as_bytes[i] for i in want[2]).decode() == " " + texts[2]
