import os

import pytest

import corpus_pipeline
from parcelflow.llm import decontaminate, pieces, pii, quality

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER) or not os.path.exists(pieces.MODEL.removeprefix("file://")), reason="no test data")


def shingles(text):
    words = "".join(c if c.isalnum() or c.isspace() or not c.isascii() else "" for c in text.lower()).split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def test_every_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs)
        assert docs.columns == columns or name == "encoding"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "privacy", "encoding"]

    before, after = seen["quality"]
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    judged = quality.grade_documents(before, quality.label_grades(labels)).collect()
    assert sorted(r.doc_id for r in judged if r.keep) == sorted(r.doc_id for r in after.collect())
    truth = {r.doc_id: r.quality for r in labels.collect()}
    kept = {r.doc_id for r in after.collect()}
    assert sum((r.doc_id in kept) == (truth[r.doc_id] == 1) for r in judged if r.doc_id in truth) >= 0.95 * sum(r.doc_id in truth for r in judged)

    before, after = seen["near_duplicates"]
    texts = {r.doc_id: shingles(r.text) for r in before.collect()}
    left = {r.doc_id for r in after.collect()}
    alike = lambda a, b: len(texts[a] & texts[b]) / len(texts[a] | texts[b])
    for gone in set(texts) - left:
        assert any(alike(gone, x) >= 0.6 for x in texts if x != gone)
    assert not any(alike(a, b) >= 0.95 for a in left for b in left if a < b)

    before, after = seen["decontamination"]
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    leaked = {r.doc_id for r in decontaminate.contaminated(before, items).collect()}
    assert {r.doc_id for r in before.collect()} - leaked == {r.doc_id for r in after.collect()}

    before, after = seen["privacy"]
    old = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text)
        assert r.text == old[r.doc_id] or pii.base_spans(old[r.doc_id]) or "<" in r.text

    before, after = seen["encoding"]
    back = pieces.with_decoded(after).collect()
    want = {r.doc_id: r.text for r in before.collect()}
    assert {r.doc_id for r in back} == set(want) and all(r.text == want[r.doc_id] for r in back)


def test_odd_documents_pass_through(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some words of text here", "en", "s", 23), (3, "a@b.cc " * 9000, "en", "s", 63_000),
            (3, "a@b.cc " * 9000, "en", "s", 63_000), (4, "plain words", None, None, 11)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, spans string, f0 int")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        empty = stage(spark, docs.where("false"), FOLDER)
        assert empty.count() == 0
        if name != "encoding":
            assert out.dtypes == docs.dtypes
        if name == "near_duplicates":
            assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "3", "4", "None"]
        if name == "privacy":
            assert {r.text for r in out.collect() if r.doc_id == 3} == {"<EMAIL> " * 9000}
        if name == "encoding":
            assert {r.doc_id for r in out.collect()} == {2, 3, 4, None}
