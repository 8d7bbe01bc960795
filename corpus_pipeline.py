"""A training-data pipeline over ``documents``, each stage one operator of ``parcelflow.llm``.

Every stage takes the documents that the one before has kept, whole, and returns the columns of ``documents``; the
last returns token ids. Nulls, empty texts, repeated rows and further columns are handled as each operator's
module says; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parcelflow.llm import decontaminate, pieces, pii, quality, simhash
from parcelflow.session import cut


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of a grade of 1 or more is at least one half, by a model of the label table's ratings."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.select_documents(docs, quality.label_grades(labels))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies (five-word shingles, Jaccard similarity of 0.8 or more)."""
    return simhash.keep_one_per_group(docs, size=5, similarity=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no passage of the benchmark."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def privacy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, personal data masked; ``n_chars`` counts the masked text."""
    return pii.mask_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, rank, ids and scores of two sampled segmentations of each document."""
    return pieces.encode(docs, k=2)


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("decontamination", decontamination_stage),
          ("privacy", privacy_stage), ("encoding", encoding_stage)]
#: A fitted classifier, shingle sets and loopy propagation have no SQL; tests/llm/test_pipeline.py checks every stage by other means.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each reads what the one before has written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
