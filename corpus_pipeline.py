"""Corpus pipeline over ``documents``: each stage is one operator of ``scoreweave.llm``.

Every stage works on all rows its predecessor kept and returns the columns of ``documents``; the last
one returns a digest of the encoded texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreweave.llm import bpe, decontaminate, language, neardup, toxicity
from scoreweave.session import shared_table_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Least share of the winning language for a document to stay.
LEAST_SHARE = 0.5


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn toxicity from the labels and drop the documents predicted toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.detect(docs, labels, prefix="_toxic_")
    return scored.filter("_toxic_predicted = 0").select(*docs.columns)


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn the languages from ``lang`` and drop documents without a letter or a clear language."""
    found = language.detect(docs, prefix="_lang_")
    known = (F.col("_lang_lang_pred") != language.UNKNOWN) & (F.col("_lang_score") >= LEAST_SHARE)
    return found.filter(known).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates (five-word shingles)."""
    return neardup.first_of_each(docs, size=5)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.without_items(docs, items)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of each document that is left."""
    return bpe.encode_decode(docs.select("doc_id", "text")).drop("text")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", clean),
    ("language", in_a_language),
    ("near_duplicates", one_of_each),
    ("decontamination", uncontaminated),
    ("encode", encode),
]

# Trained models, hash-seeded trees and BPE merges have no SQL counterpart; tests/llm compares the
# stages with brute-force versions instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_table_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
