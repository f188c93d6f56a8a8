"""From raw documents to packed sequences: quality rules, near-dedup, substring dedup, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textloom.llm import near_dedup, packing, quality, substrings
from textloom.llm._spark import prefer_small_batches, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail their own rules, or whose host is judged bad, go."""
    prefer_small_batches(spark)
    return quality.keep_good(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id stays."""
    prefer_small_batches(spark)
    return near_dedup.keep_one(docs)


def substring_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages stay in their first document only; n_chars follows the text."""
    prefer_small_batches(spark)
    return substrings.without_repeats(docs, length="n_chars")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its sequence and the offset there."""
    prefer_small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_deduplication),
    ("substring_dedup", substring_deduplication),
    ("best_fit_packing", best_fit_packing),
]

#: Signatures, chains and tokens are beyond SQL; a test holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed documents of ``sf_dir``; each stage reads what the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = stored(docs)
    return docs
