"""Corpus pipeline: from raw documents to packed sequences, in five stages.

Each stage takes the session, the documents its predecessor kept and the folder of the tables. All but the last return
the columns of ``documents``; between stages the rows are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from qaloom.llm import decontaminate, language, near_copies, packing, quality
from qaloom.llm.common import read, stored

# Only what has no letter, or hardly any n-gram in common with a language, is rejected.
LEAST_LANGUAGE_SCORE = 0.05
# After four stages an executor has less memory to spare than for packing alone, and the next run's stages need what packing held.
CACHED = 40_000


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised."""
    return language.keep_known(docs, language.fit(docs), LEAST_LANGUAGE_SCORE)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents the quality classifier accepts."""
    return quality.keep_good(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least ``doc_id`` of each component of near copies: five-word Jaccard similarity of 0.8 or more."""
    return near_copies.keep_first(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without a window of a benchmark item."""
    return decontaminate.remove_documents(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, and their places in sequences."""
    return packing.digest(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), cached=CACHED, kept=False))


STAGES = [
    ("language_id", known_language),
    ("quality_classifier", good_quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("packing", packed),
]

# Models and tokenizers cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the whole table of documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
