"""Corpus pipeline: language ID, near-dedup, substring dedup, decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one
before it kept.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagesift.llm import decontamination, language, packing, repeats, simhash
from pagesift.llm.common import read, vocabulary_path, written
from pagesift.session import prepare


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the text, its declaration and its source agree on; others go."""
    prepare(spark)
    return language.drop_unidentified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints of 4-word shingles link at 4 bits or fewer."""
    prepare(spark)
    return simhash.keep_one(docs, 4, 4)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that a 13-word window of an earlier document covers; every document stays."""
    prepare(spark)
    return repeats.remove_repeats(docs, 13)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, exactly or with up to a fifth of its words edited."""
    prepare(spark)
    return decontamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents in sequences of at most 2048."""
    prepare(spark)
    return packing.pack_documents(docs, vocabulary_path(), 2048)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]

#: SQL cannot express the stages; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
