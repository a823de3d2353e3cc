"""Queries of the training-data operators, with DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from pagesift.llm import (
    credentials, decontamination, dialogue, extraction, language, licenses, neighbours, packing, quality, repeats, sharding, simhash, spelling,
)
from pagesift.llm.common import read, vocabulary_path


def op1_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_languages(read(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), vocabulary_path(), 2048)


def op3_pigeonhole_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_main_text(read(spark, sf_dir, "pages"))


def op5_simhash_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), 4, 4)


def op6_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"), 8)


def op7_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = repeats.mark_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), 13)
    return marked.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op8_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), 0.3)


def op9_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicate_vectors(read(spark, sf_dir, "embeddings"), 0.98)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


def op11_machine_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents"), 6, 5, 5, spelling.slip)


def op12_band_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations")
    return dialogue.repair_report(conversations, dialogue.damage(conversations))


def op13_character_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credentials.scan_secrets(read(spark, sf_dir, "documents"))
    digest = F.sha2(F.encode("base", "UTF-8"), 256).alias("base_sha256")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", digest, "spans", "n_learned", "score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = (
    op1_language_fusion, op2_best_fit_packing, op3_pigeonhole_edits, op4_html_extraction, op5_simhash_popcount,
    op6_jump_sharding, op7_phrase_automata, op8_factorisation_machine, op9_nn_descent, op10_license_scan, op11_machine_composition,
    op12_band_alignment, op13_character_network, pipeline,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op6_jump_sharding": sharding.oracle(8), "op7_phrase_automata": repeats.ORACLE}
