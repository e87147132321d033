"""Registered queries of the operators: thin callables with production
parameters over whole tables, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsieve.llm import (ann_hnsw, language_id, line_dedup, lm_scoring, periodic_runs, prefix_trie,
                          quality_classifier, quality_rules, sentencepiece_codec, sharding, simhash_dedup, source_mixing, token_files)
from tabsieve.llm.common import id_fold, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = id_fold(F.col("doc_id"), 4) == 2
    model = language_id.train_language_model(docs.where(~held).select("text", "lang"))
    return language_id.predict_language(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_hnsw_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_hnsw.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "posterior")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = id_fold(F.col("doc_id"), 5) == 0
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).where(~held)
    sample = quality_classifier.sample_labels(labels)  # train_docs ids in expectation
    model = quality_classifier.train_classifier(docs.join(F.broadcast(sample), "doc_id"))
    return quality_classifier.score_quality(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.codec_report(table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix_report(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_report(table(spark, sf_dir, "conversations"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_report(table(spark, sf_dir, "documents"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.token_report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_language_id, op2_simhash_dedup, op3_hnsw_neighbours, op4_quality_rules, op5_quality_classifier,
    op6_lm_scoring, op7_sentencepiece, op8_source_mixing, op9_sharding, op10_line_dedup,
    op11_prefix_trie, op12_periodic_runs, op13_token_files)}
ORACLES: dict[str, str] = {
    "op8_source_mixing": source_mixing.REPORT_SQL.strip(),
    "op10_line_dedup": line_dedup.REPORT_SQL.strip(),
    "op11_prefix_trie": prefix_trie.REPORT_SQL.strip(),
}
