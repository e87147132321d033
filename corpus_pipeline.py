"""Corpus pipeline: five stages over ``documents``, each one operator.

``run`` writes every stage's result as Parquet into the shared folder the
session names in ``spark.checkpoint.dir`` and reads it back as the next
stage's input, so a lost executor costs at most one stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsieve.llm import language_id, line_dedup, sentencepiece_codec, simhash_dedup, source_mixing
from tabsieve.plans.lineage import checkpoint_dir

LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised; rejected are texts that
    are null or without a letter, and texts that no learned language wins
    with at least half of the probability."""
    model = language_id.train_language_model(docs)
    names = [F.col(f"`{c}`") for c in docs.columns]
    found = language_id.language_of(docs, model)(F.col("row.text"))
    rows = docs.select(F.struct(*names).alias("row")).withColumn("found", found)
    kept = rows.where((F.col("found.lang_pred") != language_id.UNKNOWN) & (F.col("found.score") >= LEAST_SCORE))
    return kept.select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shared lines stay in one document only; ``n_chars`` follows the text.
    A null text stays null."""
    out = line_dedup.dedup_lines(docs)
    new = {"text": F.when(F.col("row.text").isNotNull(), F.col("kept"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = F.when(F.col("n_dropped") > 0, F.char_length("kept")).otherwise(F.col("row.n_chars"))
        new["n_chars"] = changed.cast(kind)
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: its smallest doc_id."""
    return simhash_dedup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return source_mixing.mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_pieces, ids`` of every mixed document."""
    return sentencepiece_codec.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

ORACLE_SQL = None  # trained language id, SimHash and Viterbi pieces are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    shared = checkpoint_dir(spark) or spark.conf.get("spark.sql.warehouse.dir")
    base = f"{shared.rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}-{name}")
        docs = spark.read.parquet(f"{base}/{i}-{name}")
    return docs
