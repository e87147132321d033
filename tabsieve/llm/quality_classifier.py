"""Quality classifier: hashed word n-grams, logistic regression trained with
follow-the-regularised-leader updates, scored as sparse dot products.

Labels are few next to documents: a bounded sample of labelled ids
(``train_docs`` in expectation, by a hash of the id) is joined to the texts,
so no text is shuffled. Its hashed features are dealt into ``lanes``; each
epoch every lane runs FTRL over its rows from the shared state, and the state
is averaged. State size is fixed by ``bits``, whatever the corpus holds.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.llm.common import slices, texts
from tabsieve.plans.lineage import materialize

BITS = 18
MIX = np.uint64(0x9E3779B97F4A7C15)
ALPHA, BETA, L1, L2 = 2.0, 0.1, 1e-3, 1e-3
DRAW = 1 << 20


def features(text: bytes, bits: int = BITS) -> np.ndarray:
    """Distinct hashed word unigrams and bigrams, and the bias slot last."""
    words = text.split()
    h = np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words))
    pairs = h[:-1] * np.uint64(1_000_003) + h[1:] + np.uint64(1 << 33)
    slots = (np.concatenate([h, pairs]) * MIX) >> np.uint64(64 - bits)
    return np.append(np.unique(slots).astype(np.int32), np.int32(1 << bits))


def values(slots: np.ndarray) -> np.ndarray:
    """Unit-length weights of the n-grams, and one for the bias."""
    x = np.full(len(slots), 1.0 / np.sqrt(max(1, len(slots) - 1)))
    x[-1] = 1.0
    return x


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The regularised leader of a state."""
    return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)


def ftrl(rows: list[tuple[np.ndarray, int]], z: np.ndarray, n: np.ndarray) -> None:
    """One pass over ``(slots, label)`` rows; updates the state in place."""
    for slots, label in rows:
        x = values(slots)
        zs, ns = z[slots], n[slots]
        w = weights(zs, ns)
        g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        grown = ns + g * g
        z[slots] = zs + g - (np.sqrt(grown) - np.sqrt(ns)) / ALPHA * w
        n[slots] = grown


def train_classifier(labelled: DataFrame, epochs: int = 6, lanes: int = 8, bits: int = BITS) -> np.ndarray:
    """Weights (bias last) from ``doc_id, text, label`` rows; null labels are
    left out. Without rows all weights are zero, which scores 0.5."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                packed = [features(t, bits).tobytes() for t in texts(batch.column("text"))]
                yield pa.RecordBatch.from_arrays([batch.column("lane"), batch.column("rank"), batch.column("label"),
                                                  pa.array(packed, pa.binary())], ["lane", "rank", "label", "slots"])

    order = F.xxhash64(F.col("doc_id").cast("string"), "text")
    rows = labelled.where("label is not null").select(
        "text", F.col("label").cast("int").alias("label"), order.alias("rank"), F.pmod(order, F.lit(lanes)).alias("lane"))
    rows = materialize(rows.mapInArrow(extract, "lane long, rank long, label int, slots binary"))
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    spark = labelled.sparkSession

    def lane_pass(state: Broadcast) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(lane: pd.DataFrame) -> pd.DataFrame:
            mine = [np.array(a) for a in state.value]
            lane = lane.sort_values(["rank", "label"])
            ftrl([(np.frombuffer(s, np.int32), y) for s, y in zip(lane["slots"], lane["label"], strict=True)], *mine)
            return pd.DataFrame({"z": [mine[0].astype(np.float32).tobytes()],
                                 "n": [mine[1].astype(np.float32).tobytes()], "rows": [len(lane)]})

        return run

    for _ in range(epochs):
        step = lane_pass(spark.sparkContext.broadcast((z, n)))  # 2 ** bits numbers
        made = rows.groupBy("lane").applyInPandas(step, "z binary, n binary, rows long").collect()  # a row per lane
        if not made:
            break
        share = np.array([r["rows"] for r in made], dtype=float)
        share /= share.sum()
        z = sum(s * np.frombuffer(r["z"], np.float32).astype(float) for s, r in zip(share, made, strict=True))
        n = sum(s * np.frombuffer(r["n"], np.float32).astype(float) for s, r in zip(share, made, strict=True))
    return weights(z, n)


def sample_labels(labels: DataFrame, train_docs: int = 12_000) -> DataFrame:
    """``doc_id, label``: one label per non-null id (the larger share of its
    rows, ties to 1), about ``train_docs`` of them in all."""
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(
        (F.avg("label") >= 0.5).cast("int").alias("label"))
    total = known.count()
    if total > train_docs:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(DRAW)) < int(DRAW * train_docs / total))
    return known


def score_quality(docs: DataFrame, model: np.ndarray, threshold: float = 0.3) -> DataFrame:
    """``doc_id, score, predicted`` per document from its whole text alone.
    Null and empty texts score by the bias; repeated rows and null ids stay;
    other columns are not read."""
    bits = (len(model) - 1).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for whole in batches:
            for batch in slices(whole):
                margin = []
                for text in texts(batch.column("text")):
                    slots = features(text, bits)
                    margin.append(w[slots[:-1]].sum() / np.sqrt(max(1, len(slots) - 1)) + w[-1])
                score = 1.0 / (1.0 + np.exp(-np.clip(np.array(margin), -35, 35)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())],
                                                 ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
