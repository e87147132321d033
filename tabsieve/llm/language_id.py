"""Language identification by word-first backoff.

A known word scores by its log frequency in each language. An unseen word
falls back to its character 5-grams, and on to shorter ones while fewer than
half of them are known. The language with the largest summed log probability
wins.

The tables are fitted on a bounded sample of each language's labelled rows (all
of them up to ``train_docs``, else that many in expectation, chosen by a hash of
the row), so a rare language is learned however large the others are. They hold
the most frequent ``max_words`` words a language: all other words are what the
backoff is for.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsieve.llm.common import slices

ORDERS = (5, 4, 3, 2, 1)
UNKNOWN = "und"
TOKEN = re.compile(r"[^\W\d_]+")
SAMPLE_UNITS = 1 << 20


@dataclass
class LanguageModel:
    """Languages in rising order, a log-probability row per known word, and a
    table of rows for each n-gram order."""

    languages: list[str]
    words: dict[str, tuple[float, ...]] = field(default_factory=dict)
    grams: dict[int, dict[str, tuple[float, ...]]] = field(default_factory=dict)

    def unseen(self, word: str) -> np.ndarray:
        """Mean row of the longest character n-grams that are known well enough."""
        padded = f" {word} "
        best: list[tuple[float, ...]] = []
        for n in ORDERS:
            table = self.grams.get(n, {})
            parts = [padded[i:i + n] for i in range(len(padded) - n + 1)]
            known = [table[g] for g in parts if g in table]  # never the space alone
            if known and 2 * len(known) >= len(parts):
                return np.mean(known, axis=0)
            best = best or known
        return np.mean(best, axis=0) if best else np.zeros(len(self.languages))


def _rows(counts: dict[str, np.ndarray], languages: int) -> dict[str, tuple[float, ...]]:
    """Per entry the log posterior of each language under equal priors."""
    total = sum(counts.values()) if counts else np.zeros(languages)
    out = {}
    for key, c in counts.items():
        log = np.log((c + 0.5) / (total + 0.5 * len(counts)))
        top = log.max()
        out[key] = tuple((log - top - np.log(np.exp(log - top).sum())).tolist())
    return out


def build_model(word_counts: list[tuple[str, str, int]]) -> LanguageModel:
    """``(language, word, count)`` -> model. A word weighs one plus the log of
    its count in the n-gram tables, which stand for rare words."""
    languages = sorted({lang for lang, _, _ in word_counts})
    at = {lang: i for i, lang in enumerate(languages)}
    words: dict[str, np.ndarray] = {}
    grams: dict[int, dict[str, np.ndarray]] = {n: {} for n in ORDERS}
    for lang, word, count in word_counts:
        words.setdefault(word, np.zeros(len(languages)))[at[lang]] += count
        padded, weight = f" {word} ", 1 + np.log(count)
        for n in ORDERS:
            for i in range(len(padded) - n + 1):
                grams[n].setdefault(padded[i:i + n], np.zeros(len(languages)))[at[lang]] += weight
    grams[1].pop(" ", None)
    k = len(languages)
    return LanguageModel(languages, _rows(words, k), {n: _rows(g, k) for n, g in grams.items()})


def train_language_model(labelled: DataFrame, train_docs: int = 20_000, max_words: int = 8_000) -> LanguageModel:
    """Fits on ``text, lang`` rows; rows with a null in either are left out.
    Without any labelled row the model knows no language."""
    rows = labelled.where("text is not null and lang is not null").select("text", "lang")
    rates = rows.groupBy("lang").agg((F.lit(SAMPLE_UNITS * train_docs) / F.count(F.lit(1))).alias("below"))
    draw = F.pmod(F.xxhash64("text", "lang", F.monotonically_increasing_id()), F.lit(SAMPLE_UNITS))
    rows = rows.withColumn("draw", draw).join(F.broadcast(rates), "lang")  # one row per language
    rows = rows.where("draw < below").select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                found: dict[str, Counter] = {}
                for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                    found.setdefault(lang, Counter()).update(TOKEN.findall(text.lower()))
                flat = [(lang, w, c) for lang, words in found.items() for w, c in words.items()]
                cols = list(zip(*flat, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()),
                                                  pa.array(cols[2], pa.int64())], ["lang", "word", "n"])

    counts = rows.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(
        F.sum("n").alias("n")).where("length(word) <= 64")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= max_words).select("lang", "word", "n")
    return build_model(sorted((r["lang"], r["word"], int(r["n"])) for r in top.collect()))


REMEMBER_BYTES = 32 << 20


class Scorer:
    """Scores texts with one model; remembers the rows of words met before."""

    def __init__(self, model: LanguageModel, remember: int = 300_000, evidence: int = 16) -> None:
        self.model, self.remember, self.evidence = model, remember, evidence
        self._reset()

    def _reset(self) -> None:
        scorer, model, self.bytes = self, self.model, 0

        class Places(dict):
            def __missing__(self, word: str) -> int:
                place = self[word] = len(self)
                scorer.bytes += 4 * len(word)
                if place == len(scorer.rows):
                    scorer.rows = np.concatenate([scorer.rows, np.zeros_like(scorer.rows)])
                row = model.words.get(word)
                scorer.rows[place] = model.unseen(word) if row is None else row
                return place

        self.places, self.rows = Places(), np.zeros((1 << 14, len(model.languages)))

    def predict(self, text: str) -> tuple[str, float]:
        words = TOKEN.findall(text.lower())
        if not self.model.languages or not words or not any(c.isalpha() for w in words for c in w):
            return UNKNOWN, 0.0
        if len(self.places) > self.remember or self.bytes > REMEMBER_BYTES:
            self._reset()
        places = np.fromiter(map(self.places.__getitem__, words), dtype=np.int64, count=len(words))
        # words depend on each other: count at most ``evidence`` of them as independent
        logs = self.rows[places].sum(axis=0) * min(1.0, self.evidence / len(words))
        share = np.exp(logs - logs.max())
        best = int(np.argmax(logs))
        return self.model.languages[best], float(share[best] / share.sum())


def predict_language(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score`` per row, from the
    whole text alone. ``und`` with score 0 where the text is null or holds no
    letter, or the model knows no language; ties go to the first language by
    code point."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by max_words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for whole in batches:
            for batch in slices(whole):
                pairs = [scorer.predict(t or "") for t in batch.column("text").to_pylist()]
                cols = [batch.column(c) for c in keep]
                cols += [pa.array([p for p, _ in pairs], pa.string()), pa.array([s for _, s in pairs], pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, [*keep, "lang_pred", "score"])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(
        run, ", ".join([*kinds, "lang_pred string", "score double"]))


def language_of(docs: DataFrame, model: LanguageModel) -> Callable[[Column], Column]:
    """The same prediction as a function from a text column to a struct of
    ``lang_pred`` and ``score``, for callers that keep their other columns on
    the JVM side."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pd.DataFrame([scorer.predict(t or "") for t in batch], columns=["lang_pred", "score"])

    return run
