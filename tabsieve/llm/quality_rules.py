"""Quality rules under weak supervision.

Each rule votes good (+1), bad (-1) or abstains (0) on counts taken from the
whole text. Expectation-maximisation over all documents estimates how often
each rule is right on good and on bad documents, and the posterior probability
of good quality decides instead of "every rule must pass".

The corpus enters the estimation as counts per vote pattern: at most
3 ** len(RULES) rows whatever its size, so the iterations run on the driver
over a bounded table, and the posterior is a sum of learned weights that Spark
evaluates per row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsieve.llm.common import slices, texts
from tabsieve.plans.lineage import materialize

SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
_TAIL_BYTES = bytes(range(0x80, 0xC0))  # all but the first byte of a code point
_NOT_LETTERS = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122 or b >= 0xC0))
_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_SENTENCE_END = re.compile(rb"(?:[.!?:;\"')]|\xe2\x80[\x9c\x9d\xa6]|\xc2\xbb)[ \t\x0b\x0c\r]*(?:\n|\Z)")
_SYMBOL = re.compile(rb"[#*$%&|<>]")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper",
          "n_ended", "n_distinct", "n_symbol_lines")
RULES = ("length", "word_length", "symbols", "dup_lines", "repeats", "letters", "capitals", "sentences", "variety",
         "symbol_lines")


def repeated_words(ids: np.ndarray, distinct: int, window: int = 3) -> int:
    """Words inside windows that occur twice or more in the text."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    key = ids[:n].astype(np.int64)
    for k in range(1, window):
        if distinct >= 1 << 20:  # keep the combined number within 64 bits
            key = np.unique(key, return_inverse=True)[1]
        key = key * distinct + ids[k:k + n]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(n, dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(ids), dtype=bool)
    for k in range(window):
        covered[k:k + n] |= again
    return int(covered.sum())


def count_text(text: bytes) -> tuple[int, ...]:
    """:data:`COUNTS` of one UTF-8 text."""
    words = text.split()
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (len(words), len(text.translate(None, _SPACE + _TAIL_BYTES)),
            len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
            repeated_words(ids, len(number)), len(lines), len(text.translate(None, _NOT_LETTERS)),
            len(text.translate(None, _NOT_UPPER)), len(_SENTENCE_END.findall(text)), len(number),
            sum(_SYMBOL.search(x) is not None for x in lines))


def text_counts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and :data:`COUNTS` per document; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                rows = [count_text(t) for t in texts(batch.column("text"))]
                cols = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(COUNTS))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", *COUNTS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def votes() -> dict[str, Column]:
    """Rule name -> vote. Shares are compared without division, so an empty
    text needs no special case (it is bad by length, the rest abstain)."""
    n, chars, lines = F.col("n_words"), F.col("word_chars"), F.col("n_lines")
    return {
        "length": _vote(n >= 100, n < 20),
        "word_length": _vote((chars >= 3 * n) & (chars <= 10 * n) & (n > 0), (10 * chars < 25 * n) | (chars > 14 * n)),
        "symbols": _vote((n > 0) & (100 * F.col("n_symbols") <= 2 * n), 10 * F.col("n_symbols") > n),
        "dup_lines": _vote((lines > 1) & (10 * F.col("n_dup_lines") <= lines), 10 * F.col("n_dup_lines") > 3 * lines),
        "repeats": _vote((n >= 20) & (10 * F.col("n_repeat_words") <= 2 * n), 10 * F.col("n_repeat_words") > 5 * n),
        "letters": _vote((n > 0) & (100 * F.col("n_letters") >= 93 * chars), 10 * F.col("n_letters") < 8 * chars),
        "capitals": _vote((n > 0) & (10 * F.col("n_upper") <= 2 * F.col("n_letters")),
                          2 * F.col("n_upper") > F.col("n_letters")),
        "sentences": _vote((n > 0) & (2 * F.col("n_ended") >= lines), 10 * F.col("n_ended") < lines),
        "variety": _vote((n >= 20) & (10 * F.col("n_distinct") >= 3 * n), 10 * F.col("n_distinct") < n),
        "symbol_lines": _vote((lines > 0) & (10 * F.col("n_symbol_lines") <= lines),
                              2 * F.col("n_symbol_lines") > lines),
    }


def estimate(patterns: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns (rows of -1, 0, 1) with
    their counts. Returns the prior log odds of good and, per rule, the log
    odds that a good vote and a bad vote add. It starts from the all-must-pass
    filter that it replaces (kinds of bad text differ, so a majority vote would
    find the most frequent kind only), and each rule is then trusted as far as
    the other rules bear it out. Votes are smoothed by one document each way."""
    k = patterns.shape[1]
    up, down = patterns == 1, patterns == -1
    p = np.where(down.any(axis=1), 0.1, 0.9)
    prior, plus, minus = 0.0, np.zeros(k), np.zeros(k)
    for _ in range(rounds if weight.sum() else 0):
        good, bad = weight * p, weight * (1 - p)
        share = np.clip(good.sum() / weight.sum(), 0.02, 0.98)
        prior = float(np.log(share / (1 - share)))
        right_good = (good @ up + 1) / (good @ (up | down) + 2)  # P(good vote | good, votes)
        right_bad = (bad @ down + 1) / (bad @ (up | down) + 2)
        right_good, right_bad = np.clip(right_good, 0.005, 0.995), np.clip(right_bad, 0.005, 0.995)
        plus, minus = np.log(right_good / (1 - right_bad)), np.log((1 - right_good) / right_bad)
        p = 1.0 / (1.0 + np.exp(-np.clip(prior + up @ plus + down @ minus, -500, 500)))
    return prior, plus, minus


def judge_quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Counts, votes (``vote_<rule>``), ``base_failed``, ``posterior`` and
    ``kept`` per document.

    A null or empty text has no words and fails the base check. Repeated rows
    count in the estimation as often as they occur. An empty table gives an
    empty result. Only ``doc_id`` and ``text`` are read."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = text_counts(docs).select("doc_id", *COUNTS, *[v.alias(f"vote_{r}") for r, v in votes().items()],
                                    base.alias("base_failed"))
    rows = materialize(rows)
    names = [f"vote_{r}" for r in RULES]
    seen = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()  # 3 ** rules rows at most
    patterns = np.array([[r[c] for c in names] for r in seen], dtype=np.int64).reshape(len(seen), len(names))
    prior, plus, minus = estimate(patterns, np.array([r["n"] for r in seen], dtype=float))
    odds = F.lit(prior)
    for name, up, down in zip(names, plus, minus, strict=True):
        odds = odds + F.when(F.col(name) == 1, F.lit(float(up))).when(F.col(name) == -1, F.lit(float(down))).otherwise(
            F.lit(0.0))
    out = rows.withColumn("posterior", F.lit(1.0) / (F.lit(1.0) + F.exp(-odds)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
