"""Maximal periodic runs of words, found through longest common extensions.

A run with period p repeats for so long that a grid of fixed step must meet it:
where words p apart agree at a grid point, the common extensions of the two
positions to the right and to the left give the run's ends. The grids of all
periods together have about n log n points, a harmonic sum.

Extensions are answered by a difference cover: only positions whose residue
lies in the cover are sorted as suffixes. Two positions reach a pair of sorted
ones within ``CYCLE`` words, which are compared directly; from there the answer
is the minimum of a stretch of the array of neighbours' common prefixes, read
from a sparse table. The sort refines groups by the next words, then doubles.
Texts without a pair of positions that matches so far are never sorted.

Everything is numpy over a batch of documents laid out in one array, and one
document stays in one task; there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsieve.llm.common import WORD, slices, texts

# every difference modulo 31 occurs once between two of these residues
CYCLE, COVER = 31, (1, 5, 11, 24, 25, 27)
PAD = CYCLE + 1  # zeros behind each document: extensions end there
POINTS = 1 << 21  # grid points looked at in one go
GRAM = 4  # words that a grid point compares at once, by hash
RUN = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _shifts() -> np.ndarray:
    """Smallest step that takes two residues into the cover together."""
    inside = np.isin(np.arange(3 * CYCLE) % CYCLE, COVER)
    a, b = np.meshgrid(np.arange(CYCLE), np.arange(CYCLE), indexing="ij")
    both = np.stack([inside[a + s] & inside[b + s] for s in range(CYCLE)])
    return both.argmax(axis=0).ravel()


SHIFT = _shifts()


def _ahead(words: np.ndarray, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Equal words from i and j on, counted up to ``limit``."""
    out = limit.copy()
    alive = np.flatnonzero(limit > 0)
    t = 0
    while len(alive):
        differ = words[i[alive] + t] != words[j[alive] + t]
        out[alive[differ]] = t
        t += 1
        alive = alive[~differ]
        alive = alive[limit[alive] > t]
    return out


class CommonExtensions:
    """Longest common extensions inside documents laid out in one array, each
    followed by ``PAD`` zeros; words are positive numbers."""

    def __init__(self, words: np.ndarray, doc_of: np.ndarray):
        self.words = words
        self.at = at = np.flatnonzero(np.isin(np.arange(len(words)) % CYCLE, COVER) & (words > 0))
        self.index = np.full(len(words), -1, dtype=np.int32)
        self.index[at] = np.arange(len(at))
        order = np.arange(len(at))
        rank = np.searchsorted(doc_of[at], doc_of[at]).astype(np.int64)  # a document is a group at first
        levels = []  # ranks by the first CYCLE * 2 ** k words

        def refine(keys_of) -> bool:
            sizes = np.bincount(rank, minlength=len(at))
            open_at = np.flatnonzero(sizes[rank[order]] > 1)
            if not len(open_at):
                return False
            samples = order[open_at]
            keys = [rank[samples], *keys_of(samples)]
            by = np.lexsort(keys[::-1])
            samples = samples[by]
            order[open_at] = samples
            new = np.zeros(len(by), dtype=bool)
            new[:1] = True
            for key in keys:
                key = key[by]
                new[1:] |= key[1:] != key[:-1]
            heads = np.flatnonzero(new)
            rank[samples] = np.repeat(open_at[heads], np.diff(np.append(heads, len(by))))
            return True

        for off in range(0, CYCLE, 4):
            wide = range(off, min(off + 4, CYCLE))
            if not refine(lambda s: [words[at[s] + o] for o in wide]):
                break
        levels.append(rank.astype(np.int32))
        step = CYCLE
        while refine(lambda s: [np.where(self.index[at[s] + step] >= 0, rank[self.index[at[s] + step]], -1)]):
            levels.append(rank.astype(np.int32))
            step *= 2
        self.rank = rank
        self.table = self._minima(order, doc_of, levels)

    def _minima(self, order: np.ndarray, doc_of: np.ndarray, levels: list[np.ndarray]) -> list[np.ndarray]:
        """Sparse table over the common prefixes of neighbours in the order."""
        at, index = self.at, self.index
        i, j = at[order[:-1]].copy(), at[order[1:]].copy()
        common = np.zeros(len(i), dtype=np.int64)
        live = np.flatnonzero(doc_of[i] == doc_of[j])
        for k in range(len(levels) - 1, -1, -1):
            a, b = index[i[live]], index[j[live]]
            same = live[(a >= 0) & (b >= 0) & (levels[k][a] == levels[k][b])]
            for moved in (common, i, j):
                moved[same] += CYCLE << k
        common[live] += _ahead(self.words, i[live], j[live], np.full(len(live), CYCLE))
        table = [common.astype(np.int32)]
        while 2 << (len(table) - 1) <= len(common):
            last, half = table[-1], 1 << (len(table) - 1)
            table.append(np.minimum(last[:-half], last[half:]))
        return table

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common extension of position pairs i < j of one document each."""
        shift = SHIFT[i % CYCLE * CYCLE + j % CYCLE]
        out = _ahead(self.words, i, j, shift)
        far = np.flatnonzero(out == shift)
        a, b = i[far] + shift[far], j[far] + shift[far]
        same = self.words[a] == self.words[b]
        far, a, b = far[same], self.rank[self.index[a[same]]], self.rank[self.index[b[same]]]
        lo, width = np.minimum(a, b), np.abs(a - b)
        level = np.frexp(width.astype(np.float64))[1] - 1  # floor of the binary logarithm
        for k in np.unique(level).tolist():
            here = np.flatnonzero(level == k)
            row = self.table[k]
            out[far[here]] += np.minimum(row[lo[here]], row[lo[here] + width[here] - (1 << k)])
        return out


def _layout(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents with ``PAD`` zeros behind each; their bases and, per cell, document."""
    base = np.cumsum(counts + PAD) - counts - PAD
    padded = np.zeros(int((counts + PAD).sum()), dtype=np.int64)
    doc_of = np.repeat(np.arange(len(counts)), counts + PAD)
    padded[np.arange(len(words)) + np.repeat(np.arange(len(counts)) * PAD, counts)] = words
    return padded, base, doc_of


def _grid_hits(padded: np.ndarray, base: np.ndarray, counts: np.ndarray, least: int, times: int,
               ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``doc, position, period`` of grid points where the next words and those
    a period on agree (by hash), for all periods a run can have."""
    if not len(counts):
        return
    top = np.where(counts >= least, counts // times, 0)
    p_all = np.arange(1, int(top.max()) + 1)
    if not len(p_all):
        return
    reach = np.maximum((times - 1) * p_all, least - p_all)  # words of a run that have an equal a period on
    gram = int(max(1, min(GRAM, reach.min())))
    steps = reach - gram + 1
    grams = padded.astype(np.uint64)
    mixed = np.zeros(len(grams), dtype=np.uint64)
    for k in range(gram):
        mixed[:len(grams) - k] += (grams[k:] + np.uint64(1)) * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) % (1 << 64))
        mixed ^= mixed >> np.uint64(29)
    ends = np.cumsum(top)
    for t0 in range(0, int(ends[-1]), POINTS // 8):
        t = np.arange(t0, min(t0 + POINTS // 8, int(ends[-1])))
        doc = np.searchsorted(ends, t, side="right")
        p = t - (ends - top)[doc] + 1
        step = steps[p - 1]
        n_points = (counts[doc] - p - gram) // step + 1
        upto = np.cumsum(n_points)
        a = 0
        while a < len(t):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + POINTS, side="right")))
            n = n_points[a:b]
            first = np.cumsum(n) - n
            x = np.arange(int(n.sum()))
            x -= np.repeat(first, n)
            x *= np.repeat(step[a:b], n)
            x += np.repeat(base[doc[a:b]], n)
            y = x + np.repeat(p[a:b], n)
            hit = np.flatnonzero(mixed[x] == mixed[y])
            if len(hit):
                pair = np.searchsorted(first, hit, side="right") - 1 + a
                yield doc[pair], x[hit], p[pair]
            a = b


def find_runs(words: np.ndarray, counts: np.ndarray, least: int = 24, times: int = 3) -> np.ndarray:
    """Rows ``doc, start, length, period`` of all runs of ``least`` words and
    ``times`` periods or more, by document, start and period. ``words``:
    positive numbers of all documents in a row, ``counts`` of them each."""
    padded, base, _ = _layout(words, counts)
    found = [np.empty((0, 4), dtype=np.int64)]
    held: list[tuple] = []
    last: list = [np.empty(0, dtype=np.int64)]  # documents sorted last, with their samples

    def settle() -> None:
        """Extends the held grid points with the documents' sorted samples."""
        doc, x, p = (np.concatenate(c) for c in zip(*held))
        held.clear()
        docs, at = np.unique(doc, return_inverse=True)
        sizes = counts[docs]
        if not np.array_equal(docs, last[0]):  # a document with very many points comes here often
            own = [padded[base[d]:base[d] + counts[d]] for d in docs.tolist()]
            right, start, doc_of = _layout(np.concatenate(own), sizes)
            left, _, _ = _layout(np.concatenate([w[::-1] for w in own]), sizes)
            last[:] = [docs, start, CommonExtensions(right, doc_of), CommonExtensions(left, doc_of)]
        start = last[1]
        i = start[at] + x - base[doc]
        ahead = last[2](i, i + p)
        mirror = 2 * start[at] + sizes[at] - 1
        behind = last[3](mirror - i - p + 1, mirror - i + 1)
        first, length = x - base[doc] - behind, ahead + behind + p
        long = length >= np.maximum(least, times * p)
        found.append(np.unique(np.stack([doc, first, length, p], axis=1)[long], axis=0))

    for doc, x, p in _grid_hits(padded, base, counts, least, times):
        # what differs before the sorted samples are reached needs no sort
        near = np.full(len(x), CYCLE)
        ahead = _ahead(padded, x, x + p, near)
        behind = _behind(padded, x, p, base[doc])
        open_end = (ahead == CYCLE) | (behind == CYCLE)
        long = ahead + behind + p >= np.maximum(least, times * p)
        short = long & ~open_end
        found.append(np.stack([doc, x - base[doc] - behind, ahead + behind + p, p], axis=1)[short])
        if open_end.any():
            held.append((doc[open_end], x[open_end], p[open_end]))
            if sum(len(h[0]) for h in held) > POINTS:
                settle()
    if held:
        settle()
    runs = np.concatenate(found)
    # one stretch has one smallest period; its multiples met the grid too
    runs = runs[np.lexsort((runs[:, 3], runs[:, 2], runs[:, 1], runs[:, 0]))]
    fresh = np.ones(len(runs), dtype=bool)
    fresh[1:] = (runs[1:, :3] != runs[:-1, :3]).any(axis=1)
    runs = runs[fresh]
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def _behind(padded: np.ndarray, x: np.ndarray, p: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Equal words to the left of x and x + p, counted up to ``CYCLE``."""
    room = np.minimum(x - base, CYCLE)
    out = room.copy()
    alive = np.flatnonzero(room > 0)
    t = 1
    while len(alive):
        differ = padded[x[alive] - t] != padded[x[alive] + p[alive] - t]
        out[alive[differ]] = t - 1
        t += 1
        alive = alive[~differ]
        alive = alive[room[alive] >= t]
    return out


class _Numbers(dict):
    """Numbers words from 1 in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self) + 1
        return number


def _collapse(batch: list[bytes], least: int, times: int) -> tuple[np.ndarray, list[bytes]]:
    """Runs of a batch of texts, and the texts without the words after the
    first period of a run."""
    cut = [t.split() for t in batch]
    counts = np.array([len(c) for c in cut], dtype=np.int64)
    numbers = _Numbers()
    words = np.fromiter((numbers[w] for c in cut for w in c), dtype=np.int64, count=int(counts.sum()))
    runs = find_runs(words, counts, least, times)
    out = [b" ".join(c) for c in cut]
    bounds = np.searchsorted(runs[:, 0], np.arange(len(cut) + 1))
    for d in np.unique(runs[:, 0]).tolist():
        own = runs[bounds[d]:bounds[d + 1]]
        edge = np.zeros(len(cut[d]) + 1, dtype=np.int64)
        np.add.at(edge, own[:, 1] + own[:, 3], 1)
        np.add.at(edge, own[:, 1] + own[:, 2], -1)
        kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
        out[d] = b" ".join([cut[d][k] for k in kept.tolist()])
    return runs, out


def collapse_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """Every document with its runs of ``least`` words and ``times`` periods or
    more: ``row`` (all columns but ``text``), ``runs`` (start, length and
    smallest period in words, by start and period) and ``collapsed``, the
    words outside the repeats of a run joined by single spaces.

    A null, empty or blank text has no words, no runs and an empty
    ``collapsed``. Repeated rows and null ids stay as they are; clashing names
    stay inside ``row``. A text is never cut, however long: a worker holds the
    sorted samples of the documents of one 4 MB slice, or of one larger text."""
    names = [c for c in docs.columns if c != "text"]
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    kinds = docs.select(row, F.lit(None).cast(RUN).alias("runs"), F.lit("").alias("collapsed")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4 << 20):
                runs, collapsed = _collapse(texts(part.column(1)), least, times)
                bounds = np.searchsorted(runs[:, 0], np.arange(part.num_rows + 1))
                cells = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)],
                                                   ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), cells)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), lists, pc.cast(pa.array(collapsed, pa.binary()), pa.string())],
                    ["row", "runs", "collapsed"])

    return docs.select(row, "text").mapInArrow(run, T.StructType(kinds.fields))


def repeat_tails(text: Column, doc_id: Column) -> Column:
    """The text with a periodic tail where crc32(doc_id) mod 10 is 0 (a null id
    counts as the empty text): a test feature of the report."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, WORD.replace("[^", "[")), lambda w: w != "")

    def planted(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        moved = F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int"))))
        return F.when(n > 0, F.array_join(moved, " "))

    # the one-element array binds the words, so that they are cut once
    return F.when((h % 10 == 0) & text.isNotNull(), F.get(F.transform(F.array(words), planted), F.lit(0))).otherwise(text)


def run_report(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """Digest of :func:`collapse_runs` per document: the number of runs, the
    one with the greatest exponent (ties: smallest start, then period), and
    SHA-256 of all runs and of the collapsed text."""
    planted = docs.select("doc_id", repeat_tails(F.col("text"), F.col("doc_id")).alias("text"))
    runs = F.col("runs")
    nothing = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    best = F.aggregate(runs, nothing, lambda b, r: F.when(
        b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = collapse_runs(planted, least, times).select(
        F.col("row.doc_id").alias("doc_id"), F.size(runs).cast("long").alias("n_runs"), best.alias("best"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                      F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                      "runs_sha256", "collapsed_sha256")
