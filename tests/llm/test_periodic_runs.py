"""Periodic runs: extensions, runs and the report against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tabsieve.llm import periodic_runs

from .helpers import SCHEMA, documents, empty, rows


def slow_runs(words, least=24, times=3):
    n, best = len(words), {}
    for p in range(1, n // times + 1):
        s = 0
        while s + p < n:
            e = s
            while e + p < n and words[e] == words[e + p]:
                e += 1
            if e > s and e - s + p >= max(least, times * p):
                best.setdefault((s, e - s + p), p)
            s = e + 1
    return sorted(((s, n, p) for (s, n), p in best.items()), key=lambda r: (r[0], r[2]))


def slow_words(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def slow_report(doc_id, text):
    words = slow_words(doc_id, text)
    runs = slow_runs(words)
    dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    digest = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
    kept = hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest, kept)


def periodic(seed):
    """Words of a few letters with repeated stretches, so that runs meet, nest and touch the ends."""
    rng = random.Random(seed)
    n, letters = rng.choice([0, 1, 23, 24, 25, 70, 300, 900]), rng.choice([1, 2, 3, 60])
    words = [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        if n > 9:
            a, p = rng.randrange(n), rng.randrange(1, n // 3 + 1)
            for i in range(a + p, min(n, a + rng.randrange(2 * p, 7 * p))):
                words[i] = words[i - p]
    return words


def test_cover_holds_every_difference():
    c = periodic_runs.COVER
    assert sorted((a - b) % periodic_runs.CYCLE for a in c for b in c if a != b) == list(range(1, periodic_runs.CYCLE))


@pytest.mark.parametrize("seed", range(8))
def test_extensions(seed):
    docs = [np.array(periodic(9 * seed + k), dtype=np.int64) + 1 for k in range(9)]
    counts = np.array([len(d) for d in docs])
    padded, base, doc_of = periodic_runs._layout(np.concatenate(docs), counts)
    common = periodic_runs.CommonExtensions(padded, doc_of)
    rng = np.random.default_rng(seed)
    for d in np.flatnonzero(counts > 1):
        i, j = np.sort(rng.integers(0, counts[d], size=(2, 200)), axis=0)
        i, j = i[i < j], j[i < j]
        w = docs[d].tolist()
        expected = [next((t for t in range(len(w) - b) if w[a + t] != w[b + t]), len(w) - b) for a, b in zip(i, j)]
        assert common(base[d] + i, base[d] + j).tolist() == expected


@pytest.mark.parametrize("least,times", [(24, 3), (6, 2), (100, 4), (1, 3)])
def test_runs_match_brute_force(least, times, monkeypatch):
    for seed in range(60):
        docs = [periodic(1000 * seed + k) for k in range(seed % 5)]
        words = np.array([w + 1 for d in docs for w in d], dtype=np.int64)
        if seed % 2:
            monkeypatch.setattr(periodic_runs, "POINTS", 64)  # many small steps over the grid
        found = periodic_runs.find_runs(words, np.array([len(d) for d in docs], dtype=np.int64), least, times)
        assert found.tolist() == [[k, *r] for k, d in enumerate(docs) for r in slow_runs(d, least, times)]


def test_report_matches_brute_force(spark):
    more = [(1000 + k, " ".join(f"w{w}" for w in periodic(k)), None, None, None, None, None, None) for k in range(120)]
    docs = documents(spark).union(spark.createDataFrame(more, SCHEMA))
    found = sorted(map(tuple, periodic_runs.run_report(docs).collect()), key=str)
    expected = sorted((slow_report(r[0], r[1]) for r in rows() + more), key=str)
    assert found == expected and sum(r[1] for r in found) > 20


def test_runs_and_text_of_the_operator(spark):
    text = "start " + "x\ty  z\n" * 9 + "end"
    docs = spark.createDataFrame([(text, 5, "own"), (None, None, None)], "text string, runs int, collapsed string")
    out = {r["row"]["runs"]: r for r in periodic_runs.collapse_runs(docs).collect()}
    assert [tuple(r) for r in out[5]["runs"]] == [(1, 27, 3)] and out[5]["collapsed"] == "start x y z end"
    assert out[5]["row"]["collapsed"] == "own" and out[None]["runs"] == [] and out[None]["collapsed"] == ""
    assert periodic_runs.run_report(empty(spark)).count() == 0


def test_very_long_texts():
    one = "same " * 300_000
    block = " ".join(str(i) for i in range(500))
    other = " ".join(str(i * 7919 % 1_000_003) for i in range(200_000))
    runs, texts = periodic_runs._collapse([t.encode() for t in (one, block + (" " + block) * 40, other)], 24, 3)
    assert runs.tolist() == [[0, 0, 300_000, 1], [1, 0, 41 * 500, 500]]
    assert texts == [b"same", block.encode(), other.encode()]
