"""Mixing and sharding against brute force."""

from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsieve.llm import sharding, source_mixing

from .helpers import SCHEMA, documents, empty, rows


def slow_targets(sizes, weights=(5, 2, 1)):
    """Water-filling by repeated resharing, in exact fractions."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, target = Fraction(sum(sizes.values())), {}
    while True:
        left = total - sum(target.values())
        open_ = [s for s in names if s not in target]
        full = [s for s in open_ if left * weight[s] > 3 * sizes[s] * sum(weight[x] for x in open_)]
        if not full:
            share = sum(weight[x] for x in open_)
            return {**target, **{s: left * weight[s] / share for s in open_}}
        target.update({s: Fraction(3 * sizes[s]) for s in full})


def test_targets_match_resharing(spark):
    for sizes in ({"a": 1000, "b": 10, "é": 500, "z": 3, None: 40}, {"x": 0, None: 0}, {"q": 5},
                  {"A": 1, "B": 1, "C": 10_000, "a": 700}):
        frame = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        found = {r["source"]: r["target"] for r in source_mixing.source_targets(frame).collect()}
        assert found == pytest.approx({k: float(v) for k, v in slow_targets(sizes).items()}, rel=1e-12)


def test_mix_takes_near_the_target(spark):
    table = [(i, "w " * (1 + i * 7919 % 60), None, ["a", "b", None, "c"][0 if i % 3 else i % 4], 1, 0.0, "", i)
             for i in range(900)]
    report = source_mixing.mix_report(spark.createDataFrame(table, SCHEMA))
    found = report.collect()
    assert sorted(found) == sorted(report.collect())
    by = defaultdict(lambda: [0, 0.0])
    source = {t[0]: t[3] for t in table}
    for r in found:
        by[source[r["doc_id"]]][0] += r["taken"]
        by[source[r["doc_id"]]][1] = r["target"]
        assert r["taken"] <= 3 * r["size"] and r["taken"] % r["size"] == 0
    assert all(abs(taken / target - 1) < 0.05 for taken, target in by.values())


def test_mixed_rows_follow_the_report(spark):
    docs = documents(spark)
    report = source_mixing.mix_report(docs).collect()
    assert len(report) == len(rows())
    assert all(r["size"] == 0 and r["taken"] == 0 for r in report if r["doc_id"] in (3, 4, 5, 16))
    mixed = source_mixing.mix(docs)
    assert mixed.columns == docs.columns
    times = Counter(tuple(r) for r in mixed.collect())
    assert set(times) <= set(rows())
    repeated = Counter(rows())
    dealt = defaultdict(list)
    for r in report:
        dealt[r["doc_id"]].append(r["copies"])
    for row, n in repeated.items():
        if len(dealt[row[0]]) == 1:
            assert times[row] == n * dealt[row[0]][0]
    assert source_mixing.mix_report(empty(spark)).count() == 0 and source_mixing.mix(empty(spark)).count() == 0


def test_difference_beats_a_greedy_deal():
    rng = np.random.default_rng(3)
    for parts in (2, 5, 40):
        sizes = rng.integers(1, 10_000, 1500).tolist()
        part = sharding.difference(sizes, parts)
        sums = np.bincount(part, weights=sizes, minlength=parts)
        greedy = np.zeros(parts)
        for s in sorted(sizes, reverse=True):
            greedy[greedy.argmin()] += s
        assert sums.sum() == sum(sizes) and np.ptp(sums) <= np.ptp(greedy) and np.ptp(sums) <= 10
    assert sharding.difference([], 3).tolist() == []
    assert sorted(sharding.difference([5, 4, 3], 3).tolist()) == [0, 1, 2]
    assert np.bincount(sharding.difference([4, 5, 6, 7, 8], 2), weights=[4, 5, 6, 7, 8]).tolist() in ([16, 14], [14, 16])


@pytest.mark.parametrize("chunk", [64, 512, 8192])
def test_shards_are_whole_and_even(spark, chunk):
    rng = np.random.default_rng(5)
    table = [(i, "x" * int(rng.integers(0, 900)) + str(i % 700), None, None, None, None, None, None) for i in range(1500)]
    table += [(5000 + i, "the same text", None, None, None, None, None, None) for i in range(40)]
    found = sharding.shard_documents(spark.createDataFrame(table, SCHEMA), shards=8, chunk=chunk).collect()
    assert len(found) == len(table)
    text = {t[0]: t[1] for t in table}
    places, sums, slots = defaultdict(set), Counter(), defaultdict(list)
    for r in found:
        places[text[r["doc_id"]]].add(r["shard"])
        sums[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert r["size"] == len(text[r["doc_id"]].encode()) + 16
    assert all(len(s) == 1 for s in places.values())
    assert set(sums) == set(range(8)) and max(sums.values()) - min(sums.values()) <= 0.01 * max(sums.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_more_texts_than_one_round_of_bundles_takes(spark):
    """Above 836,000 distinct texts every class is still differenced."""
    n = 900_000
    size = F.floor(F.exp(6 + 3 * F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000)).cast("long")
    groups = spark.range(n).select(F.unhex(F.md5(F.col("id").cast("string").cast("binary"))).alias("item"), size.alias("bytes"))
    total = sharding.assign_groups(groups, 40).join(groups, "item").groupBy("shard").agg(
        F.sum("bytes").alias("b"), F.count("item").alias("k")).collect()
    sums = [r["b"] for r in total]
    assert len(sums) == 40 and sum(r["k"] for r in total) == n and max(sums) - min(sums) <= 100


def test_shards_of_odd_rows(spark):
    import zlib

    found = sharding.shard_documents(documents(spark)).collect()
    assert len(found) == len(rows())
    crc = Counter((r[0], zlib.crc32((r[1] or "").encode())) for r in rows())
    assert Counter((r["doc_id"], r["text_crc32"]) for r in found) == crc
    nothing = {r["shard"] for r in found if r["text_crc32"] == 0}
    assert len(nothing) == 1 and all(0 <= r["shard"] < 40 and r["law"] == "bytes" for r in found)
    assert sharding.shard_documents(empty(spark)).count() == 0


def test_repeated_rows_add_up_to_the_report(spark):
    table = [(None, "two words", None, "a", 9, 0.0, "", 0)] * 3000 + [(7, "three words here", None, "a", 16, 0.0, "", 1)] * 5
    table += [(100 + i, "w " * 40, None, "b", 80, 0.0, "", 2) for i in range(2000)]
    docs = spark.createDataFrame(table, SCHEMA).repartition(6)
    report = Counter()
    for r in source_mixing.mix_report(docs, weights=(1, 9)).collect():
        report[r["doc_id"]] += r["copies"]
    mixed = Counter(r["doc_id"] for r in source_mixing.mix(docs, weights=(1, 9)).select("doc_id").collect())
    assert report[None] % 3000 and mixed == +report
