"""Gram correlations, top and repeated values by key, duplicates in two phases,
exact splits with repeated keys, case folding."""

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsieve.functions.columns import casefold
from tabsieve.operators import eda, modeling, prepare, quality
from tabsieve.plans import gram


def test_correlations_of_many_columns_match_pandas(spark, monkeypatch):
    monkeypatch.setattr(gram, "BATCH_ROWS", 37)
    rng = np.random.default_rng(3)
    n, k = 400, 30
    data = rng.normal(size=(n, k)) @ rng.normal(size=(k, k)) + 1e6
    data[rng.random(size=data.shape) < 0.2] = np.nan
    data[:, 0], data[:, 1] = 7.25, np.nan  # constant, empty
    frame = pd.DataFrame(data, columns=[f"c.{i}" for i in range(k)])
    frame["whole"] = rng.integers(0, 9, n)
    df = spark.createDataFrame(frame).repartition(5)
    expected = frame.corr()
    out = eda.numeric_correlations(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan.split("MapInArrow")[-1]  # no row is exploded before the blocks
    found = {(r["column"], r["other_column"]): r["r"] for r in out.collect()}
    assert len(found) == (k + 1) * k
    for (a, b), r in found.items():
        if math.isnan(expected.loc[a, b]):
            assert r is None, (a, b, r)
        else:
            assert r == pytest.approx(expected.loc[a, b], abs=1e-9), (a, b)


def test_infinite_values_spoil_only_their_pairs(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, inf, None), (3.0, 1.0, 1.0), (4.0, 5.0, 2.0)], "a double, b double, c double")
    found = {(r["column"], r["other_column"]): r["r"] for r in eda.numeric_correlations(df).collect()}
    assert math.isnan(found["a", "b"]) and math.isnan(found["b", "a"])
    assert found["a", "c"] == pytest.approx(1.0) and found["b", "c"] == pytest.approx(1.0)
    assert eda.numeric_correlations(df.where("a > 9")).where("r is not null").count() == 0


def texts(n=500, seed=2):
    rng = random.Random(seed)
    return [(rng.choice(["hot"] * 9 + [None, " hot", "b", "c", "d", "ü"]), f"id{rng.randrange(10 ** 6)}",
             rng.choice("abcdefghijklmnop"), None) for _ in range(n)]


@pytest.mark.parametrize("tied", [eda.TIED_KEYS, 0])
def test_top_values_match_counting(spark, tied, monkeypatch):
    monkeypatch.setattr(eda, "TIED_KEYS", tied)
    rows = texts()
    df = spark.createDataFrame(rows, "`a.b` string, ident string, letter string, empty string").repartition(4)
    expected = set()
    for i, c in enumerate(df.columns):
        counts = Counter(r[i] for r in rows)
        order = sorted(counts.items(), key=lambda x: (-x[1], x[0] is None, x[0] or ""))[:5]
        expected |= {(c, v, n, k + 1, len([x for x in counts if x is not None])) for k, (v, n) in enumerate(order)}
    assert {tuple(r) for r in eda.categorical_top_values(df, 5).collect()} == expected


def test_repeated_values_by_frequency(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "a string, ident string, letter string, empty string").withColumn("n", F.lit(3))
    out = quality.duplicate_values(df, by_frequency=True).collect()
    expected = []
    for i, c in enumerate(["a", "ident", "letter", "empty"]):
        counts = Counter(r[i].strip() for r in rows if r[i] is not None)
        expected += [(c, v, k) for v, k in counts.items() if k > 1]
    expected.append(("n", "3", len(rows)))
    assert [tuple(r) for r in out] == sorted(expected, key=lambda r: (r[0], -r[2], r[1]))


@pytest.mark.parametrize("limit", [prepare.BROADCAST_KEYS, 0])
def test_duplicates_go_and_unique_rows_stay(spark, limit, monkeypatch):
    monkeypatch.setattr(prepare, "BROADCAST_KEYS", limit)
    rows = [(i % 40, None if i % 7 == 0 else f"t{i % 20}", {"k": i % 2}) for i in range(300)] + [(1000 + i, "x", None) for i in range(50)]
    df = spark.createDataFrame(rows, "a int, `b.c` string, m map<string, int>").repartition(3)
    out = prepare.remove_duplicates(df)
    assert out.columns == df.columns
    key = lambda r: (r[0], r[1] or "", str(r[2]))
    assert sorted(map(key, out.collect())) == sorted({key(r) for r in rows})
    unique = df.where("a >= 1000")
    assert prepare.remove_duplicates(unique).count() == 50


@pytest.mark.parametrize("buckets", [modeling.SPLIT_BUCKETS, 4])
def test_split_keeps_quotas_whatever_repeats(spark, buckets, monkeypatch):
    monkeypatch.setattr(modeling, "SPLIT_BUCKETS", buckets)
    for rows in ([(i, i % 2) for i in range(200)], [(7, i % 2) for i in range(200)],
                 [(i % 3, int(i % 10 == 0)) for i in range(400)]):
        df = spark.createDataFrame([(k, y, i) for i, (k, y) in enumerate(rows)], "k long, y int, row int").repartition(4)
        out = modeling.stratified_split(df, "y", ["k"])
        assert out.columns == [*df.columns, "split"]
        found = [(r["row"], r["y"], r["split"]) for r in out.collect()]
        assert sorted(r[0] for r in found) == list(range(len(rows)))
        counts = Counter(y for _, y in rows)
        plan = modeling.split_plan(dict(counts))
        got = Counter((y, s) for _, y, s in found)
        for y, (t, v) in plan.items():
            assert (got[y, "test"], got[y, "validation"]) == (t, v)
        again = {(r["row"], r["split"]) for r in modeling.stratified_split(df.repartition(2), "y", ["k"]).collect()}
        if len({k for k, _ in rows}) == len(rows):
            assert again == {(r, s) for r, _, s in found}


def test_too_many_classes_are_refused(spark, monkeypatch):
    monkeypatch.setattr(modeling, "MAX_CLASSES", 5)
    with pytest.raises(ValueError, match="classes"):
        modeling.stratified_split(spark.range(10).withColumn("y", F.col("id")), "y", ["id"])


def test_casefold_is_python_casefold(spark):
    rng = random.Random(9)
    special = [c for c in map(chr, range(0x2FFFF)) if c.casefold() != c.lower() and not 0xD800 <= ord(c) < 0xE000]
    words = ["straße", "STRASSE", "ΑΣ", "ας", "ﬁne", "İstanbul", "plain", "", "Ǆ", "µ", *special]
    words += ["".join(rng.choice(special + list("abcXYZ ")) for _ in range(6)) for _ in range(200)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for r in df.select("w", casefold("w").alias("f")).collect():
        assert r["f"] == r["w"].casefold(), ascii(r["w"])


def test_folded_spellings_are_one_group(spark):
    df = spark.createDataFrame([("straße",), ("STRASSE",), (" Strasse",), ("weg",)], "s string")
    folded = {r["variant"] for r in quality.categorical_inconsistencies(df, skip_markers=False).collect()}
    lowered = {r["variant"] for r in quality.categorical_inconsistencies(df).collect()}
    assert folded == {"straße", "STRASSE", " Strasse"} and lowered == {"STRASSE", " Strasse"}


def test_dotted_names_go_through(spark):
    df = spark.createDataFrame([(1.0, " a ", 1), (2.0, "a", 1), (None, None, 1), (900.0, "b", 1)] * 6,
                               "`avg.price` double, `the text` string, `k.v` int")
    assert {r["column"] for r in quality.missing_counts(df).collect()} == {"avg.price", "the text"}
    assert quality.dataset_health(df).first()["missing_cells"] == 12
    from tabsieve.operators import issues
    found = {r["issue_id"] for r in issues.issue_inventory(df).collect()}
    assert {"missing_values:avg.price", "categorical_inconsistency:the text", "constant_feature:k.v",
            "exact_duplicates:dataset"} <= found
    assert eda.numeric_summary(df).count() == 2
    assert quality.profile_headline(df).count() > 3
    out = prepare.trim_whitespace(prepare.impute_missing(df, "avg.price", "median"), "the text")
    assert out.where("`avg.price` is null or `the text` = ' a '").count() == 0


def test_fingerprint_code_stays_short_enough_to_compile(spark):
    """Java compiles no method of over 8,000 bytes; a table of many numbers kept
    the fingerprint of every row in the interpreter."""
    import re
    from tabsieve.sources.tables import content_fingerprint
    df = spark.range(5).select(*[(F.col("id") * 1.5 + i).alias(f"x{i}") for i in range(12)], F.col("id").cast("string").alias("t"))
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        shown = spark.sparkContext._jvm.PythonSQLUtils.explainString(
            content_fingerprint(df)._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", shown)]
    assert sizes and max(sizes) < 8000


def test_spellings_are_folded_without_a_regex_over_all_rare_letters(spark):
    """A class of all special letters is tried letter by letter on every text,
    and took most of the time; each row is folded once."""
    df = spark.createDataFrame([("Stra\u00dfe",), ("STRASSE ",), ("Weg",), ("\u0149a",), ("\u02bcna",), (None,)], "s string")
    found = quality.categorical_inconsistencies(df, skip_markers=False)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and "folded" in plan
    assert sorted((r["normalized"], r["variant"], r["n_variants"]) for r in found.collect()) == [
        ("strasse", "STRASSE ", 2), ("strasse", "Stra\u00dfe", 2), ("\u02bcna", "\u0149a", 2), ("\u02bcna", "\u02bcna", 2)]
