"""Quality checks on the literal fixtures of the reference's tests."""

import pytest
from pyspark.sql import functions as F

from tabsieve.operators import quality


def as_dict(df, key="column", value="n"):
    return {r[key]: r[value] for r in df.collect()}


def test_null_like_counts(spark):
    df = spark.createDataFrame(
        [("C1", "Consumer", "Active", 100.0), ("C2", "", "NA", None), ("C3", "  ", "null", 200.0),
         ("C4", "N/A", "Inactive", 300.0)],
        "customer_id string, segment string, status string, value double")
    assert as_dict(quality.missing_counts(df)) == {"segment": 3, "status": 2, "value": 1}


def test_duplicate_rows(spark):
    df = spark.createDataFrame([("C001", 100), ("C002", 200), ("C002", 200), ("C003", 300)],
                               "customer_id string, value int")
    assert quality.duplicate_row_count(df).first()["duplicate_rows"] == 1


def test_duplicate_values(spark):
    df = spark.createDataFrame([("C001",), ("C002",), ("C002",), ("C003",), ("C003",), ("C003",)],
                               "customer_id string")
    assert as_dict(quality.duplicate_values(df, ["customer_id"]), "value") == {"C002": 2, "C003": 3}


def test_categorical_variants(spark):
    df = spark.createDataFrame([("Consumer",), ("consumer",), (" Consumer ",), ("Business",), ("business",)],
                               "segment string")
    rows = quality.categorical_inconsistencies(df).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["normalized"], set()).add(r["variant"])
    assert groups == {"consumer": {"Consumer", "consumer", " Consumer "}, "business": {"Business", "business"}}


def test_iqr_outlier(spark):
    df = spark.createDataFrame([(v,) for v in (100, 105, 110, 115, 120, 125, 130, 1000)], "revenue int")
    r = quality.iqr_summary(df, ["revenue"], include_empty=True).first()
    assert r["outlier_count"] == 1
    assert r["q1"] == pytest.approx(108.75) and r["q3"] == pytest.approx(126.25)


def test_iqr_with_missing(spark):
    df = spark.createDataFrame([(v,) for v in (100.0, 105.0, None, 110.0, 115.0, 120.0, 1000.0)], "revenue double")
    assert quality.iqr_summary(df, ["revenue"]).first()["outlier_count"] == 1


def test_iqr_empty_column_gives_zeros(spark):
    df = spark.createDataFrame([(None,), (None,)], "revenue double")
    r = quality.iqr_summary(df, ["revenue"], include_empty=True).first()
    assert (r["lower_bound"], r["upper_bound"], r["outlier_count"]) == (0.0, 0.0, 0)


def test_iqr_rejects_text(spark):
    df = spark.createDataFrame([("a",)], "segment string")
    with pytest.raises(TypeError):
        quality.iqr_summary(df, ["segment"])


def test_numeric_like(spark):
    df = spark.createDataFrame([("12",), ("18",), ("24",), ("36",), ("unknown",)], "tenure_months string")
    r = quality.numeric_like_columns(df).first()
    assert (r["numeric_like_count"], r["non_null_count"], r["proportion"]) == (4, 5, 0.8)


def test_numeric_like_rejects_bad_threshold(spark):
    df = spark.createDataFrame([("1",)], "x string")
    with pytest.raises(ValueError):
        quality.numeric_like_columns(df, threshold=0)


def test_formatting(spark):
    df = spark.createDataFrame([("Consumer",), (" consumer",), ("Consumer ",), ("BUSINESS",), ("Business",)],
                               "segment string")
    r = quality.string_formatting_issues(df).first()
    assert (r["whitespace_count"], r["case_inconsistency_count"]) == (2, 5)


def test_identifiers(spark):
    rows = [(f"C{i:03d}", "A" if i % 2 else "B") for i in range(1, 21)]
    df = spark.createDataFrame(rows, "customer_id string, segment string")
    assert [r["column"] for r in quality.identifier_columns(df).collect()] == ["customer_id"]


def test_dates(spark):
    df = spark.createDataFrame(
        [("2024-01-05", "alpha", "1001"), ("2024-02-10", "beta", "1002"), ("2024-03-15", "gamma", "1003"),
         ("2024-04-20", "delta", "1004")], "signup_date string, segment string, reference string")
    assert [r["column"] for r in quality.date_candidate_columns(df).collect()] == ["signup_date"]


def test_constants(spark):
    rows = [("same", "active" if i else "closed", f"r{i % 5}", None) for i in range(20)]
    df = spark.createDataFrame(rows, "constant_segment string, near_constant_status string, varying_region string, "
                                     "entirely_missing string")
    got = {r["column"]: (r["issue_type"], r["dominant_proportion"]) for r in quality.constant_features(df).collect()}
    assert got == {"constant_segment": ("constant_feature", 1.0),
                   "near_constant_status": ("near_constant_feature", 0.95)}


def test_legacy_constants_include_all_null(spark):
    df = spark.createDataFrame([("x", None, 1), ("x", None, 2), ("x", None, 3), ("x", None, 4)],
                               "constant_segment string, entirely_missing string, varying_revenue int")
    assert sorted(r["column"] for r in quality.constant_columns(df).collect()) == ["constant_segment",
                                                                                   "entirely_missing"]


def test_inputs_not_mutated(spark):
    df = spark.createDataFrame([(" a ",), ("A",)], "s string")
    before = df.collect()
    quality.string_formatting_issues(df).collect()
    assert df.collect() == before


def test_unknown_is_not_missing(spark):
    df = spark.createDataFrame([("unknown",), ("x",)], "s string")
    assert quality.missing_counts(df).count() == 0


def test_dataset_health(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 1.0)], "s string, v double")
    r = quality.dataset_health(df).first()
    assert (r["row_count"], r["column_count"], r["duplicate_rows"], r["missing_cells"]) == (3, 2, 1, 2)


def test_missing_counts_with_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "v double")
    assert as_dict(quality.missing_counts(df)) == {"v": 1}
    assert df.where(F.isnan("v")).count() == 1


def test_wide_and_long_aggregation_agree(spark, monkeypatch):
    from tabsieve.operators import eda, issues
    from tabsieve.plans import columnwise
    rows = [(i, f" v{i % 3}", None if i % 4 == 0 else float(i), "N/A" if i % 5 == 0 else "2024-01-0%d" % (i % 9 + 1))
            for i in range(40)]
    df = spark.createDataFrame(rows, "k int, s string, x double, d string")
    wide = sorted(issues.scan_metrics(df).collect())
    wide_corr = sorted(eda.numeric_correlations(df).collect())
    monkeypatch.setattr(columnwise, "WIDE_AGG_LIMIT", 0)
    assert sorted(issues.scan_metrics(df).collect()) == wide
    long_corr = sorted(eda.numeric_correlations(df).collect())
    assert [(a, b) for a, b, _ in long_corr] == [(a, b) for a, b, _ in wide_corr]
    assert all(abs(x[2] - y[2]) < 1e-12 for x, y in zip(long_corr, wide_corr))


def test_approximate_fast_paths(spark, sf_dir):
    from tabsieve.operators import eda
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    exact = {r["column"]: r for r in eda.numeric_summary(li).collect()}
    approx = {r["column"]: r for r in eda.numeric_summary(li, approx_accuracy=100000).collect()}
    n = exact["l_quantity"]["count"]
    for c in exact:
        assert approx[c]["count"] == exact[c]["count"]
        assert approx[c]["min"] <= approx[c]["p50"] <= approx[c]["max"]
    vals = sorted(r[0] for r in li.select("l_quantity").collect())
    # rank error of the sketch is bounded by n / accuracy (< 1 rank here)
    assert approx["l_quantity"]["p50"] in vals[n // 2 - 2: n // 2 + 2]
    cust = spark.read.parquet(f"{sf_dir}/customer.parquet")
    assert [r["column"] for r in quality.identifier_columns(cust, approx_rsd=0.01).collect()] == \
        [r["column"] for r in quality.identifier_columns(cust).collect()]


def test_value_keys_stand_for_values(spark):
    from tabsieve.operators.valuecounts import column_cardinality, spelling_groups, value_keys

    long = "x" * 100_000
    rows = [(long, 0.0, 1), (long + " ", -0.0, 1), (long.upper(), float("nan"), 2), ("N/A", 1.5, None), ("n/a", 1.5, 3),
            ("", None, 3), (None, 2.5, 3)]
    keys = value_keys(spark.createDataFrame(rows, "t string, d double, i int"))
    card = {r["column"]: (r["non_null_count"], r["distinct_count"], r["top_count"]) for r in
            column_cardinality(keys).collect()}
    assert card == {"t": (6, 6, 1), "d": (5, 3, 2), "i": (6, 3, 3)}  # 0.0 and -0.0 are one value
    assert [(r["n_variants"], r["rows"]) for r in spelling_groups(keys).collect()] == [(3, 3)]
    assert sorted(r["n_variants"] for r in spelling_groups(keys, skip_markers=False).collect()) == [2, 3]
    assert "string" not in dict(keys.dtypes)["value"] + dict(keys.dtypes)["form"]


def test_spellings_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = [("A", "x"), ("a ", "X"), ("b", "x"), ("null", "y"), (" NULL", None)]
    df = spark.createDataFrame(rows, "p string, q string")

    def found():
        return sorted(tuple(r) for r in quality.categorical_inconsistencies(df).collect())

    small = found()
    assert small == [("p", "a", "A", 2), ("p", "a", "a ", 2), ("q", "x", "X", 2), ("q", "x", "x", 2)]
    monkeypatch.setattr(quality, "BROADCAST_GROUPS", 0)
    assert found() == small


def test_duplicate_rows_tell_nulls_apart(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("a", None), (None, None)], "p string, q string")
    assert quality.duplicate_row_count(df).first()[0] == 1
