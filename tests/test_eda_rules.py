"""Exploration statistics and validation rules on literal fixtures."""

import pytest

from tabsieve.operators import eda, issues, rules
from tabsieve.operators.rules import ValidationRule


def test_numeric_summary(spark):
    df = spark.createDataFrame([(100, 1, "A"), (200, 2, "B"), (300, 3, "A"), (400, 4, "B")],
                               "revenue int, tenure int, segment string")
    r = {x["column"]: x for x in eda.numeric_summary(df).collect()}
    assert r["revenue"]["count"] == 4 and r["revenue"]["mean"] == 250.0
    assert r["revenue"]["p50"] == 250.0 and r["revenue"]["p25"] == 175.0
    assert r["revenue"]["std"] == pytest.approx(129.0994, rel=1e-5)
    assert "segment" not in r


def test_categorical_top_counts_null(spark):
    df = spark.createDataFrame([("A",), (None,), ("B",), (None,)], "segment string")
    rows = eda.categorical_top_values(df).collect()
    assert {r["value"]: r["n"] for r in rows} == {None: 2, "A": 1, "B": 1}
    assert {r["unique_count"] for r in rows} == {2}


def test_correlations_perfect(spark):
    df = spark.createDataFrame([(1, 2, 3), (2, 4, 6), (3, 6, 9), (4, 8, 12)], "revenue int, tenure int, age int")
    rows = eda.numeric_correlations(df).collect()
    assert len(rows) == 6 and all(r["r"] == pytest.approx(1.0) for r in rows)


def test_correlation_constant_column_is_null(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "a int, b int")
    assert all(r["r"] is None for r in eda.numeric_correlations(df).collect())
    assert eda.target_correlations(df, "b").count() == 0


def test_target_correlation_negative(spark):
    df = spark.createDataFrame([(1, 500, 1), (5, 400, 1), (10, 300, 0), (20, 200, 0), (30, 100, 0)],
                               "tenure int, revenue int, churn int")
    r = {x["column"]: x["r"] for x in eda.target_correlations(df, "churn").collect()}
    assert r["tenure"] < 0 and r["revenue"] > 0


def test_target_rate(spark):
    df = spark.createDataFrame([("Consumer", 1), ("Consumer", 0), ("Business", 0), ("Business", 0)],
                               "segment string, churn int")
    got = {r["value"]: (r["n"], r["target_rate"]) for r in eda.target_rate_by_category(df, "churn").collect()}
    assert got == {"Consumer": (2, 0.5), "Business": (2, 0.0)}


def test_target_rate_rejects_non_binary(spark):
    df = spark.createDataFrame([("a", 2)], "s string, y int")
    with pytest.raises(ValueError):
        eda.target_rate_by_category(df, "y")


def test_mask_and_preview(spark):
    df = spark.createDataFrame([(1, "ab", "abcdef", None)], "k int, account string, email string, phone string")
    r = eda.safe_preview(df, ["k"]).first()
    assert (r["account"], r["email"], r["phone"]) == ("**", "ab**ef", "")


def test_target_candidates(spark):
    df = spark.createDataFrame([(0, 1, None), (1, 2, None)], "a int, b int, c int")
    assert sorted(r["column"] for r in eda.target_candidates(df).collect()) == ["a", "c"]


def test_leakage_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "churn int, churn_prediction int, age int")
    assert [r["column"] for r in eda.leakage_name_columns(df, "churn").collect()] == ["churn_prediction"]


def _rule(**kw):
    base = dict(rule_id="r1", issue_type="invalid_value", column="value", description="d", source="s")
    base.update(kw)
    return ValidationRule(**base)


def test_rule_range(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (50.0,), (100.0,), (101.0,), (None,)], "value double")
    r = rules.evaluate_rules(df, [_rule(rule_type="numeric_range", min_value=0, max_value=100)]).first()
    assert (r["checked_count"], r["violation_count"]) == (5, 2)


def test_rule_allowed(spark):
    df = spark.createDataFrame([("active",), ("inactive",), ("pending",), (" NA ",), ("null",), ("",), (None,)],
                               "value string")
    r = rules.evaluate_rules(df, [_rule(rule_type="allowed_values", allowed_values=["active", "inactive"])]).first()
    assert (r["checked_count"], r["violation_count"]) == (3, 1)


def test_rule_compare(spark):
    df = spark.createDataFrame([(1, 2), (5, 5), (8, 3), (None, 10)], "start int, end int")
    r = rules.evaluate_rules(df, [_rule(rule_type="column_comparison", column="start", comparison_column="end",
                                        comparison_operator="<=")]).first()
    assert (r["checked_count"], r["violation_count"]) == (3, 1)


def test_rule_compare_timestamps(spark):
    import datetime as dt
    d = dt.datetime
    df = spark.createDataFrame([(d(2024, 1, 1), d(2024, 1, 2)), (d(2024, 1, 5), d(2024, 1, 3)),
                                (None, d(2024, 1, 1))], "start timestamp, end timestamp")
    r = rules.evaluate_rules(df, [_rule(rule_type="column_comparison", column="start", comparison_column="end",
                                        comparison_operator="<=")]).first()
    assert (r["checked_count"], r["violation_count"]) == (2, 1)


def test_rule_parameter_validation():
    with pytest.raises(ValueError):
        _rule(rule_type="numeric_range")
    with pytest.raises(ValueError):
        _rule(rule_type="numeric_range", min_value=5, max_value=1)
    with pytest.raises(ValueError):
        _rule(rule_type="allowed_values", allowed_values=["a", ""])
    with pytest.raises(ValueError):
        _rule(rule_type="column_comparison", comparison_column="value", comparison_operator="<")


def test_rule_type_errors(spark):
    df = spark.createDataFrame([("a", True)], "s string, b boolean")
    with pytest.raises(TypeError):
        rules.evaluate_rules(df, [_rule(column="s", rule_type="numeric_range", min_value=0)])
    with pytest.raises(TypeError):
        rules.evaluate_rules(df, [_rule(column="b", rule_type="numeric_range", min_value=0)])
    with pytest.raises(KeyError):
        rules.evaluate_rules(df, [_rule(column="zz", rule_type="numeric_range", min_value=0)])


def test_rule_issue(spark):
    df = spark.createDataFrame([(-1,), (25,), (150,), (None,)], "age int")
    rule = ValidationRule("age_range", "numeric_range", "invalid_value", "age", "plausible age", "policy",
                          min_value=0, max_value=120)
    r = issues.validation_rule_issues(df, [rule]).first()
    assert r["issue_id"] == "rule:age_range" and r["evidence"].startswith("violations=2; checked=3;")
    assert r["requires_explicit_human_decision"]


def test_duplicate_rule_ids_rejected(spark):
    df = spark.createDataFrame([(1,)], "value int")
    r = _rule(rule_type="numeric_range", min_value=0)
    with pytest.raises(ValueError):
        issues.validation_rule_issues(df, [r, r])
