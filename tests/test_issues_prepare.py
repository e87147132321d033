"""Issue inventory, treatments and plans."""

import pytest
from pyspark.sql import functions as F

from tabsieve.operators import eda, issues, prepare, quality
from tabsieve.operators.prepare import Action
from tabsieve.plans import treatment
from tabsieve.sources.tables import evidence_fingerprint, fingerprint_value


def test_fake_nulls_issue(spark):
    df = spark.createDataFrame([("active",), ("N/A",), (" null ",), ("",), ("   ",), ("none",)], "status string")
    inv = {r["issue_id"]: r for r in issues.issue_inventory(df).collect()}
    assert inv["fake_nulls:status"]["evidence"] == "null_markers=5"
    assert "missing_values:status" not in inv


def test_inventory_ids_unique_and_ordered(spark):
    df = spark.createDataFrame(
        [("C1", 100.0, "Enterprise", "2024-01-01"), ("C2", None, "enterprise ", "2024-02-01"),
         ("C3", 300.0, "SMB", "2024-03-01"), ("C4", 400.0, "SMB", "2024-04-01")],
        "customer_id string, revenue double, segment string, signup_date string")
    inv = issues.issue_inventory(df).orderBy("ordinal").collect()
    ids = [r["issue_id"] for r in inv]
    assert len(ids) == len(set(ids))
    assert ids[0] == "missing_values:revenue"
    assert {"categorical_inconsistency:segment", "date_conversion:signup_date", "formatting_issue:segment"} <= set(ids)
    issues.check_issue_ids(issues.issue_inventory(df))


def test_drop_duplicates_and_rows(spark):
    df = spark.createDataFrame([(1, 10), (1, 10), (2, 20)], "customer int, value int")
    assert prepare.remove_duplicates(df).count() == 2
    df2 = spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, None), (4.0, "N/A")], "revenue double, segment string")
    assert prepare.drop_missing_rows(df2, "revenue").count() == 3


def test_impute_median_mean(spark):
    df = spark.createDataFrame([(10.0,), (20.0,), (None,), (30.0,)], "score double")
    assert [r[0] for r in prepare.impute_missing(df, "score", "median").collect()] == [10.0, 20.0, 20.0, 30.0]
    df2 = spark.createDataFrame([(10.0,), (20.0,), (None,), (60.0,)], "score double")
    assert [r[0] for r in prepare.impute_missing(df2, "score", "mean").collect()] == [10.0, 20.0, 30.0, 60.0]
    with pytest.raises(ValueError):
        prepare.impute_missing(spark.createDataFrame([("a",)], "s string"), "s", "median")


def test_impute_mode_tie_first_seen(spark):
    df = spark.createDataFrame([(1, "business"), (2, "retail"), (3, None), (4, "retail"), (5, "business")],
                               "k int, segment string")
    out = prepare.impute_missing(df, "segment", "mode", order_by="k").orderBy("k").collect()
    assert out[2]["segment"] == "business"


def test_normalize_categories(spark):
    rows = [(1, "Consumer"), (2, "consumer"), (3, "Consumer"), (4, " consumer "), (5, "business"),
            (6, "Business"), (7, "business")]
    df = spark.createDataFrame(rows, "k int, segment string")
    out = [r["segment"] for r in prepare.normalize_categories(df, "segment", "k").orderBy("k").collect()]
    assert out == ["Consumer"] * 4 + ["business"] * 3


def test_normalize_categories_tie_first_seen(spark):
    df = spark.createDataFrame([(1, "YES"), (2, "yes"), (3, "Pending"), (4, "pending")], "k int, status string")
    out = [r["status"] for r in prepare.normalize_categories(df, "status", "k").orderBy("k").collect()]
    assert out == ["YES", "YES", "Pending", "Pending"]


def test_normalize_nulls_and_trim(spark):
    df = spark.createDataFrame([("a ",), (" N/A ",), (None,), ("  ",)], "status string")
    nulled = [r[0] for r in prepare.normalize_nulls(df, "status").collect()]
    assert nulled == ["a ", None, None, None]
    trimmed = [r[0] for r in prepare.trim_whitespace(df, "status").collect()]
    assert trimmed == ["a", "N/A", None, ""]


def test_nulls_then_mode_via_plan(spark):
    df = spark.createDataFrame([(1, "Active"), (2, "Active"), (3, " N/A "), (4, None)], "k int, status string")
    inv = issues.issue_inventory(df)
    ids = {r["issue_id"] for r in inv.collect()}
    decisions = [treatment.TreatmentDecision(i, "mode" if i.startswith("missing") else
                                             "normalize_nulls" if i.startswith("fake") else "retain", "why")
                 for i in sorted(ids)]
    plan = treatment.TreatmentPlan(fingerprint_value(df), evidence_fingerprint(inv).first()["fingerprint"],
                                   "reviewer", decisions)
    out = treatment.apply_treatment_plan(df, inv, plan, order_by="k")
    assert {r["status"] for r in out.collect()} == {"Active"}


def test_plan_guards(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0)], "k int, v double")
    inv = issues.issue_inventory(df)
    fp = fingerprint_value(df)
    efp = evidence_fingerprint(inv).first()["fingerprint"]
    bad = treatment.TreatmentPlan(fp, efp, "rev", [treatment.TreatmentDecision("missing_values:v", "normalize_nulls",
                                                                                "x")])
    with pytest.raises(treatment.PlanValidationError):
        treatment.validate_plan(df, inv, bad)
    stale = treatment.TreatmentPlan("0" * 64, efp, "rev", [treatment.TreatmentDecision("missing_values:v", "median",
                                                                                        "x")])
    with pytest.raises(treatment.PlanValidationError):
        treatment.validate_plan(df, inv, stale)
    others = [treatment.TreatmentDecision(r["issue_id"], "retain", "x") for r in inv.collect()
              if r["issue_id"] != "missing_values:v"]
    ok = treatment.TreatmentPlan(fp, efp, "rev",
                                 [treatment.TreatmentDecision("missing_values:v", "median", "x"), *others])
    out = treatment.apply_treatment_plan(df, inv, ok)
    assert out.where(F.col("v").isNull()).count() == 0


def test_unknown_operation(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError):
        prepare.apply_actions(df, [Action("explode")])
    with pytest.raises(ValueError):
        prepare.apply_actions(df, [Action("drop_rows", "zz")])


def test_idempotent_cleaning(spark):
    df = spark.createDataFrame([(1, " a"), (2, "A"), (3, "n/a")], "k int, s string")
    once = prepare.apply_actions(df, [Action("normalize_nulls", "s"), Action("trim_whitespace", "s"),
                                      Action("normalize_categories", "s")], order_by="k")
    twice = prepare.apply_actions(once, [Action("normalize_nulls", "s"), Action("trim_whitespace", "s"),
                                         Action("normalize_categories", "s")], order_by="k")
    assert sorted(once.collect()) == sorted(twice.collect())
    assert issues.issue_inventory(prepare.remove_duplicates(df)).where(
        F.col("issue_type") == "exact_duplicates").count() == 0


def test_normalize_nulls_fixture(spark):
    values = ["Active", " N/A ", "NULL", "none", "NaN", " na ", "", "   ", "unknown", None, "42"]
    df = spark.createDataFrame([(i, v, " N/A ") for i, v in enumerate(values)], "k int, status string, other string")
    out = prepare.normalize_nulls(df, "status").orderBy("k").collect()
    assert sum(r["status"] is None for r in out) == 8
    assert (out[0]["status"], out[8]["status"], out[9]["status"], out[10]["status"]) == ("Active", "unknown", None,
                                                                                         "42")
    assert all(r["other"] == " N/A " for r in out)
    assert df.orderBy("k").collect()[1]["status"] == " N/A "


def test_neighbouring_imputations_equal_one_by_one(spark):
    rows = [(1, "b", 1.0, 5, "x"), (2, None, None, None, None), (3, "a", 3.0, 7, "y"), (4, "b", float("nan"), 9, "y"),
            (5, "a", 8.0, None, None)]
    df = spark.createDataFrame(rows, "k int, seg string, bal double, n int, tag string")
    actions = [prepare.Action("impute_missing", c, s) for c, s in
               (("seg", "mode"), ("bal", "median"), ("n", "mean"), ("tag", "mode"))]
    for order_by in ("k", None):
        single = df
        for a in actions:
            single = prepare.apply_action(single, a, order_by)
        together = prepare.apply_actions(df, actions, order_by)
        assert together.dtypes == single.dtypes
        assert sorted(together.collect()) == sorted(single.collect())
    picked = {r["k"]: r for r in prepare.apply_actions(df, actions, "k").collect()}
    assert tuple(picked[2]) == (2, "b", 3.0, 7.0, "y")
    with pytest.raises(ValueError):
        prepare.apply_actions(df, [prepare.Action("impute_missing", "k", "mean"),
                                   prepare.Action("impute_missing", "gone", "mode")])


@pytest.mark.parametrize("text", ["2024-01-05T10:20:30", "2024-01-05T10:20:30Z", "2024-01-05T10:20:30.5",
                                  "2024-01-05 10:20", "2024-01-05 10:20:30.25", "1/5/2024", "01/05/2024", "5 Jan 2024",
                                  "Jan 5, 2024", "January 5, 2024", "01-05-2024", "01.05.2024", "05-Jan-2024"])
def test_date_renderings(spark, text):
    out = prepare.convert_date(spark.createDataFrame([(text,)], "d string"), "d").first()["d"]
    assert (out.year, out.month, out.day) == (2024, 1, 5)


def test_empty_table_has_a_row_per_column(spark):
    df = spark.createDataFrame([], "a string, b double")
    assert sorted(map(tuple, eda.column_information(df).collect())) == [("a", "string", 0, 0), ("b", "double", 0, 0)]
    assert {r["column"] for r in quality.constant_columns(df).collect()} == {"a", "b"}
