"""Readiness, split, threshold, metrics and training."""

import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tabsieve.operators import evaluation, modeling


def test_readiness_states(spark):
    ok = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1)], "f int, y int")
    assert modeling.readiness_status(ok, "y")[0] == "PASS"
    warn = spark.createDataFrame([(None, 0), (2, 0), (3, 1), (4, 1)], "f int, y int")
    assert modeling.readiness_status(warn, "y")[0] == "WARNING"
    block = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, None)], "f int, y int")
    status, errors = modeling.readiness_status(block, "y")
    assert status == "BLOCK" and any(e.startswith("invalid_target_values") for e in errors)
    small = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "f int, y int")
    assert "class_too_small:y" in modeling.readiness_status(small, "y")[1]
    inf = spark.createDataFrame([(float("inf"), 0), (2.0, 0), (3.0, 1), (4.0, 1)], "f double, y int")
    assert modeling.readiness_status(inf, "y")[0] == "BLOCK"


def test_threshold_fixtures(spark):
    df = spark.createDataFrame([(0, .10), (0, .40), (1, .45), (1, .80)], "label int, probability double")
    r = evaluation.select_threshold(df, "label", "probability").first()
    assert (r["threshold"], r["validation_f1"]) == (0.45, 1.0)
    df2 = spark.createDataFrame([(0, .10), (1, .90)], "label int, probability double")
    r2 = evaluation.select_threshold(df2, "label", "probability").first()
    assert (r2["threshold"], r2["validation_f1"]) == (0.90, 1.0)


def test_threshold_input_checks(spark):
    with pytest.raises(evaluation.ThresholdInputError):
        evaluation.select_threshold(spark.createDataFrame([(2, .5)], "label int, p double"), "label", "p")
    with pytest.raises(evaluation.ThresholdInputError):
        evaluation.select_threshold(spark.createDataFrame([(1, 1.5)], "label int, p double"), "label", "p")


def _brute_f1(rows):
    best_t, best = None, -1.0
    for t in sorted({s for _, s in rows}):
        tp = sum(1 for y, s in rows if y == 1 and s >= t)
        fp = sum(1 for y, s in rows if y == 0 and s >= t)
        fn = sum(1 for y, s in rows if y == 1 and s < t)
        f1 = 0.0 if tp == 0 else 2 * tp / (2 * tp + fp + fn)
        if f1 > best or (f1 == best and t > best_t):
            best_t, best = t, f1
    return best_t, best


def _brute_auc(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


def test_threshold_and_auc_match_brute_force(spark):
    rng = random.Random(7)
    rows = [(rng.randint(0, 1), round(rng.random(), 1)) for _ in range(300)]
    df = spark.createDataFrame(rows, "label int, s double")
    r = evaluation.select_threshold(df, "label", "s").first()
    t, f1 = _brute_f1(rows)
    assert r["threshold"] == t and r["validation_f1"] == pytest.approx(f1)
    assert evaluation.roc_auc(df, "label", "s").first()["roc_auc"] == pytest.approx(_brute_auc(rows))


def test_baseline_auc_half_and_tie_to_zero(spark):
    df = spark.createDataFrame([(0,), (1,), (0,), (1,)], "y int")
    assert evaluation.majority_class(df, "y") == 0
    m = evaluation.baseline_metrics(df, df, "y").first()
    assert m["roc_auc"] == 0.5 and m["accuracy"] == 0.5


def test_split_sizes(spark):
    rows = [(i, "north" if i % 2 else "south", 1 if i % 4 < 2 else 0) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, region string, churn int")
    s = modeling.stratified_split(df, "churn", ["id"])
    sizes = {r["split"]: r["n"] for r in s.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes == {"test": 8, "validation": 8, "train": 24}
    again = modeling.stratified_split(df, "churn", ["id"])
    assert sorted(s.collect()) == sorted(again.collect())


def test_allocation_largest_remainder():
    assert modeling.allocate({0: 200, 1: 199}, 80) == {0: 40, 1: 40}
    assert sum(modeling.allocate({0: 7, 1: 3, 2: 1}, 4).values()) == 4


def test_train_evaluate_small(spark):
    rows = [(20 + i, "north" if i % 3 else "south", 1 if (i % 5 < 2) else 0) for i in range(40)]
    df = spark.createDataFrame(rows, "age int, region string, churn int")
    df = df.withColumn("id", F.monotonically_increasing_id())
    for model in ("Logistic Regression", "Random Forest"):
        res = modeling.train_evaluate(df, "churn", model, ["age", "region"], ["id"])
        rec = res.record.first()
        assert (rec["train_rows"], rec["test_rows"]) == (32, 8)
        assert rec["excluded"] == ["id"]
        mets = {r["variant"]: r for r in res.metrics.collect()}
        assert mets["baseline"]["roc_auc"] == 0.5
        assert all(0.0 <= mets[v][m] <= 1.0 for v in mets for m in evaluation.METRICS)
        assert res.comparison.count() == 5 and res.flags.count() == 2


def test_feature_validation_errors(spark):
    df = spark.createDataFrame([(1, 0), (2, 1)], "a int, y int")
    with pytest.raises(ValueError):
        modeling.validate_training_features(df, "y", "SVM", ["a"])
    with pytest.raises(ValueError):
        modeling.validate_training_features(df, "y", "Random Forest", ["a", "a"])
    with pytest.raises(ValueError):
        modeling.validate_training_features(df, "y", "Random Forest", ["y"])
    with pytest.raises(ValueError):
        modeling.validate_training_features(df, "y", "Random Forest", ["zz"])


def test_unseen_category_encodes_to_zeros(spark):
    train = spark.createDataFrame([("a", 0), ("b", 1), ("a", 1)], "c string, y int")
    test = spark.createDataFrame([("z", 0)], "c string, y int")
    prep = modeling.Preprocessor([], ["c"]).fit(train)
    vec = prep.transform(test).first()["features"]
    assert vec.numNonzeros() == 0 and vec.size == 2


def test_train_small_fixture(spark):
    ages = [21, 35, 48, 52, 28, 42, 31, 60, 24, 55, 39, 44, 29, 63, 33, 57, 26, 49, 37, 54]
    rows = [(i, a, "North" if i % 2 == 0 else "South", i % 2) for i, a in enumerate(ages)]
    df = spark.createDataFrame(rows, "id int, age int, region string, churned int")
    rec = modeling.train_evaluate(df, "churned", "Logistic Regression", ["age", "region"], ["id"]).record.first()
    assert (rec["train_rows"], rec["test_rows"], rec["validation_rows"]) == (16, 4, 4)


@pytest.mark.parametrize("model", modeling.SUPPORTED_MODELS)
def test_models_score_in_a_session_that_observed_metrics(spark, model):
    """The session's observations are no part of what a scoring task gets."""
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 3}
    df = spark.createDataFrame([(i, "north" if i % 3 else "south", i % 2) for i in range(20)], "age int, region string, y int")
    scored = modeling._fit_score(df, df, model, ["age"], ["region"], "y", 20).collect()
    assert len(scored) == 20 and all(0 <= r["score"] <= 1 and r["prediction"] in (0, 1) for r in scored)


def test_forest_rows_are_spread_over_tasks_by_their_number(spark, monkeypatch):
    fitted_on = []

    class Fitted(Exception):
        pass

    class Estimator:
        def fit(self, rows):
            fitted_on.append((rows.rdd.getNumPartitions(), rows.count(), rows.columns))
            raise Fitted

    monkeypatch.setattr(modeling, "FOREST_TASK_ROWS", 10, raising=False)
    monkeypatch.setattr(modeling, "_estimator", lambda *_: Estimator())
    df = spark.range(0, 45, 1, 1).selectExpr("cast(id as int) as age", "cast(id % 2 as int) as y")
    for n in (45, 10):
        with pytest.raises(Fitted):
            modeling._fit_score(df.limit(n).coalesce(1), df, "Random Forest", ["age"], [], "y", n)
    assert fitted_on == [(5, 45, ["y", "features"]), (1, 10, ["y", "features"])]


def test_skewed_inputs(spark):
    """One value holds a third of all rows: quantiles, ranks and quotas stay exact."""
    import numpy as np
    from tabsieve.plans.ranking import exact_quantiles
    rng = random.Random(3)
    vals = [7.0 if i % 3 == 0 else rng.random() * 50 for i in range(900)]
    labels = [1 if i % 3 == 0 else 0 for i in range(900)]
    df = spark.createDataFrame([(i, v, y) for i, (v, y) in enumerate(zip(vals, labels))], "id int, x double, y int")
    got = {r["p"]: r["value"] for r in exact_quantiles(df, ["x"], [0.1, 0.5, 0.9]).collect()}
    for p, v in got.items():
        assert v == pytest.approx(float(np.quantile(vals, p)))
    s = modeling.stratified_split(df, "y", ["id"])
    sizes = {(r["split"], r["y"]): r["n"] for r in s.groupBy("split", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes[("test", 1)] == 60 and sizes[("test", 0)] == 120
    scored = df.select(F.col("y").alias("label"), F.when(F.col("x") == 7.0, 0.5).otherwise(F.col("x") / 100).alias("s"))
    rows = [(r["label"], r["s"]) for r in scored.collect()]
    assert evaluation.roc_auc(scored, "label", "s").first()["roc_auc"] == pytest.approx(_brute_auc(rows))


def test_shared_auc_metrics_match_single(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(rng.randint(0, 1), round(rng.random(), 2)) for _ in range(200)], "label int, s double")
    multi = {r["variant"]: r for r in evaluation.metrics_for_predictions(df, "label", "s", {
        "a": F.when(F.col("s") >= 0.5, 1).otherwise(0), "b": F.when(F.col("s") >= 0.3, 1).otherwise(0)}).collect()}
    a = evaluation.classification_metrics(df, "label", "s", threshold=0.5, variant="a").first()
    b = evaluation.classification_metrics(df, "label", "s", threshold=0.3, variant="b").first()
    for m in evaluation.METRICS:
        assert multi["a"][m] == pytest.approx(a[m]) and multi["b"][m] == pytest.approx(b[m])


def test_categories_encode_by_value_order_and_unseen_as_zeros(spark):
    train = spark.createDataFrame([(1.0, "b", None), (2.0, "a", None), (3.0, "b", None), (6.0, None, None)],
                                  "x double, seg string, empty string")
    prep = modeling.Preprocessor(["x"], ["seg", "empty"]).fit(train)
    other = spark.createDataFrame([(2.5, "a", None), (2.5, "b", "q"), (2.5, "new", None), (2.5, None, None)],
                                  "x double, seg string, empty string")
    got = sorted(tuple(r["features"].toArray()) for r in prep.transform(other).collect())
    x = got[0][0]
    assert got == [(x, 0.0, 0.0), (x, 0.0, 1.0), (x, 0.0, 1.0), (x, 1.0, 0.0)]


def test_many_categories_need_no_labels_on_the_driver(spark):
    train = spark.range(5000).selectExpr("cast(id as double) x", "concat('c', id) as seg")
    prep = modeling.Preprocessor([], ["seg"]).fit(train)
    rows = prep.transform(train).collect()
    assert len({int(r["features"].indices[0]) for r in rows}) == 5000 == rows[0]["features"].size
