"""Binary-classification metrics on scored DataFrames.

Scores are grouped first (one row per distinct score with positive and
negative counts), so ties collapse before any ordering; running sums over
the ordered scores use the distributed ``cumulative_before`` plan rather
than a single-partition window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsieve.plans.ranking import cumulative_before

METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc")
VARIANTS = ("default_threshold", "selected_threshold", "baseline")


class ThresholdInputError(ValueError):
    pass


def _grouped_scores(df: DataFrame, label: str, score: str) -> DataFrame:
    y = F.col(label)
    return df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count(F.when(y == 1, F.lit(1))).alias("pos"),
        F.count(F.when(y == 0, F.lit(1))).alias("neg"))


def check_threshold_inputs(df: DataFrame, label: str, score: str) -> None:
    s = F.col(score).cast("double")
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col(label).isNull() | ~F.col(label).isin(0, 1), F.lit(1))).alias("bad_label"),
        F.count(F.when(s.isNull() | F.isnan(s) | (s < 0) | (s > 1), F.lit(1))).alias("bad_score"),
    ).first()
    problems = [code for code, wrong in (("no_rows", row["n"] == 0), ("labels_not_0_or_1", row["bad_label"]),
                                         ("scores_outside_0_to_1", row["bad_score"])) if wrong]
    if problems:
        raise ThresholdInputError("Threshold input refused: " + "; ".join(problems))


def select_threshold(df: DataFrame, label: str, score: str, check: bool = True) -> DataFrame:
    """The distinct score maximizing F1 of ``score >= t``; ties go to the
    higher threshold. One row ``threshold, validation_f1``."""
    if check:
        check_threshold_inputs(df, label, score)
    g = _grouped_scores(df, label, score)
    ranked = cumulative_before(g, [F.desc("score")], weight={"pos": F.col("pos"), "all": F.col("pos") + F.col("neg")})
    tp = F.col("cum_pos") + F.col("pos")
    pp = F.col("cum_all") + F.col("pos") + F.col("neg")
    f1 = F.coalesce(F.try_divide(2 * tp, pp + F.col("total_pos")), F.lit(0.0))
    best = ranked.select("score", f1.cast("double").alias("f1")).agg(
        F.max_by(F.struct("f1", "score"), F.struct("f1", "score")).alias("b"))
    return best.select(F.col("b.score").alias("threshold"), F.col("b.f1").alias("validation_f1"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Exact ROC AUC with ties counted half, from grouped scores:
    sum over scores of pos * (negatives below + neg / 2) / (P * N)."""
    g = _grouped_scores(df, label, score)
    ranked = cumulative_before(g, [F.asc("score")], weight={"neg": F.col("neg")})
    return ranked.agg(
        F.try_divide(F.sum(F.col("pos") * (F.col("cum_neg") + F.col("neg") / 2.0)),
                     F.sum("pos").cast("double") * F.first("total_neg")).alias("roc_auc"))


def confusion_metrics(df: DataFrame, label: str, prediction: Column) -> DataFrame:
    """Accuracy, precision, recall, f1 (zero division -> 0), one row."""
    y = F.col(label)
    p = prediction
    c = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when((y == 1) & (p == 1), F.lit(1))).alias("tp"),
        F.count(F.when((y == 0) & (p == 1), F.lit(1))).alias("fp"),
        F.count(F.when((y == 1) & (p == 0), F.lit(1))).alias("fn"),
        F.count(F.when((y == 0) & (p == 0), F.lit(1))).alias("tn"),
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(
        ratio(tp + tn, F.col("n")).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def classification_metrics(df: DataFrame, label: str, score: str, threshold: float | Column | None = None,
                           prediction: str | None = None, variant: str = "default_threshold") -> DataFrame:
    """M11 + M12 in one row ``variant, accuracy, precision, recall, f1,
    roc_auc``. Predictions: a given column, or ``score >= threshold``."""
    if prediction is not None:
        pred = F.col(prediction)
    else:
        t = F.lit(0.5) if threshold is None else (threshold if isinstance(threshold, Column) else F.lit(threshold))
        pred = F.when(F.col(score) >= t, F.lit(1)).otherwise(F.lit(0))
    conf = confusion_metrics(df, label, pred).select(F.lit(1).alias("_k"), "*")
    auc = roc_auc(df, label, score).select(F.lit(1).alias("_k"), "*")
    # both sides are single-row aggregates
    return conf.join(auc, "_k").select(F.lit(variant).alias("variant"), *METRICS)


def metrics_for_predictions(df: DataFrame, label: str, score: str, predictions: dict[str, Column]) -> DataFrame:
    """M11/M12 for several prediction rules over the same scores: confusion
    counts of all rules in one pass, the (threshold-free) AUC once."""
    y = F.col(label)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, p in enumerate(predictions.values()):
        aggs += [F.count(F.when((y == 1) & (p == 1), F.lit(1))).alias(f"tp{i}"),
                 F.count(F.when((y == 0) & (p == 1), F.lit(1))).alias(f"fp{i}"),
                 F.count(F.when((y == 1) & (p == 0), F.lit(1))).alias(f"fn{i}"),
                 F.count(F.when((y == 0) & (p == 0), F.lit(1))).alias(f"tn{i}")]
    counts = df.agg(*aggs)

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    rows = []
    for i, variant in enumerate(predictions):
        tp, fp, fn, tn = (F.col(f"{k}{i}") for k in ("tp", "fp", "fn", "tn"))
        rows.append(F.struct(F.lit(variant).alias("variant"), ratio(tp + tn, F.col("n")).alias("accuracy"),
                             ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
                             ratio(2 * tp, 2 * tp + fp + fn).alias("f1")))
    conf = counts.select(F.explode(F.array(*rows)).alias("m")).select("m.*").withColumn("_k", F.lit(1))
    auc = roc_auc(df, label, score).select(F.lit(1).alias("_k"), "roc_auc")
    # auc is a single-row aggregate
    return conf.join(F.broadcast(auc), "_k").select("variant", *METRICS)


def majority_class(df: DataFrame, label: str) -> int:
    """M9: most frequent class; ties -> the smaller label (0)."""
    row = df.groupBy(F.col(label).alias("y")).agg(F.count(F.lit(1)).alias("n")).agg(
        F.min_by("y", F.struct(-F.col("n"), F.col("y"))).alias("m")).first()
    return int(row["m"])


def baseline_metrics(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """M9: constant predictor of the training majority class; its score is
    the constant 1.0 / 0.0 (AUC 0.5)."""
    m = majority_class(train, label)
    scored = test.select(F.col(label), F.lit(float(m)).alias("_score"), F.lit(m).alias("_pred"))
    return classification_metrics(scored, label, "_score", prediction="_pred", variant="baseline") \
        .withColumn("majority_class", F.lit(m))


def evaluation_flags(metrics: DataFrame) -> DataFrame:
    """Low recall of the model and no gain over the baseline."""
    model = metrics.where(F.col("variant") != "baseline").withColumn("_k", F.lit(1))
    base = metrics.where(F.col("variant") == "baseline").select(
        F.lit(1).alias("_k"), F.col("accuracy").alias("baseline_accuracy"))
    # base is the one baseline row
    return model.join(F.broadcast(base), "_k").select(
        "variant", (F.col("recall") < 0.5).alias("low_recall"),
        (F.col("accuracy") <= F.col("baseline_accuracy")).alias("not_better_than_baseline"))


def metric_comparison(metrics: DataFrame) -> DataFrame:
    """One row per metric, one column per variant (fixed pivot values,
    so no extra job to discover them)."""
    long = metrics.select("variant", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])).alias("x")) \
        .select("variant", "x.metric", "x.value")
    return long.groupBy("metric").pivot("variant", list(VARIANTS)).agg(F.first("value"))
