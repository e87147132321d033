"""Typed issue inventory.

Every detector turns an aggregate into issue rows
``issue_id, issue_type, column, evidence, allowed_treatments,
requires_explicit_human_decision, ordinal``. The inventory is the ordered
union. Row-level metrics for all columns come from one aggregate pass; the
value-level ones from one value-count frame; Spark reuses both exchanges
across the union branches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsieve.functions.columns import (
    MAX_MARKER_LENGTH,
    NULL_MARKERS,
    genuine_missing,
    is_numeric_type,
    is_text_type,
    quoted,
    stripped_or_null,
    to_number,
)
from tabsieve.functions.dates import parse_date
from tabsieve.operators import quality
from tabsieve.operators.rules import RULE_TREATMENTS, ValidationRule, check_unique_rule_ids, evaluate_rules
from tabsieve.operators.valuecounts import spelling_groups, value_keys
from tabsieve.plans.columnwise import count_if, count_present, per_column
from tabsieve.plans.lineage import materialize

ISSUE_COLUMNS = ("issue_id", "issue_type", "column", "evidence", "allowed_treatments",
                 "requires_explicit_human_decision", "ordinal")

# --- fixed values: treatments allowed per issue type ------------------------
NUMERIC_MISSING_TREATMENTS = ("median", "mean", "mode", "drop_rows", "retain")
OTHER_MISSING_TREATMENTS = ("mode", "constant", "drop_rows", "retain")
FAKE_NULL_TREATMENTS = ("normalize_nulls", "retain")
CATEGORICAL_TREATMENTS = ("normalize_categories", "retain")
DATE_TREATMENTS = ("convert_date", "retain")
NUMERIC_CONVERSION_TREATMENTS = ("convert_numeric", "retain")
OUTLIER_TREATMENTS = ("cap_outliers", "retain", "investigate")
FORMATTING_TREATMENTS = ("trim_whitespace", "retain")
CONSTANT_TREATMENTS = ("exclude_feature", "retain")
NEAR_CONSTANT_TREATMENTS = ("exclude_feature", "retain", "investigate")
DUPLICATE_TREATMENTS = ("remove_duplicates", "retain")
IDENTIFIER_TREATMENTS = ("exclude_feature", "retain", "investigate")
# ---------------------------------------------------------------------------


def _arr(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _issue(frame: DataFrame, issue_type: str | Column, evidence: Column, treatments: Column,
           human: bool, detector: int, issue_id: Column | None = None,
           column: Column | None = None) -> DataFrame:
    t = F.lit(issue_type) if isinstance(issue_type, str) else issue_type
    col = F.col("column") if column is None else column
    iid = issue_id if issue_id is not None else F.concat(t, F.lit(":"), F.coalesce(col, F.lit("dataset")))
    pos = F.col("position") if "position" in frame.columns else F.lit(0)
    return frame.select(
        iid.alias("issue_id"), t.alias("issue_type"), col.cast("string").alias("column"),
        evidence.alias("evidence"), treatments.alias("allowed_treatments"),
        F.lit(human).alias("requires_explicit_human_decision"),
        (F.lit(detector * 100000) + pos).cast("int").alias("ordinal"))


def _metrics(**values: Column) -> Column:
    """Evidence: the metrics behind an issue as ``name=value; name=value``."""
    parts = [F.concat(F.lit(f"{name}="), value.cast("string")) for name, value in values.items()]
    return F.concat_ws("; ", *parts)


def _fixed(value: Column) -> Column:
    """A double for evidence, to six digits after the point."""
    return F.coalesce(value.try_cast("decimal(38,6)").cast("string"), value.cast("string"))


PRESENCE_METRICS = ("missing", "non_null")
TEXT_METRICS = ("missing", "fake_nulls", "whitespace", "non_null", "non_blank", "numeric_like", "date_like")


def scan_metrics(df: DataFrame) -> DataFrame:
    """Row-level counts for every column in one aggregate pass:
    genuine missing, textual nulls, whitespace, numeric-like and date-like
    counts (the latter on stripped, non-blank text).

    The stripped text of each text column is computed once, in a projection
    before the aggregate (Catalyst keeps it there, since it is referenced
    several times and is not cheap), and every text metric reads it.
    ``to_number`` strips first, so the numeric-like count of the raw and of
    the stripped non-blank text is the same number."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    text = [c for c in df.columns if is_text_type(fields[c])]
    kept = {c: f"_kept{i}" for i, c in enumerate(text)}
    pre = df.select(*map(quoted, df.columns), *[stripped_or_null(c).alias(kept[c]) for c in text])

    def k(c: str) -> Column:
        return F.col(kept[c])

    def is_marker(c: str, dt) -> Column:
        short = F.when(F.length(k(c)) <= MAX_MARKER_LENGTH, F.lower(k(c)).isin(*NULL_MARKERS))
        return quoted(c).isNotNull() & (k(c).isNull() | F.coalesce(short, F.lit(False)))

    # Non-text columns only need the two presence counts; the text metrics
    # do not apply to them (0 without an aggregate).
    out = per_column(pre, df.columns, {
        "missing": count_if(genuine_missing),
        "fake_nulls": count_if(is_marker),
        "whitespace": count_if(lambda c, dt: F.octet_length(c) != F.coalesce(F.octet_length(k(c)), F.lit(0))),
        "non_null": count_present(lambda c, dt: quoted(c)),
        "non_blank": count_present(lambda c, dt: k(c)),
        "numeric_like": count_present(lambda c, dt: to_number(k(c))),
        "date_like": count_present(lambda c, dt: parse_date(k(c))),
    }, applies=lambda c, dt: TEXT_METRICS if c in kept else PRESENCE_METRICS)
    return out.withColumn("numeric_non_blank", F.col("numeric_like"))


def missing_value_issues(df: DataFrame, metrics: DataFrame) -> DataFrame:  # I1
    numeric = [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]
    rows = metrics.where(F.col("missing") > 0)
    return _issue(rows, "missing_values",
                  _metrics(missing=F.col("missing")),
                  F.when(F.col("column").isin(*numeric), _arr(NUMERIC_MISSING_TREATMENTS))
                  .otherwise(_arr(OTHER_MISSING_TREATMENTS)), False, 1)


def fake_null_issues(metrics: DataFrame) -> DataFrame:  # I2
    rows = metrics.where(F.col("fake_nulls") > 0)
    return _issue(rows, "fake_nulls",
                  _metrics(null_markers=F.col("fake_nulls")), _arr(FAKE_NULL_TREATMENTS), True, 2)


def categorical_inconsistency_issues(df: DataFrame, vc: DataFrame) -> DataFrame:  # I3
    groups = spelling_groups(vc).groupBy("column").agg(
        F.count(F.lit(1)).alias("groups"), F.sum("n_variants").alias("variants"))
    pos = F.create_map(*[x for i, c in enumerate(df.columns) for x in (F.lit(c), F.lit(i))])
    rows = groups.withColumn("position", pos[F.col("column")])
    return _issue(rows, "categorical_inconsistency",
                  _metrics(groups=F.col("groups"), spellings=F.col("variants")),
                  _arr(CATEGORICAL_TREATMENTS), False, 3)


def date_conversion_issues(metrics: DataFrame, threshold: float = 0.8) -> DataFrame:  # I4
    n = F.col("non_blank")
    rows = metrics.where((n > 0) & (F.try_divide(F.col("numeric_non_blank"), n) < threshold)
                         & (F.try_divide(F.col("date_like"), n) >= threshold))
    return _issue(rows, "date_conversion",
                  _metrics(dates=F.col("date_like"), values=n), _arr(DATE_TREATMENTS), False, 4)


def numeric_conversion_issues(metrics: DataFrame, threshold: float = 0.8) -> DataFrame:  # I5
    n = F.col("non_null")
    ratio = F.try_divide(F.col("numeric_like"), n)
    rows = metrics.where((n > 0) & (ratio >= threshold))
    return _issue(rows, "numeric_conversion",
                  _metrics(numbers=F.col("numeric_like"), values=n),
                  _arr(NUMERIC_CONVERSION_TREATMENTS), False, 5)


def outlier_issues(df: DataFrame, vc: DataFrame | None = None) -> DataFrame:  # I6
    pos = F.create_map(*[x for i, c in enumerate(df.columns) for x in (F.lit(c), F.lit(i))])
    numeric = [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]
    counts = quality.numeric_weights_from_value_counts(vc, numeric) if vc is not None else None
    rows = quality.iqr_summary(df, counts=counts).where(F.col("outlier_count") > 0).withColumn(
        "position", pos[F.col("column")])
    return _issue(rows, "outlier",
                  _metrics(outside=F.col("outlier_count"), lower=_fixed(F.col("lower_bound")),
                           upper=_fixed(F.col("upper_bound"))),
                  _arr(OUTLIER_TREATMENTS), True, 6)


def formatting_issues(metrics: DataFrame) -> DataFrame:  # I7
    rows = metrics.where(F.col("whitespace") > 0)
    return _issue(rows, "formatting_issue",
                  _metrics(edge_whitespace=F.col("whitespace")), _arr(FORMATTING_TREATMENTS), False, 7)


def feature_variability_issues(df: DataFrame, vc: DataFrame) -> DataFrame:  # I8
    pos = F.create_map(*[x for i, c in enumerate(df.columns) for x in (F.lit(c), F.lit(i))])
    rows = quality.constant_features(df, vc=vc).withColumn("position", pos[F.col("column")])
    return _issue(rows, F.col("issue_type"),
                  _metrics(distinct=F.col("distinct_count"), values=F.col("non_null_count"),
                           top=F.round(F.col("dominant_proportion") * F.col("non_null_count")).cast("long")),
                  F.when(F.col("issue_type") == "constant_feature", _arr(CONSTANT_TREATMENTS))
                  .otherwise(_arr(NEAR_CONSTANT_TREATMENTS)), True, 8)


def exact_duplicate_issues(df: DataFrame) -> DataFrame:  # I9
    rows = quality.duplicate_row_count(df).where(F.col("duplicate_rows") > 0)
    return _issue(rows, "exact_duplicates",
                  _metrics(repeated_rows=F.col("duplicate_rows")), _arr(DUPLICATE_TREATMENTS), False, 9,
                  column=F.lit(None).cast("string"))


def identifier_issues(df: DataFrame, vc: DataFrame) -> DataFrame:  # I10
    pos = F.create_map(*[x for i, c in enumerate(df.columns) for x in (F.lit(c), F.lit(i))])
    rows = quality.identifier_columns(df, vc=vc).withColumn("position", pos[F.col("column")])
    return _issue(rows, "identifier",
                  _metrics(distinct=F.col("distinct_count"), values=F.col("non_null_count")),
                  _arr(IDENTIFIER_TREATMENTS), True, 10)


def validation_rule_issues(df: DataFrame, rules: Sequence[ValidationRule]) -> DataFrame:  # I11
    check_unique_rule_ids(rules)
    spark = df.sparkSession
    if not rules:
        return spark.createDataFrame([], issue_schema())
    meta = spark.createDataFrame(
        [(r.rule_id, r.issue_type, r.column, r.description, r.source, i) for i, r in enumerate(rules)],
        "rule_id string, issue_type string, rule_column string, description string, source string, position int")
    # meta has one row per declared rule: a broadcast of proven size.
    rows = evaluate_rules(df, rules).where(F.col("violation_count") > 0).join(F.broadcast(meta), "rule_id")
    return _issue(rows, F.col("issue_type"),
                  _metrics(violations=F.col("violation_count"), checked=F.col("checked_count"),
                           rule=F.col("description"), source=F.col("source")),
                  _arr(RULE_TREATMENTS), True, 11, issue_id=F.concat(F.lit("rule:"), F.col("rule_id")),
                  column=F.col("rule_column"))


def issue_schema() -> str:
    return ("issue_id string, issue_type string, column string, evidence string, "
            "allowed_treatments array<string>, requires_explicit_human_decision boolean, ordinal int")


def issue_inventory(df: DataFrame, rules: Sequence[ValidationRule] = ()) -> DataFrame:
    """The ordered union of all detectors (order by ``ordinal``).

    The two shared aggregates (row-level metrics of all columns, value
    keys of all columns, without texts) are materialized once, so the table is scanned
    once for each, plus once for duplicates and once for rules."""
    metrics = materialize(scan_metrics(df))
    vc = materialize(value_keys(df))
    parts = [
        missing_value_issues(df, metrics),
        fake_null_issues(metrics),
        categorical_inconsistency_issues(df, vc),
        date_conversion_issues(metrics),
        numeric_conversion_issues(metrics),
        outlier_issues(df, vc),
        formatting_issues(metrics),
        feature_variability_issues(df, vc),
        exact_duplicate_issues(df),
        identifier_issues(df, vc),
        validation_rule_issues(df, rules),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def check_issue_ids(issues: DataFrame) -> None:
    """Ids must be present and unique (one small aggregation)."""
    bad = issues.groupBy("issue_id").agg(F.count(F.lit(1)).alias("k")).where(
        F.col("issue_id").isNull() | (F.col("k") > 1)).limit(1).collect()
    if bad:
        raise ValueError(f"Duplicate or empty data preparation issue ID: {bad[0]['issue_id']!r}.")


# Review questions as codes, one per kind of finding in detector order.
PREPARATION_QUESTIONS: tuple[tuple[str, str], ...] = tuple((kind, f"review_{kind}") for kind in (
    "missing_values", "numeric_conversion", "categorical_inconsistency", "formatting_issue", "date_conversion",
    "identifier", "outlier", "exact_duplicates"))


def preparation_questions(issues: DataFrame) -> DataFrame:
    """I12 questions: one per kind of finding present in the inventory, in a
    fixed order. The question table is a literal of 8 rows (broadcast)."""
    spark = issues.sparkSession
    q = spark.createDataFrame([(i, t, text) for i, (t, text) in enumerate(PREPARATION_QUESTIONS)],
                              "question_order int, issue_type string, question string")
    present = issues.select("issue_type").distinct()
    return F.broadcast(q).join(present, "issue_type", "left_semi").select("question_order", "question")
