"""Quality checks.

Row-level predicates are folded into single-pass conditional aggregates
(one scan, one tiny shuffle); value-level checks read the shared
value-count frame. Results are long-form DataFrames, never driver dicts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsieve.functions.columns import (
    NULL_MARKERS,
    casefold,
    folded_norm,
    genuine_missing,
    has_edge_whitespace,
    is_numeric_type,
    is_text_type,
    missing,
    nan_to_null,
    norm,
    quoted,
    strip,
    stripped_or_null,
    textual_null,
    to_number,
)
from tabsieve.functions.canonical import hashable
from tabsieve.functions.dates import parse_date
from tabsieve.operators.valuecounts import (
    BLANK,
    EDGE,
    column_cardinality,
    has_trait,
    row_key,
    spelling_groups,
    text_key,
    text_keys,
    value_counts,
    value_keys,
    values_of_keys,
)
from tabsieve.plans.columnwise import Metric, count_if, count_present, per_column
from tabsieve.plans.lineage import materialize
from tabsieve.plans.ranking import quantiles_from_slices, slice_weights, value_weights

def _check_threshold(name: str, value: float) -> None:
    if not 0 < value <= 1:
        raise ValueError(f"{name} must be greater than 0 and at most 1.")


def _check_min_count(value: int) -> None:
    if value < 1:
        raise ValueError("min_non_null_count must be at least 1.")


# --- A1, A2, P7 -------------------------------------------------------------

def missing_counts(df: DataFrame) -> DataFrame:
    """A1: genuine missing + textual null markers per column (n > 0)."""
    out = per_column(df, df.columns, {"n": count_if(missing)})
    return out.where(F.col("n") > 0).select("column", "n")


def genuine_missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A2: null / NaN per column (n > 0)."""
    cols = list(columns) if columns is not None else df.columns
    out = per_column(df, cols, {"n": count_if(genuine_missing)})
    return out.where(F.col("n") > 0).select("column", "n")


def textual_null_counts(df: DataFrame) -> DataFrame:
    """P7 counts: present text values that are null markers (n > 0)."""
    text = [f.name for f in df.schema.fields if is_text_type(f.dataType)]
    out = per_column(df, text, {"n": count_if(textual_null)})
    return out.where(F.col("n") > 0).select("column", "n")


# --- A3, A4 -------------------------------------------------------------------

def duplicate_row_count(df: DataFrame) -> DataFrame:
    """A3: rows that repeat an earlier identical row. Rows are grouped by a
    128-bit key with map-side combine: no cell is shuffled, and a hot
    duplicate collapses before the shuffle."""
    key = row_key(hashable(df))
    groups = df.groupBy(key.alias("_row")).agg(F.count(F.lit(1)).alias("_k"))
    return groups.agg(F.coalesce(F.sum(F.col("_k") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))


def duplicate_values(df: DataFrame, columns: Sequence[str] | None = None, by_frequency: bool = False) -> DataFrame:
    """A4: non-null values (as stripped text) that occur more than once.

    Repeated values are found by 128-bit keys; only their texts are fetched,
    so a value that occurs once is never shuffled. ``by_frequency`` sorts the
    rows by column, falling count and value (L4)."""
    cols = list(columns) if columns is not None else list(df.columns)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, value string, n bigint")
    repeated = text_keys(df, cols, strip).where(F.col("key").isNotNull() & (F.col("n") > 1))
    out = values_of_keys(df, cols, repeated, strip)
    return out.orderBy("column", F.desc("n"), "value") if by_frequency else out


# --- A5, A6 -------------------------------------------------------------------

def iqr_summary(df: DataFrame, columns: Sequence[str] | None = None, include_empty: bool = False,
                counts: DataFrame | None = None) -> DataFrame:
    """q1, q3 (exact, linear), iqr, bounds q -/+ 1.5 iqr and the number
    of values strictly outside. Every numeric column is reported; with
    ``include_empty`` an all-null column yields zeros (A5), otherwise it is
    skipped (A6). ``counts`` (``column, v, w``) may be passed when the value
    counts already exist; the sliced counts serve both the quantiles and
    the outlier count, so the table is scanned once."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    cols = [c for c in (columns if columns is not None else df.columns) if is_numeric_type(fields[c])]
    if columns is not None:
        bad = [c for c in columns if c not in fields]
        if bad:
            raise KeyError(f"Column(s) {bad} do not exist.")
        non_numeric = [c for c in columns if not is_numeric_type(fields[c])]
        if non_numeric:
            raise TypeError(f"Column(s) {non_numeric} must be numeric for IQR outlier detection.")
    # The materialized slices serve the quantiles and the outlier count.
    sliced = slice_weights(counts if counts is not None else value_weights(df, cols))
    q = quantiles_from_slices(sliced, [0.25, 0.75])
    bounds = q.groupBy("column").agg(
        F.first(F.when(F.col("p") == 0.25, F.col("value")), ignorenulls=True).alias("q1"),
        F.first(F.when(F.col("p") == 0.75, F.col("value")), ignorenulls=True).alias("q3"),
    ).select(
        "column", "q1", "q3", (F.col("q3") - F.col("q1")).alias("iqr"),
        (F.col("q1") - F.lit(1.5) * (F.col("q3") - F.col("q1"))).alias("lower_bound"),
        (F.col("q3") + F.lit(1.5) * (F.col("q3") - F.col("q1"))).alias("upper_bound"),
    )
    # bounds has one row per numeric column: a broadcast of proven size.
    outside = (F.col("v") < F.col("lower_bound")) | (F.col("v") > F.col("upper_bound"))
    outliers = sliced.join(F.broadcast(bounds), "column").groupBy("column").agg(
        F.coalesce(F.sum(F.when(outside, F.col("w"))), F.lit(0)).cast("long").alias("outlier_count"))
    result = bounds.join(outliers, "column")
    if include_empty and cols:
        spark = df.sparkSession
        all_cols = spark.createDataFrame([(c,) for c in cols], "column string")
        zero = F.lit(0.0)
        result = all_cols.join(result, "column", "left").select(
            "column", *[F.coalesce(quoted(c), zero).alias(c) for c in ("q1", "q3", "iqr", "lower_bound", "upper_bound")],
            F.coalesce(F.col("outlier_count"), F.lit(0).cast("long")).alias("outlier_count"))
    return result


def numeric_weights_from_value_counts(vc: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """``column, v, w`` for numeric columns from the value keys."""
    return (vc.where(F.col("column").isin(*numeric) & F.col("value").isNotNull())
            .groupBy("column", F.col("num").alias("v")).agg(F.sum("n").alias("w")))


# --- A7, A8 -------------------------------------------------------------------

def numeric_like_columns(df: DataFrame, threshold: float = 0.8, evidence_names: bool = False) -> DataFrame:
    """A7 (A8 with ``evidence_names``): text columns whose non-null values
    mostly parse as numbers. Blanks count in the denominator."""
    _check_threshold("threshold", threshold)
    text = [f.name for f in df.schema.fields if is_text_type(f.dataType)]
    out = per_column(df, text, {
        "numeric_like_count": count_present(lambda c, dt: to_number(c)),
        "non_null_count": count_present(lambda c, dt: quoted(c)),
    })
    ratio = F.col("numeric_like_count") / F.col("non_null_count")
    name = "numeric_like_ratio" if evidence_names else "proportion"
    return out.where((F.col("non_null_count") > 0) & (ratio >= threshold)).select(
        "column", "numeric_like_count", "non_null_count", ratio.alias(name))


# --- A9, A10, A11, A12 -------------------------------------------------------

BROADCAST_GROUPS = 500_000  # rows of fixed width, about 50 bytes each


def categorical_inconsistencies(df: DataFrame, columns: Sequence[str] | None = None,
                                skip_markers: bool = True) -> DataFrame:
    """Raw spellings that share a strip+lower form; A10 with
    ``skip_markers=False``: that share a strip+casefold form (sharp s and
    double s are one), null markers included; one row per spelling, for groups with > 1 spelling.

    Long form ``column, normalized, variant, n_variants``: the list of
    variants of a group is data, so it is not folded into one array. Groups
    are found by key; only the texts of those with more than one spelling are
    fetched, by a second pass that joins the group keys: broadcast after a
    count of their rows, else left to AQE, which can split a hot group."""
    text = [f.name for f in df.schema.fields if is_text_type(f.dataType)
            and (columns is None or f.name in columns)]
    if not text:
        return df.sparkSession.createDataFrame(
            [], "column string, normalized string, variant string, n_variants bigint")
    fold, form = (F.lower, norm) if skip_markers else (casefold, folded_norm)
    groups = materialize(spelling_groups(value_keys(df, text, fold), skip_markers).drop("rows"))
    if groups.count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    cells = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("variant")) for c in text])).alias("r"))
    # folded once a row, in a projection of its own
    cells = cells.select("r.*").where(F.col("variant").isNotNull()).withColumn("folded", form("variant"))
    cells = cells.select("column", "variant", text_key(F.col("folded")).alias("form"))
    found = cells.join(groups, ["column", "form"]).groupBy("column", "variant", "n_variants").agg(
        F.count(F.lit(1)).alias("n"))
    return found.select("column", form("variant").alias("normalized"), "variant", "n_variants")


def string_formatting_issues(df: DataFrame, columns: Sequence[str] | None = None,
                             vc: DataFrame | None = None) -> DataFrame:
    """(a) values with leading/trailing whitespace; (b) rows in a
    non-blank strip+lower group that has more than one raw spelling."""
    text = [f.name for f in df.schema.fields if is_text_type(f.dataType)
            and (columns is None or f.name in columns)]
    if columns is not None:
        bad = [c for c in columns if c not in df.columns]
        if bad:
            raise KeyError(f"Column(s) {bad} do not exist.")
        wrong = [c for c in columns if c not in text]
        if wrong:
            raise TypeError(f"Column(s) {wrong} must contain string-like values.")
    vc = vc if vc is not None else value_keys(df, text)
    present = vc.where(F.col("column").isin(*text) & F.col("value").isNotNull())
    ws = present.groupBy("column").agg(
        F.coalesce(F.sum(F.when(has_trait(EDGE), F.col("n"))), F.lit(0)).alias("whitespace_count"))
    case = spelling_groups(present.where(~has_trait(BLANK)), skip_markers=False).groupBy("column").agg(
        F.sum("rows").alias("case_inconsistency_count"))
    spark = df.sparkSession
    all_cols = spark.createDataFrame([(c,) for c in text], "column string")
    return all_cols.join(ws, "column", "left").join(case, "column", "left").select(
        "column",
        F.coalesce("whitespace_count", F.lit(0)).cast("long").alias("whitespace_count"),
        F.coalesce("case_inconsistency_count", F.lit(0)).cast("long").alias("case_inconsistency_count"),
    )


def whitespace_counts(df: DataFrame) -> DataFrame:
    """Text columns with leading/trailing whitespace (one scan)."""
    text = [f.name for f in df.schema.fields if is_text_type(f.dataType)]
    out = per_column(df, text, {"whitespace_count": count_if(lambda c, dt: has_edge_whitespace(c))})
    return out.where(F.col("whitespace_count") > 0).select("column", "whitespace_count")


# --- A13, A14, A17, A18 -------------------------------------------------------

def identifier_columns(df: DataFrame, threshold: float = 0.95, min_non_null_count: int = 20,
                       text_only: bool = True, exclude: Sequence[str] = (), vc: DataFrame | None = None,
                       approx_rsd: float | None = None) -> DataFrame:
    """A13 (text columns, >= ``min_non_null_count`` values) or A14
    (``text_only=False, min_non_null_count=1``): distinct / non-null >= threshold.

    ``approx_rsd`` switches to one pass of HyperLogLog
    (``approx_count_distinct``, relative standard deviation ``approx_rsd``)
    instead of the exact value keys: no shuffle of keys."""
    _check_threshold("threshold", threshold)
    _check_min_count(min_non_null_count)
    cols = [f.name for f in df.schema.fields
            if (is_text_type(f.dataType) or not text_only) and f.name not in exclude]
    if approx_rsd is not None:
        card = per_column(df, cols, {
            "non_null_count": count_present(lambda c, dt: nan_to_null(c, dt)),
            "distinct_count": Metric(lambda c, dt: nan_to_null(c, dt).cast("string"),
                                     lambda x: F.approx_count_distinct(x, approx_rsd), "string"),
        })
    else:
        vc = vc if vc is not None else value_keys(df, cols)
        card = column_cardinality(vc.where(F.col("column").isin(*cols)))
    ratio = F.col("distinct_count") / F.col("non_null_count")
    return card.where((F.col("non_null_count") >= min_non_null_count) & (ratio >= threshold)).select(
        "column", "non_null_count", "distinct_count", ratio.alias("unique_ratio"))


def constant_features(df: DataFrame, dominance_threshold: float = 0.95, min_non_null_count: int = 20,
                      vc: DataFrame | None = None) -> DataFrame:
    """One distinct non-null value -> constant; otherwise, with enough
    values, a dominant value share >= threshold -> near-constant."""
    _check_threshold("dominance_threshold", dominance_threshold)
    _check_min_count(min_non_null_count)
    vc = vc if vc is not None else value_keys(df)
    card = column_cardinality(vc)
    share = F.col("top_count") / F.col("non_null_count")
    kind = (
        F.when(F.col("distinct_count") == 1, F.lit("constant_feature"))
        .when((F.col("non_null_count") >= min_non_null_count) & (share >= dominance_threshold),
              F.lit("near_constant_feature"))
    )
    return card.where(F.col("non_null_count") > 0).select(
        "column", kind.alias("issue_type"), "non_null_count", "distinct_count",
        F.when(F.col("distinct_count") == 1, F.lit(1.0)).otherwise(share).alias("dominant_proportion"),
    ).where(F.col("issue_type").isNotNull())


def constant_columns(df: DataFrame, exclude: Sequence[str] = (), vc: DataFrame | None = None) -> DataFrame:
    """At most one distinct non-null value (all-null columns included;
    every column of an empty table)."""
    cols = [c for c in df.columns if c not in exclude]
    vc = vc if vc is not None else value_keys(df, cols)
    card = column_cardinality(vc.where(F.col("column").isin(*cols)))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    counted = names.join(card, "column", "left").select(
        "column", F.coalesce("distinct_count", F.lit(0).cast("long")).alias("distinct_count"))
    return counted.where(F.col("distinct_count") <= 1)


# --- A15, A16 -------------------------------------------------------------------

def date_candidate_columns(df: DataFrame, threshold: float = 0.8, modeling: bool = False,
                           exclude: Sequence[str] = ()) -> DataFrame:
    """Stripped non-blank text, skipped when mostly numeric, date-parse
    share >= threshold. A16 (``modeling``): raw values, blanks kept, no
    numeric exclusion."""
    _check_threshold("threshold", threshold)
    text = [f.name for f in df.schema.fields if is_text_type(f.dataType) and f.name not in exclude]
    if modeling:
        out = per_column(df, text, {
            "value_count": count_present(lambda c, dt: quoted(c)),
            "numeric_count": count_if(lambda c, dt: F.lit(False)),
            "date_count": count_present(lambda c, dt: parse_date(c)),
        })
    else:
        def kept(c: str) -> Column:
            return stripped_or_null(c)
        out = per_column(df, text, {
            "value_count": count_present(lambda c, dt: kept(c)),
            "numeric_count": count_present(lambda c, dt: to_number(kept(c))),
            "date_count": count_present(lambda c, dt: parse_date(kept(c))),
        })
    n = F.col("value_count")
    numeric_ratio = F.col("numeric_count") / n
    date_ratio = F.col("date_count") / n
    keep = (n > 0) & (date_ratio >= threshold)
    if not modeling:
        keep = keep & (numeric_ratio < threshold)
    return out.where(keep).select("column", "value_count", numeric_ratio.alias("numeric_ratio"),
                                  date_ratio.alias("date_ratio"))


# --- A30, A31 -------------------------------------------------------------------

def dataset_health(df: DataFrame) -> DataFrame:
    """Rows, columns, duplicate rows and missing-or-marker cells. One
    per-column pass (which also counts the rows) and one duplicate pass."""
    per = per_column(df, df.columns, {"missing": count_if(missing), "rows": count_if(lambda c, dt: F.lit(True))})
    cells = per.agg(F.coalesce(F.sum("missing"), F.lit(0)).cast("long").alias("missing_cells"),
                    F.coalesce(F.max("rows"), F.lit(0)).cast("long").alias("row_count"))
    dup = duplicate_row_count(df)
    # two one-row aggregates stacked and folded: no join needed
    stacked = cells.unionByName(dup, allowMissingColumns=True)
    return stacked.agg(
        F.max("row_count").alias("row_count"), F.lit(len(df.columns)).alias("column_count"),
        F.max("duplicate_rows").alias("duplicate_rows"), F.max("missing_cells").alias("missing_cells"))


def profile_headline(df: DataFrame) -> DataFrame:
    """One row per check (check, affected_columns, affected_rows) for the
    checks that found something, from A1, A3, A7, A9, A11 and A5. Row-level
    counts come from one materialized pass, value-level ones from one
    materialized value-count frame."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    text = [c for c in df.columns if is_text_type(fields[c])]
    numeric = [c for c in df.columns if is_numeric_type(fields[c])]
    metrics = materialize(per_column(df, df.columns, {
        "missing": count_if(missing),
        "numeric_like": count_present(lambda c, dt: to_number(c) if is_text_type(dt) else F.lit(None)),
        "non_null": count_present(lambda c, dt: quoted(c)),
    }))
    vc = materialize(value_keys(df))
    either = F.col("whitespace_count") + F.col("case_inconsistency_count")
    like = metrics.where(F.col("column").isin(*text) & (F.col("non_null") > 0)
                         & (F.try_divide(F.col("numeric_like"), F.col("non_null")) >= 0.8))
    parts = [
        metrics.where(F.col("missing") > 0).agg(F.lit("missing_or_null_like").alias("check"),
                                                F.count(F.lit(1)).alias("affected_columns"),
                                                F.sum("missing").alias("affected_rows")),
        duplicate_row_count(df).select(F.lit("duplicate_rows").alias("check"),
                                       F.when(F.col("duplicate_rows") > 0, 0).alias("affected_columns"),
                                       F.col("duplicate_rows").alias("affected_rows")),
        like.agg(F.lit("numeric_like_text").alias("check"), F.count(F.lit(1)).alias("affected_columns"),
                 F.sum("numeric_like").alias("affected_rows")),
        spelling_groups(vc).agg(F.lit("categorical_inconsistency").alias("check"),
                                F.count_distinct("column").alias("affected_columns"),
                                F.sum("n_variants").alias("affected_rows")),
        string_formatting_issues(df, vc=vc).where(F.col("whitespace_count") > 0).agg(
            F.lit("leading_or_trailing_whitespace").alias("check"),
            F.count(F.lit(1)).alias("affected_columns"), F.sum("whitespace_count").alias("affected_rows")),
        string_formatting_issues(df, vc=vc).where(either > 0).agg(
            F.lit("string_formatting").alias("check"),
            F.count(F.lit(1)).alias("affected_columns"), F.sum(either).alias("affected_rows")),
        iqr_summary(df, counts=numeric_weights_from_value_counts(vc, numeric)).where(F.col("outlier_count") > 0).agg(
            F.lit("iqr_outliers").alias("check"), F.count(F.lit(1)).alias("affected_columns"),
            F.sum("outlier_count").alias("affected_rows")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("affected_rows") > 0).select(
        "check", F.col("affected_columns").cast("long").alias("affected_columns"),
        F.col("affected_rows").cast("long").alias("affected_rows"))
