"""Exploratory statistics and table metadata (A19 to A27, P1 to P5, P8 to P10,
P13)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsieve.functions.columns import (
    is_numeric_type,
    is_text_type,
    nan_to_null,
    quoted,
    require_columns,
)
from tabsieve.plans.gram import gram_correlations
from tabsieve.plans.columnwise import count_if, count_present, numeric, pair_correlations, per_column
from tabsieve.operators.valuecounts import column_cardinality, text_keys, value_counts, value_keys, values_of_keys
from tabsieve.plans.lineage import materialize
from tabsieve.plans.ranking import approx_quantiles, exact_quantiles

# --- fixed values -----------------------------------------------------------
# Column-name fragments whose values are masked in a preview.
MASKED_COLUMN_TERMS: tuple[str, ...] = (
    "account", "customer_id", "email", "phone", "postcode", "postal", "address",
)
# Column-name fragments that hint at target leakage.
LEAKAGE_TERMS: tuple[str, ...] = (
    "target", "outcome", "label", "response", "prediction", "predicted", "actual", "result", "future",
)
PREVIEW_ROWS = 10
TOP_VALUES = 10
# ---------------------------------------------------------------------------


def _numeric(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType) and f.name not in exclude]


def _text(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if is_text_type(f.dataType) and f.name not in exclude]


# --- A19 -----------------------------------------------------------------------

def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None,
                    approx_accuracy: int | None = None) -> DataFrame:
    """count, mean, std (ddof 1), min, exact 25/50/75 % and max per numeric
    column. Moments come from one aggregate pass; quantiles from the
    distributed rank plan (or, with ``approx_accuracy``, from one pass of
    ``percentile_approx``). Both sides have one row per column."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    cols = [c for c in (columns or _numeric(df)) if is_numeric_type(fields[c])]
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "column string, count bigint, mean double, std double, min double, p25 double, "
                "p50 double, p75 double, max double")

    def v(c: str) -> Column:
        return nan_to_null(c, fields[c]).cast("double")

    moments = per_column(df, cols, {
        "count": count_present(lambda c, dt: v(c)),
        "mean": numeric(F.avg, lambda c, dt: v(c)),
        "std": numeric(F.stddev_samp, lambda c, dt: v(c)),
        "min": numeric(F.min, lambda c, dt: v(c)),
        "max": numeric(F.max, lambda c, dt: v(c)),
    })
    quantiles = (exact_quantiles(df, cols, [0.25, 0.5, 0.75]) if approx_accuracy is None
                 else approx_quantiles(df, cols, [0.25, 0.5, 0.75], approx_accuracy))
    q = quantiles.groupBy("column").agg(
        *[F.first(F.when(F.col("p") == p, F.col("value")), ignorenulls=True).alias(name)
          for p, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))])
    return moments.join(F.broadcast(q), "column", "left").select(
        "column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


# --- A20 -----------------------------------------------------------------------

TIED_KEYS = 20_000  # values tied with the k-th of a column whose texts are fetched by key


def categorical_top_values(df: DataFrame, k: int = TOP_VALUES, columns: Sequence[str] | None = None) -> DataFrame:
    """Top ``k`` values per text column by frequency (null is a value), with
    the column's distinct non-null count. Ties: value ascending, null last.

    Values are counted by 128-bit key, so no text is shuffled for that. Only
    keys that can be among the first ``k`` (counted at least as often as the
    column's k-th) get their texts fetched. A column in which more than
    ``TIED_KEYS`` values tie with the k-th (an identifier) is counted by text,
    since the order of its texts decides."""
    cols = list(columns) if columns is not None else _text(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, value string, n long, rank int, unique_count long")
    keys = materialize(text_keys(df, cols))
    first = Window.partitionBy("column").orderBy(F.desc("n"))
    # row_number() <= k is planned with a partial WindowGroupLimit before the shuffle
    kth = keys.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k).groupBy("column").agg(F.min("n").alias("kth"))
    able = keys.join(F.broadcast(kth), "column").where(F.col("n") >= F.col("kth"))  # kth: one row a column
    sizes = keys.groupBy("column").agg(F.count("key").alias("unique_count"))
    crowded = {r["column"] for r in able.groupBy("column").agg(F.count(F.lit(1)).alias("m"))
               .where(F.col("m") > k + TIED_KEYS).select("column").collect()}
    fetched = [c for c in cols if c not in crowded]
    parts = [able.where(F.col("key").isNull()).select("column", F.lit(None).cast("string").alias("value"), "n")
             .where(F.col("column").isin(*fetched))] if fetched else []
    if fetched:
        parts.append(values_of_keys(df, fetched, able.where(F.col("key").isNotNull())))
    if crowded:
        parts.append(value_counts(df, sorted(crowded)).select("column", "value", "n"))
    counted = parts[0]
    for p in parts[1:]:
        counted = counted.unionByName(p)
    rank = Window.partitionBy("column").orderBy(F.desc("n"), F.asc_nulls_last("value"))
    top = counted.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return top.join(F.broadcast(sizes), "column").select("column", "value", "n", "rank", "unique_count")


# --- A21, A22, A23 -------------------------------------------------------------

def numeric_correlations(df: DataFrame) -> DataFrame:
    """Correlation matrix without the diagonal, long form; < 2 numeric
    columns -> empty. One scan whatever the number of columns: tasks fold
    their rows into blocks of cross products (``plans.gram``)."""
    cols = _numeric(df)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "column string, other_column string, r double")
    return gram_correlations(df, cols)


def target_correlations(df: DataFrame, target: str, require_variation: bool = False) -> DataFrame:
    """A22 (A23 with ``require_variation``): r of each numeric feature with a
    numeric target; undefined correlations are dropped."""
    require_columns(df, [target])
    fields = {f.name: f.dataType for f in df.schema.fields}
    if not is_numeric_type(fields[target]):
        if require_variation:
            return df.sparkSession.createDataFrame([], "column string, r double")
        raise TypeError(f"Target column '{target}' must be numeric.")
    cols = _numeric(df, exclude=[target])
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, r double")
    if require_variation:
        # A23 only reports when the target takes more than one value.
        y = nan_to_null(target, fields[target])
        if not df.agg(F.coalesce(F.min(y) < F.max(y), F.lit(False)).alias("v")).first()["v"]:
            return df.sparkSession.createDataFrame([], "column string, r double")
    out = pair_correlations(df, [(c, target) for c in cols],
                            lambda c: nan_to_null(c, fields[c]).cast("double")).select(F.col("a").alias("column"), "r")
    return out.where(F.col("r").isNotNull()).select("column", "r")


# --- A24, A25, A26, A27 -------------------------------------------------------

def _check_binary_numeric_target(df: DataFrame, target: str) -> None:
    require_columns(df, [target])
    if not is_numeric_type(df.schema[target].dataType):
        raise TypeError(f"Target column '{target}' must be numeric.")
    y = nan_to_null(target, df.schema[target].dataType)
    bad = df.where(y.isNotNull() & ~y.isin(0, 1)).limit(1).count()
    if bad:
        raise ValueError(f"Target column '{target}' must contain only 0 and 1.")


def target_rate_by_category(df: DataFrame, target: str, check: bool = True,
                            max_levels: int | None = None) -> DataFrame:
    """Per text column and value (null kept as a group): number of
    non-null targets and mean target. A25 with ``max_levels`` (columns with
    more distinct values are skipped) and ``check=False``."""
    if check:
        _check_binary_numeric_target(df, target)
    cols = _text(df, exclude=[target])
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, value string, n bigint, target_rate double")
    y = nan_to_null(target, df.schema[target].dataType).cast("double")
    if max_levels is not None:
        cols = _with_few_levels(df, cols, max_levels)
        if not cols:
            return df.sparkSession.createDataFrame([], "column string, value string, n bigint, target_rate double")
    long = df.select(y.alias("_y"), *[quoted(c).cast("string").alias(c) for c in cols]).unpivot(
        ["_y"], list(map(quoted, cols)), "column", "value")
    return long.groupBy("column", "value").agg(
        F.count("_y").alias("n"), F.avg("_y").alias("target_rate"))


def _with_few_levels(df: DataFrame, cols: Sequence[str], max_levels: int) -> list[str]:
    """Columns with at most ``max_levels`` distinct values, so that only these
    are unpivoted; one row a column reaches the driver."""
    few = column_cardinality(value_keys(df, cols)).where(F.col("distinct_count") <= max_levels)
    kept = {r["column"] for r in few.select("column").collect()}
    return [c for c in cols if c in kept]


def category_target_distribution(df: DataFrame, target: str, k: int = 20, max_levels: int = 50) -> DataFrame:
    """For a non-numeric target, the ``k`` most frequent target values
    per category value (ties by target value), columns with <= max_levels."""
    cols = _text(df, exclude=[target])
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, value string, target_value string, n bigint")
    cols = _with_few_levels(df, cols, max_levels)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, value string, target_value string, n bigint")
    long = df.select(quoted(target).cast("string").alias("_t"), *[quoted(c).cast("string").alias(c) for c in cols]) \
        .unpivot(["_t"], list(map(quoted, cols)), "column", "value")
    counts = long.where(F.col("_t").isNotNull()).groupBy("column", "value", "_t").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("column", "value").orderBy(F.desc("n"), F.asc("_t"))
    return counts.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).select(
        "column", "value", F.col("_t").alias("target_value"), "n")


def target_profile(df: DataFrame, target: str) -> DataFrame:
    """One row with the target's dtype, missing count and distinct
    count (the distribution is :func:`target_distribution`)."""
    require_columns(df, [target])
    dt = df.schema[target].dataType
    y = nan_to_null(target, dt)
    return df.agg(
        F.lit(dt.simpleString()).alias("target_dtype"),
        F.count(F.when(y.isNull(), F.lit(1))).alias("target_missing_count"),
        F.count_distinct(y).alias("target_distinct_count"))


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    """Non-missing target values with their counts."""
    require_columns(df, [target])
    y = nan_to_null(target, df.schema[target].dataType)
    return df.where(y.isNotNull()).groupBy(y.cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))


# --- P1 to P5, P10, P13 --------------------------------------------------------

def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("column_count", F.lit(len(df.columns)))


def schema_summary(df: DataFrame) -> DataFrame:
    """Column, dtype, position and the numeric/text selections."""
    rows = [(f.name, f.dataType.simpleString(), i, is_numeric_type(f.dataType), is_text_type(f.dataType))
            for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(
        rows, "column string, dtype string, position int, is_numeric boolean, is_text boolean")


def column_information(df: DataFrame) -> DataFrame:
    """Column, dtype, genuine missing count, distinct non-null count."""
    card = column_cardinality(value_keys(df))
    meta = schema_summary(df).select("column", "dtype", "position")
    none = F.lit(0).cast("long")  # an empty table still has one row per column
    return meta.join(card, "column", "left").select(
        "column", "dtype", F.coalesce("null_count", none).alias("missing_values"),
        F.coalesce("distinct_count", none).alias("unique_values"))


def target_candidates(df: DataFrame) -> DataFrame:
    """P10: numeric columns whose non-null values are a subset of {0, 1}."""
    cols = _numeric(df)
    out = per_column(df, cols, {"other": count_if(lambda c, dt: nan_to_null(c, dt).isNotNull() & ~nan_to_null(c, dt).isin(0, 1))})
    return out.where(F.col("other") == 0).select("column")


def leakage_name_columns(df: DataFrame, target: str) -> DataFrame:
    """Feature names (casefolded) containing a leakage term."""
    t = target.strip().casefold()
    rows = [(c,) for c in df.columns
            if c.strip().casefold() != t and any(term in c.strip().casefold() for term in LEAKAGE_TERMS)]
    return df.sparkSession.createDataFrame(rows, "column string")


# --- P8, P9 --------------------------------------------------------------------

def mask_value(c: str | Column) -> Column:
    """Null -> ''; up to 4 characters -> all '*'; else keep the first and
    last two characters."""
    s = (quoted(c) if isinstance(c, str) else c).cast("string")
    n = F.length(s)
    return (
        F.when(s.isNull(), F.lit(""))
        .when(n <= 4, F.repeat(F.lit("*"), n))
        .otherwise(F.concat(F.substring(s, 1, 2), F.repeat(F.lit("*"), n - 4), F.substring(s, -2, 2)))
    )


def should_mask(column: str) -> bool:
    name = column.lower()
    return any(term in name for term in MASKED_COLUMN_TERMS)


def safe_preview(df: DataFrame, order_by: Sequence[str], n: int = PREVIEW_ROWS) -> DataFrame:
    """The first ``n`` rows by ``order_by`` (a top-k, planned as
    TakeOrderedAndProject), masked columns rendered with :func:`mask_value`."""
    return df.orderBy(*order_by).limit(n).select(
        *[mask_value(c).alias(c) if should_mask(c) else quoted(c) for c in df.columns])
