"""Approved treatments as DataFrame transformations.

``apply_actions`` folds a list of actions left to right over a DataFrame.
Row-local actions are plain column expressions. Actions that need a
statistic (median, mean, mode, IQR bounds) compute it with one aggregate on
the frame as it is at that step and bring back one scalar; the category
map of ``normalize_categories`` stays a DataFrame and is joined back.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsieve.functions.columns import (
    genuine_missing,
    is_marker_text,
    is_numeric_type,
    is_text_type,
    nan_to_null,
    norm,
    quoted,
    strip,
    textual_null,
    to_number,
)
from tabsieve.functions.canonical import hashable
from tabsieve.functions.dates import date_orders, parse_date
from tabsieve.operators.rules import ValidationRule, violation_flag
from tabsieve.operators.valuecounts import row_key
from tabsieve.plans.lineage import materialize
from tabsieve.plans.ranking import exact_quantiles

OPERATIONS = ("remove_duplicates", "drop_rows", "exclude_feature", "trim_whitespace", "normalize_nulls",
              "normalize_categories", "impute_missing", "convert_numeric", "convert_date", "cap_outliers",
              "set_missing", "fill_constant", "drop_violations")
IMPUTE_STRATEGIES = ("median", "mean", "mode")
COLUMN_FREE = ("remove_duplicates",)


@dataclass(frozen=True)
class Action:
    """One approved treatment: ``operation`` on ``column`` (``strategy`` for
    imputation, ``value`` for a constant fill, ``rule`` for rule-based
    treatments)."""
    operation: str
    column: str | None = None
    strategy: str | None = None
    reason: str = ""
    value: object = None
    rule: ValidationRule | None = None


def _replace(df: DataFrame, column: str, expr: Column) -> DataFrame:
    """Swap one column, keeping column order (one projection)."""
    return df.select(*[expr.alias(c) if c == column else quoted(c) for c in df.columns])


def _require(df: DataFrame, action: Action) -> str:
    if not action.column:
        raise ValueError(f"{action.operation} requires a column.")
    if action.column not in df.columns:
        raise ValueError(f"Cannot apply {action.operation} to unknown column '{action.column}'.")
    return action.column


# --- T1 to T3, T7, T8 ----------------------------------------------------------

BROADCAST_KEYS = 500_000  # rows of two longs


def remove_duplicates(df: DataFrame) -> DataFrame:
    """One of each set of identical rows; identical rows are
    interchangeable, so keeping "the first" is keeping one.

    Two phases: 128-bit row keys are counted (16 bytes a row, combined before
    the shuffle), then only rows whose key repeats are shuffled whole; the
    others stay where they were read. With more than ``BROADCAST_KEYS``
    repeated keys all rows go through one hash aggregate instead."""
    key = row_key(hashable(df))
    repeated = materialize(df.groupBy(key.alias("_row")).agg(F.count(F.lit(1)).alias("_n"))
                           .where(F.col("_n") > 1).select("_row"))
    n = repeated.count()
    if not n:
        return df
    keyed = df.select(key.alias("_row"), F.struct(*map(quoted, df.columns)).alias("_cells"))
    once = F.any_value("_cells").alias("_cells")
    if n > BROADCAST_KEYS:
        return keyed.groupBy("_row").agg(once).select("_cells.*")
    keys = F.broadcast(repeated)
    single = keyed.join(keys, "_row", "left_anti").select("_cells.*")
    return single.union(keyed.join(keys, "_row", "left_semi").groupBy("_row").agg(once).select("_cells.*"))


def drop_missing_rows(df: DataFrame, column: str) -> DataFrame:
    """Keep rows whose value is not genuinely missing (markers stay)."""
    return df.where(~genuine_missing(column, df.schema[column].dataType))


def exclude_feature(df: DataFrame, column: str) -> DataFrame:
    return df.drop(column)


def trim_whitespace(df: DataFrame, column: str) -> DataFrame:
    """Strip text (blank becomes ''), other types untouched."""
    if not is_text_type(df.schema[column].dataType):
        return df
    return _replace(df, column, strip(column))


def normalize_nulls(df: DataFrame, column: str) -> DataFrame:
    """Textual null markers -> null; non-text columns untouched."""
    dt = df.schema[column].dataType
    if not is_text_type(dt):
        return df
    return _replace(df, column, F.when(textual_null(column, dt), F.lit(None).cast(dt)).otherwise(quoted(column)))


# --- T4 -------------------------------------------------------------------------

def category_map(df: DataFrame, column: str, order_by: str | None = None) -> DataFrame:
    """Canonical spelling per strip+lower group with >= 2 raw spellings: the
    most frequent spelling (stripped); ties -> first observed by
    ``order_by``, else the smallest spelling. Markers and nulls excluded."""
    c = quoted(column)
    rows = df.where(c.isNotNull() & ~is_marker_text(c))
    first = F.min(order_by) if order_by else F.min(c)
    spellings = rows.groupBy(norm(c).alias("_key"), c.alias("_raw")).agg(
        F.count(F.lit(1)).alias("_n"), first.alias("_first"))
    return spellings.groupBy("_key").agg(
        F.count(F.lit(1)).alias("_spellings"),
        F.min_by("_raw", F.struct(-F.col("_n"), F.col("_first"), F.col("_raw"))).alias("_pick"),
    ).where(F.col("_spellings") >= 2).select("_key", strip("_pick").alias("_canonical"))


def normalize_categories(df: DataFrame, column: str, order_by: str | None = None) -> DataFrame:
    """T4: replace every spelling of a multi-spelling group by its canonical
    form. The map has one row per such group and is joined without a hint:
    AQE broadcasts it by its measured bytes or splits a hot key."""
    if not is_text_type(df.schema[column].dataType):
        raise ValueError("normalize_categories requires a text column.")
    mapping = category_map(df, column, order_by)
    joined = df.join(mapping, norm(quoted(column)) == F.col("_key"), "left")
    out = F.coalesce(F.col("_canonical"), quoted(column))
    return joined.select(*[out.alias(c) if c == column else quoted(c) for c in df.columns])


# --- T5, T6 ---------------------------------------------------------------------

def modes_of(df: DataFrame, columns: Sequence[str], order_by: str | None = None) -> dict[str, object]:
    """Most frequent non-missing value of each column; ties -> first observed
    by ``order_by``, else the smallest value. One scan and one shuffle for all
    columns (grouping sets keep every column's own type); columns without a
    value are left out."""
    if not columns:
        return {}
    fields = {f.name: f.dataType for f in df.schema.fields}
    names = [f"_v{i}" for i in range(len(columns))]
    values = [F.when(~genuine_missing(c, fields[c]), quoted(c)).alias(n) for c, n in zip(columns, names)]
    rows = df.select(*values, (F.col(order_by) if order_by else F.lit(0)).alias("_o"))
    counts = rows.groupingSets([[F.col(n)] for n in names], *names).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_o").alias("_first"))
    # a group holds the value of its own column only, and none where it is missing
    own = F.coalesce(*[F.when(F.col(n).isNotNull(), F.lit(i)) for i, n in enumerate(names)])
    best = counts.withColumn("_own", own).where(F.col("_own").isNotNull()).groupBy("_own").agg(
        F.min(F.struct((-F.col("_n")).alias("_n"), "_first", *names)).alias("m"))
    return {columns[r["_own"]]: r["m"][names[r["_own"]]] for r in best.collect()}


def impute_statistics(df: DataFrame, wanted: Sequence[tuple[str, str]],
                      order_by: str | None = None) -> dict[str, tuple[object, T.DataType]]:
    """Fill value and resulting type of T5/T6 for ``(column, strategy)`` pairs
    of different columns: at most one pass per strategy, however many columns
    there are."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    by: dict[str, list[str]] = {s: [c for c, t in wanted if t == s] for s in IMPUTE_STRATEGIES}
    for column, strategy in wanted:
        if strategy not in IMPUTE_STRATEGIES:
            raise ValueError(f"Unsupported imputation strategy: {strategy!r}")
        if strategy != "mode" and not is_numeric_type(fields[column]):
            raise ValueError(f"{strategy.capitalize()} imputation requires a numeric column: '{column}'.")
    found: dict[str, object] = {}
    if by["median"]:
        found |= {r["column"]: r["value"] for r in exact_quantiles(df, by["median"], [0.5]).collect()}
    if by["mean"]:
        row = df.agg(*[F.avg(nan_to_null(c, fields[c]).cast("double")) for c in by["mean"]]).first()
        found |= dict(zip(by["mean"], row))
    found |= modes_of(df, by["mode"], order_by)
    out = {}
    for column, strategy in wanted:
        if found.get(column) is None:
            raise ValueError(f"Column '{column}' has no value to take a {strategy} of.")
        dt = fields[column]
        fractional = isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType))
        out[column] = (found[column], dt if strategy == "mode" or fractional else T.DoubleType())
    return out


def impute_statistic(df: DataFrame, column: str, strategy: str, order_by: str | None = None):
    """The fill value of T5/T6 and the column type after filling."""
    return impute_statistics(df, [(column, strategy)], order_by)[column]


def impute_columns(df: DataFrame, wanted: Sequence[tuple[str, str]], order_by: str | None = None) -> DataFrame:
    """T5/T6 on several columns: their statistics together, one projection."""
    fills = impute_statistics(df, wanted, order_by)
    fields = {f.name: f.dataType for f in df.schema.fields}

    def filled(c: str) -> Column:
        value, kind = fills[c]
        return F.when(genuine_missing(c, fields[c]), F.lit(value).cast(kind)).otherwise(quoted(c)).cast(kind)

    return df.select(*[filled(c).alias(c) if c in fills else quoted(c) for c in df.columns])


def fill_missing(df: DataFrame, column: str, value, target_type: T.DataType) -> DataFrame:
    dt = df.schema[column].dataType
    return _replace(df, column, F.when(genuine_missing(column, dt), F.lit(value).cast(target_type))
                    .otherwise(quoted(column)).cast(target_type))


def impute_missing(df: DataFrame, column: str, strategy: str, order_by: str | None = None) -> DataFrame:
    """Fill genuine missing values by the median, mean or mode."""
    return impute_columns(df, [(column, strategy)], order_by)


# --- X1 to X6 -------------------------------------------------------------------

def convert_numeric(df: DataFrame, column: str) -> DataFrame:
    return _replace(df, column, to_number(column))


def convert_date(df: DataFrame, column: str, day_first: bool | None = None) -> DataFrame:
    """Mixed-format date text -> ``timestamp_ntz`` (null where it is no
    date). The order of day and month is elected by the column's texts that
    leave no choice (one pass, see ``functions.dates``) unless it is given."""
    if day_first is None:
        day_first = date_orders(df, [column]).get(column, False)
    return _replace(df, column, parse_date(strip(F.col(f"`{column}`").cast("string")), day_first))


def iqr_bounds(df: DataFrame, column: str) -> tuple[float, float] | None:
    rows = {r["p"]: r["value"] for r in exact_quantiles(df, [column], [0.25, 0.75]).collect()}
    if not rows:
        return None
    q1, q3 = rows[0.25], rows[0.75]
    return q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)


def cap_outliers(df: DataFrame, column: str) -> DataFrame:
    """Clamp to the IQR bounds (nulls and NaN stay)."""
    dt = df.schema[column].dataType
    if not is_numeric_type(dt):
        raise ValueError(f"cap_outliers requires a numeric column: '{column}'.")
    bounds = iqr_bounds(df, column)
    if bounds is None:
        return df
    lo, hi = bounds
    c = quoted(column).cast("double")
    return _replace(df, column, F.when(c.isNull() | F.isnan(c), c).otherwise(F.least(F.greatest(c, F.lit(lo)), F.lit(hi))))


def set_missing(df: DataFrame, rule: ValidationRule) -> DataFrame:
    """Values that violate the rule become null."""
    dt = df.schema[rule.column].dataType
    return _replace(df, rule.column, F.when(violation_flag(df, rule), F.lit(None).cast(dt)).otherwise(F.col(rule.column)))


def fill_constant(df: DataFrame, column: str, value) -> DataFrame:
    """Genuine missing values -> a given literal."""
    dt = df.schema[column].dataType
    return _replace(df, column, F.when(genuine_missing(column, dt), F.lit(value).cast(dt)).otherwise(quoted(column)))


def drop_violations(df: DataFrame, rule: ValidationRule) -> DataFrame:
    """Drop the rows that break the rule."""
    return df.where(~violation_flag(df, rule))


# --- fold -------------------------------------------------------------------------

def apply_action(df: DataFrame, action: Action, order_by: str | None = None) -> DataFrame:
    op = action.operation
    if op == "remove_duplicates":
        return remove_duplicates(df)
    if op in ("set_missing", "drop_violations"):
        if action.rule is None:
            raise ValueError(f"{op} requires a validation rule.")
        return set_missing(df, action.rule) if op == "set_missing" else drop_violations(df, action.rule)
    if op not in OPERATIONS:
        raise ValueError(f"Unsupported data preparation operation: {op!r}")
    column = _require(df, action)
    if op == "drop_rows":
        return drop_missing_rows(df, column)
    if op == "exclude_feature":
        return exclude_feature(df, column)
    if op == "trim_whitespace":
        return trim_whitespace(df, column)
    if op == "normalize_nulls":
        return normalize_nulls(df, column)
    if op == "normalize_categories":
        return normalize_categories(df, column, order_by)
    if op == "impute_missing":
        return impute_missing(df, column, action.strategy or "", order_by)
    if op == "convert_numeric":
        return convert_numeric(df, column)
    if op == "convert_date":
        return convert_date(df, column)
    if op == "cap_outliers":
        return cap_outliers(df, column)
    return fill_constant(df, column, action.value)


STATEFUL = ("normalize_categories", "impute_missing", "cap_outliers", "remove_duplicates")


def apply_actions(df: DataFrame, actions: Sequence[Action], order_by: str | None = None,
                  checkpoint_every: int | None = None) -> DataFrame:
    """Fold actions left to right. With ``checkpoint_every`` the lineage
    is cut after that many aggregate-backed steps (reliable checkpoint);
    neighbouring imputations of different columns are one step."""
    out = df
    heavy = 0
    for run in _runs(actions, order_by):
        if len(run) > 1:
            for a in run:
                _require(out, a)
            out = impute_columns(out, [(a.column, a.strategy or "") for a in run], order_by)
        else:
            out = apply_action(out, run[0], order_by)
        if run[0].operation in STATEFUL:
            heavy += 1
            if checkpoint_every and heavy % checkpoint_every == 0:
                out = materialize(out)
    return out


def _runs(actions: Sequence[Action], order_by: str | None) -> list[list[Action]]:
    """Neighbouring imputations of different columns form one run: none of
    their statistics depends on another's fill. All else stands alone."""
    runs: list[list[Action]] = []
    for a in actions:
        joins = a.operation == "impute_missing" and a.column != order_by and bool(runs) and all(
            b.operation == "impute_missing" and b.column not in (a.column, order_by) for b in runs[-1])
        if joins:
            runs[-1].append(a)
        else:
            runs.append([a])
    return runs
