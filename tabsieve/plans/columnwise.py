"""Per-column and per-pair statistics in one scan.

A metric is a per-row value plus the aggregate over it. For a few columns
the aggregates go into one wide ``agg`` (one row out). When the aggregate
gets wide (many columns x metrics, or many column pairs), Spark drops
whole-stage codegen for it (too many buffer fields) and evaluates it
interpreted; then each row is instead exploded into one record per column
(or pair) and grouped by column. That keeps a single scan, a tiny
partial-aggregate shuffle and codegen, whatever the table width.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Above this many aggregate expressions in one ``agg`` we use the long form.
WIDE_AGG_LIMIT = 48


@dataclass(frozen=True)
class Metric:
    row: Callable[[str, T.DataType], Column]
    agg: Callable[[Column], Column]
    row_type: str


def count_if(pred: Callable[[str, T.DataType], Column]) -> Metric:
    """Rows where ``pred`` holds (null counts as false)."""
    return Metric(lambda c, dt: F.coalesce(pred(c, dt), F.lit(False)),
                  lambda x: F.count(F.when(x, F.lit(1))), "boolean")


def count_present(expr: Callable[[str, T.DataType], Column]) -> Metric:
    """Rows where ``expr`` is not null."""
    return count_if(lambda c, dt: expr(c, dt).isNotNull())


def numeric(fn: Callable[[Column], Column], expr: Callable[[str, T.DataType], Column]) -> Metric:
    """``fn`` (avg, min, stddev_samp, ...) over a double-valued row expression."""
    return Metric(lambda c, dt: expr(c, dt).cast("double"), fn, "double")


def per_column(df: DataFrame, columns: Sequence[str], metrics: dict[str, Metric],
               applies: Callable[[str, T.DataType], Collection[str]] | None = None) -> DataFrame:
    """Rows ``(column, position, metric...)``, one per column, in one scan.

    ``applies(column, type)`` names the metrics that apply to a column (all
    by default); the others are 0 for counts and null otherwise, without an
    aggregate, so only applicable aggregates count towards the width."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    names = list(metrics)
    if not columns:
        schema = "column string, position int, " + ", ".join(
            f"`{m}` {'bigint' if metrics[m].row_type == 'boolean' else 'double'}" for m in names)
        return df.sparkSession.createDataFrame([], schema)
    used = {c: set(names if applies is None else applies(c, fields[c])) for c in columns}

    def absent(m: str) -> Column:
        return F.lit(0).cast("long") if metrics[m].row_type == "boolean" else F.lit(None).cast("double")

    if sum(len(used[c]) for c in columns) <= WIDE_AGG_LIMIT:
        rows = [
            F.struct(F.lit(c).alias("column"), F.lit(df.columns.index(c)).alias("position"),
                     *[(metrics[m].agg(metrics[m].row(c, fields[c])) if m in used[c] else absent(m)).alias(m)
                       for m in names])
            for c in columns
        ]
        return df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    # Records carry the column's position only (an int key hashes cheaper
    # than a name); names are attached to the #columns result rows.
    records = F.explode(F.array(*[
        F.struct(F.lit(df.columns.index(c)).alias("position"),
                 *[(metrics[m].row(c, fields[c]) if m in used[c] else F.lit(None))
                   .cast(metrics[m].row_type).alias(f"_v{i}")
                   for i, m in enumerate(names)])
        for c in columns
    ])).alias("t")
    long = df.select(records).select("t.*")
    all_names = F.array(*[F.lit(c) for c in df.columns])
    return long.groupBy("position").agg(
        *[metrics[m].agg(F.col(f"_v{i}")).alias(m) for i, m in enumerate(names)]).select(
        F.element_at(all_names, F.col("position") + 1).alias("column"), "position", *names)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson r over rows where both are present; null when a side has zero
    variance (plain ``corr`` raises under ANSI mode)."""
    xb = F.when(y.isNotNull(), x)
    yb = F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(xb) * F.stddev_pop(yb))


def pair_correlations(df: DataFrame, pairs: Sequence[tuple[str, str]],
                      value: Callable[[str], Column]) -> DataFrame:
    """Rows ``(a, b, r)`` for the given column pairs, in one scan."""
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    # each pair keeps ~10 aggregation buffer fields
    if len(pairs) * 3 <= WIDE_AGG_LIMIT // 2:
        row = df.agg(F.array(*[
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), safe_corr(value(a), value(b)).alias("r"))
            for a, b in pairs]).alias("p"))
        return row.select(F.explode("p").alias("p")).select("p.*")
    records = F.explode(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), value(a).alias("x"), value(b).alias("y"))
        for a, b in pairs])).alias("t")
    return df.select(records).select("t.*").groupBy("a", "b").agg(safe_corr(F.col("x"), F.col("y")).alias("r"))
