"""Distributed running sums and exact order statistics.

Spark's ``Window`` with an ORDER BY but no (or a coarse) PARTITION BY pulls
every row of a partition key into one task. Exact quantiles, ROC AUC,
threshold sweeps and stratified quotas all need "how many rows come before
me", so they share one helper that never does that:

1. range-partition the rows on ``(group, order)`` so every task owns one
   contiguous slice of the order, and materialize the slice ids
   (``lineage.materialize``);
2. running sum inside each slice (window keyed by ``(slice, group)``, so a
   window partition is at most one range partition);
3. the per-slice totals form a tiny frame (at most #slices + #groups rows);
   its prefix sums are the slice offsets, broadcast back by equi-join.

Callers feed rows with unique ``(group, order)`` keys; duplicates are
collapsed beforehand into a weight (value counts, grouped scores), so one hot
value can never fill a slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsieve.functions.columns import is_numeric_type, nan_to_null, quoted
from tabsieve.plans.lineage import materialize


def _num_slices(df: DataFrame, num_slices: int | None) -> int:
    if num_slices:
        return num_slices
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def cumulative_before(
    df: DataFrame,
    order_by: Sequence[Column],
    group_by: Sequence[str] = (),
    weight: str | Column | dict[str, Column] | None = None,
    num_slices: int | None = None,
) -> DataFrame:
    """Adds ``cum_before`` (sum of ``weight`` over rows of the same group
    strictly earlier in ``order_by``) and ``group_total``.

    ``weight`` defaults to 1 per row (then ``cum_before`` is a 0-based row
    number). A dict ``{name: column}`` carries several weights at once and
    adds ``cum_<name>`` / ``total_<name>`` instead. The (group, order) key
    should be unique per row (pre-aggregate duplicates into weights).
    """
    if isinstance(weight, dict):
        weights = dict(weight)
        names = {k: (f"cum_{k}", f"total_{k}") for k in weights}
    else:
        w = F.lit(1).cast("long") if weight is None else (F.col(weight) if isinstance(weight, str) else weight)
        weights = {"": w}
        names = {"": ("cum_before", "group_total")}
    wcols = {k: f"_w{i}" for i, k in enumerate(weights)}
    groups = [F.col(g) for g in group_by]
    n = _num_slices(df, num_slices)
    # Slice ids come from a sampled range partitioner; materialize them once
    # so the detail rows and the slice totals agree.
    sliced = materialize(
        df.select("*", *[weights[k].alias(wcols[k]) for k in weights])
        .repartitionByRange(n, *groups, *order_by)
        .withColumn("_slice", F.spark_partition_id())
    )
    within = Window.partitionBy("_slice", *group_by).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    local = sliced.select("*", *[F.coalesce(F.sum(wcols[k]).over(within), F.lit(0)).alias(f"_l{wcols[k]}")
                                 for k in weights])
    # Totals come from the materialized slices, not from the window output.
    slice_totals = sliced.groupBy("_slice", *group_by).agg(
        *[F.sum(wcols[k]).alias(f"_t{wcols[k]}") for k in weights])
    # At most (#slices + #groups) rows: bounded, so a plain window and a
    # broadcast are safe here.
    earlier = Window.partitionBy(*group_by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group_by)
    offsets = slice_totals.select(
        "_slice", *group_by,
        *[F.coalesce(F.sum(f"_t{wcols[k]}").over(earlier), F.lit(0)).alias(f"_o{wcols[k]}") for k in weights],
        *[F.sum(f"_t{wcols[k]}").over(whole).alias(names[k][1]) for k in weights],
    )
    out = local.join(F.broadcast(offsets), ["_slice", *group_by])
    out = out.select("*", *[(F.col(f"_o{wcols[k]}") + F.col(f"_l{wcols[k]}")).alias(names[k][0]) for k in weights])
    drop = ["_slice"] + [c for k in weights for c in (wcols[k], f"_l{wcols[k]}", f"_o{wcols[k]}")]
    return out.drop(*drop)


def long_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Unpivot numeric columns to (column, v double); NaN counts as null."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    cols = [c for c in columns if is_numeric_type(fields[c])]
    if not cols:
        spark = df.sparkSession
        return spark.createDataFrame([], "column string, v double")
    return df.select(*[nan_to_null(c, fields[c]).cast("double").alias(c) for c in cols]).unpivot(
        [], list(map(quoted, cols)), "column", "v")


def value_weights(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, v, w``: distinct non-null values of numeric columns with
    their counts (a hot value becomes one weighted row)."""
    return (long_numeric(df, columns).where(F.col("v").isNotNull())
            .groupBy("column", "v").agg(F.count(F.lit(1)).alias("w")))


def rank_values(counts: DataFrame, num_slices: int | None = None) -> DataFrame:
    """Adds ``cum_before`` / ``group_total`` to ``column, v, w`` rows."""
    return cumulative_before(counts, [F.col("v")], ["column"], "w", num_slices)


def quantiles_from_ranked(ranked: DataFrame, probs: Sequence[float]) -> DataFrame:
    """Exact linear-interpolated quantiles ``column, p, value`` from ranked
    value counts (DuckDB ``quantile_cont`` / pandas ``quantile``)."""
    probs = [float(p) for p in probs]
    first = F.col("cum_before")
    last = F.col("cum_before") + F.col("w") - 1
    n1 = (F.col("group_total") - 1).cast("double")

    def covers(rank: Column) -> Column:
        return (first <= rank) & (rank <= last)

    # Keep only the (at most 2 x #probs) rows per column that hold a needed rank.
    needed = F.lit(False)
    for p in probs:
        needed = needed | covers(F.floor(F.lit(p) * n1)) | covers(F.ceil(F.lit(p) * n1))
    hits = ranked.where(needed).select(
        "column", "v", "cum_before", "w", "group_total",
        F.explode(F.array(*[F.lit(p) for p in probs])).alias("p"))
    pos = F.col("p") * (F.col("group_total") - 1).cast("double")
    hits = hits.select(
        "column", "p", "v", pos.alias("pos"),
        covers(F.floor(pos)).alias("has_lo"), covers(F.ceil(pos)).alias("has_hi"))
    out = hits.where(F.col("has_lo") | F.col("has_hi")).groupBy("column", "p").agg(
        F.min(F.when(F.col("has_lo"), F.col("v"))).alias("v_lo"),
        F.min(F.when(F.col("has_hi"), F.col("v"))).alias("v_hi"),
        F.first("pos").alias("pos"),
    )
    frac = F.col("pos") - F.floor(F.col("pos"))
    return out.select("column", "p", (F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * frac).alias("value"))


def slice_weights(counts: DataFrame, num_slices: int | None = None) -> DataFrame:
    """``column, v, w, _slice``: value counts range-partitioned on
    ``(column, v)`` into contiguous slices (slice ids rise with ``v`` within
    a column), materialized once so every reader sees the same slices."""
    n = _num_slices(counts, num_slices)
    return materialize(counts.repartitionByRange(n, "column", "v").withColumn("_slice", F.spark_partition_id()))


def quantiles_from_slices(sliced: DataFrame, probs: Sequence[float]) -> DataFrame:
    """Exact quantiles ``column, p, value`` from :func:`slice_weights`.

    Slice totals are plain sums over the slices (no window over values);
    their prefix sums tell which slices hold the ranks a quantile needs
    (at most two per probability and column). Only those slices are sorted
    for a running sum, so the ordered pass touches a few slices however
    large the table is."""
    probs = [float(p) for p in probs]
    totals = sliced.groupBy("_slice", "column").agg(F.sum("w").alias("_t"))
    # At most (#slices + #columns) rows: a plain window and a broadcast are safe.
    earlier = Window.partitionBy("column").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_slice", "column", "_t", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_o"),
        F.sum("_t").over(Window.partitionBy("column")).alias("group_total"))
    n1 = (F.col("group_total") - 1).cast("double")

    def holds(rank: Column) -> Column:
        return (F.col("_o") <= rank) & (rank <= F.col("_o") + F.col("_t") - 1)

    needed = F.lit(False)
    for p in probs:
        needed = needed | holds(F.floor(F.lit(p) * n1)) | holds(F.ceil(F.lit(p) * n1))
    keep = offsets.where(needed).select("_slice", "column", "_o", "group_total")
    part = sliced.join(F.broadcast(keep), ["_slice", "column"])
    within = Window.partitionBy("_slice", "column").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = part.select("column", "v", "w", "group_total",
                         (F.col("_o") + F.coalesce(F.sum("w").over(within), F.lit(0))).alias("cum_before"))
    return quantiles_from_ranked(ranked, probs)


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                    num_slices: int | None = None) -> DataFrame:
    """Exact quantiles per numeric column; columns without values give no rows."""
    return quantiles_from_slices(slice_weights(value_weights(df, columns), num_slices), probs)


def approx_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                     accuracy: int = 10000) -> DataFrame:
    """Opt-in fast path: ``percentile_approx`` per column in one scan with map-
    side sketches (rank error at most n / accuracy). Same output as
    :func:`exact_quantiles`; positions are not interpolated."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    cols = [c for c in columns if is_numeric_type(fields[c])]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, p double, value double")
    probs = [float(p) for p in probs]
    row = df.agg(F.array(*[
        F.struct(F.lit(c).alias("column"),
                 F.percentile_approx(nan_to_null(c, fields[c]).cast("double"), probs, accuracy).alias("q"))
        for c in cols]).alias("r"))
    per_col = row.select(F.explode("r").alias("r")).select("r.column", "r.q").where(F.col("q").isNotNull())
    return per_col.select("column", F.posexplode("q").alias("i", "value")).select(
        "column", F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("i") + 1).alias("p"), "value")
