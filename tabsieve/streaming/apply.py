"""Treatments fitted on a batch table, applied to batch or streaming data.

``apply_actions`` computes each statistic on the data it transforms. To
clean data that keeps arriving (Structured Streaming), the statistics are
fitted once on a reviewed batch table and then applied as plain expressions:
fill values and clamp bounds become literals, the category map becomes a
small static table joined to the stream (stream-static left join). Row-local
treatments need nothing fitted.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.functions.columns import norm, quoted
from tabsieve.operators import prepare
from tabsieve.operators.prepare import Action
from tabsieve.plans.lineage import materialize

ROW_LOCAL = ("drop_rows", "exclude_feature", "trim_whitespace", "normalize_nulls", "convert_numeric",
             "convert_date", "set_missing", "fill_constant", "drop_violations")


def _apply_step(df: DataFrame, step: tuple) -> DataFrame:
    kind = step[0]
    if kind == "local":
        return prepare.apply_action(df, step[1])
    if kind == "fill":
        _, column, value, target_type = step
        return prepare.fill_missing(df, column, value, target_type)
    if kind == "clamp":
        _, column, lo, hi = step
        c = quoted(column).cast("double")
        return prepare._replace(df, column, F.when(c.isNull() | F.isnan(c), c).otherwise(F.least(F.greatest(c, F.lit(lo)),
                                                                                    F.lit(hi))))
    if kind == "map":
        _, column, mapping = step
        # materialized when fitting; Spark broadcasts it only if it is small
        joined = df.join(mapping, norm(quoted(column)) == F.col("_key"), "left")
        fixed = F.coalesce(F.col("_canonical"), quoted(column))
        return joined.select(*[fixed.alias(c) if c == column else quoted(c) for c in df.columns])
    if kind == "dedupe":
        if df.isStreaming:
            raise ValueError("remove_duplicates on a stream needs a watermark; deduplicate in batch.")
        return df.dropDuplicates()
    raise ValueError(f"unknown step {kind!r}")


@dataclass
class FittedActions:
    steps: list[tuple] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for step in self.steps:
            out = _apply_step(out, step)
        return out


def fit_actions(batch: DataFrame, actions: Sequence[Action], order_by: str | None = None) -> FittedActions:
    """Fit each statistic on ``batch`` as transformed by the earlier steps,
    exactly as ``apply_actions`` would."""
    steps: list[tuple] = []
    cur = batch
    for a in actions:
        op = a.operation
        if op in ROW_LOCAL:
            step = ("local", a)
        elif op == "impute_missing":
            stat, target_type = prepare.impute_statistic(cur, a.column, a.strategy or "", order_by)
            step = ("fill", a.column, stat, target_type)
        elif op == "cap_outliers":
            bounds = prepare.iqr_bounds(cur, a.column)
            if bounds is None:
                continue
            step = ("clamp", a.column, bounds[0], bounds[1])
        elif op == "normalize_categories":
            mapping = materialize(prepare.category_map(cur, a.column, order_by))
            step = ("map", a.column, mapping)
        elif op == "remove_duplicates":
            step = ("dedupe",)
        else:
            raise ValueError(f"Unsupported data preparation operation: {op!r}")
        steps.append(step)
        cur = _apply_step(cur, step)
    return FittedActions(steps)
