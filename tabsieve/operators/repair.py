"""Repairs of a dirty account table with invariants.

Each repair is a column expression; the only statistic (median of valid
ages) is one exact-median job returning a scalar. Invariants compare the cells
that source and result hold per key by hash sums in one aggregate, instead of
relying on row positions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsieve.functions.columns import quoted, strip, to_number, to_timestamp_any
from tabsieve.operators.quality import duplicate_row_count
from tabsieve.plans.lineage import materialize
from tabsieve.plans.ranking import quantiles_from_slices, slice_weights

# --- fixed values -----------------------------------------------------------
CURRENCY_SIGN = "£"
REPAIR_DATE_FORMATS: tuple[str, ...] = ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MMM-yyyy", "yyyy/MM/dd")
OUTPUT_DATE_FORMAT = "yyyy-MM-dd"
AGE_MIN, AGE_MAX = 18, 110
EXTREME_TOTAL = 20000
LEAKAGE_COLUMNS: tuple[str, ...] = ("account_closed_date", "retention_offer_accepted")
PROTECTED_COLUMNS: tuple[str, ...] = ("customer_id", "account_number", "churned")
CHANGED_COLUMNS: tuple[str, ...] = ("age", "monthly_charge", "signup_date", "total_charge")
# ---------------------------------------------------------------------------


class RepairError(ValueError):
    pass


def currency_to_number(c: str | Column) -> Column:
    """Strip, drop the currency sign, strict cast (ANSI cast raises on
    text that is not a number)."""
    col = quoted(c) if isinstance(c, str) else c
    return F.replace(strip(col.cast("string")), F.lit(CURRENCY_SIGN), F.lit("")).cast("double")


def parse_dates(c: str | Column, formats: Sequence[str] = REPAIR_DATE_FORMATS) -> Column:
    """R2: first format that matches wins; null when none does."""
    col = strip((quoted(c) if isinstance(c, str) else c).cast("string"))
    return to_timestamp_any(col, formats)


def normalized_date_text(c: str | Column) -> Column:
    """The parsed date as ``yyyy-MM-dd`` text."""
    return F.date_format(parse_dates(c), OUTPUT_DATE_FORMAT)


def invalid_age(c: str | Column) -> Column:
    v = to_number(c)
    return v.isNull() | (v < AGE_MIN) | (v > AGE_MAX)


@dataclass
class RepairResult:
    table: DataFrame
    age_median: float


def _age_weights(df: DataFrame, column: str, *more: Column) -> DataFrame:
    """``column, v, w`` per distinct valid age (null: all the others), and
    ``more`` aggregates, in one pass."""
    age = F.when(~invalid_age(column), to_number(column)).alias("v")
    return df.groupBy(age).agg(F.count(F.lit(1)).alias("w"), *more).withColumn("column", F.lit(column))


def _median_of(weights: DataFrame) -> float:
    valid = weights.where(F.col("v").isNotNull()).select("column", "v", "w")
    row = quantiles_from_slices(slice_weights(valid), [0.5]).first()
    if row is None:
        raise RepairError("No valid ages available for median repair")
    return float(row["value"])


def valid_age_median(df: DataFrame, column: str = "age") -> float:
    """R4 statistic: exact median of the valid ages (one scalar)."""
    return _median_of(_age_weights(df, column))


def repair_accounts(df: DataFrame) -> RepairResult:
    """R1 to R6 in one projection, after one pass for the statistics (ages
    and the number of dates that do not parse)."""
    unparsed = F.count(F.when(parse_dates("signup_date").isNull(), F.lit(1))).alias("unparsed")
    ages = materialize(_age_weights(df, "age", unparsed))
    if ages.agg(F.sum("unparsed")).first()[0]:
        raise RepairError("Some signup dates could not be parsed")
    median = _median_of(ages)
    monthly = currency_to_number("monthly_charge")
    age = F.when(invalid_age("age"), F.lit(median)).otherwise(to_number("age"))
    total = F.when(extreme_total("total_charge"), monthly * F.col("tenure_months")).otherwise(
        F.col("total_charge"))
    replaced = {"monthly_charge": monthly, "signup_date": normalized_date_text("signup_date"),
                "age": age, "total_charge": total}
    keep = [c for c in df.columns if c not in LEAKAGE_COLUMNS]
    return RepairResult(df.select(*[replaced.get(c, quoted(c)).alias(c) for c in keep]), median)


def extreme_total(c: str) -> Column:
    """Above the limit; NaN is missing, not extreme."""
    return (quoted(c) > EXTREME_TOTAL) & ~F.isnan(quoted(c).cast("double"))


def repair_report(df: DataFrame) -> DataFrame:
    """Counts of repaired values per rule and the replacement median."""
    median = valid_age_median(df)
    return df.agg(
        F.count(F.when(invalid_age("age"), F.lit(1))).alias("invalid_ages_repaired"),
        F.lit(median).alias("age_median"),
        F.count(F.when(extreme_total("total_charge"), F.lit(1))).alias("extreme_charges_repaired"),
        F.lit(len([c for c in LEAKAGE_COLUMNS if c in df.columns])).alias("leakage_columns_removed"),
    )


def repair_invariants(source: DataFrame, result: DataFrame, key: str = "customer_id") -> DataFrame:
    """One row per invariant with its number of violations."""
    spark = source.sparkSession
    expected = [c for c in source.columns if c not in LEAKAGE_COLUMNS]
    unchanged = [c for c in expected if c not in CHANGED_COLUMNS and c != key]
    # Per key, both sides' cells as signed hash sums: zero where both hold the
    # same cells as often. An aggregate, so hot or repeated keys combine
    # before the shuffle and never pair up; null keys are one key.

    def signed(frame: DataFrame, sign: int) -> DataFrame:
        cells = [(F.xxhash64(quoted(c), quoted(c).isNull()).cast("decimal(38,0)") * sign).alias(f"_h{i}")
                 for i, c in enumerate(unchanged)]
        return frame.select(F.col(key).alias("_key"), F.lit(sign).alias("_side"), *cells)

    sums = signed(source, 1).unionByName(signed(result, -1)).groupBy("_key").agg(
        F.sum("_side").alias("_rows"), *[F.sum(f"_h{i}").alias(f"_h{i}") for i in range(len(unchanged))])
    checks = [F.coalesce(F.sum(F.abs("_rows")), F.lit(0)).alias("row_pairing")]
    for i, c in enumerate(unchanged):
        kind = "protected_column_changed" if c in PROTECTED_COLUMNS else "unchanged_column_changed"
        checks.append(F.count(F.when(F.col(f"_h{i}") != 0, F.lit(1))).alias(f"{kind}:{c}"))
    joined = sums.agg(*checks)
    ranges = result.agg(
        F.count(F.when(invalid_age("age"), F.lit(1))).alias("invalid_ages_remain"),
        F.count(F.when(F.col("monthly_charge").try_cast("double").isNull(), F.lit(1))).alias("unparseable_charges_remain"),
        F.count(F.when(F.try_to_timestamp(F.col("signup_date"), F.lit(OUTPUT_DATE_FORMAT)).isNull(), F.lit(1)))
        .alias("invalid_signup_dates_remain"),
        F.count(F.when(extreme_total("total_charge"), F.lit(1))).alias("extreme_totals_remain"),
    )
    counts = source.agg(F.count(F.lit(1)).alias("n")).select(F.lit("s").alias("side"), "n").unionByName(
        result.agg(F.count(F.lit(1)).alias("n")).select(F.lit("r").alias("side"), "n"))
    rowdiff = counts.agg(F.abs(F.sum(F.when(F.col("side") == "s", F.col("n")).otherwise(-F.col("n"))))
                         .alias("row_count_changed"))
    dups = duplicate_row_count(source).select(F.lit("s").alias("side"), F.col("duplicate_rows").alias("n")) \
        .unionByName(duplicate_row_count(result).select(F.lit("r").alias("side"), F.col("duplicate_rows").alias("n")))
    dupdiff = dups.agg(F.abs(F.sum(F.when(F.col("side") == "s", F.col("n")).otherwise(-F.col("n"))))
                       .alias("duplicate_count_changed"))
    column_list = spark.createDataFrame([(0 if result.columns == expected else 1,)], "unexpected_columns long")

    def long(frame: DataFrame) -> DataFrame:
        names = frame.columns
        return frame.select(F.explode(F.array(*[
            F.struct(F.lit(n).alias("invariant"), F.col(f"`{n}`").cast("long").alias("violations"))
            for n in names])).alias("x")).select("x.*")

    out = long(rowdiff)
    for part in (column_list, joined, dupdiff, ranges):
        out = out.unionByName(long(part))
    return out


def validate_repair(source: DataFrame, result: DataFrame, key: str = "customer_id") -> None:
    failed = repair_invariants(source, result, key).where(F.col("violations") > 0).collect()
    if failed:
        raise RepairError("Repair invariants failed: " + ", ".join(f"{r['invariant']}={r['violations']}" for r in failed))
