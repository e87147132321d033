"""The shared ``(column, value, n)`` frame.

The reference loops over columns and re-scans the table for each check. Here
the table is unpivoted once into ``(column, value)`` pairs and counted with a
hash aggregate (map-side partial counts, then one shuffle on the pair), so a
value repeated a billion times costs one row after the partial step. Pairs
are keyed by column index with typed values, so the shuffle carries no
column names and no per-row number rendering. Distinct
counts, duplicates, spelling variants, constants and top values all derive
from this one frame.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsieve.functions.columns import (
    MAX_MARKER_LENGTH,
    NULL_MARKERS,
    is_numeric_type,
    is_text_type,
    nan_to_null,
    quoted,
    strip,
)
from tabsieve.plans.lineage import materialize

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column string, value string, num double, n bigint`` including a null
    group per column.

    Records are keyed by column index and keep integers and doubles typed
    (``value`` is rendered as text only after aggregation, once per distinct
    value, and equals ``cast(value as string)``); ``num`` is the numeric value
    of integer and double columns. NaN counts as null.
    """
    cols = list(columns) if columns is not None else list(df.columns)
    fields = {f.name: f.dataType for f in df.schema.fields}
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, value string, num double, n bigint")
    no_s, no_i, no_d = F.lit(None).cast("string"), F.lit(None).cast("long"), F.lit(None).cast("double")

    def typed(c: str) -> tuple[Column, Column, Column]:
        dt = fields[c]
        if isinstance(dt, INTEGRAL):
            return no_s, quoted(c).cast("long"), no_d
        if isinstance(dt, (T.DoubleType, T.FloatType)):
            return no_s, no_i, nan_to_null(c, dt).cast("double")
        return nan_to_null(c, dt).cast("string"), no_i, no_d

    records = F.explode(F.array(*[
        F.struct(F.lit(i).alias("_ci"), *[x.alias(a) for x, a in zip(typed(c), ("_s", "_i", "_d"))])
        for i, c in enumerate(cols)])).alias("r")
    counted = df.select(records).select("r.*").groupBy("_ci", "_s", "_i", "_d").agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*[F.lit(c) for c in cols])
    return counted.select(
        F.element_at(names, F.col("_ci") + 1).alias("column"),
        F.coalesce(F.col("_s"), F.col("_i").cast("string"), F.col("_d").cast("string")).alias("value"),
        F.coalesce(F.col("_i").cast("double"), F.col("_d")).alias("num"),
        "n")


def column_cardinality(vc: DataFrame) -> DataFrame:
    """Per column: non-null rows, distinct non-null values, top frequency,
    null rows. One small aggregation over the value-count frame."""
    present = F.col("value").isNotNull()
    return vc.groupBy("column").agg(
        F.coalesce(F.sum(F.when(present, F.col("n"))), F.lit(0)).alias("non_null_count"),
        F.count(F.when(present, F.lit(1))).alias("distinct_count"),
        F.coalesce(F.max(F.when(present, F.col("n"))), F.lit(0)).alias("top_count"),
        F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("null_count"),
    )


KEY = "struct<a: bigint, b: bigint>"
BLANK, EDGE, MARKER = 1, 2, 4  # bits of ``traits``


def text_key(value: Column) -> Column:
    """128 bits that stand for a value in a shuffle: two differently seeded
    64-bit hashes. Null stays null."""
    return F.when(value.isNotNull(), F.struct(F.xxhash64(value).alias("a"), F.xxhash64(F.lit(1), value).alias("b")))


def row_key(columns: Sequence[Column]) -> Column:
    """128 bits that stand for a whole row. Hashing skips nulls, so where
    they are is hashed too."""
    cells = [*columns, *[c.isNull() for c in columns]] or [F.lit(0)]
    return F.struct(F.xxhash64(*cells).alias("a"), F.xxhash64(F.lit(1), *cells).alias("b"))


def value_keys(df: DataFrame, columns: Sequence[str] | None = None,
               fold: Callable[[Column], Column] = F.lower) -> DataFrame:
    """:func:`value_counts` for checks that need no value back: ``column,
    value, num, form, traits, n`` where ``value`` and ``form`` (strip + ``fold``)
    are keys of fixed width, so no text is shuffled or stored however long it
    is. ``num`` is set for every numeric type; ``form`` and ``traits`` (blank,
    edge white space, null marker) for text columns."""
    cols = list(columns) if columns is not None else list(df.columns)
    fields = {f.name: f.dataType for f in df.schema.fields}
    if not cols:
        return df.sparkSession.createDataFrame(
            [], f"column string, value {KEY}, num double, form {KEY}, traits int, n bigint")

    names = F.array(*[F.lit(c) for c in cols])
    at = {c: i for i, c in enumerate(cols)}
    plain = [c for c in cols if isinstance(fields[c], (*INTEGRAL, T.DoubleType, T.FloatType))]
    others = [c for c in cols if c not in plain]
    parts = ([_number_keys(df, plain, fields, at)] if plain else []) + ([_text_keys(df, others, fields, at, fold)] if others else [])
    counted = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return counted.select(F.element_at(names, F.col("_ci") + 1).alias("column"), "value", "num", "form", "traits", "n")


def _counted(df: DataFrame, records: list[Column]) -> DataFrame:
    """Equal records of all columns with their number; flat cells, which Spark
    groups faster than structs."""
    flat = df.select(F.explode(F.array(*records)).alias("r")).select("r.*")
    return flat.groupBy(*flat.columns).agg(F.count(F.lit(1)).alias("n"))


def _number_keys(df: DataFrame, cols: Sequence[str], fields: dict, at: dict[str, int]) -> DataFrame:
    """Integers and doubles stand for themselves: three cells a value."""
    none = {True: F.lit(None).cast("double"), False: F.lit(None).cast("long")}
    records = []
    for c in cols:
        whole, value = isinstance(fields[c], INTEGRAL), nan_to_null(c, fields[c])
        records.append(F.struct(F.lit(at[c]).alias("_ci"), (value.cast("long") if whole else none[False]).alias("_a"),
                                (none[True] if whole else value.cast("double")).alias("_d")))
    key = F.struct(F.coalesce("_a", F.xxhash64("_d")).alias("a"), F.lit(0).cast("long").alias("b"))
    return _counted(df, records).select(
        "_ci", F.when(F.col("_a").isNotNull() | F.col("_d").isNotNull(), key).alias("value"),
        F.coalesce(F.col("_a").cast("double"), F.col("_d")).alias("num"), F.lit(None).cast(KEY).alias("form"),
        F.lit(0).alias("traits"), "n")


def _text_keys(df: DataFrame, cols: Sequence[str], fields: dict, at: dict[str, int],
               fold: Callable[[Column], Column]) -> DataFrame:
    """All other types by the hashes of their text."""
    # Each text is stripped and folded once, in projections of their own (used
    # several times below, so Catalyst does not inline them).
    text = {c: i for i, c in enumerate(cols) if is_text_type(fields[c])}
    rows = df.select(*map(quoted, cols), *[strip(c).alias(f"_strip_{i}") for c, i in text.items()])
    rows = rows.select("*", *[fold(F.col(f"_strip_{i}")).alias(f"_form_{i}") for i in text.values()])
    no_long, no_double = F.lit(None).cast("long"), F.lit(None).cast("double")

    def hashes(shown: Column) -> tuple[Column, Column]:
        return tuple(F.when(shown.isNotNull(), h) for h in (F.xxhash64(shown), F.xxhash64(F.lit(1), shown)))

    records = []
    for c in cols:
        value = nan_to_null(c, fields[c])
        a, b = hashes(value.cast("string"))
        num = value.cast("double") if is_numeric_type(fields[c]) else no_double
        fa, fb, traits = no_long, no_long, F.lit(0)
        if c in text:
            stripped, folded = F.col(f"_strip_{text[c]}"), F.col(f"_form_{text[c]}")
            fa, fb = hashes(folded)
            marker = (F.length(stripped) <= MAX_MARKER_LENGTH) & folded.isin(*NULL_MARKERS)
            traits = (F.when(F.octet_length(stripped) == 0, BLANK).otherwise(0)
                      + F.when(F.octet_length(stripped) != F.octet_length(value), EDGE).otherwise(0)
                      + F.when(marker, MARKER).otherwise(0))
        cells = (F.lit(at[c]), a, b, num, fa, fb, traits)
        records.append(F.struct(*[x.alias(n) for x, n in zip(cells, ("_ci", "_a", "_b", "num", "_fa", "_fb", "traits"),
                                                             strict=True)]))
    form = F.struct(F.col("_fa").alias("a"), F.col("_fb").alias("b"))
    value = F.struct(F.col("_a").alias("a"), F.coalesce("_b", F.lit(0)).cast("long").alias("b"))
    return _counted(rows, records).select(
        "_ci", F.when(F.col("_a").isNotNull(), value).alias("value"), "num",
        F.when(F.col("_fa").isNotNull(), form).alias("form"), "traits", "n")


def has_trait(trait: int) -> Column:
    return F.col("traits").bitwiseAND(F.lit(trait)) != 0


def spelling_groups(keys: DataFrame, skip_markers: bool = True) -> DataFrame:
    """``column, form, n_variants, rows``: forms with more than one spelling."""
    present = keys.where(F.col("form").isNotNull())
    if skip_markers:
        present = present.where(~has_trait(MARKER))
    return present.groupBy("column", "form").agg(F.count(F.lit(1)).alias("n_variants"), F.sum("n").alias("rows")) \
        .where(F.col("n_variants") > 1)


BROADCAST_KEYS = 500_000  # rows of fixed width, about 50 bytes each


def values_of_keys(df: DataFrame, columns: Sequence[str], keys: DataFrame,
                   shown: Callable[[Column], Column] = lambda v: v) -> DataFrame:
    """``column, value, n`` of the values (``shown`` as text) whose
    ``(column, key)`` is in ``keys``: other texts are never shuffled. The keys
    are broadcast after a count of their rows, else left to AQE."""
    keys = materialize(keys.select("column", "key"))
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    cells = df.select(F.explode(F.array(*[F.struct(
        F.lit(c).alias("column"), shown(_as_text(df, c)).alias("value")) for c in columns])).alias("r")).select("r.*")
    cells = cells.where(F.col("value").isNotNull()).withColumn("key", text_key(F.col("value")))
    return cells.join(keys, ["column", "key"], "left_semi").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def _as_text(df: DataFrame, c: str) -> Column:
    return nan_to_null(c, df.schema[c].dataType).cast("string")


def text_keys(df: DataFrame, columns: Sequence[str], shown: Callable[[Column], Column] = lambda v: v) -> DataFrame:
    """``column, key, n``: distinct values as text, by 128-bit key; null is a
    value of its own with a null key."""
    records = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), text_key(shown(_as_text(df, c))).alias("key"))
                                  for c in columns])).alias("r")
    return df.select(records).select("r.*").groupBy("column", "key").agg(F.count(F.lit(1)).alias("n"))
