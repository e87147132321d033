"""Canonical text of cells and rows: the same in every engine and run.

Every value is written with a letter for its kind, so that 1, '1' and true
differ: N null, B boolean, I integer, M decimal, F floating, S text (with its
bytes counted), X binary, D days, T and U microseconds (with and without a
zone), A array, R struct, P map (entries in the order of their text).

A floating number is its exact value as odd integer times a power of two
(``F3p-1`` is 1.5), which needs no agreement about how numbers are printed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsieve.functions.columns import bound, is_text_type, quoted

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
SCALE = 54  # an absolute value times 2 ** (SCALE - its exponent) is a whole number below 2 ** 57


def float_text(c: Column) -> Column:
    """``F`` text of a double."""
    two = F.lit(2.0)

    def whole(x: Column, shift: Column) -> Column:
        half = F.floor(shift / 2)
        return (F.abs(x) * F.pow(two, half) * F.pow(two, shift - half)).cast("long")  # two steps, so that no power overflows

    def text(x: Column, shift: Column, n: Column) -> Column:
        return bound(n.bitwiseAND(-n), lambda low: F.concat(
            F.when(x < 0, F.lit("F-")).otherwise(F.lit("F")), F.floor(n / low).cast("string"), F.lit("p"),
            (F.bit_count(low - 1) - shift).cast("string")))

    def finite(x: Column) -> Column:
        return bound(F.lit(SCALE) - F.floor(F.log2(F.abs(x))), lambda shift: bound(
            whole(x, shift), lambda n: text(x, shift, n)))

    def any_text(x: Column) -> Column:
        return (F.when(F.isnan(x), F.lit("Fnan")).when(x == 0, F.lit("F0"))
                .when(x == F.lit(float("inf")), F.lit("Finf")).when(x == F.lit(float("-inf")), F.lit("F-inf"))
                .otherwise(finite(x)))

    return bound(c.cast("double"), any_text)


def cell_text(c: Column, dt: T.DataType) -> Column:
    """Canonical text of a cell; never null."""
    if isinstance(dt, T.NullType):
        return F.lit("N")
    if isinstance(dt, T.BooleanType):
        text = F.when(c, F.lit("B1")).otherwise(F.lit("B0"))
    elif isinstance(dt, INTEGRAL):
        text = F.concat(F.lit("I"), c.cast("string"))
    elif isinstance(dt, T.DecimalType):
        text = F.concat(F.lit("M"), c.cast("string"))
    elif isinstance(dt, (T.FloatType, T.DoubleType)):
        text = float_text(c)
    elif is_text_type(dt):
        text = F.concat(F.lit("S"), F.octet_length(c).cast("string"), F.lit(":"), c.cast("string"))
    elif isinstance(dt, T.BinaryType):
        text = F.concat(F.lit("X"), F.hex(c))
    elif isinstance(dt, T.DateType):
        text = F.concat(F.lit("D"), F.unix_date(c).cast("string"))
    elif isinstance(dt, T.TimestampType):
        text = F.concat(F.lit("T"), F.unix_micros(c).cast("string"))
    elif isinstance(dt, T.TimestampNTZType):
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        text = F.concat(F.lit("U"), F.timestamp_diff("MICROSECOND", epoch, c).cast("string"))
    elif isinstance(dt, T.ArrayType):
        parts = F.transform(c, lambda x: cell_text(x, dt.elementType))
        text = F.concat(F.lit("A"), F.size(c).cast("string"), F.lit("["), F.array_join(parts, ","), F.lit("]"))
    elif isinstance(dt, T.StructType):
        parts = [cell_text(c.getField(f.name), f.dataType) for f in dt.fields]
        text = F.concat(F.lit("R("), F.concat_ws(",", *parts), F.lit(")"))
    elif isinstance(dt, T.MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.concat(
            cell_text(e["key"], dt.keyType), F.lit("="), cell_text(e["value"], dt.valueType)))
        text = F.concat(F.lit("P"), F.size(c).cast("string"), F.lit("{"), F.array_join(F.array_sort(entries), ","), F.lit("}"))
    else:  # intervals, variants: as Spark shows them
        text = F.concat(F.lit("O"), c.cast("string"))
    return F.when(c.isNull(), F.lit("N")).otherwise(text)


def has_map(dt: T.DataType) -> bool:
    if isinstance(dt, T.ArrayType):
        return has_map(dt.elementType)
    if isinstance(dt, T.StructType):
        return any(has_map(f.dataType) for f in dt.fields)
    return isinstance(dt, T.MapType)


def hashable(df: DataFrame) -> list[Column]:
    """The columns of a table for hashing: those with maps, which Spark does
    not hash, as canonical text."""
    return [F.when(quoted(f.name).isNotNull(), cell_text(quoted(f.name), f.dataType)) if has_map(f.dataType)
            else quoted(f.name) for f in df.schema.fields]


def with_row_halves(df: DataFrame, low: str, high: str) -> DataFrame:
    """Adds the two 64-bit halves of the MD5 of every row's canonical text, as
    decimals. The digest is a column of its own, so that both come from one."""
    own = list(map(quoted, df.columns))
    text = F.concat_ws(";", *[cell_text(quoted(f.name), f.dataType) for f in df.schema.fields])
    rows = df.select(*own, F.md5(text.cast("binary")).alias(f"{low}_md5"))
    return rows.select(*own, *[F.conv(F.substring(quoted(f"{low}_md5"), at, 16), 16, 10).cast("decimal(38,0)").alias(name)
                               for name, at in ((low, 1), (high, 17))])
