"""Dates in mixed renderings, read by shape.

A text is matched against a few shapes (year first, numeric with the year last,
compact ISO, month names), each with an optional time of day, AM/PM and zone.
The matched fields are put together as one ISO text and cast, so an impossible
date is null and nothing is tried twice.

``13/02/2024`` can only be read day first and ``02/13/2024`` only month first;
``03/02/2024`` can be read both ways. A general reader decides each such text
alone, month first, so one column may mix both orders. Here the column decides:
:func:`date_orders` counts the texts that leave no choice, in one pass over all
columns, and the majority order is used for the rest (month first on a tie). A
text that the elected order cannot read is read in the other one, so election
never loses a date. Detection only counts readable texts and needs no order.

Two-digit years: 69 to 99 are 19xx, 00 to 68 are 20xx. A text with a zone gives
the wall clock of the session's time zone. Month and day names are English.
"""

from __future__ import annotations

import calendar
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsieve.functions.columns import _col, is_text_type, stripped_or_null
from tabsieve.plans.columnwise import count_if, count_present, per_column

_MONTH = "(?i:" + "|".join(f"{m[:3]}(?:{m[3:]})?" if m != "September" else "Sept?(?:ember)?"
                           for m in list(calendar.month_name)[1:]) + ")"
_DAY = "(?:(?i:" + "|".join(f"{d[:3]}(?:{d[3:]})?" for d in calendar.day_name) + "),? )?"
_MONTHS = "".join(m[:3].lower() for m in list(calendar.month_name)[1:])
_TIME = (r"(?:,?[T ](\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?: ?([AaPp])[.]?[Mm][.]?)?"
         r" ?([Zz]|UTC|GMT|[+-]\d{2}:?\d{2}|[+-]\d{2})?)?")
_TIME_FIELDS = ("hour", "minute", "second", "fraction", "half", "zone")
_YEAR = r"(\d{4}|\d{2})"
_ORDINAL = "(?:(?i:st|nd|rd|th))?"


@dataclass(frozen=True)
class Shape:
    """A date shape: a pattern (the same text in Java and RE2) and what its
    groups are. ``first`` and ``other`` are the two numbers of a numeric date."""

    name: str
    pattern: str
    fields: tuple[str, ...]

    @property
    def whole(self) -> str:
        return f"^{self.pattern}$"


SHAPES: tuple[Shape, ...] = (
    Shape("year_first", r"(\d{4})([-/.])(\d{1,2})([-/.])(\d{1,2})" + _TIME,
          ("year", "mark", "month", "mark2", "day", *_TIME_FIELDS)),
    Shape("numeric", r"(\d{1,2})([-/.])(\d{1,2})([-/.])" + _YEAR + _TIME,
          ("first", "mark", "other", "mark2", "year", *_TIME_FIELDS)),
    Shape("compact", r"(\d{4})(\d{2})(\d{2})(?:T(\d{2})(\d{2})(?:(\d{2}))?([Zz])?)?",
          ("year", "month", "day", "hour", "minute", "second", "zone")),
    Shape("day_month_name", _DAY + r"(\d{1,2})" + _ORDINAL + "[ -]?(" + _MONTH + ")[.]?,?[ -]" + _YEAR + _TIME,
          ("day", "name", "year", *_TIME_FIELDS)),
    Shape("month_name_day", _DAY + "(" + _MONTH + r")[.]? (\d{1,2})" + _ORDINAL + r",? (\d{4})" + _TIME,
          ("name", "day", "year", *_TIME_FIELDS)),
)
_ANY = "^(?:" + "|".join(s.pattern for s in SHAPES) + ")$"


def _stamp(p: dict[str, Column], month: Column, day: Column) -> Column:
    """ISO text of the fields, cast; null where they are no date."""
    none = F.lit("")
    year, hour = p["year"], p.get("hour", none)
    year = F.when(F.length(year) == 4, year).otherwise(
        F.concat(F.when(year >= "69", F.lit("19")).otherwise(F.lit("20")), year))
    half = p.get("half", none)
    clock = hour.try_cast("int")
    by_half = F.when((clock >= 1) & (clock <= 12), (clock % 12 + F.when(F.lower(half) == "p", 12).otherwise(0)).cast("string"))
    hour = F.when(hour == "", F.lit("0")).when(half == "", hour).otherwise(by_half)

    def two(c: Column) -> Column:
        return F.lpad(F.when(c == "", F.lit("0")).otherwise(c), 2, "0")

    fraction = F.substring(F.rpad(p.get("fraction", none), 6, "0"), 1, 6)
    text = F.concat(year, F.lit("-"), two(month), F.lit("-"), two(day), F.lit(" "), two(hour), F.lit(":"),
                    two(p.get("minute", none)), F.lit(":"), two(p.get("second", none)), F.lit("."), fraction)
    stamp = text.try_cast("timestamp_ntz")
    zone = p.get("zone", none)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    minutes = (F.substring(digits, 1, 2).try_cast("int") * 60
               + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0)))
    minutes = F.when(digits == "", 0).otherwise(F.when(zone.startswith("-"), -minutes).otherwise(minutes))
    utc = F.timestamp_add("MINUTE", -minutes, stamp)
    return F.when(zone == "", stamp).otherwise(
        F.convert_timezone(F.lit("UTC"), F.current_timezone(), utc)).cast("timestamp_ntz")


def _read(s: Column, shape: Shape, build) -> Column:
    """``build`` of the shape's fields, matched once; null where the text has
    another shape."""
    groups = F.split(F.regexp_replace(s, shape.whole, "|".join(f"${i + 1}" for i in range(len(shape.fields)))), r"\|")
    # the one-element array binds the fields, so that they are cut once
    fields = F.transform(F.array(groups), lambda p: build({f: F.get(p, F.lit(i)) for i, f in enumerate(shape.fields)}))
    return F.when(s.rlike(shape.whole), F.get(fields, F.lit(0)))


def _same_marks(p: dict[str, Column], stamp: Column) -> Column:
    return F.when(p["mark"] == p["mark2"], stamp) if "mark" in p else stamp


def _fields_to_date(shape: Shape, day_first: Column | None):
    """Builder for one shape; ``day_first`` None: numeric dates in either
    order, month first where both are possible."""

    def build(p: dict[str, Column]) -> Column:
        if shape.name == "numeric":
            monthly, daily = _stamp(p, p["first"], p["other"]), _stamp(p, p["other"], p["first"])
            both = F.coalesce(monthly, daily)
            if day_first is not None:
                both = F.when(day_first, F.coalesce(daily, monthly)).otherwise(both)
            return _same_marks(p, both)
        if "name" in p:
            place = (F.position(F.lower(F.substring(p["name"], 1, 3)), F.lit(_MONTHS)) + 2) / 3
            return _stamp(p, place.cast("int").cast("string"), p["day"])
        return _same_marks(p, _stamp(p, p["month"], p["day"]))

    return build


def parse_date(c: str | Column, day_first: Column | bool | None = None) -> Column:
    """Mixed-format date text -> ``timestamp_ntz``, null where it is none."""
    s = _col(c).cast("string")
    order = F.lit(day_first) if isinstance(day_first, bool) else day_first
    cases = F.coalesce(*[_read(s, shape, _fields_to_date(shape, order)) for shape in SHAPES])
    # one alternation of all shapes rejects other texts with a single test
    return F.when(s.rlike(_ANY), cases)


def date_shape(c: str | Column) -> Column:
    """Name of the shape in which a text is a date; a numeric date is
    ``day_first`` or ``month_first`` where only that order is possible, else
    ``either_order``. Null where the text is no date."""
    s = _col(c).cast("string")

    def numeric(p: dict[str, Column]) -> Column:
        monthly, daily = _stamp(p, p["first"], p["other"]), _stamp(p, p["other"], p["first"])
        name = (F.when(monthly.isNotNull() & daily.isNotNull(), F.lit("either_order"))
                .when(daily.isNotNull(), F.lit("day_first")).when(monthly.isNotNull(), F.lit("month_first")))
        return _same_marks(p, name)

    def named(shape: Shape):
        if shape.name == "numeric":
            return numeric
        build = _fields_to_date(shape, None)
        return lambda p: F.when(build(p).isNotNull(), F.lit(shape.name))

    return F.when(s.rlike(_ANY), F.coalesce(*[_read(s, shape, named(shape)) for shape in SHAPES]))


SHAPE_NAMES: tuple[str, ...] = ("year_first", "day_first", "month_first", "either_order", "compact",
                                "day_month_name", "month_name_day")


def date_format_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per text column: ``column``, non-blank values, how many are dates
    in each shape, and the elected ``day_first``. One scan; each text is read
    once in a projection of its own and only its shape's name is counted."""
    text = [f.name for f in df.schema.fields if is_text_type(f.dataType) and (columns is None or f.name in columns)]
    shapes = {c: f"_shape_{i}" for i, c in enumerate(text)}
    rows = df.select(*[F.col(f"`{c}`") for c in text],
                     *[date_shape(stripped_or_null(F.col(f"`{c}`"))).alias(n) for c, n in shapes.items()])
    out = per_column(rows, text, {"value_count": count_present(lambda c, dt: stripped_or_null(F.col(f"`{c}`"))),
                                  **{n: count_if(lambda c, dt, n=n: F.col(shapes[c]) == n) for n in SHAPE_NAMES}})
    return out.select("column", "value_count", *SHAPE_NAMES, (F.col("day_first") > F.col("month_first")).alias("day_first_order"))


def date_orders(df: DataFrame, columns: Sequence[str]) -> dict[str, bool]:
    """Elected order of text columns: True where days come first."""
    rows = date_format_counts(df, columns).select("column", "day_first_order").collect()  # one row a column
    return {r["column"]: r["day_first_order"] for r in rows}
