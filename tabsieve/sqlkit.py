"""Helpers that write the DuckDB oracle SQL for the registered queries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from tabsieve.functions.columns import NULL_MARKERS
from tabsieve.functions.dates import SHAPES, Shape
from tabsieve.sources.derived import DATE_TEXTS_SQL, DIRTY_CUSTOMER_SQL, ORDERS_TEXT_DATES_SQL

MARKERS_SQL = "(" + ", ".join("'" + m + "'" for m in NULL_MARKERS) + ")"

DIRTY_CTE = "dirty_customer as (" + DIRTY_CUSTOMER_SQL.format(customer="customer") + ")"
DATE_TEXTS_CTE = "date_texts as (" + DATE_TEXTS_SQL.format(orders="orders") + ")"
ORDERS_DATES_CTE = "orders_dates as (" + ORDERS_TEXT_DATES_SQL.format(orders="orders") + ")"

# dirty_customer columns and types (fixed by the view above)
DIRTY_COLUMNS = ("c_custkey", "segment", "acctbal", "nation_txt", "target")
DIRTY_TEXT = ("segment", "nation_txt")
DIRTY_NUMERIC = ("c_custkey", "acctbal", "target")
DIRTY_FLOAT = ("acctbal",)


def q(name: str) -> str:
    return '"' + name + '"'


def per_column(table: str, columns: Sequence[str], exprs: dict[str, Callable[[str], str]]) -> str:
    parts = []
    for c in columns:
        cols = ", ".join(f"{fn(c)} as {q(m)}" for m, fn in exprs.items())
        parts.append(f"select '{c}' as \"column\", {cols} from {table}")
    return "\n union all ".join(parts)


def missing_sql(c: str, text: bool, floating: bool) -> str:
    cond = f"{c} is null"
    if floating:
        cond += f" or isnan({c})"
    if text:
        cond += f" or lower(trim({c})) in {MARKERS_SQL}"
    return cond


def to_number_sql(c: str) -> str:
    s = f"trim({c})"
    return (f"case when try_cast({s} as double) is null or isnan(try_cast({s} as double)) "
            f"or regexp_matches({s}, '^[+-]?[0-9.].*[dDfF]$') then null else try_cast({s} as double) end")


def _stamp_sql(shape: Shape, month: str, day: str) -> str:
    has = set(shape.fields)

    def field(name: str) -> str:
        return f"p.{name}" if name in has else "''"

    def two(x: str) -> str:
        return f"lpad(case when {x} = '' then '0' else {x} end, 2, '0')"

    year = "case when length(p.year) = 4 then p.year when p.year >= '69' then '19' || p.year else '20' || p.year end"
    clock = f"try_cast({field('hour')} as int)"
    hour = (f"case when {field('hour')} = '' then '0' when {field('half')} = '' then {field('hour')} "
            f"when {clock} between 1 and 12 then "
            f"cast({clock} % 12 + case when lower({field('half')}) = 'p' then 12 else 0 end as varchar) end")
    stamp = (f"try_cast({year} || '-' || {two(month)} || '-' || {two(day)} || ' ' || {two(f'({hour})')} || ':' || "
             f"{two(field('minute'))} || ':' || {two(field('second'))} || '.' || "
             f"substr(rpad({field('fraction')}, 6, '0'), 1, 6) as timestamp)").replace(f"cast({year}", f"cast(({year})")
    if "zone" not in has:
        return stamp
    digits = "regexp_replace(p.zone, '[^0-9]', '', 'g')"
    minutes = (f"case when {digits} = '' then 0 else (case when p.zone[1] = '-' then -1 else 1 end) * "
               f"(try_cast(substr({digits}, 1, 2) as int) * 60 + coalesce(try_cast(substr({digits}, 3, 2) as int), 0)) end")
    return f"({stamp} - to_minutes({minutes}))"


def _read_sql(c: str, shape: Shape, expr: str) -> str:
    names = ", ".join(f"'{f}'" for f in shape.fields)
    return f"list_transform([regexp_extract({c}, '{shape.whole}', [{names}])], lambda p: {expr})[1]"


def _by_shape_sql(c: str, build: Callable[[Shape], str]) -> str:
    parts = []
    for shape in SHAPES:
        expr = build(shape)
        if "mark" in shape.fields:
            expr = f"case when p.mark = p.mark2 then {expr} end"
        parts.append(f"when regexp_matches({c}, '{shape.whole}') then {_read_sql(c, shape, expr)}")
    return "case " + " ".join(parts) + " end"


def _month_number_sql() -> str:
    return "cast((instr('janfebmaraprmayjunjulaugsepoctnovdec', lower(substr(p.name, 1, 3))) + 2) // 3 as varchar)"


def to_timestamp_sql(c: str, day_first: str | None = None) -> str:
    """Twin of ``functions.dates.parse_date``."""

    def build(shape: Shape) -> str:
        if shape.name == "numeric":
            monthly, daily = _stamp_sql(shape, "p.first", "p.other"), _stamp_sql(shape, "p.other", "p.first")
            both = f"coalesce({monthly}, {daily})"
            return both if day_first is None else f"case when {day_first} then coalesce({daily}, {monthly}) else {both} end"
        return _stamp_sql(shape, _month_number_sql() if "name" in shape.fields else "p.month", "p.day")

    return _by_shape_sql(c, build)


def date_shape_sql(c: str) -> str:
    """Twin of ``functions.dates.date_shape``."""

    def build(shape: Shape) -> str:
        if shape.name == "numeric":
            monthly, daily = _stamp_sql(shape, "p.first", "p.other"), _stamp_sql(shape, "p.other", "p.first")
            return (f"case when {monthly} is not null and {daily} is not null then 'either_order' "
                    f"when {daily} is not null then 'day_first' when {monthly} is not null then 'month_first' end")
        stamp = _stamp_sql(shape, _month_number_sql() if "name" in shape.fields else "p.month", "p.day")
        return f"case when {stamp} is not null then '{shape.name}' end"

    return _by_shape_sql(c, build)


def day_first_sql(c: str, table: str) -> str:
    """The order a column elects, as a scalar subquery."""
    return (f"(select count(*) filter (where k = 'day_first') > count(*) filter (where k = 'month_first') "
            f"from (select {date_shape_sql(f'trim({c})')} as k from {table}))")


def unpivot_text(table: str, columns: Sequence[str], value_expr: Callable[[str], str] = lambda c: c) -> str:
    return "\n union all ".join(
        f"select '{c}' as \"column\", cast({value_expr(c)} as varchar) as value from {table}" for c in columns)


def unpivot_double(table: str, columns: Sequence[str]) -> str:
    return "\n union all ".join(
        f"select '{c}' as \"column\", cast({c} as double) as v from {table}" for c in columns)


def float_text_sql(c: str) -> str:
    """Twin of ``functions.canonical.float_text``."""
    return f"""list_transform([cast({c} as double)], lambda x: case when isnan(x) then 'Fnan' when x = 0 then 'F0'
 when isinf(x) then case when x > 0 then 'Finf' else 'F-inf' end
 else list_transform([54 - cast(floor(log2(abs(x))) as bigint)], lambda k: list_transform([
  cast(abs(x) * pow(2.0, k // 2) * pow(2.0, k - k // 2) as bigint)], lambda m: case when x < 0 then 'F-' else 'F' end
  || cast(m // (m & -m) as varchar) || 'p' || cast(bit_count((m & -m) - 1) - k as varchar))[1])[1] end)[1]"""


def cell_text_sql(c: str, kind: str) -> str:
    """Twin of ``functions.canonical.cell_text`` for the kinds of the test tables."""
    text = {"int": f"'I' || cast({c} as varchar)", "text": f"'S' || strlen({c}) || ':' || {c}",
            "float": float_text_sql(c), "ts": f"'U' || epoch_us({c})", "instant": f"'T' || epoch_us({c})"}[kind]
    return f"case when {c} is null then 'N' else {text} end"


def fingerprint_sql(table: str, kinds: dict[str, str], schema: str) -> str:
    """Twin of ``sources.tables.content_fingerprint``."""
    row = " || ';' || ".join(cell_text_sql(c, k) for c, k in kinds.items())
    digits = "list_reduce(list_transform(string_split({}, ''), lambda d: cast(instr('0123456789abcdef', d) - 1 as hugeint)), lambda a, d: a * 16 + d)"
    low, high = (digits.format(f"substr(h, {at}, 16)") for at in (1, 17))
    return f"""select count(*) as row_count, sha256('{schema}|' || count(*) || '|'
 || coalesce(sum({low}) % 18446744073709551616, 0) || '|' || coalesce(sum({high}) % 18446744073709551616, 0)) as fingerprint
from (select md5({row}) as h from {table})"""
