"""The guarded parsers and the shared per-column scan agree with plain,
unguarded evaluation (brute force over a small fixture)."""

from pyspark.sql import functions as F

from tabsieve.functions.columns import (
    DATE_FORMATS,
    has_edge_whitespace,
    is_text_type,
    strip,
    stripped_or_null,
    textual_null,
    to_number,
    to_timestamp_any,
)
from tabsieve.operators import issues
from tabsieve.plans import columnwise

TRICKY = ["12", " 12 ", "+5", "-.5", "5.", "1e3", "inf", "-Infinity", "NaN", "nan", "1d", "2F", "0x10",
          "1_000", "1,000", "", "  ", "abc", "A", "N", "\x015", "5\x01", "2024-01-31", "31/01/2024",
          "01-Feb-2024", "2024/02/01", "February 3, 2024", "20240203", "2025", "12:30", "today", None]


def _unguarded_number(c):
    s = strip(F.col(c).cast("string"))
    v = s.try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | s.rlike(r"^[+-]?[0-9.].*[dDfF]$"), None).otherwise(v)


def _unguarded_date(c):
    s = F.col(c).cast("string")
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in DATE_FORMATS]).cast("timestamp_ntz")


def test_guards_do_not_change_results(spark):
    df = spark.createDataFrame([(v,) for v in TRICKY], "t string")
    rows = df.select("t", to_number("t").alias("a"), _unguarded_number("t").alias("b"),
                     to_timestamp_any("t").alias("c"), _unguarded_date("t").alias("d")).collect()
    for r in rows:
        assert r["a"] == r["b"], r
        assert r["c"] == r["d"], r
    got = {r["t"]: r["a"] for r in rows}
    assert got[" 12 "] == 12.0 and got["inf"] == float("inf") and got["1d"] is None and got["NaN"] is None


def _brute_force(df):
    out = {}
    fields = {f.name: f.dataType for f in df.schema.fields}
    for c in df.columns:
        text = is_text_type(fields[c])
        none = F.lit(None)
        out[c] = df.agg(
            F.count(F.when(F.col(c).isNull(), 1)).alias("missing"),
            F.count(F.when(F.coalesce(textual_null(c, fields[c]), F.lit(False)), 1)).alias("fake_nulls"),
            F.count(F.when(F.coalesce(has_edge_whitespace(c) if text else F.lit(False), F.lit(False)), 1))
            .alias("whitespace"),
            F.count(F.col(c)).alias("non_null"),
            F.count(to_number(c) if text else none).alias("numeric_like"),
            F.count(stripped_or_null(c) if text else none).alias("non_blank"),
            F.count(to_number(stripped_or_null(c)) if text else none).alias("numeric_non_blank"),
            F.count(to_timestamp_any(stripped_or_null(c)) if text else none).alias("date_like"),
        ).first().asDict()
    return out


def _scan(df):
    return {r["column"]: {k: r[k] for k in r.asDict() if k not in ("column", "position")}
            for r in issues.scan_metrics(df).collect()}


def test_scan_metrics_equal_brute_force(spark, monkeypatch):
    df = spark.createDataFrame(
        [(i, v, (v or "x").upper(), float(i) if i % 4 else None) for i, v in enumerate(TRICKY)],
        "k int, t string, u string, x double")
    expected = _brute_force(df)
    assert _scan(df) == expected
    # the long (exploded) form of the same scan
    monkeypatch.setattr(columnwise, "WIDE_AGG_LIMIT", 0)
    assert _scan(df) == expected


def test_scan_metrics_without_text_columns(spark):
    df = spark.createDataFrame([(1, None), (2, 2.0)], "k int, x double")
    got = _scan(df)
    assert got["x"]["missing"] == 1 and got["k"]["date_like"] == 0


def test_per_column_applies_in_wide_and_long_form(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a", 2.0), (None, " b", None), (3, None, 4.0)], "k int, t string, x double")
    metrics = {
        "nulls": columnwise.count_if(lambda c, dt: F.col(c).isNull()),
        "spaced": columnwise.count_if(lambda c, dt: F.col(c).startswith(" ")),
        "mean": columnwise.numeric(F.avg, lambda c, dt: F.col(c)),
    }

    def applies(c, dt):
        return ("nulls", "spaced") if is_text_type(dt) else ("nulls", "mean")

    def run():
        return {r["column"]: (r["nulls"], r["spaced"], r["mean"])
                for r in columnwise.per_column(df, df.columns, metrics, applies).collect()}

    expected = {"k": (1, 0, 2.0), "t": (1, 1, None), "x": (1, 0, 3.0)}
    assert run() == expected
    monkeypatch.setattr(columnwise, "WIDE_AGG_LIMIT", 0)
    assert run() == expected
