"""Mixed-format dates against values written by hand."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tabsieve.functions.dates import SHAPE_NAMES, date_format_counts, date_orders, date_shape, parse_date
from tabsieve.operators import prepare, quality

# text, month first, days first, shape
READINGS = [
    ("2024-01-05T10:00:00.123Z", "2024-01-05 10:00:00.123", None, "year_first"),
    ("05/01/24", "2024-05-01 00:00:00", "2024-01-05 00:00:00", "either_order"),
    ("Jan 5 2024", "2024-01-05 00:00:00", None, "month_name_day"),
    ("5 January 2024", "2024-01-05 00:00:00", None, "day_month_name"),
    ("2024-01-05T10:00", "2024-01-05 10:00:00", None, "year_first"),
    ("20240105T101500", "2024-01-05 10:15:00", None, "compact"),
    ("1/5/2024 10:00", "2024-01-05 10:00:00", "2024-05-01 10:00:00", "either_order"),
    ("1/5/2024 3:04 PM", "2024-01-05 15:04:00", "2024-05-01 15:04:00", "either_order"),
    ("13/02/2024", "2024-02-13 00:00:00", None, "day_first"),
    ("02/13/2024", "2024-02-13 00:00:00", None, "month_first"),
    ("2024-01-05 10:00:00+05:30", "2024-01-05 04:30:00", None, "year_first"),
    ("Fri, 5 Jan 2024 10:00:00 GMT", "2024-01-05 10:00:00", None, "day_month_name"),
    ("12/31/99", "1999-12-31 00:00:00", None, "month_first"),
    ("2024-01-05 12:30 am", "2024-01-05 00:30:00", None, "year_first"),
    ("sept 3rd, 2024", "2024-09-03 00:00:00", None, "month_name_day"),
]
NO_DATES = ["31/02/2024", "2024-02-30", "20241301", "1.2/2024", "2024-01-05 24:00", "2024-01-05 13:00 PM", "soon", "",
            "1234567890", "2024", "12:30", "a 2024-01-05", None]


@pytest.fixture()
def utc(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    yield spark
    spark.conf.set("spark.sql.session.timeZone", before)


def test_every_rendering_is_read(utc):
    df = utc.createDataFrame([(t,) for t, *_ in READINGS], "t string")
    rows = {r["t"]: r for r in df.select("t", parse_date("t").alias("m"), parse_date("t", True).alias("d"),
                                         date_shape("t").alias("s")).collect()}
    for text, monthly, daily, shape in READINGS:
        row = rows[text]
        assert (row["m"], row["d"]) == (datetime.fromisoformat(monthly), datetime.fromisoformat(daily or monthly)), text
        assert row["s"] == shape


def test_other_texts_are_no_dates(spark):
    df = spark.createDataFrame([(t,) for t in NO_DATES], "t string")
    assert df.where(parse_date("t").isNotNull() | parse_date("t", True).isNotNull() | date_shape("t").isNotNull()).count() == 0


def test_zone_gives_the_session_wall_clock(utc):
    utc.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    df = utc.createDataFrame([("2024-01-05T10:00:00Z",), ("2024-01-05 10:00",)], "t string")
    out = [r["x"].hour for r in df.select(parse_date("t").alias("x")).collect()]
    assert out == [19, 10]


def test_the_column_elects_its_order(spark):
    rows = [("03/02/2024", "03/02/2024", "03/02/2024", "x")] * 5 + [("13/02/2024", "02/13/2024", "01/01/2024", None)]
    df = spark.createDataFrame(rows, "days string, months string, open string, `odd.name` string")
    assert date_orders(df, df.columns) == {"days": True, "months": False, "open": False, "odd.name": False}
    out = prepare.convert_date(prepare.convert_date(df, "days"), "months").first()
    assert (out["days"].month, out["months"].month) == (2, 3)
    assert prepare.convert_date(df, "open", day_first=True).first()["open"].month == 2
    counts = {r["column"]: r for r in date_format_counts(df).collect()}
    assert counts["days"]["either_order"] == 5 and counts["days"]["day_first"] == 1
    assert sum(counts["odd.name"][n] for n in SHAPE_NAMES) == 0 and counts["odd.name"]["value_count"] == 5


def test_mixed_renderings_make_a_date_column(spark):
    df = spark.createDataFrame([(t, f"{i}") for i, (t, *_) in enumerate(READINGS)], "t string, n string")
    assert [r["column"] for r in quality.date_candidate_columns(df).collect()] == ["t"]


def test_one_projection_reads_each_text_once(spark):
    df = spark.createDataFrame([("2024-01-05",)], "t string").select(F.concat("t", F.lit("")).alias("t"))
    plan = date_format_counts(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2 and "Python" not in plan
