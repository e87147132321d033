"""Inputs derived from the test tables by deterministic SQL.

The test tables are clean, so checks and treatments are exercised on
"dirty" views computed from them. Each view is one SQL text that Spark and
DuckDB both run unchanged (``{customer}`` etc. are table references), so the
oracle sees the same input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DIRTY_CUSTOMER_SQL = """
select c_custkey,
 case when c_custkey % 17 = 0 then null when c_custkey % 13 = 0 then ' N/A '
      when c_custkey % 11 = 0 then '' when c_custkey % 7 = 0 then lower(c_mktsegment)
      when c_custkey % 5 = 0 then '  ' || c_mktsegment || ' ' else c_mktsegment end as segment,
 case when c_custkey % 19 = 0 then null when c_custkey % 23 = 0 then c_acctbal * 50
      else c_acctbal end as acctbal,
 case when c_custkey % 29 = 0 then 'unknown' when c_custkey % 31 = 0 then null
      else cast(c_nationkey as varchar(20)) end as nation_txt,
 case when c_acctbal > 5000 then 1 else 0 end as target
from {customer}
"""

# orders with the order date rendered as text in four formats, plus a few
# non-dates, for date sniffing (A15/A16) and multi-format parsing (R2).
ORDERS_TEXT_DATES_SQL = """
select o_orderkey,
 case o_orderkey % 4
   when 0 then strftime(o_orderdate, '%Y-%m-%d')
   when 1 then strftime(o_orderdate, '%d/%m/%Y')
   when 2 then strftime(o_orderdate, '%Y/%m/%d')
   else strftime(o_orderdate, '%d-%b-%Y') end as order_date_txt,
 case when o_orderkey % 9 = 0 then 'soon' else strftime(o_orderdate, '%Y-%m-%d') end as mostly_date_txt,
 cast(o_custkey as varchar) as custkey_txt,
 o_orderpriority
from {orders}
"""

SPARK_ORDERS_TEXT_DATES_SQL = """
select o_orderkey,
 case o_orderkey % 4
   when 0 then date_format(o_orderdate, 'yyyy-MM-dd')
   when 1 then date_format(o_orderdate, 'dd/MM/yyyy')
   when 2 then date_format(o_orderdate, 'yyyy/MM/dd')
   else date_format(o_orderdate, 'dd-MMM-yyyy') end as order_date_txt,
 case when o_orderkey % 9 = 0 then 'soon' else date_format(o_orderdate, 'yyyy-MM-dd') end as mostly_date_txt,
 cast(o_custkey as string) as custkey_txt,
 o_orderpriority
from {orders}
"""


# order dates in every rendering the date reader knows: all of them in one
# column, numeric ones with days first, numeric ones with months first
_DATE_PARTS = """
select o_orderkey, cast(year(o_orderdate) as {text}) as y, cast(month(o_orderdate) as {text}) as m1,
 cast(day(o_orderdate) as {text}) as d1, lpad(cast(month(o_orderdate) as {text}), 2, '0') as m,
 lpad(cast(day(o_orderdate) as {text}), 2, '0') as d, substr(cast(year(o_orderdate) as {text}), 3, 2) as yy,
 substr('JanFebMarAprMayJunJulAugSepOctNovDec', cast(3 * month(o_orderdate) - 2 as int), 3) as mon, o_orderpriority
from {{orders}}
"""
_DATE_TEXTS = """
select o_orderkey,
 case o_orderkey % 16 when 0 then y || '-' || m || '-' || d || 'T10:00:00.123Z' when 1 then m || '/' || d || '/' || yy
  when 2 then mon || ' ' || d1 || ' ' || y when 3 then d1 || ' ' || mon || ' ' || y when 4 then y || '-' || m || '-' || d || 'T10:00'
  when 5 then y || m || d || 'T101500' when 6 then m1 || '/' || d1 || '/' || y || ' 10:00'
  when 7 then m1 || '/' || d1 || '/' || y || ' 3:04 PM' when 8 then y || m || d when 9 then ' ' || y || '/' || m || '/' || d || ' '
  when 10 then mon || '. ' || d || ', ' || y || ' 12:30 am' when 11 then y || '-' || m || '-' || d || ' 23:59:59+05:30'
  when 12 then d || '-' || mon || '-' || yy when 13 then m || '.' || d || '.' || y when 14 then 'Fri, ' || d || ' ' || mon || ' ' || y || ' 08:00:00 GMT'
  else y || '-' || m || '-' || d end as any_txt,
 case when o_orderkey % 23 = 0 then 'unknown' else d || '/' || m || '/' || y end as days_first_txt,
 case when o_orderkey % 19 = 0 then m || '/' || m || '-' || y when o_orderkey % 7 = 0 then '31/02/' || y
  else m1 || '-' || d1 || '-' || y end as months_first_txt,
 o_orderpriority as order_txt
from (""" + _DATE_PARTS + """) parts
"""
DATE_TEXTS_SQL = _DATE_TEXTS.format(text="varchar")
SPARK_DATE_TEXTS_SQL = _DATE_TEXTS.format(text="string")

# orders as a ledger: an identifying text, a date text with some non-dates, a
# constant and a nearly constant column; and the same without the identifier,
# so that rows repeat.
_LEDGER_COMMON = """
select 'O-' || cast(o_orderkey as {text}) as order_ref,
 case when o_orderkey % 9 = 0 then 'soon' else {fmt_iso} end as booked_on,
 'USD' as currency,
 case when o_orderkey % 40 = 0 then 'late' else 'open' end as state,
 case when o_orderkey % 31 = 0 then null else o_totalprice end as amount
from {{orders}}
"""
LEDGER_SQL = _LEDGER_COMMON.format(text="varchar", fmt_iso="strftime(o_orderdate, '%Y-%m-%d')")
SPARK_LEDGER_SQL = _LEDGER_COMMON.format(text="string", fmt_iso="date_format(o_orderdate, 'yyyy-MM-dd')")

# a table that is not ready for modeling: three target classes, infinities
UNREADY_CUSTOMER_SQL = """
select c_custkey, c_mktsegment as segment,
 case when c_custkey % 50 = 0 then cast('Infinity' as double) when c_custkey % 51 = 0 then cast('NaN' as double)
      else c_acctbal end as acctbal,
 case when c_acctbal > 5000 then 1 when c_acctbal < 0 then 2 when c_custkey % 97 <> 0 then 0 end as target
from {customer}
"""


# events with every third row a second time, whole rows
REPEATED_EVENTS_SQL = "select * from {events} union all select * from {events} where event_id % 3 = 0"

# street names in spellings that only full case folding brings together
STREETS_SQL = """
select c_custkey, case c_custkey % 5 when 0 then 'Hauptstraße ' when 1 then 'HAUPTSTRASSE ' when 2 then ' hauptstrasse '
  when 3 then 'Hauptstrasse ' else 'Ringweg ' end || case when c_custkey % 5 = 4 then 'A' else '' end || c_nationkey as street
from {customer}
"""

# customers with text that CSV has to quote: quotes, commas, line breaks
CUSTOMER_NOTES_SQL = """
select c_custkey, case c_custkey % 6 when 0 then 'said "' || c_mktsegment || '", twice'
  when 1 then c_name || chr(10) || '"quoted line"' || chr(10) || chr(10) || 'end, of note' when 2 then '"'
  when 3 then chr(10) || c_mktsegment when 4 then null else c_mktsegment end as note,
 c_acctbal, case when c_custkey % 5 = 0 then 'a,b' || chr(10) else 'plain' end as tag
from {customer}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dirty_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DIRTY_CUSTOMER_SQL, customer=table(spark, sf_dir, "customer"))


def orders_text_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SPARK_ORDERS_TEXT_DATES_SQL, orders=table(spark, sf_dir, "orders"))


def customer_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CUSTOMER_NOTES_SQL, customer=table(spark, sf_dir, "customer"))


def repeated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(REPEATED_EVENTS_SQL, events=table(spark, sf_dir, "events"))


def streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(STREETS_SQL, customer=table(spark, sf_dir, "customer"))


def date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SPARK_DATE_TEXTS_SQL, orders=table(spark, sf_dir, "orders"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SPARK_LEDGER_SQL, orders=table(spark, sf_dir, "orders"))


def unready_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(UNREADY_CUSTOMER_SQL, customer=table(spark, sf_dir, "customer"))


def duck(sql: str, **tables: str) -> str:
    """The DuckDB form of a derived view: table names substituted."""
    return sql.format(**{k: v for k, v in tables.items()})


# An account table with the defects the repair operators fix: ages as text
# (some invalid), charges as text with a currency sign, sign-up dates in four
# formats, injected extreme totals and two outcome-leakage columns.
_ACCOUNTS_COMMON = """
select o_orderkey as customer_id,
 'AC-' || cast(o_custkey as {text}) as account_number,
 case when o_orderkey % 37 = 0 then 'unknown' when o_orderkey % 41 = 0 then '150'
      when o_orderkey % 43 = 0 then '7' else cast(18 + o_orderkey % 60 as {text}) end as age,
 ' £' || cast(cast(round(o_totalprice / 5000, 2) as decimal(12, 2)) as {text}) as monthly_charge,
 cast(1 + o_orderkey % 72 as int) as tenure_months,
 case when o_orderkey % 53 = 0 then 25000.0 + o_orderkey % 1000
      else cast(cast(round(o_totalprice / 5000, 2) as decimal(12, 2)) as double) * (1 + o_orderkey % 72) end
   as total_charge,
 case o_orderkey % 4 when 0 then {fmt_iso} when 1 then {fmt_dmy} when 2 then {fmt_dmony} else {fmt_ymd} end
   as signup_date,
 case when o_orderstatus = 'F' then 1 else 0 end as churned,
 case when o_orderstatus = 'F' then {fmt_iso} end as account_closed_date,
 case when o_orderkey % 3 = 0 then 'yes' else 'no' end as retention_offer_accepted
from {{orders}}
"""

DIRTY_ACCOUNTS_SQL = _ACCOUNTS_COMMON.format(
    text="varchar", fmt_iso="strftime(o_orderdate, '%Y-%m-%d')", fmt_dmy="strftime(o_orderdate, '%d/%m/%Y')",
    fmt_dmony="strftime(o_orderdate, '%d-%b-%Y')", fmt_ymd="strftime(o_orderdate, '%Y/%m/%d')")

SPARK_DIRTY_ACCOUNTS_SQL = _ACCOUNTS_COMMON.format(
    text="string", fmt_iso="date_format(o_orderdate, 'yyyy-MM-dd')", fmt_dmy="date_format(o_orderdate, 'dd/MM/yyyy')",
    fmt_dmony="date_format(o_orderdate, 'dd-MMM-yyyy')", fmt_ymd="date_format(o_orderdate, 'yyyy/MM/dd')")


def dirty_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SPARK_DIRTY_ACCOUNTS_SQL, orders=table(spark, sf_dir, "orders"))


# Labeled documents with a deterministic score in [0, 1) (ties included),
# standing in for model output in the metric queries.
SCORED_LABELS_SQL = """
select l.doc_id, l.quality as label,
 cast((l.doc_id * 37 + d.n_chars) % 100 * 7 + 30 * l.quality * (l.doc_id % 3) as double) / 1000 as score
from {labels} l join {documents} d on l.doc_id = d.doc_id
"""

LABELED_DOCUMENTS_SQL = """
select l.doc_id, l.quality, d.lang, d.source, d.n_chars
from {labels} l join {documents} d on l.doc_id = d.doc_id
"""


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SCORED_LABELS_SQL, labels=table(spark, sf_dir, "labels"),
                     documents=table(spark, sf_dir, "documents"))


def labeled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LABELED_DOCUMENTS_SQL, labels=table(spark, sf_dir, "labels"),
                     documents=table(spark, sf_dir, "documents"))
