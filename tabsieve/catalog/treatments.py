"""Registered treatment, plan and dataset-guard queries (T1 to T11, X1 to X6,
J1 to J5, S4 to S6)."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.catalog.inventory import CUSTOMER_RULES, DIRTY_KINDS, LINEITEM_KINDS, inventory_sql, rule_sql
from tabsieve.operators import issues, prepare
from tabsieve.plans import treatment
from tabsieve.registry import register
from tabsieve.sources.derived import (
    CUSTOMER_NOTES_SQL,
    REPEATED_EVENTS_SQL,
    customer_notes,
    date_texts,
    dirty_customer,
    orders_text_dates,
    repeated_events,
    table,
)
from tabsieve.sources.tables import content_fingerprint, dataset_difference, evidence_fingerprint, fingerprint_value
from tabsieve.sqlkit import (
    DATE_TEXTS_CTE,
    DIRTY_CTE,
    MARKERS_SQL,
    ORDERS_DATES_CTE,
    day_first_sql,
    fingerprint_sql,
    to_number_sql,
    to_timestamp_sql,
)

COLS = ("c_custkey", "segment", "acctbal", "nation_txt", "target")


def _select(**override: str) -> str:
    """SELECT list of the dirty view with some columns replaced."""
    return ", ".join(f"{override[c]} as {c}" if c in override else c for c in COLS)


def _dirty(spark, d) -> DataFrame:
    return dirty_customer(spark, d)


# ---------------------------------------------------------------- T1 to T3

register("remove_duplicates", """
select distinct event_type, user_id from events
""")(lambda spark, d: prepare.remove_duplicates(table(spark, d, "events").select("event_type", "user_id")))

register("remove_duplicates_events", f"""
select distinct * from ({REPEATED_EVENTS_SQL.format(events="events")})
""")(lambda spark, d: prepare.remove_duplicates(repeated_events(spark, d)))

register("drop_missing", f"""
with {DIRTY_CTE} select * from dirty_customer where not (acctbal is null or isnan(acctbal))
""")(lambda spark, d: prepare.drop_missing_rows(_dirty(spark, d), "acctbal"))

register("exclude_feature", f"""
with {DIRTY_CTE} select c_custkey, segment, acctbal, target from dirty_customer
""")(lambda spark, d: prepare.exclude_feature(_dirty(spark, d), "nation_txt"))

# ---------------------------------------------------------------- T7, T8, T4

register("trim", f"""
with {DIRTY_CTE} select {_select(segment='trim(segment)')} from dirty_customer
""")(lambda spark, d: prepare.trim_whitespace(_dirty(spark, d), "segment"))

NULLED_SEGMENT = f"case when segment is not null and lower(trim(segment)) in {MARKERS_SQL} then null else segment end"

register("normalize_nulls", f"""
with {DIRTY_CTE} select {_select(segment=NULLED_SEGMENT)} from dirty_customer
""")(lambda spark, d: prepare.normalize_nulls(_dirty(spark, d), "segment"))


def category_map_sql(tab: str, col: str, order: str) -> str:
    return f"""
 select k, trim(raw) as canonical from (
  select k, raw, count(*) over (partition by k) as spellings,
   row_number() over (partition by k order by n desc, first_key, raw) as rn
  from (select lower(trim({col})) as k, {col} as raw, count(*) as n, min({order}) as first_key
        from {tab} where {col} is not null and lower(trim({col})) not in {MARKERS_SQL} group by 1, 2)
 ) where spellings >= 2 and rn = 1"""


register("normalize_categories", f"""
with {DIRTY_CTE}, m as ({category_map_sql('dirty_customer', 'segment', 'c_custkey')})
select {_select(segment='coalesce(m.canonical, segment)')}
from dirty_customer left join m on lower(trim(segment)) = m.k
""")(lambda spark, d: prepare.normalize_categories(_dirty(spark, d), "segment", order_by="c_custkey"))

# ---------------------------------------------------------------- T5, T6

MISSING_ACCTBAL = "(acctbal is null or isnan(acctbal))"

register("impute_median", f"""
with {DIRTY_CTE}, s as (select quantile_cont(acctbal, 0.5) as m from dirty_customer where not {MISSING_ACCTBAL})
select {_select(acctbal=f'case when {MISSING_ACCTBAL} then (select m from s) else acctbal end')} from dirty_customer
""")(lambda spark, d: prepare.impute_missing(_dirty(spark, d), "acctbal", "median"))

register("impute_mean", f"""
with {DIRTY_CTE}, s as (select avg(acctbal) as m from dirty_customer where not {MISSING_ACCTBAL})
select {_select(acctbal=f'case when {MISSING_ACCTBAL} then (select m from s) else acctbal end')} from dirty_customer
""")(lambda spark, d: prepare.impute_missing(_dirty(spark, d), "acctbal", "mean"))


def mode_sql(tab: str, col: str, order: str) -> str:
    return (f"(select v from (select {col} as v, count(*) as n, min({order}) as f from {tab} "
            f"where {col} is not null group by 1) order by n desc, f, v limit 1)")


register("impute_mode", f"""
with {DIRTY_CTE}
select {_select(segment=f"coalesce(segment, {mode_sql('dirty_customer', 'segment', 'c_custkey')})")} from dirty_customer
""")(lambda spark, d: prepare.impute_missing(_dirty(spark, d), "segment", "mode", order_by="c_custkey"))

# ---------------------------------------------------------------- X1 to X6

register("convert_numeric", f"""
with {DIRTY_CTE} select {_select(nation_txt=to_number_sql('nation_txt'))} from dirty_customer
""")(lambda spark, d: prepare.convert_numeric(_dirty(spark, d), "nation_txt"))

register("convert_date", f"""
with {ORDERS_DATES_CTE}, elected as (select {day_first_sql('order_date_txt', 'orders_dates')} as days_first)
select o_orderkey, {to_timestamp_sql('trim(order_date_txt)', 'days_first')} as order_date_txt, mostly_date_txt, custkey_txt, o_orderpriority
from orders_dates, elected
""")(lambda spark, d: prepare.convert_date(orders_text_dates(spark, d), "order_date_txt"))

DATE_TEXT_COLUMNS = ("any_txt", "days_first_txt", "months_first_txt")

register("convert_date_mixed", f"""
with {DATE_TEXTS_CTE},
elected as (select {', '.join(f"{day_first_sql(c, 'date_texts')} as {c}_order" for c in DATE_TEXT_COLUMNS)})
select o_orderkey, {', '.join(f"{to_timestamp_sql(f'trim({c})', f'{c}_order')} as {c}" for c in DATE_TEXT_COLUMNS)}
from date_texts, elected
""")(lambda spark, d: functools.reduce(prepare.convert_date, DATE_TEXT_COLUMNS, date_texts(spark, d)).drop("order_txt"))

register("cap_outliers", f"""
with {DIRTY_CTE}, b as (select quantile_cont(acctbal, 0.25) as q1, quantile_cont(acctbal, 0.75) as q3 from dirty_customer),
 bb as (select q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from b)
select {_select(acctbal='case when acctbal is null then null else least(greatest(acctbal, bb.lo), bb.hi) end')}
from dirty_customer, bb
""")(lambda spark, d: prepare.cap_outliers(_dirty(spark, d), "acctbal"))

_acct_rule = CUSTOMER_RULES[0]
_seg_rule = CUSTOMER_RULES[1]
_ael, _avi = rule_sql(_acct_rule, DIRTY_KINDS)
_sel, _svi = rule_sql(_seg_rule, DIRTY_KINDS)

register("set_missing", f"""
with {DIRTY_CTE} select {_select(acctbal=f'case when {_ael} and coalesce({_avi}, false) then null else acctbal end')}
from dirty_customer
""")(lambda spark, d: prepare.set_missing(_dirty(spark, d), _acct_rule))

register("fill_constant", f"""
with {DIRTY_CTE} select {_select(segment="coalesce(segment, 'UNKNOWN')")} from dirty_customer
""")(lambda spark, d: prepare.fill_constant(_dirty(spark, d), "segment", "UNKNOWN"))

register("drop_violations", f"""
with {DIRTY_CTE} select * from dirty_customer where not ({_sel} and coalesce({_svi}, false))
""")(lambda spark, d: prepare.drop_violations(_dirty(spark, d), _seg_rule))

# ---------------------------------------------------------------- T10, T11, J1 to J5

PLAN_DECISIONS = (
    ("missing_values:segment", "mode", "fill segment with its most frequent spelling"),
    ("missing_values:acctbal", "median", "robust fill for balances"),
    ("missing_values:nation_txt", "retain", "kept for review"),
    ("fake_nulls:segment", "normalize_nulls", "markers are missing values"),
    ("categorical_inconsistency:segment", "normalize_categories", "case variants are one segment"),
    ("numeric_conversion:nation_txt", "retain", "nation codes stay text"),
    ("outlier:acctbal", "investigate", "ask finance"),
    ("formatting_issue:segment", "trim_whitespace", "stray spaces"),
    ("rule:acctbal_range", "investigate", "ledger range to confirm"),
    ("rule:segment_allowed", "retain", "variants handled by normalization"),
)


def _plan_inputs(spark, d):
    df = _dirty(spark, d)
    inv = issues.issue_inventory(df, CUSTOMER_RULES).persist()
    plan = treatment.TreatmentPlan(
        dataset_fingerprint=fingerprint_value(df),
        evidence_fingerprint=evidence_fingerprint(inv).first()["fingerprint"],
        reviewer="data steward",
        decisions=[treatment.TreatmentDecision(*x) for x in PLAN_DECISIONS])
    return df, inv, plan


def _apply_plan(spark, d):
    df, inv, plan = _plan_inputs(spark, d)
    try:
        # The plan is checked and compiled eagerly; the result does not
        # read the issue table any more.
        return treatment.apply_treatment_plan(df, inv, plan, CUSTOMER_RULES, order_by="c_custkey")
    finally:
        inv.unpersist()


# Same plan in SQL: nulls -> trim -> categories -> imputations (priority order).
register("apply_plan", f"""
with {DIRTY_CTE},
s1 as (select {_select(segment=NULLED_SEGMENT)} from dirty_customer),
s2 as (select {_select(segment='trim(segment)')} from s1),
m as ({category_map_sql('s2', 'segment', 'c_custkey')}),
s3 as (select {_select(segment='coalesce(m.canonical, segment)')} from s2 left join m on lower(trim(segment)) = m.k),
s4 as (select {_select(segment=f"coalesce(segment, {mode_sql('s3', 'segment', 'c_custkey')})")} from s3),
s5 as (select {_select(acctbal=f"case when {MISSING_ACCTBAL} then (select quantile_cont(acctbal, 0.5) from s4 where not {MISSING_ACCTBAL}) else acctbal end")} from s4)
select * from s5
""")(_apply_plan)

FLAWED_DECISIONS = (
    ("missing_values:segment", "median", "not allowed for text"),
    ("missing_values:acctbal", "median", "fine"),
    ("missing_values:acctbal", "mean", "decided twice"),
    ("no_such_issue:x", "retain", "unknown issue"),
    ("fake_nulls:segment", "normalize_nulls", "fine"),
)


def _plan_violations(spark, d):
    inv = issues.issue_inventory(_dirty(spark, d), CUSTOMER_RULES)
    dec = treatment.decisions_frame(spark, [treatment.TreatmentDecision(*x) for x in FLAWED_DECISIONS])
    return treatment.plan_violations(inv, dec)


_flawed_values = ", ".join(f"('{a}', '{b}')" for a, b, _ in FLAWED_DECISIONS)
register("plan_violations", f"""
with {DIRTY_CTE}, inv as ({inventory_sql('dirty_customer', DIRTY_KINDS, CUSTOMER_RULES)}),
dec as (select * from (values {_flawed_values}) t(issue_id, treatment))
select 'unknown_decision' as kind, issue_id, treatment from dec where issue_id not in (select issue_id from inv)
union all select 'missing_decision', issue_id, null from inv where issue_id not in (select issue_id from dec)
union all select 'forbidden_treatment', dec.issue_id, dec.treatment from dec join inv using (issue_id)
 where not list_contains(string_split(inv.allowed_treatments, ','), dec.treatment)
union all select 'duplicate_or_empty_decision', issue_id, null from dec group by issue_id
 having count(*) > 1 or issue_id is null or issue_id = ''
""")(_plan_violations)


def _unresolved(spark, d):
    inv = issues.issue_inventory(_dirty(spark, d), CUSTOMER_RULES)
    dec = treatment.decisions_frame(spark, [treatment.TreatmentDecision(*x) for x in PLAN_DECISIONS])
    return treatment.unresolved_issues(inv, dec).drop("evidence")


_plan_values = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in PLAN_DECISIONS)
register("unresolved_issues", f"""
with {DIRTY_CTE}, inv as ({inventory_sql('dirty_customer', DIRTY_KINDS, CUSTOMER_RULES)}),
dec as (select * from (values {_plan_values}) t(issue_id, treatment, rationale))
select issue_id, inv.issue_type, coalesce(inv."column", 'dataset-wide') as "column", dec.treatment, dec.rationale
from dec join inv using (issue_id) where dec.treatment in ('retain', 'investigate')
""")(_unresolved)

# ---------------------------------------------------------------- S4 to S6

CUSTOMER_SCHEMA = "c_custkey:bigint,c_name:string,c_nationkey:int,c_acctbal:double,c_mktsegment:string"
LINEITEM_SCHEMA = ("l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint,l_linenumber:int,l_quantity:double,"
                   "l_extendedprice:double,l_discount:double,l_tax:double,l_returnflag:string,l_linestatus:string,"
                   "l_shipdate:timestamp_ntz")
CUSTOMER_KINDS = {"c_custkey": "int", "c_name": "text", "c_nationkey": "int", "c_acctbal": "float", "c_mktsegment": "text"}

register("dataset_fingerprint", fingerprint_sql("customer", CUSTOMER_KINDS, CUSTOMER_SCHEMA))(
    lambda spark, d: content_fingerprint(table(spark, d, "customer")))
register("dataset_fingerprint_lineitem", fingerprint_sql("lineitem", LINEITEM_KINDS, LINEITEM_SCHEMA))(
    lambda spark, d: content_fingerprint(table(spark, d, "lineitem")))


def _equality(spark, d):
    # The whole table against itself plus a second copy of its negative-
    # balance rows: those rows exist on both sides, so only a multiset
    # difference (EXCEPT ALL) sees them.
    c = table(spark, d, "customer")
    other = c.unionByName(c.where(F.col("c_acctbal") < 0))
    return dataset_difference(c, other)


register("dataset_equality", """
with other as (select * from customer union all select * from customer where c_acctbal < 0)
select (select count(*) from (select * from customer except all select * from other)) as left_only,
 (select count(*) from (select * from other except all select * from customer)) as right_only,
 (select count(*) from (select * from customer except all select * from other)) = 0
 and (select count(*) from (select * from other except all select * from customer)) = 0 as equal
""")(_equality)


def _csv_roundtrip(spark, d):
    # S3 then S1/S2: the dirty view goes through the atomic CSV sink into the
    # shared folder and comes back through the extension dispatch, with the
    # reader's NA tokens and type inference.
    from tabsieve.sources.tables import read_table, shared_output_dir, write_table_atomic
    path = f"{shared_output_dir(spark)}/tabsieve-roundtrip-{uuid.uuid4().hex}/dirty_customer.csv"
    write_table_atomic(_dirty(spark, d), path, fmt="csv")
    return read_table(spark, path)


# Empty text is an NA token of the reader; ' N/A ' (with spaces) is not.
register("csv_roundtrip", f"""
with {DIRTY_CTE}
select c_custkey, case when segment = '' then null else segment end as segment, acctbal,
 nation_txt, cast(target as bigint) as target from dirty_customer
""")(_csv_roundtrip)


def _csv_quoted(spark, d):
    # S3 in one step, twice, then S1: text with quotes, commas and line breaks
    # in CSV files that are cut anywhere, the second version being the table.
    from tabsieve.sources.tables import read_table, shared_output_dir
    from tabsieve.sources.versions import publish_table
    path = f"{shared_output_dir(spark)}/tabsieve-versions-{uuid.uuid4().hex}/notes.csv"
    notes = customer_notes(spark, d)
    publish_table(notes.select("c_custkey", "note"), path, fmt="csv")
    publish_table(notes, path, fmt="csv")
    return read_table(spark, path)


register("csv_roundtrip_quoted", CUSTOMER_NOTES_SQL.format(customer="customer"))(_csv_quoted)


def _verified_copy(spark, d):
    # S5 with S3: the one scan that copies the table also checks it, and the
    # copy is published only if its input was the expected one.
    from tabsieve.sources.tables import VerifiedScan, read_table, save_files, shared_output_dir
    from tabsieve.sources.versions import publish_written
    expected = fingerprint_value(table(spark, d, "customer"))
    scan = VerifiedScan(spark, f"{d.rstrip('/')}/customer.parquet", expected)
    path = f"{shared_output_dir(spark)}/tabsieve-copy-{uuid.uuid4().hex}/customer.parquet"
    publish_written(spark, path, lambda target: scan.run(lambda frame: save_files(frame, target, "parquet")))
    return read_table(spark, path)


register("verified_copy", "select * from customer")(_verified_copy)


def _verified(spark, d):
    from tabsieve.sources.tables import read_verified
    path = f"{d.rstrip('/')}/customer.parquet"
    expected = fingerprint_value(table(spark, d, "customer"))
    return read_verified(spark, path, expected)


register("verified_scan", "select * from customer")(_verified)
