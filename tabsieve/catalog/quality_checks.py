"""Registered quality-check queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from tabsieve.functions.dates import SHAPE_NAMES, date_format_counts
from tabsieve.operators import quality
from tabsieve.registry import register
from tabsieve.sources.derived import (
    REPEATED_EVENTS_SQL,
    STREETS_SQL,
    date_texts,
    dirty_customer,
    orders_text_dates,
    repeated_events,
    streets,
    table,
)
from tabsieve.sqlkit import (
    DIRTY_COLUMNS,
    DATE_TEXTS_CTE,
    DIRTY_CTE,
    DIRTY_FLOAT,
    DIRTY_NUMERIC,
    DIRTY_TEXT,
    MARKERS_SQL,
    ORDERS_DATES_CTE,
    date_shape_sql,
    missing_sql,
    per_column,
    to_number_sql,
    to_timestamp_sql,
    unpivot_double,
    unpivot_text,
)

LINEITEM_NUMERIC = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax")

# ---------------------------------------------------------------- A1, A2, P7

register("missing_counts", f"""
with {DIRTY_CTE}, m as (
{per_column('dirty_customer', DIRTY_COLUMNS, {'n': lambda c: f"count(*) filter (where {missing_sql(c, c in DIRTY_TEXT, c in DIRTY_FLOAT)})"})}
) select "column", n from m where n > 0
""")(lambda spark, d: quality.missing_counts(dirty_customer(spark, d)))

register("genuine_missing", f"""
with {DIRTY_CTE}, m as (
{per_column('dirty_customer', DIRTY_COLUMNS, {'n': lambda c: f"count(*) filter (where {missing_sql(c, False, c in DIRTY_FLOAT)})"})}
) select "column", n from m where n > 0
""")(lambda spark, d: quality.genuine_missing_counts(dirty_customer(spark, d)))

register("fake_nulls", f"""
with {DIRTY_CTE}, m as (
{per_column('dirty_customer', DIRTY_TEXT, {'n': lambda c: f"count(*) filter (where {c} is not null and lower(trim({c})) in {MARKERS_SQL})"})}
) select "column", n from m where n > 0
""")(lambda spark, d: quality.textual_null_counts(dirty_customer(spark, d)))

# ---------------------------------------------------------------- A3, T1, A4

register("duplicate_rows", """
select coalesce(sum(k - 1), 0)::bigint as duplicate_rows
from (select count(*) as k from events group by event_type, user_id)
""")(lambda spark, d: quality.duplicate_row_count(table(spark, d, "events").select("event_type", "user_id")))

register("duplicate_values", f"""
with {DIRTY_CTE}, vc as (
{unpivot_text('dirty_customer', ('c_custkey', 'segment', 'nation_txt', 'target'))}
) select "column", trim(value) as value, count(*) as n from vc where value is not null
group by all having count(*) > 1
""")(lambda spark, d: quality.duplicate_values(dirty_customer(spark, d),
                                               ["c_custkey", "segment", "nation_txt", "target"]))

register("duplicate_rows_events", f"""
with e as ({REPEATED_EVENTS_SQL.format(events="events")})
select coalesce(sum(k - 1), 0)::bigint as duplicate_rows from (select count(*) as k from e group by event_id, ts, user_id, event_type, value, props)
""")(
    lambda spark, d: quality.duplicate_row_count(repeated_events(spark, d)))

register("duplicate_values_all", f"""
with {DIRTY_CTE}, vc as (
{unpivot_text('dirty_customer', DIRTY_COLUMNS)}
) select "column", trim(value) as value, count(*) as n from vc where value is not null
group by all having count(*) > 1
""")(lambda spark, d: quality.duplicate_values(dirty_customer(spark, d)))

# ---------------------------------------------------------------- A5, A6


def _iqr_sql(cte: str, tab: str, cols, include_empty: bool) -> str:
    return f"""
with {cte}long as (
{unpivot_double(tab, cols)}
), b as (
 select "column", quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.75) as q3 from long where v is not null group by 1
), b2 as (
 select "column", q1, q3, q3 - q1 as iqr, q1 - 1.5 * (q3 - q1) as lower_bound, q3 + 1.5 * (q3 - q1) as upper_bound from b
)
select b2.*, (select count(*) from long l where l."column" = b2."column" and (l.v < b2.lower_bound or l.v > b2.upper_bound)) as outlier_count
from b2
"""


register("iqr_outliers", _iqr_sql(DIRTY_CTE + ", ", "dirty_customer", DIRTY_NUMERIC, True))(
    lambda spark, d: quality.iqr_summary(dirty_customer(spark, d), list(DIRTY_NUMERIC), include_empty=True))

register("iqr_evidence", _iqr_sql("", "lineitem", LINEITEM_NUMERIC, False))(
    lambda spark, d: quality.iqr_summary(table(spark, d, "lineitem")))

# ---------------------------------------------------------------- A7, A8


def _numeric_like_sql(ratio_name: str) -> str:
    return f"""
with {DIRTY_CTE}, m as (
{per_column('dirty_customer', DIRTY_TEXT, {'numeric_like_count': lambda c: f"count({to_number_sql(c)})", 'non_null_count': lambda c: f"count({c})"})}
) select "column", numeric_like_count, non_null_count, numeric_like_count / non_null_count as {ratio_name}
from m where non_null_count > 0 and numeric_like_count / non_null_count >= 0.8
"""


register("numeric_like", _numeric_like_sql("proportion"))(
    lambda spark, d: quality.numeric_like_columns(dirty_customer(spark, d)))
register("numeric_like_evidence", _numeric_like_sql("numeric_like_ratio"))(
    lambda spark, d: quality.numeric_like_columns(dirty_customer(spark, d), evidence_names=True))

# ---------------------------------------------------------------- A9 to A12


def _variants_sql(skip_markers: bool) -> str:
    skip = f"and lower(trim(value)) not in {MARKERS_SQL}" if skip_markers else ""
    return f"""
with {DIRTY_CTE}, vc as (
{unpivot_text('dirty_customer', DIRTY_TEXT)}
), sp as (
 select distinct "column", lower(trim(value)) as normalized, value as variant from vc where value is not null {skip}
) select "column", normalized, variant, count(*) over (partition by "column", normalized) as n_variants
from sp qualify n_variants > 1
"""


register("categorical_inconsistencies", _variants_sql(True))(
    lambda spark, d: quality.categorical_inconsistencies(dirty_customer(spark, d)))
register("categorical_inconsistencies_evidence", _variants_sql(False))(
    lambda spark, d: quality.categorical_inconsistencies(dirty_customer(spark, d), skip_markers=False))

register("categorical_evidence_folded", f"""
with s as ({STREETS_SQL.format(customer="customer")}), v as (
 select distinct street as variant, replace(lower(trim(street)), 'ß', 'ss') as normalized from s)
select 'street' as "column", normalized, variant, count(*) over (partition by normalized) as n_variants from v
qualify n_variants > 1
""")(lambda spark, d: quality.categorical_inconsistencies(streets(spark, d), skip_markers=False))

register("formatting_issues", f"""
with {DIRTY_CTE}, vc as (
{unpivot_text('dirty_customer', DIRTY_TEXT)}
), ws as (
 select "column", count(*) filter (where value is not null and value <> trim(value)) as whitespace_count from vc group by 1
), g as (
 select "column", lower(trim(value)) as normalized, count(distinct value) as spellings, count(*) as rows
 from vc where value is not null and trim(value) <> '' group by 1, 2
), c as (
 select "column", coalesce(sum(rows) filter (where spellings > 1), 0)::bigint as case_inconsistency_count from g group by 1
) select ws."column", ws.whitespace_count, coalesce(c.case_inconsistency_count, 0)::bigint as case_inconsistency_count
from ws left join c using ("column")
""")(lambda spark, d: quality.string_formatting_issues(dirty_customer(spark, d)))

register("formatting_evidence", f"""
with {DIRTY_CTE}, m as (
{per_column('dirty_customer', DIRTY_TEXT, {'whitespace_count': lambda c: f"count(*) filter (where {c} <> trim({c}))"})}
) select "column", whitespace_count from m where whitespace_count > 0
""")(lambda spark, d: quality.whitespace_counts(dirty_customer(spark, d)))

# ---------------------------------------------------------------- A13, A14, A17, A18

CUSTOMER_COLUMNS = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
PART_COLUMNS = ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")


def _card_sql(tab: str, cols) -> str:
    return "\n union all ".join(
        f"select '{c}' as \"column\", count({c}) as non_null_count, count(distinct {c}) as distinct_count, "
        f"(select coalesce(max(k), 0) from (select count(*) as k from {tab} where {c} is not null group by {c})) as top_count "
        f"from {tab}" for c in cols)


register("identifier_columns", f"""
with card as ({_card_sql('customer', ('c_name', 'c_mktsegment'))})
select "column", non_null_count, distinct_count, distinct_count / non_null_count as unique_ratio
from card where non_null_count >= 20 and distinct_count / non_null_count >= 0.95
""")(lambda spark, d: quality.identifier_columns(table(spark, d, "customer")))

register("identifier_columns_modeling", f"""
with card as ({_card_sql('customer', ('c_custkey', 'c_name', 'c_nationkey', 'c_acctbal'))})
select "column", non_null_count, distinct_count, distinct_count / non_null_count as unique_ratio
from card where non_null_count >= 1 and distinct_count / non_null_count >= 0.95
""")(lambda spark, d: quality.identifier_columns(table(spark, d, "customer"), min_non_null_count=1,
                                                  text_only=False, exclude=["c_mktsegment"]))

register("constant_features", f"""
with p as (select *, case when p_size > 1 then 'regular' else 'small' end as size_class, 'part' as kind from part),
card as ({_card_sql('p', PART_COLUMNS + ('size_class', 'kind'))})
select "column",
 case when distinct_count = 1 then 'constant_feature' else 'near_constant_feature' end as issue_type,
 non_null_count, distinct_count,
 case when distinct_count = 1 then 1.0 else top_count / non_null_count end as dominant_proportion
from card where non_null_count > 0 and (distinct_count = 1 or (non_null_count >= 20 and top_count / non_null_count >= 0.95))
""")(lambda spark, d: quality.constant_features(
    table(spark, d, "part").withColumn("size_class", F.when(F.col("p_size") > 1, "regular").otherwise("small"))
    .withColumn("kind", F.lit("part"))))

register("constant_columns", f"""
with p as (select *, 'part' as kind, cast(null as varchar) as note from part),
card as ({_card_sql('p', PART_COLUMNS + ('kind', 'note'))})
select "column", distinct_count from card where distinct_count <= 1
""")(lambda spark, d: quality.constant_columns(
    table(spark, d, "part").withColumn("kind", F.lit("part")).withColumn("note", F.lit(None).cast("string"))))

# ---------------------------------------------------------------- A15, A16

ORDERS_DATE_TEXT = ("order_date_txt", "mostly_date_txt", "custkey_txt", "o_orderpriority")


def _dates_sql(modeling: bool, cte: str = ORDERS_DATES_CTE, tab: str = "orders_dates",
               columns: Sequence[str] = ORDERS_DATE_TEXT) -> str:
    if modeling:
        metrics = {
            "value_count": lambda c: f"count({c})",
            "numeric_count": lambda c: "0",
            "date_count": lambda c: f"count({to_timestamp_sql(c)})",
        }
        keep = "value_count > 0 and date_count / value_count >= 0.8"
    else:
        def kept(c: str) -> str:
            return f"case when trim({c}) <> '' then trim({c}) end"
        metrics = {
            "value_count": lambda c: f"count({kept(c)})",
            "numeric_count": lambda c: f"count({to_number_sql(kept(c))})",
            "date_count": lambda c: f"count({to_timestamp_sql(kept(c))})",
        }
        keep = ("value_count > 0 and date_count / value_count >= 0.8 "
                "and numeric_count / value_count < 0.8")
    return f"""
with {cte}, m as (
{per_column(tab, columns, metrics)}
) select "column", value_count, numeric_count / value_count as numeric_ratio, date_count / value_count as date_ratio
from m where {keep}
"""


register("date_candidates", _dates_sql(False))(
    lambda spark, d: quality.date_candidate_columns(orders_text_dates(spark, d)))
register("date_candidates_modeling", _dates_sql(True))(
    lambda spark, d: quality.date_candidate_columns(orders_text_dates(spark, d), modeling=True,
                                                    exclude=["o_orderkey"]))

DATE_TEXT_COLUMNS = ("any_txt", "days_first_txt", "months_first_txt", "order_txt")

register("date_candidates_mixed", _dates_sql(False, DATE_TEXTS_CTE, "date_texts", DATE_TEXT_COLUMNS))(
    lambda spark, d: quality.date_candidate_columns(date_texts(spark, d)))

register("date_formats", f"""
with {DATE_TEXTS_CTE}, k as (
{' union all '.join(f"select '{c}' as col, case when trim({c}) <> '' then 1 end as v, {date_shape_sql(f'trim({c})')} as k from date_texts" for c in DATE_TEXT_COLUMNS)}
) select col as "column", count(v) as value_count, {', '.join(f"count(*) filter (where k = '{n}') as {n}" for n in SHAPE_NAMES)},
 count(*) filter (where k = 'day_first') > count(*) filter (where k = 'month_first') as day_first_order
from k group by col
""")(lambda spark, d: date_format_counts(date_texts(spark, d)))

# ---------------------------------------------------------------- A30, A31

register("dataset_health", f"""
with {DIRTY_CTE}, m as (
{per_column('dirty_customer', DIRTY_COLUMNS, {'n': lambda c: f"count(*) filter (where {missing_sql(c, c in DIRTY_TEXT, c in DIRTY_FLOAT)})"})}
) select (select count(*) from dirty_customer) as row_count, 5 as column_count,
 (select coalesce(sum(k - 1), 0)::bigint from (select count(*) as k from dirty_customer group by c_custkey, segment, acctbal, nation_txt, target)) as duplicate_rows,
 (select coalesce(sum(n), 0)::bigint from m) as missing_cells
""")(lambda spark, d: quality.dataset_health(dirty_customer(spark, d)))
