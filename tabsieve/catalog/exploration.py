"""Registered exploration and metadata queries (A19 to A27, P1 to P3, P8 to
P10, P13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsieve.operators import eda
from tabsieve.registry import register
from tabsieve.sources.derived import DIRTY_CUSTOMER_SQL, dirty_customer, table
from tabsieve.sqlkit import DIRTY_CTE, DIRTY_TEXT, unpivot_double, unpivot_text

LINEITEM_NUMERIC = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax")


def _corr_sql(a: str, b: str) -> str:
    """Pearson r over pairwise-complete rows, null on zero variance."""
    xa = f"case when {b} is not null then {a} end"
    xb = f"case when {a} is not null then {b} end"
    den = f"(stddev_pop({xa}) * stddev_pop({xb}))"
    return f"case when {den} = 0 then null else covar_pop({a}, {b}) / {den} end"


# ---------------------------------------------------------------- A19

register("numeric_summary", f"""
with long as ({unpivot_double('lineitem', LINEITEM_NUMERIC)})
select "column", count(v) as "count", avg(v) as mean, stddev_samp(v) as std, min(v) as "min",
 quantile_cont(v, 0.25) as p25, quantile_cont(v, 0.5) as p50, quantile_cont(v, 0.75) as p75, max(v) as "max"
from long group by 1
""")(lambda spark, d: eda.numeric_summary(table(spark, d, "lineitem")))

# ---------------------------------------------------------------- A20

register("categorical_top", f"""
with {DIRTY_CTE}, vc as (
 select "column", value, count(*) as n from ({unpivot_text('dirty_customer', DIRTY_TEXT)}) group by 1, 2
), ranked as (
 select *, row_number() over (partition by "column" order by n desc, value asc nulls last) as "rank",
  count(value) over (partition by "column") as unique_count from vc
) select "column", value, n, "rank", unique_count from ranked where "rank" <= 10
""")(lambda spark, d: eda.categorical_top_values(dirty_customer(spark, d)))

# ---------------------------------------------------------------- A21, A22, A23

_pairs = [(a, b) for a in LINEITEM_NUMERIC for b in LINEITEM_NUMERIC if a != b]
register("correlations", "\n union all ".join(
    f"select '{a}' as \"column\", '{b}' as other_column, {_corr_sql(a, b)} as r from lineitem" for a, b in _pairs
))(lambda spark, d: eda.numeric_correlations(table(spark, d, "lineitem")))

register("target_correlation", f"""
with {DIRTY_CTE}, m as (
 select 'c_custkey' as "column", {_corr_sql('c_custkey', 'target')} as r from dirty_customer
 union all select 'acctbal', {_corr_sql('acctbal', 'target')} from dirty_customer
) select * from m where r is not null
""")(lambda spark, d: eda.target_correlations(dirty_customer(spark, d), "target"))

register("target_correlation_modeling", f"""
with {DIRTY_CTE}, m as (
 select 'c_custkey' as "column", {_corr_sql('c_custkey', 'target')} as r from dirty_customer
 union all select 'acctbal', {_corr_sql('acctbal', 'target')} from dirty_customer
) select * from m where r is not null and (select count(distinct target) from dirty_customer) > 1
""")(lambda spark, d: eda.target_correlations(dirty_customer(spark, d), "target", require_variation=True))

# ---------------------------------------------------------------- A24, A25, A26, A27

register("target_rate_by_category", f"""
with {DIRTY_CTE}, long as (
 select 'segment' as "column", segment as value, target from dirty_customer
 union all select 'nation_txt', nation_txt, target from dirty_customer
) select "column", value, count(target) as n, avg(target) as target_rate from long group by 1, 2
""")(lambda spark, d: eda.target_rate_by_category(dirty_customer(spark, d), "target"))


def _wide_dirty(spark, d):
    return dirty_customer(spark, d).withColumn("name_txt", F.concat(F.lit("C-"), F.col("c_custkey").cast("string")))


register("category_target_modeling", f"""
with {DIRTY_CTE}, w as (select *, 'C-' || cast(c_custkey as varchar) as name_txt from dirty_customer),
long as (
 select 'segment' as "column", segment as value, target from w
 union all select 'nation_txt', nation_txt, target from w
 union all select 'name_txt', name_txt, target from w
), small as (select "column" from long group by 1 having count(distinct value) <= 50)
select "column", value, count(target) as n, avg(target) as target_rate from long
where "column" in (select "column" from small) group by 1, 2
""")(lambda spark, d: eda.target_rate_by_category(_wide_dirty(spark, d), "target", check=False, max_levels=50))


def _events_hour(spark, d):
    ev = table(spark, d, "events")
    return ev.select("event_type", "props", F.hour("ts").cast("string").alias("hour_txt"))


register("category_target_text", """
with w as (select event_type, props, cast(hour(ts) as varchar) as hour_txt from events),
long as (
 select 'props' as "column", props as value, event_type as t from w
 union all select 'hour_txt', hour_txt, event_type from w
), small as (select "column" from long group by 1 having count(distinct value) <= 50),
c as (select "column", value, t, count(*) as n from long where t is not null
      and "column" in (select "column" from small) group by 1, 2, 3)
select "column", value, t as target_value, n from c
qualify row_number() over (partition by "column", value order by n desc, t asc) <= 20
""")(lambda spark, d: eda.category_target_distribution(_events_hour(spark, d), "event_type"))

register("target_profile", f"""
with {DIRTY_CTE}
select 'int' as target_dtype, count(*) filter (where target is null) as target_missing_count,
 count(distinct target) as target_distinct_count from dirty_customer
""")(lambda spark, d: eda.target_profile(dirty_customer(spark, d), "target"))

register("target_distribution", f"""
with {DIRTY_CTE}
select cast(target as varchar) as value, count(*) as n from dirty_customer where target is not null group by 1
""")(lambda spark, d: eda.target_distribution(dirty_customer(spark, d), "target"))

# ---------------------------------------------------------------- P1 to P3, P10, P13

register("shape", """
select count(*) as row_count, 6 as column_count from part
""")(lambda spark, d: eda.shape(table(spark, d, "part")))

_DTYPE_SQL = ("case lower(data_type) when 'varchar' then 'string' when 'integer' then 'int' "
              "when 'timestamp' then 'timestamp_ntz' when 'timestamp with time zone' then 'timestamp' "
              "else lower(data_type) end")

register("schema_summary", f"""
select column_name as "column", {_DTYPE_SQL} as dtype, cast(ordinal_position - 1 as integer) as position,
 lower(data_type) in ('tinyint', 'smallint', 'integer', 'bigint', 'float', 'double', 'real') as is_numeric,
 lower(data_type) = 'varchar' as is_text
from information_schema.columns where table_name = 'orders'
""")(lambda spark, d: eda.schema_summary(table(spark, d, "orders")))

_TYPEOF = ("case lower(typeof({c})) when 'varchar' then 'string' when 'integer' then 'int' "
           "else lower(typeof({c})) end")

register("column_info", f"""
with {DIRTY_CTE}
""" + "\n union all ".join(
    f"select '{c}' as \"column\", (select {_TYPEOF.format(c=c)} from dirty_customer limit 1) as dtype, "
    f"count(*) filter (where {c} is null{' or isnan(' + c + ')' if c == 'acctbal' else ''}) as missing_values, "
    f"count(distinct {c}) as unique_values from dirty_customer"
    for c in ("c_custkey", "segment", "acctbal", "nation_txt", "target")
))(lambda spark, d: eda.column_information(dirty_customer(spark, d)))

register("target_candidates", f"""
with {DIRTY_CTE}, m as (
 select 'c_custkey' as "column", count(*) filter (where c_custkey not in (0, 1)) as other from dirty_customer
 union all select 'acctbal', count(*) filter (where acctbal not in (0, 1)) from dirty_customer
 union all select 'target', count(*) filter (where target not in (0, 1)) from dirty_customer
) select "column" from m where other = 0
""")(lambda spark, d: eda.target_candidates(dirty_customer(spark, d)))



# ---------------------------------------------------------------- P8, P9


def _mask_sql(c: str) -> str:
    s = f"cast({c} as varchar)"
    return (f"case when {c} is null then '' when length({s}) <= 4 then repeat('*', length({s})) "
            f"else substr({s}, 1, 2) || repeat('*', length({s}) - 4) || right({s}, 2) end")


register("safe_preview", f"""
select {_mask_sql('c_custkey')} as customer_id, {_mask_sql('c_name')} as account_name,
 c_nationkey, c_acctbal, c_mktsegment
from customer order by c_custkey limit 10
""")(lambda spark, d: eda.safe_preview(
    table(spark, d, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("account_name"),
                                       "c_nationkey", "c_acctbal", "c_mktsegment"),
    order_by=["customer_id"]))

_leak_like = " or ".join(f"lower(trim(column_name)) like '%{t}%'" for t in eda.LEAKAGE_TERMS)
# The view's column names come from DESCRIBE of its defining query.
register("leakage_names", f"""
select column_name as "column" from (describe {DIRTY_CUSTOMER_SQL.format(customer="customer")})
where lower(trim(column_name)) <> 'acctbal' and ({_leak_like})
""")(lambda spark, d: eda.leakage_name_columns(dirty_customer(spark, d), "acctbal"))

register("leakage_names_embeddings", f"""
select column_name as "column" from information_schema.columns
where table_name = 'embeddings' and lower(trim(column_name)) <> 'vec_id' and ({_leak_like})
""")(lambda spark, d: eda.leakage_name_columns(table(spark, d, "embeddings"), "vec_id"))
