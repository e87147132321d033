"""Registered repair queries (R1 to R8) on the dirty account view."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabsieve.operators import repair
from tabsieve.registry import register
from tabsieve.sources.derived import DIRTY_ACCOUNTS_SQL, dirty_accounts
from tabsieve.sqlkit import to_number_sql

ACCOUNTS_CTE = "accounts as (" + DIRTY_ACCOUNTS_SQL.format(orders="orders") + ")"

MONTHLY_SQL = "cast(replace(trim(monthly_charge), '£', '') as double)"
DATE_SQL = ("coalesce(try_strptime(trim(signup_date), '%Y-%m-%d'), try_strptime(trim(signup_date), '%d/%m/%Y'), "
            "try_strptime(trim(signup_date), '%d-%b-%Y'), try_strptime(trim(signup_date), '%Y/%m/%d'))")
AGE_NUM = to_number_sql("age")
INVALID_AGE = f"({AGE_NUM} is null or {AGE_NUM} < 18 or {AGE_NUM} > 110)"
MEDIAN_SQL = f"(select quantile_cont({AGE_NUM}, 0.5) from accounts where not {INVALID_AGE})"
AGE_SQL = f"case when {INVALID_AGE} then {MEDIAN_SQL} else {AGE_NUM} end"
_AGE_R = to_number_sql("cast(age as varchar)")
INVALID_AGE_R = f"({_AGE_R} is null or {_AGE_R} < 18 or {_AGE_R} > 110)"
TOTAL_SQL = f"case when total_charge > 20000 then {MONTHLY_SQL} * tenure_months else total_charge end"

register("currency_to_number", f"""
with {ACCOUNTS_CTE} select customer_id, {MONTHLY_SQL} as monthly_charge from accounts
""")(lambda spark, d: dirty_accounts(spark, d).select("customer_id",
                                                     repair.currency_to_number("monthly_charge").alias("monthly_charge")))

register("multi_date", f"""
with {ACCOUNTS_CTE} select customer_id, strftime({DATE_SQL}, '%Y-%m-%d') as signup_date from accounts
""")(lambda spark, d: dirty_accounts(spark, d).select("customer_id",
                                                     repair.normalized_date_text("signup_date").alias("signup_date")))


def _median_repair(spark, d):
    df = dirty_accounts(spark, d)
    m = repair.valid_age_median(df)
    return df.select("customer_id", F.when(repair.invalid_age("age"), F.lit(m))
                     .otherwise(repair.to_number("age")).alias("age"))


register("median_repair", f"""
with {ACCOUNTS_CTE} select customer_id, {AGE_SQL} as age from accounts
""")(_median_repair)

register("derived_repair", f"""
with {ACCOUNTS_CTE} select customer_id, {TOTAL_SQL} as total_charge from accounts
""")(lambda spark, d: dirty_accounts(spark, d).select(
    "customer_id", F.when(F.col("total_charge") > repair.EXTREME_TOTAL,
                          repair.currency_to_number("monthly_charge") * F.col("tenure_months"))
    .otherwise(F.col("total_charge")).alias("total_charge")))

REPAIRED_SQL = f"""select customer_id, account_number, {AGE_SQL} as age, {MONTHLY_SQL} as monthly_charge, tenure_months,
 {TOTAL_SQL} as total_charge, strftime({DATE_SQL}, '%Y-%m-%d') as signup_date, churned from accounts"""

register("repair_transform", f"""
with {ACCOUNTS_CTE} {REPAIRED_SQL}
""")(lambda spark, d: repair.repair_accounts(dirty_accounts(spark, d)).table)


def _invariants(spark, d):
    src = dirty_accounts(spark, d)
    return repair.repair_invariants(src, repair.repair_accounts(src).table)


def _broken_invariants(spark, d):
    """A repair gone wrong in every way the invariants look at; a NaN total is
    missing, not extreme."""
    src = dirty_accounts(spark, d)
    good = repair.repair_accounts(src).table

    def where(n: int, c: str, value) -> Column:
        return F.when(F.col("customer_id") % n == 0, value).otherwise(F.col(c))

    wrong = {
        "tenure_months": where(11, "tenure_months", F.col("tenure_months") + 1),
        "account_number": where(19, "account_number", F.lit(None)),
        "churned": where(23, "churned", 1 - F.col("churned")),
        "age": where(29, "age", F.lit(200)),
        "monthly_charge": where(31, "monthly_charge", F.lit(None)),
        "total_charge": F.when(F.col("customer_id") % 17 == 0, F.lit(float("nan"))).otherwise(
            where(37, "total_charge", F.lit(30000.0))),
        "signup_date": where(41, "signup_date", F.lit("2024-02-30")),
    }
    result = good.where("customer_id % 13 <> 0").select(*[wrong.get(c, F.col(c)).alias(c) for c in good.columns])
    return repair.repair_invariants(src, result)


BROKEN_SQL = """select customer_id, case when customer_id % 19 <> 0 then account_number end as account_number,
 case when customer_id % 29 = 0 then 200 else age end as age,
 case when customer_id % 31 <> 0 then monthly_charge end as monthly_charge,
 case when customer_id % 11 = 0 then tenure_months + 1 else tenure_months end as tenure_months,
 case when customer_id % 17 = 0 then 'nan'::double when customer_id % 37 = 0 then 30000.0 else total_charge end as total_charge,
 case when customer_id % 41 = 0 then '2024-02-30' else signup_date end as signup_date,
 case when customer_id % 23 = 0 then 1 - churned else churned end as churned
from good where customer_id % 13 <> 0"""


INVARIANTS_SQL = f"""
p as (select s.customer_id as sk, r.customer_id as rk, s.account_number as sa, r.account_number as ra,
        s.tenure_months as st, r.tenure_months as rt, s.churned as sc, r.churned as rc
      from accounts s full outer join r on s.customer_id = r.customer_id)
select 'row_count_changed' as invariant, abs((select count(*) from accounts) - (select count(*) from r))::bigint as violations
union all select 'unexpected_columns', 0
union all select 'row_pairing', count(*) filter (where sk is null or rk is null) from p
union all select 'protected_column_changed:account_number', count(*) filter (where sa is distinct from ra) from p
union all select 'unchanged_column_changed:tenure_months', count(*) filter (where st is distinct from rt) from p
union all select 'protected_column_changed:churned', count(*) filter (where sc is distinct from rc) from p
union all select 'duplicate_count_changed', abs(
  (select coalesce(sum(k - 1), 0) from (select count(*) as k from accounts group by customer_id, account_number, age, monthly_charge, tenure_months, total_charge, signup_date, churned, account_closed_date, retention_offer_accepted))
  - (select coalesce(sum(k - 1), 0) from (select count(*) as k from r group by customer_id, account_number, age, monthly_charge, tenure_months, total_charge, signup_date, churned)))::bigint
union all select 'invalid_ages_remain', count(*) filter (where {INVALID_AGE_R}) from r
union all select 'unparseable_charges_remain', count(*) filter (where monthly_charge is null) from r
union all select 'invalid_signup_dates_remain', count(*) filter (where try_strptime(signup_date, '%Y-%m-%d') is null) from r
union all select 'extreme_totals_remain', count(*) filter (where total_charge > 20000 and not isnan(total_charge)) from r
"""

register("invariants", f"with {ACCOUNTS_CTE}, r as ({REPAIRED_SQL}), {INVARIANTS_SQL.strip()}")(_invariants)
register("invariants_broken", f"""
with {ACCOUNTS_CTE}, good as ({REPAIRED_SQL}), r as ({BROKEN_SQL}), {INVARIANTS_SQL.strip()}
""")(_broken_invariants)

register("repair_report", f"""
with {ACCOUNTS_CTE}
select count(*) filter (where {INVALID_AGE}) as invalid_ages_repaired, {MEDIAN_SQL} as age_median,
 count(*) filter (where total_charge > 20000) as extreme_charges_repaired, 2 as leakage_columns_removed
from accounts
""")(lambda spark, d: repair.repair_report(dirty_accounts(spark, d)))
