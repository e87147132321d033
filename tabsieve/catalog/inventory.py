"""Registered rule, issue-inventory and profile queries (A28, A30, I11, I12,
S7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.operators import issues, quality
from tabsieve.operators.rules import ValidationRule, evaluate_rules
from tabsieve.registry import register
from tabsieve.sources.derived import LEDGER_SQL, dirty_customer, ledger, table
from tabsieve.sources.tables import evidence_fingerprint
from tabsieve.sqlkit import DIRTY_CTE, MARKERS_SQL, to_number_sql, to_timestamp_sql

# Rules declared on lineitem joined with its order (A28 / I11 inputs).
LINEITEM_RULES: tuple[ValidationRule, ...] = (
    ValidationRule("discount_range", "numeric_range", "invalid_value", "l_discount",
                   "discount between 0 and 0.08", "pricing policy", min_value=0.0, max_value=0.08),
    ValidationRule("quantity_range", "numeric_range", "invalid_value", "l_quantity",
                   "quantity between 1 and 45", "order desk", min_value=1.0, max_value=45.0),
    ValidationRule("returnflag_allowed", "allowed_values", "business_rule_violation", "l_returnflag",
                   "return flag A or N", "returns team", allowed_values=("A", "N")),
    ValidationRule("ship_after_order", "column_comparison", "business_rule_violation", "o_orderdate",
                   "order date on or before ship date", "logistics", comparison_column="l_shipdate",
                   comparison_operator="<="),
    ValidationRule("tax_below_discount", "column_comparison", "business_rule_violation", "l_tax",
                   "tax lower than discount", "finance", comparison_column="l_discount",
                   comparison_operator="<"),
)

# Rules declared on the dirty customer view.
CUSTOMER_RULES: tuple[ValidationRule, ...] = (
    ValidationRule("acctbal_range", "numeric_range", "invalid_value", "acctbal",
                   "balance within the ledger range", "finance", min_value=-999.99, max_value=9999.99),
    ValidationRule("segment_allowed", "allowed_values", "business_rule_violation", "segment",
                   "known market segment", "sales",
                   allowed_values=("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")),
    ValidationRule("target_not_above_key", "column_comparison", "business_rule_violation", "target",
                   "target never exceeds the key", "modeling", comparison_column="c_custkey",
                   comparison_operator="<="),
)

LINEITEM_ORDERS_SQL = """
select l.l_orderkey, l.l_discount, l.l_quantity, l.l_returnflag, l.l_shipdate, l.l_tax, o.o_orderdate
from lineitem l join orders o on l.l_orderkey = o.o_orderkey
"""


def lineitem_orders(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_discount", "l_quantity", "l_returnflag",
                                            "l_shipdate", "l_tax")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    # Both sides grow with the data: a shuffle join chosen by Catalyst / AQE.
    return li.join(o, "l_orderkey")


# --- SQL twins of the rules ---------------------------------------------------

def _missing(c: str, kind: str) -> str:
    if kind == "text":
        return f"({c} is null or lower(trim({c})) in {MARKERS_SQL})"
    if kind == "float":
        return f"({c} is null or isnan({c}))"
    return f"({c} is null)"


def rule_sql(rule: ValidationRule, kinds: dict[str, str]) -> tuple[str, str]:
    """(eligible, violated) SQL predicates for one rule."""
    c = rule.column
    eligible = f"not {_missing(c, kinds[c])}"
    if rule.rule_type == "numeric_range":
        parts = []
        if rule.min_value is not None:
            parts.append(f"{c} < {rule.min_value!r}")
        if rule.max_value is not None:
            parts.append(f"{c} > {rule.max_value!r}")
        return eligible, "(" + " or ".join(parts) + ")"
    if rule.rule_type == "allowed_values":
        vals = ", ".join("'" + v.replace("'", "''") + "'" for v in rule.allowed_values)
        return eligible, f"({c} not in ({vals}))"
    o = rule.comparison_column
    op = "=" if rule.comparison_operator == "==" else rule.comparison_operator
    return f"{eligible} and not {_missing(o, kinds[o])}", f"(not ({c} {op} {o}))"


def rules_sql(tab: str, rules: Sequence[ValidationRule], kinds: dict[str, str]) -> str:
    parts = []
    for r in rules:
        el, vi = rule_sql(r, kinds)
        parts.append(f"select '{r.rule_id}' as rule_id, count(*) filter (where {el}) as checked_count, "
                     f"count(*) filter (where {el} and coalesce({vi}, false)) as violation_count from {tab}")
    return "\n union all ".join(parts)


LINEITEM_ORDERS_KINDS = {"l_discount": "float", "l_quantity": "float", "l_returnflag": "text",
                         "o_orderdate": "ts", "l_shipdate": "ts", "l_tax": "float"}

register("rule_results", f"""
with lo as ({LINEITEM_ORDERS_SQL}) {rules_sql('lo', LINEITEM_RULES, LINEITEM_ORDERS_KINDS)}
""")(lambda spark, d: evaluate_rules(lineitem_orders(spark, d), LINEITEM_RULES))


def _issue_projection(df: DataFrame) -> DataFrame:
    """Issue rows without evidence, which ``evidence_fingerprint`` compares."""
    return df.select("issue_id", "issue_type", "column",
                     F.array_join("allowed_treatments", ",").alias("allowed_treatments"),
                     "requires_explicit_human_decision")


RULE_TREATMENTS_TXT = "set_missing,drop_rows,retain,investigate"


def rule_issues_sql(tab: str, rules: Sequence[ValidationRule], kinds: dict[str, str], full: bool = False) -> str:
    meta = "\n union all ".join(
        f"select '{r.rule_id}' as rule_id, '{r.issue_type}' as issue_type, '{r.column}' as col, "
        f"'{r.description.replace(chr(39), 2 * chr(39))}' as description, '{r.source}' as source, {i} as i"
        for i, r in enumerate(rules))
    more = (""", 'violations=' || violation_count || '; checked=' || checked_count || '; rule=' || description
 || '; source=' || source as evidence, 1100000 + i as ordinal""" if full else "")
    return f"""select 'rule:' || r.rule_id as issue_id, m.issue_type, m.col as "column",
 '{RULE_TREATMENTS_TXT}' as allowed_treatments, true as requires_explicit_human_decision{more}
from ({rules_sql(tab, rules, kinds)}) r join ({meta}) m using (rule_id) where r.violation_count > 0"""


register("rule_issues", f"""
with lo as ({LINEITEM_ORDERS_SQL}) {rule_issues_sql('lo', LINEITEM_RULES, LINEITEM_ORDERS_KINDS)}
""")(lambda spark, d: _issue_projection(issues.validation_rule_issues(lineitem_orders(spark, d), LINEITEM_RULES)))

# --- issue inventory on the dirty customer view --------------------------------

DIRTY_KINDS = {"c_custkey": "int", "segment": "text", "acctbal": "float", "nation_txt": "text", "target": "int"}


SHOWN = 'issue_id, issue_type, "column", allowed_treatments, requires_explicit_human_decision'


def inventory_sql(tab: str, kinds: dict[str, str], rules: Sequence[ValidationRule]) -> str:
    return f"select {SHOWN} from ({issues_sql(tab, kinds, rules)})"


def _metrics_sql(**values: str) -> str:
    return " || '; ' || ".join(f"'{name}=' || {value}" for name, value in values.items())


def issues_sql(tab: str, kinds: dict[str, str], rules: Sequence[ValidationRule]) -> str:
    """All issues with evidence and ordinal."""
    text = [c for c, k in kinds.items() if k == "text"]
    numeric = [c for c, k in kinds.items() if k in ("int", "float")]
    cols = list(kinds)
    parts = []

    def row(issue_type: str, col: str | None, allowed: str, human: bool, cond: str, detector: int,
            evidence: str, stats: str) -> str:
        ordinal = detector * 100000 + (cols.index(col) if col else 0)
        iid = f"'{issue_type}:{col if col else 'dataset'}'"
        colv = f"'{col}'" if col else "cast(null as varchar)"
        return (f"select {iid} as issue_id, '{issue_type}' as issue_type, {colv} as \"column\", "
                f"'{allowed}' as allowed_treatments, {str(human).lower()} as requires_explicit_human_decision, "
                f"{evidence} as evidence, {ordinal} as ordinal from ({stats}) where {cond}")

    for c in cols:  # I1
        floating = f" or isnan({c})" if kinds[c] == "float" else ""
        allowed = "median,mean,mode,drop_rows,retain" if c in numeric else "mode,constant,drop_rows,retain"
        parts.append(row("missing_values", c, allowed, False, "k > 0", 1, _metrics_sql(missing="k"),
                         f"select count(*) as k from {tab} where {c} is null{floating}"))
    for c in text:  # I2
        parts.append(row("fake_nulls", c, "normalize_nulls,retain", True, "k > 0", 2, _metrics_sql(null_markers="k"),
                         f"select count(*) as k from {tab} where {c} is not null and lower(trim({c})) in {MARKERS_SQL}"))
    for c in text:  # I3
        parts.append(row("categorical_inconsistency", c, "normalize_categories,retain", False, "k > 0", 3,
                         _metrics_sql(groups="k", spellings="s"),
                         f"select count(*) as k, sum(d) as s from (select count(distinct {c}) as d from {tab} "
                         f"where {c} is not null and lower(trim({c})) not in {MARKERS_SQL} "
                         f"group by lower(trim({c})) having count(distinct {c}) > 1)"))
    for c in text:  # I4
        kept = f"case when trim({c}) <> '' then trim({c}) end"
        parts.append(row("date_conversion", c, "convert_date,retain", False, "n > 0 and m / n < 0.8 and k / n >= 0.8", 4,
                         _metrics_sql(dates="k", values="n"),
                         f"select count({kept}) as n, count({to_number_sql(kept)}) as m, "
                         f"count({to_timestamp_sql(kept)}) as k from {tab}"))
    for c in text:  # I5
        parts.append(row("numeric_conversion", c, "convert_numeric,retain", False, "n > 0 and k / n >= 0.8", 5,
                         _metrics_sql(numbers="k", values="n"),
                         f"select count({c}) as n, count({to_number_sql(c)}) as k from {tab}"))
    for c in numeric:  # I6
        v = f"cast({c} as double)"
        parts.append(row("outlier", c, "cap_outliers,retain,investigate", True, "k > 0", 6,
                         _metrics_sql(outside="k", lower="cast(lo as decimal(38,6))", upper="cast(hi as decimal(38,6))"),
                         f"select count(*) as k, any_value(lo) as lo, any_value(hi) as hi from {tab}, "
                         f"(select q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from "
                         f"(select quantile_cont({v}, 0.25) as q1, quantile_cont({v}, 0.75) as q3 from {tab})) b "
                         f"where {v} < lo or {v} > hi"))
    for c in text:  # I7
        parts.append(row("formatting_issue", c, "trim_whitespace,retain", False, "k > 0", 7,
                         _metrics_sql(edge_whitespace="k"), f"select count(*) as k from {tab} where {c} <> trim({c})"))
    for c in cols:  # I8
        stats = (f"select count({c}) as nn, count(distinct {c}) as nd, "
                 f"(select coalesce(max(k), 0) from (select count(*) as k from {tab} where {c} is not null group by {c})) as top "
                 f"from {tab}")
        evidence = _metrics_sql(distinct="nd", values="nn", top="top")
        parts.append(row("constant_feature", c, "exclude_feature,retain", True, "nn > 0 and nd = 1", 8, evidence, stats))
        parts.append(row("near_constant_feature", c, "exclude_feature,retain,investigate", True,
                         "nn >= 20 and nd > 1 and top / nn >= 0.95", 8, evidence, stats))
    all_cols = ", ".join(cols)  # I9
    parts.append(row("exact_duplicates", None, "remove_duplicates,retain", False, "s > 0", 9,
                     _metrics_sql(repeated_rows="s"),
                     f"select coalesce(sum(k - 1), 0)::bigint as s from (select count(*) as k from {tab} group by {all_cols})"))
    for c in text:  # I10
        parts.append(row("identifier", c, "exclude_feature,retain,investigate", True, "nn >= 20 and nd / nn >= 0.95", 10,
                         _metrics_sql(distinct="nd", values="nn"),
                         f"select count({c}) as nn, count(distinct {c}) as nd from {tab}"))
    body = "\n union all ".join(parts)
    if rules:
        body += "\n union all " + rule_issues_sql(tab, rules, kinds, full=True)
    return body


register("issue_inventory", f"""
with {DIRTY_CTE} {inventory_sql('dirty_customer', DIRTY_KINDS, CUSTOMER_RULES)}
""")(lambda spark, d: _issue_projection(issues.issue_inventory(dirty_customer(spark, d), CUSTOMER_RULES)))

register("evidence_fingerprint", f"""
with {DIRTY_CTE}, inv as ({issues_sql('dirty_customer', DIRTY_KINDS, CUSTOMER_RULES)}),
lines as (select issue_id, to_json({{'allowed_treatments': string_split(allowed_treatments, ','), 'column': "column",
 'evidence': evidence, 'issue_id': issue_id, 'issue_type': issue_type, 'ordinal': ordinal,
 'requires_explicit_human_decision': requires_explicit_human_decision}})::varchar as line from inv)
select sha256(string_agg(line, chr(10) order by issue_id)) as fingerprint, count(*) as issue_count from lines
""")(
    lambda spark, d: evidence_fingerprint(issues.issue_inventory(dirty_customer(spark, d), CUSTOMER_RULES)))

# --- A30 -------------------------------------------------------------------------


def headline_sql(tab: str, kinds: dict[str, str]) -> str:
    text = [c for c, k in kinds.items() if k == "text"]
    numeric = [c for c, k in kinds.items() if k in ("int", "float")]
    cols = list(kinds)
    missing = "\n union all ".join(
        f"select '{c}' as col, count(*) filter (where {_missing(c, kinds[c])}) as n from {tab}" for c in cols)
    numlike = "\n union all ".join(
        f"select '{c}' as col, count({to_number_sql(c)}) as k, count({c}) as nn from {tab}" for c in text)
    variants = "\n union all ".join(
        f"select '{c}' as col, lower(trim({c})) as g, count(distinct {c}) as sp from {tab} "
        f"where {c} is not null and lower(trim({c})) not in {MARKERS_SQL} group by 2" for c in text)
    ws = "\n union all ".join(
        f"select '{c}' as col, count(*) filter (where {c} <> trim({c})) as n from {tab}" for c in text)
    formats = "\n union all ".join(
        f"select (select count(*) from {tab} where {c} <> trim({c})) + (select coalesce(sum(k), 0) from (select count(*) as k "
        f"from {tab} where {c} is not null and trim({c}) <> '' group by lower(trim({c})) having count(distinct {c}) > 1)) as n"
        for c in text)
    out = "\n union all ".join(
        f"select '{c}' as col, (select count(*) from {tab}, (select quantile_cont(cast({c} as double), 0.25) as q1, "
        f"quantile_cont(cast({c} as double), 0.75) as q3 from {tab}) b where cast({c} as double) < q1 - 1.5 * (q3 - q1) "
        f"or cast({c} as double) > q3 + 1.5 * (q3 - q1)) as n" for c in numeric)
    all_cols = ", ".join(cols)
    return f"""
select * from (
 select 'missing_or_null_like' as "check", count(*) filter (where n > 0) as affected_columns,
        coalesce(sum(n), 0)::bigint as affected_rows from ({missing})
 union all select 'duplicate_rows', 0, coalesce(sum(k - 1), 0)::bigint
        from (select count(*) as k from {tab} group by {all_cols})
 union all select 'numeric_like_text', count(*), coalesce(sum(k), 0)::bigint
        from ({numlike}) where nn > 0 and k / nn >= 0.8
 union all select 'categorical_inconsistency', count(distinct col), coalesce(sum(sp), 0)::bigint
        from ({variants}) where sp > 1
 union all select 'leading_or_trailing_whitespace', count(*), coalesce(sum(n), 0)::bigint from ({ws}) where n > 0
 union all select 'string_formatting', count(*), coalesce(sum(n), 0)::bigint from ({formats}) where n > 0
 union all select 'iqr_outliers', count(*), coalesce(sum(n), 0)::bigint from ({out}) where n > 0
) where affected_rows > 0
"""


register("profile_headline", f"""
with {DIRTY_CTE} {headline_sql('dirty_customer', DIRTY_KINDS)}
""")(lambda spark, d: quality.profile_headline(dirty_customer(spark, d)))


_q_values = ", ".join("(%d, '%s', '%s')" % (i, t, q.replace("'", "''"))
                      for i, (t, q) in enumerate(issues.PREPARATION_QUESTIONS))
register("preparation_questions", f"""
with {DIRTY_CTE}, inv as ({inventory_sql('dirty_customer', DIRTY_KINDS, CUSTOMER_RULES)}),
q as (select * from (values {_q_values}) t(question_order, issue_type, question))
select question_order, question from q where issue_type in (select issue_type from inv)
""")(lambda spark, d: issues.preparation_questions(issues.issue_inventory(dirty_customer(spark, d), CUSTOMER_RULES)))

DOCUMENT_KINDS = {"doc_id": "int", "text": "text", "lang": "text", "source": "text", "n_chars": "int"}

register("issue_inventory_documents", f"""
{inventory_sql('documents', DOCUMENT_KINDS, ())}
""")(lambda spark, d: _issue_projection(issues.issue_inventory(table(spark, d, "documents"))))

# --- issue inventory on the whole lineitem fact table ----------------------------
# The large-table workload: every detector over all 11 columns of lineitem,
# plus the rules that only read lineitem columns.

LINEITEM_KINDS = {"l_orderkey": "int", "l_partkey": "int", "l_suppkey": "int", "l_linenumber": "int",
                  "l_quantity": "float", "l_extendedprice": "float", "l_discount": "float", "l_tax": "float",
                  "l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "ts"}
LINEITEM_ONLY_RULES = tuple(r for r in LINEITEM_RULES
                            if {r.column, r.comparison_column} <= set(LINEITEM_KINDS) | {None})

register("issue_inventory_lineitem", f"""
{inventory_sql('lineitem', LINEITEM_KINDS, LINEITEM_ONLY_RULES)}
""")(lambda spark, d: _issue_projection(issues.issue_inventory(table(spark, d, "lineitem"), LINEITEM_ONLY_RULES)))

# --- issue inventories in which I4, I8, I9 and I10 find something ----------------

LEDGER_CTE = "ledger as (" + LEDGER_SQL.format(orders="orders") + ")"
LEDGER_KINDS = {"order_ref": "text", "booked_on": "text", "currency": "text", "state": "text", "amount": "float"}
LEDGER_DAY_KINDS = {c: LEDGER_KINDS[c] for c in ("booked_on", "currency", "state")}

register("issue_inventory_ledger", f"""
with {LEDGER_CTE} {inventory_sql('ledger', LEDGER_KINDS, ())}
""")(lambda spark, d: _issue_projection(issues.issue_inventory(ledger(spark, d))))

register("issue_inventory_ledger_days", f"""
with {LEDGER_CTE}, days as (select booked_on, currency, state from ledger) {inventory_sql('days', LEDGER_DAY_KINDS, ())}
""")(lambda spark, d: _issue_projection(issues.issue_inventory(ledger(spark, d).select(*LEDGER_DAY_KINDS))))

# --- A28 with every comparison operator ------------------------------------------

COMPARISON_RULES: tuple[ValidationRule, ...] = tuple(
    ValidationRule(f"tax_{name}_discount", "column_comparison", "business_rule_violation", "l_tax",
                   f"tax {operator} discount", "finance", comparison_column="l_discount",
                   comparison_operator=operator)
    for name, operator in (("below", "<"), ("at_most", "<="), ("above", ">"), ("at_least", ">="),
                           ("equals", "=="), ("differs_from", "!=")))

register("rule_comparisons", f"""
{rules_sql('lineitem', COMPARISON_RULES, LINEITEM_ORDERS_KINDS)}
""")(lambda spark, d: evaluate_rules(table(spark, d, "lineitem"), COMPARISON_RULES))
