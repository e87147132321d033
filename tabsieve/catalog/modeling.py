"""Registered modeling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsieve.operators import evaluation, modeling
from tabsieve.registry import register
from tabsieve.sources.derived import (
    LABELED_DOCUMENTS_SQL,
    SCORED_LABELS_SQL,
    UNREADY_CUSTOMER_SQL,
    dirty_customer,
    labeled_documents,
    scored_labels,
    table,
    unready_customer,
)
from tabsieve.sqlkit import DIRTY_CTE, MARKERS_SQL, to_timestamp_sql

SCORED_CTE = "scored as (" + SCORED_LABELS_SQL.format(labels="labels", documents="documents") + ")"

# ---------------------------------------------------------------- A29

register("readiness_check", f"""
with {DIRTY_CTE}, f as (
 select count(*) as rows,
  count(*) filter (where target is null) as invalid_target,
  count(*) filter (where c_custkey is null) as m_key,
  count(*) filter (where segment is null or lower(trim(segment)) in {MARKERS_SQL}) as m_segment,
  count(*) filter (where acctbal is null or isnan(acctbal)) as m_acctbal,
  count(*) filter (where isinf(acctbal)) as i_acctbal,
  count(*) filter (where nation_txt is null or lower(trim(nation_txt)) in {MARKERS_SQL}) as m_nation
 from dirty_customer
), c as (select count(*) as n_classes, min(k) as smallest from (select count(*) as k from dirty_customer
          where target is not null group by target)),
found as (
 select 'error' as severity, 'empty_dataset' as code, cast(null as varchar) as "column", rows as n from f where rows = 0
 union all select 'error', 'invalid_target_values', 'target', invalid_target from f where invalid_target > 0
 union all select 'warning', 'missing_or_blank_values', 'c_custkey', m_key from f where m_key > 0
 union all select 'warning', 'missing_or_blank_values', 'segment', m_segment from f where m_segment > 0
 union all select 'error', 'infinite_values', 'acctbal', i_acctbal from f where i_acctbal > 0
 union all select 'warning', 'missing_or_blank_values', 'acctbal', m_acctbal from f where m_acctbal > 0
 union all select 'warning', 'missing_or_blank_values', 'nation_txt', m_nation from f where m_nation > 0
 union all select 'error', 'not_two_classes', 'target', n_classes from c where n_classes <> 2
 union all select 'error', 'class_too_small', 'target', smallest from c where n_classes = 2 and smallest < 2
)
select * from found
union all select 'status', case when count(*) filter (where severity = 'error') > 0 then 'BLOCK'
 when count(*) filter (where severity = 'warning') > 0 then 'WARNING' else 'PASS' end, null, null from found
""")(lambda spark, d: modeling.readiness_check(dirty_customer(spark, d), "target"))

register("readiness_check_blocked", f"""
with u as ({UNREADY_CUSTOMER_SQL.format(customer="customer")}), f as (
 select count(*) filter (where target is null) as invalid_target,
  count(*) filter (where isinf(acctbal)) as infinite, count(*) filter (where isnan(acctbal)) as nans from u
), found as (
 select 'error' as severity, 'invalid_target_values' as code, 'target' as "column", invalid_target as n from f
  where invalid_target > 0
 union all select 'error', 'infinite_values', 'acctbal', infinite from f where infinite > 0
 union all select 'warning', 'missing_or_blank_values', 'acctbal', nans from f where nans > 0
 union all select 'error', 'not_two_classes', 'target', count(distinct target) from u having count(distinct target) <> 2
)
select * from found union all select 'status', 'BLOCK', null, null from found where severity = 'error' group by severity
""")(lambda spark, d: modeling.readiness_check(unready_customer(spark, d), "target"))

# ---------------------------------------------------------------- M1


def _corr(a: str, b: str) -> str:
    xa = f"case when {b} is not null then {a} end"
    xb = f"case when {a} is not null then {b} end"
    den = f"(stddev_pop({xa}) * stddev_pop({xb}))"
    return f"case when {den} = 0 then null else covar_pop({a}, {b}) / {den} end"


_EV_COLS = ("c_custkey", "segment", "acctbal", "nation_txt")
MODELING_EVIDENCE_SQL = f"""
with {DIRTY_CTE}, card as (
""" + "\n union all ".join(
    f"select '{c}' as col, count({c}) as nn, count(distinct {c}) as nd, "
    f"count(*) filter (where {c} is null{' or isnan(' + c + ')' if c == 'acctbal' else ''}) as nm from dirty_customer"
    for c in _EV_COLS) + f"""
), dates as (
""" + "\n union all ".join(
    f"select '{c}' as col, count({c}) as nn, count({to_timestamp_sql(c)}) as nd from dirty_customer"
    for c in ("segment", "nation_txt")) + f"""
)
select 'numeric_feature' as kind, 'c_custkey' as "column", cast(null as double) as value
union all select 'numeric_feature', 'acctbal', null
union all select 'categorical_feature', 'segment', null
union all select 'categorical_feature', 'nation_txt', null
union all select 'constant_feature', col, nd from card where nd <= 1
union all select 'identifier_feature', col, nd / nn from card where nn >= 1 and nd / nn >= 0.95
union all select 'missing_feature', col, nm from card where nm > 0
union all select 'date_candidate', col, nd / nn from dates where nn > 0 and nd / nn >= 0.8
union all select * from (
 select 'numeric_target_relationship', 'c_custkey', {_corr('c_custkey', 'target')} as r from dirty_customer
 union all select 'numeric_target_relationship', 'acctbal', {_corr('acctbal', 'target')} from dirty_customer
) where r is not null and (select min(target) < max(target) from dirty_customer)
"""
register("modeling_evidence", MODELING_EVIDENCE_SQL)(lambda spark, d: modeling.modeling_evidence(dirty_customer(spark, d), "target"))

# ---------------------------------------------------------------- M4

register("stratified_split", """
with c as (select quality as y, count(*) as n from labels group by 1),
t as (select ceil(0.2 * sum(n))::bigint as total, sum(n) as n_all from c),
a as (select y, n, total * n / n_all as exact, floor(total * n / n_all)::bigint as base, total from c, t),
ta as (select y, n, base + case when row_number() over (order by exact - base desc, y)
         <= total - sum(base) over () then 1 else 0 end as test_q from a),
r as (select y, n - test_q as rest, test_q from ta),
vt as (select ceil(0.25 * sum(rest))::bigint as total, sum(rest) as n_all from r),
va as (select y, rest, test_q, total * rest / n_all as exact, floor(total * rest / n_all)::bigint as base, total
       from r, vt),
q as (select y, test_q, base + case when row_number() over (order by exact - base desc, y)
         <= total - sum(base) over () then 1 else 0 end as val_q, rest from va)
select 'test' as split, y as quality, test_q as n from q
union all select 'validation', y, val_q from q
union all select 'train', y, rest - val_q from q
""")(lambda spark, d: modeling.stratified_split(table(spark, d, "labels"), "quality", ["doc_id"])
     .groupBy("split", "quality").agg(F.count(F.lit(1)).alias("n")))

# ---------------------------------------------------------------- M9 to M12, M14, M16

GROUPED = "g as (select score, count(*) filter (where label = 1) as pos, count(*) filter (where label = 0) as neg " \
          "from scored group by score)"


def metrics_sql(pred: str, score: str = "score", source: str = "scored", variant: str = "default_threshold") -> str:
    """One row: variant + accuracy, precision, recall, f1, roc_auc."""
    return f"""(select '{variant}' as variant,
  coalesce((tp + tn) / nullif(n, 0), 0.0) as accuracy, coalesce(tp / nullif(tp + fp, 0), 0.0) as "precision",
  coalesce(tp / nullif(tp + fn, 0), 0.0) as recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) as f1,
  (select sum(pos * (coalesce(neg_below, 0) + neg / 2.0)) / (sum(pos) * sum(neg)) from (
     select pos, neg, sum(neg) over (order by s rows between unbounded preceding and 1 preceding) as neg_below
     from (select {score} as s, count(*) filter (where label = 1) as pos, count(*) filter (where label = 0) as neg
           from {source} group by 1))) as roc_auc
 from (select count(*)::double as n,
   count(*) filter (where label = 1 and {pred} = 1)::double as tp, count(*) filter (where label = 0 and {pred} = 1)::double as fp,
   count(*) filter (where label = 1 and {pred} = 0)::double as fn, count(*) filter (where label = 0 and {pred} = 0)::double as tn
   from {source}))"""


THRESHOLD_CTES = f"""{GROUPED},
c as (select score, pos, neg,
  sum(pos) over (order by score desc rows between unbounded preceding and current row) as tp,
  sum(pos + neg) over (order by score desc rows between unbounded preceding and current row) as pp,
  sum(pos) over () as p from g)"""
THRESHOLD_SELECT = """select score as threshold, coalesce(2 * tp / nullif(pp + p, 0), 0.0)::double as validation_f1
from c order by validation_f1 desc, score desc limit 1"""
THRESHOLD_SQL = f"with {SCORED_CTE}, {THRESHOLD_CTES} {THRESHOLD_SELECT}"

register("threshold_f1", THRESHOLD_SQL)(lambda spark, d: evaluation.select_threshold(scored_labels(spark, d),
                                                                                   "label", "score"))

register("confusion_metrics", f"""
with {SCORED_CTE} select * from {metrics_sql('case when score >= 0.5 then 1 else 0 end')}
""")(lambda spark, d: evaluation.classification_metrics(scored_labels(spark, d), "label", "score", threshold=0.5))

register("roc_auc", f"""
with {SCORED_CTE} select roc_auc from {metrics_sql('0')}
""")(lambda spark, d: evaluation.roc_auc(scored_labels(spark, d), "label", "score"))

MAJORITY_SQL = "(select y from (select label as y, count(*) as n from scored group by 1) order by n desc, y limit 1)"

register("majority_baseline", f"""
with {SCORED_CTE}, b as (select label, cast({MAJORITY_SQL} as double) as bscore,
  {MAJORITY_SQL} as bpred from scored)
select m.*, {MAJORITY_SQL} as majority_class from {metrics_sql('bpred', 'bscore', 'b', 'baseline')} m
""")(lambda spark, d: evaluation.baseline_metrics(scored_labels(spark, d), scored_labels(spark, d), "label"))


def _three_variants(spark, d):
    s = scored_labels(spark, d)
    t = evaluation.select_threshold(s, "label", "score").first()["threshold"]
    return (evaluation.classification_metrics(s, "label", "score", threshold=0.5, variant="default_threshold")
            .unionByName(evaluation.classification_metrics(s, "label", "score", threshold=t,
                                                           variant="selected_threshold"))
            .unionByName(evaluation.baseline_metrics(s, s, "label").drop("majority_class")))


THREE_SQL = f"""
with {SCORED_CTE}, {THRESHOLD_CTES}, t as ({THRESHOLD_SELECT}),
b as (select label, cast({MAJORITY_SQL} as double) as bscore, {MAJORITY_SQL} as bpred from scored),
m as (
 select * from {metrics_sql('case when score >= 0.5 then 1 else 0 end')}
 union all select * from {metrics_sql('case when score >= (select threshold from t) then 1 else 0 end', variant='selected_threshold')}
 union all select * from {metrics_sql('bpred', 'bscore', 'b', 'baseline')}
)"""

register("evaluation_flags", THREE_SQL + """
select variant, recall < 0.5 as low_recall,
 accuracy <= (select accuracy from m where variant = 'baseline') as not_better_than_baseline
from m where variant <> 'baseline'
""")(lambda spark, d: evaluation.evaluation_flags(_three_variants(spark, d)))

register("metric_comparison", THREE_SQL + """
, l as (
 select variant, 'accuracy' as metric, accuracy as value from m
 union all select variant, 'precision', "precision" from m
 union all select variant, 'recall', recall from m
 union all select variant, 'f1', f1 from m
 union all select variant, 'roc_auc', roc_auc from m)
select metric, max(value) filter (where variant = 'default_threshold') as default_threshold,
 max(value) filter (where variant = 'selected_threshold') as selected_threshold,
 max(value) filter (where variant = 'baseline') as baseline
from l group by metric
""")(lambda spark, d: evaluation.metric_comparison(_three_variants(spark, d)))

# ---------------------------------------------------------------- M5 to M8, M13, M15 (rows-only checks)

TRAIN_FEATURES = ["n_chars", "lang", "source"]


def _train(model: str):
    def run(spark, d):
        res = modeling.train_evaluate(labeled_documents(spark, d), "quality", model, TRAIN_FEATURES, ["doc_id"])
        return res.metrics
    return run


def _fitted(spark, d):
    return modeling.Preprocessor(["n_chars"], ["lang", "source"]).fit(labeled_documents(spark, d)).statistics(spark)


_LABELED_CTE = "ld as (" + LABELED_DOCUMENTS_SQL.format(labels="labels", documents="documents") + ")"
_PREPARED_SQL = f"""{_LABELED_CTE}, med as (select quantile_cont(n_chars::double, 0.5) as m from ld),
x as (select coalesce(n_chars::double, m) as v from ld, med),
levels as (select col, value, count(*) as n from (
 select 'lang' as col, lang as value from ld union all select 'source', source from ld)
 where value is not null and lower(trim(value)) not in {MARKERS_SQL} group by all)"""
register("preprocessor_statistics", f"""
with {_PREPARED_SQL}
select 'n_chars' as "column", 'median' as statistic, m as number, cast(null as varchar) as text from med
union all select 'n_chars', 'mean', avg(v), null from x
union all select 'n_chars', 'std', stddev_pop(v), null from x
union all select col, 'mode', null, arg_min(value, (-n, value)) from levels group by col
union all select col, 'levels', count(*), null from levels group by col
""")(_fitted)
register("preprocessor_positions", f"""
with {_PREPARED_SQL}
select col as "column", value, cast(row_number() over (partition by col order by value) - 1 as double) as position from levels
""")(lambda spark, d: modeling.Preprocessor(["n_chars"], ["lang", "source"]).fit(labeled_documents(spark, d)).positions)

# class quotas: largest remainders of ceil(0.2 n) and of ceil(0.25 rest); totals need no classes
register("training_record", f"""
with {_LABELED_CTE}, n as (select count(*) as n, ceil(0.2 * count(*))::bigint as test_rows from ld),
v as (select *, ceil(0.25 * (n - test_rows))::bigint as validation_rows from n)
select 'Logistic Regression' as model, 'quality' as target, 'n_chars,lang,source' as features, 'doc_id' as excluded,
 n - test_rows as train_rows, test_rows, validation_rows from v
""")(lambda spark, d: modeling.train_evaluate(
    labeled_documents(spark, d), "quality", "Logistic Regression", TRAIN_FEATURES, ["doc_id"]).record.select(
    "model", "target", F.array_join("features", ",").alias("features"), F.array_join("excluded", ",").alias("excluded"),
    "train_rows", "test_rows", "validation_rows"))

# requests with something wrong, judged by names or by data
FLAWED_REQUESTS = (
    ("many faults", "quality", "Decision Tree", ("lang", "lang", "quality", "nowhere")),
    ("no features", "missing", "Random Forest", ()),
    ("three classes", "doc_kind", "Random Forest", ("n_chars",)),
    ("text target", "yes_no", "Random Forest", ("n_chars",)),
    ("sound", "quality", "Random Forest", ("n_chars", "lang")),
)


def _training_problems(spark, d):
    df = labeled_documents(spark, d).withColumn("doc_kind", F.col("doc_id") % 3).withColumn(
        "yes_no", F.when(F.col("quality") == 1, "yes").otherwise("no"))
    rows = [(name, p) for name, target, model, features in FLAWED_REQUESTS
            for p in modeling.training_problems(df, target, model, list(features))]
    return spark.createDataFrame(rows, "request string, problem string")


register("training_problems", f"""
with {_LABELED_CTE}, kinds as (select count(distinct doc_id % 3) as k from ld),
other as (select count(*) as k from ld where quality not in (0, 1))
select 'many faults' as request, unnest(['model_not_supported:Decision Tree', 'feature_repeated:lang',
 'feature_is_target:quality', 'feature_not_found:nowhere']) as problem
union all select 'no features', unnest(['target_not_found:missing', 'features_empty:'])
union all select 'three classes', 'not_ready:not_two_classes:doc_kind' from kinds where k <> 2
union all select 'text target', 'target_not_binary:yes_no' where (select count(*) from ld) > 0
union all select 'sound', 'target_not_binary:quality' from other where k > 0
""")(_training_problems)

_DOC_LEVELS = " union all ".join(f"select '{c}' as col, {c} as value, quality as y from ld" for c in ("lang", "source"))
register("target_evidence", f"""
with {_LABELED_CTE}
select 'target_missing' as kind, 'quality' as "column", cast(null as varchar) as category,
 cast(null as varchar) as target_value, count(*) - count(quality) as n, cast(null as double) as value from ld
union all select 'target_distinct', 'quality', null, null, count(distinct quality), null from ld
union all select 'target_value', 'quality', null, cast(quality as varchar), count(*), null from ld
 where quality is not null group by quality
union all select 'category_target', col, value, null, count(y), avg(y::double) from ({_DOC_LEVELS}) group by col, value
""")(lambda spark, d: modeling.target_evidence(labeled_documents(spark, d), "quality"))
register("target_evidence_text", f"""
with {_LABELED_CTE}, c as (select source as value, lang as y, count(*) as n from ld where lang is not null group by all)
select 'target_missing' as kind, 'lang' as "column", cast(null as varchar) as category,
 cast(null as varchar) as target_value, count(*) - count(lang) as n, cast(null as double) as value from ld
union all select 'target_distinct', 'lang', null, null, count(distinct lang), null from ld
union all select 'target_value', 'lang', null, lang, count(*), null from ld where lang is not null group by lang
union all select 'category_target_value', 'source', value, y, n, null from c
 qualify row_number() over (partition by value order by n desc, y) <= 20
""")(lambda spark, d: modeling.target_evidence(labeled_documents(spark, d), "lang"))

register("train_lr")(_train("Logistic Regression"))
register("train_rf")(_train("Random Forest"))
register("train_evaluate")(lambda spark, d: modeling.train_evaluate(
    labeled_documents(spark, d), "quality", "Logistic Regression", TRAIN_FEATURES, ["doc_id"]).record)


_mq_values = ", ".join("(%d, '%s', '%s')" % (i, k, q.replace("'", "''"))
                       for i, (k, q) in enumerate(modeling.MODELING_QUESTIONS))
register("modeling_questions", f"""
with ev as ({MODELING_EVIDENCE_SQL.strip()}),
{DIRTY_CTE.replace('dirty_customer as', 'dc as')},
tk as (select 'target_missing' as kind where (select count(*) filter (where target is null) from dc) > 0
       union all select 'target_single_value' where (select count(distinct target) from dc) <= 1),
q as (select * from (values {_mq_values}) t(question_order, kind, question))
select question_order, question from q where kind in (select kind from ev union all select kind from tk)
""")(lambda spark, d: modeling.modeling_questions(dirty_customer(spark, d), "target"))
