"""Reviewed treatment plans: guards, compilation and application
(T10, T11, J1 to J6).

A plan is a small control table (one decision per issue). Checks against
the issue table are real joins (anti joins for unknown and missing
decisions, an inner join for forbidden treatments); the compiled action
list is tiny and ordered on the driver, then folded lazily over the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.operators.prepare import Action, apply_actions
from tabsieve.sources.tables import evidence_fingerprint, fingerprint_value

# --- fixed values -----------------------------------------------------------
# Stable execution priority of compiled operations (lower runs first).
OPERATION_PRIORITY = {"normalize_nulls": 0, "trim_whitespace": 1, "normalize_categories": 2, "impute_missing": 3}
DEFAULT_PRIORITY = 4
UNRESOLVED_TREATMENTS = ("retain", "investigate")
# Treatments with a direct operation (same name).
DIRECT_TREATMENTS = ("remove_duplicates", "drop_rows", "normalize_nulls", "normalize_categories",
                     "trim_whitespace", "exclude_feature")
# Treatments declared in the vocabulary and executed by our extensions.
EXTENSION_TREATMENTS = ("convert_numeric", "convert_date", "cap_outliers", "set_missing", "constant")
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class TreatmentDecision:
    issue_id: str
    treatment: str
    rationale: str


@dataclass
class TreatmentPlan:
    dataset_fingerprint: str
    evidence_fingerprint: str
    reviewer: str
    decisions: list[TreatmentDecision] = field(default_factory=list)
    constants: dict[str, object] = field(default_factory=dict)


class PlanValidationError(ValueError):
    pass


def decisions_frame(spark, decisions: Sequence[TreatmentDecision]) -> DataFrame:
    return spark.createDataFrame([(d.issue_id, d.treatment, d.rationale, i) for i, d in enumerate(decisions)],
                                 "issue_id string, treatment string, rationale string, decision_order int")


def plan_violations(issues: DataFrame, decisions: DataFrame) -> DataFrame:
    """J1 to J4 as rows ``kind, issue_id, treatment``."""
    unknown = decisions.join(issues.select("issue_id"), "issue_id", "left_anti").select(
        F.lit("unknown_decision").alias("kind"), "issue_id", "treatment")
    undecided = issues.select("issue_id").join(decisions, "issue_id", "left_anti").select(
        F.lit("missing_decision").alias("kind"), "issue_id", F.lit(None).cast("string").alias("treatment"))
    forbidden = decisions.join(issues.select("issue_id", "allowed_treatments"), "issue_id").where(
        ~F.array_contains("allowed_treatments", F.col("treatment"))).select(
        F.lit("forbidden_treatment").alias("kind"), "issue_id", "treatment")
    repeated = decisions.groupBy("issue_id").agg(F.count(F.lit(1)).alias("k")).where(
        (F.col("k") > 1) | F.col("issue_id").isNull() | (F.col("issue_id") == "")).select(
        F.lit("duplicate_or_empty_decision").alias("kind"), "issue_id", F.lit(None).cast("string").alias("treatment"))
    unclear = issues.groupBy("issue_id").agg(F.count(F.lit(1)).alias("k")).where(
        (F.col("k") > 1) | F.col("issue_id").isNull() | (F.col("issue_id") == "")).select(
        F.lit("duplicate_or_empty_issue").alias("kind"), "issue_id", F.lit(None).cast("string").alias("treatment"))
    return unknown.unionByName(undecided).unionByName(forbidden).unionByName(repeated).unionByName(unclear)


def validate_plan(df: DataFrame, issues: DataFrame, plan: TreatmentPlan, check_fingerprints: bool = True) -> None:
    """Reviewer and rationales present, fingerprints current, every
    issue decided exactly once with an allowed treatment."""
    if not plan.reviewer or not plan.reviewer.strip():
        raise PlanValidationError("A reviewer is required.")
    for d in plan.decisions:
        if not d.rationale or not d.rationale.strip():
            raise PlanValidationError(f"Decision for '{d.issue_id}' needs a rationale.")
    if check_fingerprints:
        if fingerprint_value(df) != plan.dataset_fingerprint:
            raise PlanValidationError("The dataset changed since the plan was reviewed.")
        if evidence_fingerprint(issues).first()["fingerprint"] != plan.evidence_fingerprint:
            raise PlanValidationError("The issue evidence changed since the plan was reviewed.")
    problems = plan_violations(issues, decisions_frame(df.sparkSession, plan.decisions)).collect()
    if problems:
        text = "; ".join(f"{p['kind']}: {p['issue_id']}" for p in problems)
        raise PlanValidationError(f"Treatment plan is invalid: {text}")


def compile_plan(issues: DataFrame, plan: TreatmentPlan, rules=()) -> list[Action]:
    """Decisions joined to their issues, mapped to actions, stably
    ordered by priority. The joined control table has one row per decision."""
    spark = issues.sparkSession
    dec = decisions_frame(spark, plan.decisions)
    resolved = dec.join(F.broadcast(issues.select("issue_id", "column", "issue_type")), "issue_id") \
        .orderBy("decision_order").collect()
    rule_by_issue = {f"rule:{r.rule_id}": r for r in rules}
    actions: list[Action] = []
    for row in resolved:
        t, col = row["treatment"], row["column"]
        if t in UNRESOLVED_TREATMENTS:
            continue
        if t in ("median", "mean", "mode"):
            if col is None:
                raise ValueError(f"{t.capitalize()} imputation requires an issue column.")
            actions.append(Action("impute_missing", col, t, row["rationale"]))
        elif t == "remove_duplicates":
            actions.append(Action("remove_duplicates", reason=row["rationale"]))
        elif t in DIRECT_TREATMENTS:
            if col is None:
                raise ValueError(f"{t} requires an issue column.")
            actions.append(Action(t, col, reason=row["rationale"]))
        elif t == "constant":
            actions.append(Action("fill_constant", col, reason=row["rationale"], value=plan.constants.get(col)))
        elif t == "set_missing":
            actions.append(Action("set_missing", col, reason=row["rationale"], rule=rule_by_issue[row["issue_id"]]))
        elif t in EXTENSION_TREATMENTS:
            actions.append(Action(t, col, reason=row["rationale"]))
        else:
            raise ValueError(f"Unsupported approved treatment: {t!r}")
    return sorted(actions, key=lambda a: OPERATION_PRIORITY.get(a.operation, DEFAULT_PRIORITY))


def apply_treatment_plan(df: DataFrame, issues: DataFrame, plan: TreatmentPlan, rules=(),
                         order_by: str | None = None, check_fingerprints: bool = True,
                         checkpoint_every: int | None = None) -> DataFrame:
    # The issue table is read by three guards and the compiler; it is small
    # (bounded by columns x detectors), so keep it instead of recomputing it.
    issues = issues.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        validate_plan(df, issues, plan, check_fingerprints)
        actions = compile_plan(issues, plan, rules)
    finally:
        issues.unpersist()
    return apply_actions(df, actions, order_by, checkpoint_every)


def unresolved_issues(issues: DataFrame, decisions: DataFrame) -> DataFrame:
    """Issues whose decision is retain or investigate."""
    return decisions.where(F.col("treatment").isin(*UNRESOLVED_TREATMENTS)).join(issues, "issue_id").select(
        "issue_id", "issue_type", F.coalesce(F.col("column"), F.lit("dataset-wide")).alias("column"),
        "treatment", "evidence", "rationale")
