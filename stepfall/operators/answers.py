"""Answer records per case: affected users, realised severity, index and task rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfall import constants as K
from stepfall.functions.measures import rate, realised_pp
from stepfall.functions.predicates import checked_predicate
from stepfall.operators.cohorts import cohort_separability
from stepfall.operators.score import case_labels
from stepfall.operators.severity import CRASH, reached
from stepfall.plans.joins import small_side

USER = ["instance_id", "user_id"]


def _cohort(text: str) -> Column:
    if text.startswith("payment_method"):
        return F.expr(checked_predicate(text, ("payment_method",))
                      .replace("payment_method", "pay_method"))
    return F.expr(checked_predicate(text))


def _by_fault(parts: Mapping[str, Column], default: Column) -> Column:
    out = default
    for fault, value in parts.items():
        out = F.when(F.col("fault_type") == fault, value).otherwise(out)
    return out


def _own_cohort(sessions: DataFrame, answers: DataFrame,
                cohorts: Mapping[str, str]) -> DataFrame:
    """Sessions lying in the cohort of their own case's fault."""
    faulty = answers.filter("has_fault").select("instance_id", "fault_type")
    member = _by_fault({f: F.coalesce(_cohort(text), F.lit(False))
                        for f, text in cohorts.items()}, F.lit(False))
    return sessions.join(small_side(faulty), "instance_id").filter(member)


def planted_users(sessions: DataFrame, answers: DataFrame,
                  cohorts: Mapping[str, str]) -> DataFrame:
    """Affected ids of every case, as rows.

    ``cohorts`` maps fault type to predicate text; a user counts when a session of theirs in
    the post period lies in the cohort of their case's fault.  A payment cohort tests the
    session's method, the others the user attributes carried by the session.
    """
    return (
        _own_cohort(sessions, answers, cohorts).filter(F.col("period") == "post")
        .select(*USER).distinct())


def realised_severity(sessions: DataFrame, answers: DataFrame, cohorts: Mapping[str, str], *,
                      vocabulary: Sequence[str] = K.STAGES) -> DataFrame:
    """Realised severity of each case's own fault, all cases in one aggregation.

    0.0 where nothing was planted or a step was not reached in one period; a crash rate without
    sessions counts as zero instead.
    """
    bases, hits = {}, {}
    for fault in cohorts:
        base, hit = reached(K.STEP_OF_FAULT.get(fault, CRASH), vocabulary)
        bases[fault], hits[fault] = F.expr(base), F.expr(hit)
    base, hit = _by_fault(bases, F.lit(False)), _by_fault(hits, F.lit(False))
    counts = [F.count_if((F.col("period") == p) & c).alias(f"{kind}_{p}")
              for p in ("pre", "post") for kind, c in (("n", base), ("k", hit))]
    pre, post = (rate(F.col(f"k_{p}"), F.col(f"n_{p}")) for p in ("pre", "post"))
    zero = F.lit(0.0)
    rise = F.round(F.lit(100.0) * (F.coalesce(post, zero) - F.coalesce(pre, zero)), 2)
    measured = _own_cohort(sessions, answers, cohorts).groupBy(
        "instance_id", "fault_type").agg(*counts).select(
        "instance_id", F.when(F.col("fault_type").isin(*K.STEP_OF_FAULT), realised_pp(pre, post))
        .otherwise(rise).alias("severity_pp_realised"))
    return answers.select("instance_id").join(measured, "instance_id", "left").withColumn(
        "severity_pp_realised", F.coalesce("severity_pp_realised", zero))


def gold_record(answers: DataFrame, sessions: DataFrame, planted: DataFrame,
                cohorts: Mapping[str, str]) -> DataFrame:
    """Answer header per case.  The ids themselves stay rows (``planted``), see the README.

    ``seed``, ``persona_mix`` and ``notes`` are carried along where the answers have them.
    """
    sized = planted.groupBy("instance_id").agg(F.count("*").alias("n"))
    none = F.lit("")
    return (
        case_labels(answers)
        .join(realised_severity(sessions, answers, cohorts), "instance_id", "left")
        .join(sized, "instance_id", "left")
        .select(
            "instance_id", "has_fault", "fault_type",
            F.coalesce("n", F.lit(0)).cast("bigint").alias("n_affected"),
            F.when(F.col("has_fault"), F.col("affected_cohort_predicate")).otherwise(none)
            .alias("affected_cohort_predicate"),
            "severity_pp_target", "severity_pp_realised", "confounder_type",
            "is_confounder_trap", "is_simpson", "decoy_screens", "acceptable_mechanisms",
            "changepoint_day",
            *[c for c in ("seed", "persona_mix", "notes") if c in answers.columns]))


def answer_index(gold: DataFrame, users: DataFrame, planted: DataFrame) -> DataFrame:
    """Hidden index: header numbers plus how well one visible column describes the cohort."""
    best = cohort_separability(users, planted).select(
        "instance_id", F.col("product").alias("worst_single_col_leak"))
    return gold.join(best, "instance_id", "left").select(
        "instance_id", "fault_type", "has_fault", "severity_pp_target", "severity_pp_realised",
        "is_confounder_trap", "is_simpson", "n_affected",
        F.coalesce("worst_single_col_leak", F.lit(0.0)).alias("worst_single_col_leak"))


def public_index(cases: DataFrame) -> DataFrame:
    """What a solver may see of the case list."""
    return cases.select("instance_id")


def task_records(cases: DataFrame, question: Column | None = None) -> DataFrame:
    """One neutral task row per case: window, changepoint, funnel, allowed columns."""
    text = question if question is not None else F.concat(
        F.lit("Which change explains the conversion of days "), F.col("changepoint_day"),
        F.lit(" to "), F.col("window_days") - 1, F.lit(" against the days before?"))
    return cases.select(
        "instance_id", text.alias("question"),
        F.lit(" > ".join(K.STAGES)).alias("funnel"), "window_days", "changepoint_day",
        F.array(*map(F.lit, K.USER_ATTRIBUTES)).alias("cohort_whitelist_columns"),
        F.lit("ranked hypotheses").alias("output_contract"))
