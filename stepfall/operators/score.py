"""Scoring ranked hypotheses of any number of systems against the answers of all cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfall.constants import F1_FLOOR, INNOCENT
from stepfall.operators.cohorts import (
    attribute_profiles, claim_clauses, claim_counts, expression_matches, match_profiles, profile_prf,
)
from stepfall.plans.joins import small_side

RUN = ["system", "instance_id"]


def claims_of(hypotheses: DataFrame) -> DataFrame:
    """Each distinct predicate of a case once, however many systems claim it."""
    text = F.coalesce("affected_cohort", F.lit(""))
    return hypotheses.select(
        "instance_id", text.alias("claim_id"), text.alias("predicate")).distinct()


def score_claims(claims: DataFrame, users: DataFrame, planted: DataFrame) -> DataFrame:
    """Precision, recall and F1 of every claimed predicate, whatever its text.

    Predicates become clause rows, which meet the profiles in one plan whatever their number.  The few that
    clause rows cannot say are compiled as expressions over the same profiles; their texts are read
    here.  A text that is refused, is no predicate or names other columns is an empty cohort.
    """
    profiles = attribute_profiles(users, planted)
    clauses, beyond = claim_clauses(claims)
    counts = claim_counts(match_profiles(profiles, clauses))
    for more in expression_matches(profiles, claims, beyond):
        counts = counts.unionByName(claim_counts(more))
    return profile_prf(claims, counts, planted)


def judged_hypotheses(hypotheses: DataFrame, gold: DataFrame, claim_scores: DataFrame) -> DataFrame:
    """Hypotheses with the case's answer, mechanism match and claim measures attached."""
    measures = claim_scores.select(
        "instance_id", F.col("claim_id").alias("claim"), "precision", "recall", "f1",
        "n_planted")
    return (
        hypotheses.withColumn("claim", F.coalesce("affected_cohort", F.lit("")))
        .join(small_side(gold.select(
            "instance_id", "has_fault", "fault_type", "acceptable_mechanisms")), "instance_id")
        .join(measures, ["instance_id", "claim"], "left")
        .withColumn("ok", F.array_contains("acceptable_mechanisms", F.col("mechanism_type")))
        .withColumn("hit", F.col("ok") & (F.col("f1") >= F1_FLOOR))
    )


def best_hypothesis(judged: DataFrame) -> DataFrame:
    """First mechanism-matching hypothesis per run, else the top one."""
    chosen = F.min_by(
        F.struct("rank", "mechanism_type", "affected_cohort", "ok", "precision", "recall", "f1"),
        F.struct((~F.col("ok")).alias("miss"), F.col("rank"))).alias("b")
    return judged.groupBy(*RUN).agg(chosen).select(*RUN, "b.*")


def runs_of(systems: Sequence[str], cases: DataFrame) -> DataFrame:
    """Every system answers for every case."""
    return cases.select(
        F.explode(F.array(*map(F.lit, systems))).alias("system"), "instance_id")


def score_cases(
    hypotheses: DataFrame, gold: DataFrame, planted: DataFrame, users: DataFrame, *,
    runs: DataFrame | None = None,
) -> DataFrame:
    """One row per (system, case).

    ``runs`` lists the (system, instance_id) pairs that must answer, so that an empty list of
    hypotheses scores too; by default the pairs that have hypotheses.
    """
    claim_scores = score_claims(claims_of(hypotheses), users, planted)
    judged = judged_hypotheses(hypotheses, gold, claim_scores)
    first, three = F.col("rank") == 1, F.col("rank") <= 3
    innocent = F.col("mechanism_type") == INNOCENT
    best = F.min_by(F.struct("precision", "recall", "f1"),
                    F.struct((~F.col("ok")).alias("miss"), F.col("rank")))
    per_run = judged.groupBy(*RUN).agg(
        F.max(F.when(first, F.col("mechanism_type"))).alias("top"),
        F.bool_or(first & innocent).alias("top_innocent"),
        F.bool_or(three & innocent).alias("any_innocent"),
        F.bool_or(first & F.col("hit")).alias("top_hit"),
        F.bool_or(three & F.col("hit")).alias("any_hit"),
        best.alias("best"))

    listed = per_run
    if runs is not None:
        listed = runs.select(*RUN).join(per_run, RUN, "left")
    answers = planted.groupBy("instance_id").agg(F.count("*").alias("n_planted"))
    fault = F.col("has_fault")
    # without any hypothesis the empty claim is compared with the answer
    unclaimed = F.when(F.coalesce("n_planted", F.lit(0)) == 0, F.lit(1.0)).otherwise(F.lit(0.0))

    def measure(name: str) -> Column:
        return F.when(fault, F.coalesce(F.col(f"best.{name}"), unclaimed))

    def no(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(False))

    return (
        listed.join(small_side(gold.select("instance_id", "has_fault", "fault_type")),
                    "instance_id")
        .join(answers, "instance_id", "left")
        .select(
            "system", "instance_id", "has_fault",
            F.when(fault, F.col("fault_type")).alias("gold_fault"),
            F.when(fault, F.col("top")).alias("top_pred"),
            F.when(fault, no("top_hit")).otherwise(no("top_innocent")).alias("top1_correct"),
            F.when(fault, no("any_hit")).otherwise(no("any_innocent")).alias("recall_at_3"),
            measure("f1").alias("cohort_f1"),
            measure("precision").alias("cohort_precision"),
            measure("recall").alias("cohort_recall"),
            (~fault & F.col("top").isNotNull() & ~no("top_innocent")).alias("false_positive"))
    )


def suite_summary(scores: DataFrame) -> DataFrame:
    """Top-1 over fault cases, mean F1 over cases that have one, false positives over all."""
    return scores.groupBy("system").agg(
        F.count("*").alias("n_cases"),
        F.count_if("has_fault").alias("n_fault"),
        F.count_if(F.col("has_fault") & F.col("top1_correct")).alias("top1"),
        F.coalesce(F.round(F.avg("cohort_f1"), 3), F.lit(0.0)).alias("mean_f1"),
        F.count_if("false_positive").alias("false_positives"))


# --- views over case scores ---------------------------------------------------------------

def credit_bands(scores: DataFrame, *, full: float = 0.8, partial: float = F1_FLOOR) -> DataFrame:
    """Fault cases by F1 band; strict credit counts full ones, lenient also half of partial."""
    band = (F.when(~F.col("top1_correct"), F.lit("miss"))
            .when(F.col("cohort_f1") >= full, F.lit("full"))
            .when(F.col("cohort_f1") >= partial, F.lit("partial")).otherwise(F.lit("miss")))
    return (
        scores.filter("has_fault").withColumn("band", band).groupBy("system").agg(
            *(F.count_if(F.col("band") == b).alias(f"n_{b}") for b in ("full", "partial", "miss")))
        .withColumn("strict", F.col("n_full") / (F.col("n_full") + F.col("n_partial")
                                                 + F.col("n_miss")))
        .withColumn("lenient", (F.col("n_full") + F.col("n_partial") * 0.5) / (
            F.col("n_full") + F.col("n_partial") + F.col("n_miss")))
    )


def detection_curve(scores: DataFrame, cases: DataFrame) -> DataFrame:
    """Top-1 share of fault cases per target severity."""
    return (
        scores.filter("has_fault")
        .join(cases.select("instance_id", "severity_pp_target"), "instance_id")
        .groupBy("system", "severity_pp_target")
        .agg(F.count("*").alias("n_cases"), F.count_if("top1_correct").alias("top1"))
        .withColumn("detected", F.col("top1") / F.col("n_cases")))


def case_labels(cases: DataFrame) -> DataFrame:
    """Confounder label: a trap is low intent, else Simpson, else none."""
    return cases.withColumn(
        "confounder_type",
        F.when(F.col("is_confounder_trap"), F.lit("low_intent"))
        .when(F.col("is_simpson"), F.lit("simpson")).otherwise(F.lit("none")))


def fp_and_resistance(scores: DataFrame, cases: DataFrame) -> DataFrame:
    """False-positive and top-1 shares split by the case's confounder label."""
    return (
        scores.join(case_labels(cases).select("instance_id", "confounder_type"), "instance_id")
        .groupBy("system", "confounder_type")
        .agg(F.count("*").alias("n_cases"),
             F.avg(F.col("false_positive").cast("double")).alias("fp_rate"),
             F.avg(F.col("top1_correct").cast("double")).alias("top1_rate")))


def system_comparison(scores: DataFrame, *, first: str, second: str,
                      wanted_pp: float = 30.0) -> DataFrame:
    """Top-1 rate of two systems on fault cases, and whether the gap reaches ``wanted_pp``."""
    fault = scores.filter("has_fault")
    def share(system: str) -> Column:
        mine = F.col("system") == system
        return F.try_divide(F.count_if(mine & F.col("top1_correct")).cast("double"),
                            F.count_if(mine).cast("double"))
    return fault.agg(share(first).alias("first_rate"), share(second).alias("second_rate")).select(
        F.lit(first).alias("first_system"), F.lit(second).alias("second_system"),
        "first_rate", "second_rate",
        (F.lit(100.0) * (F.col("second_rate") - F.col("first_rate"))).alias("gap_pp"),
        (F.lit(100.0) * (F.col("second_rate") - F.col("first_rate")) >= wanted_pp)
        .alias("reached"))


def severity_calibration(index: DataFrame, *, tolerance_pp: float = 1.0) -> DataFrame:
    """Is the realised severity within the tolerance of its target?"""
    gap = F.abs(F.col("severity_pp_target") - F.col("severity_pp_realised"))
    return index.filter("has_fault").select(
        "instance_id", "severity_pp_target", "severity_pp_realised",
        gap.alias("gap_pp"), (gap <= tolerance_pp).alias("calibrated"))


def label_agreement(first: DataFrame, second: DataFrame, *, on: str, label: str) -> DataFrame:
    """Agreement rate and Cohen's kappa of two binary (0/1) label tables."""
    pairs = first.select(on, F.col(label).alias("a")).join(
        second.select(on, F.col(label).alias("b")), on)
    a, b = F.col("a") == 1, F.col("b") == 1
    counts = pairs.agg(F.count("*").alias("n"), F.count_if(a == b).alias("n_agree"),
                       F.count_if(a).alias("n_a"), F.count_if(b).alias("n_b"))
    n = F.col("n").cast("double")
    observed = F.try_divide(F.col("n_agree").cast("double"), n)
    chance = F.try_divide(
        F.col("n_a") * F.col("n_b") + (F.col("n") - F.col("n_a")) * (F.col("n") - F.col("n_b")),
        n * n)
    return counts.select(
        "n", "n_agree", observed.alias("agreement"),
        F.try_divide(observed - chance, F.lit(1.0) - chance).alias("kappa"))
