"""Checks that separate a fault from a confounder: cohort vs rest, Simpson, traffic mix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfall.constants import STAGES, USER_ATTRIBUTES
from stepfall.functions.measures import rate
from stepfall.operators.severity import (
    CRASH, Step, age_band, attribute_values, band_label, count_columns, long_steps, step_counts,
    with_delta,
)

WHOLE: Step = (STAGES[0], STAGES[-1])


def cohort_stats(sessions: DataFrame, cohort: Column, *, steps: Sequence[Step] = (WHOLE, CRASH),
                 vocabulary: Sequence[str] = STAGES) -> DataFrame:
    """Pre and post numbers of a cohort beside those of everyone else."""
    sided = sessions.withColumn(
        "side", F.when(F.coalesce(cohort, F.lit(False)), F.lit("cohort")).otherwise(F.lit("rest")))
    keys = ["instance_id", "side"]
    return with_delta(long_steps(step_counts(sided, keys, steps, vocabulary), keys, steps))


def confounder_check(sessions: DataFrame) -> DataFrame:
    """Churn of users who crashed before the changepoint against those who did not, per age band.

    A user churned when no session of theirs starts in the post period.
    """
    pre, post = F.col("period") == "pre", F.col("period") == "post"
    per_user = (
        sessions.groupBy("instance_id", "user_id", "device_age_months")
        .agg(F.bool_or(pre).alias("seen"), F.bool_or(post).alias("back"),
             F.bool_or(pre & F.col("has_crash")).alias("crashed"))
        .filter("seen"))
    churned = ~F.col("back")
    return (
        per_user.filter(F.col("device_age_months").isNotNull())
        .groupBy("instance_id", band_label(age_band(F.col("device_age_months"))).alias("age_band"))
        .agg(F.count_if("crashed").alias("n_crashers"),
             F.count_if(F.col("crashed") & churned).alias("churned_crashers"),
             F.count_if(~F.col("crashed")).alias("n_others"),
             F.count_if(~F.col("crashed") & churned).alias("churned_others"))
        .withColumn("churn_crashers", rate(F.col("churned_crashers"), F.col("n_crashers")))
        .withColumn("churn_others", rate(F.col("churned_others"), F.col("n_others")))
    )


def _segments(sessions: DataFrame, attr: str, step: Step, vocabulary: Sequence[str]) -> DataFrame:
    """Counts of one step per attribute value; a null attribute is a segment of its own."""
    named = sessions.withColumn(
        "segment", F.coalesce(attribute_values()[attr], F.lit("(none)")))
    counts = step_counts(named, ["instance_id", "segment"], [step], vocabulary)
    return long_steps(counts, ["instance_id", "segment"], [step])


def _totals(segments: DataFrame) -> DataFrame:
    return segments.groupBy("instance_id").agg(
        *(F.sum(c).alias(f"all_{c}") for c in ("n_pre", "k_pre", "n_post", "k_post")))


def mix_shift(sessions: DataFrame, attr: str, *, step: Step = WHOLE,
              vocabulary: Sequence[str] = STAGES) -> DataFrame:
    """Split the change of a conversion rate into within-segment and traffic-mix parts.

    The parts of all segments add up to the aggregate change.
    """
    segments = _segments(sessions, attr, step, vocabulary)
    zero = F.lit(0.0)
    w = {p: F.coalesce(rate(F.col(f"n_{p}"), F.col(f"all_n_{p}")), zero) for p in ("pre", "post")}
    overall = F.coalesce(rate(F.col("all_k_pre"), F.col("all_n_pre")), zero)
    r_pre = F.coalesce(rate(F.col("k_pre"), F.col("n_pre")), overall)
    r_post = F.coalesce(rate(F.col("k_post"), F.col("n_post")), zero)
    return (
        segments.join(_totals(segments), "instance_id")
        .select("instance_id", "segment",
                (w["post"] * (r_post - r_pre)).alias("within"),
                ((w["post"] - w["pre"]) * r_pre).alias("mix"))
        .withColumn("total", F.col("within") + F.col("mix")))


def simpson_check(sessions: DataFrame, *, attrs: Sequence[str] = USER_ATTRIBUTES,
                  step: Step = WHOLE, vocabulary: Sequence[str] = STAGES,
                  threshold_pp: float = 2.0) -> DataFrame:
    """Per attribute: is the aggregate flat while its segments move in opposite directions?"""
    values = attribute_values()
    combos = step_counts(
        sessions.select("instance_id", "period", "stage_mask", "has_crash",
                        *(values[a].alias(a) for a in attrs)),
        ["instance_id", *attrs], [step], vocabulary)
    counters = count_columns(1)
    named = ", ".join(f"struct('{a}' AS attr, {a} AS value)" for a in attrs)
    segments = (
        combos.select("instance_id", *counters, F.expr(f"inline(array({named}))"))
        .groupBy("instance_id", "attr", "value").agg(*(F.sum(c).alias(c) for c in counters)))
    moves = with_delta(long_steps(segments, ["instance_id", "attr", "value"], [step]))
    whole = F.lit(100.0) * (
        rate(F.sum("k_pre"), F.sum("n_pre")) - rate(F.sum("k_post"), F.sum("n_post")))
    return (
        moves.groupBy("instance_id", "attr")
        .agg(whole.alias("total_delta"), F.max("delta_pp").alias("max_seg_delta"),
             F.min("delta_pp").alias("min_seg_delta"))
        .withColumn("flag", F.coalesce(
            (F.abs("total_delta") < threshold_pp) & (F.col("max_seg_delta") > threshold_pp)
            & (F.col("min_seg_delta") < -threshold_pp), F.lit(False))))
