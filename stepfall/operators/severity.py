"""Step conversion and its change across the changepoint.

All counts come from one pass over session rows; the attribute scan first shrinks sessions to
one row per attribute combination, so the six-fold expansion happens on that small table.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfall.constants import STAGES, STEPS, USER_ATTRIBUTES
from stepfall.functions.measures import rate, realised_pp, shown_pct, two_proportion_z
from stepfall.operators.sessions import holds, sql_text

Step = tuple[str, str]
CRASH: Step = ("session", "crash")


def reached(step: Step, vocabulary: Sequence[str]) -> tuple[str, str]:
    """SQL conditions for the base and the hit of a step; conversion is set membership."""
    if step == CRASH:
        return "TRUE", "has_crash"
    base = holds(step[0], vocabulary)
    return base, f"{base} AND {holds(step[1], vocabulary)}"


PERIODS = ("pre", "post")


def step_counts(
    sessions: DataFrame, keys: Sequence[str], steps: Sequence[Step],
    vocabulary: Sequence[str] = STAGES,
) -> DataFrame:
    """Per key and step i: sessions with the base (``n_pre_i``, ``n_post_i``) and with the hit
    (``k_pre_i``, ``k_post_i``)."""
    sums = []
    for i, step in enumerate(steps):
        base, hit = reached(step, vocabulary)
        for p in PERIODS:
            sums.append(F.expr(f"count_if(period = '{p}' AND {base}) AS n_{p}_{i}"))
            sums.append(F.expr(f"count_if(period = '{p}' AND {hit}) AS k_{p}_{i}"))
    return sessions.groupBy(*keys).agg(*sums)


def count_columns(n_steps: int) -> list[str]:
    return [f"{kind}_{p}_{i}" for i in range(n_steps) for p in PERIODS for kind in ("n", "k")]


def long_steps(counts: DataFrame, keys: Sequence[str], steps: Sequence[Step]) -> DataFrame:
    """Wide step counters to one row per step."""
    rows = ", ".join(
        f"struct({sql_text(a)} AS from_stage, {sql_text(b)} AS to_stage, n_pre_{i} AS n_pre, "
        f"k_pre_{i} AS k_pre, n_post_{i} AS n_post, k_post_{i} AS k_post)"
        for i, (a, b) in enumerate(steps))
    return counts.select(*keys, F.expr(f"inline(array({rows}))"))


def with_delta(long: DataFrame) -> DataFrame:
    """Rates and the change in percentage points, positive when things got worse."""
    worse = F.when(F.col("to_stage") == CRASH[1], F.col("rate_post") - F.col("rate_pre")) \
        .otherwise(F.col("rate_pre") - F.col("rate_post"))
    return (
        long.withColumn("rate_pre", rate(F.col("k_pre"), F.col("n_pre")))
        .withColumn("rate_post", rate(F.col("k_post"), F.col("n_post")))
        .withColumn("delta_pp", F.lit(100.0) * worse)
    )


def step_conversion(
    sessions: DataFrame, *, keys: Sequence[str] = ("instance_id",),
    steps: Sequence[Step] = STEPS, vocabulary: Sequence[str] = STAGES,
) -> DataFrame:
    """``P(to | from)`` per period: the share of sessions holding ``from`` that hold ``to``."""
    long = long_steps(step_counts(sessions, keys, steps, vocabulary), keys, steps)
    sides = ", ".join(
        f"struct('{p}' AS period, n_{p} AS n_from, k_{p} AS n_both)" for p in PERIODS)
    return (
        long.select(*keys, "from_stage", "to_stage", F.expr(f"inline(array({sides}))"))
        .withColumn("rate", rate(F.col("n_both"), F.col("n_from")))
        .select(*keys, "period", "from_stage", "to_stage", "n_from", "n_both", "rate")
    )


def cohort_severity(
    sessions: DataFrame, step: Step, cohort: Column, label: str,
    vocabulary: Sequence[str] = STAGES,
) -> DataFrame:
    """Realised severity of one step (or of :data:`CRASH`) among the cohort's sessions.

    Every case answers: a cohort without sessions counts 0 and has severity 0.0.
    """
    inside = F.coalesce(cohort, F.lit(False))
    base, hit = reached(step, vocabulary)
    counts = [F.count_if(inside).alias("cohort_sessions")]
    for period in ("pre", "post"):
        during = inside & (F.col("period") == period)
        counts += [F.count_if(during & F.expr(base)).alias(f"n_{period}"),
                   F.count_if(during & F.expr(hit)).alias(f"k_{period}")]
    pre, post = (rate(F.col(f"k_{p}"), F.col(f"n_{p}")) for p in ("pre", "post"))
    if step == CRASH:
        # a missing side counts as a zero rate here, unlike a step
        zero = F.lit(0.0)
        drop = F.round(F.lit(100.0) * (F.coalesce(post, zero) - F.coalesce(pre, zero)), 2)
        metric = "crash_rate_increase"
    else:
        drop, metric = realised_pp(pre, post), f"P({step[1]}|{step[0]})"
    return sessions.groupBy("instance_id").agg(*counts).select(
        "instance_id", F.lit(label).alias("cohort"), F.lit(metric).alias("metric"),
        "cohort_sessions", shown_pct(pre).alias("pre"), shown_pct(post).alias("post"),
        drop.alias("realised_pp"))


def aggregate_shift(
    sessions: DataFrame, step: Step = (STAGES[0], STAGES[-1]),
    vocabulary: Sequence[str] = STAGES,
) -> DataFrame:
    """No-fault case: the shift over all sessions; nothing was planted, so realised is 0."""
    counts = step_counts(sessions, ["instance_id"], [step], vocabulary)
    pre, post = (F.coalesce(rate(F.col(f"k_{p}_0"), F.col(f"n_{p}_0")), F.lit(0.0))
                 for p in ("pre", "post"))
    return counts.select(
        "instance_id", F.lit(0.0).alias("realised_pp"),
        F.round(F.lit(100.0) * (pre - post), 2).alias("aggregate_pp_shift"))


# --- scan over attributes -----------------------------------------------------------------

def age_band(age: Column) -> Column:
    """Number of the 12-month band (12k, 12k + 12]; 0 belongs to the first."""
    return F.greatest(F.ceil(age / 12) - 1, F.lit(0)).cast("int")


def band_label(band: Column) -> Column:
    low = F.when(band == 0, F.lit(0)).otherwise(band * 12 + 1)
    return F.concat_ws("-", low.cast("string"), (band * 12 + 12).cast("string"))


def attribute_values() -> dict[str, Column]:
    """Attribute name -> its value as text, ages in bands."""
    out = {name: F.col(name).cast("string") for name in USER_ATTRIBUTES}
    age = F.col("device_age_months")
    out["device_age_months"] = F.when(age.isNotNull(), band_label(age_band(age)))
    return out


def severity_scan(
    sessions: DataFrame, *, steps: Sequence[Step] = (*STEPS, CRASH),
    vocabulary: Sequence[str] = STAGES, min_sessions: int = 0, pairs: bool = False,
) -> DataFrame:
    """Severity of every step and of crashes for every attribute value, ranked per case.

    ``sessions`` carry the six user attributes.  Values that are null name no cohort and are
    left out.  ``pairs`` adds all two-attribute cohorts.
    """
    names = list(USER_ATTRIBUTES)
    values = attribute_values()
    labelled = sessions.select(
        "instance_id", "period", "stage_mask", "has_crash",
        *(values[n].alias(n) for n in names))
    combos = step_counts(labelled, ["instance_id", *names], steps, vocabulary)

    cohorts = [f"struct('{n}' AS attr, {n} AS value)" for n in names]
    if pairs:
        cohorts += [f"struct('{a}&{b}' AS attr, concat({a}, '&', {b}) AS value)"
                    for a, b in combinations(names, 2)]
    counters = count_columns(len(steps))
    totals = (
        combos.select("instance_id", *counters, F.expr(f"inline(array({', '.join(cohorts)}))"))
        .filter(F.col("value").isNotNull())
        .groupBy("instance_id", "attr", "value")
        .agg(*(F.expr(f"sum({c}) AS {c}") for c in counters))
    )
    ranked = Window.partitionBy("instance_id").orderBy(
        F.col("delta_pp").desc_nulls_last(), "attr", "value", "from_stage")
    keys = ["instance_id", "attr", "value"]
    return (
        with_delta(long_steps(totals, keys, steps))
        .filter((F.col("n_pre") >= min_sessions) & (F.col("n_post") >= min_sessions))
        .withColumn("rnk", F.row_number().over(ranked))
    )


def severity_ztest(scan: DataFrame) -> DataFrame:
    """Pooled two-proportion z per scan row, positive when worse."""
    def z(first: str, second: str) -> Column:
        return two_proportion_z(F.col(f"k_{first}"), F.col(f"n_{first}"),
                                F.col(f"k_{second}"), F.col(f"n_{second}"))
    return scan.withColumn(
        "z", F.when(F.col("to_stage") == CRASH[1], z("post", "pre")).otherwise(z("pre", "post")))
