"""Symptom views: volume, crash rate, latency, service levels, payment parity, decoys.

Latency percentiles are exact.  Rows are first counted per latency value (a plain, spillable
hash aggregation that combines on the map side); the percentile then runs over value counts,
so its state is bounded by the number of distinct milliseconds and not by the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfall.constants import (
    CRASH_MIN_ROWS, LATENCY_MIN_ROWS, SLO_LIMITS_MS, STAGES,
)
from stepfall.functions.measures import rate
from stepfall.functions.timing import is_recent
from stepfall.operators.sessions import event_days, has
from stepfall.plans.joins import with_cases


def case_volume(events: DataFrame, *, approximate: bool = False) -> DataFrame:
    """Events, distinct users and distinct raw names per case."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return events.groupBy("instance_id").agg(
        F.count("*").alias("n_events"),
        distinct(F.col("user_id")).alias("n_users"),
        distinct(F.col("event_name")).alias("n_names"))


def recent_window(events: DataFrame, cases: DataFrame) -> DataFrame:
    """Events at or after the changepoint, by event time.

    The earliest changepoint of all cases bounds the scan: a scalar subquery that reaches the file
    reader as a filter, beside each case's own bound.
    """
    start = F.date_add("base_date", F.col("changepoint_day")).cast("timestamp_ntz")
    earliest = cases.agg(F.min(start)).scalar()
    return (
        with_cases(events.filter(F.col("event_ts") >= earliest), cases, "base_date", "changepoint_day")
        .filter(is_recent(F.col("event_ts"), F.col("base_date"), F.col("changepoint_day")))
        .drop("base_date", "changepoint_day")
    )


def signal_histogram(events: DataFrame, *, by: str = "os", screen: str = "checkout") -> DataFrame:
    """Row and crash counts per (case, group, on-screen, latency value on that screen).

    Both detectors and the symptom view are sums over this table, so they share one scan.
    """
    on_screen = F.coalesce(F.col("screen") == screen, F.lit(False))
    return (
        events.select("instance_id", by, on_screen.alias("on_screen"),
                      F.when(on_screen, F.col("latency_ms")).alias("latency_ms"), "is_crash")
        .groupBy("instance_id", by, "on_screen", "latency_ms")
        .agg(F.count("*").alias("n"), F.count_if("is_crash").alias("n_crash"))
    )


def _p95(value: Column, weight: Column) -> Column:
    return F.percentile(value, F.lit(0.95), weight)


def crash_rate_by_os(
    histogram: DataFrame, *, by: str = "os", min_rows: int = CRASH_MIN_ROWS,
) -> DataFrame:
    """Crashing share of event rows per group with more than ``min_rows`` rows."""
    return (
        histogram.groupBy("instance_id", by)
        .agg(F.sum("n").alias("n"), F.sum("n_crash").alias("n_crash"))
        .filter(F.col("n") > min_rows)
        .select("instance_id", by, rate(F.col("n_crash"), F.col("n")).alias("rate"), "n")
    )


def latency_p95_by_os(
    histogram: DataFrame, *, by: str = "os", min_rows: int = LATENCY_MIN_ROWS,
) -> DataFrame:
    """p95 latency on the watched screen; ``n`` counts rows with and without a latency."""
    return (
        histogram.filter("on_screen").groupBy("instance_id", by)
        .agg(_p95(F.col("latency_ms"), F.col("n")).alias("p95"), F.sum("n").alias("n"))
        .filter(F.col("n") > min_rows)
    )


def symptom_by_os(histogram: DataFrame, *, by: str = "os") -> DataFrame:
    """Crash percent (2 digits) and p95 checkout latency (0 digits) per group."""
    return histogram.groupBy("instance_id", by).agg(
        F.round(F.lit(100.0) * F.sum("n_crash") / F.sum("n"), 2).alias("crash_pct"),
        F.round(_p95(F.when(F.col("on_screen"), F.col("latency_ms")), F.col("n")), 0)
        .alias("chk_p95"))


def median_of(value: str, positive_only: bool = False) -> Column:
    x = F.col(value)
    return F.coalesce(F.median(F.when(x != 0, x) if positive_only else x), F.lit(0.0))


def best_group(value: str, by: str = "os") -> Column:
    """(name, value) of the highest value; equal values go to the first name, nulls to none."""
    order = F.struct((-F.col(value)).alias("neg"), F.col(by))
    return F.min_by(F.struct(by, value), F.when(F.col(value).isNotNull(), order))


def group_median(groups: DataFrame, value: str, *, positive_only: bool = False) -> DataFrame:
    """Median over a case's groups, mean of the middle two; 0 when there is none.

    ``positive_only`` leaves zero values out, as null ones always are.
    """
    return groups.groupBy("instance_id").agg(median_of(value, positive_only).alias("median"))


def top_suspect(groups: DataFrame, value: str, *, by: str = "os") -> DataFrame:
    """Group with the highest value per case."""
    return (
        groups.filter(F.col(value).isNotNull()).groupBy("instance_id")
        .agg(best_group(value, by).alias("b")).select("instance_id", "b.*"))


def slo_audit(
    events: DataFrame, cases: DataFrame, *, limits: Mapping[str, int] = SLO_LIMITS_MS,
    cold_start_screen: str | None = None, by: str = "os",
) -> DataFrame:
    """p95 of each signal per group and event-time period against its limit.

    A signal is breached at or above its limit.  Cold start is the logical event
    ``app_cold_start``, or all rows of ``cold_start_screen`` where that event is not logged.
    """
    cold = (F.col("screen") == cold_start_screen) if cold_start_screen else (
        F.col("canonical") == "app_cold_start")
    counted = (
        event_days(events, cases).filter(F.col("latency_ms").isNotNull())
        .select("instance_id", by, "period", "latency_ms",
                F.coalesce(cold, F.lit(False)).alias("cold"),
                F.coalesce(F.col("screen") == "checkout", F.lit(False)).alias("checkout"))
        .groupBy("instance_id", by, "period", "latency_ms", "cold", "checkout")
        .agg(F.count("*").alias("n"))
    )
    signals = F.filter(F.array(
        F.when(F.col("cold"), F.lit("cold_start")),
        F.when(F.col("checkout"), F.lit("checkout_screen")),
        F.lit("screen_load")), lambda s: s.isNotNull())
    limit = F.lit(None).cast("int")
    for name, bar in limits.items():
        limit = F.when(F.col("signal") == name, F.lit(bar)).otherwise(limit)
    return (
        counted.withColumn("signal", F.explode(signals))
        .groupBy("instance_id", by, "period", "signal")
        .agg(_p95(F.col("latency_ms"), F.col("n")).alias("p95"))
        .withColumn("limit_ms", limit)
        .withColumn("breach", F.col("p95") >= F.col("limit_ms"))
    )


def payment_parity(sessions: DataFrame, *, vocabulary: Sequence[str] = STAGES) -> DataFrame:
    """Order rate per first payment method and period, and the gap to the best method."""
    paid = has("payment_submit", vocabulary)
    best = F.max("rate").over(Window.partitionBy("instance_id", "period"))
    return (
        sessions.filter(F.col("pay_method").isNotNull())
        .groupBy("instance_id", "pay_method", "period")
        .agg(F.count_if(paid).alias("n_pay"),
             F.count_if(paid & has("order_confirmed", vocabulary)).alias("n_order"))
        .withColumn("rate", rate(F.col("n_order"), F.col("n_pay")))
        .withColumn("gap_to_best", best - F.col("rate"))
    )


# screen -> (event that shows it, event that dismisses it); without a dismissal, leaving means
# that no later funnel stage is in the session.
DECOYS = {
    "upsell": ("upsell_view", "upsell_dismiss", ()),
    "tutorial": ("tutorial_view", None, STAGES[1:]),
}
DECOY_VOCABULARY = (*STAGES, "upsell_view", "upsell_dismiss", "tutorial_view")


def decoy_report(
    sessions: DataFrame, *, vocabulary: Sequence[str] = DECOY_VOCABULARY,
    decoys: Mapping[str, tuple[str, str | None, Sequence[str]]] = DECOYS,
) -> DataFrame:
    """Sessions that saw an optional screen and the share that left there."""
    counts, rows = [], []
    for screen, (view, dismiss, later) in decoys.items():
        seen = has(view, vocabulary)
        stayed = F.lit(False)
        for name in ([dismiss] if dismiss else later):
            stayed = stayed | has(name, vocabulary)
        counts += [F.count_if(seen).alias(f"seen_{screen}"),
                   F.count_if(seen & ~stayed).alias(f"exit_{screen}")]
        rows.append(F.struct(
            F.lit(screen).alias("screen"), F.col(f"seen_{screen}").alias("sessions_seen"),
            F.col(f"exit_{screen}").alias("sessions_exited")))
    return (
        sessions.groupBy("instance_id", "period").agg(*counts)
        .select("instance_id", "period", F.explode(F.array(*rows)).alias("r"))
        .select("instance_id", "r.screen", "period", "r.sessions_seen", "r.sessions_exited")
        .withColumn("exit_rate", rate(F.col("sessions_exited"), F.col("sessions_seen")))
    )
