"""Detectors: from signals to ranked hypotheses, for all cases in one plan.

A detector is a function ``(events, users, cases) -> hypotheses``; register more with
:func:`detector`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfall import constants as K
from stepfall.operators import symptoms
from stepfall.schemas import EVIDENCE

Detector = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]
DETECTORS: dict[str, Detector] = {}

FINDING = ("instance_id", "mechanism_type", "mechanism", "affected_cohort", "score",
           "confidence", "evidence", "confounders_considered")


def detector(name: str) -> Callable[[Detector], Detector]:
    def add(fn: Detector) -> Detector:
        DETECTORS[name] = fn
        return fn
    return add


def quoted(value: Column) -> Column:
    """SQL string literal of a value."""
    return F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))


def _evidence(claim: Column, sql: str = "") -> Column:
    return F.array(F.struct(claim.alias("claim"), F.lit(sql).alias("sql"),
                            F.lit("").alias("result_summary"))).cast(
        f"array<{EVIDENCE.simpleString()}>")


def _crash_sql(by: str, min_rows: int) -> str:
    """The finding as a query that a reader can run on one case's recent events."""
    return (f"SELECT {by}, avg(CAST(is_crash AS INT)) AS rate, count(*) AS n FROM events "
            f"GROUP BY {by} HAVING count(*) > {min_rows} ORDER BY rate DESC")


def _texts(*items: str) -> Column:
    return F.array(*map(F.lit, items)).cast("array<string>")


def _standing_out(groups: DataFrame, value: str, floor: float, factor: float,
                  by: str, positive_only: bool) -> DataFrame:
    """Top group per case when it exceeds the floor and ``factor`` times the case's median."""
    best, median = symptoms.best_group(value, by), symptoms.median_of(value, positive_only)
    return (
        groups.groupBy("instance_id").agg(best.alias("b"), median.alias("median"))
        .select("instance_id", "b.*", "median")
        .filter((F.col(value) > floor) & (F.col(value) > F.lit(factor) * F.col("median"))))


def detect_crash(
    histogram: DataFrame, *, by: str = "os", min_rows: int = K.CRASH_MIN_ROWS,
    min_rate: float = K.CRASH_MIN_RATE, factor: float = K.CRASH_MEDIAN_FACTOR,
) -> DataFrame:
    """Crash concentration: one group's row crash rate stands out (recent rows only)."""
    groups = symptoms.crash_rate_by_os(histogram, by=by, min_rows=min_rows)
    hit = _standing_out(groups, "rate", min_rate, factor, by, False)
    shown = F.format_number(F.col("rate") * 100, 1)
    return hit.select(
        "instance_id", F.lit("crash_concentration").alias("mechanism_type"),
        F.concat(F.lit("Crashes concentrate on "), F.col(by), F.lit(".")).alias("mechanism"),
        F.concat(F.lit(f"{by} = "), quoted(F.col(by))).alias("affected_cohort"),
        F.col("rate").alias("score"), F.lit(K.CONFIDENCE_CRASH).alias("confidence"),
        _evidence(F.concat(F.lit("crash share of rows (%): "), shown), _crash_sql(by, min_rows))
        .alias("evidence"),
        _texts("device age was not examined").alias("confounders_considered"))


def detect_latency(
    histogram: DataFrame, *, by: str = "os", min_rows: int = K.LATENCY_MIN_ROWS,
    min_p95: float = K.LATENCY_MIN_P95, factor: float = K.LATENCY_MEDIAN_FACTOR,
) -> DataFrame:
    """Checkout latency: one group's p95 stands out among groups with a non-zero p95."""
    groups = symptoms.latency_p95_by_os(histogram, by=by, min_rows=min_rows)
    hit = _standing_out(groups, "p95", min_p95, factor, by, True)
    shown = F.round("p95", 0).cast("bigint").cast("string")
    return hit.select(
        "instance_id", F.lit("checkout_latency").alias("mechanism_type"),
        F.concat(F.lit("Checkout became slow on "), F.col(by), F.lit(".")).alias("mechanism"),
        F.concat(F.lit(f"{by} = "), quoted(F.col(by))).alias("affected_cohort"),
        F.col("p95").alias("score"), F.lit(K.CONFIDENCE_LATENCY).alias("confidence"),
        _evidence(F.concat(F.lit("checkout p95 (ms): "), shown)).alias("evidence"),
        _texts().alias("confounders_considered"))


def innocent_rows(cases: DataFrame) -> DataFrame:
    """The innocent answer for every case."""
    return cases.select(
        "instance_id", F.lit(K.INNOCENT).alias("mechanism_type"),
        F.lit("Neither crashes nor latency stand out.").alias("mechanism"),
        F.lit("").alias("affected_cohort"), F.lit(None).cast("double").alias("score"),
        F.lit(K.CONFIDENCE_INNOCENT).alias("confidence"),
        F.slice(_evidence(F.lit("")), 1, 0).alias("evidence"),
        _texts("traffic mix", "device age").alias("confounders_considered"))


def detect_none(cases: DataFrame, findings: DataFrame) -> DataFrame:
    """Cases without any finding get the innocent answer."""
    found = findings.select("instance_id").distinct()
    return innocent_rows(cases.join(found, "instance_id", "left_anti"))


def rank_hypotheses(system: str, findings: Sequence[DataFrame], cases: DataFrame) -> DataFrame:
    """Concatenate findings in the given order, fall back to innocent, number them per case.

    The fallback joins the union for every case and is kept where it stands alone, so the
    findings are computed once.
    """
    every = innocent_rows(cases).withColumn("place", F.lit(len(findings)))
    for i, found in enumerate(findings):
        every = every.unionByName(found.select(*FINDING).withColumn("place", F.lit(i)))
    case = Window.partitionBy("instance_id")
    order = case.orderBy("place", F.col("score").desc_nulls_last(), "affected_cohort")
    return (
        every.withColumn("rank", F.row_number().over(order))
        .withColumn("n_rows", F.count("*").over(case))
        .filter((F.col("place") < len(findings)) | (F.col("n_rows") == 1))
        .select(F.lit(system).alias("system"), "instance_id", "rank", "mechanism_type",
                "mechanism", "affected_cohort", "evidence", "confidence",
                "confounders_considered"))


@detector("baseline")
def baseline(events: DataFrame, users: DataFrame, cases: DataFrame, **thresholds) -> DataFrame:
    """Two clean signals, crash and checkout latency, in the recent window."""
    histogram = symptoms.signal_histogram(symptoms.recent_window(events, cases))
    unknown = [k for k in thresholds if not k.startswith(("crash_", "latency_"))]
    if unknown:
        raise TypeError(f"no such threshold: {', '.join(unknown)}")
    crash = {k[6:]: v for k, v in thresholds.items() if k.startswith("crash_")}
    slow = {k[8:]: v for k, v in thresholds.items() if k.startswith("latency_")}
    return rank_hypotheses(
        "baseline", [detect_crash(histogram, **crash), detect_latency(histogram, **slow)], cases)


def cohort_text(attr: Column, value: Column) -> Column:
    """Predicate text of a scan cohort; an age band becomes its two bounds."""
    ends = F.split(value, "-")
    low, high = F.element_at(ends, 1), F.try_element_at(ends, F.lit(2))
    band = F.concat(
        F.when(low != "0", F.concat(F.lit("device_age_months >= "), low, F.lit(" AND ")))
        .otherwise(F.lit("")), F.lit("device_age_months <= "), high)
    return (
        F.when(attr == "device_age_months", band)
        .when(attr == "is_returning", F.concat(F.lit("is_returning = "), F.upper(value)))
        .otherwise(F.concat(attr, F.lit(" = "), quoted(value))))


def findings_from_scan(scan: DataFrame, *, per_case: int = 3, min_pp: float = 0.0) -> DataFrame:
    """The ``per_case`` worst scan rows whose step names a mechanism, as findings."""
    step = F.concat_ws(">", "from_stage", "to_stage")
    mechanism = F.when(F.col("to_stage") == "crash", F.lit("crash_concentration"))
    for fault, (a, b) in K.STEP_OF_FAULT.items():
        mechanism = mechanism.when(step == f"{a}>{b}", F.lit(fault))
    named = scan.withColumn("mechanism_type", mechanism).filter(
        F.col("mechanism_type").isNotNull() & (F.col("delta_pp") > min_pp))
    order = Window.partitionBy("instance_id").orderBy("rnk")
    return named.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_case).select(
        "instance_id", "mechanism_type",
        F.concat(F.lit("Got worse for "), "attr", F.lit(" "), "value", F.lit(": "), step)
        .alias("mechanism"),
        cohort_text(F.col("attr"), F.col("value")).alias("affected_cohort"),
        F.col("delta_pp").alias("score"),
        F.least(F.lit(1.0), F.col("delta_pp") / 100).alias("confidence"),
        _evidence(F.concat(F.lit("change (pp): "), F.format_number("delta_pp", 2)))
        .alias("evidence"),
        _texts("ranked against every other single attribute").alias("confounders_considered"))


def closed_ranks(hypotheses: DataFrame) -> DataFrame:
    """Ranks from 1 without gaps, in the order there was."""
    run = Window.partitionBy("system", "instance_id").orderBy("rank", "mechanism_type", "affected_cohort")
    return hypotheses.withColumn("rank", F.row_number().over(run))


def valid_hypotheses(hypotheses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows: closed set of mechanisms, confidence within [0, 1]."""
    good = F.coalesce(
        F.col("mechanism_type").isin(*K.MECHANISMS) & F.col("confidence").between(0.0, 1.0),
        F.lit(False))
    return hypotheses.filter(good), hypotheses.filter(~good)
