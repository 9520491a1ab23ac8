"""The whole chain: events -> sessions -> detectors -> ranked hypotheses -> scores."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfall.operators import detect, score, severity


def scan_hypotheses(sessions: DataFrame, cases: DataFrame, *, per_case: int = 3,
                    min_sessions: int = 0) -> DataFrame:
    """Ranked hypotheses of the attribute scan."""
    scan = severity.severity_scan(sessions, min_sessions=min_sessions)
    return detect.rank_hypotheses(
        "scan", [detect.findings_from_scan(scan, per_case=per_case)], cases)


def all_systems(hypotheses: Mapping[str, DataFrame]) -> DataFrame:
    """Hypotheses of several systems as one table."""
    first, *rest = (df.withColumn("system", F.lit(name)) for name, df in hypotheses.items())
    for more in rest:
        first = first.unionByName(more)
    return first


def score_suite(hypotheses: DataFrame, gold: DataFrame, planted: DataFrame,
                users: DataFrame) -> DataFrame:
    """Case scores of all systems folded to one row per system."""
    return score.suite_summary(score.score_cases(hypotheses, gold, planted, users))
