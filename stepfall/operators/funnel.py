"""Funnel reports by logical stage, and the naive name match."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfall.constants import NAIVE_PATTERNS, STAGES
from stepfall.operators.sessions import event_days, holds, sql_text


def funnel_report(
    sessions: DataFrame, *, segment: str | None = None, stages: Sequence[str] = STAGES,
    vocabulary: Sequence[str] = STAGES,
) -> DataFrame:
    """Sessions and users per ordered stage and period, with step and overall conversion.

    Sessions fold to one row per user first (counters and the OR of their masks), which gives
    session counts and distinct users in one chain without a distinct aggregate.
    """
    keys = ["instance_id", *([segment] if segment else []), "period"]
    n, at = len(stages), [holds(s, vocabulary) for s in stages]
    later = range(1, n)
    per_user = sessions.groupBy(*keys, "user_id").agg(
        F.bit_or("stage_mask").alias("stage_mask"),
        *(F.expr(f"count_if({at[i]}) AS s_{i}") for i in range(n)),
        *(F.expr(f"count_if({at[i - 1]} AND {at[i]}) AS p_{i}") for i in later),
        *(F.expr(f"count_if({at[0]} AND {at[i]}) AS o_{i}") for i in later))
    totals = per_user.groupBy(*keys).agg(
        *(F.expr(f"count_if({at[i]}) AS u_{i}") for i in range(n)),
        *(F.expr(f"sum(s_{i}) AS s_{i}") for i in range(n)),
        *(F.expr(f"sum({c}_{i}) AS {c}_{i}") for i in later for c in ("p", "o")))

    def row(i: int) -> str:
        step = f"CAST(p_{i} AS DOUBLE) / nullif(s_{i - 1}, 0)" if i else "CAST(NULL AS DOUBLE)"
        return (f"struct({i} AS stage_idx, {sql_text(stages[i])} AS stage, s_{i} AS sessions, "
                f"u_{i} AS users, {step} AS step_rate, "
                f"CAST({f'o_{i}' if i else 's_0'} AS DOUBLE) / nullif(s_0, 0) AS overall_rate)")

    return totals.select(*keys, F.expr(f"inline(array({', '.join(map(row, range(n)))}))"))


def _like_any(patterns: Sequence[str], name: str = "event_name") -> str:
    """SQL condition: the lower-cased name matches one of the patterns."""
    return "(" + " OR ".join(f"lower({name}) LIKE {sql_text(p)}" for p in patterns) + ")"


def naive_stage_match(
    events: DataFrame, patterns: Mapping[str, Sequence[str]] = NAIVE_PATTERNS,
) -> DataFrame:
    """Raw names caught by each stage's LIKE patterns; a name may fall under several."""
    names = events.groupBy("instance_id", "event_name").agg(F.count("*").alias("n_events"))
    tests = ", ".join(f"CASE WHEN {_like_any(p)} THEN {sql_text(s)} END"
                      for s, p in patterns.items())
    found = F.expr(f"explode(filter(array({tests}), s -> s IS NOT NULL))")
    return names.select("instance_id", found.alias("stage"), "event_name", "n_events")


def like_to_regex(patterns: Sequence[str]) -> str:
    """One regular expression that finds what any of the LIKE patterns matches."""
    parts = []
    for pattern in patterns:
        body = "".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in pattern.strip("%"))
        parts.append(("" if pattern.startswith("%") else "^") + body
                     + ("" if pattern.endswith("%") else r"\z"))
    return "(?s)" + "|".join(parts)


def naive_funnel(
    events: DataFrame, patterns: Mapping[str, Sequence[str]] = NAIVE_PATTERNS,
    cases: DataFrame | None = None,
) -> DataFrame:
    """Distinct users reaching each naively matched stage.

    One scan of the events is folded to (case, user, name, period), so patterns are searched once per
    folded row and not per event.  The matched stages become bits, and one roll-up by user serves all.
    With ``cases`` the counts are given per event-time period as well as for the whole window.
    """
    keys = ["instance_id", "user_id"]
    stages = list(patterns)
    mask = F.expr(" + ".join(
        f"CASE WHEN low RLIKE {sql_text(like_to_regex(patterns[s]))} THEN {1 << i} ELSE 0 END"
        for i, s in enumerate(stages)))
    if cases is None:
        seen = events.select(*keys, "event_name").distinct().withColumn("period", F.lit("all"))
    else:
        seen = event_days(events, cases).select(*keys, "event_name", "period").distinct()
    marked = seen.withColumn("low", F.lower("event_name"))
    if cases is None:
        whole = marked.groupBy(*keys).agg(F.bit_or(mask).alias("m"))
        periods = whole.select("instance_id", F.lit("all").alias("period"), "m")
    else:
        split = marked.groupBy(*keys).agg(
            *(F.bit_or(F.when(F.col("period") == p, mask).otherwise(0)).alias(p)
              for p in ("pre", "post")))
        periods = split.select("instance_id", F.explode(F.array(
            F.struct(F.lit("all").alias("period"), F.col("pre").bitwiseOR(F.col("post")).alias("m")),
            F.struct(F.lit("pre").alias("period"), F.col("pre").alias("m")),
            F.struct(F.lit("post").alias("period"), F.col("post").alias("m")))).alias("x")
        ).select("instance_id", "x.*")
    counts = periods.groupBy("instance_id", "period").agg(
        *(F.expr(f"count_if((m & {1 << i}) != 0) AS u_{i}") for i in range(len(stages))))
    rows = ", ".join(f"struct({i} AS stage_idx, {sql_text(s)} AS stage, u_{i} AS users)"
                     for i, s in enumerate(stages))
    return counts.select("instance_id", "period", F.expr(f"inline(array({rows}))"))
