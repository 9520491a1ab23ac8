"""Session roll-up: one row per session from the event stream.

Two forms.  :func:`session_rollup` keeps the set of logical events as an array;
:func:`session_flags` keeps it as a bit mask over a known vocabulary.  The mask has fixed
width, so the aggregation stays in the code-generated hash path and combines on the map
side: a session of a billion events still sends one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfall.constants import PAYMENT_METHODS, STAGES, USER_ATTRIBUTES
from stepfall.functions.timing import day_index, period_of, wall_micros
from stepfall.plans.joins import small_side, with_cases

NAMES_PER_MASK = 62


def event_days(events: DataFrame, cases: DataFrame) -> DataFrame:
    """Events with their day index and the period that day falls in."""
    day = day_index(F.col("event_ts"), F.col("base_date"))
    return (
        with_cases(events, cases, "base_date", "changepoint_day")
        .withColumn("day", day)
        .withColumn("period", period_of(F.col("day"), F.col("changepoint_day")))
        .drop("base_date", "changepoint_day")
    )


def _label_period(sessions: DataFrame, cases: DataFrame) -> DataFrame:
    """Day and period of a session follow from its earliest event."""
    return (
        with_cases(sessions, cases, "base_date", "changepoint_day")
        .withColumn("day", day_index(F.col("first_ts"), F.col("base_date")))
        .withColumn("period", period_of(F.col("day"), F.col("changepoint_day")))
        .drop("base_date", "changepoint_day", "first_ts")
    )


def session_rollup(events: DataFrame, cases: DataFrame) -> DataFrame:
    """user, first day, sorted set of logical events, crash flag, first payment method, period.

    A null ``canonical`` (unresolved name) does not enter the set.  The set is bounded by the
    number of logical events, whatever the session's length.  A session belongs to one user.
    """
    paid = F.when(F.col("payment_method").isNotNull(),
                  F.struct("event_ts", "payment_method"))
    rolled = events.groupBy("instance_id", "session_id", "user_id").agg(
        F.min("event_ts").alias("first_ts"),
        F.array_sort(F.collect_set("canonical")).alias("canon"),
        F.bool_or("is_crash").alias("has_crash"),
        F.min(paid)["payment_method"].alias("pay_method"),
    )
    return _label_period(rolled, cases).select(
        "instance_id", "session_id", "user_id", "day", "canon", "has_crash", "pay_method",
        "period")


def mask_name(number: int, mask: str = "stage_mask") -> str:
    """Column of the ``number``-th 62 names of a vocabulary: stage_mask, stage_mask_1, ..."""
    return mask if number == 0 else f"{mask}_{number}"


def holds(name: str, vocabulary: Sequence[str] = STAGES, mask: str = "stage_mask") -> str:
    """SQL condition: does the session's set hold ``name``?"""
    number, place = divmod(list(vocabulary).index(name), NAMES_PER_MASK)
    return f"({mask_name(number, mask)} & {1 << place}L) != 0"


def has(name: str, vocabulary: Sequence[str] = STAGES, mask: str = "stage_mask") -> Column:
    return F.expr(holds(name, vocabulary, mask))


def sql_text(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _masks_of(vocabulary: Sequence[str]) -> list[Column]:
    """One bit mask per 62 names."""
    out = []
    for at in range(0, max(1, len(vocabulary)), NAMES_PER_MASK):
        names = vocabulary[at:at + NAMES_PER_MASK]
        whens = " ".join(f"WHEN {sql_text(v)} THEN {1 << i}L" for i, v in enumerate(names))
        out.append(F.expr(f"CASE canonical {whens} ELSE 0L END") if names else F.lit(0).cast("long"))
    return out


def _first_method(methods: Sequence[str]) -> tuple[Column, Column, Column]:
    """Two aggregates and the first payment method they give: earliest, then alphabetical.

    For the listed methods time and place in the alphabet are packed in one integer.  Any other
    method stays text; its minimum is taken with its time, and the two are compared at the end.
    """
    known = sorted(methods)
    slots = max(1, len(known))
    codes = " ".join(f"WHEN {sql_text(m)} THEN {i}L" for i, m in enumerate(known))
    code = F.expr(f"CASE payment_method {codes} END") if known else F.lit(None).cast("long")
    packed = wall_micros(F.col("event_ts")) * F.lit(slots) + code
    other = F.when(F.col("payment_method").isNotNull() & code.isNull(), F.struct(
        wall_micros(F.col("event_ts")).alias("at"), F.col("payment_method").alias("method")))
    listed = ", ".join(map(sql_text, known or [""]))
    method = F.expr(f"element_at(array({listed}), CAST(pmod(packed, {slots}) AS INT) + 1)")
    first = F.when(F.col("packed").isNotNull(), F.struct(
        F.floor(F.expr(f"(packed - pmod(packed, {slots})) div {slots}")).alias("at"),
        method.alias("method")))
    return F.min(packed).alias("packed"), F.min(other).alias("other"), F.least(first, F.col("other"))


def session_flags(
    events: DataFrame,
    cases: DataFrame,
    *,
    vocabulary: Sequence[str] = STAGES,
    methods: Sequence[str] = PAYMENT_METHODS,
    closed: bool = False,
) -> DataFrame:
    """Fixed-width roll-up: bit masks (``stage_mask``, one more per 62 names) instead of the set.

    User attributes already on the events are carried along: they depend on the user alone,
    so as extra grouping keys they add no rows and save the join with ``users``.  The first
    payment method is the earliest, ties going to the alphabet, as in :func:`session_rollup`.
    ``methods`` are expected ones, which are compared as numbers; any other is kept as well, at
    the price of a text in the aggregation.  ``closed`` promises that there is no other.
    A session belongs to one user; where its rows name several, each is a session, in both forms.
    """
    carried = [c for c in USER_ATTRIBUTES if c in events.columns]
    packed, other, method = _first_method(methods)
    masks = [F.bit_or(m).alias(mask_name(i)) for i, m in enumerate(_masks_of(vocabulary))]
    extra = [] if closed else [other]
    rolled = events.groupBy("instance_id", "session_id", "user_id", *carried).agg(
        F.min("event_ts").alias("first_ts"), *masks, F.bool_or("is_crash").alias("has_crash"),
        packed, *extra)
    if closed:
        rolled = rolled.withColumn("other", F.lit(None).cast("struct<at:bigint,method:string>"))
    return _label_period(rolled, cases).withColumn("pay_method", method["method"]).drop(
        "packed", "other")


def attach_users(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """Look up user attributes per session (after the roll-up, when few rows are left)."""
    sessions = sessions.drop(*USER_ATTRIBUTES)       # what some events carried gives way
    wanted = small_side(users.select("instance_id", "user_id", *USER_ATTRIBUTES))
    return sessions.join(wanted, ["instance_id", "user_id"], "left")
