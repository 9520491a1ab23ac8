"""Day index, period and recent-window expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_index(ts: Column, base_date: Column) -> Column:
    """Whole days from midnight of ``base_date`` to ``ts``."""
    return F.datediff(F.to_date(ts), base_date)


def period_of(day: Column, changepoint_day: Column) -> Column:
    return F.when(day >= changepoint_day, F.lit("post")).otherwise(F.lit("pre"))


def is_recent(ts: Column, base_date: Column, changepoint_day: Column) -> Column:
    """Event-time test: at or after midnight of the changepoint day.

    The raw timestamp is compared, so that the scan can use it.
    """
    return ts >= F.date_add(base_date, changepoint_day).cast("timestamp_ntz")


def wall_micros(ts: Column) -> Column:
    """Microseconds of the wall-clock reading; unlike ``unix_micros`` no session zone enters."""
    return (
        F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
        * F.lit(86_400_000_000)
        + F.hour(ts).cast("bigint") * F.lit(3_600_000_000)
        + F.minute(ts).cast("bigint") * F.lit(60_000_000)
        + (F.extract(F.lit("SECOND"), ts) * F.lit(1_000_000)).cast("bigint")
    )
