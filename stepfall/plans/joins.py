"""Join policy.

``broadcast`` is only ever asked for a side whose planned size is known and below a limit.
Beyond it the join is left plain: Spark shuffles both sides and adaptive execution splits
skewed partitions, so a hot key costs more tasks and not a bigger one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_LIMIT_BYTES = 16 * 1024 * 1024


def planned_bytes(df: DataFrame) -> int | None:
    """Optimizer's size estimate; None where the session cannot tell (runs no job)."""
    try:
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        return int(str(stats.sizeInBytes()))
    except Exception:
        return None


def small_side(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast when its estimate is within ``limit``; else return it as is."""
    size = planned_bytes(df)
    return F.broadcast(df) if size is not None and size <= limit else df


def with_cases(df: DataFrame, cases: DataFrame, *columns: str) -> DataFrame:
    """Attach per-case columns.  The case table holds one row per case."""
    return df.join(small_side(cases.select("instance_id", *columns)), "instance_id")
