"""Rates, percentage points and set-overlap measures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate(hits: Column, base: Column) -> Column:
    """``hits / base``; null when the base is zero."""
    return F.try_divide(hits.cast("double"), base.cast("double"))


def realised_pp(pre: Column, post: Column) -> Column:
    """Drop in percentage points, 2 digits; 0.0 when either side was not measurable."""
    return F.coalesce(F.round(F.lit(100.0) * (pre - post), 2), F.lit(0.0))


def shown_pct(value: Column) -> Column:
    return F.round(F.lit(100.0) * F.coalesce(value, F.lit(0.0)), 1)


def precision_recall_f1(claimed: Column, planted: Column, both: Column) -> tuple[Column, ...]:
    """Precision, recall and F1 of two id sets from their sizes, 3 digits.

    Two empty sets agree perfectly; one empty set scores zero.
    """
    empty = (claimed == 0) & (planted == 0)
    p = F.coalesce(rate(both, claimed), F.lit(0.0))
    r = F.coalesce(rate(both, planted), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(F.lit(2.0) * p * r, p + r), F.lit(0.0))
    return tuple(
        F.when(empty, F.lit(1.0)).otherwise(F.round(x, 3)) for x in (p, r, f1))


def two_proportion_z(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Pooled z of ``k1/n1 - k2/n2``; null when the variance is zero or a side is empty."""
    pooled = rate(k1 + k2, n1 + n2)
    variance = pooled * (F.lit(1.0) - pooled) * (
        F.try_divide(F.lit(1.0), n1.cast("double")) + F.try_divide(F.lit(1.0), n2.cast("double")))
    return F.try_divide(rate(k1, n1) - rate(k2, n2), F.sqrt(variance))
