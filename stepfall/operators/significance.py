"""How sure a scan's findings are: tail probabilities and control of false discoveries.

A scan asks thousands of questions at once, so some answers look striking by chance.  The step-up
procedure of Benjamini and Hochberg gives every row the share of false findings one accepts when
that row and all stronger ones are called findings.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Chebyshev fit of the complementary error function, relative error below 1.2e-7.
ERFC_FIT = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398,
            1.48851587, -0.82215223, 0.17087277)

BINS_PER_OCTAVE = 32
LEAST_BIN = -64 * BINS_PER_OCTAVE


def normal_tail(z: Column) -> Column:
    """Probability that a standard normal value exceeds ``z``; null stays null."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + x / 2)
    fit = reduce(lambda inner, c: F.lit(c) + t * inner, reversed(ERFC_FIT[:-1]), F.lit(ERFC_FIT[-1]))
    half = t * F.exp(fit - x * x) / 2
    return F.when(z >= 0, half).otherwise(F.lit(1.0) - half)


def _meet(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join by columns in which null meets null."""
    right = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    alike = [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in on]
    return left.join(right, reduce(Column.__and__, alike, F.lit(True)), how).drop(*(f"_right_{c}" for c in on))


def step_up(tests: DataFrame, *, keys: Sequence[str] = ("instance_id",), p: str = "p",
            alpha: float = 0.05) -> DataFrame:
    """``tests`` with ``q``, the adjusted probability within its keys, and ``discovery`` (q <= alpha).

    Rows whose ``p`` is null or no number are no tests: they count nowhere, their ``q`` is null and
    they are no discovery.  Equal probabilities get equal ``q``; null keys form one group.

    No task sees all rows of a group: equal probabilities are counted first; ranks within
    a bin of probabilities (1/32 of an octave) come from a window over that bin, and only the at most
    2,114 bins of a group meet to add up the ranks before and the least value behind.
    """
    value = F.col(p).cast("double")
    asked = tests.withColumn("_p", F.when(~F.isnan(value), value))
    octave = F.floor(F.log2("_p") * BINS_PER_OCTAVE)
    # a filter on _p itself would be pushed below the caller's projections and repeat their expressions
    counted = (
        asked.groupBy(*keys, "_p").agg(F.count("_p").alias("_n")).filter("_n > 0")
        .withColumn("_bin", F.when(F.col("_p") > 0, F.least(F.greatest(octave, F.lit(LEAST_BIN)),
                                                           F.lit(2 * BINS_PER_OCTAVE)))
                    .otherwise(F.lit(LEAST_BIN - 1))))
    by_bin = Window.partitionBy(*keys).orderBy("_bin")
    in_bin = Window.partitionBy(*keys, "_bin").orderBy("_p")
    bins = counted.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_held")).select(
        *keys, "_bin",
        F.coalesce(F.sum("_held").over(by_bin.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_held").over(Window.partitionBy(*keys)).alias("_m"))
    ranked = _meet(counted, bins, [*keys, "_bin"]).withColumn(
        "_rank", F.col("_before") + F.sum("_n").over(in_bin.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "_raw", F.col("_p") * F.col("_m") / F.col("_rank"))
    down = Window.partitionBy(*keys).orderBy(F.col("_bin").desc())
    behind = ranked.groupBy(*keys, "_bin").agg(F.min("_raw").alias("_least")).select(
        *keys, "_bin", F.min("_least").over(down.rowsBetween(Window.unboundedPreceding, -1)).alias("_behind"))
    in_bin_down = Window.partitionBy(*keys, "_bin").orderBy(F.col("_p").desc())
    adjusted = _meet(ranked, behind, [*keys, "_bin"]).select(*keys, "_p", F.least(
        F.lit(1.0), "_behind",
        F.min("_raw").over(in_bin_down.rowsBetween(Window.unboundedPreceding, 0))).alias("q"))
    return _meet(asked, adjusted, [*keys, "_p"], "left").drop("_p").withColumn(
        "discovery", F.coalesce(F.col("q") <= alpha, F.lit(False)))
