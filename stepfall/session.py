"""Session settings the operators are tuned for.  Applied to a session the caller owns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stepfall.plans.joins import planned_bytes

# Adaptive execution sizes and splits shuffle partitions; forcing the skew-join rule lets it
# split a hot user or case even where the split costs one more shuffle.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m",
    # hash instead of sort-merge where every build partition is measured to be small (Spark asks
    # that this is no less than the advisory size)
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    # session sets are small; let more of them stay in the hash map before sorting
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "8192",
}
PARTITION_BYTES = 64 * 1024 * 1024


def partitions_for(input_bytes: int, least: int) -> int:
    """Shuffle partitions that stay near ``PARTITION_BYTES`` if all input were shuffled."""
    return max(least, -(-input_bytes // PARTITION_BYTES))


def tune(spark: SparkSession, largest: DataFrame | None = None) -> SparkSession:
    """Apply the settings; ``largest`` (the event table) sizes the first shuffle.

    Adaptive execution merges partitions that turn out small, so the number may start high.
    """
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    size = planned_bytes(largest) if largest is not None else None
    if size is not None:
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum",
                       str(partitions_for(size, least)))
    return spark
