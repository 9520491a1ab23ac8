"""Small helpers that several operators of this package share."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are maximal runs of anything but space, tab and the line separators 0A to 0D.
WORD = r"[^\x20\x09-\x0D]+"


BATCH_ROWS = 4000            # rows of an Arrow batch: texts in a Python worker stay within some megabytes
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepared(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where it is run from a folder, and keep batches small."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, *paths]))
    if not 0 < int(spark.conf.get(_BATCH_SETTING, "0")) <= BATCH_ROWS:
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by Spark's own reader."""
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def packed(docs: DataFrame, **keys: Column) -> DataFrame:
    """All columns of ``docs`` in one struct ``_row`` beside derived key columns.

    Whatever names the caller's columns have, they cannot clash with an operator's own.
    """
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                       *[c.alias(k) for k, c in keys.items()])
