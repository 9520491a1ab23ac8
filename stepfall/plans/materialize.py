"""Cutting lineage at points where several results share an intermediate table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir``.

    Where the session names none, a folder in the warehouse serves, which is shared as well.
    """
    named = (spark.conf.get("spark.checkpoint.dir", None)
             or spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    if not named:
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/stepfall-shared"
    return named.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new folder name of its own under the shared folder."""
    return f"{shared_folder(spark)}/stepfall/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    Each call makes a folder of its own under ``stepfall/``, which the owner of the shared
    folder may clear when no job is running.  Unlike a cache it survives lost executors, and
    unlike an RDD checkpoint it keeps file sizes, so later joins still know which side is small.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
