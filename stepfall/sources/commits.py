"""Publishing several tables as one commit, and the schemas of stored records.

A commit writes every table into a folder of its own (``<table>/commit=<name>/instance_id=<case>``) and ends
with one file of rows (sequence, commit, case) in ``_commits``.  That file appears at once or not at
all, and readers follow it: of each case they see the newest commit listed there.  A publish that
fails before its last step leaves folders nobody reads.

The restricted root has no list of its own: its ``_follows`` names the root whose list counts, so
both roots turn to a commit at the same moment.

JSON records keep their schema beside them (``_schema``): ids such as ``001`` stay text and columns
without a value stay columns.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepfall.plans.joins import small_side

CASE = "instance_id"
COMMIT = "commit"
LOG = "sequence long, commit string, instance_id string"


def _absent(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def new_commit() -> str:
    """A name that partition discovery takes for text."""
    return f"c{uuid.uuid4().hex}"


def follow(spark: SparkSession, root: str, leader: str) -> None:
    """Let readers of ``root`` follow the commits of ``leader``."""
    known = _leader(spark, root)
    if known is None:
        spark.createDataFrame([(leader,)], "value string").coalesce(1).write.mode("append").text(f"{root}/_follows")
    elif known != leader:
        raise ValueError(f"{root} follows {known}")


def _leader(spark: SparkSession, root: str) -> str | None:
    try:
        line = spark.read.text(f"{root}/_follows").first()
    except AnalysisException as error:
        if _absent(error):
            return None
        raise
    return line.value if line is not None else None


def commit_log(spark: SparkSession, root: str) -> DataFrame | None:
    """All commits of a root, by case; None where nothing was ever committed."""
    try:
        return spark.read.schema(LOG).json(f"{_leader(spark, root) or root}/_commits")
    except AnalysisException as error:
        if _absent(error):
            return None
        raise


def live_cases(log: DataFrame) -> DataFrame:
    """The newest commit of every case."""
    return log.groupBy(CASE).agg(F.max(F.struct("sequence", COMMIT)).alias("last")).select(
        CASE, F.col(f"last.{COMMIT}").alias(COMMIT))


def publish(spark: SparkSession, root: str, commit: str, cases: DataFrame) -> None:
    """Make a commit visible: all its cases at once."""
    log = commit_log(spark, root)
    last = log.agg(F.max("sequence")).scalar() if log is not None else F.lit(None)
    (cases.select(CASE).distinct()
     .select((F.coalesce(last, F.lit(0)) + 1).cast("long").alias("sequence"), F.lit(commit).alias(COMMIT), CASE)
     .coalesce(1).write.mode("append").json(f"{root}/_commits"))


def visible(spark: SparkSession, root: str, stored: DataFrame) -> DataFrame:
    """Rows of live commits, without the commit's column; tables that were never committed as they are."""
    if COMMIT not in stored.columns:
        return stored
    log = commit_log(spark, root)
    if log is None:                      # folders of a first commit that never came to its end
        return stored.filter(F.lit(False)).drop(COMMIT)
    live = live_cases(log)
    # the few commits still in use prune the scan; the join drops cases that a later one replaced
    used = [r[0] for r in live.select(COMMIT).distinct().collect()]
    return stored.filter(F.col(COMMIT).isin(*used)).join(
        small_side(live), [COMMIT, CASE], "left_semi").drop(COMMIT)


def replaced(spark: SparkSession, root: str, table: str) -> DataFrame:
    """(commit, case) folders of a table that no reader looks at any more, for whoever clears them."""
    log = commit_log(spark, root)
    stored = spark.read.schema(f"{COMMIT} string, {CASE} string").parquet(f"{root}/{table}")
    folders = stored.select(COMMIT, CASE).distinct()
    return folders if log is None else folders.join(live_cases(log), [COMMIT, CASE], "left_anti")


# --- schemas of stored records --------------------------------------------------------------

def merged(a: T.StructType, b: T.StructType) -> T.StructType:
    """Fields of both, those of ``a`` first; a field of two kinds is an error."""
    kinds = {f.name: f.dataType for f in a}
    for f in b:
        if f.name in kinds and kinds[f.name] != f.dataType:
            raise ValueError(f"{f.name} is stored as {kinds[f.name].simpleString()}, not {f.dataType.simpleString()}")
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in [*a, *(f for f in b if f.name not in kinds)]])


def stored_schema(spark: SparkSession, path: str) -> T.StructType | None:
    """The schema that was stored with records; None where there is none."""
    try:
        lines = spark.read.text(f"{path}/_schema").distinct().collect()
    except AnalysisException as error:
        if _absent(error):
            return None
        raise
    out = T.StructType([])
    for line in sorted(r.value for r in lines):
        out = merged(out, T.StructType.fromJson(json.loads(line)))
    return out


def keep_schema(df: DataFrame, path: str) -> None:
    """Store the schema of ``df`` with its records, before they are written."""
    spark = df.sparkSession
    known = stored_schema(spark, path)
    plain = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])
    if known is None or len(merged(known, plain)) > len(known):
        spark.createDataFrame([(plain.json(),)], "value string").coalesce(1).write.mode("append").text(
            f"{path}/_schema")
