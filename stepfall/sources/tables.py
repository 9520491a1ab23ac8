"""Reading and writing the warehouse: a public root and a restricted root.

All cases live in one table partitioned by ``instance_id``, so opening one case is partition
pruning.  A root is written in one of two ways: table by table, where a write replaces only the cases it holds
(dynamic partition overwrite) and a rerun ends in the same state; or by commits (``commits``), where
all tables of a publish are seen together or not at all.  Readers find out by themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from stepfall import schemas
from stepfall.plans.joins import small_side
from stepfall.schemas import conform, require_public
from stepfall.sources import commits

CASE = "instance_id"


# --- readers ------------------------------------------------------------------------------

def read_table(spark: SparkSession, root: str, name: str,
               cases: Sequence[str] | None = None) -> DataFrame:
    """``events`` or ``users`` of some cases (all by default)."""
    schema = {"events": schemas.EVENTS, "users": schemas.USERS}[name]
    df = commits.visible(spark, root, spark.read.schema(schema).parquet(f"{root}/{name}"))
    df = df.select(*schema.names)
    return df if cases is None else df.filter(F.col(CASE).isin(*cases))


def scan_case(events: DataFrame) -> DataFrame:
    """What each case holds: rows and first and last event."""
    return events.groupBy(CASE).agg(
        F.count("*").alias("n_events"), F.min("event_ts").alias("first_ts"),
        F.max("event_ts").alias("last_ts"))


def _json(spark: SparkSession, path: str, schema: T.StructType, whole_files: bool = False) -> DataFrame:
    root = path.rstrip("/").rpartition("/")[0]
    return commits.visible(spark, root, spark.read.schema(schema).option("multiLine", whole_files).json(path))


def read_records(spark: SparkSession, path: str, known: T.StructType | None = None) -> DataFrame:
    """Records as :func:`write_records_by_case` stored them, with the schema stored beside them.

    ``known`` serves where records came from elsewhere and have none.
    """
    schema = commits.stored_schema(spark, path) or known
    if schema is None:
        raise ValueError(f"{path} has no stored schema")
    return _json(spark, path, schema).select(*schema.names)


def read_gold(spark: SparkSession, path: str, *, whole_files: bool = False) -> DataFrame:
    """All answer records of a directory: JSON lines, by case or not.

    ``whole_files`` is for sets of files with one (pretty-printed) object each.
    """
    return _json(spark, path, schemas.GOLD, whole_files)


def read_gold_headers(spark: SparkSession, root: str) -> DataFrame:
    """The answer records that :func:`write_records_by_case` stored under ``gold``."""
    return read_records(spark, f"{root}/gold", schemas.GOLD)


def read_gold_users(spark: SparkSession, root: str) -> DataFrame:
    """The answer ids of all published cases."""
    stored = spark.read.schema(schemas.GOLD_USERS).parquet(f"{root}/gold_users")
    return commits.visible(spark, root, stored).select(*schemas.GOLD_USERS.names)


def read_personas(spark: SparkSession, root: str) -> DataFrame:
    """The restricted personas of all published cases."""
    stored = spark.read.schema(schemas.PERSONAS).parquet(f"{root}/personas")
    return commits.visible(spark, root, stored).select(*schemas.PERSONAS.names)


def read_index(spark: SparkSession, root: str) -> DataFrame:
    """The stored index of published cases (public or restricted, by the root)."""
    return read_records(spark, f"{root}/index", schemas.INDEX)


def gold_users(gold: DataFrame) -> DataFrame:
    """Answer ids as rows."""
    return gold.select(CASE, F.explode("affected_user_ids").alias("user_id"))


def read_tasks(spark: SparkSession, path: str, *, whole_files: bool = False) -> DataFrame:
    """Task records, JSON lines by default (see :func:`read_gold`)."""
    return _json(spark, path, schemas.TASK, whole_files)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.DICTIONARY).json(path)


def read_hypotheses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.HYPOTHESES).json(path)


def records(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType) -> DataFrame:
    """Small in-memory records as a table (case lists, fixtures, hand-written answers).

    Goes through Arrow, which makes a local relation: its size is known to the optimizer, so
    joins with it broadcast, which a list of Python rows would not get.
    """
    columns = [[row[i] for row in rows] for i in range(len(schema.fields))]
    arrow = to_arrow_schema(schema)
    table = pa.Table.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)
    return spark.createDataFrame(table, schema=schema)


def case_index(events: DataFrame) -> DataFrame:
    """Cases present in a table."""
    return events.select(CASE).distinct()


# --- public projections -------------------------------------------------------------------

def denormalise(events: DataFrame, users: DataFrame) -> DataFrame:
    """Copy user attributes onto events; events of unknown users keep nulls.

    A user table of checked small size is broadcast.  Otherwise both sides are hashed by (case,
    user): one heavy user is a skewed partition, which adaptive execution splits, since users
    have one row per id.
    """
    wanted = small_side(users.select(CASE, "user_id", *schemas._ATTRIBUTES))
    return events.drop(*schemas._ATTRIBUTES).join(wanted, [CASE, "user_id"], "left")


def publish_events(events: DataFrame, users: DataFrame) -> DataFrame:
    """Public event rows: no logical event, user attributes on."""
    public = denormalise(events.drop("canonical"), users)
    return conform(require_public("events", public), schemas.EVENTS)


def publish_users(users: DataFrame) -> DataFrame:
    """Public user rows: internal (``_``) and answer columns are left behind."""
    visible = users.select(*(c for c in users.columns if not c.startswith("_")))
    return require_public("users", conform(visible, schemas.USERS))


def tagged(df: DataFrame, instance_id: str) -> DataFrame:
    """Tag the rows of a single case."""
    return df.withColumn(CASE, F.lit(instance_id))


def leak_guard(**tables: DataFrame) -> dict[str, list[str]]:
    """Forbidden columns per table (empty lists when clean); reads schemas only."""
    return {name: schemas.forbidden_in(df) for name, df in tables.items()}


# --- writers ------------------------------------------------------------------------------
# With ``commit`` a table goes to that commit's folder, which readers see once it is published.

def _by_case(df: DataFrame, path: str, commit: str | None):
    """Writer of a table by case, and the path to write to."""
    if commit is not None:
        return df.write.mode("errorifexists").partitionBy(CASE), f"{path}/{commits.COMMIT}={commit}"
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    return writer.partitionBy(CASE), path


def _write_by_case(df: DataFrame, path: str, *order: str, commit: str | None = None) -> None:
    if order:
        # rows in this order: row groups then have narrow ranges, which a filter skips
        rows = df.repartitionByRange(CASE, *order).sortWithinPartitions(CASE, *order)
    else:
        # "rebalance" gathers a case into few files and splits a case that is too large for one
        rows = df.hint("rebalance", CASE)
    writer, path = _by_case(rows, path, commit)
    writer.parquet(path)


def write_public(events: DataFrame, users: DataFrame, root: str, *, commit: str | None = None) -> None:
    """Write the public ``events`` and ``users`` of the cases at hand, after the guard."""
    public_events, public_users = publish_events(events, users), publish_users(users)
    _write_by_case(public_events, f"{root}/events", "event_ts", commit=commit)
    _write_by_case(public_users, f"{root}/users", commit=commit)


def write_restricted(df: DataFrame, root: str, name: str, *, commit: str | None = None) -> None:
    """Restricted table by case: ``personas``, ``gold_users``, ``answer_index`` and so on."""
    _write_by_case(df, f"{root}/{name}", commit=commit)


def write_personas(users: DataFrame, root: str, *, commit: str | None = None) -> None:
    write_restricted(users.select(*schemas.PERSONAS.names), root, "personas", commit=commit)


def write_gold_users(planted: DataFrame, root: str, *, commit: str | None = None) -> None:
    """Answer ids as a globally sorted table: within a case, files and rows follow the id."""
    _write_by_case(planted.select(CASE, "user_id"), f"{root}/gold_users", "user_id", commit=commit)


def write_records(df: DataFrame, path: str) -> None:
    """JSON lines of a table that is replaced as a whole, such as the dictionary."""
    df.write.mode("overwrite").json(path)


def write_records_by_case(df: DataFrame, path: str, *, commit: str | None = None) -> None:
    """JSON lines by case with their schema: gold headers, tasks and indexes; other cases keep what they have."""
    if df.columns == [CASE]:                 # a file must hold something beside the case
        df = df.withColumn("published", F.lit(True))
    commits.keep_schema(df, path)
    writer, path = _by_case(df.hint("rebalance", CASE), path, commit)
    # a column without any value is still written, so a record says all it has
    writer.option("ignoreNullFields", False).json(path)


def write_map(mapping: DataFrame, root: str) -> None:
    mapping.select("event_name", "canonical").write.mode("overwrite").parquet(
        f"{root}/canonical_map")


def register(**tables: DataFrame) -> None:
    """Expose DataFrames to SQL under the given names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
