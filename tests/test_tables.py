import json

import pytest
from conftest import SF_TINY, rows
from pyspark.sql import functions as F

from stepfall import schemas
from stepfall.operators import answers
from stepfall.sources import tables
from stepfall.sources.retail import ClickWarehouse


@pytest.fixture(scope="module")
def warehouse(spark):
    return ClickWarehouse(spark, SF_TINY)


def test_round_trip_and_case_pruning(spark, warehouse, tmp_path):
    root = str(tmp_path)
    tables.write_public(warehouse.raw_events, warehouse.users, root)
    back = tables.read_table(spark, root, "events")
    assert back.schema == schemas.EVENTS
    assert back.exceptAll(tables.publish_events(warehouse.raw_events, warehouse.users)).count() == 0
    assert back.count() == warehouse.raw_events.count()
    one = tables.read_table(spark, root, "events", ["case_1"])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(instance_id" in plan or "instance_id#" in plan.split(
        "PartitionFilters: [")[1].split("]")[0]
    assert one.count() == warehouse.raw_events.filter("instance_id = 'case_1'").count()


def test_rewriting_one_case_keeps_the_others(spark, warehouse, tmp_path):
    root = str(tmp_path)
    tables.write_public(warehouse.raw_events, warehouse.users, root)
    only = warehouse.raw_events.filter("instance_id = 'case_1'").limit(5)
    for _ in range(2):      # a rerun ends in the same state
        tables.write_public(only, warehouse.users.filter("instance_id = 'case_1'"), root)
    counts = dict(rows(tables.scan_case(tables.read_table(spark, root, "events")),
                       "instance_id", "n_events"))
    whole = dict(rows(tables.scan_case(warehouse.raw_events), "instance_id", "n_events"))
    assert counts == {**whole, "case_1": 5}


def test_guard_refuses_answer_columns(warehouse, tmp_path):
    leaky = warehouse.users.withColumn("persona", F.lit("p"))
    assert tables.leak_guard(events=warehouse.raw_events, users=leaky) == {
        "events": ["canonical"], "users": ["persona"]}
    with pytest.raises(schemas.ForbiddenColumns):
        schemas.require_public("users", leaky)
    assert "persona" not in tables.publish_users(leaky.withColumn("_acq_day", F.lit(1))).columns
    assert "canonical" not in tables.publish_events(warehouse.raw_events, warehouse.users).columns
    with pytest.raises(schemas.ForbiddenColumns):
        tables.publish_events(warehouse.raw_events.withColumn("persona", F.lit("p")), warehouse.users)


def test_unknown_users_keep_null_attributes(make_events, make_users):
    events = make_events([("s", "u1", "1 1:00", "x"), ("s", "ghost", "1 1:00", "x")])
    got = tables.denormalise(events, make_users([("u1", dict(geo="E"))]))
    assert rows(got, "user_id", "geo") == [("ghost", None), ("u1", "E")]


def test_answer_files(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"gold_{i}.json").write_text(json.dumps(
            {"instance_id": f"c{i}", "has_fault": i == 1, "fault_type": "dead_screen",
             "affected_user_ids": ["u1", "u2"] if i == 1 else [], "severity_pp_target": 8.0,
             "persona_mix": {"a": 0.5}}, indent=2))
    gold = tables.read_gold(spark, str(tmp_path), whole_files=True)
    assert rows(gold, "instance_id", "has_fault") == [("c1", True), ("c2", False)]
    assert rows(tables.gold_users(gold), "user_id") == [("u1",), ("u2",)]


def test_answer_ids_are_written_sorted(spark, tmp_path):
    ids = spark.range(500).select(F.lit("a").alias("instance_id"),
                                  F.format_string("u%05d", F.col("id") * 7 % 500).alias("user_id"))
    tables.write_gold_users(ids, str(tmp_path))
    files = sorted((tmp_path / "gold_users" / "instance_id=a").glob("*.parquet"))
    got = [r.user_id for f in files for r in spark.read.parquet(str(f)).collect()]
    assert got == [f"u{i:05d}" for i in range(500)]


def test_dictionary_tasks_and_maps(spark, warehouse, cases, tmp_path):
    from stepfall.operators import names
    entries = names.dictionary_entries(warehouse.surface_forms)
    tables.write_records(entries, f"{tmp_path}/dictionary")
    back = tables.read_dictionary(spark, f"{tmp_path}/dictionary")
    assert back.schema == schemas.DICTIONARY and back.exceptAll(entries).count() == 0
    tables.write_records(answers.task_records(cases), f"{tmp_path}/tasks")
    tasks = tables.read_tasks(spark, f"{tmp_path}/tasks")
    assert rows(tasks, "instance_id", "changepoint_day") == [("a", 14), ("b", 14)]
    mapping = names.canonical_map(warehouse.surface_forms)
    tables.write_map(mapping, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/canonical_map").count() == mapping.count()
    people = warehouse.user_rows.withColumn("persona", F.lit("p"))
    tables.write_personas(people, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/personas").count() == people.count()
    tables.register(names_seen=mapping)
    assert spark.sql("SELECT count(*) AS n FROM names_seen").collect()[0].n == mapping.count()
    tagged = tables.tagged(mapping, "z")
    assert tagged.select("instance_id").distinct().collect()[0][0] == "z"


def test_records_have_a_known_size(spark, cases):
    from stepfall.plans.joins import planned_bytes
    assert planned_bytes(cases) < 10_000


def test_conform_names_what_is_missing(spark):
    with pytest.raises(ValueError, match="acquired_ts"):
        schemas.conform(spark.createDataFrame([("u",)], "user_id string"), schemas.USERS)
