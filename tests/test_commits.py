"""Publishing as one commit, and records that keep their types."""

import datetime as dt

import pytest
from conftest import SF_TINY, rows
from pyspark.sql import functions as F

from stepfall import schemas
from stepfall.plans import catalog, jobs
from stepfall.sources import commits, tables
from stepfall.sources.retail import ClickWarehouse


@pytest.fixture(scope="module")
def warehouse(spark):
    return ClickWarehouse(spark, SF_TINY)


def publish(w, case, root, persona, target=None):
    one = F.col("instance_id") == case
    users = w.users.filter(one).withColumn("persona", F.lit(persona))
    answers = w.answers.filter(one)
    if target is not None:
        answers = answers.withColumn("severity_pp_target", F.lit(target))
    return jobs.publish_cases(w.raw_events.filter(one), users, w.cases.filter(one), answers,
                              f"{root}/public", f"{root}/restricted", cohorts=catalog.COHORTS)


def state(spark, root):
    public, restricted = f"{root}/public", f"{root}/restricted"
    found = {
        "events": tables.read_table(spark, public, "events"), "users": tables.read_table(spark, public, "users"),
        "index": tables.read_index(spark, public), "tasks": tables.read_tasks(spark, f"{public}/tasks"),
        "gold_users": tables.read_gold_users(spark, restricted), "gold": tables.read_gold_headers(spark, restricted),
        "hidden": tables.read_index(spark, restricted), "personas": tables.read_personas(spark, restricted)}
    return {name: sorted(map(str, df.collect())) for name, df in found.items()}


WRITES = ["write_public", "write_gold_users", "write_records_by_case", "write_personas"]


def test_a_failed_publish_changes_nothing(spark, warehouse, tmp_path, monkeypatch):
    publish(warehouse, "case_0", tmp_path, "p")
    before = state(spark, tmp_path)
    assert all(before[t] for t in before if t != "gold_users")
    for broken in [*WRITES, "publish"]:
        with monkeypatch.context() as m:
            home = commits if broken == "publish" else tables
            real = getattr(home, broken)

            def fail(*args, **kw):
                if broken not in ("publish", "write_public"):
                    real(*args, **kw)        # the table is there, the ones behind it are not
                raise OSError("lost")
            m.setattr(home, broken, fail)
            with pytest.raises(OSError, match="lost"):
                publish(warehouse, "case_0", tmp_path, "q", target=99.0)
        assert state(spark, tmp_path) == before, broken
    publish(warehouse, "case_0", tmp_path, "q", target=99.0)
    after = state(spark, tmp_path)
    assert after["events"] == before["events"] and after["personas"] != before["personas"]
    assert "severity_pp_target=99.0" in after["gold"][0] and "99.0" in after["hidden"][0]
    assert len(after["tasks"]) == len(after["gold"]) == 1
    dead = commits.replaced(spark, f"{tmp_path}/restricted", "personas")
    assert {r.instance_id for r in dead.collect()} == {"case_0"} and dead.count() >= 2


def test_other_cases_keep_their_commit(spark, warehouse, tmp_path):
    for case in ("case_0", "case_1", "case_0"):
        publish(warehouse, case, tmp_path, case)
    log = commits.commit_log(spark, f"{tmp_path}/public")
    assert rows(log, "sequence", "instance_id") == [(1, "case_0"), (2, "case_1"), (3, "case_0")]
    live = dict(rows(commits.live_cases(log), "instance_id", "commit"))
    assert live["case_0"] != live["case_1"]
    users = tables.read_table(spark, f"{tmp_path}/public", "users")
    assert users.schema == schemas.USERS and users.count() == users.distinct().count()
    one = tables.read_table(spark, f"{tmp_path}/public", "events", ["case_1"])
    assert one.count() == warehouse.raw_events.filter("instance_id = 'case_1'").count()
    assert "commit" in one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]


def test_nothing_is_visible_before_the_first_commit(spark, warehouse, tmp_path, monkeypatch):
    def fail(*args, **kw):
        raise OSError("lost")
    monkeypatch.setattr(commits, "publish", fail)
    with pytest.raises(OSError):
        publish(warehouse, "case_0", tmp_path, "p")
    assert not any(state(spark, tmp_path).values())


def test_a_restricted_root_follows_one_leader(spark, tmp_path):
    commits.follow(spark, str(tmp_path), "a")
    commits.follow(spark, str(tmp_path), "a")
    with pytest.raises(ValueError, match="follows a"):
        commits.follow(spark, str(tmp_path), "b")


KINDS = ("instance_id string, seed long, fault string, base_date date, mix map<string,double>, "
         "tags array<string>, n int")


def test_records_keep_ids_types_and_empty_columns(spark, tmp_path):
    day = dt.date(2026, 6, 1)
    made = spark.createDataFrame([("001", 7, None, day, {"a": 0.5}, ["x"], 1), ("1", 8, None, None, None, [], None),
                                  ("2026-01-01", 9, None, day, {}, None, 3)], KINDS)
    path = f"{tmp_path}/gold"
    tables.write_records_by_case(made, path)
    back = tables.read_records(spark, path)
    assert back.schema == made.schema
    assert sorted(map(str, back.collect())) == sorted(map(str, made.collect()))
    assert sorted(map(str, tables.read_gold_headers(spark, str(tmp_path)).collect())) == sorted(map(str, made.collect()))
    # a later batch with one more column, and one column less
    more = spark.createDataFrame([("003", 5, "slow", "n")], "instance_id string, seed long, fault string, notes string")
    tables.write_records_by_case(more, path)
    both = tables.read_records(spark, path)
    assert rows(both, "instance_id", "fault", "notes") == [
        ("001", None, None), ("003", "slow", "n"), ("1", None, None), ("2026-01-01", None, None)]
    with pytest.raises(ValueError, match="seed is stored as bigint"):
        tables.write_records_by_case(more.withColumn("seed", F.lit("x")), path)


def test_typed_ids_of_parquet_tables(spark, tmp_path):
    ids = spark.createDataFrame([("001", "01"), ("1", "1")], "instance_id string, user_id string")
    tables.write_gold_users(ids, str(tmp_path))
    assert rows(tables.read_gold_users(spark, str(tmp_path)), "instance_id", "user_id") == [("001", "01"), ("1", "1")]
    tables.write_personas(ids.withColumn("persona", F.lit("p")), str(tmp_path))
    assert rows(tables.read_personas(spark, str(tmp_path)), "instance_id") == [("001",), ("1",)]


def test_records_from_elsewhere(spark, tmp_path):
    (tmp_path / "index" / "instance_id=007").mkdir(parents=True)
    (tmp_path / "index" / "instance_id=007" / "a.json").write_text('{"base_date": "2026-06-01"}\n')
    assert rows(tables.read_index(spark, str(tmp_path)), "instance_id", "base_date") == [("007", dt.date(2026, 6, 1))]
    with pytest.raises(ValueError, match="no stored schema"):
        tables.read_records(spark, f"{tmp_path}/index")
