import pytest
from conftest import SF_TINY, rows
from pyspark.sql import functions as F

from stepfall import schemas
from stepfall.operators import detect
from stepfall.plans import catalog, jobs
from stepfall.plans.joins import small_side
from stepfall.session import partitions_for, tune
from stepfall.sources import tables
from stepfall.sources.retail import ClickWarehouse


@pytest.fixture(scope="module")
def published(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("warehouse")
    public, restricted = f"{root}/public", f"{root}/restricted"
    w = ClickWarehouse(spark, SF_TINY)
    users = w.users.withColumn("persona", F.lit("p"))
    index = jobs.publish_cases(w.raw_events, users, w.cases, w.answers, public, restricted,
                               cohorts=catalog.COHORTS)
    return w, public, restricted, index


def test_published_cases(spark, published):
    w, public, restricted, index = published
    events = tables.read_table(spark, public, "events")
    assert events.count() == w.raw_events.count()
    assert not schemas.forbidden_in(spark.read.parquet(f"{public}/events"))
    assert not schemas.forbidden_in(spark.read.parquet(f"{public}/users"))
    planted = spark.read.parquet(f"{restricted}/gold_users")
    stored = {r.instance_id: r for r in spark.read.json(f"{restricted}/gold").collect()}
    sizes = dict(rows(planted.groupBy("instance_id").count(), "instance_id", "count"))
    assert {c: r.n_affected for c, r in stored.items()} == {
        c: sizes.get(c, 0) for c in ("case_0", "case_1", "case_2")}
    assert index.count() == 3 and stored["case_2"].affected_cohort_predicate == ""
    assert spark.read.parquet(f"{restricted}/personas").count() == w.users.count()
    assert tables.read_tasks(spark, f"{public}/tasks").count() == 3
    assert tables.read_gold_headers(spark, restricted).count() == 3
    assert {r.instance_id for r in tables.read_index(spark, public).collect()} == set(stored)


def test_a_second_batch_keeps_the_first(spark, tmp_path):
    """Two batches in turn; the package's own readers find both, and they score."""
    public, restricted = f"{tmp_path}/public", f"{tmp_path}/restricted"
    w = ClickWarehouse(spark, SF_TINY)
    for case in ("case_0", "case_1", "case_0"):
        one = F.col("instance_id") == case
        jobs.publish_cases(w.raw_events.filter(one), w.users.filter(one), w.cases.filter(one),
                           w.answers.filter(one), public, restricted, cohorts=catalog.COHORTS)
    both = {"case_0", "case_1"}
    names = lambda df: {r.instance_id for r in df.select("instance_id").distinct().collect()}
    gold = tables.read_gold_headers(spark, restricted)
    assert names(gold) == names(tables.read_index(spark, public)) == both
    assert names(tables.read_index(spark, restricted)) == both
    assert names(tables.read_table(spark, public, "events")) == both
    tasks = tables.read_tasks(spark, f"{public}/tasks")
    assert names(tasks) == both and tasks.count() == 2 and gold.count() == 2
    ran = jobs.run_suite(spark, public, w.cases.filter(F.col("instance_id").isin(*both)),
                         w.answers, tables.read_gold_users(spark, restricted))
    assert names(ran.scores) == both


def test_records_in_one_file_and_one_record_per_file(spark, tmp_path):
    answers = spark.createDataFrame([(f"case_{i}", [f"u{i}"]) for i in range(3)],
                                    "instance_id string, affected_user_ids array<string>")
    tables.write_records(answers.coalesce(1), f"{tmp_path}/lines")
    assert tables.read_gold(spark, f"{tmp_path}/lines").count() == 3
    assert tables.read_tasks(spark, f"{tmp_path}/lines").count() == 3
    (tmp_path / "files").mkdir()
    for i in range(2):
        (tmp_path / "files" / f"{i}.json").write_text('{\n "instance_id": "c%d"\n}' % i)
    assert tables.read_gold(spark, f"{tmp_path}/files", whole_files=True).count() == 2


def test_the_time_window_reaches_the_scan(spark, published):
    w, public, _, _ = published
    from stepfall.operators import symptoms
    recent = symptoms.recent_window(tables.read_table(spark, public, "events"), w.cases)
    recent.collect()
    plan = recent._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.split("\n") if "FileScan parquet" in line and "event_ts" in line)
    assert "GreaterThanOrEqual(event_ts" in scan or "event_ts#" in scan.split("DataFilters")[1].split("]")[0]
    by_hand = w.events.join(w.cases, "instance_id").filter("event_ts >= date_add(base_date, changepoint_day)")
    assert recent.count() == by_hand.count() > 0


def test_rejects_are_kept_apart(spark, published):
    w, public, restricted, _ = published
    made = w.answers.select(
        F.lit("x").alias("system"), "instance_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("rank"),
        F.lit("m").alias("mechanism"), F.lit("os = 'X'").alias("affected_cohort"),
        F.lit(None).cast(schemas.HYPOTHESES["evidence"].dataType).alias("evidence"),
        F.array().cast("array<string>").alias("confounders_considered"))
    made = made.withColumn("mechanism_type", F.when(F.col("rank") == 1, "a guess").otherwise(
        "innocent_dropoff")).withColumn("confidence", F.lit(0.5))
    ran = jobs.run_suite(spark, public, w.cases, w.answers, spark.read.parquet(
        f"{restricted}/gold_users"), systems=(), submitted={"x": made})
    assert set(rows(ran.rejects, "mechanism_type", "rank")) == {("a guess", 1)}
    assert set(rows(ran.hypotheses, "mechanism_type", "rank")) == {("innocent_dropoff", 1)}
    assert rows(ran.scores, "instance_id", "top1_correct") == [
        ("case_0", False), ("case_1", False), ("case_2", True)]


def test_answers_keep_what_they_say_about_the_making(spark, published):
    from stepfall.operators import answers, sessions
    w = published[0]
    told = w.answers.withColumn("seed", F.lit(7)).withColumn("notes", F.lit("n"))
    rows_ = sessions.attach_users(sessions.session_flags(w.raw_events, w.cases), w.user_rows)
    gold = answers.gold_record(told, rows_, answers.planted_users(rows_, told, catalog.COHORTS),
                               catalog.COHORTS)
    assert set(rows(gold, "seed", "notes")) == {(7, "n")}


def test_suite_on_stored_tables(spark, published):
    w, public, restricted, _ = published
    planted = spark.read.parquet(f"{restricted}/gold_users")
    perfect = w.answers.select(
        F.lit("x").alias("system"), "instance_id", F.lit(1).alias("rank"),
        F.col("acceptable_mechanisms")[0].alias("mechanism_type"), F.lit("m").alias("mechanism"),
        F.col("affected_cohort_predicate").alias("affected_cohort"),
        F.lit(None).cast(schemas.HYPOTHESES["evidence"].dataType).alias("evidence"),
        F.lit(0.9).alias("confidence"),
        F.array().cast("array<string>").alias("confounders_considered"))
    silent = perfect.limit(0)
    hypotheses, scores, summary, rejects = jobs.run_suite(
        spark, public, w.cases, w.answers, planted,
        submitted={"perfect": perfect, "silent": silent})
    assert scores.count() == 9 and rejects.count() == 0
    assert set(rows(hypotheses, "system")) == {("baseline",), ("perfect",)}
    got = {r.system: r for r in summary.collect()}
    assert got["silent"].top1 == 0 and got["silent"].n_cases == 3
    assert got["perfect"].false_positives == 0 and got["perfect"].n_fault == 2
    # nobody is planted in case_1 at this size, so its right predicate claims too much
    assert rows(scores.filter("system = 'perfect' AND has_fault"), "instance_id",
                "cohort_recall") == [("case_0", 1.0), ("case_1", 0.0)]
    one = jobs.run_suite(spark, public, w.cases, w.answers, planted, only=["case_2"]).scores
    assert rows(one, "system", "instance_id", "top1_correct") == [("baseline", "case_2", True)]


def test_symptom_view(published):
    w = published[0]
    view = jobs.symptom_view(w.events, w.cases)
    assert {k: v.count() > 0 for k, v in view.items()} == {
        "volume": True, "funnel": True, "by_os": True}


def test_a_new_detector_joins_the_registry(spark, published):
    w, public, restricted, _ = published

    @detect.detector("shy")
    def shy(events, users, cases):
        return detect.rank_hypotheses("shy", [], cases)

    try:
        h, scores, _, _ = jobs.run_suite(
            spark, public, w.cases, w.answers, spark.read.parquet(f"{restricted}/gold_users"),
            systems=("shy",))
        assert set(rows(h, "mechanism_type")) == {("innocent_dropoff",)}
    finally:
        del detect.DETECTORS["shy"]


def test_sizes_decide_the_join(spark, cases):
    assert "ResolvedHint" in small_side(cases)._jdf.queryExecution().analyzed().toString()
    unknown = spark.createDataFrame(spark.sparkContext.parallelize([("a",)]), "instance_id string")
    assert "ResolvedHint" not in small_side(unknown)._jdf.queryExecution().analyzed().toString()


def test_partitions_grow_with_the_input(spark):
    assert partitions_for(10, 8) == 8
    assert partitions_for(100 * 2**40, 200) == 1638400
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions",)}
    tune(spark, spark.range(10))
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum") == \
        before["spark.sql.shuffle.partitions"]


def test_shared_folder(monkeypatch):
    """The session's folder, else one in its warehouse."""
    from stepfall.plans.materialize import shared_folder

    class Conf(dict):
        def getConf(self):  # noqa: N802
            return self

    class Session:
        def __init__(self, **settings):
            self.conf = Conf({k.replace("_", "."): v for k, v in settings.items()})
            self.sparkContext = self.conf

    assert shared_folder(Session(spark_checkpoint_dir="hdfs://x/shared/")) == "hdfs://x/shared"
    assert shared_folder(Session(spark_sql_warehouse_dir="file:/w")) == "file:/w/stepfall-shared"
