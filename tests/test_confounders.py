import pytest
from pyspark.sql import functions as F

from stepfall.operators import confounders, score, severity

FLAGS = ("instance_id string, user_id string, period string, stage_mask long, has_crash boolean, "
         "os string, device_type string, device_age_months int, geo string, channel string, "
         "is_returning boolean")
REACHED, OPENED = 1 | 1 << 8, 1


def flags(spark, *groups):
    """(os, period, sessions, how many of them ordered)"""
    out = []
    for os, period, n, k in groups:
        out += [("a", f"{os}{period}{i}", period, REACHED if i < k else OPENED, False, os, "mid",
                 10, "G", "paid", True) for i in range(n)]
    return spark.createDataFrame(out, FLAGS)


def test_pure_mix_shift(spark):
    # both segments keep their rates (80% and 20%); the weak one grows
    made = flags(spark, ("X", "pre", 80, 64), ("Y", "pre", 20, 4),
                 ("X", "post", 20, 16), ("Y", "post", 80, 16))
    got = {r.segment: r for r in confounders.mix_shift(made, "os").collect()}
    assert got["X"].within == pytest.approx(0) and got["Y"].within == pytest.approx(0)
    assert sum(r.total for r in got.values()) == pytest.approx(0.32 - 0.68)


def test_parts_add_up_with_segments_appearing_and_leaving(spark):
    made = flags(spark, ("gone", "pre", 30, 10), ("both", "pre", 20, 15),
                 ("both", "post", 25, 11), ("new", "post", 40, 9))
    parts = confounders.mix_shift(made, "os").collect()
    assert sum(r.total for r in parts) == pytest.approx(20 / 65 - 25 / 50)


def test_simpson(spark):
    made = flags(spark, ("X", "pre", 50, 25), ("Y", "pre", 50, 25),
                 ("X", "post", 50, 35), ("Y", "post", 50, 15))
    got = {r.attr: r for r in confounders.simpson_check(made).collect()}
    assert got["os"].flag and got["os"].max_seg_delta == pytest.approx(20)
    assert got["os"].total_delta == pytest.approx(0) and not got["geo"].flag


def test_scan_bands_and_rank(spark):
    made = flags(spark, ("X", "pre", 10, 10), ("X", "post", 10, 5), ("Y", "pre", 10, 5),
                 ("Y", "post", 10, 5))
    ages = made.withColumn("device_age_months", F.when(F.col("os") == "X", 24).otherwise(25))
    scan = severity.severity_scan(ages, steps=[("app_open", "order_confirmed")])
    got = {(r.attr, r.value): r for r in scan.collect()}
    assert got[("device_age_months", "13-24")].delta_pp == 50.0
    assert got[("device_age_months", "25-36")].delta_pp == 0.0
    assert got[("device_age_months", "13-24")].rnk == 1 and got[("os", "X")].rnk == 2
    z = severity.severity_ztest(scan).filter("attr = 'os' AND value = 'X'").collect()[0].z
    assert z == pytest.approx(0.5 / (0.75 * 0.25 * 0.2) ** 0.5)
    pairs = severity.severity_scan(ages, steps=[severity.CRASH], pairs=True, min_sessions=1)
    assert pairs.filter("attr = 'os&device_age_months'").count() == 2


def test_cohort_against_the_rest(spark):
    made = flags(spark, ("X", "pre", 10, 10), ("X", "post", 10, 5), ("Y", "pre", 10, 5),
                 ("Y", "post", 10, 5))
    got = confounders.cohort_stats(made, F.col("os") == "X").filter("to_stage = 'order_confirmed'")
    assert {r.side: r.delta_pp for r in got.collect()} == {"cohort": 50.0, "rest": 0.0}


def test_churn_within_age_bands(spark):
    one = ("mid", 10, "G", "paid", True)
    made = spark.createDataFrame([
        ("a", "c1", "pre", 1, True, "X", *one), ("a", "c2", "pre", 1, True, "X", *one),
        ("a", "c2", "post", 1, False, "X", *one), ("a", "n1", "pre", 1, False, "X", *one),
        ("a", "late", "post", 1, True, "X", *one)], FLAGS)
    got = confounders.confounder_check(made).collect()
    assert [(r.age_band, r.n_crashers, r.churned_crashers, r.n_others, r.churned_others)
            for r in got] == [("0-12", 2, 1, 1, 1)]


def test_agreement(spark):
    a = spark.createDataFrame([(i, int(i < 5)) for i in range(10)], "id int, y int")
    b = spark.createDataFrame([(i, int(i < 4)) for i in range(10)], "id int, y int")
    r = score.label_agreement(a, b, on="id", label="y").collect()[0]
    assert (r.n, r.n_agree) == (10, 9) and r.kappa == pytest.approx((0.9 - 0.5) / 0.5)


def test_calibration(spark):
    index = spark.createDataFrame([("a", True, 8.0, 7.0), ("b", True, 8.0, 6.9), ("c", False, 0.0, 0.0)],
                                  "instance_id string, has_fault boolean, severity_pp_target double, "
                                  "severity_pp_realised double")
    got = {r.instance_id: r.calibrated for r in score.severity_calibration(index).collect()}
    assert got == {"a": True, "b": False}
