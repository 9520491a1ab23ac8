import datetime as dt

import pytest
from conftest import rows

from stepfall.operators import detect, sessions, symptoms

CRASH_ROWS = "instance_id string, os string, on_screen boolean, latency_ms int, n long, n_crash long"


def histogram(spark, *groups):
    return spark.createDataFrame(list(groups), CRASH_ROWS)


def crash_groups(spark, top_rate_of_1000):
    return histogram(
        spark, ("a", "X", False, None, 1000, top_rate_of_1000), ("a", "Y", False, None, 1000, 20),
        ("a", "Z", False, None, 1000, 20), ("a", "small", False, None, 200, 200))


def test_groups_need_more_than_the_row_floor(spark):
    got = symptoms.crash_rate_by_os(histogram(
        spark, ("a", "X", False, None, 200, 1), ("a", "Y", False, None, 201, 1)))
    assert rows(got, "os", "n") == [("Y", 201)]


def test_crash_rate_must_exceed_factor_times_median(spark):
    # the median of (50, 20, 20) per mille is 20, and 2.5 times that is exactly 50
    assert detect.detect_crash(crash_groups(spark, 50)).count() == 0
    got = detect.detect_crash(crash_groups(spark, 51))
    assert rows(got, "affected_cohort", "score", "confidence") == [("os = 'X'", 0.051, 0.55)]


def test_latency_thresholds_are_strict(spark):
    def slow(p95, n=51):
        return histogram(
            spark, ("a", "X", True, p95, n, 0), ("a", "Y", True, 1000, 60, 0),
            ("a", "Z", True, 900, 60, 0), ("a", "empty", True, None, 60, 0))
    assert detect.detect_latency(slow(3000)).count() == 0
    assert detect.detect_latency(slow(3001, 50)).count() == 0
    got = detect.detect_latency(slow(3001))
    assert rows(got, "affected_cohort", "score") == [("os = 'X'", 3001.0)]


def test_median_leaves_out_null_and_zero(spark):
    groups = spark.createDataFrame(
        [("a", 4.0), ("a", None), ("a", 0.0), ("a", 2.0), ("b", None)], "instance_id string, p95 double")
    assert rows(symptoms.group_median(groups, "p95", positive_only=True), "instance_id", "median") \
        == [("a", 3.0), ("b", 0.0)]


def test_ties_go_to_the_first_name(spark):
    groups = spark.createDataFrame([("a", "Y", 0.5), ("a", "X", 0.5), ("a", "W", None)],
                                   "instance_id string, os string, rate double")
    assert rows(symptoms.top_suspect(groups, "rate"), "os", "rate") == [("X", 0.5)]


def test_fallback_stands_alone(spark, cases):
    ranked = detect.rank_hypotheses("m", [detect.detect_crash(crash_groups(spark, 90))], cases)
    assert rows(ranked, "instance_id", "rank", "mechanism_type") == [
        ("a", 1, "crash_concentration"), ("b", 1, "innocent_dropoff")]
    assert rows(detect.detect_none(cases, detect.detect_crash(crash_groups(spark, 90))),
                "instance_id", "confidence") == [("b", 0.4)]


def test_crash_ranks_before_latency(spark, cases):
    h = crash_groups(spark, 90).unionByName(histogram(
        spark, ("a", "Y", True, 9000, 100, 0), ("a", "Z", True, 1000, 100, 0),
        ("a", "X", True, 1000, 100, 0)))
    ranked = detect.rank_hypotheses("m", [detect.detect_crash(h), detect.detect_latency(h)], cases)
    assert rows(ranked.filter("instance_id = 'a'"), "rank", "mechanism_type", "affected_cohort") == [
        (1, "crash_concentration", "os = 'X'"), (2, "checkout_latency", "os = 'Y'")]


def test_recent_window_is_by_event_time(make_events, cases):
    events = make_events([("s1", "u1", "13 23:59", "app_open"), ("s1", "u1", "14 00:00", "home_view")])
    assert rows(symptoms.recent_window(events, cases), "canonical") == [("home_view",)]


def test_percentile_of_counts_is_the_percentile_of_rows(spark, make_events):
    values = [100, 100, 100, 250, 900, 40, None]
    events = make_events([("s", "u", "1 10:00", "x", {"screen": "checkout", "latency": v})
                          for v in values])
    got = symptoms.symptom_by_os(symptoms.signal_histogram(events)).collect()[0]
    # rank 0.95 * 5 = 4.75 between 250 and 900
    assert got.chk_p95 == round(250 + 0.75 * 650)
    assert symptoms.latency_p95_by_os(symptoms.signal_histogram(events), min_rows=6).collect()[0].n == 7


def test_limit_is_breached_at_its_value(make_events, cases):
    events = make_events([
        ("s", "u", "1 10:00", "app_cold_start", {"latency": 2000, "screen": "app"}),
        ("s", "u", "1 10:00", "screen_load", {"latency": 900, "screen": "checkout"})])
    got = symptoms.slo_audit(events, cases)
    assert rows(got, "signal", "p95", "breach") == [
        ("checkout_screen", 900.0, False), ("cold_start", 2000.0, True),
        ("screen_load", 1945.0, True)]


def test_payment_gap_is_to_the_best_method(make_events, cases):
    events = make_events([
        ("s1", "u", "1 10:00", "payment_submit", {"pay": "upi"}),
        ("s2", "u", "1 11:00", "payment_submit", {"pay": "card"}),
        ("s2", "u", "1 11:01", "order_confirmed", {"pay": "card"})])
    got = symptoms.payment_parity(sessions.session_flags(events, cases))
    assert rows(got, "pay_method", "rate", "gap_to_best") == [("card", 1.0, 0.0), ("upi", 0.0, 1.0)]


def test_decoys(make_events, cases):
    events = make_events([
        ("s1", "u", "1 10:00", "upsell_view"), ("s1", "u", "1 10:01", "upsell_dismiss"),
        ("s2", "u", "1 11:00", "upsell_view"), ("s2", "u", "1 11:01", "order_confirmed"),
        ("s3", "u", "1 12:00", "tutorial_view"), ("s3", "u", "1 12:01", "app_open"),
        ("s4", "u", "1 13:00", "tutorial_view"), ("s4", "u", "1 13:01", "home_view")])
    flags = sessions.session_flags(events, cases, vocabulary=symptoms.DECOY_VOCABULARY)
    assert rows(symptoms.decoy_report(flags), "screen", "sessions_seen", "sessions_exited") == [
        ("tutorial", 2, 1), ("upsell", 2, 1)]


def test_volume(make_events):
    events = make_events([("s", "u1", "1 1:00", "x"), ("s", "u1", "1 1:00", "y"), ("t", "u2", "1 1:00", "x")])
    assert rows(symptoms.case_volume(events), "n_events", "n_users", "n_names") == [(3, 2, 2)]
    assert rows(symptoms.case_volume(events, approximate=True), "n_users") == [(2,)]


def test_hypothesis_validation(spark):
    made = spark.createDataFrame(
        [("dead_screen", 0.0), ("dead_screen", 1.0), ("dead_screen", 1.1), ("magic", 0.5), (None, 0.5)],
        "mechanism_type string, confidence double")
    good, bad = detect.valid_hypotheses(made)
    assert good.count() == 2 and bad.count() == 3


def test_scan_cohort_texts_compile(spark):
    from pyspark.sql import functions as F

    from stepfall.functions.predicates import checked_predicate
    made = spark.createDataFrame(
        [("os", "O'S"), ("device_age_months", "0-12"), ("device_age_months", "25-36"),
         ("is_returning", "true")], "attr string, value string")
    texts = [r[0] for r in made.select(detect.cohort_text(F.col("attr"), F.col("value"))).collect()]
    assert texts == ["os = 'O''S'", "device_age_months <= 12",
                     "device_age_months >= 25 AND device_age_months <= 36", "is_returning = TRUE"]
    assert all(checked_predicate(t) for t in texts)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_wall_clock_order_ignores_the_session_zone(spark, zone):
    from pyspark.sql import functions as F

    from stepfall.functions.timing import wall_micros
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        made = spark.createDataFrame([(dt.datetime(2026, 11, 1, 1, 30, 0, 5),)], "t timestamp_ntz")
        got = made.select(wall_micros(F.col("t"))).collect()[0][0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == int((dt.datetime(2026, 11, 1, 1, 30) - dt.datetime(1970, 1, 1)).total_seconds()) \
        * 1_000_000 + 5
