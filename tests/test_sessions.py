from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from conftest import rows

from stepfall.constants import STAGES
from stepfall.operators import funnel, sessions, severity

BROWSE, DETAIL = "product_browse", "product_detail_view"


def test_period_follows_the_earliest_event(make_events, cases):
    events = make_events([
        ("s1", "u1", "13 23:55", "app_open"), ("s1", "u1", "14 00:05", "home_view"),
        ("s2", "u1", "14 00:00", "app_open")])
    for roll in (sessions.session_rollup, sessions.session_flags):
        assert rows(roll(events, cases), "session_id", "day", "period") == [
            ("s1", 13, "pre"), ("s2", 14, "post")]
    cut = sessions.event_days(events, cases)
    assert rows(cut.filter("session_id = 's1'"), "day", "period") == [(13, "pre"), (14, "post")]


def test_first_payment_method_skips_nulls(make_events, cases):
    events = make_events([
        ("s1", "u1", "1 10:02", "order_confirmed", {"pay": "card"}),
        ("s1", "u1", "1 10:00", "checkout_start"),
        ("s1", "u1", "1 10:01", "payment_submit", {"pay": "upi"}),
        ("s2", "u1", "2 10:00", "app_open"),
        ("s3", "u1", "3 10:00", "payment_submit", {"pay": "voucher"})])
    assert rows(sessions.session_rollup(events, cases), "session_id", "pay_method") == [
        ("s1", "upi"), ("s2", None), ("s3", "voucher")]
    assert rows(sessions.session_flags(events, cases), "session_id", "pay_method") == [
        ("s1", "upi"), ("s2", None), ("s3", "voucher")]


def test_unresolved_names_leave_the_set(make_events, cases):
    events = make_events([("s1", "u1", "1 10:00", None, {"crash": True}),
                          ("s1", "u1", "1 10:01", "home_view")])
    assert rows(sessions.session_rollup(events, cases), "canon", "has_crash") == [
        (["home_view"], True)]


def test_conversion_ignores_order_in_time(make_events, cases):
    events = make_events([
        ("s1", "u1", "1 10:00", DETAIL), ("s1", "u1", "1 10:05", BROWSE),
        ("s2", "u2", "1 10:00", BROWSE)])
    got = severity.step_conversion(
        sessions.session_flags(events, cases), steps=[(BROWSE, DETAIL)])
    assert rows(got, "period", "n_from", "n_both", "rate") == [
        ("post", 0, 0, None), ("pre", 2, 1, 0.5)]


def test_empty_period_gives_zero_severity(make_events, cases):
    from pyspark.sql import functions as F
    events = make_events([("s1", "u1", "1 10:00", BROWSE), ("s1", "u1", "1 10:01", DETAIL),
                          ("s2", "u1", "20 10:00", "app_open")])
    flags = sessions.session_flags(events, cases)
    step = severity.cohort_severity(flags, (BROWSE, DETAIL), F.lit(True), "all")
    assert rows(step, "cohort_sessions", "pre", "post", "realised_pp") == [(2, 100.0, 0.0, 0.0)]
    crash = severity.cohort_severity(
        flags.withColumn("has_crash", F.col("period") == "post"), severity.CRASH,
        F.col("os") == "X", "os")
    assert rows(crash, "metric", "realised_pp") == [("crash_rate_increase", 100.0)]


def test_severity_sign_and_rounding(make_events, cases):
    from pyspark.sql import functions as F
    made = []
    for i in range(3):
        made.append((f"p{i}", f"u{i}", "1 10:00", BROWSE))
        made.append((f"q{i}", f"u{i}", "15 10:00", BROWSE))
    made += [("p0", "u0", "1 10:01", DETAIL), ("p1", "u1", "1 10:01", DETAIL),
             ("q0", "u0", "15 10:01", DETAIL)]
    flags = sessions.session_flags(make_events(made), cases)
    got = severity.cohort_severity(flags, (BROWSE, DETAIL), F.lit(True), "all")
    assert rows(got, "pre", "post", "realised_pp") == [(66.7, 33.3, 33.33)]


def test_funnel_report_counts_sessions_and_users(make_events, cases):
    events = make_events([
        ("s1", "u1", "1 10:00", "app_open"), ("s1", "u1", "1 10:01", "home_view"),
        ("s2", "u1", "2 10:00", "app_open"), ("s3", "u2", "2 10:00", "app_open"),
        ("s4", "u3", "2 10:00", "home_view")])
    got = funnel.funnel_report(sessions.session_flags(events, cases)).filter("stage_idx < 2")
    assert rows(got, "stage", "sessions", "users", "step_rate", "overall_rate") == [
        ("app_open", 3, 2, None, 1.0), ("home_view", 2, 2, 1 / 3, 1 / 3)]


def test_naive_match_overreaches(make_events, cases):
    events = make_events([
        ("s1", "u1", "1 10:00", "x", {"name": "SESSION-START"}),
        ("s1", "u1", "1 10:01", "x", {"name": "order_history_view"}),
        ("s2", "u2", "20 10:00", "x", {"name": "notification_open"})])
    assert rows(funnel.naive_stage_match(events), "stage", "event_name") == [
        ("app_open", "SESSION-START"), ("app_open", "notification_open"),
        ("order_confirmed", "order_history_view")]
    got = funnel.naive_funnel(events, cases=cases).filter("stage = 'app_open'")
    assert rows(got, "period", "users") == [("all", 2), ("post", 1), ("pre", 1)]


def test_one_expression_finds_what_like_finds(spark):
    from pyspark.sql import functions as F
    names = ["xa.b", "a.b", "a+b", "a.b\n", "A_b", "sab", "a\nb", "ab", "", "a.bc", "c'd"]
    made = spark.createDataFrame([(n,) for n in names], "name string")
    for patterns in (("%a_b%",), ("a_b",), ("a%b", "%c'd"), ("%.b",), ("a.%", "ab%")):
        regex = funnel.like_to_regex(patterns)
        like = F.lit(False)
        for p in patterns:
            like = like | F.col("name").like(p)
        for r in made.select("name", like.alias("l"), F.col("name").rlike(regex).alias("r")).collect():
            assert r.l == r.r, (patterns, r)


def test_a_session_name_with_quotes_survives(make_events, cases):
    odd = "it's"
    events = make_events([("s1", "u1", "1 10:00", odd)])
    flags = sessions.session_flags(events, cases, vocabulary=("app_open", odd))
    assert rows(flags, "stage_mask") == [(2,)]


def test_masks_hold_any_number_of_names(make_events, cases):
    names = [f"n{i}" for i in range(140)]
    events = make_events([("s", "u", "1 1:00", "n3"), ("s", "u", "1 1:01", "n69"),
                          ("s", "u", "1 1:02", "n139")])
    flags = sessions.session_flags(events, cases, vocabulary=names)
    held = flags.select(*(sessions.has(n, names).alias(n) for n in names)).collect()[0].asDict()
    assert [n for n, yes in held.items() if yes] == ["n3", "n69", "n139"]


PAYS = ["card", "upi", "wallet", "cod", "netbanking", "Voucher", None]


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["u1", "u2", None]), st.integers(0, 2),
                          st.sampled_from(STAGES), st.sampled_from(PAYS)), min_size=1, max_size=25),
       st.sampled_from([(), ("card", "upi"), ("upi", "netbanking", "card", "cod", "wallet", "Voucher")]))
def test_both_roll_ups_follow_one_rule(make_events, cases, drawn, methods):
    """Ties in time, methods that nobody listed, null users."""
    events = make_events([(f"s{s}", u, f"1 10:0{m}", name, {"pay": pay})
                          for s, u, m, name, pay in drawn])
    shared = ("session_id", "user_id", "day", "has_crash", "pay_method", "period")
    flags = sessions.session_flags(events, cases, methods=methods)
    assert rows(sessions.session_rollup(events, cases), *shared) == rows(flags, *shared)
    if len(methods) > 5:
        closed = sessions.session_flags(events, cases, methods=methods, closed=True)
        assert rows(closed, *shared) == rows(flags, *shared)


def test_attributes_on_events_give_way_to_users(make_events, make_users, cases):
    events = make_events([("s", "u1", "1 1:00", "app_open", {"os": "old"})])
    got = sessions.attach_users(sessions.session_flags(events, cases), make_users([("u1", {"os": "new"})]))
    assert got.columns.count("os") == 1 and rows(got, "os", "geo") == [("new", "G")]


def test_one_huge_session_equals_many_small_ones(spark, make_events, cases):
    """A session holding a third of all rows: the two roll-ups agree on everything."""
    from pyspark.sql import functions as F
    base = spark.range(3000).select(
        F.lit("a").alias("instance_id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
            F.concat(F.lit("s"), (F.col("id") % 97).cast("string"))).alias("session_id"),
        F.lit("u").alias("user_id"),
        F.expr("timestamp_ntz'2026-06-01 00:00:00' + make_dt_interval(0, 0, cast(id * 13 AS int), 0)")
        .alias("event_ts"),
        F.when(F.col("id") % 2 == 0, F.lit("app_open")).otherwise(F.lit("home_view"))
        .alias("canonical"),
        (F.col("id") % 500 == 0).alias("is_crash"),
        F.when(F.col("id") % 7 == 0, F.lit("cod")).alias("payment_method"))
    full = sessions.session_rollup(base, cases).select(
        "session_id", "day", "has_crash", "pay_method", "period",
        F.array_contains("canon", "app_open").alias("o"))
    flat = sessions.session_flags(base, cases).select(
        "session_id", "day", "has_crash", "pay_method", "period", sessions.has("app_open").alias("o"))
    assert full.exceptAll(flat).count() == 0 and full.count() == flat.count() == 98
