import hypothesis
import pytest
from conftest import rows
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stepfall.functions.normal_form import normal_form
from stepfall.functions.predicates import checked_predicate
from stepfall.operators import cohorts, score, sessions


@pytest.fixture(scope="module")
def users(make_users):
    return make_users([
        ("u1", dict(os="X", age=30, geo="A or B")), ("u2", dict(os="X", age=24)),
        ("u3", dict(os="Y", age=40, ret=False)), ("u4", dict(os=None, age=None)),
        ("u5", dict(os="it's", age=0))]).cache()


@pytest.mark.parametrize("text", [
    "", "   ", None, "os = 'X'; drop table users", "os = 'dropship'", "persona = 'p'",
    "user_id = 'u1'", "lower(os) = 'x'", "os = \"X\"", "os = 5", "os ==", "os = 'X' AND",
    "device_age_months > 'old'", "os IN (SELECT 1)", "payment_method = 'upi'", "os = os2",
    "reflect('java.lang.System', 'exit')", "os = 'X' -- c", "is_returning = 7", "os LIKE",
    "os = 'X') OR (TRUE", "(os = 'X'"])
def test_refused_or_broken_predicates_select_nobody(users, text):
    assert cohorts.compile_cohort(users, text).count() == 0


@pytest.mark.parametrize("text,ids", [
    ("os = 'X'", "u1 u2"), ("OS = 'X' and device_age_months > 24", "u1"),
    ("24 < device_age_months", "u1 u3"), ("os IN ('X', 'Y')", "u1 u2 u3"),
    ("os = 'it''s'", "u5"), ("geo = 'A or B'", "u1"), ("is_returning", "u1 u2 u4 u5"),
    ("is_returning = 0", "u3"), ("NOT (os = 'X' OR device_age_months >= 40)", "u5"),
    ("device_age_months BETWEEN 24 AND 30", "u1 u2"), ("os IS NULL", "u4"),
    ("os LIKE 'i%'", "u5"), ("os <> 'X' OR device_age_months = '30'", "u1 u3 u5"),
    ("os = 'X' AND is_returning = TRUE OR os = 'Y'", "u1 u2 u3")])
def test_accepted_predicates(users, text, ids):
    assert rows(cohorts.compile_cohort(users, text), "user_id") == [(i,) for i in ids.split()]


def test_event_level_predicate_needs_its_column(make_events):
    events = make_events([("s", "u1", "1 1:00", "x", {"pay": "upi"}), ("s", "u2", "1 1:00", "x")])
    assert cohorts.compile_cohort(events, "payment_method = 'upi'").count() == 0
    got = cohorts.compile_cohort(events, "payment_method = 'upi'", columns=("payment_method",))
    assert rows(got, "user_id") == [("u1",)]


FLAT = ["os = 'X'", "os = 'X' AND device_age_months > 24", "os IN ('X', 'Y', 'X')",
        "geo = 'A or B' OR os <> 'X'", "os = 'it''s' OR is_returning = FALSE",
        "device_age_months <= 24 AND device_age_months >= 10 OR os = 'Y' AND is_returning = 0",
        "device_age_months > 'old'", "os = 'dropship'", "os > 'X'", "device_age_months <> 24.0",
        "os = 'nobody'"]


def test_bulk_compilation_equals_one_by_one(spark, users):
    claims = spark.createDataFrame([("a", t, t) for t in FLAT],
                                   "instance_id string, claim_id string, predicate string")
    bulk = cohorts.compile_cohort_bulk(users, cohorts.cohort_clauses(claims))
    got = {}
    for claim, uid in rows(bulk, "claim_id", "user_id"):
        got.setdefault(claim, []).append((uid,))
    for text in FLAT:
        assert got.get(text, []) == rows(cohorts.compile_cohort(users, text), "user_id"), text
    assert bulk.count() == bulk.distinct().count()


def test_clause_rows(spark):
    claims = spark.createDataFrame(
        [("a", "c", "os IN ('p', 'q') AND device_age_months > 24 OR is_returning = TRUE")],
        "instance_id string, claim_id string, predicate string")
    assert rows(cohorts.cohort_clauses(claims), "disjunct_id", "clause_id", "column", "op",
                "str_value", "num_value") == [
        (0, 0, "os", "in", "p", None), (0, 0, "os", "in", "q", None),
        (0, 1, "device_age_months", "gt", None, 24.0), (1, 2, "is_returning", "eq", "true", None)]


def test_clauses_without_a_case_apply_to_all(spark, make_users):
    two = make_users([("u1", {}), ("u1", dict(case="b"))])
    clauses = spark.createDataFrame([("c", 0, 0, "os", "eq", "X", None)],
                                    "claim_id string, disjunct_id int, clause_id int, column string, "
                                    "op string, str_value string, num_value double")
    assert rows(cohorts.compile_cohort_bulk(two, clauses), "instance_id", "user_id") == [
        ("a", "u1"), ("b", "u1")]


def ids(spark, *pairs):
    return spark.createDataFrame(list(pairs), "instance_id string, user_id string")


def test_id_sets(spark):
    claims = spark.createDataFrame([("a", "some"), ("a", "none"), ("b", "some"), ("b", "none")],
                                   "instance_id string, claim_id string")
    claimed = spark.createDataFrame(
        [("a", "some", "u1"), ("a", "some", "u2"), ("a", "some", "u2"), ("b", "some", "u1")],
        "instance_id string, claim_id string, user_id string")
    got = cohorts.id_set_prf(claims, claimed, ids(spark, ("a", "u1"), ("a", "u3"), ("a", "u4")))
    assert rows(got, "instance_id", "claim_id", "precision", "recall", "f1") == [
        ("a", "none", 0.0, 0.0, 0.0), ("a", "some", 0.5, 0.333, 0.4),
        ("b", "none", 1.0, 1.0, 1.0), ("b", "some", 0.0, 0.0, 0.0)]


def test_f1_is_rounded_before_the_floor(spark):
    from stepfall.functions.measures import precision_recall_f1
    # 2 * 1249 / 5000 = 0.4996
    made = spark.createDataFrame([(2500, 2500, 1249)], "c int, p int, b int")
    f1 = made.select(precision_recall_f1(F.col("c"), F.col("p"), F.col("b"))[2]).collect()[0][0]
    assert f1 == 0.5


def test_affected_users_need_a_late_session(make_events, make_users, cases):
    events = make_events([
        ("s1", "u1", "13 23:50", "app_open"), ("s1", "u1", "14 00:10", "home_view"),
        ("s2", "u2", "14 00:00", "app_open"), ("s3", "u3", "20 10:00", "payment_submit", {"pay": "upi"}),
        ("s4", "u2", "2 10:00", "payment_submit", {"pay": "upi"})])
    flags = sessions.session_flags(events.drop("os"), cases)
    users = make_users([("u1", {}), ("u2", {}), ("u3", dict(os="Y"))])
    got = cohorts.affected_users(flags, users, cohorts.cohort_column("os = 'X'"))
    assert rows(got, "user_id") == [("u2",)]
    assert rows(cohorts.affected_users_payment(flags, "upi"), "user_id") == [("u3",)]
    assert rows(cohorts.methods_used(flags, ("card", "upi")), "user_id", "methods") == [("u3", ["upi"])]
    active = cohorts.active_in_regression(
        sessions.attach_users(flags, users), cases, F.col("os") == "X")
    assert rows(active, "session_id", "active") == [
        ("s1", False), ("s2", True), ("s3", False), ("s4", False)]


def test_separability_ties_go_to_the_earlier_column_and_value(make_users, spark, cases):
    users = make_users([("u1", dict(os="B", device_type="p")), ("u2", dict(os="A", device_type="q"))])
    best = cohorts.cohort_separability(users, ids(spark, ("a", "u1"), ("a", "u2")), cases=cases)
    # geo, channel, age and is_returning describe both users perfectly; age comes first
    assert rows(best, "instance_id", "n_affected", "col", "value", "product") == [
        ("a", 2, "device_age_months", "10", 1.0), ("b", 0, None, None, None)]
    pairs = cohorts.cohort_separability(users, ids(spark, ("a", "u1"), ("a", "u2")), best_only=False)
    assert {("os", "A", 1.0, 0.5), ("os", "B", 1.0, 0.5)} <= set(
        rows(pairs, "col", "value", "precision", "recall"))


HYP = "system string, instance_id string, rank int, mechanism_type string, affected_cohort string"


@pytest.fixture(scope="module")
def scoring(spark, make_users):
    people = [(f"x{i}", dict(os="X")) for i in range(4)] + [(f"y{i}", dict(os="Y")) for i in range(4)]
    users = make_users(people + [(n, {**o, "case": "b"}) for n, o in people])
    gold = spark.createDataFrame(
        [("a", True, "dead_screen", ["dead_screen"]), ("b", False, "none", ["innocent_dropoff"])],
        "instance_id string, has_fault boolean, fault_type string, acceptable_mechanisms array<string>")
    planted = ids(spark, *(("a", f"x{i}") for i in range(4)))
    return users, gold, planted


def scored(spark, scoring, hyps, **kw):
    users, gold, planted = scoring
    got = score.score_cases(spark.createDataFrame(hyps, HYP), gold, planted, users, **kw)
    return {(r.system, r.instance_id): r for r in got.collect()}


WRONG, RIGHT = "cold_start", "dead_screen"


@pytest.mark.parametrize("rank,top1,recall", [(1, True, True), (2, False, True), (4, False, False)])
def test_right_mechanism_by_rank(spark, scoring, rank, top1, recall):
    hyps = [("m", "a", r, RIGHT if r == rank else WRONG, "os = 'X'" if r == rank else "os = 'Y'")
            for r in range(1, 5)]
    r = scored(spark, scoring, hyps)[("m", "a")]
    assert (r.top1_correct, r.recall_at_3, r.cohort_f1, r.false_positive) == (top1, recall, 1.0, False)
    assert r.top_pred == (RIGHT if rank == 1 else WRONG) and r.gold_fault == RIGHT


def test_first_match_counts_and_not_the_best(spark, scoring):
    r = scored(spark, scoring, [("m", "a", 1, RIGHT, "os = 'Y'"), ("m", "a", 2, RIGHT, "os = 'X'")])
    assert (r[("m", "a")].cohort_f1, r[("m", "a")].top1_correct, r[("m", "a")].recall_at_3) == (
        0.0, False, True)


def test_without_match_the_top_one_is_measured(spark, scoring):
    r = scored(spark, scoring, [("m", "a", 1, WRONG, "os = 'X'")])[("m", "a")]
    assert (r.cohort_f1, r.top1_correct) == (1.0, False)


def test_no_fault_case(spark, scoring):
    r = scored(spark, scoring, [
        ("calm", "b", 1, "innocent_dropoff", ""), ("jumpy", "b", 1, WRONG, "os = 'X'"),
        ("jumpy", "b", 3, "innocent_dropoff", "")])
    calm, jumpy = r[("calm", "b")], r[("jumpy", "b")]
    assert (calm.top1_correct, calm.false_positive, calm.cohort_f1, calm.gold_fault) == (
        True, False, None, None)
    assert (jumpy.top1_correct, jumpy.false_positive, jumpy.recall_at_3) == (False, True, True)


def test_an_empty_list_still_scores(spark, scoring):
    runs = spark.createDataFrame([("m", "a"), ("m", "b")], "system string, instance_id string")
    r = scored(spark, scoring, [("other", "a", 1, WRONG, "")], runs=runs)
    a, b = r[("m", "a")], r[("m", "b")]
    assert (a.top1_correct, a.cohort_f1, a.top_pred, a.false_positive) == (False, 0.0, None, False)
    assert (b.top1_correct, b.false_positive) == (False, False)


@pytest.mark.parametrize("text,f1", [
    ("NOT (os = 'Y')", 1.0), ("(os = 'X')", 1.0), ("os == 'X'", 1.0), ("os LIKE 'X%'", 1.0),
    ("os BETWEEN 'X' AND 'X'", 1.0), ("os NOT IN ('Y')", 1.0), ("payment_method = 'upi'", 0.0),
    ("all users", 0.0), ("os = 'X' AND", 0.0), ("os = ('X'", 0.0), ("NOT", 0.0), ("os IN ()", 0.0),
    ("'X'", 0.0), ("os = 'X'; DROP TABLE users", 0.0)])
def test_any_text_scores(spark, scoring, text, f1):
    got = scored(spark, scoring, [("m", "a", 1, RIGHT, text)])
    assert len(got) == 1 and got[("m", "a")].cohort_f1 == f1


GROUPED = [
    "NOT (os = 'X' OR device_age_months >= 40)", "(os = 'X' OR os = 'Y') AND NOT is_returning",
    "device_age_months BETWEEN 24 AND 30", "device_age_months NOT BETWEEN 24 AND 30", "os IS NULL",
    "NOT os IS NOT NULL OR geo IS NULL", "os LIKE 'i%'", "os NOT LIKE '%s'", "NOT os LIKE '_'", "os NOT IN ('X', 'Y')",
    "NOT os IN ('X', NULL)", "os IN (NULL, 'X')", "NOT os = NULL", "is_returning IS TRUE", "is_returning IS NOT FALSE",
    "NOT NOT is_returning", "NOT is_returning", "24 < device_age_months AND (os = 'X')", "NOT '30' <= device_age_months",
    "((os = 'X') AND ((device_age_months > 24)))", "os BETWEEN NULL AND 'X'", "NOT os BETWEEN NULL AND 'X'",
    "(os = 'it''s' OR geo = 'A or B') AND NOT (os = 'X' AND device_age_months < 30)", "is_returning BETWEEN FALSE AND FALSE",
    "os LIKE '100!%'", "(os = geo)", "os <> geo OR (os = 'X')", "os = 'X' OR TRUE", "NOT (os = 'X' AND NOT (os <> 'X'))",
    "(os =", "NOT", "(lower(os) = 'x')", "(payment_method = 'upi')", "NOT (os = 'X') AND", "(is_returning = 7)",
    "(is_returning = TRUE) = TRUE", "os IS NULL IS NULL", "NOT (device_age_months)", "os NOT = 'X'",
    "(1 = 1)", "device_age_months IN (24, '30', 40)", "NOT device_age_months IN (24)", "is_returning NOT",
    "(os = 'X' AND device_age_months > 1) OR (os = 'Y' AND device_age_months > 1) OR (NOT os = 'X')",
]


def claims_of(spark, texts):
    return spark.createDataFrame([("a", t, t) for t in texts],
                                 "instance_id string, claim_id string, predicate string")


def test_grouped_texts_equal_expressions(spark, users):
    got = {}
    for claim, uid in rows(cohorts.compile_claims(users, claims_of(spark, GROUPED + FLAT)), "claim_id", "user_id"):
        got.setdefault(claim, []).append((uid,))
    for text in GROUPED + FLAT:
        assert got.get(text, []) == rows(cohorts.compile_cohort(users, text), "user_id"), text


LEAVES = st.sampled_from([
    "os = 'X'", "os <> 'X'", "os IS NULL", "os IS NOT NULL", "os IN ('X', 'Y')", "os NOT IN ('X')", "os LIKE '%s'",
    "device_age_months > 24", "device_age_months BETWEEN 10 AND 30", "24 >= device_age_months", "is_returning",
    "is_returning = FALSE", "geo = 'A or B'", "os NOT BETWEEN 'X' AND 'Y'", "os = NULL", "is_returning IS NOT TRUE"])
TEXTS = st.recursive(LEAVES, lambda t: st.one_of(
    t.map("NOT ({})".format), st.tuples(t, t).map("({0[0]} AND {0[1]})".format),
    st.tuples(t, t).map("({0[0]}) OR {0[1]}".format)), max_leaves=8)


def test_made_up_texts_equal_expressions(spark, users):
    texts = sorted({find_example(TEXTS, seed) for seed in range(60)})
    assert len(texts) > 30
    got = {}
    for claim, uid in rows(cohorts.compile_claims(users, claims_of(spark, texts)), "claim_id", "user_id"):
        got.setdefault(claim, set()).add(uid)
    columns = [F.when(cohorts.cohort_column(t), F.lit(i)) for i, t in enumerate(texts)]
    for uid, found in users.select("user_id", F.array_compact(F.array(*columns))).collect():
        for i, t in enumerate(texts):
            assert (uid in got.get(t, ())) == (i in found), (uid, t)


def find_example(strategy, seed):
    """One value of a strategy, the same for the same seed."""
    out = []

    @hypothesis.seed(seed)
    @hypothesis.settings(max_examples=12, database=None, phases=[hypothesis.Phase.generate], deadline=None)
    @hypothesis.given(strategy)
    def draw(text):
        out.append(text)
    draw()
    return out[-1]


def test_normal_forms():
    assert normal_form("NOT (os = 'X' OR is_returning)") == [
        (("os", "ne", ("X",)), ("is_returning", "ne", ("true",)))]
    assert normal_form("os NOT IN ('X', 'Y') OR geo LIKE 'a%'") == [
        (("os", "ne", ("X",)), ("os", "ne", ("Y",))), (("geo", "like", ("a%",)),)]
    assert normal_form("lower(os) = 'x'") == [] and normal_form("os = geo") is None
    wide = " AND ".join(f"(os = 'a{i}' OR geo = 'b{i}')" for i in range(20))
    assert normal_form(wide) is None and checked_predicate(wide) is not None
    assert normal_form("(" * 300 + "os = 'X'" + ")" * 300) is None


def test_wide_texts_are_compiled_as_expressions(spark, users):
    wide = " AND ".join(f"(os = 'X' OR device_age_months <> {i})" for i in range(20, 40))
    got = cohorts.compile_claims(users, claims_of(spark, [wide, "NOT (os = 'Y')"]))
    assert rows(got, "claim_id", "user_id") == sorted(
        [(wide, u) for u in ("u1", "u2", "u3", "u5")] + [("NOT (os = 'Y')", u) for u in ("u1", "u2", "u5")])


def test_any_number_of_grouped_texts_is_one_plan(spark, scoring, tmp_path, monkeypatch):
    users, _, _ = scoring
    analysed = []
    monkeypatch.setattr(cohorts, "cohort_column", lambda text: analysed.append(text) or F.lit(False))

    def plan_of(n):
        texts = [f"(os = 'X' OR geo IS NULL) AND device_age_months BETWEEN {i} AND 99" for i in range(n)]
        claims_of(spark, texts).write.parquet(f"{tmp_path}/{n}")
        return cohorts.compile_claims(users, spark.read.parquet(f"{tmp_path}/{n}"))
    few, many = plan_of(10), plan_of(10_000)
    shape = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert analysed == [] and shape(few) == shape(many)
    # all users are 10 months old
    assert many.select("claim_id").distinct().count() == 11


def test_suite_views(spark, scoring, cases):
    users, gold, planted = scoring
    hyps = spark.createDataFrame([
        ("m", "a", 1, RIGHT, "os = 'X'"), ("m", "b", 1, WRONG, "os = 'X'"),
        ("n", "a", 1, WRONG, "os = 'Y'"), ("n", "b", 1, "innocent_dropoff", "")], HYP)
    scores = score.score_cases(hyps, gold, planted, users).cache()
    assert rows(score.suite_summary(scores), "system", "n_cases", "n_fault", "top1", "mean_f1",
                "false_positives") == [("m", 2, 1, 1, 1.0, 1), ("n", 2, 1, 0, 0.0, 0)]
    assert rows(score.credit_bands(scores), "system", "strict", "lenient") == [
        ("m", 1.0, 1.0), ("n", 0.0, 0.0)]
    gap = score.system_comparison(scores, first="n", second="m").collect()[0]
    assert (gap.gap_pp, gap.reached) == (100.0, True)
    assert rows(score.detection_curve(scores, cases), "system", "severity_pp_target", "detected") == [
        ("m", 8.0, 1.0), ("n", 8.0, 0.0)]
    assert rows(score.fp_and_resistance(scores, cases), "system", "fp_rate") == [
        ("m", 0.5), ("n", 0.0)]


def test_guard_marks(spark):
    made = spark.createDataFrame([("os = 'X'",), ("  ",), (None,), ("SELECT 1",), ("os = 'dropship'",)],
                                 "affected_cohort string")
    assert [r.refused for r in cohorts.predicate_guard(made).collect()] == [
        False, True, True, True, True]


def test_checked_predicate_is_stable():
    once = checked_predicate("os = 'a' AND NOT device_age_months IN (1, 2)")
    assert once == "(`os` = 'a' AND NOT `device_age_months` IN ( 1 , 2 ))"
