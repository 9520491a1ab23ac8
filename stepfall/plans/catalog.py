"""Named queries over the retail tables, one per operator.

Each takes (spark, folder of parquet tables) and returns a DataFrame over whole tables.
Array results are joined to text here so that any engine can compare them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfall import constants as K
from stepfall.operators import (
    answers, cohorts, confounders, detect, funnel, names, retrieval, score, sessions, severity,
    significance, symptoms,
)
from stepfall.plans import attribution
from stepfall.plans.materialize import cut
from stepfall.sources import tables
from stepfall.sources.retail import ClickWarehouse, OrderWarehouse

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Cohorts that exist in the retail tables, by fault.
COHORTS = {
    "dead_screen": "os = 'HOUSEHOLD'",
    "checkout_latency": "os = 'MACHINERY'",
    "cold_start": "os IN ('FURNITURE', 'AUTOMOBILE')",
    "crash_concentration": "os = 'BUILDING' AND device_age_months > 24",
    "payment_failure": "payment_method = 'upi'",
}
# The retail events have no planted fault, so their detectors ask for "above the median" only.
LOOSE = {"crash_factor": 1.05, "latency_factor": 1.02}


def query(fn: Callable[[ClickWarehouse], DataFrame]) -> Callable:
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(ClickWarehouse(spark, sf_dir))
    return fn


def _flags(w: ClickWarehouse) -> DataFrame:
    # the retail view makes up its payment methods, so there are no others
    return sessions.session_flags(w.raw_events, w.cases, closed=True)


def _with_users(w: ClickWarehouse) -> DataFrame:
    return sessions.attach_users(_flags(w), w.user_rows)


def _histogram(w: ClickWarehouse, recent: bool = True) -> DataFrame:
    events = symptoms.recent_window(w.events, w.cases) if recent else w.events
    return symptoms.signal_histogram(events)


def _planted(w: ClickWarehouse) -> DataFrame:
    return answers.planted_users(_with_users(w), w.answers, COHORTS)


def _gold(w: ClickWarehouse) -> DataFrame:
    return answers.gold_record(w.answers, _with_users(w), _planted(w), COHORTS)


def _cohort(fault: str):
    return cohorts.cohort_column(COHORTS[fault])


def _dictionary(w: ClickWarehouse) -> DataFrame:
    return names.dictionary_entries(w.surface_forms)


def _map(w: ClickWarehouse) -> DataFrame:
    return names.canonical_map(w.surface_forms)


def _baseline(w: ClickWarehouse) -> DataFrame:
    return detect.baseline(w.events, w.user_rows, w.cases, **LOOSE)


def _scan_hypotheses(w: ClickWarehouse, session_rows: DataFrame) -> DataFrame:
    return attribution.scan_hypotheses(session_rows, w.cases)


def _suite(w: ClickWarehouse) -> tuple[DataFrame, DataFrame]:
    """Hypotheses of both systems and the planted ids.  Sessions feed both, so they are
    written once; the two small results are written because scoring reads them repeatedly."""
    session_rows = cut(_with_users(w))
    hypotheses = attribution.all_systems({
        "baseline": _baseline(w), "scan": _scan_hypotheses(w, session_rows)})
    return cut(hypotheses), cut(answers.planted_users(session_rows, w.answers, COHORTS))


def _scores(w: ClickWarehouse) -> DataFrame:
    hypotheses, planted = _suite(w)
    return score.score_cases(hypotheses, w.answers, planted, w.user_rows)


def _claims(w: ClickWarehouse) -> DataFrame:
    """Every (os, device type) pair of a case as a claim, in two shapes."""
    pairs = w.user_rows.select("instance_id", "os", "device_type").distinct()
    both = F.concat(F.lit("os = '"), "os", F.lit("' AND device_type = '"), "device_type",
                    F.lit("'"))
    either = F.concat(F.lit("os IN ('"), "os", F.lit("') AND device_age_months > 24 OR "
                      "device_type <> '"), "device_type", F.lit("' AND is_returning = TRUE"))
    return pairs.select("instance_id", F.explode(F.array(both, either)).alias("predicate")) \
        .withColumn("claim_id", F.col("predicate"))


# --- scans, projections, filters ----------------------------------------------------------

@query
def scan_case(w):
    return tables.scan_case(w.raw_events)


@query
def case_index(w):
    return tables.case_index(w.raw_events)


@query
def answer_index(w):
    return answers.answer_index(_gold(w), w.user_rows, _planted(w))


@query
def publish_events(w):
    return tables.publish_events(w.raw_events, w.users)


@query
def publish_users(w):
    return tables.publish_users(w.users)


@query
def day_index(w):
    return sessions.event_days(w.raw_events, w.cases).groupBy("instance_id", "day").agg(
        F.count("*").alias("n_events"))


@query
def period_label(w):
    return sessions.event_days(w.raw_events, w.cases).groupBy("instance_id", "period").agg(
        F.count("*").alias("n_events"), F.min("day").alias("first_day"),
        F.max("day").alias("last_day"))


@query
def recent_window(w):
    return symptoms.recent_window(w.raw_events, w.cases).select(
        "instance_id", "user_id", "session_id", "event_ts", "event_name")


@query
def naive_stage_match(w):
    return funnel.naive_stage_match(w.raw_events)


@query
def cohort_eq(w):
    return w.user_rows.filter(_cohort("dead_screen")).select("instance_id", "user_id", "os")


@query
def cohort_in(w):
    return w.user_rows.filter(_cohort("cold_start")).select("instance_id", "user_id", "os")


@query
def cohort_and(w):
    return w.user_rows.filter(_cohort("crash_concentration")).select(
        "instance_id", "user_id", "os", "device_age_months")


@query
def cohort_payment(w):
    return _flags(w).filter(F.col("pay_method") == "upi").select(
        "instance_id", "session_id", "user_id", "pay_method")


@query
def active_in_regression(w):
    return cohorts.active_in_regression(
        _with_users(w), w.cases, _cohort("crash_concentration")).select(
        "instance_id", "session_id", "active")


@query
def compile_cohort(w):
    return cohorts.compile_cohort(
        w.user_rows, "(os = 'BUILDING' OR geo LIKE 'A%') AND NOT device_age_months BETWEEN 10 AND 30")


@query
def compile_cohort_events(w):
    return cohorts.compile_cohort(
        w.events, "payment_method = 'upi' AND is_returning = TRUE",
        columns=(*K.USER_ATTRIBUTES, "payment_method"))


@query
def predicate_guard(w):
    texts = w.table("documents").select(
        F.col("doc_id").alias("claim"), F.col("text").alias("affected_cohort"))
    return cohorts.predicate_guard(texts).select("claim", "refused")


@query
def leak_guard(w):
    found = tables.leak_guard(
        raw_events=w.raw_events, events=tables.publish_events(w.raw_events, w.users),
        users=tables.publish_users(w.users))
    rows = {"raw_events": w.raw_events, "events": tables.publish_events(w.raw_events, w.users),
            "users": tables.publish_users(w.users)}
    parts = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"),
                    F.lit(",".join(found[name])).alias("forbidden"))
             for name, df in rows.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def dictionary_entries(w):
    return _dictionary(w)


@query
def canonical_map(w):
    return _map(w)


@query
def valid_hypotheses(w):
    # document labels as claims of doubtful quality
    made = w.table("documents").select(
        F.col("doc_id").alias("claim"),
        F.when(F.col("lang") == "en", F.lit("dead_screen"))
        .when(F.col("lang") == "fr", F.lit("cold_start")).otherwise(F.col("source"))
        .alias("mechanism_type"),
        (F.col("n_chars") / 2000.0).alias("confidence"))
    good, bad = detect.valid_hypotheses(made)
    return good.withColumn("accepted", F.lit(True)).unionByName(
        bad.withColumn("accepted", F.lit(False))).select("claim", "mechanism_type", "accepted")


@query
def case_labels(w):
    volume = symptoms.case_volume(w.raw_events)
    return score.case_labels(w.cases).join(volume, "instance_id").select(
        "instance_id", "confounder_type", "n_events")


# --- joins --------------------------------------------------------------------------------

@query
def denormalise_events(w):
    return tables.denormalise(w.raw_events, w.user_rows).groupBy(
        "instance_id", *K.USER_ATTRIBUTES).agg(F.count("*").alias("n_events"))


@query
def affected_users(w):
    return cohorts.affected_users(_flags(w), w.user_rows, _cohort("crash_concentration"))


@query
def affected_users_payment(w):
    return cohorts.affected_users_payment(_flags(w), "upi")


@query
def methods_used(w):
    return cohorts.methods_used(_flags(w), K.PAYMENT_METHODS).select(
        "instance_id", "user_id", F.array_join("methods", ",").alias("methods"))


@query
def affected_flag(w):
    return cohorts.affected_flag(w.user_rows, _planted(w)).select(
        "instance_id", "user_id", "affected")


@query
def resolve_exact(w):
    found = names.resolve_exact(w.raw_events.drop("canonical"), cut(_map(w)))
    return found.groupBy("instance_id", "event_name", "canonical").agg(
        F.count("*").alias("n_events"))


# --- aggregations -------------------------------------------------------------------------

@query
def case_volume(w):
    return symptoms.case_volume(w.raw_events)


@query
def session_rollup(w):
    return sessions.session_rollup(w.raw_events, w.cases).withColumn(
        "canon", F.array_join("canon", ","))


@query
def session_flags(w):
    return _flags(w).select(
        "instance_id", "session_id", "user_id", "day", "stage_mask", "has_crash", "pay_method",
        "period")


@query
def step_conversion(w):
    return severity.step_conversion(_flags(w))


def _severity(name: str, fault: str) -> None:
    def run(w: ClickWarehouse) -> DataFrame:
        if fault == "payment_failure":
            return severity.cohort_severity(
                _flags(w), K.STEP_OF_FAULT[fault], F.col("pay_method") == "upi",
                COHORTS[fault])
        step = K.STEP_OF_FAULT.get(fault, severity.CRASH)
        return severity.cohort_severity(_with_users(w), step, _cohort(fault), COHORTS[fault])
    run.__name__ = name
    query(run)


_severity("severity_dead_screen", "dead_screen")
_severity("severity_checkout", "checkout_latency")
_severity("severity_cold_start", "cold_start")
_severity("severity_payment", "payment_failure")
_severity("severity_crash", "crash_concentration")


@query
def aggregate_shift(w):
    return severity.aggregate_shift(_flags(w))


@query
def crash_rate_by_os(w):
    return symptoms.crash_rate_by_os(_histogram(w))


@query
def latency_p95_by_os(w):
    return symptoms.latency_p95_by_os(_histogram(w)).withColumn("p95", F.round("p95", 4))


@query
def symptom_by_os(w):
    return symptoms.symptom_by_os(_histogram(w, recent=False))


@query
def group_median(w):
    h = _histogram(w)
    crash = symptoms.group_median(symptoms.crash_rate_by_os(h), "rate")
    slow = symptoms.group_median(symptoms.latency_p95_by_os(h), "p95", positive_only=True)
    return crash.withColumnRenamed("median", "crash_median").join(
        slow.select("instance_id", F.round("median", 4).alias("p95_median")), "instance_id")


@query
def top_suspect(w):
    return symptoms.top_suspect(symptoms.crash_rate_by_os(_histogram(w)), "rate")


@query
def naive_funnel(w):
    return funnel.naive_funnel(w.raw_events)


@query
def naive_funnel_periods(w):
    return funnel.naive_funnel(w.raw_events, cases=w.cases)


@query
def cohort_separability(w):
    return cohorts.cohort_separability(w.user_rows, _planted(w), cases=w.cases)


@query
def separability_pairs(w):
    return cohorts.cohort_separability(w.user_rows, _planted(w), best_only=False)


@query
def cohort_prf(w):
    return score.score_claims(cut(_claims(w)), w.user_rows, cut(_planted(w)))


@query
def id_set_prf(w):
    """Methods as claims: users of a method after the change against the planted users."""
    used = _flags(w).filter("period = 'post' AND pay_method IS NOT NULL").select(
        "instance_id", F.col("pay_method").alias("claim_id"), "user_id").distinct()
    used = cut(used)
    return cohorts.id_set_prf(used.select("instance_id", "claim_id").distinct(), used, _planted(w))


@query
def dictionary_stats(w):
    return names.dictionary_stats(w.surface_forms)


@query
def forms_by_canonical(w):
    return names.forms_by_canonical(w.surface_forms)


@query
def gold_record(w):
    return _gold(w).drop("decoy_screens").withColumn(
        "acceptable_mechanisms", F.array_join("acceptable_mechanisms", ","))


@query
def gold_users(w):
    return _planted(w)


# --- detectors, ranking, scoring ----------------------------------------------------------

def _finding(df: DataFrame) -> DataFrame:
    return df.select("instance_id", "mechanism_type", "affected_cohort",
                     F.round("score", 6).alias("score"), "confidence")


@query
def detect_crash(w):
    return _finding(detect.detect_crash(_histogram(w), factor=LOOSE["crash_factor"]))


@query
def detect_latency(w):
    return _finding(detect.detect_latency(_histogram(w), factor=LOOSE["latency_factor"]))


@query
def detect_none(w):
    """Only crashes are looked at here, with a strict factor, so that cases stay unexplained."""
    return detect.detect_none(w.cases, detect.detect_crash(_histogram(w), factor=1.2)).select(
        "instance_id", "mechanism_type", "affected_cohort", "confidence")


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("system", "instance_id", "rank", "mechanism_type", "affected_cohort",
                     F.round("confidence", 6).alias("confidence"))


@query
def rank_hypotheses(w):
    return _ranked(_baseline(w))


@query
def scan_hypotheses(w):
    return _ranked(_scan_hypotheses(w, _with_users(w)))


@query
def best_hypothesis(w):
    h, planted = _suite(w)
    judged = score.judged_hypotheses(
        h, w.answers, score.score_claims(score.claims_of(h), w.user_rows, planted))
    return score.best_hypothesis(judged)


@query
def compile_cohort_bulk(w):
    return cohorts.compile_claims(w.user_rows, _claims(w))


# Texts as systems write them: grouped ones, one about another table, and no predicates.
MIXED_CLAIMS = (
    "(os = 'MACHINERY')", "os == 'BUILDING'", "NOT (os = 'HOUSEHOLD' OR geo = 'ASIA')",
    "device_age_months BETWEEN 10 AND 20", "os LIKE 'A%' AND device_type NOT IN ('mid')",
    "geo IS NULL OR is_returning = FALSE", "payment_method = 'upi'", "all users", "os = 'X' AND", "")


def _mixed_claims(w: ClickWarehouse) -> DataFrame:
    texts = F.explode(F.array(*map(F.lit, MIXED_CLAIMS)))
    return w.user_rows.select("instance_id").distinct().select(
        "instance_id", texts.alias("predicate")).withColumn("claim_id", F.col("predicate"))


@query
def score_mixed_claims(w):
    return score.score_claims(_mixed_claims(w), w.user_rows, _planted(w))


@query
def compile_mixed_claims(w):
    return cohorts.compile_claims(w.user_rows, _mixed_claims(w))


@query
def cohort_clauses(w):
    return cohorts.cohort_clauses(_claims(w))


@query
def score_cases(w):
    return _scores(w)


@query
def suite_summary(w):
    return score.suite_summary(_scores(w))


# --- names --------------------------------------------------------------------------------

@query
def name_variants(w):
    bases = w.table("part").select(
        F.concat_ws("_", F.replace(F.lower("p_name"), F.lit(" "), F.lit("_")),
                    F.lower("p_type")).alias("base")).distinct()
    return names.name_variants(bases)


@query
def owned_variants(w):
    bases = w.table("part").groupBy(
        F.replace(F.lower("p_name"), F.lit(" "), F.lit("_")).alias("base")).agg(
        F.min("p_partkey").alias("position"))
    return names.owned_variants(bases)


@query
def resolve_names(w):
    return names.resolve_names(w.raw_events, _dictionary(w))


@query
def resolve_events(w):
    # the dictionary is a stored table: written here, its small size is known to the joins
    return names.resolve_events(w.raw_events, cut(_dictionary(w))).groupBy(
        "instance_id", "logical_key").agg(F.count("*").alias("n_events"))


@query
def dictionary_audit(w):
    return names.dictionary_audit(w.raw_events, _dictionary(w))


@query
def resolution_pr(w):
    d = _dictionary(w)
    return names.resolution_pr(names.resolve_names(w.raw_events, d), _map(w), d)


# --- composed reports ---------------------------------------------------------------------

@query
def funnel_report(w):
    return funnel.funnel_report(_flags(w))


@query
def funnel_by_segment(w):
    return funnel.funnel_report(_with_users(w), segment="device_type")


@query
def severity_scan(w):
    return severity.severity_scan(_with_users(w))


@query
def severity_scan_pairs(w):
    return severity.severity_scan(_with_users(w), pairs=True)


@query
def severity_ztest(w):
    scan = severity.severity_ztest(severity.severity_scan(_with_users(w)))
    return scan.withColumn("z", F.round("z", 6))


@query
def severity_discoveries(w):
    tested = severity.severity_ztest(severity.severity_scan(_with_users(w), pairs=True)).withColumn(
        "p", significance.normal_tail(F.col("z")))
    found = significance.step_up(tested)
    return found.select("instance_id", "attr", "value", "from_stage", "to_stage", F.round("p", 9).alias("p"),
                        F.round("q", 9).alias("q"), "discovery")


@query
def slo_audit(w):
    audit = symptoms.slo_audit(w.events, w.cases, cold_start_screen="app")
    return audit.withColumn("p95", F.round("p95", 4))


@query
def payment_parity(w):
    return symptoms.payment_parity(_flags(w))


# Steps of the retail funnel treated as optional screens: one with, one without a dismissal.
RETAIL_DECOYS = {
    "home": ("home_view", "product_browse", ()),
    "product_detail": ("product_detail_view", None, K.STAGES[4:]),
}


@query
def decoy_report(w):
    return symptoms.decoy_report(_flags(w), vocabulary=K.STAGES, decoys=RETAIL_DECOYS)


@query
def cohort_stats(w):
    return confounders.cohort_stats(_with_users(w), _cohort("crash_concentration"))


@query
def confounder_check(w):
    return confounders.confounder_check(_with_users(w))


@query
def simpson_check(w):
    found = confounders.simpson_check(_with_users(w))
    return found.select("instance_id", "attr", "flag", *(
        F.round(c, 6).alias(c) for c in ("total_delta", "max_seg_delta", "min_seg_delta")))


@query
def mix_shift(w):
    return confounders.mix_shift(_with_users(w), "os").select("instance_id", "segment", *(
        F.round(c, 9).alias(c) for c in ("within", "mix", "total")))


@query
def detection_curve(w):
    return score.detection_curve(_scores(w), w.cases)


@query
def credit_bands(w):
    return score.credit_bands(_scores(w))


@query
def fp_and_resistance(w):
    return score.fp_and_resistance(_scores(w), w.cases)


@query
def system_comparison(w):
    return score.system_comparison(_scores(w), first="baseline", second="scan")


@query
def severity_calibration(w):
    return score.severity_calibration(_gold(w), tolerance_pp=1.0)


@query
def label_agreement(w):
    human = w.table("labels").select("doc_id", F.col("quality").alias("good"))
    judge = w.table("documents").select(
        "doc_id", (F.col("n_chars") >= 500).cast("int").alias("good"))
    return score.label_agreement(human, judge, on="doc_id", label="good")


# --- retrieval ----------------------------------------------------------------------------

def _asked(w: ClickWarehouse) -> DataFrame:
    return w.table("benchmark").select(F.col("item_id").alias("query_id"), "text")


def _lexical(w: ClickWarehouse) -> retrieval.LexicalIndex:
    """Frequencies of the terms that are asked for, stored once for all searches of a query."""
    corpus = w.table("documents").select("doc_id", "text")
    return retrieval.lexical_index(cut(retrieval.term_frequencies(corpus, retrieval.asked_terms(_asked(w)))))


def _dense(w: ClickWarehouse) -> DataFrame:
    """The mean vector of each label as a query."""
    rows = w.table("embeddings")
    mean = (
        rows.select("label", F.posexplode("embedding").alias("i", "x"))
        .groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
        .select(F.col("label").cast("bigint").alias("query_id"), F.col("v.x").alias("vector")))
    return retrieval.dense_topk(
        rows.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), mean)


def _shown(df: DataFrame) -> DataFrame:
    return df.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query
def bm25_topk(w):
    return _shown(retrieval.bm25_search(_lexical(w), _asked(w), prune=False))


@query
def dense_topk(w):
    return _shown(_dense(w))


@query
def hybrid_topk(w):
    """Two rankings of the same documents: as usual, and with length counting for nothing."""
    index, asked = _lexical(w), _asked(w)
    return _shown(retrieval.fused_topk([
        retrieval.bm25_search(index, asked, prune=False),
        retrieval.bm25_search(index, asked, k1=0.4, b=0.0, prune=False)]))


# --- the larger order-line stream ---------------------------------------------------------

def _orders(fn: Callable[[OrderWarehouse], DataFrame]) -> Callable:
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(OrderWarehouse(spark, sf_dir))
    return fn


@_orders
def order_severity_scan(w):
    flags = sessions.session_flags(w.raw_events, w.cases, closed=True)
    return severity.severity_scan(sessions.attach_users(flags, w.user_rows))


@_orders
def order_funnel_report(w):
    return funnel.funnel_report(sessions.session_flags(w.raw_events, w.cases, closed=True))


@_orders
def order_symptom_by_os(w):
    return symptoms.symptom_by_os(symptoms.signal_histogram(w.events))

