"""End-to-end jobs over stored tables: look at cases, label and publish them, score systems."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from stepfall import constants as K
from stepfall.operators import answers as A
from stepfall.operators import detect, funnel, retrieval, score, sessions, symptoms
from stepfall.plans.attribution import all_systems
from stepfall.plans.materialize import cut
from stepfall.session import tune
from stepfall.sources import commits, tables


def symptom_view(events: DataFrame, cases: DataFrame | None = None) -> dict[str, DataFrame]:
    """The first look at a warehouse: volume, naive funnel, crash and latency by OS."""
    return {
        "volume": symptoms.case_volume(events),
        "funnel": funnel.naive_funnel(events, cases=cases),
        "by_os": symptoms.symptom_by_os(symptoms.signal_histogram(events)),
    }


def publish_cases(
    events: DataFrame, users: DataFrame, cases: DataFrame, answers: DataFrame,
    public_root: str, restricted_root: str, *, cohorts: Mapping[str, str] = K.DEFAULT_COHORTS,
) -> DataFrame:
    """Measure, label and publish cases as one commit; returns the hidden answer index.

    ``events`` carry ``canonical``, ``users`` may carry ``persona``; ``answers`` say per case
    what was planted.  Public tables pass the column guard before anything is written.  Readers see the
    new state of all tables of both roots at once, and the old one if a write fails before.
    """
    tune(events.sparkSession, events)
    tables.publish_events(events, users), tables.publish_users(users)      # refuse early
    rows = cut(sessions.attach_users(sessions.session_flags(
        events.drop(*K.USER_ATTRIBUTES), cases), users))
    planted = cut(A.planted_users(rows, answers, cohorts))
    gold = cut(A.gold_record(answers, rows, planted, cohorts))
    index = A.answer_index(gold, users, planted)

    spark, commit = events.sparkSession, commits.new_commit()
    commits.follow(spark, restricted_root, public_root)
    tables.write_public(events, users, public_root, commit=commit)
    tables.write_records_by_case(A.public_index(cases), f"{public_root}/index", commit=commit)
    tables.write_records_by_case(A.task_records(cases), f"{public_root}/tasks", commit=commit)
    tables.write_gold_users(planted, restricted_root, commit=commit)
    tables.write_records_by_case(gold, f"{restricted_root}/gold", commit=commit)
    tables.write_records_by_case(index, f"{restricted_root}/index", commit=commit)
    if "persona" in users.columns:
        tables.write_personas(users, restricted_root, commit=commit)
    commits.publish(spark, public_root, commit, cases)
    return index


def build_lexical_index(corpus: DataFrame, path: str) -> None:
    """Store the index of ``corpus(doc_id, text)`` for any number of query sets.

    Rows are ranged by shard, term and document, so a term in most documents spreads over many files,
    and within a file they are sorted by term: a search opens the shards it needs and skips row groups.
    """
    spark = corpus.sparkSession
    rows = retrieval.term_frequencies(corpus).repartitionByRange("shard", "term", "doc_id")
    rows.sortWithinPartitions("shard", "term", "doc_id").write.mode("overwrite").partitionBy("shard").parquet(
        f"{path}/postings")
    stored = spark.read.parquet(f"{path}/postings")
    index = retrieval.lexical_index(stored)
    index.marks.write.mode("overwrite").parquet(f"{path}/marks")
    index.blocks.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(
        f"{path}/blocks")


def open_lexical_index(spark: SparkSession, path: str) -> retrieval.LexicalIndex:
    """The index that :func:`build_lexical_index` stored."""
    postings = retrieval.lexical_index(spark.read.parquet(f"{path}/postings")).postings
    return retrieval.LexicalIndex(postings, spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/marks"))


class SuiteRun(NamedTuple):
    hypotheses: DataFrame
    scores: DataFrame
    summary: DataFrame
    rejects: DataFrame


def run_suite(
    spark: SparkSession, public_root: str, cases: DataFrame, gold: DataFrame,
    planted: DataFrame, *, systems: Sequence[str] = ("baseline",),
    submitted: Mapping[str, DataFrame] | None = None, only: Sequence[str] | None = None,
) -> SuiteRun:
    """Run registered detectors on stored cases and score them.

    ``submitted`` adds hypotheses that other systems wrote; ``only`` limits the cases.  Every
    system answers for every case, also where it returned nothing.  Hypotheses outside the closed
    set of mechanisms or with an impossible confidence are kept apart as rejects; the others of
    a run keep their order and close the gap in the ranks.
    """
    events = tables.read_table(spark, public_root, "events", only)
    users = tables.read_table(spark, public_root, "users", only)
    if only is not None:
        cases = cases.filter(cases["instance_id"].isin(*only))
    answers = {name: detect.DETECTORS[name](events, users, cases) for name in systems}
    answers.update(submitted or {})
    tune(spark, events)
    valid, invalid = detect.valid_hypotheses(cut(all_systems(answers)))
    hypotheses = cut(detect.closed_ranks(valid))
    runs = score.runs_of(list(answers), cases)
    scores = cut(score.score_cases(hypotheses, gold, planted, users, runs=runs))
    return SuiteRun(hypotheses, scores, score.suite_summary(scores), invalid)
