"""Cohorts: predicates, affected users, separability, bulk compilation, set overlap.

A user table of any size has few distinct attribute combinations.  Everything that only needs
counts (separability, claim scoring) first folds users to one row per combination, its
*profile*, and works on those; ids are touched only where ids are the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfall.constants import USER_ATTRIBUTES
from stepfall.functions import normal_form
from stepfall.functions.measures import precision_recall_f1, rate
from stepfall.functions.predicates import (
    checked_predicate, flat_pieces, is_flat, is_refused, literal_values, number_value, text_value,
)
from stepfall.plans.joins import with_cases

USER = ["instance_id", "user_id"]
ATTRS = list(USER_ATTRIBUTES)


# --- predicates ---------------------------------------------------------------------------

def cohort_column(text: str, columns: Sequence[str] = USER_ATTRIBUTES) -> Column:
    """Boolean column of a predicate text; false for everyone when it is refused or no predicate."""
    checked = checked_predicate(text, columns)
    try:
        return F.lit(False) if checked is None else F.expr(checked)
    except ParseException:
        return F.lit(False)


def compile_cohort(
    table: DataFrame, predicate: str, *, columns: Sequence[str] = USER_ATTRIBUTES,
) -> DataFrame:
    """Distinct users matching a predicate text; none when it is refused or does not analyse.

    Pass ``users`` for user-level predicates, or ``events`` with more ``columns`` (such as
    ``payment_method``) for event-level ones.
    """
    try:
        kept = table.filter(cohort_column(predicate, columns))
        kept.schema  # noqa: B018 - analyse now, so a bad predicate is caught here
    except AnalysisException:
        kept = table.filter(F.lit(False))
    return kept.select(*USER).distinct()


def predicate_guard(hypotheses: DataFrame) -> DataFrame:
    """Mark claims whose predicate is blank or holds a refused substring."""
    return hypotheses.withColumn("refused", is_refused(F.col("affected_cohort")))


def active_in_regression(sessions: DataFrame, cases: DataFrame, cohort: Column) -> DataFrame:
    """Session rows with ``active``: on or after the changepoint and in the cohort."""
    return (
        with_cases(sessions, cases, "changepoint_day")
        .withColumn("active", (F.col("day") >= F.col("changepoint_day"))
                    & F.coalesce(cohort, F.lit(False)))
        .drop("changepoint_day")
    )


# --- affected users -----------------------------------------------------------------------

def affected_users(sessions: DataFrame, users: DataFrame, cohort: Column) -> DataFrame:
    """Cohort members with a session that started on or after the changepoint."""
    late = sessions.filter(F.col("period") == "post").select(*USER).distinct()
    return users.filter(cohort).select(*USER).join(late, USER, "left_semi")


def affected_users_payment(sessions: DataFrame, method: str) -> DataFrame:
    """Users who chose ``method`` in a session on or after the changepoint."""
    return (
        sessions.filter((F.col("period") == "post") & (F.col("pay_method") == method))
        .select(*USER).distinct())


def methods_used(sessions: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Payment methods per user in regression sessions, as a sorted array of at most
    ``len(methods)`` names."""
    used = [F.bool_or(F.col("pay_method") == m).alias(m) for m in methods]
    names = F.filter(F.array(*(F.when(F.col(m), F.lit(m)) for m in sorted(methods))),
                     lambda x: x.isNotNull())
    return (
        sessions.filter((F.col("period") == "post") & F.col("pay_method").isNotNull())
        .groupBy(*USER).agg(*used).select(*USER, names.alias("methods")))


def affected_flag(users: DataFrame, affected: DataFrame) -> DataFrame:
    """Users with ``affected``: is the id in the set?"""
    marks = affected.select(*USER).distinct().withColumn("affected", F.lit(True))
    return users.join(marks, USER, "left").withColumn(
        "affected", F.coalesce("affected", F.lit(False)))


# --- profiles -----------------------------------------------------------------------------

def attribute_profiles(users: DataFrame, planted: DataFrame | None = None) -> DataFrame:
    """One row per attribute combination: number of users and of planted users."""
    marked = users.withColumn("affected", F.lit(False)) if planted is None else (
        affected_flag(users, planted))
    return marked.groupBy("instance_id", *ATTRS).agg(
        F.count("*").alias("n_users"), F.count_if("affected").alias("n_planted"))


def _attribute_rows() -> Column:
    """Generator of (column, vkey, s, x) per attribute; ``vkey`` is the value as join text.

    Numbers are keyed as doubles, so that 24 and 24.0 meet; a null has a key of its own.
    """
    def row(name: str) -> str:
        s, x = f"CAST({name} AS STRING)", "CAST(NULL AS DOUBLE)"
        if name == "device_age_months":
            s, x = "CAST(NULL AS STRING)", f"CAST({name} AS DOUBLE)"
        key = f"coalesce('=' || coalesce({s}, CAST({x} AS STRING)), 'null')"
        return f"struct('{name}' AS column, {key} AS vkey, {s} AS s, {x} AS x)"

    return F.expr(f"inline(array({', '.join(map(row, ATTRS))}))")


def cohort_separability(users: DataFrame, affected: DataFrame, *, best_only: bool = True,
                        cases: DataFrame | None = None) -> DataFrame:
    """Precision and recall of every single (column, value) as a description of the affected.

    The best pair per case has the highest product; ties go to the earlier column and then to
    the smaller value.  With ``cases`` a case without affected users answers with nulls.
    """
    order = F.lit(None).cast("int")
    for i, name in enumerate(ATTRS):
        order = F.when(F.col("col") == name, F.lit(i)).otherwise(order)
    profiles = attribute_profiles(users, affected)
    totals = profiles.groupBy("instance_id").agg(F.sum("n_planted").alias("n_affected"))
    pairs = (
        profiles.select("instance_id", "n_users", "n_planted", F.expr("inline(array(" + ", ".join(
            f"struct('{n}' AS col, CAST({n} AS STRING) AS value)" for n in ATTRS) + "))"))
        .filter(F.col("value").isNotNull())
        .groupBy("instance_id", "col", "value")
        .agg(F.sum("n_users").alias("n"), F.sum("n_planted").alias("k"))
        .join(totals, "instance_id")
        .filter(F.col("n_affected") > 0)
        .withColumn("p", rate(F.col("k"), F.col("n")))
        .withColumn("r", rate(F.col("k"), F.col("n_affected")))
        .withColumn("pr", F.col("p") * F.col("r"))
    )
    kept = ["instance_id", "n_affected", "col", "value",
            F.round("p", 3).alias("precision"), F.round("r", 3).alias("recall"),
            F.round(F.round("p", 3) * F.round("r", 3), 3).alias("product")]
    if not best_only:
        return pairs.select(*kept)
    number = F.when(F.col("col") == "device_age_months", F.col("value").cast("int"))
    first = Window.partitionBy("instance_id").orderBy(
        F.col("pr").desc(), order, number, F.col("value"))
    best = (pairs.withColumn("rn", F.row_number().over(first)).filter("rn = 1 AND pr > 0")
            .select(*kept))
    if cases is None:
        return best
    return cases.select("instance_id").join(best, "instance_id", "left").withColumn(
        "n_affected", F.coalesce("n_affected", F.lit(0)).cast("bigint"))


# --- many claims at once ------------------------------------------------------------------

CLAIM = ["instance_id", "claim_id"]


def cohort_clauses(claims: DataFrame) -> DataFrame:
    """Clause rows of flat predicate texts (columns ``instance_id, claim_id, predicate``).

    Other texts yield no rows here: refused ones select nobody, and those with grouping, NOT,
    BETWEEN, LIKE or IS NULL are what :func:`grouped_clauses` is for.  A clause whose literal does
    not fit its column keeps null values and so matches nobody.  IN has one row per value.
    """
    text = F.col("predicate")
    column = F.col("c.column")
    parted = (
        claims.filter(~is_refused(text) & is_flat(text))
        .select(*CLAIM, F.posexplode(flat_pieces(text)).alias("clause_id", "c"))
        .select(*CLAIM, "clause_id", "c", F.explode(literal_values(F.col("c.raw"))).alias("lit"))
    )
    return parted.select(
        *CLAIM, F.col("c.disjunct_id").alias("disjunct_id"), "clause_id",
        column.alias("column"), F.col("c.op").alias("op"),
        text_value(column, F.col("lit")).alias("str_value"),
        number_value(column, F.col("lit")).alias("num_value"))


# How a clause tests an attribute value: numbers as numbers, everything else as text.
_TESTS = " ".join(
    f"WHEN '{op}' THEN if(x IS NOT NULL, x {sign} num_value, s {sign} str_value)"
    for op, sign in (("eq", "="), ("in", "="), ("ne", "<>"), ("lt", "<"), ("le", "<="),
                     ("gt", ">"), ("ge", ">="))) + (
    " WHEN 'like' THEN s LIKE str_value WHEN 'notlike' THEN s NOT LIKE str_value"
    " WHEN 'null' THEN s IS NULL AND x IS NULL WHEN 'notnull' THEN s IS NOT NULL OR x IS NOT NULL")


_BITS = {name: 1 << i for i, name in enumerate(ATTRS)}
_BIT_OF = "CASE column " + " ".join(f"WHEN '{n}' THEN {b}" for n, b in _BITS.items()) + " END"


def _sized(clauses: DataFrame, claim: Sequence[str]) -> DataFrame:
    """Clauses with the number of clauses of their disjunct and the columns of their claim."""
    disjunct = Window.partitionBy(*claim, "disjunct_id")
    return clauses.withColumn(
        "n_clauses", F.size(F.collect_set("clause_id").over(disjunct))
    ).withColumn("colset", F.bit_or(F.expr(_BIT_OF)).over(Window.partitionBy(*claim)))


def _per_column_set(table: DataFrame, sized: DataFrame, kept: Sequence[str]) -> DataFrame:
    """``table`` once per column set in use, with the attributes outside the set nulled.

    There are at most 63 sets of six columns, so they travel as one short array.
    """
    sets = sized.agg(F.collect_set("colset").alias("s")).select(
        F.coalesce("s", F.expr("array(0)"))).scalar()
    spread = table.select(*kept, *ATTRS, F.explode(sets).alias("colset"))
    return spread.select(*kept, "colset", *(
        F.expr(f"if((colset & {bit}) != 0, {name}, NULL) AS {name}")
        for name, bit in _BITS.items()))


def match_profiles(profiles: DataFrame, clauses: DataFrame) -> DataFrame:
    """(claim, attribute combination) pairs where some disjunct is fully met.

    Profiles are first summed to the columns a claim names, so a claim about the OS meets a
    handful of rows.  Then relational division by equality joins: clauses are resolved to the
    attribute values that satisfy them on the short list of distinct values, and, since a
    combination has one value per column, the resolved clauses it meets are simply counted.
    """
    scope = ["instance_id"] if "instance_id" in clauses.columns else []
    claim = [*scope, "claim_id"]
    sized = _sized(clauses, claim)
    values = profiles.select(*scope, _attribute_rows()).distinct()
    wanted = (
        sized.join(values, [*scope, "column"]).filter(F.expr(f"CASE op {_TESTS} END"))
        .select(*claim, "colset", "disjunct_id", "n_clauses", "clause_id", "column", "vkey")
        .distinct())

    kept = ["instance_id", "n_users", "n_planted"]
    margins = _per_column_set(profiles, sized, kept).groupBy(
        "instance_id", "colset", *ATTRS).agg(
        F.sum("n_users").alias("n_users"), F.sum("n_planted").alias("n_planted"))
    profile = ["colset", *ATTRS, "n_users", "n_planted"]
    rows = margins.select("instance_id", *profile, _attribute_rows())
    owner = list(dict.fromkeys([*claim, "instance_id"]))
    return (
        rows.join(wanted, [*scope, "colset", "column", "vkey"])
        .groupBy(*owner, *profile, "disjunct_id", "n_clauses").agg(F.count("*").alias("n_met"))
        .filter(F.col("n_met") == F.col("n_clauses"))
        .select(*owner, *profile).distinct())


def compile_cohort_bulk(users: DataFrame, clauses: DataFrame) -> DataFrame:
    """User ids of every claim.

    Claims meet the folded profiles; the profiles that a claim selects are then looked up by users,
    who are read once for that and move by their whole attribute combination.
    """
    claim = [*(["instance_id"] if "instance_id" in clauses.columns else []), "claim_id"]
    profiles = attribute_profiles(users)
    matched = match_profiles(profiles, clauses)
    right = matched.select("claim_id", *(
        F.col(c).alias(f"m_{c}") for c in ("instance_id", "colset", *ATTRS)))
    same = (F.col("instance_id") == F.col("m_instance_id")) & (
        F.col("colset") == F.col("m_colset"))
    for name in ATTRS:
        same = same & F.col(name).eqNullSafe(F.col(f"m_{name}"))
    whole = F.struct(*ATTRS).alias("whole")
    spread = _per_column_set(profiles.withColumn("whole", whole), _sized(clauses, claim),
                             ["instance_id", "whole"])
    chosen = spread.join(right, same).select("claim_id", "instance_id", "whole")
    return users.select(*USER, whole).join(chosen, ["instance_id", "whole"]).select("claim_id", *USER)


TEXTS_PER_PLAN = 40
CLAUSE = ["disjunct_id", "clause_id", "column", "op", "str_value", "num_value"]


def grouped_clauses(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clause rows of the texts that are not flat, and the texts beyond clause rows.

    Each distinct text is read once, in tasks (``normal_form``).  Beyond are comparisons of two columns,
    constants as conditions, and texts whose normal form has very many disjuncts.
    """
    text = F.col("predicate")
    grouped = claims.filter(~is_refused(text) & ~is_flat(text))
    parsed = grouped.select("predicate").distinct().mapInArrow(normal_form.read_texts, normal_form.ROWS)
    scope = [c for c in ("instance_id",) if c in claims.columns]
    named = grouped.select(*scope, "claim_id", "predicate")
    clauses = named.join(parsed.filter("NOT rest"), "predicate").select(*scope, "claim_id", *CLAUSE)
    return clauses, parsed.filter("rest").select("predicate")


def claim_clauses(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clause rows of all claims, and the texts beyond clause rows."""
    grouped, beyond = grouped_clauses(claims)
    return cohort_clauses(claims).unionByName(grouped), beyond


def expression_matches(table: DataFrame, claims: DataFrame, texts: DataFrame) -> list[DataFrame]:
    """Rows of ``table`` (users or profiles) in the claims with the given texts, compiled as expressions.

    Meant for the few texts that clause rows cannot express.  ``TEXTS_PER_PLAN`` of them share a plan and
    one pass over the table.  They are streamed to the driver, which keeps only the plans.
    A text that is refused or is no predicate over the columns selects nobody.
    """
    scope = [c for c in ("instance_id",) if c in claims.columns]
    out, batch = [], []

    def plan() -> None:
        if batch:
            named = F.array_compact(F.array(*(F.when(c, F.lit(t)) for t, c in batch)))
            rows = table.withColumn("predicate", F.explode(named))
            out.append(rows.join(claims.select(*scope, "claim_id", "predicate"),
                                 [*scope, "predicate"]).drop("predicate"))
            batch.clear()

    for (one,) in texts.toLocalIterator():
        column = cohort_column(one)
        try:
            table.filter(column).schema  # noqa: B018 - analyse now, so a bad predicate is caught here
        except AnalysisException:
            continue
        batch.append((one, column))
        if len(batch) == TEXTS_PER_PLAN:
            plan()
    plan()
    return out


def compile_claims(users: DataFrame, claims: DataFrame) -> DataFrame:
    """User ids of every claim, whatever its text; claims that select nobody have no rows."""
    clauses, beyond = claim_clauses(claims)
    out = compile_cohort_bulk(users, clauses)
    for more in expression_matches(users, claims, beyond):
        out = out.unionByName(more.select("claim_id", *USER))
    return out


def claim_counts(matched: DataFrame) -> DataFrame:
    """Claimed users and planted users among them, per claim."""
    return matched.groupBy(*CLAIM).agg(
        F.sum("n_users").alias("n_claimed"), F.sum("n_planted").alias("n_both"))


def profile_prf(claims: DataFrame, counts: DataFrame, planted: DataFrame) -> DataFrame:
    """Precision, recall and F1 per claim from its counts.

    ``claims`` (instance_id, claim_id) keep a row even when they select nobody; ``planted``
    are the case's answer ids (which need not all be users).
    """
    answers = planted.groupBy("instance_id").agg(F.count("*").alias("n_planted"))
    return _scored(
        claims.select(*CLAIM).join(counts, CLAIM, "left").join(answers, "instance_id", "left"))


def id_set_prf(claims: DataFrame, claimed: DataFrame, planted: DataFrame) -> DataFrame:
    """The same measures from explicit id sets ``claimed(instance_id, claim_id, user_id)``."""
    counts = (
        claimed.select(*CLAIM, "user_id").distinct()
        .join(planted.select(*USER).withColumn("hit", F.lit(1)), USER, "left")
        .groupBy(*CLAIM)
        .agg(F.count("*").alias("n_claimed"), F.count("hit").alias("n_both")))
    answers = planted.groupBy("instance_id").agg(F.count("*").alias("n_planted"))
    return _scored(
        claims.select(*CLAIM).join(counts, CLAIM, "left").join(answers, "instance_id", "left"))


def _scored(sized: DataFrame) -> DataFrame:
    filled = sized.select(*CLAIM, *(
        F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
        for c in ("n_claimed", "n_planted", "n_both")))
    p, r, f1 = precision_recall_f1(
        F.col("n_claimed"), F.col("n_planted"), F.col("n_both"))
    return filled.select("*", p.alias("precision"), r.alias("recall"), f1.alias("f1"))

