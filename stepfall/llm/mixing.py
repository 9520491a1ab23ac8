"""Mix sources to target weights by Pareto order sampling.

Every source gets a target number of words; the ratio of target to source size is the expected
number of copies of its documents.  Whole copies are certain.  The fraction that is left is an
inclusion probability p, and documents are ranked by their random odds divided by their
inclusion odds, (u / (1-u)) / (p / (1-p)), with u a hash of the document's id: the first ones, up
to the words still needed, get one more copy.  So the sample's size in words is fixed, also when
the probabilities differ (``preference``).  The first document that does not fit ends a round;
the next round goes on down the ranking with documents that fit into what is left, and after
``ROUNDS`` of them the rest is a few words.

The end in the ranking is found without ordering a source in one place: two histograms (2,048
cells each) of words per source and rank cell leave one cell per source to order.

Cases: null text has size 0; null source is a source of its own, last in order; documents without
words get copies but take no words; no documents give an empty result; rows with the same doc_id
and source share their place in the ranking and are taken together or not at all.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfall.llm.common import packed
from stepfall.plans.materialize import cut

WEIGHTS = (5, 2, 1)          # by source in code point order, repeating
MAX_COPIES = 3
CELLS = 2048
ROUNDS = 4


@dataclass
class MixPlan:
    """One row per source: its size, target, and per round (largest size taken, end in the ranking)."""

    sources: DataFrame
    seed: int


def _key(source: Column) -> Column:
    return F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source.cast("string")))


def targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0,
            max_copies: int = MAX_COPIES) -> DataFrame:
    """One row per source: ``source, key, source_size, target``.

    Targets share the words of all sources by weight; a target stops at ``max_copies`` times its
    source and the excess is shared again, which is a common level l with target = min(cap, l*w).
    """
    totals = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("preference")).alias("pref"))
    everything = Window.partitionBy(F.lit(1))
    numbered = totals.withColumn("i", F.row_number().over(
        everything.orderBy(F.col("source").asc_nulls_last())) - 1)
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                         (F.col("i") % len(weights) + 1).cast("int"))
    capped = (numbered.withColumn("w", cycle)
              .withColumn("cap", F.col("source_size") * float(max_copies))
              .withColumn("all", F.sum("source_size").over(everything) * float(share)))
    rising = everything.orderBy(F.col("cap") / F.col("w"), "i")
    level = (capped
             .withColumn("before", F.coalesce(F.sum("cap").over(
                 rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
             .withColumn("rest", F.sum("w").over(
                 rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
             .withColumn("level", (F.col("all") - F.col("before")) / F.col("rest"))
             .withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"),
                                               F.struct(F.col("cap") / F.col("w"), "i", "level")))
                         .over(everything)["level"]))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(
        F.least("cap", F.col("level") * F.col("w")))
    return level.select("source", _key(F.col("source")).alias("key"), "source_size", "pref",
                        target.alias("target"))


def _ranked(rows: DataFrame, seed: int, max_copies: int) -> DataFrame:
    """Adds whole copies, inclusion probability and place in the ranking to rows with a plan.

    The place is a number in (0, CELLS) that rises with the random odds divided by the inclusion odds.
    """
    share = F.col("target") * F.col("preference") / F.col("pref")
    expected = F.least(F.coalesce(share, F.lit(0.0)), F.lit(float(max_copies)))
    near = F.round("e")
    odds = F.col("u") * (1 - F.col("p"))
    return (rows.withColumn("e", F.when(F.col("pref") > 0, expected).otherwise(0.0))
            .withColumn("e", F.when(F.abs(F.col("e") - near) < 1e-9, near).otherwise(F.col("e")))
            .withColumn("whole", F.floor("e")).withColumn("p", F.col("e") - F.col("whole"))
            .withColumn("u", (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "key"), 11)
                              + F.lit(0.5)) / F.lit(float(1 << 53)))
            .withColumn("place", F.when(F.col("p") > 0, odds / (
                odds + F.col("p") * (1 - F.col("u"))) * CELLS)).drop("e", "u"))


def _first_over(rows: DataFrame, by: list[str], cell: str) -> DataFrame:
    """Per group the first cell with which the words exceed ``need``; need becomes what it may hold."""
    cells = rows.groupBy(*by, cell, "need").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy(*by).orderBy(cell))
    return (cells.withColumn("upto", upto).filter("upto > need AND upto - words <= need")
            .select(*by, F.col(cell), (F.col("need") - F.col("upto") + F.col("words")).alias("need"),
                    (F.col("upto") - F.col("need")).alias("over")))


def _taken(p: Column, place: Column, size: Column, cuts: Column) -> Column:
    """Whether one of the rounds takes a row; a null end means that all fit."""
    return (p > 0) & F.exists(cuts, lambda c: (size <= c["largest"]) & (
        c["end"].isNull() | (place < c["end"]) | (c["closed"] & (place == c["end"]))))


def plan_mix(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0,
             max_copies: int = MAX_COPIES, seed: int = 17) -> MixPlan:
    """Targets and cuts for ``sized`` (doc_id, source, size, preference), which is read often."""
    sources = cut(targets(sized, weights, share, max_copies))
    rows = _ranked(sized.withColumn("key", _key(F.col("source"))).join(
        sources.drop("source"), "key"), seed, max_copies)
    certain = rows.groupBy("key").agg(F.sum(F.col("whole") * F.col("size")).alias("certain"))
    open_rows = cut(rows.filter("p > 0").select("key", "size", "place").withColumn(
        "c1", F.floor("place")).withColumn("c2", F.floor((F.col("place") - F.col("c1")) * CELLS)))
    state = cut(sources.join(certain, "key", "left").select(
        "key", "source_size", "pref", "target",
        (F.col("target") - F.coalesce("certain", F.lit(0))).alias("need"),
        F.lit(float("inf")).alias("largest"), F.lit(-1.0).alias("start"),
        F.lit(float("inf")).alias("over"),
        F.array().cast("array<struct<largest:double,end:double,closed:boolean>>").alias("cuts")))
    for _ in range(ROUNDS):
        fit = open_rows.join(state.select("key", "need", "largest", "start"), "key").filter(
            "place >= start AND size <= largest AND size > 0").drop("largest", "start")
        first = _first_over(fit, ["key"], "c1").drop("over")
        second = _first_over(fit.drop("need").join(first, ["key", "c1"]), ["key", "c1"], "c2").drop("over")
        last = _first_over(fit.drop("need").join(second, ["key", "c1", "c2"]),
                           ["key", "c1", "c2"], "place")
        found = last.select("key", F.col("place").alias("end"), F.col("need").alias("left"),
                            F.col("over").alias("beyond"))
        # where all that is left fits, its words are taken off and the rest stays a shortage
        words = fit.groupBy("key").agg(F.sum("size").alias("words"))
        left = F.coalesce("left", F.col("need") - F.coalesce("words", F.lit(0)))
        state = cut(state.join(found, "key", "left").join(words, "key", "left").select(
            "key", "source_size", "pref", "target", left.alias("need"), left.alias("largest"),
            F.coalesce("end", F.lit(float("inf"))).alias("start"),
            F.when(F.size("cuts") == 0, F.coalesce("beyond", F.lit(float("inf")))).otherwise(
                F.col("over")).alias("over"),
            F.concat("cuts", F.array(F.struct("largest", "end", F.lit(False).alias("closed"))))
            .alias("cuts")))
    # Where the first document that did not fit exceeds by less than what is left, take it instead.
    instead = F.array(F.col("cuts")[0].withField("closed", F.lit(True)))
    return MixPlan(cut(state.withColumn("cuts", F.when(
        F.col("over") < F.col("need"), instead).otherwise(F.col("cuts")))), seed)


def apply_mix(docs: DataFrame, plan: MixPlan, *, doc_id: str = "doc_id", source: str = "source",
              size: Column, preference: Column | None = None,
              max_copies: int = MAX_COPIES) -> DataFrame:
    """``docs`` in a struct ``_row`` with ``doc_id, size, source_size, target, copies, taken``."""
    rows = packed(docs, doc_id=F.col(doc_id), key=_key(F.col(source)), size=size,
                  preference=preference if preference is not None else F.lit(1.0))
    rows = _ranked(rows.join(plan.sources.select("key", "source_size", "pref", "target", "cuts"),
                             "key"), plan.seed, max_copies)
    extra = _taken(F.col("p"), F.col("place"), F.col("size"), F.col("cuts"))
    copies = F.col("whole").cast("long") + F.coalesce(extra, F.lit(False)).cast("long")
    return rows.withColumn("copies", copies).select(
        "_row", "doc_id", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", size: Column,
        preference: Column | None = None, weights: Sequence[float] = WEIGHTS, share: float = 1.0,
        max_copies: int = MAX_COPIES, seed: int = 17) -> DataFrame:
    """Decide the copies of every document; see ``apply_mix`` for the result.

    ``preference`` (positive) makes some documents of a source likelier than others; with a
    preference so uneven that documents reach ``max_copies``, a source stays below its target.
    """
    sized = cut(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"),
        (preference if preference is not None else F.lit(1.0)).alias("preference")))
    plan = plan_mix(sized, weights, share, max_copies, seed)
    return apply_mix(docs, plan, doc_id=doc_id, source=source, size=size, preference=preference,
                     max_copies=max_copies)


def repeated(mixed: DataFrame) -> DataFrame:
    """Each document as often as the mix takes it."""
    rows = mixed.filter("copies > 0").withColumn(
        "n", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select("_row.*")
