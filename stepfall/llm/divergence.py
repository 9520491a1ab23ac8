"""How far the sources of a language differ in their use of words, with late strings.

Term statistics are shuffled as 64-bit digests only.  Texts are read again for the strings, and only of
terms that are kept: every task keeps the least and the greatest string of each digest.  Where the
two differ, strings collided in a digest; just those digests are counted once more by string, and
each string becomes a term of its own (``part`` holds it; it is empty for all others).  A digest is in at least
as many documents as any of its strings, so dropping rare digests first loses no term.  Strings meet
results only at the end: terms that a report lists, and ties at its last rank.

Per (language, source) a term's share is ``1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V))``, with
V kept terms of the language and N their occurrences in the group; all arithmetic is in integers.

* ``term`` report: kept terms a source uses more than its language, by difference of shares, ``TOP`` of them.
* ``pair`` report: every other source of the language, by the sum of differences over all kept terms.

Pairs are summed in tiles: ``SIDE`` sources against ``SIDE``, terms in buckets of about ``BUCKET``.  A tile
gets only counts above zero; the rest is filled in as the share of a zero count, and terms that a tile
never saw enter by their number.  So no task holds more than a tile, whatever the number of sources or terms.
The answer itself has a row per pair of sources of a language.

Cases: null text, lang and source count as ''; a language without kept terms gives pairs with value 0
and no terms; a source without terms takes part; every row is a document, also where ids repeat;
ties are ordered by the UTF-8 bytes of the item; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfall.plans.joins import small_side
from stepfall.plans.materialize import cut

LEAST_DOCS = 30
SCALE = 1_000_000_000
SMOOTH = 5
TOP = 50
DIGEST_BITS = 64
SIDE = 64                    # sources of a tile's side
BUCKET = 4096                # terms of a tile, about
ENTRIES = 250_000            # terms by source that a task counts before it sends them

# A term is letters A to Z, in small letters, and bytes of characters beyond ASCII; all else separates.
_TERM_BYTES = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

COUNTS = "lang string, source string, digest long, n long, docs long"
COUNTS_BY_STRING = "lang string, source string, digest long, n long, docs long, part string"
NAMES = "lang string, digest long, low string, high string"
PARTIAL = "lang string, a int, b int, value long, seen long"


def digests(terms: list[bytes], bits: int) -> np.ndarray:
    """Signed 64-bit digests of which the lowest ``bits`` vary."""
    values = np.fromiter(map(xxhash.xxh3_64_intdigest, terms), np.uint64, len(terms))
    return (values & np.uint64((1 << bits) - 1)).view(np.int64)


def _documents(batch: pa.RecordBatch) -> Iterator[tuple[str, str, list[bytes]]]:
    texts = batch.column("text").cast(pa.binary())
    for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts):
        yield lang, source, text.as_py().translate(_TERM_BYTES).split()


def _counted(bits: int, by_string: bool) -> Callable:
    """Occurrences and documents of every digest, or of every string; a task sends at most ``ENTRIES`` at once."""
    def rows(counts: dict, docs: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), found in counts.items():
            terms, k, spread = list(found), len(found), docs[lang, source]
            columns = {"lang": pa.repeat(pa.scalar(lang), k), "source": pa.repeat(pa.scalar(source), k),
                       "digest": pa.array(digests(terms, bits), pa.int64()),
                       "n": pa.array(list(found.values()), pa.int64()),
                       "docs": pa.array(list(map(spread.__getitem__, terms)), pa.int64())}
            if by_string:
                columns["part"] = pa.array([t.decode() for t in terms], pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs, held = defaultdict(Counter), defaultdict(Counter), 0
        for batch in batches:
            for lang, source, terms in _documents(batch):
                group = counts[lang, source]
                held -= len(group)
                group.update(terms)
                held += len(group)
                docs[lang, source].update(set(terms))
                if held >= ENTRIES:
                    yield from rows(counts, docs)
                    counts, docs, held = defaultdict(Counter), defaultdict(Counter), 0
        yield from rows(counts, docs)
    return run


def _named(bits: int) -> Callable:
    """Least and greatest string of every digest; a task sends at most ``ENTRIES`` at once."""
    def rows(terms: dict) -> Iterator[pa.RecordBatch]:
        for lang, found in terms.items():
            ordered = sorted(found)
            key = digests(ordered, bits)
            _, first = np.unique(key, return_index=True)
            _, last = np.unique(key[::-1], return_index=True)
            names = pa.array([t.decode() for t in ordered], pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(first), pa.string()), pa.array(key[first]), names.take(pa.array(first)),
                 names.take(pa.array(len(ordered) - 1 - last))], names=["lang", "digest", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, held = defaultdict(set), 0
        for batch in batches:
            for lang, _, found in _documents(batch):
                held -= len(terms[lang])
                terms[lang].update(found)
                held += len(terms[lang])
                if held >= ENTRIES:
                    yield from rows(terms)
                    terms, held = defaultdict(set), 0
        yield from rows(terms)
    return run


def _summed(rows: DataFrame, *more: str) -> DataFrame:
    return rows.groupBy("lang", "source", "digest", *more).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _frequent(counts: DataFrame, least: int) -> DataFrame:
    return counts.groupBy("lang", "digest", "part").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("total")).filter(F.col("docs") >= least)


def kept_terms(rows: DataFrame, least: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """Kept terms ``lang, digest, part, term, total`` and their counts by source (above zero)."""
    texts = rows.filter("text <> ''")
    counts = cut(_summed(texts.mapInArrow(_counted(bits, False), COUNTS)).withColumn("part", F.lit("")))
    kept = cut(_frequent(counts, least))
    key = ["lang", "digest"]
    names = cut(texts.mapInArrow(_named(bits), NAMES).join(small_side(kept.select(*key)), key, "left_semi")
                .groupBy(*key).agg(F.min("low").alias("low"), F.max("high").alias("high")))
    counts = counts.join(small_side(kept.select(*key)), key, "left_semi")
    collided = names.filter("low <> high").select(*key)
    if not collided.isEmpty():
        by_string = _summed(texts.mapInArrow(_counted(bits, True), COUNTS_BY_STRING).join(
            small_side(collided), key, "left_semi"), "part")
        counts = cut(counts.join(collided, key, "left_anti").unionByName(by_string))
        kept = _frequent(counts, least)
        counts = counts.join(small_side(cut(kept).select(*key, "part")), [*key, "part"], "left_semi")
    terms = kept.join(names.select(*key, "low"), key).select(
        *key, "part", F.when(F.col("part") == "", F.col("low")).otherwise(F.col("part")).alias("term"), "total")
    return cut(terms), cut(counts)


def share(count: Column, total: Column, kept: Column, smooth: int = SMOOTH) -> Column:
    """The share of a term, in whole parts of ``SCALE``; counts beyond 64-bit products take decimals."""
    wide = lambda c, digits=20: c.cast(f"decimal({digits},0)")
    count, total, kept = (c.cast("long") for c in (count, total, kept))
    narrow = F.call_function("div", (count + F.lit(smooth)) * F.lit(SCALE), total + kept * F.lit(smooth))
    exact = F.call_function("div", (wide(count) + wide(F.lit(smooth), 3)) * wide(F.lit(SCALE), 10),
                            wide(total) + wide(kept) * wide(F.lit(smooth), 3))
    return F.lit(1).cast("long") + F.when(count < F.lit((1 << 62) // SCALE), narrow).otherwise(exact)


def _tile(side: int) -> Callable:
    """Sums of absolute differences between the sources of two blocks, over the terms seen here."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        lang, i, j, _ = (k.as_py() for k in key)
        column = {c: table.column(c).to_numpy() for c in ("s", "zero", "p")}
        sources, at = np.unique(column["s"], return_index=True)
        line = np.searchsorted(sources, column["s"])
        real = np.flatnonzero(table.column("digest").is_valid().to_numpy())
        used = table.select(["digest", "part"]).take(pa.array(real)).to_pydict()
        number: dict[tuple[int, str], int] = {}
        place = [number.setdefault(k, len(number)) for k in zip(used["digest"], used["part"])]
        grid = np.repeat(column["zero"][at][:, None], len(number), axis=1)
        grid[line[real], place] = column["p"][real]
        there = np.flatnonzero(sources // side == j)
        a, b, value = [], [], []
        for x in np.flatnonzero(sources // side == i).tolist():
            others = there[there > x]
            a.append(np.full(len(others), sources[x]))
            b.append(sources[others])
            value.append(np.abs(grid[others] - grid[x]).sum(axis=1))
        n = sum(map(len, a))
        columns = [np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b, value)]
        return pa.table({"lang": pa.array([lang] * n, pa.string()), "a": pa.array(columns[0], pa.int32()),
                         "b": pa.array(columns[1], pa.int32()), "value": pa.array(columns[2], pa.int64()),
                         "seen": pa.array(np.full(n, len(number)), pa.int64())})
    return run


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """``lang, a, b, value`` for every two sources of a language, a before b."""
    cells = groups.select("lang", "s", "zero", "blocks", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1))
                          .alias("bucket"), F.lit(None).cast("long").alias("digest"),
                          F.lit(None).cast("string").alias("part"), F.lit(0).cast("long").alias("p"))
    used = shares.select("lang", "s", "zero", "blocks", F.pmod(F.xxhash64("digest", "part"), F.col("buckets"))
                         .cast("int").alias("bucket"), "digest", "part", "p")
    own = F.floor(F.col("s") / SIDE).cast("int")
    tiles = cells.unionByName(used).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "lang", F.least(own, "other").alias("i"), F.greatest(own, "other").alias("j"), "bucket",
        "s", "zero", "digest", "part", "p")
    sums = tiles.groupBy("lang", "i", "j", "bucket").applyInArrow(_tile(SIDE), PARTIAL).groupBy("lang", "a", "b").agg(
        F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    side = lambda c: groups.select(
        "lang", F.col("s").alias(c), F.col("zero").alias(f"zero_{c}"), F.col("source").alias(f"source_{c}"), "kept")
    return sums.join(side("a"), ["lang", "a"]).join(side("b").drop("kept"), ["lang", "b"]).select(
        "lang", "source_a", "source_b",
        (F.col("value") + (F.col("kept") - F.col("seen")) * F.abs(F.col("zero_a") - F.col("zero_b"))).alias("value"))


def audit(docs: DataFrame, *, lang: str = "lang", source: str = "source", text: str = "text",
          least_docs: int = LEAST_DOCS, top: int = TOP, bits: int = DIGEST_BITS) -> DataFrame:
    """``lang, source, part, item, value, rank``: both reports of every (lang, source) group."""
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(blank(lang).alias("lang"), blank(source).alias("source"), blank(text).alias("text"))
    terms, counts = kept_terms(rows, least_docs, bits)
    key = ["lang", "digest", "part"]

    used = counts.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    kept = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_size"))
    group_of = rows.select("lang", "source").distinct().join(used, ["lang", "source"], "left") \
        .join(small_side(kept), "lang", "left").fillna(0, ["size", "kept", "lang_size"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    many = F.count("*").over(Window.partitionBy("lang"))
    zero = F.when(F.col("kept") > 0, share(F.lit(0), F.col("size"), F.col("kept"))).otherwise(0)
    groups = cut(group_of.select(
        "lang", "source", "size", "kept", "lang_size", place.alias("s"), zero.alias("zero"),
        F.ceil(many / SIDE).cast("int").alias("blocks"),
        F.greatest(F.lit(1), F.ceil(F.col("kept") / BUCKET)).cast("int").alias("buckets")))

    shares = cut(counts.join(small_side(groups), ["lang", "source"]).join(
        small_side(terms.select(*key, "total")), key).select(
        "lang", "source", "digest", "part", "s", "zero", "blocks", "buckets",
        share(F.col("n"), F.col("size"), F.col("kept")).alias("p"),
        share(F.col("total"), F.col("lang_size"), F.col("kept")).alias("q")))

    group = Window.partitionBy("lang", "source")
    more = shares.filter("p > q").select("lang", "source", "digest", "part", (F.col("p") - F.col("q")).alias("value"))
    tied = more.withColumn("r", F.rank().over(group.orderBy(F.desc("value")))).filter(F.col("r") <= top)
    ranked = group.orderBy(F.desc("value"), "item")
    listed = tied.withColumnRenamed("part", "split").join(
        small_side(terms.select("lang", "digest", F.col("part").alias("split"), F.col("term").alias("item"))),
        ["lang", "digest", "split"]).withColumn("rank", F.row_number().over(ranked)) \
        .filter(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    half = cut(_pairs(groups, shares))
    both = half.select("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"), "value").unionByName(
        half.select("lang", F.col("source_b").alias("source"), F.col("source_a").alias("item"), "value"))
    pairs = both.withColumn("rank", F.row_number().over(ranked)).select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    return pairs.unionByName(listed)
