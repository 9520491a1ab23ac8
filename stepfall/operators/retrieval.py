"""Text and vector lookup over a corpus, for a bounded set of queries.

Scores are exact.  Only corpus tokens that occur in some query leave the scan, and the best k
per query are cut inside each task before anything moves by query.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfall.plans.joins import BROADCAST_LIMIT_BYTES, planned_bytes, small_side
from stepfall.plans.materialize import cut


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """Best ``k`` documents per query; equal scores go to the smaller id.

    Scores are sums whose order changes between runs, so they are compared to 9 digits: copies
    of a document then tie instead of swapping places.
    """
    scored = scored.withColumn("score", F.round("score", 9))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


MARKS = 256                  # names that mark documents, so that no name is hot
_MARK = "\u0000"


class LexicalIndex(NamedTuple):
    """Postings of a corpus and what is known of them by block.

    ``postings`` (doc_id, dl, term, tf, shard): one row per document and term.  ``blocks`` (term, shard, n,
    max_tf, min_dl): per term and class of document lengths.  ``marks`` (dl, tf): one row per document.
    """

    postings: DataFrame
    blocks: DataFrame
    marks: DataFrame


def _counted_here():
    """Per row the number of times each of its terms occurs; the other columns are repeated."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            terms = batch.column("terms")
            row = np.repeat(np.arange(batch.num_rows), terms.value_lengths().to_numpy())
            words = terms.flatten().dictionary_encode()
            width = max(1, len(words.dictionary))
            pairs, tf = np.unique(row * width + words.indices.to_numpy(), return_counts=True)
            at = pa.array(pairs // width)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("dl").take(at),
                 words.dictionary.take(pa.array(pairs % width)), pa.array(tf, pa.int64())],
                names=["doc_id", "dl", "term", "tf"])
    return run


def term_frequencies(corpus: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """``doc_id, dl, term, tf, shard`` of all documents in one tokenising pass.

    Every document also has a row of a mark instead of a term, so that documents and their mean length can be
    counted from the same rows.  ``only`` limits the terms (column ``term``).  A shard is a class of
    document lengths; lengths in a shard differ by at most about 40 %.

    A document is counted by the task that reads it and its rows stay together; only what ids that occur
    more than once have in common is added up by a shuffle.
    """
    ids = corpus.select("doc_id")
    again = cut(ids.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    mark = F.concat(F.lit(_MARK), F.pmod(F.xxhash64("doc_id"), F.lit(MARKS)).cast("string"))
    terms = F.concat(F.coalesce("t", F.array().cast("array<string>")), F.array(mark))

    def counted(docs: DataFrame) -> DataFrame:
        rows = docs.select("doc_id", tokens(F.col("text")).alias("t")).select(
            "doc_id", F.size("t").alias("dl"), terms.alias("terms"))
        kind = ids.schema["doc_id"].dataType.simpleString()
        rows = rows.mapInArrow(_counted_here(), f"doc_id {kind}, dl int, term string, tf long")
        if only is None:
            return rows
        marks = corpus.sparkSession.range(MARKS).select(
            F.concat(F.lit(_MARK), F.col("id").cast("string")).alias("term"))
        return rows.join(small_side(only.select("term").distinct().unionByName(marks)), "term", "left_semi")

    def added_up(rows: DataFrame) -> DataFrame:
        return rows.groupBy("doc_id", "dl", "term").agg(F.sum("tf").alias("tf"))

    if again.isEmpty():
        found = counted(corpus)
    elif (planned_bytes(again) or BROADCAST_LIMIT_BYTES + 1) > BROADCAST_LIMIT_BYTES:
        found = added_up(counted(corpus))
    else:
        several = again.withColumnRenamed("doc_id", "_several")
        same = F.col("doc_id").eqNullSafe(F.col("_several"))
        found = counted(corpus.join(F.broadcast(several), same, "left_anti")).unionByName(
            added_up(counted(corpus.join(F.broadcast(several), same, "left_semi"))))
    shard = F.coalesce(F.floor(2 * F.log2(F.col("dl") + 1)), F.lit(0)).cast("int")
    return found.select("doc_id", "dl", "term", "tf", shard.alias("shard"))


def _is_mark() -> Column:
    return F.col("term").startswith(_MARK)


def blocks_of(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term", "shard").agg(
        F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))


def lexical_index(frequencies: DataFrame) -> LexicalIndex:
    """An index over stored term frequencies."""
    postings = frequencies.filter(~_is_mark())
    return LexicalIndex(postings, blocks_of(postings), frequencies.filter(_is_mark()).select("dl", "tf"))


def asked_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))


def bm25_search(index: LexicalIndex, queries: DataFrame, *, k: int = 10, k1: float = 1.2, b: float = 0.75,
                prune: bool = True) -> DataFrame:
    """Lexical top-k of an index for ``queries(query_id, text)``; exact with and without ``prune``.

    The term weight is ``max(0, ln((N - n + 0.5) / (n + 0.5)))``: a term in half of the corpus
    or more weighs nothing and is left out of the join without changing a score.

    With ``prune``, the shards with the highest bounds are scored first, as many as are needed for k
    documents.  Their k-th score is a floor; of the other shards only those whose bound (greatest tf
    with the least length, for every term) reaches it are read.
    """
    asked = asked_terms(queries)
    n_docs = index.marks.agg(F.sum("tf")).scalar()
    mean = index.marks.agg(F.sum(F.col("dl") * F.col("tf")) / F.sum(F.when(F.col("dl").isNotNull(), F.col("tf")))).scalar()
    n = F.col("n")
    wanted = index.blocks.join(small_side(asked.select("term").distinct()), "term", "left_semi")
    weights = (
        wanted.groupBy("term").agg(F.sum("n").alias("n"))
        .withColumn("w", F.ln((n_docs - n + 0.5) / (n + 0.5))).filter("w > 0"))
    weighted = asked.join(weights.select("term", "w"), "term")

    def part(tf: str, dl: str) -> Column:
        tf, dl = F.col(tf), F.col(dl)
        return F.col("w") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean))

    def scored(terms: DataFrame, on: list[str]) -> DataFrame:
        # stored, so that its size is known: the estimate of a join grows with the corpus
        return index.postings.join(small_side(cut(terms)), on).groupBy("query_id", "doc_id").agg(
            F.sum(part("tf", "dl")).alias("score"))

    if not prune:
        return top_k(scored(weighted, ["term"]), k)
    bounds = weighted.join(wanted, "term").groupBy("query_id", "shard").agg(
        F.sum(part("max_tf", "min_dl")).alias("bound"), F.max("n").alias("least_docs"))
    by_bound = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "shard")
    ahead = F.sum("least_docs").over(by_bound.rowsBetween(Window.unboundedPreceding, -1))
    placed = bounds.withColumn("first", F.coalesce(ahead, F.lit(0)) < k)
    first = scored(placed.filter("first").join(weighted, "query_id").select("query_id", "shard", "term", "w"),
                   ["term", "shard"])
    floor = top_k(first, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    second = placed.filter("NOT first").join(floor, "query_id", "left").filter(
        F.col("bound") >= F.coalesce(F.col("least"), F.lit(0.0)) - 1e-8)
    rest = scored(second.join(weighted, "query_id").select("query_id", "shard", "term", "w"), ["term", "shard"])
    return top_k(first.unionByName(rest), k)


def bm25_topk(corpus: DataFrame, queries: DataFrame, *, k: int = 10, k1: float = 1.2,
              b: float = 0.75) -> DataFrame:
    """Lexical top-k of ``corpus(doc_id, text)`` without a stored index (see :func:`bm25_search`)."""
    index = lexical_index(cut(term_frequencies(corpus, asked_terms(queries))))
    return bm25_search(index, queries, k=k, k1=k1, b=b, prune=False)


def unit(vector: Column) -> Column:
    """The vector scaled to length one, in doubles; null components where it has no length."""
    wide = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(wide, lambda x: F.try_divide(x, norm))


QUERY_BLOCK = 1024
CORPUS_ROWS = 4096


def _block_best(k: int):
    """Per batch of corpus vectors and block of queries the best ``k`` of each query."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        block, queries, names = None, None, None
        for batch in batches:
            for part in (batch.slice(i, CORPUS_ROWS) for i in range(0, batch.num_rows, CORPUS_ROWS)):
                kinds = part.column("block").to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
                for a, b in zip(edges, edges[1:]):
                    rows = part.slice(a, b - a)
                    if kinds[a] != block:
                        block, queries, names = kinds[a], None, None
                    asks = rows.column("query_id").is_valid().to_numpy(zero_copy_only=False)
                    vectors = rows.column("v").flatten().to_numpy(zero_copy_only=False)
                    vectors = vectors.reshape(b - a, -1)
                    if asks.any():
                        more = vectors[asks]
                        ids = rows.column("query_id").filter(pa.array(asks)).to_numpy()
                        queries = more if queries is None else np.concatenate((queries, more))
                        names = ids if names is None else np.concatenate((names, ids))
                    if asks.all():
                        continue
                    docs = rows.column("doc_id").filter(pa.array(~asks)).to_numpy()
                    if names is None:
                        continue                          # no query in this block
                    scores = np.round(vectors[~asks] @ queries.T, 9)
                    take = min(k, len(docs))
                    low = np.partition(scores, len(docs) - take, axis=0)[len(docs) - take]
                    out = []
                    for j in range(len(names)):
                        near = np.flatnonzero(scores[:, j] >= low[j])
                        best = near[np.lexsort((docs[near], -scores[near, j]))[:take]]
                        out.append((np.full(len(best), names[j]), docs[best], scores[best, j]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(c)) for c in zip(*out)],
                        names=["query_id", "doc_id", "score"])
    return run


def dense_topk(corpus: DataFrame, queries: DataFrame, *, k: int = 10) -> DataFrame:
    """Cosine top-k of ``corpus(doc_id, vector)`` for ``queries(query_id, vector)``.

    Queries form blocks of about ``QUERY_BLOCK``, the corpus is dealt in shares of a few thousand
    rows, and every (share, block) is one matrix product of which only the best ``k`` per query
    leave the task.  Ids are whole numbers, vectors have one length.  All pairs are looked at, in
    blocks: exact, and meant for query sets much smaller than the corpus.
    """
    valid = lambda df, name: df.select(
        F.col(name).cast("long").alias(name), unit(F.col("vector")).alias("v")).filter(
        F.forall("v", lambda x: x.isNotNull()))
    asked, stored = valid(queries, "query_id"), valid(corpus, "doc_id")
    blocks = asked.agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("n")).scalar()
    shares = stored.agg(F.ceil(F.count("*") / (8 * CORPUS_ROWS)).alias("n")).scalar()
    block = F.pmod(F.xxhash64("query_id"), F.greatest(blocks, F.lit(1)))
    share = F.pmod(F.xxhash64("doc_id"), F.greatest(shares, F.lit(1)))
    none = F.lit(None).cast("long")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(shares, F.lit(1)) - 1)).alias("share")
    left = asked.select(none.alias("doc_id"), "query_id", "v", block.alias("block"), every)
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(blocks, F.lit(1)) - 1)).alias("block")
    right = stored.select("doc_id", none.alias("query_id"), "v", each, share.alias("share"))
    # within a (share, block) the queries come first
    dealt = left.unionByName(right).repartition("share", "block").sortWithinPartitions(
        "block", "share", F.col("query_id").isNull())
    dealt = dealt.select("doc_id", "query_id", "v", (F.col("block") * F.greatest(shares, F.lit(1))
                                                     + F.col("share")).alias("block"))
    found = dealt.mapInArrow(_block_best(k), "query_id long, doc_id long, score double")
    return top_k(found, k)


def fused_topk(rankings: list[DataFrame], *, k: int = 10, offset: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ``(query_id, doc_id, rank)`` tables."""
    every = rankings[0].select("query_id", "doc_id", "rank")
    for more in rankings[1:]:
        every = every.unionByName(more.select("query_id", "doc_id", "rank"))
    summed = every.groupBy("query_id", "doc_id").agg(
        F.sum(F.lit(1.0) / (F.col("rank") + offset)).alias("score"))
    return top_k(summed, k)
