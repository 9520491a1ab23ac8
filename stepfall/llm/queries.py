"""Queries over the given tables, one per operator, and the SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfall.llm import (
    capfilters, debruijn, divergence, hilbert, minhash, mixing, packing, periodic, pii, secrets, suffixes,
    toxicity, warc,
)
from stepfall.llm.common import table, word_count
from stepfall.plans.materialize import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.Banding(words=2))


@query
def op2_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), TOKENIZER).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scanned(docs, secrets.train(docs)).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_field", "n_agreed")


@query
def op4_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(table(spark, sf_dir, "documents"))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), teaches=fold != 0)
    return toxicity.scored(docs, model).select(
        "doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = cut(table(spark, sf_dir, "documents").select(
        "doc_id", "source", word_count(F.col("text")).alias("size")))
    return mixing.mix(sized, size=F.col("size")).select(
        "doc_id", "size", "source_size", "target", "taken")


@query
def op7_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op8_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    archive = warc.write_archive(pages)
    return warc.lookup(spark, archive, pages.select("url", "page_id")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op8_warc_archive"] = """
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END
           AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
             sha1(coalesce(html, '')) AS payload_digest,
             max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keeper
      FROM pages)
"""


@query
def op9_cap_filter_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilters.near_duplicates(table(spark, sf_dir, "embeddings"))


SQL["op9_cap_filter_near_duplicates"] = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), n AS (
    SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS size
    FROM v WHERE label IS NOT NULL AND e IS NOT NULL
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label
        AND a.vec_id <> b.vec_id
    WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.98
), reach AS (
    SELECT vec_id AS a, vec_id AS b FROM v
    UNION
    SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE a = v.vec_id) AS n_links,
       m.component_id, v.vec_id = m.component_id AS kept
FROM v JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) m ON m.a = v.vec_id
"""


@query
def op10_debruijn_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.without_repeats(table(spark, sf_dir, "documents"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.crc32(F.col("doc_id").cast("string"))
    n = word_count(F.col("text")).cast("int")
    numbered = table(spark, sf_dir, "documents").select("doc_id", "text", h.alias("h"), n.alias("n"))
    g, n = F.floor(F.col("h") / 10), F.col("n")
    placed = numbered.withColumn("a", F.try_mod(g, n).cast("int")).withColumn(
        "p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    text = F.when((F.col("h") % 10 == 0) & (n > 0), periodic.repeated_tail(
        F.col("text"), F.col("a"), F.col("p"))).otherwise(F.col("text"))
    best = periodic.strongest(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return periodic.periodic_runs(placed, text=text).withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query
def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, F.lit(k).__eq__)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return pii.found(table(spark, sf_dir, "documents")).select(
        "doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"))


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


SQL["op13_source_divergence"] = r"""
WITH docs AS (
    SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
), words AS (
    SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM docs
), kept AS (
    SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 30
), sizes AS (
    SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang
), used AS (
    SELECT lang, source, term, count(*) AS c FROM words SEMI JOIN kept USING (lang, term)
    GROUP BY lang, source, term
), spread AS (
    SELECT lang, source, sum(c) AS n FROM used GROUP BY lang, source
), groups AS (
    SELECT DISTINCT lang, source FROM docs
), cells AS (
    SELECT g.lang, g.source, k.term, coalesce(u.c, 0) AS c,
           1 + (1000000000::HUGEINT * (coalesce(u.c, 0) + 5)) // (coalesce(s.n, 0) + 5 * z.v) AS p,
           1 + (1000000000::HUGEINT * (k.total + 5)) // (z.n + 5 * z.v) AS q
    FROM groups g JOIN kept k USING (lang) JOIN sizes z USING (lang)
    LEFT JOIN spread s ON s.lang = g.lang AND s.source = g.source
    LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source AND u.term = k.term
), far AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
    GROUP BY ALL
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
), terms AS (
    SELECT lang, source, term AS item, p - q AS value FROM cells WHERE c > 0 AND p > q
), ranked AS (
    SELECT lang, source, 'pair' AS part, item, value FROM pairs
    UNION ALL SELECT lang, source, 'term', item, value FROM terms
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM ranked)
WHERE part = 'pair' OR rank <= 50
"""
