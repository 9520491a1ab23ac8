"""From raw documents to packed training sequences.

STAGES names the steps in order.  Each takes (spark, docs, sf_dir), works on all rows it is given and
returns documents again (the last one: packed pieces).  ``run`` stores every stage's result in the
shared folder as parquet and reads it back as the next one's input, so a lost executor never
costs more than the stage at hand.

1. toxicity: drops documents that score 0.5 or more; the model is learned from ``labels``.
2. near_duplicates: one document of each group of near-duplicates stays (five-word shingles,
   similarity 0.8 or more).
3. secrets: replaces the values of found secrets in the text.
4. mixing: takes documents as often as their source's target asks for.
5. packing: places the token pieces of all documents in sequences of 4096.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfall.llm import minhash, mixing, packing, toxicity
from stepfall.llm import secrets as secret_scan
from stepfall.llm.common import prepared, table, word_count
from stepfall.plans.materialize import cut

# Texts in a Python worker at a time.
BATCH_BYTES = 1 << 20

# Workers live from stage to stage: what one stage has freed goes back to the system, not into the next stage's share.
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1",
                 "MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_TRIM_THRESHOLD_": str(4 << 20)}

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

# Learned models and sampling take part, which SQL cannot express.
ORACLE_SQL = None


def ready(spark: SparkSession) -> None:
    prepared(spark).sparkContext.environment.update(WORKER_MEMORY)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not score as toxic.  Null and empty texts stay."""
    ready(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, whatever their ids; texts without words are never near-duplicates."""
    ready(spark)
    return minhash.one_of_each_component(docs, minhash.Banding(words=5))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets are replaced and ``n_chars`` follows the text."""
    ready(spark)
    return secret_scan.redacted(docs, secret_scan.train(docs), length="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, three times at most."""
    ready(spark)
    return mixing.repeated(mixing.mix(docs, size=word_count(F.col("text"))))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: where it comes from and where it lies."""
    ready(spark)
    return packing.packed_documents(docs, TOKENIZER).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
