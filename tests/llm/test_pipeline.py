"""The pipeline on a small corpus, stage by stage, and its odd inputs."""

import random

import pytest
from llm_fixtures import make_docs, sf_of  # noqa: F401
from pyspark.sql import functions as F
from test_minhash import shingle_set

import corpus_pipeline


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("bcdfgklmnr") + rng.choice("aeou") for _ in range(3))
    vocabulary = [word() for _ in range(400)]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(10, 80))]
        bad = i % 8 == 0
        if bad:
            words[3:3] = rng.sample(["stupid", "idiot", "worthless", "scum"], 2)
        if i % 9 == 1:
            words.insert(5, "password=" + "".join(rng.choice("0123456789abcdef") for _ in range(18)))
        rows.append((i, " ".join(words), f"s{i % 4}"))
        labels.append((i, int(bad)))
    for i in range(60):
        words = rows[10 * i + 3][1].split(" ")
        words[-1] = "changed"
        rows.append((1000 + i, " ".join(words), "s1"))
    return rows, labels


def stages(spark, docs, root):
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, root)
        path = f"{root}/stage{len(out)}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_every_stage_takes_effect(spark, make_docs, sf_of, corpus):  # noqa: F811
    rows, labels = corpus
    docs = make_docs(rows)
    root = sf_of(documents=docs, labels=spark.createDataFrame(labels, "doc_id long, toxic int"))
    clean, single, safe, mixed, packed = stages(spark, docs, root)
    for step in (clean, single, safe, mixed):
        assert step.columns == docs.columns
    bad = {i for i, y in labels if y}
    kept = {r.doc_id for r in clean.collect()}
    assert not bad & kept and len(kept) >= 0.98 * (len(rows) - len(bad) - 8)
    # near-duplicates, against all pairs of five-word shingle sets
    sets = {r.doc_id: shingle_set(r.text, 5) for r in clean.collect()}
    ids = sorted(sets)
    gone = {j for k, i in enumerate(ids) for j in ids[k + 1:] if sets[i] and 100 * len(
        sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert {r.doc_id for r in single.collect()} == set(ids) - gone and gone
    texts = {r.doc_id: r for r in safe.collect()}
    assert texts.keys() == {r.doc_id for r in single.collect()}
    assert not any("password=" in r.text and "[SECRET]" not in r.text for r in texts.values())
    assert all(r.n_chars == len(r.text) for r in texts.values())
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert max(counts.values()) <= 3 and counts.keys() <= texts.keys()
    assert {r.doc_id: r.n for r in packed.groupBy("doc_id").agg(
        F.sum((F.col("piece") == 0).cast("int")).alias("n")).collect()} == counts
    used = packed.select("sequence_id").distinct().count()
    assert used <= packed.agg(F.sum("length")).first()[0] / 4096 + 2
    assert corpus_pipeline.run(spark, root).count() == packed.count()


def test_odd_rows_and_extra_columns(spark, make_docs, sf_of):  # noqa: F811
    docs = make_docs([(1, None, None), (2, "", "a"), (None, "x y", "b"), (3, "long word " * 30_000, "a"),
                      (4, "same text", "a"), (4, "same text", "a")])
    for c in ("size", "_row", "cls", "score", "copies", "key", "length"):
        docs = docs.withColumn(c, F.lit("extra"))
    root = sf_of(documents=docs, labels=spark.createDataFrame([], "doc_id long, toxic int"))
    steps = stages(spark, docs, root)
    assert all(s.columns == docs.columns for s in steps[:-1])
    assert steps[0].count() == 6 and steps[-1].count() > 0


def test_empty_tables(spark, make_docs, sf_of):  # noqa: F811
    docs = make_docs([])
    root = sf_of(documents=docs, labels=spark.createDataFrame([], "doc_id long, toxic int"))
    assert [s.count() for s in stages(spark, docs, root)] == [0] * 5


def test_workers_give_back_what_a_stage_has_freed(spark):
    import corpus_pipeline

    def settings():
        def run(batches):
            import os

            import pyarrow as pa
            for _ in batches:
                yield pa.RecordBatch.from_arrays([pa.array([
                    f"{os.environ.get('MALLOC_MMAP_THRESHOLD_')} {pa.default_memory_pool().backend_name}"])], names=["x"])
        return run

    corpus_pipeline.ready(spark)
    got = {r.x for r in spark.range(1).mapInArrow(settings(), "x string").collect()}
    assert got == {"1048576 system"}
