import math
import random

import pytest
from conftest import rows

from stepfall.operators import retrieval

DOCS = {1: "checkout is slow slow", 2: "Checkout works", 3: "the cart view", 4: "cart cart the the",
        5: "nothing here"}


def brute_force(query, k1=1.2, b=0.75):
    split = {d: t.lower().split() for d, t in DOCS.items()}
    mean = sum(map(len, split.values())) / len(split)
    out = {}
    for term in set(query.lower().split()):
        n = sum(term in t for t in split.values())
        w = math.log((len(split) - n + 0.5) / (n + 0.5)) if n else 0
        for d, t in split.items():
            if w > 0 and term in t:
                tf = t.count(term)
                out[d] = out.get(d, 0) + w * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(t) / mean))
    return out


def test_bm25_equals_brute_force(spark):
    docs = spark.createDataFrame(list(DOCS.items()), "doc_id int, text string")
    asked = {7: "SLOW checkout, slow!", 8: "the cart", 9: "unknown"}
    queries = spark.createDataFrame(list(asked.items()), "query_id int, text string")
    got = retrieval.bm25_topk(docs, queries, k=5).collect()
    assert {r.query_id for r in got} == {7, 8}
    for q in (7, 8):
        wanted = brute_force(asked[q].replace(",", "").replace("!", ""))
        mine = {r.doc_id: r.score for r in got if r.query_id == q}
        assert mine == pytest.approx(wanted)
    assert [r.doc_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 7] == [1, 2]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    from stepfall.plans import jobs
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    texts = [(i, " ".join(rng.choices(words, [1 / (1 + j) for j in range(60)], k=rng.choice([0, 3, 12, 200]))))
             for i in range(600)] + [(600, None), (601, "w0 w1"), (601, "w0 w1")]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    path = str(tmp_path_factory.mktemp("index"))
    jobs.build_lexical_index(docs, path)
    return docs, jobs.open_lexical_index(spark, path)


@pytest.mark.parametrize("k,k1,b", [(1, 1.2, 0.75), (7, 1.2, 0.75), (5, 0.4, 0.0), (1000, 1.2, 1.0)])
def test_a_stored_index_serves_any_query_set(spark, stored, k, k1, b):
    docs, index = stored
    for asked in (["w3 w40", "w59", "none"], ["w10 w11 w12 w13", "w0", "w50 w50 w2"]):
        queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, text string")
        plain = retrieval.bm25_topk(docs, queries, k=k, k1=k1, b=b)
        for prune in (True, False):
            got = retrieval.bm25_search(index, queries, k=k, k1=k1, b=b, prune=prune)
            assert rows(got, "query_id", "rank", "doc_id", "score") == rows(
                plain, "query_id", "rank", "doc_id", "score")


def test_blocks_bound_their_postings(stored):
    _, index = stored
    joined = index.postings.join(index.blocks, ["term", "shard"])
    assert joined.count() == index.postings.count()
    assert joined.filter("tf > max_tf OR dl < min_dl").count() == 0
    assert index.marks.agg({"tf": "sum"}).collect()[0][0] == 603


def test_texts_are_read_once(spark, stored, tmp_path):
    docs, _ = stored
    docs.write.parquet(f"{tmp_path}/corpus")
    got = retrieval.bm25_topk(spark.read.parquet(f"{tmp_path}/corpus"),
                              spark.createDataFrame([(1, "w3")], "query_id int, text string"))
    # what is left to run reads the stored frequencies only
    assert got.inputFiles() and not [f for f in got.inputFiles() if f.startswith(f"file://{tmp_path}/corpus")]


def test_cosine_order_and_ties(spark):
    docs = spark.createDataFrame(
        [(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), (4, [-1.0, 0.0]), (5, [0.0, 0.0])],
        "doc_id int, vector array<float>")
    queries = spark.createDataFrame([(1, [5.0, 0.0]), (2, [0.0, 1.0])],
                                    "query_id int, vector array<double>")
    got = retrieval.dense_topk(docs, queries, k=3)
    assert rows(got, "query_id", "rank", "doc_id")[:3] == [(1, 1, 1), (1, 2, 3), (1, 3, 2)]


def test_many_query_vectors(spark, monkeypatch):
    """1,500 queries in blocks over a corpus in shares, against plain products."""
    import numpy as np
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 400)
    monkeypatch.setattr(retrieval, "CORPUS_ROWS", 50)
    rng = np.random.default_rng(1)
    corpus, asked = rng.normal(size=(900, 6)), rng.normal(size=(1500, 6))
    table = lambda x, name: spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(x)], f"{name} int, vector array<double>").repartition(3)
    got = retrieval.dense_topk(table(corpus, "doc_id"), table(asked, "query_id"), k=4).collect()
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = np.round(unit(asked) @ unit(corpus).T, 9)
    best = np.argsort(-scores, axis=1, kind="stable")[:, :4]
    assert len(got) == 6000
    for r in got:
        assert best[r.query_id, r.rank - 1] == r.doc_id
        assert r.score == pytest.approx(scores[r.query_id, r.doc_id], abs=2e-9)


def test_no_vectors(spark):
    none = spark.createDataFrame([], "doc_id int, vector array<double>")
    one = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<double>")
    assert retrieval.dense_topk(none, one).count() == 0
    assert retrieval.dense_topk(one.withColumnRenamed("query_id", "doc_id"), one.limit(0)).count() == 0


def test_fusion(spark):
    one = spark.createDataFrame([(1, 10, 1), (1, 20, 2)], "query_id int, doc_id int, rank int")
    two = spark.createDataFrame([(1, 20, 1), (1, 30, 2)], "query_id int, doc_id int, rank int")
    got = retrieval.fused_topk([one, two], k=2).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [20, 10]
    assert got[0].score == pytest.approx(1 / 61 + 1 / 62)


def test_documents_are_counted_where_they_are_read(spark):
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 7} w{i % 5}") for i in range(50)], "doc_id int, text string")
    plan = retrieval.term_frequencies(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("limit", [None, 0])
def test_ids_that_repeat_are_added_up(spark, monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr(retrieval, "BROADCAST_LIMIT_BYTES", limit)
    texts = [(1, "a b a"), (1, "a c c"), (1, "a"), (None, "b b"), (None, "b a"), (None, None), (None, None), (2, ""),
             (3, "A b"), (4, "É1 x-x")]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    got = retrieval.term_frequencies(docs)
    found = {(r.doc_id, r.dl, r.term): r.tf for r in got.filter(~retrieval._is_mark()).collect()}
    assert found == {(1, 3, "a"): 3, (1, 3, "b"): 1, (1, 3, "c"): 2, (1, 1, "a"): 1, (None, 2, "b"): 3,
                     (None, 2, "a"): 1, (3, 2, "a"): 1, (3, 2, "b"): 1, (4, 3, "é1"): 1, (4, 3, "x"): 2}
    marks = got.filter(retrieval._is_mark())
    assert rows(marks, "doc_id", "dl", "tf") == sorted(
        [(1, 3, 2), (1, 1, 1), (None, 2, 2), (None, None, 2), (2, 0, 1), (3, 2, 1), (4, 3, 1)], key=repr)
    asked = spark.createDataFrame([("c",)], "term string")
    some = retrieval.term_frequencies(docs, asked).filter(~retrieval._is_mark())
    assert rows(some, "doc_id", "dl", "term", "tf") == [(1, 3, "c", 2)]


def test_asked_terms_go_to_the_postings(spark, stored):
    _, index = stored
    queries = spark.createDataFrame([(1, "w3 w40"), (2, "w59")], "query_id int, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = retrieval.bm25_search(index, queries, prune=False)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
