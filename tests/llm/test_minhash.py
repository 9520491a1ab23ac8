"""Near-duplicates against all pairs of shingle sets."""

import math
import random
import re

import pytest
from llm_fixtures import make_docs, sf_of  # noqa: F401
from pyspark.sql import functions as F

from stepfall.llm import components, minhash

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def shingle_set(text, k):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, k):
    sets = [shingle_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, len(sets[i]), least.get(find(i)), doc is not None and doc == least[find(i)])
                   for i, (doc, _) in enumerate(rows)), key=repr)


def texts(seed, families=12, size=8, length=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    rows, n = [], 0
    for _ in range(families):
        base = [word() for _ in range(rng.randint(2, length))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = word()
            rows.append((n, " ".join(copy).upper() if rng.random() < 0.1 else "\n".join(copy)))
            n += 1
    return rows + [(900, None), (901, ""), (902, " \t"), (903, "one"), (904, "ONE"), (905, "É É"),
                   (906, "é é"), rows[3], (None, rows[5][1]), (None, "alone here")]


@pytest.mark.parametrize("seed,k", [(1, 2), (2, 5), (3, 3)])
def test_against_all_pairs(spark, make_docs, seed, k):  # noqa: F811
    rows = texts(seed)
    docs = make_docs(rows).repartition(3).withColumn("cls", F.lit("x"))
    got = minhash.near_duplicates(docs, minhash.Banding(words=k)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, k)


def test_blocks_and_chains(spark, make_docs, monkeypatch):  # noqa: F811
    """A chain of edits, each near the next one only, in blocks of four classes."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "KEY_BLOCK", 5)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        rows.append((60 - i, " ".join(words)))
        for _ in range(3):
            words[rng.randrange(200)] = f"n{rng.random()}"
    got = minhash.near_duplicates(make_docs(rows), minhash.Banding(words=2)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 2)


def test_shared_keys_in_any_batches():
    np, pa = minhash.np, minhash.pa
    rng = np.random.default_rng(2)
    key = np.sort(rng.integers(0, 60, 100))
    cls = np.arange(100)
    want = sorted((int(k), int(c), int(cls[key == k].min())) for k, c in zip(key, cls)
                  if (key == k).sum() > 1)
    for size in (1, 2, 7, 100):
        parts = [pa.RecordBatch.from_arrays([pa.array(key[i:i + size]), pa.array(cls[i:i + size])],
                                            names=["key", "cls"]) for i in range(0, 100, size)]
        got = sorted(tuple(r.values()) for b in minhash._shared(iter(parts)) for r in b.to_pylist())
        assert got == want


def test_pairs_at_the_threshold_reach_the_full_sets():
    # fewer than 0.02 % of pairs at a similarity of 0.8 have fewer equal minhashes
    n, least = minhash.Banding().hashes, minhash.Banding().least_equal
    assert sum(math.comb(n, k) * .8 ** k * .2 ** (n - k) for k in range(least)) < 2e-4


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [
        (i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = components.components(spark.createDataFrame(links, "a long, b long"))
    want = {x: find(x) for a, b in links if a != b for x in (a, b)}
    assert {r.node: r.root for r in got.collect()} == want


def test_one_of_each(spark, make_docs):  # noqa: F811
    docs = make_docs([(3, "a b c d e f g"), (1, "a b c d e f g"), (2, "x y"), (2, "x z"), (4, None)])
    kept = minhash.one_of_each(docs.withColumn("_id", F.lit("q")), minhash.Banding())
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4]
    assert kept.columns == [*docs.columns, "_id"]


def test_one_of_each_component_whatever_the_ids(spark, make_docs):  # noqa: F811
    same, near = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(59))
    docs = make_docs([
        (None, "one text without id"), (None, "another text without id"), (None, None), (None, " \t\n\v"),
        (2, "b a c d e f"), (2, "z y x w v u"), (2, "z y x w v u"),
        (7, near), (5, same), (7, "own words of seven"), (None, same), (9, ""), (9, None)])
    kept = minhash.one_of_each_component(docs.repartition(3), minhash.Banding())
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([
        (None, "one text without id"), (None, "another text without id"), (None, None), (None, " \t\n\v"),
        (2, "b a c d e f"), (2, "z y x w v u"), (5, same), (7, "own words of seven"), (9, ""), (9, None)],
        key=repr)


def test_query_against_all_pairs(spark, make_docs, sf_of):  # noqa: F811
    from stepfall.llm import queries
    rows = texts(5)
    root = sf_of(documents=make_docs(rows))
    got = queries.QUERIES["op1_minhash_near_duplicates"](spark, root).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 2)


def test_empty_table(make_docs):  # noqa: F811
    assert minhash.near_duplicates(make_docs([]), minhash.Banding()).count() == 0
