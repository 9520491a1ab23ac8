"""Periodic runs against a search of every start and period."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_fixtures import make_docs, sf_of  # noqa: F401
from stepfall.llm import periodic, queries


def brute(words):
    """Every longest stretch of equal words q apart, its least period first."""
    n, least = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                least.setdefault((i, j - i + q), q)
            i = j
    return sorted((s, n, q) for (s, n), q in least.items())


def found(words):
    number = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int32)
    return [tuple(r) for r in periodic.runs_of(ids).tolist()]


def test_cover_reaches_every_difference():
    d = {(b - a) % periodic.MODULUS for a in periodic.COVER for b in periodic.COVER}
    assert d == set(range(periodic.MODULUS))


@given(st.lists(st.integers(0, 2), min_size=2, max_size=150), st.data())
@settings(max_examples=80, deadline=None)
def test_extensions(words, data):
    index = periodic.Extensions(np.array(words, np.int32))
    pairs = [(i, j) for j in range(1, len(words)) for i in range(0, j, 1 + j // 7)]
    i, j = np.array(pairs).T
    expect = []
    for a, b in pairs:
        t = 0
        while b + t < len(words) and words[a + t] == words[b + t]:
            t += 1
        expect.append(t)
    assert index.of(i, j).tolist() == expect


@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.integers(1, 40)),
                max_size=6))
@settings(max_examples=150, deadline=None)
def test_runs(parts):
    words = [w for block, times in parts for w in block * times]
    assert found(words) == brute(words)


def test_runs_of_long_texts():
    rng = random.Random(5)
    words = [str(rng.randrange(40)) for _ in range(900)]
    block = [str(rng.randrange(900)) for _ in range(700)]
    text = words + block * 4 + words[:50] + ["x"] * 300 + ["a", "b", "a"] * 90 + words
    assert found(text) == brute(text)
    assert (950 - 50, 2800, 700) in found(text)


def test_same_runs_without_the_kept_grid(monkeypatch):
    monkeypatch.setattr(periodic, "GRID_WORDS", 0)
    monkeypatch.setattr(periodic, "CHUNK_PAIRS", 50)
    text = list("abcab") * 30 + list("xyz") * 20 + ["q"] * 70
    assert found(text) == brute(text)


def answer(doc_id, text):
    """The query's row, by plain Python."""
    words = [w.decode() for w in (text or "").encode().split()]
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n > 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    gone = set()
    for s, size, q in runs:
        gone.update(range(s + q, s + size))
    best = min(runs, key=lambda r: (-np.longdouble(r[1]) / r[2], r[0], r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
            sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
           "collapsed_sha256")


@pytest.fixture(scope="module")
def odd(make_docs):
    texts = [None, "", " \n\t", "a", "a " * 24, "a " * 23, "a b " * 40 + "b a " * 40, "é ü\x0bé ü\x0c" * 20,
             "x\x85y x\x85y " * 30, ("one two three four " * 8 + "end ") * 5, "word " * 3000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a b c " * 30), (4, "a " * 24), (4, "a " * 24)]
    # ids whose tails the query repeats
    tails = [i for i in range(100, 400) if zlib.crc32(str(i).encode()) % 10 == 0]
    rng = random.Random(1)
    rows += [(i, " ".join(str(rng.randrange(30)) for _ in range(rng.randrange(1, 200)))) for i in tails]
    rows += [(i, None) for i in tails[:2]]
    return make_docs(rows)


def test_query_equals_brute_force(spark, sf_of, odd):
    got = queries.QUERIES["op11_periodic_runs"](spark, sf_of(documents=odd))
    assert tuple(got.columns) == COLUMNS
    expect = [answer(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expect, key=repr)


def test_query_on_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("n_chars < 9000")
    got = {r.doc_id: tuple(r) for r in queries.QUERIES["op11_periodic_runs"](spark, sf).collect()}
    rows = docs.collect()
    assert len(rows) > 150
    for r in rows:
        assert got[r.doc_id] == answer(r.doc_id, r.text)


def test_text_without_periods_keeps_other_columns(spark):
    rows = spark.createDataFrame([(1, "a b " * 20, "k", "r"), (2, "as  it is", "l", "s")],
                                 "runs int, text string, _row string, collapsed string")
    got = periodic.without_periods(rows).collect()
    assert [tuple(r) for r in got] == [(1, "a b", "k", "r"), (2, "as  it is", "l", "s")]


def test_empty_table(make_docs):
    assert periodic.periodic_runs(make_docs([])).collect() == []


def test_very_long_text():
    words = np.concatenate((np.arange(150_000), np.tile(np.arange(1000), 60), np.zeros(40_000, int)))
    assert periodic.runs_of(words.astype(np.int32)).tolist() == [[150_000, 60_001, 1000], [210_000, 40_000, 1]]
