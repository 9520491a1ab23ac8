"""Packing: ids against the tokenizer itself, every sequence gapless, few sequences."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import make_docs  # noqa: F401
from tokenizers import Tokenizer

from stepfall.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
WORDS = st.lists(st.one_of(
    st.sampled_from(["Hello,", "it's", "don't", "<|endoftext|>", "<|ENDOFTEXT|>", "İstanbul", "ΣΑΣ", "a b", "x1y2",
                     "́e", "é", "...", "été", "\x1c", "١٢", "A", ".", "a.b.", "naïve,"]),
    st.text(max_size=6)), max_size=12)


@pytest.fixture(scope="module")
def direct():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, texts):
    parts = [(t or "").encode() for t in texts]
    ids, at = tokenizer.ids(np.frombuffer(b"".join(parts), np.uint8),
                            np.cumsum([0, *map(len, parts)]))
    return [ids[a:b].tolist() for a, b in zip(at, at[1:])]


@settings(max_examples=150, deadline=None)
@given(WORDS, st.sampled_from([" ", "\n", "\t ", "\r\n"]))
def test_cached_words_give_the_tokenizers_ids(words, gap):
    text = gap.join(words)
    assert ids_of(packing.worker_tokenizer(PATH), [text]) == [
        Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids]


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 5)
    own = packing.WordTokenizer(PATH)
    texts = ["one two three", "four five six, seven", None, "", "one eight"]
    assert ids_of(own, texts) == ids_of(packing.WordTokenizer(PATH), texts)
    assert ids_of(own, [None, ""]) == [[], []]


def check(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in rows)
    return len(by), -(-total // capacity)


def test_documents(spark, make_docs, direct):  # noqa: F811
    rows = [(i, "word " * (i * 37 % 1500)) for i in range(300)] + [
        (900, None), (901, ""), (902, "long text " * 5000), (903, "long text " * 5000),
        (5, "word " * 185)]
    got = packing.packed_documents(make_docs(rows), PATH).collect()
    used, least = check(got, 4096)
    assert least <= used <= least * 1.01 + 1
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    for doc, text in rows:
        ids = direct.encode(text or "", add_special_tokens=False).ids + [1]
        parts = sorted((r for r in pieces[doc]), key=lambda r: r.piece)
        copies = 2 if doc == 5 else 1
        want = [(k // 4096, k, len(ids[k:k + 4096]),
                 zlib.crc32(np.asarray(ids[k:k + 4096], "<u4").tobytes()))
                for k in range(0, len(ids), 4096) for _ in range(copies)]
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in parts] == want


def test_sequences_hold_the_ids(spark, make_docs, direct):  # noqa: F811
    texts = {1: "a few words here", 2: None, 3: "other words " * 30}
    packed = packing.packed_documents(make_docs(list(texts.items())), PATH, keep_ids=True, capacity=32)
    placed = {(r.sequence_id, r.offset): r for r in packed.collect()}
    whole = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in packing.sequences(packed).collect()}
    for (s, o), r in placed.items():
        ids = direct.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [1]
        assert whole[s][o:o + r.length].tolist() == ids[r.start:r.start + r.length]


def test_empty_table(make_docs):  # noqa: F811
    assert packing.packed_documents(make_docs([]), PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=30))
def test_plans_hold_every_piece_once(histogram):
    groups = packing.plan_sequences(histogram, 64, width=4, rounds=60)
    held = defaultdict(int)
    for m, content in groups:
        assert m > 0 and sum(content) <= 64
        for n in content:
            held[n] += m
    assert held == {n: c for n, c in histogram.items()}
    # best fit, longest first, needs at most 11/9 of the best and 1
    total = sum(n * c for n, c in histogram.items())
    large = sum(c for n, c in histogram.items() if n > 32)
    plain = sum(m for m, _ in packing._best_fit([], dict(histogram), 64))
    assert max(-(-total // 64), large) <= sum(m for m, _ in groups) <= plain


def test_knapsack_against_all_choices():
    import itertools
    rng = np.random.default_rng(3)
    for _ in range(30):
        sizes, weights = rng.integers(1, 8, 4), rng.random(4)
        taken = packing.best_configuration(weights, sizes, 12)
        best = max(np.dot(c, weights) for c in itertools.product(range(13), repeat=4)
                   if np.dot(c, sizes) <= 12)
        assert np.dot(taken, sizes) <= 12 and np.dot(taken, weights) == pytest.approx(best)


def test_knapsack_with_bounds_against_all_choices():
    import itertools
    rng = np.random.default_rng(4)
    for _ in range(30):
        sizes, weights, most = rng.integers(1, 8, 4), rng.random(4), rng.integers(0, 4, 4)
        taken = packing.best_configuration(weights, sizes, 12, most)
        best = max(np.dot(c, weights) for c in itertools.product(*(range(m + 1) for m in most))
                   if np.dot(c, sizes) <= 12)
        assert np.dot(taken, sizes) <= 12 and np.dot(taken, weights) == pytest.approx(best)
        assert (taken <= most).all()


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_the_program_places_nine_in_ten_sequences(spark, sf):
    """On whole tables: as few sequences as their tokens allow, most of them configurations."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    histogram = {r["length"]: r["count"] for r in packing.token_pieces(docs, PATH).groupBy(
        "length").count().collect()}
    least = -(-sum(n * c for n, c in histogram.items()) // 4096)
    plan = packing.plan_sequences(histogram)
    assert packing._count(plan) == least
    left = dict(histogram)
    full = left.pop(4096, 0)
    program = packing.program_sequences(left)
    assert packing._count(program) >= 0.9 * (least - full)
    assert all(4096 - packing.CLASS <= sum(content) <= 4096 for _, content in program)
    held = defaultdict(int)
    for m, content in program:
        for n in content:
            held[n] += m
    assert all(held[n] + left[n] == c for n, c in histogram.items() if n < 4096)


def test_a_plan_for_millions_of_pieces_stays_small():
    rng = np.random.default_rng(6)
    drawn = np.clip(rng.lognormal(6.3, 0.9, 20_000), 1, 4095).astype(int)
    histogram = {int(n): int(c) * 1000 for n, c in zip(*np.unique(drawn, return_counts=True))}
    groups = packing.plan_sequences(histogram, rounds=100)
    assert packing._count(groups) <= packing._count(packing._best_fit([], dict(histogram), 4096))
    assert len(groups) < 20_000
    left = dict(histogram)
    assert packing._count(packing.program_sequences(left, rounds=100)) > 0
    assert sum(n * c for n, c in left.items()) < 0.15 * sum(n * c for n, c in histogram.items())


def test_plan_starts_no_other_kind_of_python_worker(spark, monkeypatch):
    """Rows from a list pass through RDD workers with an environment of their own, which stay beside the others."""
    pieces = spark.range(40).selectExpr("id AS doc_id", "0 AS piece", "1 + id % 7 AS length")

    def refused(*_args, **_kwargs):
        raise AssertionError("rows from a list")
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refused)
    rows = packing.pack(pieces, 16).collect()
    fill = {}
    for r in rows:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(rows) == 40
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 16
