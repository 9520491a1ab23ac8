"""Repeated byte strings against brute force."""

import hashlib
import random

import numpy as np
import pytest
from llm_fixtures import make_docs, sf_of  # noqa: F401

from stepfall.llm import paths, suffixes


def brute(rows, k):
    count = {}
    for doc, text in set(rows):
        raw = (text or "").encode()
        for i in range(len(raw) - k + 1):
            count[raw[i:i + k]] = count.get(raw[i:i + k], 0) + 1
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - k + 1):
            if count[raw[i:i + k]] > 1:
                gone[i:i + k] = b"\1" * k
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def texts(seed, n=70):
    rng = random.Random(seed)
    noise = lambda m: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(0, m)))
    passages = [noise(90) + "x" for _ in range(5)]
    rows = []
    for i in range(n):
        parts = [noise(20)]
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, 8)
            p = p[a:len(p) - rng.randint(0, 8)]
            if rng.random() < 0.4 and p:                       # an edit inside
                at = rng.randrange(len(p))
                p = p[:at] + rng.choice("QRS") + p[at + 1:]
            parts += [p, noise(12)]
        rows.append((i, "".join(parts)))
    rows += [(100 + i, "ab" * rng.randint(0, 60)) for i in range(4)] + [(110, "z" * 70)]
    return rows + rng.sample(rows, 5) + [(200, None), (201, ""), (5, "q" * 50), (None, rows[2][1])]


@pytest.mark.parametrize("seed,k,m", [(1, 16, 4), (2, 24, 8), (3, 12, 3), (4, 30, 5), (5, 20, 20)])
def test_against_brute_force(spark, make_docs, seed, k, m):  # noqa: F811
    rows = texts(seed)
    got = suffixes.without_repeats(make_docs(rows).repartition(6), length=k, anchor=m).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, k)


def test_hot_phrase(spark, make_docs):  # noqa: F811
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh") for _ in range(60))
    word = lambda: "".join(rng.choice("ijklmnop") for _ in range(20))
    rows = [(i, word() + passage + word()) for i in range(120)] + [(i, word() * 3) for i in range(200, 240)]
    got = suffixes.without_repeats(make_docs(rows).repartition(4), length=24, anchor=6).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 24)


def test_texts_that_share_an_id_are_gathered_apart(spark, make_docs):  # noqa: F811
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("ijklmnop") for _ in range(20))
    passage = "".join(rng.choice("abcdefgh") for _ in range(60))
    rows = [(d, word() + passage + word()) for d in [None] * 30 + [4] * 30]
    rows += [(1, rows[0][1])] + [rows[0]] * 40
    docs = make_docs(rows).select("doc_id", "text").repartition(4)
    spans = suffixes.repeated_spans(docs, suffixes.Windows(24, 6, words=False, keep_first=False))
    found = paths.with_texts(docs, spans, "left").select("_found").collect()
    assert len(found) == len(rows) and {len(r[0]) for r in found} == {1}
    assert max(len(x.found) for r in found for x in r[0]) <= 100
    got = suffixes.without_repeats(docs, length=24, anchor=6).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 24)


def test_common_prefixes():
    assert suffixes.common_prefixes([b"abc", b"abd", b"abd", b"ab", b"", b"\0", b"\0\0"]).tolist() \
        == [2, 3, 2, 0, 0, 1]


def test_query_against_brute_force(spark, make_docs, sf_of):  # noqa: F811
    from stepfall.llm import queries
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh ") for _ in range(900))
    rows = [(i, "".join(rng.choice("ijkl ") for _ in range(rng.randint(0, 300)))
             + (long[rng.randint(0, 300):] if i % 4 == 0 else "") + "é") for i in range(60)]
    root = sf_of(documents=make_docs(rows))
    got = queries.QUERIES["op4_suffix_repeats"](spark, root).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 400)


def test_empty_table(make_docs):  # noqa: F811
    assert suffixes.without_repeats(make_docs([])).count() == 0


def test_marks_agree_in_both_engines(spark, make_docs):  # noqa: F811
    texts = ["", None, "a", "é" * 40, "line\nline", "x" * 100_000]
    docs = make_docs(list(enumerate(texts)))
    got = {r.doc_id: r.mark for r in docs.select("doc_id", paths.text_mark(docs.text).alias("mark")).collect()}
    raw = [(x or "").encode() for x in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.cumsum([0, *map(len, raw)])
    assert [got[i] for i in range(len(texts))] == paths.text_marks(data, offsets).tolist()


@pytest.mark.parametrize("bits", [1, 1 << 15])
def test_a_full_bitmap_changes_nothing(spark, make_docs, monkeypatch, bits):  # noqa: F811
    monkeypatch.setattr(paths, "FILTER_BITS", bits)
    rows = texts(6)
    got = suffixes.without_repeats(make_docs(rows).repartition(3), length=20, anchor=6).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 20)


def test_windows_that_do_not_fit_are_refused():
    with pytest.raises(ValueError):
        paths.Windows(20_000, 64, words=False, keep_first=False)
    with pytest.raises(ValueError):
        paths.Windows(20, 21, words=True, keep_first=True)
