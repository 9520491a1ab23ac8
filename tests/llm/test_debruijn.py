"""Repeated windows of words against brute force."""

import hashlib
import random
import re

import pytest
from llm_fixtures import make_docs, sf_of  # noqa: F401
from pyspark.sql import functions as F

from stepfall.llm import debruijn, paths

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def brute(rows, k):
    """(doc_id, text) rows; equal rows are one source."""
    key = lambda r: (r[0] is not None, r[0] or 0, paths.xxhash.xxh3_64_intdigest(
        (r[1] or "").encode()) >> 33)
    seen, gone = {}, {}
    for row in sorted(set(rows), key=key):
        words = WORD.findall(row[1] or "")
        mask = [False] * len(words)
        for i in range(len(words) - k + 1):
            window = tuple(words[i:i + k])
            if window in seen:
                mask[i:i + k] = [True] * k
            seen.setdefault(window, (row, i))
        kept = [w for w, g in zip(words, mask) if not g]
        gone[row] = (row[0], len(words), sum(mask),
                     hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return sorted((gone[r] for r in rows), key=repr)


def texts(seed, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice("ab") + rng.choice(["", "é", "c"]) * rng.randint(0, 3)
    passages = [[word() for _ in range(rng.randint(3, 40))] for _ in range(5)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, 4)
            parts += p[a:len(p) - rng.randint(0, 4)] + [word() for _ in range(rng.randint(0, 5))]
        rows.append((i, rng.choice([" ", "\t", " \n"]).join(parts)))
    rows += [(i, "w " * rng.randint(0, 50)) for i in range(100, 110)] + rng.sample(rows, 8)
    return rows + [(200, None), (201, ""), (5, "other text " * 9), (None, rows[3][1]), (-4, rows[4][1])]


@pytest.mark.parametrize("seed,k,m", [(1, 5, 2), (2, 8, 3), (3, 12, 4), (4, 6, 6)])
def test_against_brute_force(spark, make_docs, seed, k, m):  # noqa: F811
    rows = texts(seed)
    docs = make_docs(rows).repartition(5).withColumn("core", F.lit("x"))
    got = debruijn.without_repeats(docs, words=k, anchor=m).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, k)


def test_small_chunks_and_pieces(spark, make_docs, monkeypatch):  # noqa: F811
    """Tasks that settle few runs at once, texts cut into stretches."""
    w = paths.Windows(5, 2, True, True)
    rows = [r for r in texts(9) if r[1]]
    whole = paths.np.frombuffer("".join(r[1] for r in rows).encode(), paths.np.uint8)
    at = paths.np.cumsum([0] + [len(r[1].encode()) for r in rows])
    full = paths.slice_runs(w, whole, at)
    monkeypatch.setattr(paths, "PIECE", 7)
    cut = paths.slice_runs(w, whole, at)
    windows = lambda x: sorted((i, a + j) for i, a, n in zip(*(v.tolist() for v in x[:3]))
                               for j in range(n))
    assert windows(full) == windows(cut)
    docs = make_docs(rows)
    got = debruijn.without_repeats(docs, words=5, anchor=2).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 5)


@pytest.mark.parametrize("keep_first", [True, False])
def test_comparison_does_not_depend_on_batches(keep_first):
    """The streaming comparison gives the same for any cut of its sorted input."""
    np, pa = paths.np, paths.pa
    rng = np.random.default_rng(5)
    w = paths.Windows(5, 2, True, keep_first)
    n = 400
    core, path = rng.integers(0, 30, n), rng.integers(0, 4, n)
    doc, place = rng.integers(0, 40, n), rng.integers(0, 3, n) << 31
    shape = 3 << 15 | (0 if keep_first else rng.integers(0, 8, n) == 0)
    order = np.lexsort((place, doc, path, core))
    cols = [x[order] for x in (core, path, doc, place, np.broadcast_to(shape, n).astype(np.int32))]

    def run(size):
        parts = [pa.RecordBatch.from_arrays([pa.array(c[i:i + size]) for c in cols],
                 names=["core", "path", "doc_id", "place", "shape"]) for i in range(0, n, size)]
        rows = [tuple(r.values()) for b in paths._compare(w)(iter(parts)) for r in b.to_pylist()]
        return sorted(set(rows)), sorted(r for r in rows if r[-1])
    assert run(n) == run(1) == run(3) == run(50)
    # and it agrees with plain counting
    rows = list(zip(*(c.tolist() for c in cols)))
    by_core, by_path = {}, {}
    for c, p, d, pl, s in rows:
        by_core.setdefault(c, set()).add(p)
        by_path.setdefault((c, p), []).append((d, pl, s))
    done, opened = set(), set()
    for (c, p), members in by_path.items():
        first = min(m[:2] for m in members)
        many = any(m[2] & 1 for m in members) or len({m[:2] for m in members}) > 1
        done |= {m[:2] for m in members if m[:2] != first or (not keep_first and many)}
        if len(by_core[c]) > 1:
            opened.add((*first, c, not keep_first and many))
    got = run(n)[0]
    assert {r[:2] for r in got if not r[-1]} >= done
    assert {r[:2] for r in got if not r[-1]} == done
    assert {(r[0], r[1], r[3], bool(r[4] & 1)) for r in got if r[-1]} == opened


def test_query_against_brute_force(spark, make_docs, sf_of):  # noqa: F811
    from stepfall.llm import queries
    rng = random.Random(7)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"r{rng.randint(0, 999)}" for _ in range(rng.randint(0, 80)))
             + (" " + passage[rng.randint(0, 30):] if i % 3 == 0 else "")) for i in range(80)]
    root = sf_of(documents=make_docs(rows))
    got = queries.QUERIES["op10_debruijn_repeats"](spark, root).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 20)


def test_empty_table(make_docs):  # noqa: F811
    assert debruijn.without_repeats(make_docs([])).count() == 0
