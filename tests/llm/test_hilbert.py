"""Nearest neighbours against brute force; the curve itself."""

import math

import numpy as np
import pytest
from llm_fixtures import sf_of  # noqa: F401
from pyspark.sql import functions as F

from stepfall.llm import hilbert

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=10):
    use = [r for r in rows if r[0] is not None and r[1] and all(
        x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    out = []
    for q in {(r[0], tuple(r[1])) for r in use if r[0] % 100 == 0}:
        others = {}
        for r in use:
            if r[0] != q[0] and len(r[1]) == len(q[1]):
                d = float(np.sqrt(((np.array(r[1], float) - np.array(q[1], float)) ** 2).sum()))
                others[r[0]] = min(d, others.get(r[0], d))
        best = sorted((d, i) for i, d in others.items())[:k]
        out += [(q[0], n, i, round(d, 9)) for n, (d, i) in enumerate(best, 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def answers(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in df.collect())


def random_rows(seed, n, dim=64):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return [(i, v.astype(np.float32).tolist(), 1)
            for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))]


@pytest.mark.parametrize("part,block", [(4096, 512), (37, 2)])
def test_small_tables_are_exact(spark, monkeypatch, part, block):
    monkeypatch.setattr(hilbert, "PART", part)
    monkeypatch.setattr(hilbert, "QUERY_BLOCK", block)
    rows = random_rows(1, 500)
    rows += [(1000 + i, rows[100][1], 1) for i in range(30)]               # ties
    rows += [(2000, None, 1), (2100, [0.0] * 64, 1), (2200, [1.0, None] + [0.0] * 62, 1),
             (2300, [float("nan")] * 64, 1), (2400, [1.0, 2.0, 3.0], 1), (2401, [1.0, 2.0, 4.0], 1),
             (2500, [], 1), (None, rows[3][1], 1), rows[200], rows[7]]
    got = hilbert.nearest(table(spark, rows).withColumn("keys", F.lit("x")), F.col("vec_id") % 100 == 0)
    assert answers(got) == brute(rows)


def test_recall_with_many_ranges(spark, monkeypatch):
    """The hardest case: independent directions in 64 dimensions, all 24 ranges."""
    monkeypatch.setattr(hilbert, "RANGE_LEAST", 200)
    rows = random_rows(2, 5000)
    got = answers(hilbert.nearest(table(spark, rows), F.col("vec_id") % 100 == 0))
    true = brute(rows)
    hit = len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in true})
    assert len(got) == len(true) and hit / len(true) > 0.93


def test_few_rows_and_empty(spark):
    rows = random_rows(3, 5)
    assert answers(hilbert.nearest(table(spark, rows), F.col("vec_id") % 100 == 0)) == brute(rows)
    assert hilbert.nearest(table(spark, rows).limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert hilbert.nearest(table(spark, rows[:1]), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_neighbouring_cells(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
    keys = hilbert.hilbert_keys(grid, bits)
    assert sorted(keys.tolist()) == list(range(1 << bits * dims))
    way = grid[np.argsort(keys)]
    assert (np.abs(np.diff(way, axis=0)).sum(axis=1) == 1).all()


def test_query(spark, sf_of):  # noqa: F811
    from stepfall.llm import queries
    rows = random_rows(4, 300, dim=7)
    got = queries.QUERIES["op7_hilbert_neighbours"](spark, sf_of(embeddings=table(spark, rows)))
    assert answers(got) == brute(rows)
