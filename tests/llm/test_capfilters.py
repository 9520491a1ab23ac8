"""Near-duplicate vectors against all pairs."""

import math

import numpy as np
import pytest
from llm_fixtures import sf_of  # noqa: F401
from pyspark.sql import functions as F

from stepfall.llm import capfilters

SCHEMA = "vec_id long, embedding array<float>, label int"


def clusters(seed, dim=64, families=15, size=8):
    rng = np.random.default_rng(seed)
    rows = []
    for f in range(families):
        base = rng.normal(size=dim)
        for _ in range(size):
            noise = rng.normal(size=dim) * rng.choice([0.02, 0.08, 0.12])
            vec = (base + noise).astype(np.float32) * rng.choice([1.0, 3.0])
            rows.append((len(rows), vec.tolist(), f % 3))
    rows += [(len(rows) + i, rng.normal(size=dim).astype(np.float32).tolist(), i % 3) for i in range(60)]
    return rows


ODD = [(900, None, 1), (901, [0.0] * 64, 1), (902, [1.0] * 63 + [None], 1), (903, [], 1),
       (904, [1.0] * 63 + [float("nan")], 1), (905, [1.0] * 63 + [float("inf")], 1),
       (906, [1.0] * 64, None), (907, [1.0] * 64, None), (908, [1.0, 2.0, 3.0, 4.0, 5.0], 1),
       (909, [1.0, 2.0, 3.0, 4.0, 5.0], 1), (None, [2.0] * 64, 2), (910, [2.0] * 64, 2)]


def fits(r):
    return r[1] is not None and r[2] is not None and all(
        x is not None and math.isfinite(x) for x in r[1]) and any(r[1])


def brute(rows):
    use = [i for i, r in enumerate(rows) if fits(r)]
    vec = {i: np.array(rows[i][1], float) for i in use}
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for k, i in enumerate(use):
        for j in use[:k]:
            if rows[i][2] == rows[j][2] and len(vec[i]) == len(vec[j]) and vec[i] @ vec[j] / (
                    np.linalg.norm(vec[i]) * np.linalg.norm(vec[j])) >= 0.98:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted(((r[0], links[i], least.get(find(i)), r[0] is not None and r[0] == least[find(i)])
                   for i, r in enumerate(rows)), key=repr)


@pytest.mark.parametrize("seed,block", [(1, 512), (2, 3)])
def test_against_all_pairs(spark, monkeypatch, seed, block):
    monkeypatch.setattr(capfilters, "BLOCK", block)
    rows = clusters(seed) + ODD
    rows += [rows[3], rows[3], (999, rows[5][1], rows[5][2])]
    table = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumn("cls", F.lit("x"))
    got = capfilters.near_duplicates(table).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_list_decoding_finds_the_best_of_all():
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(5, 16))
    a, b, c, d = capfilters.directions(16)
    for x, found in zip(vectors, capfilters.decode(vectors, 12)):
        parts = [x[4 * i:4 * i + 4] @ code.T for i, code in enumerate((a, b, c, d))]
        every = (parts[0][:, None, None, None] + parts[1][:, None, None]
                 + parts[2][:, None] + parts[3]).ravel()
        assert set(found) == set(np.argsort(-every)[:12])


def test_near_vectors_share_a_filter():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.98 * x + (1 - 0.98**2) ** 0.5 * y / np.linalg.norm(y, axis=1, keepdims=True)
    shared = [bool(set(a) & set(b)) for a, b in zip(
        capfilters.decode(x).tolist(), capfilters.decode(y).tolist())]
    assert np.mean(shared) > 0.998


def test_empty_table_and_query(spark, sf_of):  # noqa: F811
    from stepfall.llm import queries
    empty = spark.createDataFrame([], SCHEMA)
    assert capfilters.near_duplicates(empty).count() == 0
    rows = clusters(5)
    root = sf_of(embeddings=spark.createDataFrame(rows, SCHEMA))
    got = queries.QUERIES["op9_cap_filter_near_duplicates"](spark, root).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
