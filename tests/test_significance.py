import math
import random

import pytest
from pyspark.sql import functions as F

from stepfall.operators import significance


def adjusted(ps):
    """Benjamini and Hochberg, one value after the other from the largest."""
    order = sorted(range(len(ps)), key=lambda i: ps[i])
    out, least = [None] * len(ps), 1.0
    for rank in range(len(ps), 0, -1):
        i = order[rank - 1]
        least = min(least, ps[i] * len(ps) / rank)
        out[i] = least
    return out


def test_normal_tail(spark):
    zs = [-40.0, -3.1, -0.5, 0.0, 1e-9, 0.7, 1.96, 5.0, 9.0, 30.0]
    got = spark.createDataFrame([(z,) for z in zs] + [(None,)], "z double").select(
        "z", significance.normal_tail(F.col("z")).alias("p")).collect()
    for r in got:
        if r.z is None:
            assert r.p is None
        else:
            assert r.p == pytest.approx(math.erfc(r.z / math.sqrt(2)) / 2, rel=1.3e-7)


@pytest.mark.parametrize("seed", range(3))
def test_step_up_equals_the_plain_procedure(spark, seed):
    rng = random.Random(seed)
    groups = {"a": [rng.random() for _ in range(300)] + [0.5] * 150 + [10 ** -rng.uniform(1, 30) for _ in range(40)],
              None: [0.0, 0.0, 1.0, 1e-300, 0.04], "b": [0.03], "c": [1.0] * 4}
    rows = [(g, i, p) for g, ps in groups.items() for i, p in enumerate(ps)]
    rows += [("a", -1, None), ("a", -2, float("nan")), ("d", -1, None)]
    made = spark.createDataFrame(rows, "instance_id string, i int, p double").repartition(5)
    got = {(r.instance_id, r.i): r for r in significance.step_up(made).collect()}
    assert len(got) == len(rows)
    for g, ps in groups.items():
        for i, q in enumerate(adjusted(ps)):
            assert got[g, i].q == pytest.approx(q, rel=1e-12)
            assert got[g, i].discovery == (q <= 0.05)
    for key in (("a", -1), ("a", -2), ("d", -1)):
        assert got[key].q is None and not got[key].discovery


def test_repeated_rows_and_an_empty_table(spark):
    made = spark.createDataFrame([("a", 0.01), ("a", 0.01), ("a", 0.9)], "instance_id string, p double")
    got = sorted((r.p, round(r.q, 12)) for r in significance.step_up(made).collect())
    assert got == [(0.01, 0.015), (0.01, 0.015), (0.9, 0.9)]
    none = significance.step_up(made.filter("false"))
    assert none.columns == ["instance_id", "p", "q", "discovery"] and none.count() == 0


def test_other_keys(spark):
    made = spark.createDataFrame([(1, "x", 0.02), (1, "y", 0.02), (1, "x", 0.5)], "k int, step string, p double")
    got = sorted((r.step, round(r.q, 12)) for r in significance.step_up(made, keys=["k", "step"]).collect())
    assert got == [("x", 0.04), ("x", 0.5), ("y", 0.02)]
    every = sorted(round(r.q, 12) for r in significance.step_up(made, keys=[]).collect())
    assert every == [0.03, 0.03, 0.5]


def test_chance_findings_are_held_back(spark):
    # 2,000 cohorts without an effect and 20 with one: single tests at 5 % would report about 100 by chance
    rng = random.Random(3)
    rows = [("a", f"n{i}", rng.gauss(0, 1)) for i in range(2000)] + [("a", f"y{i}", rng.gauss(6, 1)) for i in range(20)]
    z = spark.createDataFrame(rows, "instance_id string, name string, z double")
    found = significance.step_up(z.withColumn("p", significance.normal_tail(F.col("z")))).filter("discovery").collect()
    names = [r.name for r in found]
    assert sum(n[0] == "y" for n in names) >= 19 and sum(n[0] == "n" for n in names) <= 3
