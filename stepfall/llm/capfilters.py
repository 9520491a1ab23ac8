"""Near-duplicate vectors by spherical-cap filters from structured random product codes.

A vector is split into ``PARTS`` parts, each with a code of random directions.  A filter is a choice of one
direction per part; its cap holds the vectors whose inner product with the sum of these directions is
high.  The filters that a vector exceeds are list-decoded without looking at all of them: the best
pairs of directions of either half, and among their pairs the best ``CAPS``.  (The height of the
caps is thus the vector's own: each lies in exactly ``CAPS`` of them.)  Vectors of one label that share
a filter meet and are compared exactly.  Of random pairs with a cosine of exactly 0.98, 0.02 % share
no filter (simulated), and fewer above.

Equal vectors of a label form one class first.  A pair that shares several filters counts under its
first one, so links are counted without listing them; what leaves a task is, per class, its links and
the classes it hangs together with, as few as connect them.  Filters with many classes are dealt to pairs of blocks.

Cases: null labels, and vectors that are null, zero or hold null or non-finite components, have no
links and are components of their own; vectors of different length are not compared; rows sharing a
vec_id are vectors of their own; a null vec_id never names a component unless all its members have
none, and is not kept; an empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfall.llm.components import components
from stepfall.llm.vectors import matrix, sound
from stepfall.plans.materialize import cut

PARTS = 4
DIRECTIONS = 32
CAPS = 32
BLOCK = 512
COSINE = 0.98

MET = "cls long, n_links long, other long"


def directions(dim: int) -> list[np.ndarray]:
    """A code of random unit directions for each part of a vector."""
    rng = np.random.default_rng(dim)
    out = []
    for part in np.array_split(np.arange(dim), PARTS):
        code = rng.normal(size=(DIRECTIONS, len(part)))
        out.append(code / np.maximum(np.linalg.norm(code, axis=1, keepdims=True), 1e-12))
    return out


def decode(vectors: np.ndarray, caps: int = CAPS) -> np.ndarray:
    """Numbers of the ``caps`` filters that each vector exceeds most.

    A pair of half-choices among the best ``caps`` has both halves among the best ``caps`` of theirs.
    """
    dim, at, scores = vectors.shape[1], 0, []
    for code in directions(dim):
        scores.append(vectors[:, at:at + code.shape[1]] @ code.T)
        at += code.shape[1]
    halves = []
    for a, b in (scores[:2], scores[2:]):
        both = (a[:, :, None] + b[:, None, :]).reshape(len(vectors), -1)
        best = np.argpartition(-both, caps, axis=1)[:, :caps]
        halves.append((best, np.take_along_axis(both, best, 1)))
    (i, x), (j, y) = halves
    total = (x[:, :, None] + y[:, None, :]).reshape(len(vectors), -1)
    number = (i[:, :, None] * DIRECTIONS**2 + j[:, None, :]).reshape(len(vectors), -1)
    best = np.argpartition(-total, caps - 1, axis=1)[:, :caps]
    return np.sort(np.take_along_axis(number, best, 1), axis=1)


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            dims = np.diff(part.column("vec").offsets.to_numpy())
            for dim in np.unique(dims):
                rows = part.filter(pa.array(dims == dim))
                vectors = matrix(rows.column("vec"))
                found = decode(vectors / np.linalg.norm(vectors, axis=1, keepdims=True))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("cls"), pa.array(list(found.astype(np.int32)), pa.list_(pa.int32()))],
                    names=["cls", "filters"])


def _block_links(rows: list[dict], cosine: float) -> pa.RecordBatch | None:
    """Links in one block of a filter: per class their number and a class it hangs together with."""
    number = rows[0]["filter"]
    cls = np.array([r["cls"] for r in rows])
    many = np.array([r["n"] for r in rows])
    side = np.array([r["side"] for r in rows])
    vectors = np.array([r["vec"] for r in rows])
    length = np.sqrt((vectors * vectors).sum(axis=1))
    near = (vectors @ vectors.T) / (length[:, None] * length[None, :]) >= cosine
    near &= ((side != 1)[:, None] & (side != 0)[None, :]) | ((side != 0)[:, None] & (side != 1)[None, :])
    np.fill_diagonal(near, False)
    if not near.any():
        return None
    busy = np.flatnonzero(near.any(axis=1))
    near = near[np.ix_(busy, busy)]
    # a pair counts under the first filter that both have
    names = {f: k for k, f in enumerate(sorted({
        f for i in busy for f in rows[i]["filters"] if f < number}))}
    if names:
        has = np.zeros((len(busy), len(names)), np.float32)
        for k, i in enumerate(busy):
            has[k, [names[f] for f in rows[i]["filters"] if f < number]] = 1
        near &= has @ has.T == 0
    links = near @ many[busy]
    keep = links > 0
    if not keep.any():
        return None
    # enough pairs to connect what is linked here
    up = {int(c): int(c) for c in cls[busy]}

    def top(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x
    pairs = []
    for k in np.flatnonzero(keep):
        for o in cls[busy][near[k]].tolist():
            a, b = top(int(cls[busy][k])), top(o)
            if a != b:
                up[max(a, b)] = min(a, b)
                pairs.append((max(a, b), min(a, b)))
    ids = [*cls[busy][keep].tolist(), *[a for a, _ in pairs]]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array([*links[keep].tolist(), *[0] * len(pairs)], pa.int64()),
         pa.array([*[None] * int(keep.sum()), *[b for _, b in pairs]], pa.int64())],
        names=["cls", "n_links", "other"])


def _meet(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if held and any(r[k] != held[0][k] for k in ("label", "dim", "filter", "x", "y")):
                    found = _block_links(held, cosine) if len(held) > 1 else None
                    if found is not None:
                        yield found
                    held = []
                held.append(r)
        found = _block_links(held, cosine) if len(held) > 1 else None
        if found is not None:
            yield found
    return run


def near_duplicates(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding",
                    label: str = "label", cosine: float = COSINE) -> DataFrame:
    """Per vector: ``vec_id, n_links, component_id, kept``."""
    fits = sound(F.col("vec")) & F.col("label").isNotNull()
    rows = cut(vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"),
        F.col(embedding).cast("array<double>").alias("vec")).withColumn(
        "cls", F.when(fits, F.xxhash64("label", "vec"))).withColumn("again", F.hash("vec", "label")))
    classes = cut(rows.filter("cls IS NOT NULL").groupBy("cls", "again").agg(
        F.min("vec_id").alias("first"), F.count("*").alias("n"),
        F.min(F.struct("label", "vec")).alias("s")).select(
        # a 96-bit name: the second hash tells apart what the first may confuse
        F.xxhash64("cls", "again").alias("id"), "cls", "again", "first", "n", "s.label", "s.vec")
        .withColumn("dim", F.size("vec")))
    met = classes.select(F.col("id").alias("cls"), "vec").mapInArrow(
        _filters, "cls long, filters array<int>")
    thin = cut(met.join(classes.select(F.col("id").alias("cls"), "label", "dim"), "cls"))
    each = thin.withColumn("filter", F.explode("filters")).drop("filters")
    sizes = each.groupBy("label", "dim", "filter").agg(F.count("*").alias("size")).filter("size > 1") \
        .select("label", "dim", "filter", F.ceil(F.col("size") / BLOCK).alias("blocks"))
    block = F.pmod(F.xxhash64("cls"), F.col("blocks"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(
        F.least("block", o).alias("x"), F.greatest("block", o).alias("y"),
        F.when(o == F.col("block"), 2).when(F.col("block") < o, 0).otherwise(1).alias("side")))
    dealt = each.join(sizes, ["label", "dim", "filter"]).withColumn("block", block).withColumn(
        "p", F.explode(pairs)).select("label", "dim", "filter", "cls", "p.*")
    full = dealt.join(thin.select("cls", "filters"), "cls").join(
        classes.select(F.col("id").alias("cls"), "n", "vec"), "cls")
    keys = ["label", "dim", "filter", "x", "y"]
    found = cut(full.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_meet(cosine), MET))
    links = found.groupBy("cls").agg(F.sum("n_links").alias("links"))
    roots = components(found.filter("other IS NOT NULL").select(
        F.col("cls").alias("a"), F.col("other").alias("b")))
    placed = classes.select(F.col("id"), F.col("cls"), F.col("again"), "first", "n").join(
        links.withColumnRenamed("cls", "id"), "id", "left").join(
        roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn(
        "root", F.coalesce("root", "id"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(least, "root").select(
        "cls", "again", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    out = rows.select("vec_id", "cls", "again").join(named, ["cls", "again"], "left")
    component = F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
