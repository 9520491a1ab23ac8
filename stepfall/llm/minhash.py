"""Near-duplicate documents by MinHash with tensored banding.

Two collections of ``half`` small keys are made, each of ``rows`` minhashes; a table key is a pair, one
small key from either collection.  So ``half * half`` table keys of ``2 * rows`` minhashes cost only
``2 * half * rows`` minhashes.  Documents with equal shingle sets form one class first.

Classes that share a table key are candidates.  In every key the least class is compared with the
others, on full shingle sets, and linked ones form components.  Keys whose classes then lie in several
components are looked at again: blocks of their classes are compared across components by their
minhashes, and components with pairs within ``SLACK`` standard errors of the threshold form
families.  In blocks of a family such pairs are confirmed on full sets until they connect what can be
connected.  So a link is lost only if no table key is shared (with 9 and 3: 0.6 % at a similarity of
exactly 0.8, 0.1 % at 0.85) or the minhashes are off by more; no key's classes are gathered in
one place or written out as pairs.

Words are separated by ASCII white space, letters A to Z count as small ones; fewer words than a shingle
are one shingle.  Cases: documents without words have no shingles and no links; repeated rows are
documents with equal sets; a null doc_id never names a component unless all its members have none,
and is not kept.  Other columns are ignored by ``near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepfall.llm import paths
from stepfall.llm.components import components
from stepfall.plans.materialize import cut

SLACK = 3.5
KEY_BLOCK = 2048             # classes of a key whose minhashes are compared with each other in one go
BLOCK = 512                  # classes of a family whose full sets are


@dataclass(frozen=True)
class Banding:
    """Shingles of ``words``; links at ``percent`` / 100 or more; sizes of the key collections."""

    words: int = 5
    percent: int = 80
    half: int = 9
    rows: int = 3

    @property
    def hashes(self) -> int:
        return 2 * self.half * self.rows

    @property
    def least_equal(self) -> int:
        """Equal minhashes below which a pair is taken to be dissimilar."""
        p = self.percent / 100
        return int(self.hashes * p - SLACK * (self.hashes * p * (1 - p)) ** 0.5)


SKETCH = "doc_id long, n long, cls long, sketch binary"


def lowered(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def shingles(b: Banding, data: np.ndarray, offsets: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the texts of a slice, one after the other, and how many each has."""
    words, counts = paths.word_values(lowered(data), offsets[:-1], offsets[1:])
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(len(counts), np.int64)
    prefix = paths.Prefix(words)
    begin = np.cumsum(counts) - counts
    number = np.where(counts >= b.words, counts - b.words + 1, np.minimum(counts, 1))
    of = np.repeat(np.arange(len(counts)), number)
    start = begin[of] + np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number)
    size = np.minimum(counts, b.words)[of]
    value = paths.mix(prefix.of(start, start + size) + size.astype(np.uint64))
    order = np.lexsort((value, of))
    of, value = of[order], value[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (value[1:] != value[:-1])
    return value[new], np.bincount(of[new], minlength=len(counts))


def set_names(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One 64-bit name per set: equal for equal sets."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(paths.mix(values + np.uint64(7)))))
    ends = np.cumsum(counts)
    return paths.mix(sums[ends] - sums[ends - counts] + counts.astype(np.uint64)).view(np.int64)


def minhashes(b: Banding, values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One row of minhashes per set that is not empty."""
    rng = np.random.default_rng(11)
    turn = rng.integers(1, 1 << 32, (b.hashes, 2), dtype=np.uint64) | np.uint64(1)
    low = (values & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    high = (values >> np.uint64(32)).astype(np.uint32)
    full = counts > 0
    starts = (np.cumsum(counts) - counts)[full]
    out = np.empty((int(full.sum()), b.hashes), np.uint32)
    for i, (x, y) in enumerate(turn):
        h = low * np.uint32(x) + high * np.uint32(y)
        out[:, i] = np.minimum.reduceat(h ^ (h >> np.uint32(15)), starts) if len(starts) else 0
    return out


def _sketches(b: Banding):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column("doc_id")
            for x, y, data, offsets in paths.text_slices(batch):
                values, counts = shingles(b, data, offsets)
                full = counts > 0
                table = minhashes(b, values, counts)
                rows = iter([r.tobytes() for r in table])
                yield pa.RecordBatch.from_arrays(
                    [docs.slice(x, y - x), pa.array(counts, pa.int64()),
                     pa.array(set_names(values, counts), pa.int64(), mask=~full),
                     pa.array([next(rows) if f else None for f in full], pa.binary())],
                    names=["doc_id", "n", "cls", "sketch"])
    return run


def table_keys(b: Banding, sketches: np.ndarray) -> np.ndarray:
    """All pairs of small keys, one from either collection, as 64-bit table keys."""
    parts = sketches.reshape(len(sketches), 2, b.half, b.rows).astype(np.uint64)
    small = np.zeros(parts.shape[:3], np.uint64)
    for i in range(b.rows):
        small = paths.mix(small * np.uint64(31) + parts[..., i] + np.uint64(1))
    number = np.arange(b.half * b.half, dtype=np.uint64).reshape(b.half, b.half)
    keys = paths.mix(small[:, 0, :, None] * np.uint64(7) + small[:, 1, None, :] + number)
    return keys.reshape(len(sketches), -1).view(np.int64)


def _keys(b: Banding):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                sketches = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint32)
                keys = table_keys(b, sketches.reshape(part.num_rows, b.hashes))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()),
                     pa.array(np.repeat(part.column("cls").to_numpy(), keys.shape[1]))],
                    names=["key", "cls"])
    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, cls): the rows of keys with several classes, with the key's least class."""
    key_held, least, told, one = None, None, False, None
    for batch in batches:
        key, cls = batch.column("key").to_numpy(), batch.column("cls").to_numpy()
        if not len(key):
            continue
        n = len(key)
        new = np.ones(n, bool)
        new[1:] = key[1:] != key[:-1]
        goes_on = key_held is not None and key[0] == key_held
        new[0] = not goes_on
        head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        first = cls[head]
        more = np.zeros(n, bool)
        more[1:] = ~new[1:]
        more[:-1] |= ~new[1:]
        if goes_on:
            lead = int(np.argmax(new)) if new.any() else n
            own = np.arange(n) < lead
            first = np.where(own, least, first)
            more |= own
            if not told:
                yield _members(np.array([key_held]), np.array([one]), np.array([least]))
        if more.any():
            yield _members(key[more], cls[more], first[more])
        key_held, least, one, told = key[-1], first[-1], cls[-1], bool(more[-1])


def _members(key, cls, least) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(cls, pa.int64()),
                                       pa.array(least, pa.int64())], names=["key", "cls", "least"])


def _full_sets(b: Banding):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in paths.text_slices(batch):
                values, counts = shingles(b, data, offsets)
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(set_names(values, counts), pa.int64()),
                     pa.array([values[e - n:e].tobytes() for e, n in zip(ends, counts)], pa.binary())],
                    names=["cls", "shingles"])
    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("left"), batch.column("right")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])
    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("right"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(_confirm(percent), "a long, b long")


def _groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[dict]]:
    """Rows of a sorted stream by group; callers deal groups of bounded size."""
    held: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if held and any(r[n] != held[0][n] for n in names):
                yield held
                held = []
            held.append(r)
    if held:
        yield held


class Block:
    """Classes that are compared with each other: all, or those of two sides."""

    def __init__(self, b: Banding, rows: list[dict]) -> None:
        self.cls = np.array([r["cls"] for r in rows])
        self.root = np.array([r["root"] for r in rows])
        side = np.array([r["side"] for r in rows])
        self.table = np.frombuffer(b"".join(r["sketch"] for r in rows), np.uint32).reshape(
            len(rows), b.hashes)
        self.left, self.right, self.least = (
            np.flatnonzero(side != 1), np.flatnonzero(side != 0), b.least_equal)
        self.up: dict[int, int] = {}

    def top(self, root: int) -> int:
        while self.up.get(root, root) != root:
            root = self.up[root]
        return root

    def join(self, a: int, b: int) -> None:
        a, b = sorted((self.top(a), self.top(b)))
        self.up[b] = a

    def near(self, i: int) -> np.ndarray:
        """Members on the other side, of other components, whose minhashes agree often enough."""
        other = self.right[self.root[self.right] != self.root[i]]
        return other[(self.table[other] == self.table[i]).sum(axis=1) >= self.least]


def _active(b: Banding):
    """Blocks of a key: classes near one of another component, and a component they hang together with."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ("key", "x", "y")):
            block, active = Block(b, rows), set()
            keys, key = table_keys(b, block.table), rows[0]["key"]
            for i in block.left.tolist():
                near = block.near(i)
                if len(near):                    # the first key that a pair shares speaks for it
                    near = near[keys[i][(keys[near] == keys[i]).argmax(axis=1)] == key]
                if len(near):
                    active.update([i, *near.tolist()])
                    for r in set(block.root[near].tolist()):
                        block.join(int(block.root[i]), r)
            if active:
                at = sorted(active)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.cls[at]), pa.array(block.root[at]),
                     pa.array([block.top(r) for r in block.root[at].tolist()], pa.int64())],
                    names=["cls", "root", "hub"])
    return run


def _links_across(b: Banding):
    """Blocks of a family: links between components, confirmed on full sets, as many as connect them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ("family", "x", "y")):
            block = Block(b, rows)
            sets: dict[int, set] = {}

            def full(i: int) -> set:
                if i not in sets:
                    sets[i] = set(np.frombuffer(rows[i]["shingles"], np.uint64).tolist())
                return sets[i]

            links = []
            for i in block.left.tolist():
                for j in block.near(i).tolist():
                    if block.top(int(block.root[i])) == block.top(int(block.root[j])):
                        continue
                    common = len(full(i) & full(j))
                    if 100 * common >= b.percent * (len(full(i)) + len(full(j)) - common):
                        block.join(int(block.root[i]), int(block.root[j]))
                        links.append((int(block.cls[i]), int(block.cls[j])))
            if links:
                x, y = zip(*links)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])
    return run


def _dealt(rows: DataFrame, group: str, most: int) -> DataFrame:
    """Rows (group, cls, root) dealt to pairs of blocks of their group: ``x, y, side``."""
    sizes = rows.groupBy(group).agg(F.ceil(F.count("*") / most).alias("blocks"))
    block = F.pmod(F.xxhash64("cls"), F.col("blocks"))
    # block pairs (x, y) with x <= y; a class is on the first side where its block is x
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(
        F.least("block", o).alias("x"), F.greatest("block", o).alias("y"),
        F.when(o == F.col("block"), 2).when(F.col("block") < o, 0).otherwise(1).alias("side")))
    return rows.join(sizes, group).withColumn("block", block).withColumn(
        "p", F.explode(pairs)).select(group, "cls", "root", "p.*")


def _late_links(members: DataFrame, roots: DataFrame, classes: DataFrame, sets: DataFrame,
                b: Banding) -> DataFrame:
    """Links between components that share a key."""
    placed = members.select("key", "cls").join(
        roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn(
        "root", F.coalesce("root", "cls"))
    several = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")) \
        .filter("low <> high").select("key")
    sketches = classes.select("cls", "sketch")
    active = cut(_dealt(placed.join(several, "key"), "key", KEY_BLOCK).join(sketches, "cls")
                 .repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
                 .mapInArrow(_active(b), "cls long, root long, hub long").distinct())
    families = components(active.select(F.col("root").alias("a"), F.col("hub").alias("b"))).select(
        F.col("node").alias("root"), F.col("root").alias("family"))
    grouped = active.select("cls", "root").distinct().join(families, "root")
    return _dealt(grouped, "family", BLOCK).join(sketches, "cls").join(sets, "cls").repartition(
        "family", "x", "y").sortWithinPartitions("family", "x", "y").mapInArrow(
        _links_across(b), "a long, b long")


def _placed(texts: DataFrame, b: Banding) -> tuple[DataFrame, DataFrame]:
    """Sketches of all rows, and per class ``cls, first_doc, root`` (the name of its component)."""
    rows = cut(texts.mapInArrow(_sketches(b), SKETCH))
    classes = cut(rows.filter("n > 0").groupBy("cls").agg(
        F.min("doc_id").alias("first_doc"), F.min(F.struct("sketch")).alias("s")).select(
        "cls", "first_doc", "s.sketch"))
    members = cut(classes.select("cls", "sketch").mapInArrow(_keys(b), "key long, cls long")
                  .repartition("key").sortWithinPartitions("key", "cls")
                  .mapInArrow(_shared, "key long, cls long, least long"))
    near = members.select("cls").distinct()
    wanted = rows.join(near, "cls").select("doc_id").distinct()
    sets = cut(texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["doc_id"])).select(texts["text"])
               .mapInArrow(_full_sets(b), "cls long, shingles binary")
               .groupBy("cls").agg(F.min(F.struct("shingles")).alias("s")).select("cls", "s.shingles"))
    star = (members.filter("cls <> least").select(
        F.col("least").alias("a"), F.col("cls").alias("b")).distinct())
    links = cut(confirmed(star, sets, b.percent))
    roots = components(links)
    late = cut(_late_links(members, roots, classes, sets, b))
    if not late.isEmpty():
        roots = components(links.unionByName(late))
    return rows, classes.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").select(
        "cls", "first_doc", F.coalesce("root", "cls").alias("root"))


def near_duplicates(docs: DataFrame, b: Banding, *, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """Per document: ``doc_id, n_shingles, component_id, kept``."""
    rows, placed = _placed(docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), b)
    least = placed.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = placed.join(least, "root").select("cls", "component_id")
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "cls").join(named, "cls", "left")
    return out.withColumn("component_id", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(
        F.col("component_id"))).select("doc_id", "n_shingles", "component_id", F.coalesce(
            F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, b: Banding, *, doc_id: str = "doc_id",
                text: str = "text") -> DataFrame:
    """The documents, all columns, of which one stays per component; of equal ids the first text."""
    found = near_duplicates(docs, b, doc_id=doc_id, text=text).filter("kept").select(
        F.col("doc_id").alias("_id")).distinct()
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"), whole)
    order = Window.partitionBy("_id").orderBy(F.col("_text").asc_nulls_last())
    return rows.join(found, "_id").withColumn("_n", F.row_number().over(order)).filter(
        "_n = 1").select("_row.*")


def _classed(b: Banding):
    """Rows with the class of their text, the text itself left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, data, offsets in paths.text_slices(batch):
                values, counts = shingles(b, data, offsets)
                names = [n for n in batch.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(n).slice(x, y - x) for n in names]
                    + [pa.array(set_names(values, counts), pa.int64(), mask=counts == 0)],
                    names=[*names, "cls"])
    return run


def one_of_each_component(docs: DataFrame, b: Banding, *, doc_id: str = "doc_id",
                          text: str = "text") -> DataFrame:
    """The documents, all columns: one row of every component, whatever the ids are.

    The row with the least id stays, one without an id only if no other row of the component has one.
    Rows without words belong to no component and all stay.  Ids need not be unique: rows are told
    apart by their class.
    """
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    _, placed = _placed(texts, b)
    stays = placed.groupBy("root").agg(F.min(F.struct(
        F.col("first_doc").isNull().alias("none"), "first_doc", "cls")).alias("s")).select("s.cls")
    worded = F.coalesce(F.col(text).rlike(r"[^ \t-\r]"), F.lit(False))
    rows = docs.filter(worded).select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).cast("long").alias("id"),
                 F.xxhash64(text).alias("h")).alias("_order"), F.col(text).alias("text"))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("_row", "_order"))
    # copies meet in their task first; one row per class is sent
    one = rows.mapInArrow(_classed(b), f"{kinds}, cls long").groupBy("cls").agg(
        F.min_by("_row", "_order").alias("_row"))
    return one.join(stays, "cls").select("_row.*").unionByName(docs.filter(~worded))
