"""Runs of windows that share an anchor: the compact form in which repeated windows are compared.

A window is ``K`` symbols in a row (words, or bytes) of one text.  A window's anchor is the gram
of ``M`` symbols in it with the least hash, so equal windows have equal anchors at equal places, and
neighbouring windows mostly share theirs.  A maximal run of windows with one anchor travels as one row: hash of
the anchor gram (``core``), hash of all symbols of the run (``path``), where it starts and how many
windows it has.  Two equal windows lie in runs with equal cores; two runs with equal paths are equal
window by window.  So rows meet by core, equal paths are settled as a whole, and only where a core
leads into several different paths do single windows have to be compared.

Tasks first settle the runs they hold themselves and send one row per path, so a text that makes up
a third of all rows is one row per task and path.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfall.plans.materialize import cut

BASE = 0x9E3779B97F4A7C15 | 1
PLACE_BITS = 24
PIECE = 1 << 22              # symbols of one text looked at together
SLICE_BYTES = 1 << 18        # texts are looked at together up to so many bytes (the arrays over them take many times that)
CHUNK_RUNS = 400_000         # runs a task settles by itself before it sends them
NULL_DOC = -(1 << 63)
MARK_SEED = 42               # the seed of Spark's xxhash64
FILTER_BITS = 1 << 26        # bits that tell which texts have findings: a broadcast of 8 MB at most

RUNS = "core long, path long, doc_id long, place long, shape int"
FOUND = "doc_id long, place long, n int, core long, shape int, open boolean"
_RUN_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())


@dataclass(frozen=True)
class Windows:
    """What is compared: windows of ``k`` symbols with anchors of ``m``.

    ``keep_first``: the earliest of equal windows stays; else all of them are repeated.
    """

    k: int
    m: int
    words: bool
    keep_first: bool

    def __post_init__(self) -> None:
        # a run's number of windows and its anchor's offset share 31 bits, 14 of them for the offset
        if not 0 < self.m <= self.k or self.k - self.m >= 1 << 14:
            raise ValueError("an anchor needs 1 to length symbols, and a window at most 16,383 more")


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        inverse = pow(BASE, -1, 1 << 64)
        for b in (BASE, inverse):
            steps = np.full(size + 1, b, np.uint64)
            steps[0] = 1
            _powers.append(np.cumprod(steps))
        del _powers[:-2]
    return _powers[0], _powers[1]


class Prefix:
    """Rolling polynomial hash of any stretch of a symbol array."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.up, self.down = powers(len(symbols))
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * self.up[:len(symbols)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def grams(self, m: int) -> np.ndarray:
        return (self.sums[m:] - self.sums[:-m]) * self.down[:len(self.sums) - m]


def word_values(data: np.ndarray, starts: np.ndarray, ends: np.ndarray
                ) -> tuple[np.ndarray, np.ndarray]:
    """One value per word of the texts data[start:end], and the number of words of each text."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    inside = ~space
    begin = inside.copy()
    begin[1:] &= space[:-1]
    stop = inside.copy()
    stop[:-1] &= space[1:]
    full = starts < ends
    heads, tails = starts[full], ends[full] - 1
    begin[heads] = inside[heads]
    stop[tails] = inside[tails]
    b, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    counts = np.searchsorted(b, ends) - np.searchsorted(b, starts)
    return stretch_hashes(data, b, e), counts


def stretch_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes data[begin:end], for many stretches."""
    return mix(Prefix(_byte_values()[data]).of(begin, end) + (end - begin).astype(np.uint64))


def text_slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows from, rows to, their bytes and where each text starts (and the last ends)."""
    text = batch.column("text")
    if pa.types.is_large_string(text.type):
        text = text.cast(pa.string())
    n = len(text)
    if n == 0:
        return
    buffers = text.buffers()
    offsets = np.frombuffer(buffers[1], np.int32, n + 1, text.offset * 4).astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        b = min(b, n)
        yield a, b, data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        a = b


def text_marks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """31 bits of each text's hash: tells rows apart that share a doc_id.  Equal to ``text_mark``."""
    whole = data.tobytes()
    return np.array([xxhash.xxh64_intdigest(whole[a:b], MARK_SEED) >> 33
                     for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.int64)


def symbols_of(w: Windows, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts of a slice, and how many each has."""
    if w.words:
        return word_values(data, offsets[:-1], offsets[1:])
    return _byte_values()[data], np.diff(offsets)


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` values in a row."""
    size = 1
    while size * 2 <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[:len(v) - (width - size)], v[width - size:]) if size < width else v


def runs_of(w: Windows, symbols: np.ndarray, counts: np.ndarray, first: np.ndarray
            ) -> tuple[np.ndarray, ...]:
    """Runs in the given symbol stretches: (stretch, lo, n, d, core, path), all arrays.

    ``first``: the place in its text of each stretch's first symbol, added to ``lo``.
    """
    n = len(symbols)
    if n < w.k:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(
            np.zeros(0, np.uint64) for _ in range(2))
    prefix = Prefix(symbols)
    order = mix(prefix.grams(w.m))
    order &= np.uint64(~((1 << PLACE_BITS) - 1) & (2**64 - 1))
    order |= np.arange(len(order), dtype=np.uint64)
    anchor = (sliding_min(order, w.k - w.m + 1) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    ends = np.cumsum(counts)
    stretch = np.repeat(np.arange(len(counts)), counts)
    inside = stretch[:n - w.k + 1] == stretch[w.k - 1:]
    new = inside.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    last = inside.copy()
    last[:-1] &= (anchor[1:] != anchor[:-1]) | ~inside[1:]
    # a window that lies in the next text has its anchor there, so runs never join texts
    lo, hi = np.flatnonzero(new), np.flatnonzero(last)
    at, of = anchor[lo], stretch[lo]
    count, d = hi - lo + 1, at - lo
    core = mix(prefix.of(at, at + w.m) + np.uint64(w.m))
    path = mix(mix(prefix.of(lo, hi + w.k)) + (count << 20 | d).astype(np.uint64))
    return of, lo - (ends - counts)[of] + first[of], count, d, core, path


def _pieces(counts: np.ndarray, k: int) -> Iterator[tuple[int, int, int, int]]:
    """Stretches of bounded length: (text from, text to, first symbol, end), windows once each."""
    for i, n in enumerate(counts.tolist()):
        at = 0
        while True:
            yield i, at, min(n, at + PIECE + k - 1)
            at += PIECE
            if at >= n - k + 1:
                break


def slice_runs(w: Windows, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    symbols, counts = symbols_of(w, data, offsets)
    if not len(counts) or counts.max() < PIECE:
        return runs_of(w, symbols, counts, np.zeros(len(counts), np.int64))
    starts, out = np.cumsum(counts) - counts, []
    for i, a, b in _pieces(counts, w.k):
        found = runs_of(w, symbols[starts[i] + a:starts[i] + b], np.array([b - a]), np.array([a]))
        out.append((np.full(len(found[0]), i), *found[1:]))
    return tuple(np.concatenate(x) for x in zip(*out))


def settle(w: Windows, runs: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """One row per path for the shuffle, and stretches of windows that are already settled.

    Each item: core, path, doc_id, place, windows, d, whether the path is known to be repeated.
    """
    core, path, doc, place, count, d, known = (np.concatenate(x) for x in zip(*runs))
    order = np.lexsort((place, doc, mix(core ^ (path * np.uint64(BASE)))))
    core, path, doc, place, count, d, known = (
        x[order] for x in (core, path, doc, place, count, d, known))
    same = np.zeros(len(core), bool)
    same[1:] = (core[1:] == core[:-1]) & (path[1:] == path[:-1])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(core))))
    # equal rows of the table are one text, not repetitions of each other
    other = same & ((doc != doc[head]) | (place != place[head]))
    many = np.zeros(len(core), bool)
    if not w.keep_first:
        many[head[other | known]] = True
    done = other if w.keep_first else many[head]
    keep = ~same
    shape = (count << 15 | d << 1 | many).astype(np.int32)
    columns = [core[keep].view(np.int64), path[keep].view(np.int64), doc[keep], place[keep], shape[keep]]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _RUN_TYPES)],
                                     names=["core", "path", "doc_id", "place", "shape"])
    if done.any():
        yield _span_rows(doc[done], place[done], count[done])


def _span_rows(doc: np.ndarray, place: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    """Settled stretches, neighbours joined; they pass the shuffle under a key of their document."""
    mark, lo = place & 0x7FFFFFFF, place >> 31
    order = np.lexsort((lo, mark, doc))
    doc, mark, lo, end = doc[order], mark[order], lo[order], (lo + count)[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1]) | (lo[1:] > end[:-1])
    head, tail = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(doc)) - 1
    lo, n = lo[head], end[tail] - lo[head]
    key = mix((doc[head] * 31 + mark[head]).astype(np.uint64)).view(np.int64)
    columns = [key, n, doc[head], lo << 31 | mark[head], np.full(len(head), -1)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _RUN_TYPES)],
                                      names=["core", "path", "doc_id", "place", "shape"])


def doc_numbers(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([NULL_DOC if x is None else x for x in batch.column("doc_id").to_pylist()],
                    np.int64)


def _runs(w: Windows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            docs = doc_numbers(batch)
            for a, b, data, offsets in text_slices(batch):
                of, lo, count, d, core, path = slice_runs(w, data, offsets)
                if not len(of):
                    continue
                marks = text_marks(data, offsets)
                held.append((core, path, docs[a:b][of], lo << 31 | marks[of], count, d,
                             np.zeros(len(of), bool)))
                size += len(of)
                if size >= CHUNK_RUNS:
                    yield from settle(w, held)
                    held, size = [], 0
        if held:
            yield from settle(w, held)
    return run


def _edges(w: Windows):
    """Single windows of the stretches named for each text, settled like runs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            found = batch.column("_found")
            docs = doc_numbers(batch)
            for a, b, data, offsets in text_slices(batch):
                symbols, counts = symbols_of(w, data, offsets)
                marks, begin = text_marks(data, offsets), np.cumsum(counts) - counts
                prefix = Prefix(symbols)
                for i in range(a, b):
                    for r in of_text(found[i], marks[i - a]):
                        n = r["n"]
                        lo = r["lo"] + np.arange(n)
                        at = begin[i - a] + lo
                        held.append((np.full(n, r["core"]).view(np.uint64),
                                     mix(prefix.of(at, at + w.k)), np.full(n, docs[i]),
                                     lo << 31 | marks[i - a], np.ones(n, np.int64),
                                     np.zeros(n, np.int64), np.full(n, bool(r["shape"] & 1))))
                        size += n
                if size >= CHUNK_RUNS:
                    yield from settle(w, held)
                    held, size = [], 0
        if held:
            yield from settle(w, held)
    return run


def compared_edges(docs: DataFrame, w: Windows, stretches: DataFrame) -> DataFrame:
    """Settled windows of the open stretches (``core, doc_id, place, n, shape``) of the texts."""
    named = per_document(stretches, "n", "core", "shape")
    return with_texts(docs, named, "inner").mapInArrow(_edges(w), RUNS).repartition(
        "core", "path").sortWithinPartitions("core", "path", "doc_id", "place").mapInArrow(
        settled(w), FOUND)


def _compare(w: Windows):
    """Sorted rows (core, path, doc_id, place): settle equal paths; report branching cores as open."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last path so far: its core, path, first doc and place, shape, whether it was reported
        pending: dict | None = None
        for batch in batches:
            rows = {c: batch.column(c).to_numpy() for c in batch.schema.names}
            spans = rows["shape"] == -1
            if spans.any():
                yield _found(rows["doc_id"][spans], rows["place"][spans], rows["path"][spans])
                rows = {c: v[~spans] for c, v in rows.items()}
            if not len(rows["core"]):
                continue
            if pending is not None:
                rows = {c: np.concatenate(([pending[c]], v)).astype(v.dtype) for c, v in rows.items()}
            n = len(rows["core"])
            core, path, doc, place, shape = (rows[c] for c in (
                "core", "path", "doc_id", "place", "shape"))
            same_core = np.zeros(n, bool)
            same_core[1:] = core[1:] == core[:-1]
            same = np.zeros(n, bool)
            same[1:] = same_core[1:] & (path[1:] == path[:-1])
            heads = np.flatnonzero(~same)
            head = heads[np.cumsum(~same) - 1]
            other = same & ((doc != doc[head]) | (place != place[head]))
            many = np.zeros(n, bool)
            many[head[other]] = True
            if not w.keep_first:
                many |= (shape & 1).astype(bool) & ~same
                np.logical_or.at(many, head, (shape & 1).astype(bool))
                done = other | many | (same & ((shape & 1) > 0))
                seen_done = pending is not None and pending["done"]
                if seen_done and done[0]:
                    done[0] = False                  # reported with an earlier batch
                closed_first = bool(done[heads[-1]]) or (seen_done and heads[-1] == 0)
            else:
                done, closed_first = other, False
            if done.any():
                yield _found(doc[done], place[done], shape[done].astype(np.int64) >> 15)
            # a path is open if the core also leads into another path
            branch = np.zeros(len(heads), bool)
            if len(heads) > 1:
                alike = core[heads[1:]] == core[heads[:-1]]
                branch[1:] |= alike
                branch[:-1] |= alike
            told = pending is not None and pending["told"]
            if pending is not None:
                branch[0] |= pending["branch"]
            report = branch.copy()
            if told:
                report[0] = False
            i = heads[report]
            if len(i):
                flag = shape[i] | (many[i].astype(np.int32) if not w.keep_first else 0)
                late = report[-1] and not w.keep_first and not many[heads[-1]]
                if late:                             # its count may still grow with the next batch
                    i, flag = i[:-1], flag[:-1]
                    report[-1] = False
                yield _found(doc[i], place[i], np.zeros(len(i), np.int64), core[i], flag)
            h = heads[-1]
            pending = {"core": core[h], "path": path[h], "doc_id": doc[h], "place": place[h],
                       "shape": shape[h] | (1 if not w.keep_first and many[h] else 0),
                       "branch": bool(branch[-1]), "done": closed_first,
                       "told": bool(report[-1]) or (told and len(heads) == 1)}
        if pending is not None and pending["branch"] and not pending["told"]:
            one = lambda c, t=np.int64: np.array([pending[c]], t)
            yield _found(one("doc_id"), one("place"), np.zeros(1, np.int64), one("core"),
                         one("shape", np.int32))
    return run


def settled(w: Windows):
    """Like ``_compare`` for rows whose paths are single windows: nothing is left open."""
    compare = _compare(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in compare(batches):
            if found.num_rows and not found.column("open")[0].as_py():
                yield found
    return run


def of_text(found: pa.Scalar, mark: int | bytes) -> list[dict]:
    """What was found for the text with this mark among those gathered for its doc_id."""
    if isinstance(mark, bytes):
        mark = xxhash.xxh64_intdigest(mark, MARK_SEED) >> 33
    return [r for x in found.as_py() if x["mark"] == mark for r in x["found"]]


def covered(size: int, spans: list[tuple[int, int]], k: int) -> np.ndarray | None:
    """Which symbols lie in a window that starts in one of the spans (first start, how many)."""
    if not spans:
        return None
    lo, n = np.array(spans, np.int64).T
    depth = np.bincount(lo, minlength=size + 1) - np.bincount(lo + n - 1 + k, minlength=size + 1)
    return np.cumsum(depth)[:size] > 0


def _found(doc, place, n, core=None, shape=None) -> pa.RecordBatch:
    size, is_open = len(doc), core is not None
    columns = [pa.array(doc, pa.int64()), pa.array(place, pa.int64()), pa.array(n, pa.int32()),
               pa.array(core if is_open else np.zeros(size, np.int64), pa.int64()),
               pa.array(shape if is_open else np.zeros(size, np.int32), pa.int32()),
               pa.array(np.full(size, is_open))]
    return pa.RecordBatch.from_arrays(
        columns, names=["doc_id", "place", "n", "core", "shape", "open"])


def compared_runs(docs: DataFrame, w: Windows) -> DataFrame:
    """Settled stretches and open runs of all texts (``doc_id, text``), stored in the shared folder."""
    runs = docs.mapInArrow(_runs(w), RUNS)
    return cut(runs.repartition("core").sortWithinPartitions("core", "path", "doc_id", "place")
               .mapInArrow(_compare(w), FOUND))


def per_document(rows: DataFrame, *fields: str) -> DataFrame:
    """Rows gathered as one list per text; a text has a bounded number of them by its length.

    Equal rows of copies of a text that share its doc_id count once.
    """
    return cut(rows.groupBy("doc_id", F.col("place").bitwiseAND(0x7FFFFFFF).alias("mark")).agg(
        F.collect_set(F.struct(F.shiftright("place", 31).alias("lo"), *fields)).alias("found")))


def text_mark(text: Column) -> Column:
    """What ``text_marks`` gives, as an expression."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 33)


def _slot() -> tuple[Column, Column]:
    """Which bitmap a (_key, _mark) belongs to, and its bit there."""
    slot = F.pmod(F.xxhash64("_key", "_mark"), F.lit(FILTER_BITS))
    return F.shiftright(slot, 15).cast("int"), slot.bitwiseAND(0x7FFF)


def with_texts(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Texts joined with what ``per_document`` gathered for them, by document and mark of the text.

    Only texts that may have findings are shuffled.  A bitmap of hashed keys, of fixed size and
    therefore broadcast, tells which; the join decides.  With findings in far more than
    ``FILTER_BITS`` texts the bitmap fills up and all texts are shuffled, with the same result.
    """
    group, bit = _slot()
    side = found.select(F.col("doc_id").alias("_key"), F.col("mark").alias("_mark"),
                        F.array(F.struct("mark", "found")).alias("_found"))
    named = side.select(group.alias("_group"), bit.alias("_bit")).repartition("_group").groupBy("_group").agg(
        F.bitmap_construct_agg("_bit").alias("_bits"))
    rows = docs.withColumns({"_key": F.coalesce("doc_id", F.lit(NULL_DOC)), "_mark": text_mark(F.col("text"))})
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright("_bit", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    maybe = F.expr("shiftright(_byte, cast(_bit & 7 AS int)) & 1") == 1
    rows = rows.withColumns({"_group": group, "_bit": bit}).join(F.broadcast(named), "_group", "left").withColumn(
        "_byte", F.coalesce(byte, F.lit(0)))
    columns = [*docs.columns, "_found"]
    joined = rows.filter(maybe).select(*docs.columns, "_key", "_mark").join(side, ["_key", "_mark"], how).select(*columns)
    if how == "inner":
        return joined
    rest = rows.filter(~maybe).withColumn("_found", F.lit(None).cast(side.schema["_found"].dataType))
    return joined.unionByName(rest.select(*columns))
