"""Find runs of words that repeat with a period, by a difference-cover index of common extensions.

A run is a longest stretch of words in which words ``q`` apart are equal (``q`` is its least period)
and which holds at least ``REPEATS`` periods and ``LEAST`` words.

*Harmonic grid.*  A run of period q covers two neighbouring multiples of q.  So only pairs (y - q, y)
with q a divisor of y are looked at, n log n of them; a few words must agree before more is asked.
*Common extensions.*  How far two places agree is answered by ``Extensions``: only suffixes at the places of a
difference cover (6 of 31) are sorted.  Any two places reach sampled places after the same step of fewer
than 31 words; these words are compared, the rest is a range minimum over the common prefixes of
sorted neighbours (sparse table).  The same over the reversed text extends to the left.
A pair's stretch is a run when it is long enough; stretches found more than once keep their least period.

Spark deals out documents; each is looked at in full by the task that holds it, since no run leaves its
document.  Memory follows the longest document (some 60 bytes a word, and pairs in chunks), not the table.

Cases: null or empty text has no words and no runs; repeated rows get equal results; words are told
apart exactly, as bytes; equal exponents are ordered by start, then period; an empty table gives
no rows; other columns are ignored by ``periodic_runs`` and kept by ``without_periods``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfall.llm.common import WORD

LEAST = 24                   # words of a run
REPEATS = 3                  # periods of a run
GRID_WORDS = 1 << 16         # the grid of texts up to this size is kept
CHUNK_PAIRS = 1 << 20
FEW = 8                      # words compared one by one before the index is asked

# A perfect difference set; every residue but 0 is a difference in just one way.
MODULUS = 31
COVER = (1, 5, 11, 24, 25, 27)

RUN = "array<struct<start: bigint, length: bigint, period: bigint>>"
_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _first_of_pair() -> np.ndarray:
    """For every residue d: an element e of the cover such that e + d is one too."""
    out = np.full(MODULUS, COVER[0])
    for a in COVER:
        for b in COVER:
            out[(b - a) % MODULUS] = a
    return out


_MEETS = _first_of_pair()
_IN_COVER = np.isin(np.arange(MODULUS), COVER)


class Extensions:
    """How many words from place i on equal those from place j on (i < j)."""

    def __init__(self, words: np.ndarray) -> None:
        n = len(words)
        # the end differs from every word, so no comparison runs past it
        self.words = np.concatenate((words, np.full(MODULUS + 1, -1, words.dtype)))
        places = np.flatnonzero(np.resize(_IN_COVER, n + 1))
        self.row = np.full(n + 1, -1, np.int32)
        self.row[places] = np.arange(len(places), dtype=np.int32)
        levels, order = self._sorted(places)
        self.rank = np.empty(len(places), np.int64)
        self.rank[order] = np.arange(len(places))
        common = self._neighbours(places[order], levels)
        self.table = [common]
        while 2 << len(self.table) - 1 <= len(common):
            last, half = self.table[-1], 1 << len(self.table) - 1
            self.table.append(np.minimum(last[:-half], last[half:]))

    def _sorted(self, places: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Ranks by the first 31, 62, 124 ... words of the sampled suffixes, and their order."""
        blocks = np.lib.stride_tricks.sliding_window_view(self.words, MODULUS)[places]
        order = np.lexsort(blocks.T[::-1])
        new = np.concatenate(([False], (blocks[order][1:] != blocks[order][:-1]).any(axis=1)))
        rank = np.empty(len(places), np.int64)
        rank[order] = np.cumsum(new)
        levels, step = [rank], MODULUS
        while rank.max(initial=0) + 1 < len(places):
            far = self._rank_at(rank, places + step)
            key = rank * (len(places) + 1) + far + 1
            order = np.argsort(key, kind="stable")
            new = np.concatenate(([False], key[order][1:] != key[order][:-1]))
            rank = np.empty(len(places), np.int64)
            rank[order] = np.cumsum(new)
            levels.append(rank)
            step *= 2
        return levels, order

    def _rank_at(self, rank: np.ndarray, places: np.ndarray) -> np.ndarray:
        out = np.full(len(places), -1, np.int64)
        inside = places < len(self.row)
        out[inside] = rank[self.row[places[inside]]]
        return out

    def _neighbours(self, ordered: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Common words of each sorted suffix and the next one."""
        a, b = ordered[:-1].copy(), ordered[1:].copy()
        for k in range(len(levels) - 1, -1, -1):
            same = self._rank_at(levels[k], a)
            same = (same >= 0) & (same == self._rank_at(levels[k], b))
            a[same] += MODULUS << k
            b[same] += MODULUS << k
        return a - ordered[:-1] + self._compared(a, b, np.full(len(a), MODULUS))

    def _compared(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that agree one by one, ``most`` at most."""
        out = np.zeros(len(a), np.int64)
        left = np.arange(len(a))
        for t in range(MODULUS):
            left = left[most[left] > t]
            left = left[self.words[a[left] + t] == self.words[b[left] + t]]
            if not len(left):
                break
            out[left] = t + 1
        return out

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common words from i and from j on; i < j everywhere."""
        step = (_MEETS[(j - i) % MODULUS] - i) % MODULUS
        out = self._compared(i, j, step)
        on = np.flatnonzero(out == step)
        x = self.rank[self.row[i[on] + step[on]]]
        y = self.rank[self.row[j[on] + step[on]]]
        low, high = np.minimum(x, y), np.maximum(x, y)
        size = np.frexp(high - low)[1] - 1           # power of two within the range
        for k in np.unique(size).tolist():
            these = size == k
            row = self.table[k]
            out[on[these]] += np.minimum(row[low[these]], row[high[these] - (1 << k)])
        return out


_grid: dict[str, np.ndarray] = {}


def _grid_pairs(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (y, q) with y < n and q a divisor of y, in chunks."""
    if n <= GRID_WORDS:
        if not _grid:
            q = np.repeat(np.arange(1, GRID_WORDS // 2), (GRID_WORDS - 1) // np.arange(1, GRID_WORDS // 2))
            y = np.concatenate([np.arange(p, GRID_WORDS, p) for p in range(1, GRID_WORDS // 2)])
            order = np.argsort(y, kind="stable")
            _grid["y"], _grid["q"] = y[order].astype(np.int32), q[order].astype(np.int32)
        upto = int(np.searchsorted(_grid["y"], n))
        yield _grid["y"][:upto], _grid["q"][:upto]
        return
    held, size = [], 0
    for q in range(1, n // REPEATS + 1):
        y = np.arange(q, n, q)
        held.append((y, np.full(len(y), q)))
        size += len(y)
        if size >= CHUNK_PAIRS:
            yield tuple(map(np.concatenate, zip(*held)))
            held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def runs_of(words: np.ndarray) -> np.ndarray:
    """Runs of one text as rows (start, length, period), by start, then period."""
    n = len(words)
    found, right, left = [], None, None
    if n >= LEAST:
        for y, q in _grid_pairs(n):
            # the first grid pair inside a run agrees at least that far
            need = np.maximum(LEAST - 2 * q, q * (REPEATS - 2)) + 1
            keep = (y + need <= n) & (words[y] == words[y - q])
            y, q, need = (v[keep].astype(np.int64) for v in (y, q, need))
            for t in range(1, FEW):
                keep = words[y + t] == words[y - q + t]
                y, q, need = y[keep], q[keep], need[keep]
            if not len(y):
                continue
            if right is None:
                right = Extensions(words)
            ahead = right.of(y - q, y)
            keep = ahead >= need
            y, q, ahead = y[keep], q[keep], ahead[keep]
            if not len(y):
                continue
            if left is None:
                left = Extensions(words[::-1].copy())
            back = left.of(n - y, n - y + q)
            length = back + ahead + q
            keep = length >= np.maximum(LEAST, REPEATS * q)
            found.append(np.unique(np.stack((y - q - back, length, q))[:, keep], axis=1))
    if not found:
        return np.zeros((0, 3), np.int64)
    # rows come out by start, length, period: the first of equal stretches has the least period
    runs = np.unique(np.concatenate(found, axis=1), axis=1)
    first = np.ones(runs.shape[1], bool)
    first[1:] = (runs[:2, 1:] != runs[:2, :-1]).any(axis=0)
    runs = runs[:, first]
    return runs[:, np.lexsort((runs[2], runs[0]))].T


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Mask of the words that stay: a run keeps its first period, unless another drops that."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges[:-1]) == 0


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs, collapsed = [], []
        for text in batch.column("_text"):
            words = (text.as_py() or "").encode("utf-8").split()
            number: dict[bytes, int] = {}
            ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
            rows = runs_of(ids)
            if len(rows):
                words = [words[i] for i in np.flatnonzero(kept_words(len(words), rows)).tolist()]
            runs.append([{"start": s, "length": n, "period": q} for s, n, q in rows.tolist()])
            collapsed.append(b" ".join(words).decode("utf-8"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("_row"), pa.array(runs, _RUN_TYPE), pa.array(collapsed, pa.string())],
            names=["_row", "_runs", "_collapsed"])


def _looked_at(docs: DataFrame, text: Column, *keep: Column) -> DataFrame:
    rows = docs.select(F.struct(*keep).alias("_row"), text.cast("string").alias("_text"))
    kind = rows.schema["_row"].dataType.simpleString()
    return rows.mapInArrow(_found, f"_row {kind}, _runs {RUN}, _collapsed string")


def periodic_runs(docs: DataFrame, *, doc_id: str = "doc_id", text: Column | str = "text") -> DataFrame:
    """``doc_id, runs, collapsed`` per document: runs by start, then period, and the words that stay."""
    text = F.col(f"`{text}`") if isinstance(text, str) else text
    return _looked_at(docs, text, F.col(f"`{doc_id}`").cast("long").alias("doc_id")).select(
        "_row.doc_id", F.col("_runs").alias("runs"), F.col("_collapsed").alias("collapsed"))


def without_periods(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """All columns of ``docs``; texts with runs lose the repeated periods, other texts stay as they are."""
    found = _looked_at(docs, F.col(f"`{text}`"), *[F.col(f"`{c}`") for c in docs.columns])
    value = lambda c: F.col("_row").getField(c)
    return found.select(*[
        (F.when(F.size("_runs") > 0, F.col("_collapsed")).otherwise(value(c)) if c == text else value(c)).alias(c)
        for c in docs.columns])


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; the earliest of equal ones, null if none."""
    def better(best: Column, run: Column) -> Column:
        return F.when(best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run) \
            .otherwise(best)
    return F.aggregate(runs, F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), better)


def repeated_tail(text: Column, start: Column, period: Column) -> Column:
    """The words of ``text``; from word ``start`` on the first ``period`` of them over and over."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    rest = F.size(words) - start
    times = F.ceil(rest / period).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, start + 1, period), times))
    return F.array_join(F.concat(F.slice(words, F.lit(1), start), F.slice(again, F.lit(1), rest)), " ")
