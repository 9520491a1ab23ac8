"""Remove byte strings that occur more than once, by triggered phrases and their order.

A rolling hash over grams of ``anchor`` bytes triggers phrases: a trigger is a gram that is the least
in some window of ``length`` bytes.  All windows of a text with the same trigger form a phrase.  Equal
phrases meet in a shuffle by trigger and are repeated from end to end (``paths``).  This is not the full
prefix-free parsing: no suffix array of a dictionary and of a parse is built, and no order of the whole
corpus.

Phrases that share a trigger but differ are ordered twice: by the suffix that begins at the trigger and
by the reversed prefix that ends there, range-partitioned so that no trigger's phrases gather
in one task.  The longest common prefixes with the neighbours in the two orders bound how far any
other phrase agrees to the right and to the left, and so which windows can be repeated at all.  Just
those are compared one by one, by trigger and content.

Cases: null or empty text has no bytes; texts shorter than ``length`` keep all; matches never cross
texts; rows equal in doc_id and text are one source (not repetitions of each other) and treated
alike; rows that share a doc_id but not the text are told apart by 31 bits of a hash.  Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfall.llm import paths
from stepfall.llm.paths import Windows
from stepfall.plans.materialize import cut

LENGTH = 400
ANCHOR = 64

PHRASES = "core long, doc_id long, place long, shape int, before binary, after binary"
BOUND = "core long, doc_id long, place long, shape int, left int, right int"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _phrases(w: Windows):
    """Bytes of the open phrases: reversed before the trigger, forward from it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, docs = batch.column("_found"), paths.doc_numbers(batch)
            for a, b, data, offsets in paths.text_slices(batch):
                marks, out = paths.text_marks(data, offsets), []
                raw = data.tobytes()
                for i in range(a, b):
                    for r in paths.of_text(found[i], marks[i - a]):
                        lo, n, d = r["lo"], r["shape"] >> 15, r["shape"] >> 1 & 0x3FFF
                        at = int(offsets[i - a]) + lo
                        out.append((r["core"], docs[i], lo << 31 | int(marks[i - a]), r["shape"],
                                    raw[at:at + d][::-1], raw[at + d:at + n - 1 + w.k]))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, t) for x, t in zip(zip(*out), (
                            pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))],
                        names=["core", "doc_id", "place", "shape", "before", "after"])
    return run


def common_prefixes(texts: list[bytes]) -> np.ndarray:
    """Length of the common prefix of each text and the next one."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    width = int(size.max(initial=0)) + 1
    table = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in texts), np.uint8)
    table = table.reshape(len(texts), width)
    differ = table[1:] != table[:-1]
    differ[:, -1] = True
    return np.minimum(differ.argmax(axis=1), np.minimum(size[1:], size[:-1]))


def _neighbours(column: str):
    """Sorted rows: the longest agreement with the rows beside that have the same trigger.

    At a partition's ends the row beside is unknown; full agreement is assumed there, which only
    means that more windows are compared.
    """
    name = "left" if column == "before" else "right"
    blank = "right" if column == "before" else "left"

    def out(rows: list[dict], longest: np.ndarray) -> pa.RecordBatch:
        n = len(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array([r[c] for r in rows], t) for c, t in (
                ("core", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64()),
                ("shape", pa.int32()))]
            + [pa.array(longest, pa.int32()), pa.nulls(n, pa.int32())],
            names=["core", "doc_id", "place", "shape", name, blank]).select(
            ["core", "doc_id", "place", "shape", "left", "right"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, agree = None, 0            # the last row, and its agreement with the row before it
        for batch in batches:
            rows = batch.to_pylist()
            if not rows:
                continue
            if held is None:
                agree = len(rows[0][column])
                rows_all = rows
            else:
                rows_all = [held, *rows]
            texts = [r[column] for r in rows_all]
            core = np.array([r["core"] for r in rows_all])
            pair = np.where(core[1:] == core[:-1], common_prefixes(texts), 0)
            before = np.concatenate(([agree], pair))
            yield out(rows_all[:-1], np.maximum(before[:-1], pair))
            held, agree = rows_all[-1], int(before[-1])
        if held is not None:
            yield out([held], np.array([len(held[column])]))
    return run


def _ordered(phrases: DataFrame, column: str) -> DataFrame:
    rows = phrases.select("core", "doc_id", "place", "shape", column)
    return rows.repartitionByRange("core", column).sortWithinPartitions("core", column).mapInArrow(
        _neighbours(column), BOUND)


def _stretches(bounds: DataFrame, w: Windows) -> DataFrame:
    """Windows of a phrase that may occur elsewhere, by how far others agree on both sides."""
    both = bounds.groupBy("core", "doc_id", "place", "shape").agg(
        F.max("left").alias("left"), F.max("right").alias("right"))
    d = F.shiftright("shape", 1).bitwiseAND(0x3FFF)
    n = F.shiftright("shape", 15)
    most = F.least(d, F.col("left"))
    least = F.greatest(d - n + 1, F.lit(w.k) - F.col("right"))
    return both.select("core", "doc_id", (F.col("place") + F.shiftleft((d - most).cast("long"), 31))
                       .alias("place"), (most - least + 1).alias("n"), "shape").filter("n > 0")


def _kept_bytes(w: Windows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            texts, found = batch.column("text"), batch.column("_found")
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                raw = (texts[i].as_py() or "").encode("utf-8")
                spans = paths.of_text(found[i], raw) if found[i].is_valid else []
                gone = paths.covered(len(raw), [(r["lo"], r["n"]) for r in spans], w.k)
                kept, runs = raw, 0
                if gone is not None:
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    runs = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                out.append((doc, len(raw), len(raw) - len(kept), runs,
                            hashlib.sha256(kept).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 5, kinds)],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    return run


def repeated_spans(docs: DataFrame, w: Windows) -> DataFrame:
    """Starts of repeated strings per text: ``doc_id, mark, found`` with runs (lo, n) of starts."""
    first = paths.compared_runs(docs, w)
    opened = paths.per_document(first.filter("open"), "core", "shape")
    phrases = cut(paths.with_texts(docs, opened, "inner").mapInArrow(_phrases(w), PHRASES))
    bounds = _ordered(phrases, "after").unionByName(_ordered(phrases, "before"))
    second = paths.compared_edges(docs, w, cut(_stretches(bounds, w)))
    return paths.per_document(first.filter("NOT open").unionByName(second), "n")


def without_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
                    length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """Per text: bytes, bytes and stretches removed, hash of the bytes that stay."""
    w = Windows(length, anchor, words=False, keep_first=False)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return paths.with_texts(rows, repeated_spans(rows, w), "left").mapInArrow(_kept_bytes(w), RESULT)
