"""Remove long passages that occurred before, by paths of word windows.

The windows of ``k`` words are the edges of a token graph.  Neither its nodes and degrees nor the joins
that contract its paths are built: a run of windows between two minimizers is taken as a path of
edges that an occurrence enters and leaves as a whole, and it is stored as one row (``paths``).
A Spark shuffle joins the paths by their anchor.  Where an anchor leads into one path only, the path
stays compact, and all occurrences but the earliest are repeats from end to end.
Where several follow, only the earliest occurrence of each path is opened into its edges again; a second
shuffle joins those by edge and the earliest source coordinate (document, place) keeps it.
The coordinates found are merged into spans, and every word under a repeated edge goes.

Cases: null or empty text has no words; a text shorter than a window keeps all of them; a window is
never counted across texts; rows that are equal in doc_id and text are one source and treated alike;
rows that share a doc_id but not the text are told apart by 31 bits of a hash and ordered by it;
a null doc_id comes before all others.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfall.llm import paths
from stepfall.llm.paths import Windows

WORDS = 20
ANCHOR = 8

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _kept_words(w: Windows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            texts, found = batch.column("text"), batch.column("_found")
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                raw = (texts[i].as_py() or "").encode("utf-8")
                words = raw.split()
                spans = paths.of_text(found[i], raw) if found[i].is_valid else []
                gone = paths.covered(len(words), [(r["lo"], r["n"]) for r in spans], w.k)
                kept = words if gone is None else [x for x, g in zip(words, gone.tolist()) if not g]
                out.append((doc, len(words), len(words) - len(kept),
                            hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out), (
                    pa.int64(), pa.int64(), pa.int64(), pa.string()))] if out else [
                    pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"])
    return run


def repeated_spans(docs: DataFrame, w: Windows) -> DataFrame:
    """Starts of repeated windows per text: ``doc_id, mark, found`` with runs (lo, n) of starts."""
    first = paths.compared_runs(docs, w)
    opened = first.filter("open").withColumn("n", F.shiftright("shape", 15))
    second = paths.compared_edges(docs, w, opened)
    return paths.per_document(first.filter("NOT open").unionByName(second), "n")


def without_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
                    words: int = WORDS, anchor: int = ANCHOR) -> DataFrame:
    """Per text: number of words, how many a repeated window covers, hash of the words that stay."""
    w = Windows(words, anchor, words=True, keep_first=True)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    spans = repeated_spans(rows, w)
    return paths.with_texts(rows, spans, "left").mapInArrow(_kept_words(w), RESULT)
