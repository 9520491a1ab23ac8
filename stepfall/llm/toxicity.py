"""Toxicity of documents by a lexicon that also catches misspelled terms, read in context.

The lexicon is learned from labelled rows: words, and beginnings of words, that toxic texts use far more often
than others.  It is kept as a trie.  A word of a text is matched by a Levenshtein automaton of at most one
edit that runs along the trie: both advance together, so only branches that can still match are
walked.  A vectorized filter (an edit leaves the first or the last characters of a term alone) picks
the words worth matching, and distinct words are remembered.

Every hit is scored in its window: terms close to each other strengthen one another, and hits inside
quotation marks, wherever in the text these opened, are counted apart from the rest, so that reported
speech can weigh differently from abuse.  A logistic model on these counts gives the score.

Learning uses at most ``SAMPLE`` labelled rows, those with the least hash of their id: two thirds make
the lexicon with which one third teaches the logistic model, whose hits are thus unseen; the final
lexicon is then made from all of them.  Scoring uses the text alone, and all of it.

Cases: null or empty texts get the score of a text without hits; rows without a label, or with a null
one, teach nothing; with no labelled rows of both kinds every score is the share of toxic ones (near 0 if
there are none); repeated rows are scored alike; an empty table gives no rows.  Further columns are
kept by ``drop_toxic`` and ignored by ``scored``.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfall.llm import paths
from stepfall.plans.materialize import cut

SAMPLE = 20_000              # labelled rows that are learned from
LEAST_TEXTS = 3              # toxic texts that must use a term, however many there are
STRONG = 2.5                 # log odds of a term
FUZZY_FROM = 5               # shorter terms are matched exactly
WINDOW = 8                   # words on either side of a hit
REMEMBERED = 60              # bytes of words that are remembered; longer ones are matched each time
FEATURES = 6
COUNTED_BYTES = 1 << 20      # text whose words are counted together in a task
QUOTES = re.compile(rb'"|\xe2\x80[\x9c-\x9e]|\xc2[\xab\xbb]')
STRAIGHT = re.compile(rb'"|\n[ \t\r]*\n')      # and ends of paragraphs
OPENING, CLOSING, LOW, ANGLE = b"\xe2\x80\x9c", b"\xe2\x80\x9d", b"\xe2\x80\x9e", b"\xc2\xab"
BEHIND = (b"'", b"\xe2\x80\x98")          # single marks only tell when a word follows at once


@dataclass
class Trie:
    """Lexicon: children, and the weight where a term (or a stem) ends."""

    next: list[dict[str, int]] = field(default_factory=lambda: [{}])
    term: dict[int, float] = field(default_factory=dict)
    stem: dict[int, float] = field(default_factory=dict)
    long: set[int] = field(default_factory=set)     # terms that are matched with an edit, too

    def add(self, text: str, weight: float, stem: bool) -> None:
        at = 0
        for c in text:
            if c not in self.next[at]:
                self.next[at][c] = len(self.next)
                self.next.append({})
            at = self.next[at][c]
        (self.stem if stem else self.term)[at] = weight
        if not stem and len(text) >= FUZZY_FROM:
            self.long.add(at)

    def match(self, word: str) -> tuple[float, bool]:
        """Largest weight of a term at most one edit away, and whether it took an edit.

        A state of the automaton is (place in the word, edits so far).  Without edits there is one
        way through the trie; beside each of its nodes the states with one edit begin: a letter too
        many, another letter, or a letter left out, each going on without further edits.  Stems match
        without edits and whatever follows.
        """
        step, size = self.next, len(word)
        way, best = [0], 0.0
        for c in word:
            at = step[way[-1]].get(c, -1)
            if at < 0:
                break
            way.append(at)
            best = max(best, self.stem.get(at, 0.0))
        if len(way) == size + 1:
            best = max(best, self.term.get(way[-1], 0.0))
        if best > 0 or size < FUZZY_FROM - 1:
            return best, False
        for i, node in enumerate(way):
            starts = [(node, i + 1)] if i < size else []
            for c, child in step[node].items():
                starts.append((child, i))
                if i < size and c != word[i]:
                    starts.append((child, i + 1))
            for at, k in starts:
                while k < size and at >= 0:
                    at = step[at].get(word[k], -1)
                    k += 1
                if at in self.long:
                    best = max(best, self.term[at])
        return best, best > 0


@dataclass
class Model:
    terms: list[tuple[str, float]]
    stems: list[tuple[str, float]]
    weights: list[float]

    def trie(self) -> Trie:
        t = Trie()
        for text, w in self.terms:
            t.add(text, w, False)
        for text, w in self.stems:
            t.add(text, w, True)
        return t


def _put(bits: np.ndarray, code: int) -> None:
    bits[code >> 3] |= 1 << (code & 7)


def _has(bits: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return (bits[codes >> 3] >> (codes & 7).astype(np.uint8) & 1).astype(bool)


def _three(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The three bytes from each place on as one number."""
    return (data[at].astype(np.int32) << 16) | (data[at + 1].astype(np.int32) << 8) | data[at + 2]


class Finder:
    """Hits of a lexicon in slices of texts."""

    def __init__(self, model: Model) -> None:
        self.trie = model.trie()
        self.seen: dict[bytes, tuple[float, bool]] = {}
        # sets of the three (or two) bytes that terms begin and end with, one bit each
        self.head3, self.head2 = np.zeros(1 << 21, np.uint8), np.zeros(1 << 13, np.uint8)
        self.tail3 = np.zeros(1 << 21, np.uint8)
        for text, _ in model.terms + model.stems:
            raw = text.encode()
            code = int.from_bytes(raw[:3].ljust(3, b"\0"), "big")
            if len(text) < 6:
                _put(self.head2, code >> 8)
            _put(self.head3, code)
            if len(text) >= FUZZY_FROM:
                _put(self.tail3, int.from_bytes(raw[-3:], "big"))

    def hits(self, raw: bytes, begin: np.ndarray, end: np.ndarray
             ) -> list[tuple[int, float, bool]]:
        """(word number, weight, misspelled) of the words that match."""
        data = np.frombuffer(raw + b"\0\0\0", np.uint8)
        size = end - begin
        head = _three(data, begin) & np.where(size > 2, 0xFFFFFF, np.where(size > 1, 0xFFFF00, 0xFF0000))
        tail = _three(data, np.maximum(end - 3, 0))
        worth = (size > 2) & (_has(self.head3, head) | _has(self.head2, head >> 8) | _has(self.tail3, tail))
        out = []
        for k in np.flatnonzero(worth).tolist():
            word = raw[begin[k]:end[k]]
            found = self.seen.get(word)
            if found is None:
                found = self.trie.match(word.decode("utf-8", "replace"))
                if len(word) < REMEMBERED:
                    if len(self.seen) > 150_000:
                        self.seen.clear()
                    self.seen[word] = found
            if found[0] > 0:
                out.append((k, *found))
        return out


def words_of(raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of runs of letters and digits of any script, and each text's first word."""
    data = np.frombuffer(raw, np.uint8)
    inside = ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57)) | (data >= 128)
    # general punctuation (E2 80 xx) and signs of Latin-1 (C2 xx) separate words
    for lead, second, size in ((0xE2, 0x80, 3), (0xC2, None, 2)):
        at = np.flatnonzero(data[:len(data) - size + 1] == lead)
        if second is not None:
            at = at[data[at + 1] == second]
        for i in range(size):
            inside[at + i] = False
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1] if len(data) else inside
    after = np.concatenate((inside[1:], [False])) & ~edge[1:] if len(data) else inside
    begin, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return begin, end, np.searchsorted(begin, offsets)


def lowered(data: np.ndarray) -> bytes:
    return data.tobytes().lower()


def _word_byte(raw: bytes, at: int) -> bool:
    c = raw[at]
    return c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122


def _straight_pairs(raw: bytes, text_from: int, text_to: int) -> set[int]:
    """Places of the straight marks that open or close a quotation.

    One opens behind anything but a letter or digit (an inch mark does not), and only if another one closes
    it in the same paragraph.
    """
    out, opened = set(), -1
    for m in STRAIGHT.finditer(raw, text_from, text_to):
        at = m.start()
        if m.group() != b'"':
            opened = -1
        elif opened >= 0:
            out.update((opened, at))
            opened = -1
        elif at == text_from or not _word_byte(raw, at - 1):
            opened = at
    return out


def _quotations(raw: bytes, text_from: int, text_to: int) -> tuple[list[int], list[bool]]:
    """Places behind a text's quotation marks, and whether a quotation is open from there on.

    Straight marks open and close in turn, see ``_straight_pairs``.  A closing mark closes one that is open,
    if any; the mark that opens in English closes after a low one.
    """
    places, opened = [], []
    straight, curly, low, angle = False, 0, 0, 0
    pairs = _straight_pairs(raw, text_from, text_to)
    for m in QUOTES.finditer(raw, text_from, text_to):
        mark = m.group()
        if mark == b'"':
            straight ^= m.start() in pairs
        elif mark == LOW:
            low += 1
        elif mark == OPENING and not low:
            curly += 1
        elif mark in (OPENING, CLOSING):
            if curly and mark == CLOSING:
                curly -= 1
            else:
                low = max(0, low - 1)
        else:
            angle = angle + 1 if mark == ANGLE else max(0, angle - 1)
        places.append(m.end())
        opened.append(straight or curly > 0 or low > 0 or angle > 0)
    return places, opened


def _quoted(raw: bytes, text_from: int, at: int,
            marks: tuple[list[int], list[bool]] | None = None) -> bool:
    """Whether a word stands right behind a quotation mark or inside a quotation of its text.

    A single mark behind a letter is an apostrophe (as in French elision) and opens nothing.
    """
    for mark in BEHIND:
        if raw.endswith(mark, text_from, at):
            before = at - len(mark)
            if before == text_from or not _word_byte(raw, before - 1):
                return True
    places, opened = marks if marks is not None else _quotations(raw, text_from, len(raw))
    k = bisect_right(places, at)
    return k > 0 and opened[k - 1]


def features(finder: Finder, raw: bytes, offsets: np.ndarray) -> np.ndarray:
    """One row per text: 1, exact, misspelled, quoted, densest window, length."""
    begin, end, first = words_of(raw, offsets)
    out = np.zeros((len(offsets) - 1, FEATURES))
    out[:, 0] = 1.0
    out[:, 5] = np.log1p(np.diff(first)) / 5
    hits = finder.hits(raw, begin, end)
    texts = np.searchsorted(first, [k for k, _, _ in hits], "right") - 1
    lately: list[tuple[int, int, float]] = []
    marks, marked = ([], []), -1                 # quotations of the text at hand
    for (k, weight, misspelled), t in zip(hits, texts.tolist()):
        if t != marked:
            marks, marked = _quotations(raw, int(offsets[t]), int(offsets[t + 1])), t
        quoted = _quoted(raw, int(offsets[t]), int(begin[k]), marks)
        out[t, 3 if quoted else 2 if misspelled else 1] += weight
        lately = [x for x in lately if x[0] == t and k - x[1] <= WINDOW]
        lately.append((t, k, weight))
        out[t, 4] = max(out[t, 4], sum(x[2] for x in lately))
    out[:, 1:5] = np.log1p(out[:, 1:5])
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with the number of toxic and of other texts that have them."""
    for batch in batches:
        toxic = batch.column("toxic").to_pylist()
        for a, b, data, offsets in paths.text_slices(batch, COUNTED_BYTES):
            counts: tuple[Counter, Counter] = Counter(), Counter()
            raw = lowered(data)
            begin, end, first = words_of(raw, offsets)
            for i in range(b - a):
                span = slice(first[i], first[i + 1])
                words = {raw[x:y] for x, y in zip(begin[span].tolist(), end[span].tolist())}
                counts[toxic[a + i]].update(w for w in words if len(w) > 2)
            found = sorted(set(counts[0]) | set(counts[1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([w.decode("utf-8", "replace") for w in found], pa.string()),
                 pa.array([counts[1][w] for w in found], pa.int64()),
                 pa.array([counts[0][w] for w in found], pa.int64())], names=["word", "bad", "good"])


def _strongest(counts: DataFrame, bad: int, good: int, least: int,
               strong: float) -> list[tuple[str, float]]:
    """All words that are used often and selectively enough, with their log odds."""
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
    rows = counts.filter(F.col("bad") >= least).withColumn("w", odds).filter(F.col("w") >= strong) \
        .orderBy((F.col("w") * F.col("bad")).desc(), "word").collect()
    return [(r["word"], float(r["w"])) for r in rows]


def learn_lexicon(rows: DataFrame) -> tuple[list, list]:
    """Terms and stems of labelled texts (``text, toxic``), with log odds as weights."""
    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return [], []
    counts = cut(rows.select("text", "toxic").mapInArrow(_counts, "word string, bad long, good long")
                 .groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))
    begun = counts.withColumn("n", F.explode(F.sequence(F.lit(4), F.lit(7)))).filter(
        F.length("word") > F.col("n")).withColumn("word", F.expr("substring(word, 1, n)")).groupBy(
        "word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count("*").alias("forms"))
    stems = dict(_strongest(begun.filter("forms >= 5"), bad, good, 3 * LEAST_TEXTS, STRONG + 1.5))
    stems = [(s, w) for s, w in stems.items() if not any(s[:i] in stems for i in range(4, len(s)))]
    # words that begin with a stem stay terms, too: a stem does not match their misspelled forms
    return _strongest(counts, bad, good, LEAST_TEXTS, STRONG), stems


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic model by Newton's method; the bias is not shrunk."""
    w, shrink = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    shrink[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - shrink * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink + 1e-9)
        step = np.linalg.solve(bend, slope)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _feature_rows(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(model)
        for batch in batches:
            for a, b, data, offsets in paths.text_slices(batch):
                x = features(finder, lowered(data), offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("toxic").slice(a, b - a), pa.array(list(x), pa.list_(pa.float64()))],
                    names=["toxic", "x"])
    return run


def train(docs: DataFrame, labels: DataFrame, *, teaches: Column | None = None,
          doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic",
          sample: int = SAMPLE) -> Model:
    """Learn from labelled rows for which ``teaches`` (on the labels' ``doc_id``) holds."""
    named = labels.select(F.col(doc_id).alias("doc_id"), F.col(toxic).cast("int").alias("toxic"))
    named = named.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"))
    if teaches is not None:
        named = named.filter(teaches)
    chosen = named.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(sample)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # at most ``sample`` rows of two numbers and a hash
    rows = cut(texts.join(F.broadcast(chosen), "doc_id").select("h", "toxic", "text").dropDuplicates(
        ["text"]))
    part = F.pmod(F.shiftright("h", 8), F.lit(3))
    terms, stems = learn_lexicon(rows.filter(part < 2))
    model = Model(terms, stems, [0.0] * FEATURES)
    held = rows.filter(part == 2).select("text", "toxic").mapInArrow(
        _feature_rows(model), "toxic int, x array<double>").collect()
    y = np.array([r["toxic"] for r in held], float)
    if not len(y) or y.min() == y.max() or not terms:
        share = rows.agg(F.avg("toxic")).first()[0] or 0.0
        model.weights[0] = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    else:
        model.weights = fit_logistic(np.array([r["x"] for r in held]), y).tolist()
        model.terms, model.stems = learn_lexicon(rows)
    return model


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, weights = Finder(model), np.array(model.weights)
        for batch in batches:
            for a, b, data, offsets in paths.text_slices(batch):
                z = features(finder, lowered(data), offsets) @ weights
                score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [c.slice(a, b - a) for n, c in zip(batch.schema.names, batch.columns) if n != "text"]
                    + [pa.array(score)], names=[n for n in batch.schema.names if n != "text"] + ["score"])
    return run


def scored(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score`` of every text."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_scores(model), "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Model, *, text: str = "text", limit: float = 0.5) -> DataFrame:
    """The documents, all columns, whose score is below ``limit``."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                       F.col(text).alias("text"))
    schema = f"_row {rows.schema['_row'].dataType.simpleString()}, score double"
    return rows.mapInArrow(_scores(model), schema).filter(F.col("score") < limit).select("_row.*")
