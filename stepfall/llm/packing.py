"""Pack token pieces into sequences of a fixed length.

Documents are tokenized where they lie; longer ones are cut into pieces of ``capacity`` tokens.  What
meets on the driver is only the histogram of piece lengths, at most ``capacity`` rows however many
documents there are.  On it a configuration linear program is solved: a configuration is a multiset
of length classes that fits into a sequence, and the program asks how often to use each one.  It is
solved by multiplicative weights: every class has a weight, a knapsack dynamic program prices the
configuration with the largest weight per sequence, the configuration is used for a step and the
weights of the classes it served fall.  Half of the solution or more is rounded (whole parts first, then
the largest fractions up) and the rest solved again.  A class stands in the program with its mean
length; when a configuration is filled, its last two pieces are chosen to come as close to the
capacity as they can.  The last pieces go best-fit into the gaps, longest first, on counted groups of
equal sequences.  The finished plan says for the r-th piece of each length where it goes; pieces find
their r by counting within salted groups of equal length, so no length gathers in one task.

Cases: null or empty text is the end token alone; repeated rows are packed once each; very long
texts become many pieces; an empty table gives no rows.  Only the named columns are read.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepfall.llm.paths import stretch_hashes, text_slices
from stepfall.plans.materialize import cut

CAPACITY = 4096
END_ID = 1
CACHE_WORDS = 200_000       # words in either half of what a Python worker remembers
TEXT_BYTES = 1 << 20        # text looked at together in a task
CLASS = 16                  # lengths in one class of the program
ROUNDS = 400                # most steps of one solution; it ends when it holds as many tokens as there are
STEP = 0.25
TAIL = 0.02                 # share of the tokens below which best fit ends the plan
LOOSE = 0.1                 # share of the tokens above which a pass without a full sequence allows gaps
RANK_GROUP = 50_000         # pieces of one length that are numbered in one task
_RANK_BITS = 44

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordTokenizer:
    """Ids of texts, for a tokenizer that lowers letters and never joins over ASCII white space.

    A slice of texts is cut into words between ASCII white space, with a stop or comma after ASCII
    letters as a word of its own (the tokenizer separates them too).  Distinct words of the slice are
    looked up in a bounded cache; new ones made of letters are encoded together, which gives exactly
    one end-of-word token each and is checked by count.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        # words seen lately, and those seen before them; a word that is met again moves back up
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def forget(self) -> None:
        """Give the memory back to whatever runs next in this Python worker."""
        self.known, self.older = {}, {}

    def _encode_letters(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of letters, encoded as one text."""
        text = b" ".join(words).decode("utf-8")
        ids = np.asarray(self.tokenizer.encode_batch_fast(
            [text], add_special_tokens=False)[0].ids, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words) or stops[-1] != len(ids):
            return self._encode_each(words)
        flat, cuts = ids.tobytes(), [0, *(stops * 4).tolist()]
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]

    def _encode_each(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(
            [w.decode("utf-8") for w in words], add_special_tokens=False)
        return [np.asarray(e.ids, "<u4").tobytes() for e in found]

    def look_up(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words; new ones are remembered."""
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        found = list(map(self.known.get, words))
        gaps = []
        for i in [i for i, x in enumerate(found) if x is None]:
            found[i] = self.older.get(words[i])
            if found[i] is None:
                gaps.append(i)
            else:
                self.known[words[i]] = found[i]
        letters = [i for i in gaps if words[i].isalpha() or words[i].decode("utf-8").isalpha()]
        inside = set(letters)
        for group, encode in ((letters, self._encode_letters),
                              ([i for i in gaps if i not in inside], self._encode_each)):
            for k in range(0, len(group), 500):
                part = [words[i] for i in group[k:k + 500]]
                ids = encode(part)
                self.known.update(zip(part, ids))
                for i, x in zip(group[k:k + 500], ids):
                    found[i] = x
        return found

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice in a row, and where each text's ids begin (and the last end)."""
        raw = data.tobytes()
        if b"<|" not in raw:                    # the names of special tokens are case-sensitive
            raw = raw.lower()
        begin, end, counts = word_bounds(np.frombuffer(raw, np.uint8), offsets)
        hashes = stretch_hashes(np.frombuffer(raw, np.uint8), begin, end)
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        words = [raw[a:b] for a, b in zip(begin[first].tolist(), end[first].tolist())]
        found = self.look_up(words)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        long = sizes[which]
        upto = np.concatenate(([0], np.cumsum(long)))
        source = np.repeat((np.cumsum(sizes) - sizes)[which] - upto[:-1], long)
        ids = flat[source + np.arange(upto[-1])]
        return ids, upto[np.concatenate(([0], np.cumsum(counts)))]


def word_bounds(data: np.ndarray, offsets: np.ndarray
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word of the texts, and how many each text has."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    inside = ~space
    starts, ends = offsets[:-1], offsets[1:]
    full = starts < ends
    head = np.zeros(len(data), bool)
    tail = np.zeros(len(data), bool)
    head[starts[full]] = True
    tail[ends[full] - 1] = True
    after = head.copy()
    after[1:] |= space[:-1]
    before = tail.copy()
    before[:-1] |= space[1:]
    mark = np.zeros(len(data), bool)
    mark[1:] = (data[:-1] >= 97) & (data[:-1] <= 122)
    mark &= before & ~head & _MARKS[data]
    stop = inside & before
    stop[:-1] |= mark[1:]
    begin, end = np.flatnonzero(inside & (after | mark)), np.flatnonzero(stop) + 1
    return begin, end, np.searchsorted(begin, ends) - np.searchsorted(begin, starts)


_MARKS = np.zeros(256, bool)
_MARKS[list(b".,!?;:")] = True


@functools.cache
def worker_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this Python worker; words are remembered for a task only."""
    return WordTokenizer(path)


def _tokenize(path: str, capacity: int, end_id: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_tokenizer(path)
        last = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            for a, b, data, offsets in text_slices(batch, TEXT_BYTES):
                ids, starts = tokenizer.ids(data, offsets)
                flat, at = ids.tobytes(), (starts * 4).tolist()
                out: dict[str, list] = {k: [] for k in (
                    "doc_id", "piece", "start", "length", "ids_crc32")}
                kept: list[bytes] = []
                for doc, x, y in zip(docs[a:b], at, at[1:]):
                    whole = flat[x:y] + last
                    for k, c in enumerate(range(0, len(whole), 4 * capacity)):
                        part = whole[c:c + 4 * capacity]
                        out["doc_id"].append(doc)
                        out["piece"].append(k)
                        out["start"].append(c // 4)
                        out["length"].append(len(part) // 4)
                        out["ids_crc32"].append(zlib.crc32(part))
                        if keep_ids:
                            kept.append(part)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                columns = [pa.array(v, t) for v, t in zip(out.values(), kinds)]
                names = list(out)
                if keep_ids:
                    columns.append(pa.array(kept, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
        tokenizer.forget()
    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, *, doc_id: str = "doc_id",
                 text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
                 keep_ids: bool = False) -> DataFrame:
    """Pieces of every document; with ``keep_ids`` also their ids (little-endian 32-bit)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_tokenize(tokenizer_path, capacity, end_id, keep_ids),
                           PIECES + (", ids binary" if keep_ids else ""))


def best_configuration(weights: np.ndarray, sizes: np.ndarray, room: int,
                       most: np.ndarray | None = None) -> np.ndarray:
    """Knapsack: how often to take each item for the most weight within ``room``.

    An item is taken at most ``most`` times, if given.  Its copies are offered in lots of 1, 2, 4 and so
    on; every lot is one vector step over all rooms.
    """
    copies = room // sizes if most is None else np.minimum(room // sizes, most)
    lots: list[tuple[int, int]] = []
    for i, k in enumerate(copies.tolist()):
        lot = 1
        while k > 0:
            lots.append((i, min(lot, k)))
            k -= lot
            lot *= 2
    best = np.zeros(room + 1)
    taken_at = np.zeros((len(lots), room + 1), bool)
    for row, (i, lot) in enumerate(lots):
        size = lot * int(sizes[i])
        offer = best[:-size] + lot * weights[i]
        np.greater(offer, best[size:], out=taken_at[row, size:])
        best[size:] = np.maximum(offer, best[size:])
    taken, c = np.zeros(len(sizes), np.int64), room
    for row in range(len(lots) - 1, -1, -1):
        if taken_at[row, c]:
            i, lot = lots[row]
            taken[i] += lot
            c -= lot * int(sizes[i])
    return taken


def configuration_lp(sizes: np.ndarray, demand: np.ndarray, room: int, rounds: int = ROUNDS,
                     step: float = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Covering program min sum x, A x >= demand, by multiplicative weights, up to a common factor.

    A step serves the scarcest item of the priced configuration by ``step`` of its demand; steps end
    when the configurations hold the demanded volume.

    Returns configurations (rows of counts per size) and how often to use each.
    """
    found: dict[bytes, tuple[np.ndarray, float]] = {}
    log_weight = -np.log(demand.astype(float))
    volume, whole = 0.0, float(demand @ sizes)
    for _ in range(rounds):
        weight = np.exp(log_weight - log_weight.max())
        taken = best_configuration(weight, sizes, room, demand)
        used = np.flatnonzero(taken)
        if not len(used):
            break
        amount = step * (demand[used] / taken[used]).min()
        log_weight = log_weight - amount * taken / demand
        key = taken.tobytes()
        found[key] = (taken, found.get(key, (taken, 0.0))[1] + amount)
        volume += amount * float(taken @ sizes)
        if volume >= whole:
            break
    if not found:
        return np.zeros((0, len(sizes)), np.int64), np.zeros(0)
    table = np.array([t for t, _ in found.values()])
    times = np.array([x for _, x in found.values()])
    return table, times


def program_sequences(left: dict[int, int], capacity: int = CAPACITY, *, width: int = CLASS,
                      rounds: int = ROUNDS) -> list[tuple[int, list[int]]]:
    """Groups of equal sequences (how many, piece lengths) by the configuration program.

    The program is solved for the pieces that are left, half of its solution is rounded and placed,
    and the rest is solved again, until a pass places nothing or less than ``TAIL`` of the tokens is
    left.  A pass places the whole parts of all configurations; while these are less than half of the
    solution, the largest fractions are rounded up.  Sequences are filled to within ``width`` tokens;
    where the lengths left do not allow that, larger gaps are taken.  ``left`` is reduced by what
    is placed.
    """
    groups: list[tuple[int, list[int]]] = []
    total = sum(n * c for n, c in left.items())
    unit, slack = max(1, width // 2), width
    while (rest := sum(n * c for n, c in left.items())) > TAIL * total:
        classes: dict[int, list[int]] = {}
        for n in sorted(n for n, c in left.items() if c > 0):
            classes.setdefault(-(-n // width), []).append(n)
        names = sorted(classes)
        demand = np.array([sum(left[n] for n in classes[s]) for s in names], np.int64)
        mean = [sum(n * left[n] for n in classes[s]) / d for s, d in zip(names, demand)]
        sizes = np.array([max(1, round(m / unit)) for m in mean], np.int64)
        room = max(capacity // unit, int(sizes.max()))
        table, times = configuration_lp(sizes, demand, room, rounds)
        if not len(times):
            break
        times = times * (demand @ sizes) / (times @ (table @ sizes))
        counts = np.floor(times).astype(np.int64)
        half = int(np.ceil(times.sum() / 2))
        up = np.argsort(counts - times, kind="stable")[:max(0, half - int(counts.sum()))]
        counts[up] += 1
        placed = 0
        for i in np.argsort(-times, kind="stable"):
            slots = [names[k] for k in np.flatnonzero(table[i])[::-1] for _ in range(table[i, k])]
            for group in _fill(int(counts[i]), slots, classes, left, capacity, width, slack):
                groups.append(group)
                placed += group[0]
        if not placed:
            if rest <= LOOSE * total or slack >= capacity:
                break
            slack *= 8
    return groups


def _fill(times: int, slots: list[int], classes: dict[int, list[int]], left: dict[int, int],
          capacity: int, width: int, slack: int) -> list[tuple[int, list[int]]]:
    """Give actual lengths to the slots of one configuration, longest first, in runs of equal sequences.

    All slots but the last two take the length of their class that is left most often.  Of the last two
    the first stays in its class, and the second is the longest piece that then fits, at most two
    classes from its own; the pair that leaves least room is taken.  A configuration that cannot be
    filled up to ``slack`` tokens ends.
    """
    out = []
    while times > 0:
        need: dict[int, int] = {}

        def free(n: int) -> int:
            return left.get(n, 0) - need.get(n, 0)

        room = capacity
        for s in slots[:-2]:
            n = max(classes[s], key=lambda n: (free(n), n))
            if free(n) <= 0:
                return out
            need[n] = need.get(n, 0) + 1
            room -= n
        low, high = (slots[-1] - 3) * width, (slots[-1] + 2) * width
        best: tuple[int, tuple[int, ...]] | None = None
        for n in ([0] if len(slots) == 1 else [n for n in classes[slots[-2]] if free(n) > 0]):
            for m in range(min(room - n, high), max(low, 0), -1):
                if free(m) > (m == n):
                    if best is None or n + m > best[0]:
                        best = (n + m, (n, m) if n else (m,))
                    break
            if best is not None and best[0] == room:
                break
        if best is None or room - best[0] > slack:
            return out
        for n in best[1]:
            need[n] = need.get(n, 0) + 1
        run = min(times, *(left[n] // k for n, k in need.items()))
        for n, k in need.items():
            left[n] -= k * run
        out.append((run, [n for n, k in sorted(need.items(), reverse=True) for _ in range(k)]))
        times -= run
    return out


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY, *, width: int = CLASS,
                   rounds: int = ROUNDS) -> list[tuple[int, list[int]]]:
    """Groups of equal sequences, (how many, piece lengths), for the counted lengths.

    Full pieces are sequences of their own, the configuration program places the others, and what its
    rounding leaves goes best-fit into the gaps.  Rounding costs sequences where a corpus has only
    a few: while the plan then needs more than best-fit alone, twice as many of the program's
    emptiest sequences are opened again and their pieces go best-fit too.
    """
    left = {n: int(c) for n, c in histogram.items() if c > 0}
    full = [(left.pop(capacity), [capacity])] if left.get(capacity) else []
    goal = _count(_best_fit([], dict(left), capacity))
    groups = sorted(program_sequences(left, capacity, width=width, rounds=rounds),
                    key=lambda g: sum(g[1]))
    opened = 0
    while True:
        again = dict(left)
        for m, content in groups[:opened]:
            for n in content:
                again[n] = again.get(n, 0) + m
        plan = _best_fit(groups[opened:], again, capacity)
        if _count(plan) <= goal or opened >= len(groups):
            return full + plan
        opened = max(1, 2 * opened)


def _count(groups: list[tuple[int, list[int]]]) -> int:
    return sum(m for m, _ in groups)


def _best_fit(groups: list[tuple[int, list[int]]], left: dict[int, int],
              capacity: int) -> list[tuple[int, list[int]]]:
    """Best fit, longest first, on groups of equal sequences kept by the room they have."""
    by_room: list[list[tuple[int, list[int]]]] = [[] for _ in range(capacity + 1)]
    for m, content in groups:
        by_room[capacity - sum(content)].append((m, content))
    filled = np.array([bool(x) for x in by_room])
    for n in sorted((n for n, c in left.items() if c > 0), reverse=True):
        count = left[n]
        while count:
            rooms = np.flatnonzero(filled[n:])
            if len(rooms):
                room = n + int(rooms[0])
                m, content = by_room[room].pop()
                filled[room] = bool(by_room[room])
                take = min(m, count)
                if m > take:
                    by_room[room].append((m - take, content))
                    filled[room] = True
            else:
                room, content = capacity, []
                take = -(-count // (capacity // n)) if count >= capacity // n else 1
            fits = min(room // n, max(1, count // take))
            by_room[room - fits * n].append((take, content + [n] * fits))
            filled[room - fits * n] = True
            count -= take * fits
            if count < 0:                        # the last new sequence is not full
                m, full = by_room[room - fits * n].pop()
                filled[room - fits * n] = bool(by_room[room - fits * n])
                if m > 1:
                    by_room[room - fits * n].append((m - 1, full))
                    filled[room - fits * n] = True
                by_room[room - (fits + count) * n].append((1, content + [n] * (fits + count)))
                filled[room - (fits + count) * n] = True
                count = 0
    return [g for room in by_room for g in room]


def _slots(groups: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """The plan as sorted arrays: from which rank of a length on which sequences take it, and where."""
    rows, rank, sequence = [], {}, 0
    for m, content in groups:
        at = 0
        for n in dict.fromkeys(content):
            k = content.count(n)
            rows.append((n << _RANK_BITS | rank.get(n, 0), sequence, k, at))
            rank[n] = rank.get(n, 0) + m * k
            at += n * k
        sequence += m
    rows.sort()
    names = ("key", "sequence", "per", "at")
    return dict(zip(names, np.array(rows, np.int64).reshape(-1, 4).T))


def _place(plan) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        for batch in batches:
            n = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            key = (n << _RANK_BITS) | rank
            i = np.searchsorted(p["key"], key, "right") - 1
            r = key - p["key"][i]
            keep = [c for c in batch.schema.names if c not in ("rank", "salt")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [
                    pa.array(p["sequence"][i] + r // p["per"][i]),
                    pa.array(p["at"][i] + r % p["per"][i] * n)],
                keep + ["sequence_id", "offset"])
    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with ``length``) with ``sequence_id`` and ``offset``.  Reads them three times."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = spark.sparkContext.broadcast(_slots(plan_sequences(histogram, capacity)))
    salts = F.pmod(F.xxhash64("doc_id", "piece"), F.col("groups"))
    # as an Arrow table: rows from a list would start Python workers of another kind, which stay beside ours
    sizes = spark.createDataFrame(pa.table({
        "length": pa.array(list(histogram), pa.int64()),
        "groups": pa.array([-(-c // RANK_GROUP) for c in histogram.values()], pa.int64())}))
    salted = pieces.join(F.broadcast(sizes), "length").withColumn("salt", salts).drop("groups")
    counts = salted.groupBy("length", "salt").count()
    before = counts.withColumn("before", F.sum("count").over(
        Window.partitionBy("length").orderBy("salt")) - F.col("count")).drop("count")
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece"))
    ranked = salted.withColumn("inside", inside).join(before, ["length", "salt"]).withColumn(
        "rank", F.col("before") + F.col("inside") - 1).drop("before", "inside", "salt")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.drop("rank").schema)
    return ranked.mapInArrow(_place(plan), fields + ", sequence_id long, offset long")


def packed_documents(docs: DataFrame, tokenizer_path: str, *, doc_id: str = "doc_id",
                     text: str = "text", capacity: int = CAPACITY,
                     end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Tokenize once (stored in the shared folder), then pack."""
    return pack(cut(token_pieces(docs, tokenizer_path, doc_id=doc_id, text=text, capacity=capacity,
                                 end_id=end_id, keep_ids=keep_ids)), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence with its ids in order; ``packed`` must have ``ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
        .alias("ids"))
