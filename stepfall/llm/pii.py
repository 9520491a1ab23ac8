"""Find personal data, also in disguise, and give its place in the text as written.

Patterns find email addresses, IP addresses, card numbers and phone numbers in the text as it is (base
spans).  Then transducers rewrite the text, each reading the one before:

1. ``LOOKALIKES``: invisible characters go; letters, digits and signs that look like ASCII ones become those;
2. ``SPELLED``: names of digits (en, de, fr, es, "double", "triple") become digits;
3. ``SIGNS``: dots, at-signs and plus-signs in brackets, as entities or as words become signs.

A transducer emits its output with the stretch of input behind each piece, so any stretch of the last
text maps back through all of them to characters of the source.  The same patterns run on the
rewritten text; what they find there across at least one rewritten piece is added, unless a base
span of its kind covers it.  Base spans always stay.

A word "at" counts only where the domain's dot is disguised too or the name before holds a digit or
a sign; a word "dot" only between numbers or before at most ``LABELS`` labels that end in one of
``ENDINGS``.  So "meet at noon" and "point of view" stay words.

Spans count code points, the end excluded.  Cases: null and empty texts have no spans; repeated rows
get equal results; texts of any length are read whole, in time about linear to their length; an empty
table gives no rows; further columns are ignored by ``found`` and kept by ``redacted``.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# Base patterns.  An address is looked for from its at-sign; numbers from their first digit.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
IP_MOST = 255
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
CARD_DIGITS = (14, 19)
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
PHONE_DIGITS = (10, 15)
NAME_STEP = 256              # characters looked at together, backwards from an at-sign

# Letters of other scripts by the ASCII letter they look like.
LETTERS = {
    "A": "ΑА", "B": "ΒВ", "C": "СϹ", "E": "ΕЕ", "H": "ΗН",
    "I": "ΙІ", "J": "Ј", "K": "ΚК", "M": "ΜМ", "N": "Ν",
    "O": "ΟО", "P": "ΡР", "S": "Ѕ", "T": "ΤТ", "X": "ΧХ",
    "Y": "ΥҮ", "Z": "Ζ", "a": "αа", "c": "сϲ", "d": "ԁ",
    "e": "е", "g": "ɡ", "h": "һ", "i": "іıι", "j": "ј", "k": "кκ",
    "l": "ӏ", "m": "м", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ",
    "s": "ѕ", "t": "т", "u": "ս", "v": "νѵ", "w": "ԝ", "x": "хχ",
    "y": "уү", "-": "‐‑‒–—―−", ".": "。۔․",
}
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff\u034f\u061c\u180e"
# Names of digits in the languages of the corpus.
DIGITS = {
    "0": "zero null zéro cero", "1": "one eins un uno", "2": "two zwei zwo deux dos", "3": "three drei trois tres",
    "4": "four vier quatre cuatro", "5": "five fünf cinq cinco", "6": "six sechs seis",
    "7": "seven sieben sept siete", "8": "eight acht huit ocho", "9": "nine neun neuf nueve",
}
TIMES = {"double": 2, "triple": 3}
AT = "at|arroba|arobase|klammeraffe"
DOT = "dot|punkt|point|punto"
ENDINGS = "com|org|net|edu|gov|mil|int|io|co|info|biz|dev|app|eu|uk|de|fr|es|nl|ch|au|jp|example"
LABELS = 4

_SIGN_OF = {x: k for k, xs in LETTERS.items() for x in xs} | dict.fromkeys(INVISIBLE, "")
_VALUE = {name: d for d, names in DIGITS.items() for name in names.split()}
_NAMES = "|".join(sorted(_VALUE, key=len, reverse=True))
_NAME = rf"(?:{_NAMES})(?!\w)"

# Accented Latin letters stand for themselves.
_FOREIGN = re.compile("[^\\x00-\\x7fÀ-İĲ-ɏ]")
# A name of a digit; the gap after it goes where another name follows.
_SPELLED = re.compile(
    rf"(?i)(?<!\w)(?:(?P<times>{'|'.join(TIMES)})[\x20-](?=(?:{_NAME})|[0-9](?!\w)))?"
    rf"(?:(?P<name>{_NAME})|(?P<digit>(?<=[\x20-])[0-9](?!\w)))(?P<gap>[\x20-](?={_NAME}|(?:{'|'.join(TIMES)})[\x20-]))?")
_CHAIN = rf"(?:[A-Za-z0-9-]{{1,63}}(?:\s{{1,3}}(?:{DOT})\s{{1,3}}|\s?[(\[{{]\s?(?:{DOT}|\.)\s?[)\]}}]\s?|\.))"
_SIGNS = re.compile(
    rf"(?i)(?P<at>\s{{0,3}}[(\[{{<]\s?(?:{AT}|@)\s?[)\]}}>]\s{{0,3}}|&(?:\#64|\#x40|commat);"
    rf"|(?<=[A-Za-z0-9])\s{{1,3}}(?:{AT})\s{{1,3}}(?={_CHAIN}{{1,{LABELS}}}(?:{ENDINGS})(?!\w)))"
    rf"|(?P<dot>\s{{0,3}}[(\[{{<]\s?(?:{DOT}|\.)\s?[)\]}}>]\s{{0,3}}|&(?:\#46|\#x2e|period);"
    rf"|(?<=[0-9])\s{{1,3}}(?:{DOT})\s{{1,3}}(?=[0-9])"
    rf"|(?<=[A-Za-z0-9])\s{{1,3}}(?:{DOT})\s{{1,3}}(?={_CHAIN}{{0,{LABELS}}}(?:{ENDINGS})(?!\w)))"
    rf"|(?P<plus>(?<!\w)plus\s(?=[0-9]{{1,4}}[\x20(]|[0-9]{{1,3}}-|[0-9]{{10,15}}(?!\w))|[(\[{{]\s?(?:plus|\+)\s?[)\]}}]\s?(?=[0-9])|&(?:\#43|plus);)")

SPAN = "array<struct<kind: string, start: bigint, end: bigint, base: boolean>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                 ("base", pa.bool_())]))


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    odd = sum(map(int, digits[-1::-2]))
    even = sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def _name_start(text: str, at: int, least: int) -> int:
    """Where the run of name characters that ends before ``at`` begins, not before ``least``."""
    start = at
    while start > least:
        piece = text[max(least, start - NAME_STEP):start]
        m = LOCAL.search(piece)
        if m is None:
            break
        start -= len(piece) - m.start()
        if m.start() > 0:
            break
    return start


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        if domain is not None:
            start = _name_start(text, at, done)
            if start < at:
                done = domain.end()
                yield start, done
        at = text.find("@", max(at + 1, done))


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def matches(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of everything the patterns find, in order."""
    out = [(a, 0, b) for a, b in emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text)
            if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= IP_MOST for x in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= CARD_DIGITS[0]:
            d = _digits(m.group())
            if CARD_DIGITS[0] <= len(d) <= CARD_DIGITS[1] and luhn(d):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text)
                if PHONE_DIGITS[0] <= len(_digits(m.group())) <= PHONE_DIGITS[1]]
    return sorted(out)


class Rewritten:
    """A transducer's output: its text, and for every changed piece the stretch of input behind it."""

    def __init__(self, text: str, pattern: re.Pattern, emit: Callable[[re.Match], str | None]) -> None:
        out, size, read = [], 0, 0
        self.low: list[int] = []         # begin of each changed piece in the output
        self.high: list[int] = []
        self.source: list[tuple[int, int]] = []
        for m in pattern.finditer(text):
            piece = emit(m)
            if piece is None:
                continue
            out += (text[read:m.start()], piece)
            size += m.start() - read
            self.low.append(size)
            size += len(piece)
            self.high.append(size)
            self.source.append(m.span())
            read = m.end()
        self.text = "".join([*out, text[read:]]) if self.low else text

    def changed(self, start: int, end: int) -> bool:
        """Whether a changed piece lies in, or a removed one within, [start, end) of the output."""
        i = bisect_right(self.high, start)
        return i < len(self.low) and self.low[i] < end

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The input's stretch behind [start, end) of the output."""
        return self._of(start)[0], self._of(end - 1)[1]

    def _of(self, at: int) -> tuple[int, int]:
        i = bisect_right(self.low, at) - 1
        if i < 0:
            return at, at + 1
        if at < self.high[i]:
            return self.source[i]
        shift = self.source[i][1] - self.high[i]
        return at + shift, at + shift + 1


@functools.lru_cache(maxsize=4096)
def lookalike(c: str) -> str | None:
    """The ASCII character that ``c`` looks like, '' where it is invisible, None if it stands for itself."""
    if c in _SIGN_OF:
        return _SIGN_OF[c]
    digit = unicodedata.decimal(c, None)
    if digit is not None:
        return str(digit)
    plain = unicodedata.normalize("NFKC", c)
    return plain if len(plain) == 1 and plain.isascii() else None


def _spelled(m: re.Match) -> str | None:
    if m["name"] is None and m["times"] is None:
        return None
    digit = _VALUE[m["name"].lower()] if m["name"] else m["digit"]
    return digit * TIMES.get((m["times"] or "").lower(), 1)


def _sign(m: re.Match) -> str | None:
    if m["at"] is not None:
        word = m["at"].strip()
        if word[0] not in "([{<&" and not _plausible(m):
            return None
        return "@"
    return "." if m["dot"] is not None else "+"


def _plausible(m: re.Match) -> bool:
    """A bare "at": the domain's dot is in words, or the name before looks like one of an account."""
    name = LOCAL.search(m.string, max(0, m.start() - 64), m.start())
    rest = m.string[m.end():m.end() + 80]
    return bool(name and re.search(r"[0-9._+-]", name.group())) or re.match(
        rf"(?i)[A-Za-z0-9-]+\s?[\s(\[{{]\s?(?:{DOT})\b", rest) is not None


TRANSDUCERS = ((_FOREIGN, lambda m: lookalike(m.group())), (_SPELLED, _spelled), (_SIGNS, _sign))


def spans(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, whether a base span) of one text, in order."""
    base = matches(text)
    steps, last = [], text
    for pattern, emit in TRANSDUCERS:
        if pattern is _FOREIGN and last.isascii():
            continue
        step = Rewritten(last, pattern, emit)
        if step.low:
            steps.append(step)
            last = step.text
    added = set()
    if steps:
        known = [[(a, b) for a, k, b in base if k == kind] for kind in range(len(KINDS))]
        for start, kind, end in matches(last):
            a, b, changed = start, end, False
            for step in reversed(steps):
                changed |= step.changed(a, b)
                a, b = step.back(a, b)
            if not changed:
                continue
            i = bisect_right(known[kind], (a, len(text) + 1)) - 1
            if i < 0 or known[kind][i][1] < b:
                added.add((a, kind, b, False))
    return sorted([(a, k, b, True) for a, k, b in base] + list(added))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [[{"kind": KINDS[k], "start": a, "end": b, "base": base}
                for a, k, b, base in spans(t.as_py() or "")] for t in batch.column("_text")]
        yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(out, _SPAN_TYPE)],
                                         names=["_row", "_spans"])


def _redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for t in batch.column("_text"):
            text = t.as_py()
            out.append(text if text is None else without(text, spans(text)))
        yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(out, pa.string())],
                                         names=["_row", "_clean"])


def without(text: str, found: list[tuple[int, int, int, bool]]) -> str:
    """The text with every span replaced by its kind; spans that overlap become one, named by the first."""
    out, done = [], 0
    for a, kind, b, _ in found:
        if a < done:
            done = max(done, b)
            continue
        out += (text[done:a], f"[{KINDS[kind].upper()}]")
        done = b
    return "".join([*out, text[done:]])


def found(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, spans`` per document: (kind, start, end, base) by start, then kind as listed."""
    rows = docs.select(F.struct(F.col(f"`{doc_id}`").cast("long").alias("doc_id")).alias("_row"),
                       F.col(f"`{text}`").cast("string").alias("_text"))
    return rows.mapInArrow(_found, f"_row struct<doc_id: bigint>, _spans {SPAN}").select(
        "_row.doc_id", F.col("_spans").alias("spans"))


def redacted(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """All columns of ``docs``, spans in the text replaced."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                       F.col(f"`{text}`").cast("string").alias("_text"))
    clean = rows.mapInArrow(_redacted, f"_row {rows.schema['_row'].dataType.simpleString()}, _clean string")
    return clean.select(*[(F.col("_clean") if c == text else F.col("_row").getField(c)).alias(c)
                          for c in docs.columns])


def listed(found_spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(found_spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
