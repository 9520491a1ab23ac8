"""Personal data: base spans against the plain patterns, disguises against planted ones."""

import hashlib
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import make_docs, sf_of  # noqa: F401

from stepfall.llm import pii, queries

PLAIN = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in pattern.finditer(text):
            digits = "".join(c for c in m.group() if c in "0123456789")
            good = (True, kind == 1 and all(int(p) <= 255 for p in m.group().split(".")),
                    14 <= len(digits) <= 19 and luhn(digits), 10 <= len(digits) <= 15)[kind]
            if good:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def texts_of(text):
    return [(pii.KINDS[k], text[a:b], base) for a, k, b, base in pii.spans(text)]


def added(text):
    return [(k, x) for k, x, base in texts_of(text) if not base]


@given(st.text("ab1@.+-_ (\xe9", max_size=60))
@settings(max_examples=400, deadline=None)
def test_base_spans_of_letters(text):
    assert pii.matches(text) == plain(text)


@given(st.lists(st.sampled_from(["4111111111111111", "1", "12", "255", "256", ".", "-", " ", "+", "(", ")", "@",
                                 "a", "49 30 123456", "00"]), max_size=25).map("".join))
@settings(max_examples=400, deadline=None)
def test_base_spans_of_numbers(text):
    assert pii.matches(text) == plain(text)


@given(st.text("a1@. 9nineotoа０​[]dtplus(", max_size=60))
@settings(max_examples=300, deadline=None)
def test_base_spans_stay_and_offsets_hold(text):
    spans = pii.spans(text)
    assert [s[:3] for s in spans if s[3]] == plain(text)
    assert all(0 <= a < b <= len(text) for a, _, b, _ in spans)


def test_disguises_map_back_to_the_source():
    for text, expect in [
        ("write to jane.doe [at] example [dot] com today", ("email", "jane.doe [at] example [dot] com")),
        ("write to jane at mail dot example dot com today", ("email", "jane at mail dot example dot com")),
        ("jane_1 at example.org, please", ("email", "jane_1 at example.org")),
        ("(jane&#64;example&#46;com)", ("email", "jane&#64;example&#46;com")),
        ("an juergen (at) beispiel (punkt) de schreiben", ("email", "juergen (at) beispiel (punkt) de")),
        ("jаne@exаmple.com", ("email", "jаne@exаmple.com")),
        ("x ja​ne＠example．com y", ("email", "ja​ne＠example．com")),
        ("one nine two dot one six eight dot zero dot seven", ("ip", "one nine two dot one six eight dot zero dot seven")),
        ("host 10 dot 0 dot 0 dot 12 is up", ("ip", "10 dot 0 dot 0 dot 12")),
        ("host 10[.]0[.]0[.]12 is up", ("ip", "10[.]0[.]0[.]12")),
        ("ring plus four nine three zero one two three four five six seven now",
         ("phone", "plus four nine three zero one two three four five six seven")),
        ("ruf +49 30 eins zwei drei vier f\xfcnf sechs an", ("phone", "+49 30 eins zwei drei vier f\xfcnf sechs")),
        ("card ４１１１ 1111 1111 1111", ("card", "４１１１ 1111 1111 1111")),
        ("card four one one one 1111 1111 1111 double one eleven", None),
        ("card four one one one 1111 1111 11 double one", ("card", "four one one one 1111 1111 11 double one")),
    ]:
        assert added(text) == ([expect] if expect else []), text


def test_ordinary_text_has_no_spans():
    for text in ("meet me at noon. dot your is", "look at example.com for more", "le point de vue est bon",
                 "one of the two, at six or seven", "price at 5 dot 20", "\xe9t\xe9 \xfcber ni\xf1o 3\xb2 абв",
                 "nine at five", "call five five five", "version 1.2.3 at dot release"):
        assert pii.spans(text) == [], text


def test_spans_covered_by_base_ones_are_not_repeated():
    text = "one a@b.com 4111 1111 1111 1111 ａ"
    assert all(base for *_, base in pii.spans(text)) and len(pii.spans(text)) == 2


WORDS = ("the and of rereinsh tiwhwh onat thlystti est\xe0 \xfcber \xe9an at on point dot plus one sechs le "
         "in. were, 12 7 x2 (a) [b] 2024-01-02 3.14 100 %").split()


def disguised(rng):
    """A piece of personal data as it is, and in a disguise."""
    kind = rng.choice(["email", "ip", "phone", "card"])
    names = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
    say = lambda x: " ".join(names[int(c)] for c in x)
    look = str.maketrans("aeopc", "аеорс")
    wide = str.maketrans("0123456789", "".join(chr(0xFF10 + i) for i in range(10)))
    if kind == "email":
        name, host = f"{rng.choice(['ana', 'bob.k', 'c_d'])}{rng.randrange(90)}", f"mail{rng.randrange(9)}.example.com"
        return kind, rng.choice([
            f"{name} [at] {host.replace('.', ' [dot] ')}", f"{name} at {host.replace('.', ' dot ')}",
            f"{name}(at){host}", f"{name}@{host}".translate(look), f"{name}&#64;{host}", f"{name} at {host}"])
    if kind == "ip":
        parts = [str(rng.randrange(1, 255)) for _ in range(4)]
        return kind, rng.choice(["[.]".join(parts), " dot ".join(map(say, parts)), ".".join(parts).translate(wide)])
    if kind == "phone":
        number = "".join(str(rng.randrange(10)) for _ in range(10))
        return kind, rng.choice([f"plus one {say(number)}", f"+1 {number[:3]} {say(number[3:])}",
                                 f"+1 ({number[:3]}) {number[3:]}".translate(wide)])
    body = "".join(str(rng.randrange(10)) for _ in range(15))
    card = next(body + c for c in "0123456789" if luhn(body + c))
    return kind, rng.choice([say(card), card.translate(wide), f"{card[:12]} {say(card[12:])}"])


def test_recall_and_precision_on_planted_disguises():
    rng = random.Random(3)
    hit = planted = wrong = 0
    for _ in range(600):
        kind, secret = disguised(rng)
        head = " ".join(rng.choices(WORDS, k=40)) + " so, "
        text = head + secret + ". And " + " ".join(rng.choices(WORDS, k=40))
        got = [(k, a, b) for a, k, b, base in pii.spans(text) if not base]
        exact = (pii.KINDS.index(kind), len(head), len(head) + len(secret))
        planted += 1
        hit += exact in got
        wrong += len([g for g in got if g != exact])
    assert hit / planted > 0.97, hit
    assert wrong / planted < 0.03, wrong


def digest(text):
    base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in plain(text))
    return hashlib.sha256(base.encode()).hexdigest()


def test_query_equals_plain_patterns(spark, sf_of, make_docs):
    texts = [None, "", "a@b.co a@b.co", "\U0001f600 x@y.zz", "+1 (017) 555-7713 x", "1.2.3.4", "x" * 5000,
             "card 4111 1111 1111 1111", "jane [at] b [dot] com"]
    docs = make_docs([(i, t) for i, t in enumerate(texts)] + [(None, "1.2.3.4"), (3, "1.2.3.4"), (3, "1.2.3.4")])
    got = queries.QUERIES["op12_personal_data"](spark, sf_of(documents=docs))
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    expect = []
    for r in docs.collect():
        text = r.text or ""
        kinds = [k for _, k, _ in plain(text)]
        expect.append((r.doc_id, *[kinds.count(k) for k in range(4)], digest(text),
                       ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b, _ in pii.spans(text))))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expect, key=repr)


def test_query_on_given_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.QUERIES["op12_personal_data"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(rows) == 1000
    for r in rows:
        assert got[r.doc_id].base_sha256 == digest(r.text or "")
    assert sum(r.n_email for r in got.values()) > 0


def test_redacted_keeps_other_columns(spark):
    rows = spark.createDataFrame([("a@b.co", "1 a@b.co, 1.2.3.4 \xfc", "k"), ("x", None, "l")],
                                 "_row string, text string, _clean string")
    assert [tuple(r) for r in pii.redacted(rows).collect()] == [
        ("a@b.co", "1 [EMAIL], [IP] \xfc", "k"), ("x", None, "l")]


def test_empty_table(make_docs):
    assert pii.found(make_docs([])).collect() == []


@pytest.mark.parametrize("text", ["a" * 400_000, "1" * 400_000, "+1" * 200_000, "a dot " * 60_000, "@" * 400_000,
                                  "one " * 90_000, "(at)" * 90_000, "a@" * 150_000, "1." * 200_000, " " * 400_000])
def test_time_is_about_linear(text):
    begin = time.perf_counter()
    pii.spans(text)
    assert time.perf_counter() - begin < 10
