"""Automaton against edit distance, features against plain code, accuracy on held-out rows."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import make_docs, sf_of  # noqa: F401
from pyspark.sql import functions as F

from stepfall.llm import toxicity as T

TERMS = {"stupid": 3.0, "idiot": 2.5, "scum": 4.0, "worthless": 5.0, "blödmann": 2.6}
STEMS = {"lowei": 4.5}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def plain_match(word):
    exact = max([w for t, w in TERMS.items() if t == word]
                + [w for t, w in STEMS.items() if word.startswith(t)], default=0.0)
    if exact:
        return exact, False
    near = max([w for t, w in TERMS.items() if len(t) >= 5 and distance(t, word) <= 1], default=0.0)
    return near, near > 0


def edited():
    def edit(args):
        word, at, kind, c = args
        at %= len(word) + 1
        return word[:at] + (c if kind != 2 else "") + word[at + (kind > 0):]
    return st.tuples(st.sampled_from([*TERMS, *STEMS]), st.integers(0, 20), st.integers(0, 2),
                     st.sampled_from("abidö")).map(edit)


@settings(max_examples=300, deadline=None)
@given(st.one_of(edited(), edited().map(lambda w: w + "s"), st.text("stupidm", max_size=8)))
def test_automaton_against_edit_distance(word):
    model = T.Model(list(TERMS.items()), list(STEMS.items()), [0.0] * T.FEATURES)
    assert model.trie().match(word) == plain_match(word)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(edited(), st.text("abc é", max_size=5)), max_size=12))
def test_filter_loses_no_match(words):
    finder = T.Finder(T.Model(list(TERMS.items()), list(STEMS.items()), [0.0] * T.FEATURES))
    raw = " ".join(words).encode()
    begin, end, first = T.words_of(raw, np.array([0, len(raw)]))
    found = [raw[a:b].decode() for a, b in zip(begin, end)]
    assert finder.hits(raw, begin, end) == [
        (i, *plain_match(w)) for i, w in enumerate(found) if plain_match(w)[0] and len(w.encode()) > 2]


def test_words_and_quotation():
    raw = "he said “stupid” and «idiot» x.\n\"you scum\" - worthless".encode()
    begin, end, first = T.words_of(raw, np.array([0, 10, len(raw)]))
    words = [raw[a:b].decode() for a, b in zip(begin, end)]
    assert words == ["he", "said", "stupid", "and", "idiot", "x", "you", "scum", "worthless"]
    assert first.tolist() == [0, 2, 9]
    quoted = [T._quoted(raw, 0, int(a)) for a in begin]
    assert quoted == [False, False, True, False, True, False, True, True, False]


def test_quotations_of_any_length():
    far = " and so on" * 60
    cases = [
        (f'she said "{far} stupid" and more', True), (f'she said "{far}" and stupid', False),
        (f'"one{far}" then "two{far}" then stupid', False), (f'"one\ntwo stupid" x', True),
        (f'"one\ntwo" stupid', False), (f"“a “b{far}” stupid” c", True), (f"„a{far}“ stupid", False),
        (f"„a{far} stupid“", True), (f"home » news » more «a{far} stupid» x", True),
        (f"«a\n{far}» stupid", False), ("stray ” here “a stupid” x", True)]
    for text, want in cases:
        before = 'not " closed '.encode()                      # the text ahead tells nothing
        raw = before + text.encode()
        assert T._quoted(raw, len(before), raw.index(b"stupid")) == want, text
        x = T.features(T.Finder(T.Model([("stupid", 3.0)], [], [0.0] * T.FEATURES)), raw,
                       np.array([0, len(before), len(raw)]))
        assert (x[1, 3] > 0) == want and (x[1, 1] > 0) != want, text


@pytest.mark.parametrize("text,want", [
    ("c'est l'stupid du village", False), ("il a dit 'stupid' hier", True), ("qu\u2019il est stupid", False),
    ("d\u2018stupid", False), ("a 5\" pipe and the stupid one", False), ("a 5\" pipe and \"the stupid\" one", True),
    ("ein 19\" Schirm, du stupid", False), ("er sagte \u201aja\u2018 und stupid", False), ("er rief: \"stupid!\"", True),
    ("sie rief \u201edu stupid\u201c", True), ("el dijo \"hola y\n\nstupid", False), ("\u00abstupid\u00bb dijo", True),
    ("un tubo de 3\" y un stupid", False), ("'stupid' dijo", True), ("(\"stupid\")", True),
    ("il dit \"oui\" et stupid", False), ("\"a\n\n\"b stupid\" c", True), ("don't be 'that' stupid", False)])
def test_apostrophes_and_inch_marks(text, want):
    raw = text.encode()
    assert T._quoted(raw, 0, raw.index(b"stupid")) == want


def test_context_changes_features():
    finder = T.Finder(T.Model(list(TERMS.items()), [], [0.0] * T.FEATURES))
    texts = ["stupid idiot", "stupid " + "a " * 30 + "idiot", 'she wrote "stupid idiot"', "stupld", ""]
    raw = "".join(texts).encode()
    x = T.features(finder, raw, np.cumsum([0] + [len(t.encode()) for t in texts]))
    assert x[0, 4] > x[1, 4] and x[0, 1] == x[1, 1] > 0        # near each other or far
    assert x[2, 3] > 0 and x[2, 1] == 0                        # quoted
    assert x[3, 2] > 0 and x[3, 1] == 0 and not x[4, 1:].any()


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("bcdfgklmnr") + rng.choice("aeou") for _ in range(3))
    vocabulary = [word() for _ in range(300)]
    bad = ["stupid", "idiot", "worthless", "disgusting"]
    docs, labels = [], []
    for i in range(1500):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(rng.randint(1, 3)):
                w = rng.choice(bad)
                if rng.random() < 0.2:
                    w = w[:3] + "*" * 0 + w[4:]
                words.insert(rng.randrange(len(words)), w)
        docs.append((i, " ".join(words)))
        if i % 10:
            labels.append((i, int(toxic)))
    return docs + [(5000, None), (5001, ""), (None, "stupid idiot"), (7, docs[7][1])], labels


def test_rare_long_and_stemmed_terms_are_kept(spark):
    rng = random.Random(8)
    rare = sorted({"".join(rng.choice("bcdfgklmnr") + rng.choice("aeou") for _ in range(4))
                   for _ in range(600)})
    long, forms = "x" * 70 + "y", [f"vermin{c}" for c in "abcdef"]
    bad = [f"so {rare[i % len(rare)]} they say" for i in range(3 * len(rare))]
    bad += [f"a {long} here"] * 3 + [f"such {w} there" for w in forms * 3]
    rows = [(t, 1) for t in bad] + [("so a here there they say such", 0)] * 6000
    terms, stems = T.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert {*rare, long, *forms} <= {w for w, _ in terms} and "verm" in dict(stems)
    finder = T.Finder(T.Model(terms, stems, [0.0] * T.FEATURES))
    words = [rare[0], long, long[1:], "vermina", "xermina"]
    raw = " ".join(words).encode()
    begin, end, _ = T.words_of(raw, np.array([0, len(raw)]))
    assert [(k, m) for k, _, m in finder.hits(raw, begin, end)] == [
        (0, False), (1, False), (2, True), (3, False), (4, True)]


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, toxic int").withColumn("quality", F.lit(1))


def test_held_out_accuracy_and_query(spark, make_docs, sf_of, corpus):  # noqa: F811
    from stepfall.llm import queries
    docs, labels = corpus
    root = sf_of(documents=make_docs(docs), labels=labels_of(
        spark, labels + [(5000, None), (None, 1), (123456, 1)]))
    got = queries.QUERIES["op5_toxicity"](spark, root).collect()
    assert len(got) == len(docs)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 200
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    by = {r.doc_id: r for r in got}
    assert by[5000].score == by[5001].score < 0.5 and not by[None].held_out
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_labels_of_the_held_out_fold_teach_nothing(spark, make_docs, corpus):  # noqa: F811
    docs, labels = corpus
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    table = make_docs(docs)
    held = {r.doc_id for r in table.filter(fold == 0).collect()}
    flipped = [(d, 1 - y if d in held else y) for d, y in labels]
    assert flipped != labels
    assert T.train(table, labels_of(spark, labels), teaches=fold != 0) == T.train(
        table, labels_of(spark, flipped), teaches=fold != 0)


def test_no_labels_and_empty(spark, make_docs, corpus):  # noqa: F811
    docs = make_docs(corpus[0][:20])
    none = T.train(docs, labels_of(spark, []))
    assert all(r.score < 1e-5 for r in T.scored(docs, none).collect())
    ones = T.train(docs, labels_of(spark, [(1, 1), (2, 1)]))
    assert all(r.score > 0.99 for r in T.scored(docs, ones).collect())
    assert T.scored(docs.limit(0), none).count() == 0


def test_dropping_keeps_columns(spark, make_docs):  # noqa: F811
    model = T.Model(list(TERMS.items()), [], [-3.0, 6.0, 4.0, 1.0, 0.0, 0.0])
    docs = make_docs([(1, "stupid idiot"), (2, "fine"), (3, None)]).withColumn("score", F.lit("s"))
    kept = T.drop_toxic(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]


def test_scoring_needs_little_memory_beside_the_texts():
    """Python workers share an executor's memory with its JVM; what a slice needs does not follow the batch."""
    import tracemalloc

    import pyarrow as pa
    text = "some words, stupid or not, that fill a text up to its end " * 40
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(1000), pa.int64()), pa.array([text] * 1000)], names=["doc_id", "text"])
    run = T._scores(T.Model(list(TERMS.items()), list(STEMS.items()), [0.1] * T.FEATURES))
    tracemalloc.start()
    try:
        scores = [x for out in run(iter([batch])) for x in out.column("score").to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(set(scores)) == 1 and len(scores) == 1000
    assert peak < 24 << 20
