"""Divergence of sources against plain integer arithmetic, and its edge cases."""

import random
import re
from collections import Counter, defaultdict

import pytest
from check_oracle import compare, oracle_connection

from stepfall.llm import divergence, queries

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string"


def brute(rows, least=30, top=50):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in ((t or "", la or "", s or "") for t, la, s in rows):
        terms = TERM.findall(text.translate(LOWER))
        groups.add((lang, source))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        v, mine = len(kept), [s for la, s in groups if la == lang]
        whole = Counter()
        for s in mine:
            whole.update({t: counts[lang, s][t] for t in kept})

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + (10**9 * (c[t] + 5)) // (n + 5 * v) for t in kept}
        p, q = shares(counts[lang, source]), shares(whole)
        pairs = [(s, sum(abs(p[t] - x) for t, x in shares(counts[lang, s]).items())) for s in mine if s != source]
        terms = [(t, p[t] - q[t]) for t in kept if counts[lang, source][t] > 0 and p[t] > q[t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, top)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, f, i + 1) for i, (item, f) in enumerate(items[:most])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    vocabulary = [f"W{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150)] + ["\xc9t\xe9", "\xe9t\xe9", "x\U0001f600"]
    out = [(None, None, None), ("", "en", "empty"), (None, "en", None), ("solo", "xx", "a"), ("", "xx", "b"),
           ("1 2 -", "yy", "only")]
    for i in range(400):
        lang, source = rng.choice(["en", "de"]), rng.choice(["a", "b", "c", "\xfc", None])
        words = rng.choices(vocabulary, [1 + 40 // (1 + k + len(source or "")) for k in range(len(vocabulary))],
                            k=rng.randrange(30))
        out.append((rng.choice(" ,_3").join(words), lang, source))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], SCHEMA)


def result(df):
    return sorted(map(tuple, df.collect()))


def test_audit(spark, rows):
    got = divergence.audit(frame(spark, rows))
    assert [f"{n} {t}" for n, t in got.dtypes] == [
        "lang string", "source string", "part string", "item string", "value bigint", "rank int"]
    assert result(got) == brute(rows)


@pytest.mark.parametrize("bits", [0, 3, 6])
def test_collisions_are_split(spark, rows, bits):
    assert result(divergence.audit(frame(spark, rows), bits=bits)) == brute(rows)


def test_other_limits_and_small_tiles(spark, rows, monkeypatch):
    monkeypatch.setattr(divergence, "SIDE", 2)
    monkeypatch.setattr(divergence, "BUCKET", 7)
    assert result(divergence.audit(frame(spark, rows), least_docs=5, top=3)) == brute(rows, 5, 3)


def test_no_term_is_kept(spark):
    rows = [("a b", "en", "x"), ("c", "en", "y"), ("d", "en", "z")]
    assert result(divergence.audit(frame(spark, rows))) == brute(rows)
    assert {r[4] for r in brute(rows)} == {0}


def test_empty_table_and_clashing_columns(spark, rows):
    assert divergence.audit(frame(spark, [])).collect() == []
    clash = frame(spark, rows).selectExpr("*", "1 AS n", "2 AS digest", "'z' AS part", "3 AS p", "4 AS rank")
    assert result(divergence.audit(clash)) == brute(rows)


def test_large_counts_stay_exact(spark):
    big = spark.createDataFrame([(9 * 10**15, 3 * 10**16, 7)], "c long, n long, v long")
    got = big.select(divergence.share(*[big[c] for c in "cnv"]).alias("p")).first().p
    assert got == 1 + (10**9 * (9 * 10**15 + 5)) // (3 * 10**16 + 35)


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    name = "op13_source_divergence"
    assert compare(spark, oracle_connection(sf), queries.QUERIES[name], queries.SQL[name], sf) == []
