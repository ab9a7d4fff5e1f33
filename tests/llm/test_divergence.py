import re
from collections import Counter
from fractions import Fraction
from math import floor

import duckdb
import pytest

from tallyframe.llm import divergence as D

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def brute(docs, least=30, top=50):
    """Dense: every term of a language in every group."""
    docs = [tuple(x or "" for x in d) for d in docs]
    words = [[re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)] for t, _, _ in docs]
    found: dict = {}
    for w, (_, lang, _) in zip(words, docs, strict=True):
        found.setdefault(lang, Counter()).update(set(w))
    kept = {lang: {t for t, n in c.items() if n >= least} for lang, c in found.items()}
    n: dict = {}
    for w, (_, lang, source) in zip(words, docs, strict=True):
        for key in ((lang, source), lang):
            n.setdefault(key, Counter()).update(t for t in w if t in kept[lang])
    out = []
    for lang, terms in kept.items():
        share = lambda c: {t: 1 + floor(Fraction(10**9 * (c[t] + 5), sum(c.values()) + 5 * len(terms))) for t in terms}  # noqa: B023, E731
        sources = sorted({s for _, x, s in docs if x == lang})
        p, q = {s: share(n[lang, s]) for s in sources}, share(n[lang])
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in terms), o.encode(), o) for o in sources if o != s]
            over = [(q[t] - p[s][t], t.encode(), t) for t in terms if n[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o, -v, r) for r, (v, _, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", t, -v, r) for r, (v, _, t) in enumerate(sorted(over)[:top], 1)]
    return sorted(out)


@pytest.fixture
def docs():
    # ties everywhere: words of equal counts, a source without kept terms, one that holds most rows, nulls
    out = [(" ".join(f"Word{chr(97 + k % 7)}é{chr(97 + i % 3)} tail_{chr(97 + k % 5)}" for k in range(i % 11)), "en", "big") for i in range(60)]
    out += [(f"worda{chr(98 + i % 20)} Éa éa common x" + " zz" * (i % 3), "en", f"s{i % 3}") for i in range(60)]
    return out + [("rare only here", "en", "bare"), (None, "en", None), ("", None, "s1"), ("a common x", None, None), ("hello", "fr", "s0"), ("common x " * 3000, "en", "s0")]


def result(spark, docs, **kw):
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "text string, lang string, source string, item string, n int").repartition(3)
    return sorted(tuple(r[c] for c in COLUMNS) for r in D.audit(df, **kw).collect())


def test_whole_audit_equals_the_dense_one(spark, docs):
    assert result(spark, docs) == brute(docs)
    assert result(spark, docs, least=1, top=7) == brute(docs, 1, 7)


def test_flushes_and_shuffled_groups_give_the_same(spark, docs, monkeypatch):
    monkeypatch.setattr(D, "HELD", 3)
    monkeypatch.setattr(D, "SMALL", 0)
    assert result(spark, docs, least=2, top=5) == brute(docs, 2, 5)


def test_no_kept_terms_and_no_rows(spark):
    few = [("a b", "en", "x"), ("c", "en", "y"), (None, "en", "x")]
    assert result(spark, few) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
    assert result(spark, []) == []


def test_selection_refines_ties_by_bytes(spark):
    rows = [("g", "s", f"{'same' * 9}{c}{d}", 5) for c in "ab" for d in ["", *"zyxéA"]] + [("g", "s", "first", 6), ("g", "t", "one", 0), ("g", "t", "two", 2**32 - 1)]
    got = {(r.source, r.item) for r in D.first_of(spark.createDataFrame(rows, "lang string, source string, item string, value bigint"), 5).collect()}
    want = sorted((r for r in rows if r[1] == "s"), key=lambda r: (-r[3], r[2].encode()))[:5]
    assert got == {("s", r[2]) for r in want} | {("t", "one"), ("t", "two")}


def test_share_is_exact_for_large_counts(spark):
    n, every, v = 3 * 10**17 + 1, 9 * 10**17 + 7, 123_457
    row = spark.range(1).select(D.share(*(D.F.lit(x) for x in (n, every, v))).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 5) // (every + 5 * v)


def test_sql_is_the_dense_one_too(docs):
    import pandas as pd

    documents = pd.DataFrame(docs, columns=["text", "lang", "source"])  # noqa: F841
    assert sorted(duckdb.sql(D.OP11_SQL).fetchall()) == brute(docs)
