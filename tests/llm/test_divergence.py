"""The divergence audit against counted terms in exact integers."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from creatorlens.llm import divergence

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_docs, top):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
        words = [w.translate(LOWER) for w in words]
        groups[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang in docs.keys() | {k[0] for k in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        of = {s: c for (x, s), c in groups.items() if x == lang}
        whole = sum(of.values(), Counter())

        def p(c, t):
            return 1 + 10**9 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept))

        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, c in of.items():
            pairs = [(-sum(f(p(c, t), p(d, t)) for t in kept), o) for o, d in of.items() if o != s]
            terms = [(-f(p(c, t), p(whole, t)), t) for t in kept if c[t] and p(c, t) > p(whole, t)]
            for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


def corpus():
    rng = random.Random(8)
    words = ["wort", "été", "Über", "a", "Zed's", "x1y", "ß", "end.", "no-one", "ÉTÉ"] + [f"w{'abcdefghij'[i % 10]}{'klmnop'[i % 6]}" for i in range(40)]
    rows = []
    for i in range(260):
        lang = rng.choice(["en", "en", "en", "fr", None, ""])
        source = rng.choice(["hot", "hot", "hot", *(f"s{k}" for k in range(9)), None])
        rows.append((lang, source, " ".join(rng.choice(words[: rng.randint(1, len(words))]) for _ in range(rng.randint(0, 40)))))
    return rows + [("xx", "alone", "one two"), ("de", "a", None), ("de", "b", ""), ("de", "b", ""), ("en", "none", "12 34"), ("en", "hot", "deep " * 400000 + "y" * 3000000)]


@pytest.mark.parametrize("min_docs,tile", [(10, 128), (3, 2)])
def test_audit_by_brute_force(spark, monkeypatch, min_docs, tile):
    monkeypatch.setattr(divergence, "BLOCK_BITS", 3)
    rows = corpus()
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({"n": F.lit("clash"), "term": F.lit(1), "tile": F.lit("t")})
    got = divergence.audit(docs.repartition(7), min_docs, 10, tile).collect()
    assert sorted(map(tuple, got)) == brute(rows, min_docs, 10)


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_columns_of_runs():
    rng = np.random.default_rng(3)
    for length in (0, 1, 7, 60):
        dense = [rng.integers(0, 3, length) for _ in range(2)]
        encoded = [divergence.runs(np.flatnonzero(c), c[np.flatnonzero(c)], length) for c in dense]
        for column, (ends, counts) in zip(dense, encoded):
            assert np.repeat(counts, np.diff(ends, prepend=0)).tolist() == column.tolist()
            assert not (np.diff(counts) == 0).any()  # runs are as long as can be
        shares = [(e, divergence.shares(c + 2, 9)) for e, c in encoded]
        p, q = (divergence.shares(c + 2, 9) for c in dense)
        assert divergence.common_sum(*shares) == int(((p - q) ** 2 // (p + q)).sum())


def test_equal_counts_are_neighbours(spark):
    """Terms with the same counts in all sources make one run, however many there are."""
    texts = [("en", s, " ".join(f"{kind}{'abcdefghij'[i]}" for kind, n in (("low", n), ("mid", 2 * n), ("top", 3)) for i in range(10) for _ in range(n)))
             for s, n in (("a", 1), ("b", 2), ("c", 5)) for _ in range(4)]
    found = divergence.Audit(spark.createDataFrame(texts, "lang string, source string, text string").coalesce(1), 10)
    rows = found.entries.coalesce(1).orderBy("source", "at").collect()
    for source in "abc":
        counts = [r.n for r in rows if r.source == source]
        assert sum(a != b for a, b in zip(counts, counts[1:])) <= 2


def test_share_is_exact(spark):
    pairs = [(2, 7), (10**12 + 1, 9 * 10**15 - 1), (9 * 10**15 - 1, 9 * 10**15 - 1), (123456789, 987654321)]
    want = [1 + 10**9 * a // b for a, b in pairs]
    frame = spark.createDataFrame(pairs, "a long, b long")
    assert [r[0] for r in frame.select(divergence.share(F.col("a"), F.col("b"))).collect()] == want
    assert [int(divergence.shares(np.array([a]), b)[0]) for a, b in pairs] == want
