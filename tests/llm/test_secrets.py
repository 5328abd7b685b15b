"""The randomness battery: each statistic by brute force, and secrets planted among slugs."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from creatorlens.llm import common, secrets

LETTERS = "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = {
    "base64": LETTERS.upper() + LETTERS + "0123456789+/",
    "upper hex": "0123456789ABCDEF",
    "base32": LETTERS.upper() + "234567",
    "lower": LETTERS,
}


@pytest.fixture(scope="module")
def words(spark, sf):
    texts = [r.text for r in common.table(spark, sf, "documents").where("text is not null").select("text").collect()]
    return sorted({w.lower() for t in texts for w in t.split() if w.isascii() and w.isalpha() and len(w) > 1})


def slug(rng, words):
    parts, sep, style = [], rng.choice("-_/-"), rng.random()
    while len(sep.join(parts)) < rng.randint(20, 48):
        parts.append(rng.choice(words) if rng.random() < 0.9 else str(rng.randrange(2030)))
    if style < 0.15:
        parts = [p.capitalize() for p in parts]
    if style > 0.95:
        parts = [p.upper() for p in parts]
    return ("" if style < 0.07 else sep).join(parts)


def planted(rng, words, n_slugs, n_secrets, lengths):
    rows = [(i, f"see {slug(rng, words)} here") for i in range(n_slugs)]
    kinds = list(ALPHABETS)
    for j in range(n_secrets):
        token = "".join(rng.choice(ALPHABETS[kinds[j % 4]]) for _ in range(lengths[j % len(lengths)]))
        rows.append((n_slugs + j, f"see {token} here"))
    return rows


@pytest.mark.parametrize("seed", [2, 3])
def test_secrets_among_slugs(spark, words, seed):
    rows = planted(random.Random(seed), words, 20000, 20, (24, 32, 40, 48, 36))
    found = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).where("size(added) > 0").select("doc_id").collect()
    hits = [r.doc_id for r in found if r.doc_id >= 20000]
    assert len(hits) >= 18
    assert len(found) - len(hits) <= 0.05 * len(found)


def test_repeated_secret_and_repeated_slug(spark, words):
    """A third of all rows are copies of one secret, another third of one slug."""
    rows = planted(random.Random(4), words, 2000, 8, (40,))
    rows += [(5000 + i, rows[2000][1]) for i in range(2000)] + [(9000 + i, rows[0][1]) for i in range(2000)]
    found = {r.doc_id for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).where("size(added) > 0").collect()}
    assert {2000, *range(5000, 7000)} <= found
    assert not found & {0, *range(9000, 11000)}


def brute_statistics(token, nulls):
    s = [c for c in token if c.isascii() and c.isalnum()]
    n, body = len(s), "".join(s)
    if set(body) <= set("0123456789abcdef") or set(body) <= set("0123456789ABCDEF"):
        name = "hex"
    else:
        name = "base32" if set(body) <= set(ALPHABETS["base32"]) else "base64"
    m2, m3, _ = nulls.moments[name]
    all_pairs = n * (n - 1) / 2
    pairs = sum(c * (c - 1) / 2 for c in Counter(s).values())
    uniform = (all_pairs * m2 - pairs) / math.sqrt(n * (n - 1) * (n - 2) * (m3 - m2**2) + all_pairs * (m2 - m2**2))
    kind = ["0" if c.isdigit() else "A" if c.isupper() else "a" for c in s]
    changes = sum(a != b for a, b in zip(kind, kind[1:]))
    rate = nulls.switches
    runs = (changes - (n - 1) * rate) / math.sqrt((n - 1) * rate * (1 - rate)) if changes else 0.0
    at = lambda c: "0123456789abcdefghijklmnopqrstuvwxyz".index(c.lower())
    known = sum(nulls.information[36 * at(a) + at(b)] for a, b in zip(s, s[1:]))
    serial = ((n - 1) * nulls.mean - known) / (math.sqrt(n - 1) * nulls.spread)
    codes = [ord(c) for c in s]
    mean = sum(codes) / n
    below = sum((c - mean) ** 2 for c in codes)
    rho = min(max(sum((a - mean) * (b - mean) for a, b in zip(codes, codes[1:])) / below, -0.999), 0.999) if below else 0.999
    return uniform, runs, serial, (math.atanh(0.8) - abs(math.atanh(rho))) * math.sqrt(n - 3) < 1.645


def test_statistics_by_brute_force(spark, words):
    rng = random.Random(6)
    tokens = [slug(rng, words) for _ in range(60)] + ["aaaaaaaaaaaaaaaaaaaaaa", ALPHABETS["base64"], "0123456789ABCDEF" * 2, "Ab1" * 4000]
    tokens += ["".join(rng.choice(a) for _ in range(30)) for a in ALPHABETS.values()]
    pairs = Counter()
    for t in tokens:
        s = [ord(c) for c in t if c.isalnum()]
        pairs.update(zip(s, s[1:]))
    nulls = secrets.fitted(dict(pairs))
    assert sum(math.exp(x) for x in nulls.information) > 0 and 0 < nulls.switches < 1
    frame = spark.createDataFrame([(t,) for t in tokens], "token string")
    got = frame.where(secrets._testable(F.col("token"))).select("token", secrets.statistics(F.col("token"), nulls).alias("s")).collect()
    assert len(got) == len([t for t in tokens if not t.isdigit()])
    for r in got:
        *want, ordered = brute_statistics(r.token, nulls)
        assert (r.s.uniform, r.s.runs, r.s.serial) == pytest.approx(tuple(want), rel=1e-6, abs=1e-6)
        assert r.s.ordered == ordered


def test_fitted_nulls_by_brute_force():
    pairs = {(ord("a"), ord("b")): 70000, (ord("B"), ord("c")): 10000, (ord("c"), ord("7")): 20000}
    nulls = secrets.fitted(pairs)
    weight = secrets.PRIOR_PAIRS
    assert nulls.switches == pytest.approx((weight * secrets.SWITCHES + 30000) / (weight + 100000))
    at = "0123456789abcdefghijklmnopqrstuvwxyz".index
    assert nulls.information[36 * at("a") + at("b")] > 0 > nulls.information[36 * at("a") + at("7")]
    assert set(nulls.moments) == {"hex", "base32", "base64"}
    assert secrets.fitted({}).mean == pytest.approx(0, abs=1e-9)


def test_nothing_to_test(spark):
    rows = [(1, None), (2, ""), (3, "12345678901234567890123"), (4, "short words only")]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3, 4] and not any(r.added for r in got)
