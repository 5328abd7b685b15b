"""Whitening against plain linear algebra and exact integer arithmetic."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from creatorlens.llm import catalog, common, whitening


def brute_polynomial(m):
    """Faddeev-LeVerrier in exact integers, constant term first."""
    d = len(m)
    c, b = [0] * d + [1], [[0] * d for _ in range(d)]
    for k in range(1, d + 1):
        b = [[sum(m[i][t] * b[t][j] for t in range(d)) + (c[d - k + 1] if i == j else 0) for j in range(d)] for i in range(d)]
        c[d - k] = -sum(m[i][t] * b[t][i] for i in range(d) for t in range(d)) // k
    return c


def gram(rows):
    return [[sum(r[i] * r[j] for r in rows) for j in range(len(rows[0]))] for i in range(len(rows[0]))]


@pytest.mark.parametrize("size", [1, 2, 5, 9])
def test_polynomial_is_exact(spark, size):
    rng = random.Random(size)
    m = gram([[rng.randint(-(10**9), 10**9) * (i != 2) for i in range(size)] for _ in range(size + 1)])
    assert whitening.polynomial(spark, m) == brute_polynomial(m)


def test_hessenberg_form_with_zero_pivots():
    for m in ([[0, 1, 0], [0, 0, 1], [1, 0, 0]], [[2, 0, 0, 1], [0, 3, 0, 0], [0, 0, 3, 0], [1, 0, 0, 2]]):
        p = 2147483647
        assert whitening.polynomial_mod(np.array(m), p).tolist() == [c % p for c in brute_polynomial(m)]


def test_primes_cover_the_bound():
    primes = whitening.primes_for(10**40)
    assert primes[0] == 2**31 - 1 and len(set(primes)) == len(primes)
    assert all(p % q for p in primes for q in range(3, 47000, 2))


def test_roots_with_multiplicity_and_zeros():
    poly = [1]
    for root in (7, 7, 7, 3, 3, 1, 0, 0):
        poly = [(poly[k - 1] if k else 0) - root * (poly[k] if k < len(poly) else 0) for k in range(len(poly) + 1)]
    assert [(float(r), n) for r, n in whitening.largest_roots(poly, 8)] == [(7.0, 3), (3.0, 2), (1.0, 1)]
    assert [(float(r), n) for r, n in whitening.largest_roots(poly, 2)] == [(7.0, 2)]
    assert whitening.largest_roots([1], 3) == [] == whitening.largest_roots([0, 0, 1], 3)


def brute(vectors, most, scale=1024.0):
    x = np.floor(np.array(vectors, dtype=np.float64) * scale) + 100000
    n = len(x)
    centred = (n * x - x.sum(axis=0)) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    deviation = [sum(int(z) ** 2 for z in row) for row in (n * x - x.sum(axis=0))]
    at = [i for i in np.argsort(-e)[:most] if e[i] > 1e-9 * max(e.max(), 1)]
    return deviation, centred @ v[:, at] / np.sqrt(e[at]), e[at] / e.sum()


def check(df, most, want_vectors, **kw):
    got = {}
    for r in whitening.whitened(df, components=most, **kw).collect():
        got.setdefault(r.vec_id, []).append(r)
    deviation, white, explained = brute(want_vectors, most)
    assert len(got) == len(want_vectors)
    size = white.shape[1]
    found = np.array([[r.whitened for r in sorted(rows, key=lambda r: r.component)] for _, rows in sorted(got.items())])
    assert found.shape == (len(want_vectors), size)
    sign = np.sign((found * white).sum(axis=0))
    np.testing.assert_allclose(found * sign, white, rtol=1e-7, atol=1e-7)
    for (_, rows), d in zip(sorted(got.items()), deviation):
        assert {r.deviation for r in rows} == {d} and {r.n for r in rows} == {len(want_vectors)}
        np.testing.assert_allclose([r.explained for r in sorted(rows, key=lambda r: r.component)], explained, rtol=1e-9)
        assert all(r.identity_error < 1e-9 for r in rows)


def test_whitening_by_brute_force(spark):
    rng = np.random.default_rng(1)
    data = (rng.normal(size=(300, 6)) * [3, 1, 0.5, 0.25, 0.1, 0]).astype(np.float32)  # the last dimension is constant
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    odd = [(900, None), (901, [1.0, None, 0.0]), (902, [float("nan")]), (903, [float("inf")] * 6)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumns({"n": F.lit("clash"), "white": F.lit(1), "component": F.lit("c")})
    check(df.repartition(5), 8, [v for _, v in rows])
    assert sorted(whitening.whitened(df).columns) == sorted(["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])


def test_large_entries_are_exact(spark):
    rng = random.Random(4)
    data = [[rng.randint(-(2**44), 2**44) / 1024, float(rng.randint(-5, 5)), rng.random()] for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(data)), "vec_id long, embedding array<double>")
    n, sums, m = whitening.scatter(df, "embedding", 1024.0)
    x = [[int(np.floor(c * 1024)) for c in v] for v in data]
    s = [sum(v[i] for v in x) for i in range(3)]
    assert (n, sums) == (2000, s)
    assert m == [[n * sum(v[i] * v[j] for v in x) - s[i] * s[j] for j in range(3)] for i in range(3)]
    # deviations beyond a long are null, the rest of the row is there
    assert all(r.deviation is None or r.deviation >= 0 for r in whitening.whitened(df).collect())


def test_equal_variances_short_vectors_and_few_rows(spark):
    def frame(data):
        return spark.createDataFrame(list(enumerate(data)), "vec_id long, embedding array<double>")

    corners = [[a, b, c] for a in (-1.0, 1.0) for b in (-1.0, 1.0) for c in (-0.5, 0.5)]
    rows = whitening.whitened(frame(corners)).collect()
    assert len(rows) == 24 and all(r.identity_error < 1e-12 for r in rows)
    assert sorted({round(r.explained, 12) for r in rows}) == [round(1 / 9, 12), round(4 / 9, 12)]
    short = [[1.0, 2.0], [1.0], [], [3.0, 0.0, 5.0], [0.25]]
    check(frame(short).repartition(3), 8, [v + [0.0] * (3 - len(v)) for v in short])
    for few in ([], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [[]] * 3, [None]):
        assert whitening.whitened(frame(few)).count() == 0


def test_query_over_the_table(spark, sf):
    rows = catalog.op12_whitening(spark, sf).collect()
    table = common.table(spark, sf, "embeddings").orderBy("vec_id").collect()
    assert len(rows) == 8 * len(table)
    deviation, white, explained = brute([r.embedding for r in table], 8)
    by = {(r.vec_id, r.component): r for r in rows}
    found = np.array([[by[r.vec_id, k].whitened for k in range(1, 9)] for r in table])
    np.testing.assert_allclose(found * np.sign((found * white).sum(axis=0)), white, atol=1e-8)
    assert [by[r.vec_id, 1].deviation for r in table] == deviation
    np.testing.assert_allclose([by[table[0].vec_id, k].explained for k in range(1, 9)], explained, rtol=1e-9)
    assert rows[0].identity_error < 1e-9
