"""Whitening of embeddings through the exact characteristic polynomial of their scatter.

Entries become integers, so the scatter n * sum(x x') - S S' is an exact integer matrix: tasks
multiply blocks of limbs small enough for exact floating-point products, and an aggregate adds
them as decimals. Its characteristic polynomial is found modulo many primes, one prime at a
time in Spark tasks, by reduction to Hessenberg form; Chinese remaindering gives the integer
coefficients. All roots are real and none is negative, so the sign changes of the shifted
polynomial count the roots above a point exactly (Descartes): bisection isolates the largest
roots and then halves their intervals by the sign of the polynomial. Components are the null
spaces of scatter minus root, by inverse iteration in decimals of DIGITS digits.

What the driver holds is the scatter, the polynomial and the components: bounded by the number
of dimensions. Every row is read twice, to fit and to whiten.

Edge cases: a vector that is null, or holds a null or non-finite entry, takes no part. A shorter
vector counts as filled up with zero entries. Repeated rows count each; ids may be null or
repeated. Entries beyond 2^61 / scale count as that. A component without variance (a constant
dimension, fewer vectors than dimensions) has no whitened value and is left out, so equal
vectors and empty tables give no rows. Components of equal variance are any orthonormal basis of
their space. Columns named like an output are replaced.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stored

LIMB_BITS = 22
EXACT_ROWS = 1 << (53 - 2 * LIMB_BITS)  # rows whose limb products add up below 2^53
HELD_ROWS = 1 << 18  # rows whose sums fit a long
LARGEST = 1 << 61
ROOT_BITS = 160  # bits of the largest root; at least GUARD_BITS behind the point
GUARD_BITS = 64
DIGITS = 100
STEPS = 3  # of inverse iteration

_SUMS = "i int, j int, power int, total long"


def entries(column: pa.Array, scale: float) -> np.ndarray:
    """floor(scale * entry) as a matrix of longs; shorter vectors are filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), dtype=np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, place] = np.clip(np.floor(column.flatten().to_numpy(zero_copy_only=False) * scale), -LARGEST, LARGEST).astype(np.int64)
    return out


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """x as a sum of limbs times powers of 2^LIMB_BITS; as few as its largest entry needs."""
    out = []
    while np.abs(x).max(initial=0) >= 1 << LIMB_BITS:
        out.append(x & ((1 << LIMB_BITS) - 1))
        x = x >> LIMB_BITS
    return [*out, x]


def _scatter_sums(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}  # (power, dimensions): products, a constant one in front
        rows = 0

        def handed() -> pa.RecordBatch:
            keys, totals = [np.zeros((3, 0), np.int32)], [np.zeros(0, np.int64)]
            for (power, size), total in held.items():
                i, j = np.triu_indices(size + 1)
                keys.append(np.stack([i - 1, j - 1, np.full(len(i), power)]).astype(np.int32))
                totals.append(total[i, j])
            held.clear()
            columns = [*map(pa.array, np.concatenate(keys, axis=1)), pa.array(np.concatenate(totals))]
            return pa.RecordBatch.from_arrays(columns, names=["i", "j", "power", "total"])

        for batch in small_batches(batches, EXACT_ROWS):
            x = entries(batch.column(0), scale)
            if rows + len(x) > HELD_ROWS:
                yield handed()
                rows = 0
            rows += len(x)
            parts = limbs(x)
            size = x.shape[1]
            for a, left in enumerate(parts):
                for b, right in enumerate(parts):
                    total = held.setdefault((a + b, size), np.zeros((size + 1, size + 1), dtype=np.int64))
                    total[1:, 1:] += (left.T.astype(np.float64) @ right.astype(np.float64)).astype(np.int64)
                held[a, size][0, 1:] += left.sum(axis=0)
            held[0, size][0, 0] += len(x)
        yield handed()

    return run


@dataclass
class Whitening:
    """n vectors, their sums, unit components (rows), their variances and shares of all variance."""

    scale: float
    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray


def usable(vectors: DataFrame, vector_col: str) -> DataFrame:
    """The rows that take part, with the vector as doubles."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(F.coalesce(finite, F.lit(False))).withColumn(vector_col, x.cast("array<double>"))


def scatter(vectors: DataFrame, vector_col: str, scale: float) -> tuple[int, list[int], list[list[int]]]:
    """n, sums S and n * sum(x x') - S S', exact, of the usable vectors."""
    # -1 stands for the constant one
    parts = usable(vectors, vector_col).select(vector_col).mapInArrow(_scatter_sums(scale), _SUMS)
    found = parts.groupBy("i", "j", "power").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    return _assembled(found.collect())


def _assembled(rows) -> tuple[int, list[int], list[list[int]]]:
    size = max((r.j + 1 for r in rows), default=0)
    full = [[0] * (size + 1) for _ in range(size + 1)]
    for r in rows:
        full[r.i + 1][r.j + 1] += int(r.total) << (LIMB_BITS * r.power)
    n, s = full[0][0], full[0][1:]
    m = [[n * full[min(i, j) + 1][max(i, j) + 1] - s[i] * s[j] for j in range(size)] for i in range(size)]
    return n, s, m


# --- the characteristic polynomial


def _is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide all numbers below 2^32."""
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    return n % 2 == 1 and all(pow(a, d, n) == 1 or any(pow(a, d << k, n) == n - 1 for k in range(r)) for a in (2, 3, 5, 7))


def primes_for(bound: int) -> list[int]:
    """Primes below 2^31 whose product exceeds ``bound``."""
    out, product, p = [], 1, (1 << 31) - 1
    while product <= bound:
        if _is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def polynomial_mod(a: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x I - a) modulo p, constant term first, through Hessenberg form."""
    a, d = a % p, len(a)
    for k in range(d - 2):
        below = np.flatnonzero(a[k + 1 :, k])
        if not len(below):
            continue
        r = k + 1 + below[0]
        a[[k + 1, r]] = a[[r, k + 1]]
        a[:, [k + 1, r]] = a[:, [r, k + 1]]
        factor = a[k + 2 :, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2 :] = (a[k + 2 :] - factor[:, None] * a[k + 1]) % p
        a[:, k + 1] = (a[:, k + 1] + (a[:, k + 2 :] * factor % p).sum(axis=1)) % p
    minors = np.zeros((d + 1, d + 1), dtype=np.int64)  # polynomials of the leading minors
    minors[0, 0] = 1
    for k in range(d):
        minors[k + 1, 1:] = minors[k, :-1]
        path, weights = 1, np.zeros(k + 1, dtype=np.int64)
        for i in range(k, -1, -1):
            weights[i] = int(a[i, k]) * path % p
            path = path * int(a[i, i - 1]) % p if i else 0
        minors[k + 1] = (minors[k + 1] - (weights[:, None] * minors[: k + 1] % p).sum(axis=0)) % p
    return minors[d]


def polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(x I - matrix), constant term first; the matrix is a scatter."""
    d = len(matrix)
    # the coefficients are elementary symmetric in roots that are not negative
    bound = (1 + sum(matrix[i][i] for i in range(d)) // d + 1) ** d
    primes = primes_for(2 * bound)
    sent = spark.sparkContext.broadcast(matrix)  # d^2 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = np.array(sent.value, dtype=object)
        for batch in batches:
            found = [polynomial_mod((exact % p).astype(np.int64), p).tolist() for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["p", "residues"])

    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(len(primes)).mapInArrow(run, "p long, residues array<long>").collect()
    product = math.prod(primes)
    lifts = [(product // r.p) * pow(product // r.p, -1, r.p) for r in rows]
    out = [sum(r.residues[k] * lift for r, lift in zip(rows, lifts)) % product for k in range(d + 1)]
    return [c - product if 2 * c > product else c for c in out]


# --- roots


def _changes(c: list[int], at: int) -> int:
    """Sign changes of the polynomial shifted by ``at``: the number of roots above it."""
    c = list(c)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += at * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _value(c: list[int], at: int) -> int:
    out = 0
    for x in reversed(c):
        out = out * at + x
    return out


def largest_roots(poly: list[int], most: int) -> list[tuple[Decimal, int]]:
    """The positive roots among the ``most`` largest with their multiplicity, largest first. Roots that
    agree in all bits are one."""
    while poly and not poly[0]:
        poly = poly[1:]
    d = len(poly) - 1
    if d < 1:
        return []
    top = -poly[d - 1] + 1  # above the sum of the roots
    bits = max(0, ROOT_BITS - top.bit_length()) + GUARD_BITS
    while True:
        c = [x << (bits * (d - k)) for k, x in enumerate(poly)]
        spans = _spans(c, top << bits, min(most, d))
        if all(low for low, _ in spans):  # no root rounds to zero
            break
        bits *= 2
    roots: dict[Decimal, int] = {}
    with localcontext() as context:
        context.prec = DIGITS
        for low, high in spans:
            root = Decimal(low + high) / 2 / (1 << bits)
            roots[root] = roots.get(root, 0) + 1
    return list(roots.items())


def _spans(c: list[int], top: int, most: int) -> list[tuple[int, int]]:
    """For each of the largest roots the integers next to it (low < root <= high)."""
    above = {0: len(c) - 1, top: 0}

    def count(at: int) -> int:
        if at not in above:
            above[at] = _changes(c, at)
        return above[at]

    out = []
    for rank in range(1, most + 1):
        low = max(at for at, n in above.items() if n >= rank)
        high = min(at for at, n in above.items() if n < rank)
        while high - low > 1 and not (above[low] == rank and above[high] == rank - 1):
            middle = (low + high) // 2
            low, high = (middle, high) if count(middle) >= rank else (low, middle)
        if high - low > 1:  # a single root: its side is the sign's
            right = _value(c, high)
            if not right:
                low = high - 1
            while high - low > 1:
                middle = (low + high) // 2
                value = _value(c, middle)
                low, high = (low, middle) if not value or (value > 0) == (right > 0) else (middle, high)
        out.append((low, high))
    return out


# --- components


def null_space(matrix: list[list[int]], root: Decimal, size: int) -> np.ndarray:
    """``size`` orthonormal vectors that the matrix less ``root`` takes to almost zero."""
    with localcontext() as context:
        context.prec = DIGITS
        a = np.array([[Decimal(x) for x in row] for row in matrix], dtype=object)
        d = len(a)
        a[np.arange(d), np.arange(d)] -= root
        tiny = max(abs(x) for x in a.ravel()) * Decimal(10) ** (10 - DIGITS) or Decimal(1)
        rng = random.Random(d)
        vectors = np.array([[Decimal(rng.randint(-(10**9), 10**9)) for _ in range(size)] for _ in range(d)], dtype=object)
        order = np.arange(d)
        for k in range(d):  # factors in place; rows swapped for the largest pivot
            r = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
            a[[k, r]], order[[k, r]] = a[[r, k]], order[[r, k]]
            a[k, k] = a[k, k] if abs(a[k, k]) > tiny else tiny
            a[k + 1 :, k] /= a[k, k]
            a[k + 1 :, k + 1 :] -= np.multiply.outer(a[k + 1 :, k], a[k, k + 1 :])
        for _ in range(STEPS):
            vectors = vectors[order]
            for k in range(d):
                vectors[k + 1 :] -= np.multiply.outer(a[k + 1 :, k], vectors[k])
            for k in range(d - 1, -1, -1):
                vectors[k] /= a[k, k]
                vectors[:k] -= np.multiply.outer(a[:k, k], vectors[k])
            for i in range(size):
                for _ in range(2):
                    for j in range(i):
                        vectors[:, i] -= (vectors[:, i] * vectors[:, j]).sum() * vectors[:, j]
                    vectors[:, i] /= (vectors[:, i] ** 2).sum().sqrt()
        return vectors.T.astype(np.float64)


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int = 8, scale: float = 1024.0) -> Whitening:
    """The components of largest variance of floor(scale * vector); a constant added to all entries
    would change none of it."""
    n, sums, matrix = scatter(vectors, vector_col, scale)
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    roots = largest_roots(polynomial(vectors.sparkSession, matrix), components) if trace else []
    basis, variances, explained = [], [], []
    for root, size in roots:
        basis.append(null_space(matrix, root, size))
        variances += [float(root / (n * n))] * size
        explained += [float(root / trace)] * size
    all_of = np.concatenate(basis) if basis else np.zeros((0, len(sums)))
    return Whitening(scale, n, sums, all_of, np.array(variances), np.array(explained))


def _deviations(scaled: np.ndarray, sums: np.ndarray, n: int) -> tuple[np.ndarray, list]:
    """(n x - S) / n as doubles, and the exact sum of (n x - S)^2, null beyond a long."""
    most = n * int(np.abs(scaled).max(initial=0)) + max(map(abs, sums.tolist()), default=0)
    kind = np.int64 if most * most * max(1, len(sums)) < 1 << 63 else object
    z = n * scaled.astype(kind) - sums.astype(kind)
    squares = (z * z).sum(axis=1)
    return (z / n).astype(np.float64), [int(s) if s < 1 << 63 else None for s in squares]


def projected(vectors: DataFrame, model: Whitening, vector_col: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """The usable rows: columns ``keep`` (default all but the vector), ``deviation`` and ``white``, the whitened array."""
    rest = [c for c in (vectors.columns if keep is None else keep) if c not in (vector_col, "deviation", "white")]
    fields = [vectors.schema[c] for c in rest] + [T.StructField("deviation", T.LongType()), T.StructField("white", T.ArrayType(T.DoubleType()))]
    sent = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        sums = np.array(m.sums, dtype=object)
        onto = (m.components / np.sqrt(m.variances)[:, None]).T
        for batch in small_batches(batches):
            x = entries(batch.column(len(rest)), m.scale)
            x = np.pad(x, ((0, 0), (0, len(sums) - x.shape[1])))
            centred, squares = _deviations(x, sums, m.n)
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * np.int32(onto.shape[1]))
            white = pa.ListArray.from_arrays(ends, pa.array((centred @ onto).ravel()))
            columns = [batch.column(i) for i in range(len(rest))] + [pa.array(squares, pa.int64()), white]
            yield pa.RecordBatch.from_arrays(columns, names=[*rest, "deviation", "white"])

    return usable(vectors, vector_col).select(*rest, vector_col).mapInArrow(run, T.StructType(fields))


def identity_error(white: DataFrame, size: int) -> float:
    """Largest absolute entry of the covariance of ``white`` (divisor n) less the identity."""
    pairs = [(i, j) for i in range(size) for j in range(i + 1)]
    row = white.agg(*[F.covar_pop(F.col("white")[i], F.col("white")[j]) for i, j in pairs]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(row, pairs))


def whitened(vectors: DataFrame, vector_col: str = "embedding", components: int = 8, scale: float = 1024.0, keep: list[str] | None = None) -> DataFrame:
    """One row per usable vector and component: the columns ``keep`` (default all but the vector), component
    (from 1), n, deviation, whitened, explained, identity_error."""
    model = fit(vectors, vector_col, components, scale)
    white = projected(vectors, model, vector_col, keep)
    names = ("component", "n", "deviation", "whitened", "explained", "identity_error")
    rest = [c for c in white.columns[:-2] if c not in names]
    white = white.select(*rest, "deviation", "white")
    size = len(model.variances)
    if not size:
        error = 0.0
    else:
        white = stored(white, "whitened")
        error = identity_error(white, size)
    explained = F.array(*[F.lit(float(x)) for x in model.explained]).cast("array<double>")
    return white.select(*rest, "deviation", F.posexplode("white").alias("at", "whitened")).select(
        *rest, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
