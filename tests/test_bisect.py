"""Ranks found by bins: exact at any spread of values, with nothing sorted."""

import random

import pytest
from pyspark.sql import functions as F

from creatorlens.operators import quantile as Q
from creatorlens.plans import reports as R


@pytest.mark.parametrize("kind", ["long", "double"])
def test_bins_find_all_ranks(spark, kind):
    rng = random.Random(3)
    values = [rng.choice([7, 7, 7, rng.randint(-50, 50), rng.randint(-(2**62), 2**62)]) for _ in range(3000)]
    values += [2**62 + i for i in range(40)] + [-(2**63), 2**63 - 1]
    if kind == "double":
        values = [rng.choice([0.0, 1e-300, 1e300, -1e300, float("inf"), rng.gauss(0, 1), v / 3]) for v in values]
    data = sorted(values)
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 5, f"x {kind}").repartition(4)
    ks = [1, 2, 3, 700, 1500, 1501, len(data) - 1, len(data)]
    found = Q.binned_values(df, "x", [*ks, 0, len(data) + 1])
    assert found == {k: data[k - 1] for k in ks}
    assert Q.kth_values(df, "x", ks, limit=100) == [data[k - 1] for k in ks]
    assert Q.binned_values(df.where("false"), "x", [1]) == {} == Q.binned_values(df, "x", [])


def test_hot_group_beyond_the_passes(spark, monkeypatch):
    """When grids stop narrowing, no task ranks more than its bins."""
    rng = random.Random(4)
    rows = [("hot", rng.random() ** 8) for _ in range(6000)] + [(None, float(i % 3)) for i in range(900)] + [("cold", 1.0), ("cold", 4.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    want = {r.g: r.x for r in df.groupBy("g").agg(F.percentile("x", F.lit(0.3)).alias("x")).collect()}
    ranked = []
    real = Q._pick_ranks
    monkeypatch.setattr(Q, "_pick_ranks", lambda counts, keys: ranked.append(counts.groupBy(*keys).count().agg(F.max("count")).first()[0]) or real(counts, keys))
    bisected = []
    search = Q.bisect_ranks
    monkeypatch.setattr(Q, "bisect_ranks", lambda *a: bisected.append(a[3]) or search(*a))
    monkeypatch.setattr(Q, "MAX_PASSES", 1)
    got = {r.g: r.x for r in Q.exact_quantiles(df, ["x"], 0.3, ["g"], limit=10).collect()}
    assert got == pytest.approx(want, abs=1e-15)
    assert bisected and max(n or 0 for n in ranked) <= 10


@pytest.mark.parametrize("n,nulls", [(0, 0), (3, 0), (10, 2), (57, 13), (500, 0), (40, 40)])
def test_deciles_by_brute_force(spark, n, nulls):
    rng = random.Random(n)
    rows = [(i, None if i < nulls else rng.choice([5, 5, 5, rng.randint(0, 30)])) for i in range(n)]
    df = spark.createDataFrame(rows, "creator_id long, subscriber_count long")
    ordered = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    want, at = [], 0
    for t in range(10):
        part = [s for _, s in ordered[at : at + n // 10 + (t < n % 10)]]
        at += len(part)
        known = [s for s in part if s is not None]
        if part:
            mean = sum(known) / len(known) if known else None
            want.append((t + 1, len(part), min(known, default=None), max(known, default=None), mean if mean is None else float(int(mean + 0.5))))
    assert [tuple(r) for r in R.subscriber_deciles(df).collect()] == want
