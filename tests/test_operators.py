"""Operators against brute force, with limits lowered so the large-data paths run."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from creatorlens.operators import impute as I
from creatorlens.operators import quantile as Q
from creatorlens.operators import ranking as RK
from creatorlens.operators.dedup import keep_first
from creatorlens.operators.profile import histogram
from creatorlens.operators.skew import lookup_join
from creatorlens.plans import reports as R


def skewed(n=4000, seed=1):
    """Rows (id, g, x, y): a third of all rows share one key and one value; some nulls."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        g = "hot" if hot else (None if i % 50 == 1 else f"g{i % 40}")
        x = None if i % 17 == 0 else (7.5 if hot and i % 2 else round(rnd.gauss(0, 100), 3))
        y = None if i % 13 == 0 else rnd.lognormvariate(0, 3)
        rows.append((i, g, x, y))
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(skewed(), "id bigint, g string, x double, y double").cache()


def as_dict(df, key):
    return {r[key]: tuple(v for k, v in r.asDict().items() if k != key) for r in df.collect()}


@pytest.mark.parametrize("limit", [10_000, 300, 20])
@pytest.mark.parametrize("q", [0.5, 0.95])
def test_grouped_quantiles_equal_builtin(frame, limit, q):
    got = as_dict(Q.exact_quantiles(frame, ["x", "y"], q, ["g"], limit), "g")
    want = as_dict(
        frame.groupBy("g").agg(F.percentile("x", F.lit(q)).alias("x"), F.percentile("y", F.lit(q)).alias("y")), "g"
    )
    assert got == want


@pytest.mark.parametrize("limit", [10_000, 300, 20])
def test_global_median(frame, limit):
    got = Q.exact_quantiles(frame, ["x", "y"], 0.5, (), limit).first()
    rows = skewed()
    for i, c in ((2, "x"), (3, "y")):
        assert got[c] == pytest.approx(float(np.median([r[i] for r in rows if r[i] is not None])), abs=0)


@pytest.mark.parametrize("limit", [10_000, 100])
def test_kth_values(frame, limit):
    xs = sorted(r[2] for r in skewed() if r[2] is not None)
    ks = [1, 1500, len(xs) + 1, 0]
    want = [xs[k - 1] if 1 <= k <= len(xs) else None for k in ks]
    assert Q.kth_values(frame, "x", ks, limit) == want


def test_kth_pair_breaks_ties_by_id(frame):
    order = sorted(skewed(), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
    for k in (100, 2000, 4000):
        v, i = RK.kth_pair(frame, "x", "id", k, limit=200)
        assert (v, i) == (order[k - 1][2], order[k - 1][0])


def test_global_row_number_rank_and_percent_rank(frame):
    df = frame.repartition(7)
    w = Window.orderBy(F.col("x").asc_nulls_first(), "id")
    want = as_dict(
        df.select(
            "id", F.row_number().over(w).alias("rn"),
            F.rank().over(Window.orderBy(F.col("x").asc_nulls_first())).alias("r"),
            F.percent_rank().over(Window.orderBy(F.col("x").asc_nulls_first())).alias("p"),
            F.ntile(20).over(w).alias("t"),
        ), "id",
    )
    narrow = df.select("id", "x")
    rn = RK.global_row_number(narrow, ["x", "id"], "rn", "n")
    rank = RK.global_rank(narrow, "x", ["id"], "r", "n")
    pr = RK.global_percent_rank(narrow, "x", ["id"], "p")
    tile = RK.global_ntile(narrow, ["x", "id"], 20, "t")
    got = rn.join(rank, "id").join(pr.select("id", "p"), "id").join(tile.select("id", "t"), "id")
    assert as_dict(got.select("id", "rn", "r", "p", "t"), "id") == want


def test_hot_value_spreads_over_partitions(spark):
    """A value held by most rows must not end up in one partition."""
    df = spark.range(0, 8000, 1, 8).select("id", F.lit(1).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # too small to split
    try:
        rows, _, total = RK._ordered(df, ["v", "id"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = [r["count"] for r in rows.groupBy("_part").count().collect()]
    assert total == 8000 and max(sizes) < 4000


@pytest.mark.parametrize("n,k", [(25, 10), (7, 10), (100, 20), (2996, 20), (1, 10)])
def test_ntile_formula(spark, n, k):
    df = spark.range(1, n + 1).select(F.col("id").alias("rn"))
    want = [r[0] for r in df.select(F.ntile(k).over(Window.orderBy("rn"))).collect()]
    got = [r[0] for r in df.orderBy("rn").select(RK.ntile_of(F.col("rn"), F.lit(n), k)).collect()]
    assert sorted(got) == sorted(want) and got == want


@pytest.mark.parametrize("limit", [1_000_000, 40])
def test_concentration_equals_percent_rank(spark, limit):
    rnd = random.Random(3)
    rows = [(i, None if i % 11 == 0 else float(rnd.randint(0, 30))) for i in range(500)]
    df = spark.createDataFrame(rows, "creator_id bigint, revenue_90d double")
    pr = df.withColumn("p", F.percent_rank().over(Window.orderBy(F.col("revenue_90d").asc_nulls_first())))
    got = {r["segment"]: (r["n_creators"], r["total_revenue"]) for r in R.revenue_concentration(df, limit).collect()}
    for name, cond in (("Top 10% by revenue", F.col("p") >= 0.9), ("Bottom 50% by revenue", F.col("p") < 0.5)):
        w = pr.filter(cond).agg(F.count("*"), F.sum("revenue_90d")).first()
        assert got[name] == (w[0], w[1])


def test_keep_first_null_keys_collapse(spark):
    rows = [("a", 2, "late"), ("a", 1, "early"), (None, 5, "n5"), (None, 4, "n4"), ("b", 9, "b")]
    df = spark.createDataFrame(rows, "k string, pos int, v string")
    got = {r["k"]: r["v"] for r in keep_first(df, ["k"], "pos").collect()}
    assert got == {"a": "early", None: "n4", "b": "b"}


def brute_impute(rows):
    by, everything = {}, []
    for _, g, x, _ in rows:
        if x is not None:
            everything.append(x)
            if g is not None:
                by.setdefault(g, []).append(x)
    med = {g: float(np.median(v)) for g, v in by.items()}
    glob = float(np.median(everything))
    return {
        i: x if x is not None else float(np.round(med.get(g, glob), 2)) for i, g, x, _ in rows
    }


@pytest.mark.parametrize("limit,broadcast_rows", [(1_000_000, 100_000), (50, 100_000), (20, 5)])
def test_impute_group_median(frame, monkeypatch, limit, broadcast_rows):
    monkeypatch.setattr(Q, "BROADCAST_ROWS", broadcast_rows)
    out = I.impute_group_median(frame, "g", ["x"], 2, limit)
    assert {r["id"]: r["x"] for r in out.collect()} == brute_impute(skewed())
    assert out.columns == frame.columns


def test_histogram_matches_numpy(frame):
    xs = [r[3] for r in skewed() if r[3] is not None]
    n, edges = np.histogram(xs, bins=35)
    got = histogram(frame, "y", 35).orderBy("bin").collect()
    assert [r["n"] for r in got] == n.tolist()
    assert np.allclose([r["lo"] for r in got], edges[:-1])


def test_histogram_of_constant(spark):
    df = spark.createDataFrame([(3.0,), (3.0,), (None,)], "v double")
    got = histogram(df, "v", 4).orderBy("bin").collect()
    n, edges = np.histogram([3.0, 3.0], bins=4)
    assert [r["n"] for r in got] == n.tolist() and [r["lo"] for r in got] == edges[:-1].tolist()


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_join_with_heavy_and_missing_keys(spark, frame, monkeypatch, how):
    monkeypatch.setattr(Q, "BROADCAST_ROWS", 3)
    keys = ["hot", *[f"g{i}" for i in range(1, 30)], "unused"]
    dim = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, v int")
    got = lookup_join(frame.select("id", "g"), dim, "g", "k", how, limit=200)
    at = {k: i for i, k in enumerate(keys)}
    want = {(i, at.get(g)) for i, g, _, _ in skewed() if how == "left" or g in at}
    assert {(r["id"], r["v"]) for r in got.collect()} == want
    assert got.count() == len(want)
