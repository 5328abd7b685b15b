"""What grows with the tables: passes over packed points, shuffles of narrow rows, no table written for one reader."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from creatorlens.functions import strip
from creatorlens.operators import kmeans as km
from creatorlens.operators import quantile as Q
from creatorlens.operators.dedup import keep_first
from creatorlens.session import drop_scratch, scratch_root
from creatorlens.sources import marts


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_products_settle_ties_as_differences_do():
    """A grid of integers has many points as near to two centroids."""
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, size=(5000, 3)).astype(float)
    sets = [rng.integers(-3, 4, size=(k, 3)).astype(float) for k in (1, 2, 2, 5, 5, 3)]
    sums = km._Sums(sets)
    for lo in range(0, len(x), km.BLOCK):
        sums.add(np.ascontiguousarray(x[lo : lo + km.BLOCK].T))
    for c, got in zip(sets, sums.result()):
        dist = km._measured(x, c)
        np.testing.assert_allclose(got, km._summed(x, dist, dist.argmin(axis=1), len(c)), atol=1e-8)


def test_points_are_packed_into_blocks(spark):
    df = spark.range(5000).select("id", (F.col("id") / 7).alias("a"), (-F.col("id")).cast("double").alias("b")).repartition(2)
    blocks = [np.frombuffer(r.block).reshape(2, -1) for r in km._packed(df, ["a", "b"]).collect()]
    assert len(blocks) <= 2 * (2500 // km.BLOCK + 1)
    got = np.concatenate(blocks, axis=1)
    assert sorted(map(tuple, got.T)) == sorted((i / 7, -float(i)) for i in range(5000))
    assert km._packed(df.where("false"), ["a", "b"]).count() == 0


@pytest.mark.parametrize("open_rows", [0, 2000])
def test_listed_points_change_no_label(spark, monkeypatch, open_rows):
    """Runs that measure the places written down with the blocks are those of plain iteration."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(9000, 3)) + (rng.normal(size=(6, 3)) * 2)[np.arange(9000) % 6]
    x[::7] = np.round(x[::7])  # points that are as near to two centroids
    points = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id int, a double, b double, c double").repartition(3)
    monkeypatch.setattr(km, "LISTED_ROWS", 1)
    monkeypatch.setattr(km, "OPEN_ROWS", open_rows)
    monkeypatch.setattr(km, "BLOCK", 1000)
    seen, real = [], km._pass
    monkeypatch.setattr(km, "_pass", lambda *a: seen.append((a[4], a[5])) or real(*a))
    specs = [(k, 7, i) for k in (1, 2, 5, 7) for i in range(3)]
    columns = ["a", "b", "c"]
    runs = km.lloyd(points, "id", columns, km.make_runs(points, "id", columns, specs))
    measured = 0
    for run, start in zip(runs, km.make_runs(points, "id", columns, specs)):
        c, history = start.centroids, []
        while len(history) < 300:
            dist = km._measured(x, c)
            sums = km._summed(x, dist, dist.argmin(axis=1), run.k)
            new = sums[:, 2:] / sums[:, :1]
            moved = ((new - c) ** 2).sum(axis=1)
            history.append(sums[:, 1].sum() - (sums[:, 0] * moved).sum())
            c = new
            if np.sqrt(moved.max()) < 1e-6:
                break
        assert len(run.history) == len(history)
        np.testing.assert_allclose(run.history, history, rtol=1e-9)
        np.testing.assert_allclose(run.centroids, c, atol=1e-9)
        measured += len(history) * run.k * len(x)
    assert any(m is not None for _, lists in seen for m in lists.narrowed) and any(any(lists.listed) for _, lists in seen)
    assert any(m is not None for margins, _ in seen for m in margins) == (open_rows > 0)
    assert sum(r.distances for r in runs) < 0.8 * measured


def test_strip_without_regular_expression(spark):
    texts = [f"{w}a{w}b{w}" for w in map(chr, range(0x3100))] + [" a\n\n", "\r\n a \n", " ", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.where(~strip(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).count() == 0
    assert "regexp" not in plan(df.select(strip(F.col("t")))).lower()


@pytest.mark.parametrize("limit", [5, 1000])
def test_rows_of_small_groups_are_shuffled_once(spark, monkeypatch, limit):
    df = spark.range(3000).select((F.col("id") % 900).alias("g"), F.when(F.col("id") % 4 > 0, F.col("id") * 1.5).alias("x"), F.lit(None).cast("double").alias("y"))
    df = df.unionByName(spark.range(20).select(F.lit(None).cast("bigint").alias("g"), F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y")))
    want = {r.g: (r.x, r.y) for r in df.groupBy("g").agg(F.percentile("x", F.lit(0.5)).alias("x"), F.percentile("y", F.lit(0.5)).alias("y")).collect()}
    monkeypatch.setattr(Q, "BROADCAST_ROWS", 100)
    got = Q.exact_quantiles(df, ["x", "y"], 0.5, ["g"], limit)
    assert {r.g: (r.x, r.y) for r in got.collect()} == want
    assert "RepartitionByExpression" in plan(got)


def test_many_repeated_keys_shuffle_no_single_row(spark):
    df = spark.range(150_000).select(F.col("id").cast("string").alias("k"), F.col("id").alias("pos")).withColumn("v", F.lit("first"))
    twice = df.union(df.where("pos < 110000").select("k", (F.col("pos") + 1_000_000).alias("pos"), F.lit("second").alias("v")))
    got = keep_first(twice, ["k"], "pos")
    assert "LeftAnti" in plan(got)
    assert got.agg(F.count("*"), F.countDistinct("k"), F.count_if(F.col("v") == "first")).first() == (150_000, 150_000, 150_000)


def test_only_creators_are_written(spark, sf):
    drop_scratch(spark)
    items = marts.stored(spark, sf, "items").select("video_id", "views")
    assert "l_extendedprice" not in plan(items).split("Join")[-1].split("Relation")[0]
    marts.stored(spark, sf, "videos_messy").select("views").count()
    marts.stored(spark, sf, "creators_messy").select("creator_id").count()
    written = [n for n in os.listdir(scratch_root(spark).removeprefix("file:")) if n.startswith(("mart-", "entities"))]
    assert len(written) == 1 and written[0].startswith("mart-segments")
