"""Rows and keys that need no work do none: repeated keys, gaps, heavy keys."""

import random

import pytest
from pyspark.sql import functions as F

from creatorlens.operators import impute, quantile, skew
from creatorlens.operators.dedup import keep_first


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("repeated_limit", [100_000, 3])
def test_keep_first_by_brute_force(spark, repeated_limit):
    rng = random.Random(6)
    rows = [(rng.choice([None, "hot", "hot", f"k{rng.randint(0, 60)}", f"once{i}"]), rng.choice(["a", None]), i, f"v{i}") for i in range(900)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, g string, pos int, v string").repartition(5)
    for keys in (["k"], ["k", "g"]):
        at = [("k", "g").index(k) for k in keys]
        want = {}
        for r in sorted(rows, key=lambda r: r[2]):
            want.setdefault(tuple(r[i] for i in at), r)
        got = keep_first(df, keys, "pos", repeated_limit).select("k", "g", "pos", "v").collect()
        assert sorted(map(tuple, got), key=str) == sorted(want.values(), key=str)
    assert keep_first(df.where("false"), ["k"], "pos").count() == 0


def test_rows_of_single_keys_are_not_shuffled(spark):
    df = spark.range(1000).select("id", F.col("id").alias("pos"), F.lit("x").alias("v"))
    assert "Aggregate" not in plan(keep_first(df, ["id"], "pos"))
    twice = keep_first(df.union(df.where("id < 10")), ["id"], "pos")
    assert twice.count() == 1000 and "LeftAnti" in plan(twice)


def test_medians_of_groups_with_a_gap_only(spark, monkeypatch):
    rows = [(i % 50, None if i % 50 == 7 and i < 100 else float(i)) for i in range(1000)] + [(None, None)]
    df = spark.createDataFrame(rows, "g int, x double")
    asked = []
    real = impute.exact_quantiles
    monkeypatch.setattr(impute, "exact_quantiles", lambda d, *a: asked.append(d.select("g").distinct().count() if "g" in d.columns else None) or real(d, *a))
    want = {g: sorted(x for h, x in rows if h == g and x is not None) for g in range(50)}
    for bound, groups in ((quantile.BROADCAST_ROWS, 1), (0, 51)):
        monkeypatch.setattr(quantile, "BROADCAST_ROWS", bound)
        asked.clear()
        got = impute.impute_group_median(df, "g", ["x"], 2).collect()
        assert asked == [groups, None] and len(got) == len(rows)
        seven = want[7]
        median = (seven[(len(seven) - 1) // 2] + seven[len(seven) // 2]) / 2
        assert sorted(r.x for r in got if r.g == 7)[: 2] == sorted([*seven, median, median])[:2]
        assert sum(r.x == median for r in got if r.g == 7) == 2 + seven.count(median)
        assert [r.x for r in got if r.g is None] == [round(sorted(x for _, x in rows if x is not None)[499 - 1] / 2 + sorted(x for _, x in rows if x is not None)[499] / 2, 2)]


def test_heavy_keys_by_sketch_and_by_count(spark, monkeypatch):
    rows = [("a",)] * 500 + [("b",)] * 101 + [("c",)] * 100 + [(f"k{i}",) for i in range(900)] + [(None,)] * 700
    df = spark.createDataFrame(rows, "k string").repartition(6)
    for least in (skew.LEAST_SUPPORT, 1.0):
        monkeypatch.setattr(skew, "LEAST_SUPPORT", least)
        assert sorted(r[0] for r in skew.heavy_keys(df, "k", 100).collect()) == ["a", "b"]
    assert skew.heavy_keys(df, "k", 10_000).count() == 0
    monkeypatch.setattr(quantile, "BROADCAST_ROWS", 10)
    dim = df.select(F.col("k").alias("d")).where("k is not null").distinct().withColumn("n", F.length("d"))
    for how, n in (("left", len(rows)), ("inner", len(rows) - 700)):
        joined = skew.lookup_join(df, dim, "k", "d", how, 100)
        assert joined.count() == n and joined.where("k is not null and n is null").count() == 0


@pytest.mark.parametrize("how", ["left", "inner"])
def test_more_heavy_keys_than_can_be_sent(spark, monkeypatch, how):
    """Five heavy keys, two may be broadcast: their rows are spread, also those without a match."""
    monkeypatch.setattr(quantile, "BROADCAST_ROWS", 2)
    rows = [(f"hot{i % 5}", i) for i in range(4000)] + [(f"k{i % 300}", i) for i in range(900)] + [(None, i) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(6)
    names = [f"hot{i}" for i in range(4)] + [f"k{i}" for i in range(200)] + ["never"]
    dim = spark.createDataFrame([(d, len(d)) for d in names], "d string, n int")
    seen = []
    real = skew._salted
    monkeypatch.setattr(skew, "_salted", lambda *a: seen.append(a[-1]) or real(*a))
    got = sorted(map(tuple, skew.lookup_join(df, dim, "k", "d", how, 200).collect()), key=str)
    known = set(names)
    want = [(k, v, k, len(k)) if k in known else (k, v, None, None) for k, v in rows if how == "left" or k in known]
    assert got == sorted(want, key=str) and seen == [4]


def test_files_follow_size(spark, tmp_path):
    from creatorlens.session import materialize

    df = spark.range(4000).select("id", F.when(F.col("id") < 3900, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 3)).alias("kind"))
    stored = materialize(df.repartition(16), "layout", "kind")
    assert stored.count() == 4000 and len(stored.inputFiles()) == 4


def test_ledger_is_counted_while_the_tables_are_written(spark, sf, monkeypatch):
    from creatorlens.plans import cleaning as C
    from creatorlens.sources import marts

    raw = [marts.stored(spark, sf, t) for t in ("creators_messy", "videos_messy")]
    creators, videos = C.clean_creators(raw[0]), C.clean_videos(raw[1])
    summary = {r.table_name: r for r in C.cleaning_summary(creators, videos).collect()}
    for name, c, source in (("creators", creators, raw[0]), ("videos", videos, raw[1])):
        assert (summary[name].n_before, summary[name].n_after) == (source.count(), c.clean.count())
        assert c.counts["rows"] == c.staged.count()
    for df in (C.cleaning_ledger(creators, videos), C.cleaning_summary(creators, videos)):
        assert "Relation" not in plan(df) and "FileScan" not in plan(df)  # no table is read again
    nothing = C.clean_creators(raw[0].where("false")), C.clean_videos(raw[1].where("creator_id = 'never'"))
    assert {r.n_rows for r in C.cleaning_ledger(*nothing).collect()} == {0}
    assert [(r.n_before, r.n_after) for r in C.cleaning_summary(*nothing).collect()] == [(0, 0)] * 2
