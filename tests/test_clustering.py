"""k-means, silhouette and stability against plain NumPy versions and invariants."""

from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from creatorlens import fixed_values as fv
from creatorlens.operators import kmeans as km
from creatorlens.operators import segments as SG
from creatorlens.operators import silhouette as SIL
from creatorlens.operators import stability as ST
from creatorlens.plans import segmentation as S
from creatorlens.plans import validation as V


def blobs(n=300, seed=5):
    rng = np.random.default_rng(seed)
    centers = np.array([[0, 0], [10, 10], [-10, 10]])
    x = centers[rng.integers(3, size=n)] + rng.normal(size=(n, 2))
    return x


@pytest.fixture(scope="module")
def points(spark):
    rows = [(i, float(a), float(b), float(i)) for i, (a, b) in enumerate(blobs())]
    return spark.createDataFrame(rows, "id bigint, a double, b double, c double").cache()


@pytest.fixture(scope="module")
def std(points):
    return km.standardize(points, "id", ["a", "b"])


def local(std):
    return np.array([[r["f0"], r["f1"]] for r in std.points.orderBy("id").collect()])


def test_standardize(std):
    x = blobs()
    assert np.allclose(local(std), (x - x.mean(axis=0)) / x.std(axis=0))


def test_standardize_rejects_gaps_and_keeps_constant(spark):
    df = spark.createDataFrame(
        [(1, 1.0, 5.0), (2, 3.0, 5.0), (3, None, 5.0), (4, float("nan"), 5.0)], "id int, a double, b double"
    )
    s = km.standardize(df, "id", ["a", "b"])
    assert (s.n, s.n_rejected) == (2, 2)
    assert [(r["f0"], r["f1"]) for r in s.points.orderBy("id").collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def sequential(x, start, max_iter=300, tol=1e-6):
    c, history = start.copy(), []
    for _ in range(max_iter):
        lab = np.argmin(((x[:, None] - c[None]) ** 2).sum(axis=2), axis=1)
        new = np.array([x[lab == k].mean(axis=0) for k in range(len(c))])
        history.append(((x - new[lab]) ** 2).sum())
        shift = np.sqrt(((new - c) ** 2).sum(axis=1)).max()
        c = new
        if shift < tol:
            break
    return c, history


def test_batched_runs_equal_sequential_runs(std):
    x = local(std)
    runs = km.make_runs(std.points, "id", std.columns, [(k, seed, 0) for k in (2, 3) for seed in range(3)])
    starts = [r.centroids.copy() for r in runs]
    km.lloyd(std.points, "id", std.columns, runs)
    for run, start in zip(runs, starts):
        c, history = sequential(x, start)
        assert np.allclose(run.centroids, c)
        assert np.allclose(run.history, history)
        assert all(b <= a + 1e-9 for a, b in zip(run.history, run.history[1:]))


def test_fit_is_reproducible_and_best(std):
    best, runs = km.kmeans(std, "id", 3, n_init=4, seed=7)
    again, _ = km.kmeans(std, "id", 3, n_init=4, seed=7)
    assert best.inertia == min(r.inertia for r in runs)
    assert np.allclose(best.centroids, again.centroids)
    labels = {r["cluster"] for r in km.assign_clusters(std.points, std.columns, best.centroids).collect()}
    assert labels == {0, 1, 2}


def test_k_equals_n_and_too_large(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 5.0)], "id int, a double")
    best, _ = km.kmeans(km.standardize(df, "id", ["a"]), "id", 3, n_init=1)
    assert best.inertia == pytest.approx(0)
    with pytest.raises(ValueError):
        km.kmeans(km.standardize(df, "id", ["a"]), "id", 4, n_init=1)


def test_empty_cluster_restarts_at_a_point(std):
    far = np.array([[0.0, 0.0], [1e6, 1e6]])
    run = km.Run(2, 1, 0, far)
    km.lloyd(std.points, "id", std.columns, [run], max_iter=1)
    third = hashed_order(range(300), 1, 0)[2]
    assert run.restarted == 1 and np.allclose(run.centroids[1], local(std)[third])


def hashed_order(ids, seed, restart):
    return sorted(ids, key=lambda i: md5(f"{i}:{seed}:{restart}".encode()).hexdigest())


def test_starts_come_from_the_whole_table(spark):
    n = 20_000
    df = spark.range(n).select("id", F.col("id").cast("double").alias("f0")).repartition(7)
    runs = km.make_runs(df, "id", ["f0"], [(k, seed, r) for k in (3, 5) for seed in (1, 2) for r in (0, 1)])
    for run in runs:
        assert run.centroids.ravel().tolist() == hashed_order(range(n), run.seed, run.restart)[: run.k]
    assert max(run.centroids.max() for run in runs) > 4096


def test_alignment_of_many_clusters():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 2)) * 10
    order = rng.permutation(12)
    aligned = ST.align_to_first([base, base[order] + 0.01])
    assert np.allclose(aligned[1], base + 0.01)


def test_rows_with_nan_are_left_out_of_fit_and_labels(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 9.0), (4, float("nan")), (5, None)], "creator_id int, a double")
    std = km.standardize(df, "creator_id", ["a"])
    labelled = S.attach_clusters(df, std, [[-1.0], [1.0]])
    assert std.n == 3 and sorted(r["creator_id"] for r in labelled.collect()) == [1, 2, 3]


@pytest.mark.parametrize("stable,status", [(8496, "FAIL"), (8500, "PASS")])
def test_verdict_on_the_unrounded_figure(spark, monkeypatch, stable, status):
    full = spark.range(1).select(F.lit(99.0).alias("pct"))
    monkeypatch.setattr(V, "_trimmed", lambda *a: full)
    monkeypatch.setattr(V, "_positive", lambda *a: full)
    counts = spark.createDataFrame([(10_000, stable)], "n bigint, n_stable bigint")
    rows = {r["check"]: r for r in V.summary(full, counts).collect()}
    row = rows["Cluster assignment stability"]
    assert (row["value"], row["status"]) == (85.0, status)
    assert {r["all_passed"] for r in rows.values()} == {status == "PASS"}


def test_ties_go_to_the_lowest_cluster(spark):
    df = spark.createDataFrame([(0.0,)], "f0 double")
    assert km.assign_clusters(df, ["f0"], [[1.0], [-1.0]]).first()["cluster"] == 0


def brute_silhouette(x, lab):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = []
    for i in range(len(x)):
        own = lab == lab[i]
        if own.sum() <= 1:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        others = [d[i, lab == c].mean() for c in np.unique(lab) if c != lab[i]]
        out.append((min(others) - a) / max(a, min(others)) if others else 0.0)
    return float(np.mean(out))


def test_silhouette_of_all_points(std, monkeypatch):
    monkeypatch.setattr(SIL, "BLOCK", 128)  # several blocks
    c = np.array([[0.0, 0.0], [1.0, 1.0], [-1.0, 1.0]])
    labelled = km.assign_clusters(std.points, std.columns, c)
    x = local(std)
    lab = np.argmin(((x[:, None] - c[None]) ** 2).sum(axis=2), axis=1)
    row = SIL.silhouette(labelled, "id", std.columns, None).first()
    assert row["n_scored"] == len(x)
    assert row["silhouette"] == pytest.approx(brute_silhouette(x, lab))


def test_silhouette_of_all_points_with_repeated_and_null_keys(spark, monkeypatch):
    monkeypatch.setattr(SIL, "BLOCK", 4)
    x = np.array([[0.0], [0.1], [0.2], [5.0], [5.1], [9.0], [9.3]])
    lab = np.array([0, 0, 0, 1, 1, 2, 2])
    keys = [1, 1, 1, 1, None, None, None]
    rows = [(k, int(c), float(v)) for k, c, v in zip(keys, lab, x[:, 0])]
    row = SIL.silhouette(spark.createDataFrame(rows, "id int, cluster int, f0 double"), "id", ["f0"], None).first()
    assert row["n_scored"] == 7 and row["silhouette"] == pytest.approx(brute_silhouette(x, lab))
    none = spark.createDataFrame([], "id int, cluster int, f0 double")
    assert tuple(SIL.silhouette(none, "id", ["f0"], None).first()) == (0, 0.0)


def test_silhouette_edge_cases(spark):
    one = spark.createDataFrame([(1, 0, 0.0), (2, 0, 1.0)], "id int, cluster int, f0 double")
    assert SIL.silhouette(one, "id", ["f0"], 500).first()["silhouette"] == 0.0
    lone = spark.createDataFrame([(1, 0, 0.0), (2, 1, 1.0), (3, 1, 1.5)], "id int, cluster int, f0 double")
    x, lab = np.array([[0.0], [1.0], [1.5]]), np.array([0, 1, 1])
    got = SIL.silhouette(lone, "id", ["f0"], 500).first()["silhouette"]
    assert got == pytest.approx(brute_silhouette(x, lab))


def test_sample_is_exact_and_repeatable(std):
    a = [r["id"] for r in SIL.hash_sample(std.points, "id", 50).collect()]
    b = [r["id"] for r in SIL.hash_sample(std.points.repartition(5), "id", 50).collect()]
    assert len(set(a)) == 50 and a == b


def test_name_clusters_collisions(spark):
    """One cluster leads everything: the last role wins, the rest are filled in."""
    df = spark.createDataFrame([(0, 10), (1, 5), (2, 1)], "cluster int, subscriber_count int")
    top, low = [9.0, 9.0, 9.0, 0.0, 0.0], [0.0] * 5
    names = {r["cluster"]: r["archetype"] for r in SG.name_clusters(df, [top, low, low]).collect()}
    assert names == {0: fv.VOLUME, 1: fv.DABBLERS, 2: "Cluster_2"}


def test_name_clusters_no_free_cluster(spark):
    df = spark.createDataFrame([(0, 1), (1, 5)], "cluster int, subscriber_count int")
    c = [[9.0, 0.0, 9.0, 0.0, 0.0], [0.0, 9.0, 0.0, 0.0, 0.0]]
    names = {r["cluster"]: r["archetype"] for r in SG.name_clusters(df, c).collect()}
    assert names == {0: fv.VOLUME, 1: fv.VIRAL}


def test_stability_counts_modal_label(spark):
    rows = [(1, 0, 0, 0), (2, 0, 1, 0), (3, 0, 1, 2)]
    df = spark.createDataFrame(rows, "id int, r0 int, r1 int, r2 int")
    row = ST.stability(df, ["r0", "r1", "r2"], 3, 2).first()
    assert (row["n"], row["n_stable"], row["pct_stable"]) == (3, 2, 66.7)


def test_alignment_undoes_renumbering():
    base = np.array([[0.0, 0.0], [5.0, 5.0], [9.0, 0.0]])
    out = ST.align_to_first([base, base[[2, 0, 1]] + 0.1])
    assert np.allclose(out[1], base + 0.1)


def test_aligned_stability_is_at_least_raw(points):
    df = points.withColumnRenamed("id", "creator_id")
    runs = V.stability_runs(df, k=3, seeds=range(5), features=["a", "b"])
    raw, aligned = runs.raw(4).first(), runs.aligned(4).first()
    assert aligned["n_stable"] >= raw["n_stable"] and raw["n"] == 300
    cv = ST.inertia_cv(runs.inertia_table()).first()
    values = [r.inertia for r in runs.runs]
    assert cv["cv_pct"] == pytest.approx(np.std(values) / np.mean(values) * 100)


def test_k_sweep_inertia_falls(points):
    df = points.withColumnRenamed("id", "creator_id")
    rows = S.k_sweep(df, ks=(2, 3, 4), n_init=3, features=["a", "b"]).orderBy("k").collect()
    inertias = [r["inertia"] for r in rows]
    assert inertias == sorted(inertias, reverse=True)
    assert max(rows, key=lambda r: r["silhouette"])["k"] == 3
    assert all(-1 <= r["silhouette"] <= 1 for r in rows)


def test_inertia_matches_history(std):
    c = np.array([[0.0, 0.0], [1.0, 1.0]])
    a = km.assign_clusters(std.points, std.columns, c)
    x = local(std)
    lab = np.argmin(((x[:, None] - c[None]) ** 2).sum(axis=2), axis=1)
    assert km.inertia(a, std.columns, c).first()[0] == pytest.approx(((x - c[lab]) ** 2).sum())
    means = {r["cluster"]: (r["f0"], r["f1"]) for r in km.update_centroids(a, std.columns).collect()}
    for k in (0, 1):
        assert np.allclose(means[k], x[lab == k].mean(axis=0))


def _plain(points, columns, runs, max_iter=300, tol=1e-6):
    """Lloyd's iteration over all points in plain arithmetic."""
    x = np.array([[r[c] for c in columns] for r in points.collect()])
    for r in runs:
        while not r.done and len(r.history) < max_iter:
            dist = ((x[:, None, :] - r.centroids[None]) ** 2).sum(axis=2)
            near = dist.argmin(axis=1)
            n = np.bincount(near, minlength=r.k)
            new = np.array([x[near == c].mean(axis=0) for c in range(r.k)])
            moved = ((new - r.centroids) ** 2).sum(axis=1)
            r.history.append(dist[np.arange(len(x)), near].sum() - (n * moved).sum())
            r.label_centroids, r.centroids = r.centroids, new
            r.done = bool(np.sqrt(moved.max()) < tol)
            r.distances += len(x) * r.k
    return runs


def test_split_points_change_no_label(spark, monkeypatch):
    """Iterating on open points gives the runs of plain iteration for fewer distances and passes."""
    rng = np.random.default_rng(11)
    centers = rng.normal(size=(6, 3)) * 2
    rows = [(i, *map(float, centers[i % 6] + rng.normal(size=3))) for i in range(9000)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    std = km.standardize(df, "id", ["a", "b", "c"])
    points = km.spread_points(std)
    specs = [(k, 7, i) for k in (1, 2, 5) for i in range(3)]
    passes = []
    real = km._pass
    monkeypatch.setattr(km, "_pass", lambda *a: passes.append(a[4]) or real(*a))
    for rows_open in (km.OPEN_ROWS, 2000, 0):
        monkeypatch.setattr(km, "OPEN_ROWS", rows_open)
        passes.clear()
        got = km.lloyd(points, "id", std.columns, km.make_runs(points, "id", std.columns, specs))
        want = _plain(points, std.columns, km.make_runs(points, "id", std.columns, specs))
        for g, w in zip(got, want):
            assert len(g.history) == len(w.history) and g.done == w.done
            np.testing.assert_allclose(g.history, w.history, rtol=1e-9)
            np.testing.assert_allclose(g.label_centroids, w.label_centroids, atol=1e-9)
        longest = max(len(w.history) for w in want)
        split = any(m is not None for p in passes for m in p)
        if rows_open:
            assert split and len(passes) < longest
            assert sum(g.distances for g in got) < sum(w.distances for w in want)
        else:
            assert not split and len(passes) == longest
    # more open points than were counted on: the pass is thrown away, the run goes on
    monkeypatch.setattr(km, "OPEN_ROWS", 3000)
    monkeypatch.setattr(km, "_chosen_margin", lambda run, rows: 10.0 if run.margins is not None else None)
    got = km.lloyd(points, "id", std.columns, km.make_runs(points, "id", std.columns, specs[-1:]))
    np.testing.assert_allclose(got[0].history, want[-1].history, rtol=1e-9)
    points.unpersist()


def test_starts_are_the_first_of_the_order(spark, monkeypatch):
    """The threshold only saves work: starts are those of the whole order, without Python."""
    from hashlib import md5

    rows = [(f"k{i % 700}" if i % 9 else None, float(i % 13), float(i)) for i in range(2000)]
    points = spark.createDataFrame(rows, "id string, f0 double, f1 double").repartition(3)
    orders = [(42, 0), (42, 1), (7, 3)]
    want = {o: np.array([v[1:] for v in sorted((md5(f"{k or ''}:{o[0]}:{o[1]}".encode()).hexdigest(), a, b) for k, a, b in rows)[:12]]) for o in orders}
    for spare in (km.STARTS_SPARE, -1.5):  # with too little spare the share has to grow
        monkeypatch.setattr(km, "STARTS_SPARE", spare)
        got = km.start_points(points, "id", ["f0", "f1"], [*orders, orders[0]], 12)
        assert got.keys() == want.keys() and all((got[o] == want[o]).all() for o in orders)
    assert len(km.start_points(points, "id", ["f0", "f1"], orders, 5000)[42, 0]) == 2000
    assert km.start_points(points.where("false"), "id", ["f0"], orders, 3)[7, 3].shape == (0, 1)


def test_roles_and_other_features(spark):
    """Naming takes its roles as a parameter and leaves out those of features not clustered on."""
    rng = np.random.default_rng(2)
    rows = [(i, float(i % 3) * 10 + rng.normal(), float(i % 2), 1000 * (i % 3 == 1)) for i in range(90)]
    df = spark.createDataFrame(rows, "creator_id int, rpm double, avg_ctr double, subscriber_count int")
    seg = S.segment(df, k=3, n_init=3, features=["rpm", "avg_ctr"], roles=[("rpm", "Rich"), ("missing", "Nobody")])
    names = {r.archetype for r in seg.named.select("archetype").distinct().collect()}
    assert {"Rich", fv.GIANTS, fv.DABBLERS} == names
    means = {r.archetype: r.m for r in seg.named.groupBy("archetype").agg(F.avg("rpm").alias("m")).collect()}
    assert max(means, key=means.get) == "Rich"
    assert S.segment(df, k=2, n_init=2, features=["rpm"]).named.count() == 90


def test_silhouette_of_a_sample_against_all(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(70, 2)) + np.repeat([[0, 0], [4, 0]], 35, axis=0)
    rows = [(i, int(i >= 35), *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, cluster int, a double, b double")
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    chosen = sorted(range(70), key=lambda i: md5(f"{i}:0".encode()).hexdigest())[:20]
    want = []
    for i in chosen:
        own = [j for j in range(70) if (j >= 35) == (i >= 35)]
        a = dist[i, own].sum() / (len(own) - 1)
        b = dist[i, [j for j in range(70) if j not in own]].mean()
        want.append((b - a) / max(a, b))
    got = SIL.silhouette(df, "id", ["a", "b"], 20, against_all=True).first()
    assert got.n_scored == 20 and got.silhouette == pytest.approx(np.mean(want))
