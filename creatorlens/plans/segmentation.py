"""Segmentation job: standardise, choose K, cluster, name, export."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators import kmeans as km
from ..operators import segments as sg
from ..operators.silhouette import hash_sample, silhouette
from ..specs import DEFAULT_SPEC, SegmentSpec

KEY = "creator_id"


@dataclass
class Segmentation:
    std: km.Standardized
    best: km.Run
    runs: list[km.Run]
    assigned: DataFrame  # input rows with complete features, plus cluster
    named: DataFrame  # assigned, archetype replaced by the cluster's name

    def summary(self) -> DataFrame:
        """(k, n_points, n_rejected, inertia, silhouette)."""
        points = km.assign_clusters(self.std.points, self.std.columns, self.best.label_centroids)
        score = silhouette(points, KEY, self.std.columns)
        return score.select(
            F.lit(self.best.k).alias("k"),
            F.lit(self.std.n).cast("bigint").alias("n_points"),
            F.lit(self.std.n_rejected).cast("bigint").alias("n_rejected"),
            F.lit(float(self.best.inertia)).alias("inertia"),
            "silhouette",
        )


def attach_clusters(df: DataFrame, std: km.Standardized, centroids) -> DataFrame:
    """Input rows with their cluster: one projection, no join back to the points."""
    z = {
        f: (F.col(c).cast("double") - F.lit(m)) / F.lit(s)
        for c, f, m, s in zip(std.features, std.columns, std.mean, std.std)
    }
    return (
        df.filter(km.complete_row(std.features))
        .withColumns(z)
        .withColumn("cluster", km.nearest(std.columns, centroids))
        .drop(*std.columns)
    )


def segment(
    df: DataFrame,
    k: int = 5,
    n_init: int = 20,
    max_iter: int = 300,
    seed: int = 42,
    features: Sequence[str] = fv.CLUSTER_FEATURES,
    roles: Sequence[tuple[str, str]] = sg.ROLES,
) -> Segmentation:
    std = km.standardize(df, KEY, features)
    best, runs = km.kmeans(std, KEY, k, n_init, max_iter, seed=seed)
    assigned = attach_clusters(df, std, best.label_centroids)
    names = sg.name_clusters(assigned, best.centroids.tolist(), features, roles=roles)
    return Segmentation(std, best, runs, assigned, sg.with_cluster_names(assigned, names))


def k_sweep(
    df: DataFrame,
    ks: Sequence[int] = range(2, 9),
    n_init: int = 10,
    max_iter: int = 300,
    seed: int = 42,
    sample_size: int = 500,
    features: Sequence[str] = fv.CLUSTER_FEATURES,
) -> DataFrame:
    """(k, inertia, silhouette) per K; every restart of every K shares the passes."""
    std = km.standardize(df, KEY, features)
    spark = df.sparkSession
    points = km.spread_points(std)
    try:
        runs = km.make_runs(points, KEY, std.columns, [(k, seed, i) for k in ks for i in range(n_init)])
        km.lloyd(points, KEY, std.columns, runs, max_iter)
        rows = hash_sample(points, KEY, sample_size).collect()
    finally:
        points.unpersist()
    # the bounded sample is scored once per K
    sample = spark.createDataFrame(rows, std.points.schema)
    out = None
    for k in ks:
        best = km.best_of([r for r in runs if r.k == k])
        labelled = km.assign_clusters(sample, std.columns, best.label_centroids)
        one = silhouette(labelled, KEY, std.columns, sample_size).select(
            F.lit(int(k)).alias("k"), F.lit(float(best.inertia)).alias("inertia"), "silhouette"
        )
        out = one if out is None else out.unionByName(one)
    return out


def export(seg: Segmentation, spec: SegmentSpec = DEFAULT_SPEC) -> DataFrame:
    return sg.export_segments(seg.named, spec)


def centroid_table(seg: Segmentation) -> DataFrame:
    """(cluster, features...) of the best run in real units."""
    real = np.array(sg.centroids_real(seg.std, seg.best.centroids))
    rows = [(i, *map(float, c)) for i, c in enumerate(real)]
    ddl = "cluster int, " + ", ".join(f"{f} double" for f in seg.std.features)
    return seg.assigned.sparkSession.createDataFrame(rows, ddl)
