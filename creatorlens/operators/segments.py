"""Naming clusters, describing them and exporting the segment table."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..plans.cleaning import len_consistency, tier_label
from ..session import literal_frame
from ..sources.readers import project_existing, with_column_if_absent
from ..specs import DEFAULT_SPEC, SegmentSpec
from .gap import gap_export
from .kmeans import Standardized


def centroids_real(std: Standardized, centroids) -> list[list[float]]:
    """Centroids in the features' own units."""
    return [[float(v) * s + m for v, m, s in zip(c, std.mean, std.std)] for c in centroids]


#: Feature whose highest centroid earns a name; a later name replaces an earlier one.
ROLES = (
    ("avg_retention_rate", fv.SPECIALISTS),
    ("avg_ctr", fv.VIRAL),
    ("upload_freq_per_month", fv.VOLUME),
)


def name_clusters(
    assigned: DataFrame,
    centroids: Sequence[Sequence[float]],
    features: Sequence[str] = fv.CLUSTER_FEATURES,
    size_column: str = "subscriber_count",
    roles: Sequence[tuple[str, str]] = ROLES,
) -> DataFrame:
    """(cluster, archetype) from centroid positions; one row per centroid.

    The cluster with the largest mean size, and the centroid with the highest value of
    each role's feature get that name; the lowest cluster without a role is the dabbler,
    the rest are numbered. When one cluster earns several names the last of them decides,
    size coming first. A role whose feature was not clustered on is left out. Only K
    averages leave the aggregate.
    """
    k = len(centroids)
    sizes = {
        r["cluster"]: r["m"]
        for r in assigned.groupBy("cluster").agg(F.avg(size_column).alias("m")).collect()
        if r["m"] is not None
    }
    names: dict[int, str] = {}
    if sizes:
        names[min(sizes, key=lambda c: (-sizes[c], c))] = fv.GIANTS
    at = {f: i for i, f in enumerate(features)}
    for feature, name in roles:
        if feature in at:
            names[max(range(k), key=lambda c: (centroids[c][at[feature]], -c))] = name
    free = [c for c in range(k) if c not in names]
    if free:
        names[free[0]] = fv.DABBLERS
    rows = [(c, names.get(c, f"Cluster_{c}")) for c in range(k)]
    return literal_frame(assigned.sparkSession, ("cluster", "archetype"), rows)


def with_cluster_names(assigned: DataFrame, names: DataFrame) -> DataFrame:
    """Replaces ``archetype`` by the cluster's name (a K-entry map literal, no join)."""
    table = {r["cluster"]: r["archetype"] for r in names.collect()}
    mapping = F.create_map(*[F.lit(x) for x in chain(*table.items())])
    return assigned.withColumn("archetype", mapping[F.col("cluster")])


def cluster_summary(named: DataFrame) -> DataFrame:
    return named.groupBy("archetype").agg(
        F.count("creator_id").alias("n"),
        F.round(F.avg("avg_retention_rate"), 2).alias("avg_retention"),
        F.round(F.avg("avg_ctr"), 2).alias("avg_ctr"),
        F.round(F.avg("rpm"), 2).alias("avg_rpm"),
    )


def profile_minmax(
    named: DataFrame, features: Sequence[str] = fv.CLUSTER_FEATURES, digits: int = 6
) -> DataFrame:
    """Per archetype, each feature's mean scaled to 0..1 across archetypes."""
    means = named.filter(F.col("archetype").isNotNull()).groupBy("archetype").agg(
        *[F.avg(c).alias(c) for c in features]
    )
    few = Window.partitionBy(F.lit(0))  # one row per archetype

    def scaled(c: str) -> Column:
        lo, hi = F.min(c).over(few), F.max(c).over(few)
        return F.round((F.col(c) - lo) / (hi - lo + F.lit(1e-9)), digits).alias(c)

    return means.select("archetype", *[scaled(c) for c in features])


def scatter_feed(
    named: DataFrame, fractions: dict[str, float] | None = None, seed: int = 0
) -> DataFrame:
    """Retention against click-through by archetype; ``fractions`` thins archetypes."""
    if fractions is not None:
        named = named.sampleBy("archetype", fractions, seed)
    return named.select("creator_id", "archetype", "avg_ctr", "avg_retention_rate")


def export_segments(df: DataFrame, spec: SegmentSpec = DEFAULT_SPEC) -> DataFrame:
    """The segment table: gap columns added, missing derivations filled in, fixed order."""
    if "avg_video_len_std" in df.columns:
        df = with_column_if_absent(df, "len_consistency_score", len_consistency(df))
    df = with_column_if_absent(df, "subscriber_tier", tier_label(spec))
    return project_existing(gap_export(df, spec), fv.SEGMENT_EXPORT_COLUMNS)
