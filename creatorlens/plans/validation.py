"""Validation job: does the gap survive trimming, is it broad, are clusters stable?"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import pct_of
from ..operators import kmeans as km
from ..operators import stability as st
from ..operators.gap import parity_gap, positive_share
from ..operators.profile import histogram
from ..operators.quantile import GROUP_LIMIT, exact_quantiles
from ..specs import DEFAULT_SPEC, SegmentSpec

KEY = "creator_id"


def _verdict(value, threshold: float):
    return F.when(value >= threshold, F.lit("PASS")).otherwise(F.lit("FAIL"))


def outlier_trim(
    segments: DataFrame, spec: SegmentSpec = DEFAULT_SPEC, limit: int = GROUP_LIMIT
) -> DataFrame:
    """Gap left after removing target rows above the interpolated 95% views quantile."""
    return _trimmed(segments, spec, limit).select(
        "n_removed",
        F.round("full", 0).alias("gap_before"),
        F.round("trimmed", 0).alias("gap_after"),
        F.round("pct", 1).alias("pct_retained"),
        _verdict(F.col("pct"), fv.TRIM_PASS_PCT).alias("verdict"),
    )


def _trimmed(segments: DataFrame, spec: SegmentSpec, limit: int) -> DataFrame:
    """The unrounded figures of ``outlier_trim``."""
    rows = parity_gap(segments, spec).select("views_90d", "revenue_gap")
    cutoff = exact_quantiles(rows, ["views_90d"], fv.TRIM_QUANTILE, (), limit).scalar()
    kept = F.col("views_90d") <= cutoff
    agg = rows.agg(
        F.count("*").alias("n_all"),
        F.count_if(kept).alias("n_kept"),
        F.sum("revenue_gap").alias("full"),
        F.coalesce(F.sum(F.when(kept, F.col("revenue_gap"))), F.lit(0.0)).alias("trimmed"),
    )
    pct = pct_of(F.col("trimmed"), F.col("full"))
    return agg.select(
        (F.col("n_all") - F.col("n_kept")).alias("n_removed"), "full", "trimmed", pct.alias("pct")
    )


def broad_base(segments: DataFrame, spec: SegmentSpec = DEFAULT_SPEC) -> DataFrame:
    """Share of target rows with a gap above zero."""
    return _positive(segments, spec).select(
        F.round("pct", 1).alias("pct_positive"),
        F.round(F.lit(100.0) - F.col("pct"), 1).alias("pct_zero"),
        _verdict(F.col("pct"), fv.BROAD_BASE_PASS_PCT).alias("verdict"),
    )


def _positive(segments: DataFrame, spec: SegmentSpec) -> DataFrame:
    return parity_gap(segments, spec).agg(positive_share(F.col("revenue_gap")).alias("pct"))


def gap_distribution(
    segments: DataFrame,
    spec: SegmentSpec = DEFAULT_SPEC,
    bins: int = 35,
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Histogram of the per-creator gap with its median and mean on every row."""
    rows = parity_gap(segments, spec).select("revenue_gap")
    median = exact_quantiles(rows, ["revenue_gap"], 0.5, (), limit).scalar()
    mean = rows.agg(F.avg("revenue_gap").alias("m")).scalar()
    return histogram(rows, "revenue_gap", bins).select(
        "bin",
        F.round("lo", 2).alias("lo"),
        F.round("hi", 2).alias("hi"),
        "n",
        F.round(median, 2).alias("median_gap"),
        F.round(mean, 2).alias("mean_gap"),
    )


@dataclass
class StabilityRuns:
    std: km.Standardized
    runs: list[km.Run]

    def inertia_table(self) -> DataFrame:
        return km.runs_frame(self.std.points.sparkSession, self.runs)

    def labels(self) -> DataFrame:
        """(creator_id, run, cluster): every point under every run."""
        sets = [r.label_centroids for r in self.runs]
        wide = st.with_run_labels(self.std.points, KEY, self.std.columns, sets)
        by_run = F.array(*[F.col(f"run_{i}") for i in range(len(sets))])
        return wide.select(KEY, F.posexplode(by_run).alias("run", "cluster"))

    def _score(self, centroid_sets, agreement: int) -> DataFrame:
        labelled = st.with_run_labels(self.std.points, KEY, self.std.columns, centroid_sets)
        names = [f"run_{i}" for i in range(len(self.runs))]
        return st.stability(labelled, names, self.runs[0].k, agreement)

    def raw(self, agreement: int = fv.STABILITY_AGREEMENT) -> DataFrame:
        """Agreement of the cluster numbers as each run produced them."""
        return self._score([r.label_centroids for r in self.runs], agreement)

    def aligned(self, agreement: int = fv.STABILITY_AGREEMENT) -> DataFrame:
        """Agreement after matching every run's clusters to the first run's."""
        return self._score(st.align_to_first([r.label_centroids for r in self.runs]), agreement)


def stability_runs(
    df: DataFrame,
    k: int = 5,
    seeds: Sequence[int] = range(fv.STABILITY_RUNS),
    max_iter: int = 200,
    features: Sequence[str] = fv.CLUSTER_FEATURES,
) -> StabilityRuns:
    """One single-restart fit per seed, all advanced by the same passes."""
    std = km.standardize(df, KEY, features)
    points = km.spread_points(std)
    try:
        runs = km.make_runs(points, KEY, std.columns, [(k, s, 0) for s in seeds])
        km.lloyd(points, KEY, std.columns, runs, max_iter)
    finally:
        points.unpersist()
    return StabilityRuns(std, runs)


def summary(
    segments: DataFrame,
    stability: DataFrame,
    spec: SegmentSpec = DEFAULT_SPEC,
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """(check, value, threshold, status, all_passed) of the three checks.

    ``stability`` is one row with n and n_stable. Unrounded figures are compared with the
    thresholds; ``value`` shows one decimal. The verdict over all is a window over the three
    rows, so that no check runs twice.
    """
    stable = F.col("n_stable") * 100.0 / F.nullif(F.col("n"), F.lit(0))
    parts = (
        ("Outlier trim survives", _trimmed(segments, spec, limit).select("pct"), fv.TRIM_PASS_PCT),
        ("Broad-base positive-gap rate", _positive(segments, spec).select("pct"), fv.BROAD_BASE_PASS_PCT),
        ("Cluster assignment stability", stability.select(stable.alias("pct")), fv.STABILITY_PASS_PCT),
    )
    out = None
    for name, df, threshold in parts:
        one = df.select(
            F.lit(name).alias("check"),
            F.round("pct", 1).alias("value"),
            F.lit(threshold).alias("threshold"),
            _verdict(F.col("pct"), threshold).alias("status"),
        )
        out = one if out is None else out.unionByName(one)
    three = Window.partitionBy(F.lit(1))
    return out.withColumn("all_passed", F.bool_and(F.col("status") == "PASS").over(three))
