"""Named queries over the star-schema tables: one per operator or report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixed_values as fv
from .functions import (
    age_years,
    duration_minutes,
    lenient_double,
    lenient_long,
    parse_count,
    parse_currency,
    parse_date,
    parse_rate,
    parse_views,
    strip,
)
from .operators import gap as G
from .operators import kmeans as km
from .operators import profile as P
from .operators import ranking as RK
from .operators import segments as SG
from .operators import stability as ST
from .operators.dedup import keep_first
from .operators.lookup import normalize_labels
from .operators.silhouette import silhouette
from .plans import cleaning as C
from .plans import reports as R
from .plans import segmentation as S
from .plans import sql_reports as Q
from .plans import validation as V
from .session import once, scratch_path
from .sources import marts, schemas
from .sources.readers import POSITION, read_strings, read_typed, write_table

Query = Callable[[SparkSession, str], DataFrame]
SPEC = marts.MART_SPEC

# --- Fixed values: reference centroids in z-score units (one row per cluster) ---
CENTROIDS = (
    (1.0, 0.5, 0.0, 0.0, 0.0),
    (-0.5, 1.0, 0.5, 0.0, 0.0),
    (0.0, -0.5, 1.0, 0.5, -0.5),
    (0.0, 0.0, -0.5, 1.0, 0.5),
    (-0.5, -0.5, -0.5, -0.5, 0.5),
)


def shifted_centroids(runs: int = fv.STABILITY_RUNS) -> list[list[list[float]]]:
    """The reference centroids drifting a little per run; the last run is renumbered."""
    sets = [
        [[v + 0.01 * r * (1 if j % 2 == 0 else -1) for j, v in enumerate(c)] for c in CENTROIDS]
        for r in range(runs)
    ]
    sets[-1] = sets[-1][1:] + sets[-1][:1]
    return sets


def _table(name: str, fn, *args) -> Query:
    return lambda spark, sf_dir: fn(marts.stored(spark, sf_dir, name), *args)


def _seg(fn, *args) -> Query:
    return _table("segments", fn, *args)


# ── sources and sinks ───────────────────────────────────────────────────────


def src_csv_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "creators-csv")
    # in another order than the schema's: columns are found by name
    raw = marts.stored(spark, sf_dir, "creators_messy").select(*reversed(schemas.CREATORS_MESSY.names))
    write_table(raw, path, "csv")
    return read_strings(spark, path, schemas.CREATORS_MESSY, with_position=False)


def _roundtrip(name: str, schema, fmt: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = scratch_path(spark, f"{name}-{fmt}")
        write_table(marts.stored(spark, sf_dir, name).select(*reversed(schema.names)), path, fmt)
        return read_typed(spark, path, schema, fmt)

    return run


def export_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "segments-export")
    write_table(SG.export_segments(marts.stored(spark, sf_dir, "segments"), SPEC), path)
    return read_typed(spark, path, schemas.CREATOR_SEGMENTS)


# ── cleaning ────────────────────────────────────────────────────────────────


def cleaned_creators(spark: SparkSession, sf_dir: str) -> C.Cleaned:
    raw = marts.stored(spark, sf_dir, "creators_messy")
    return once(spark, ("creators",), sf_dir, lambda: C.clean_creators(raw))


def cleaned_videos(spark: SparkSession, sf_dir: str) -> C.Cleaned:
    raw = marts.stored(spark, sf_dir, "videos_messy")
    return once(spark, ("videos",), sf_dir, lambda: C.clean_videos(raw))


def _clean_creators(*columns: str) -> Query:
    return lambda spark, sf_dir: cleaned_creators(spark, sf_dir).clean.select(*columns)


def clean_strip(raw: DataFrame) -> DataFrame:
    return C.strip_strings(raw.select(*schemas.CREATORS_MESSY.names))


def dedup_keep_first(raw: DataFrame) -> DataFrame:
    return keep_first(C.strip_strings(raw), ["creator_id"], POSITION).drop(POSITION)


def dedup_videos(raw: DataFrame) -> DataFrame:
    return keep_first(C.strip_strings(raw), ["video_id"], POSITION).drop(POSITION)


def _normalized(column: str, synonyms) -> Callable[[DataFrame], DataFrame]:
    def run(raw: DataFrame) -> DataFrame:
        df = raw.select(
            "creator_id", strip(F.col(column)).alias("raw_label"),
            strip(F.col(column)).alias(column),
        )
        counted = normalize_labels(df, column, synonyms).groupBy("raw_label", column)
        return counted.agg(F.count("*").alias("n_rows"))

    return run


def _normalized_rows(column: str, synonyms) -> Callable[[DataFrame], DataFrame]:
    """Every row's label before and after."""

    def run(raw: DataFrame) -> DataFrame:
        text = strip(F.col(column))
        df = raw.select(strip(F.col("creator_id")).alias("creator_id"), text.alias("raw_label"), text.alias(column))
        return normalize_labels(df, column, synonyms)

    return run


def _parsed(key: str, *columns: tuple[str, str, Callable]) -> Callable[[DataFrame], DataFrame]:
    """(id, raw text, parsed value) per named column."""

    def run(raw: DataFrame) -> DataFrame:
        texts = {f"raw_{name}": strip(F.col(source)) for source, name, _ in columns}
        df = raw.select(strip(F.col(key)).alias(key), *[c.alias(n) for n, c in texts.items()])
        for _, name, _ in columns:
            df = df.withColumn(name, F.col(f"raw_{name}")) if name != key else df
        return C.parse_columns(df, {name: parser for _, name, parser in columns})

    return run


_DOUBLES = (
    "avg_retention_rate", "avg_ctr", "avg_video_length_mins", "avg_video_len_std", "rpm",
)


def null_invalid(raw: DataFrame) -> DataFrame:
    df = raw.select(
        strip(F.col("creator_id")).alias("creator_id"),
        *[lenient_double(strip(F.col(c))).alias(c) for c in ("avg_retention_rate", "rpm")],
    )
    return C.null_invalid(df)


def drop_zero(raw: DataFrame) -> DataFrame:
    df = raw.select(
        strip(F.col("creator_id")).alias("creator_id"),
        parse_count(strip(F.col("subscriber_count"))).alias("subscriber_count"),
    )
    return df.filter(F.col("subscriber_count") != 0)


def drop_chargebacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = cleaned_videos(spark, sf_dir).staged
    kept = staged.filter(~F.col("_chargeback"))
    parts = (("kept", kept), ("chargebacks", C.chargebacks(staged)))
    out = None
    for name, df in parts:
        one = df.agg(
            F.count("*").alias("n_rows"),
            F.count("revenue").alias("n_revenue"),
            F.round(F.sum("revenue"), 2).alias("revenue"),
        ).select(F.lit(name).alias("part"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def chargeback_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every deduplicated video with the part it goes to."""
    staged = cleaned_videos(spark, sf_dir).staged
    part = F.when(F.col("_chargeback"), F.lit("chargebacks")).otherwise(F.lit("kept"))
    return staged.select("video_id", "creator_id", "publish_date", "revenue", part.alias("part"))


def distinct_before_after(raw: DataFrame) -> DataFrame:
    df = keep_first(C.strip_strings(raw), ["creator_id"], POSITION)
    df = df.select(
        F.col("niche_category").alias("niche_raw"), "niche_category",
        F.col("archetype").alias("archetype_raw"), "archetype",
    )
    df = normalize_labels(df, "niche_category", fv.NICHE_SYNONYMS)
    df = normalize_labels(df, "archetype", fv.ARCHETYPE_SYNONYMS)
    return P.distinct_before_after(
        df,
        {
            "niche_category": ("niche_raw", "niche_category"),
            "archetype": ("archetype_raw", "archetype"),
        },
    )


def cleaning_query(fn) -> Query:
    return lambda spark, sf_dir: fn(
        cleaned_creators(spark, sf_dir), cleaned_videos(spark, sf_dir)
    )


# ── profiling ───────────────────────────────────────────────────────────────


def histogram(segments: DataFrame) -> DataFrame:
    """The profiling features, 40 bins each."""
    return P.histograms(segments, fv.PROFILE_FEATURES, 40).select(
        "feature", "bin", F.round("lo", 8).alias("lo"), F.round("hi", 8).alias("hi"), "n"
    )


def tier_internal_std(segments: DataFrame) -> DataFrame:
    mid = SPEC.tier_labels()[2]
    return P.subset_spread(segments, F.col("subscriber_tier") == mid, "avg_retention_rate")


# ── windows ─────────────────────────────────────────────────────────────────


def win_ntile(segments: DataFrame) -> DataFrame:
    narrow = segments.select("creator_id", "subscriber_count")
    return RK.global_ntile(narrow, ["subscriber_count", "creator_id"], 10, "decile")


def win_percent_rank(segments: DataFrame) -> DataFrame:
    narrow = segments.select("creator_id", "revenue_90d")
    return RK.global_percent_rank(narrow, "revenue_90d", ["creator_id"])


def win_total(segments: DataFrame) -> DataFrame:
    """COUNT(*) OVER () as a scalar subquery, next to the global row number."""
    narrow = segments.select("creator_id", "views_90d")
    total = narrow.agg(F.count("*").alias("n")).scalar()
    return narrow.withColumn("cnt", total)


def global_rank(segments: DataFrame) -> DataFrame:
    """Row number and shared rank by views: values repeat, some are null."""
    narrow = segments.select("creator_id", "views_90d")
    return RK.global_rank(narrow, "views_90d", ["creator_id"], "rnk", "n_total", "rn")


# ── clustering ──────────────────────────────────────────────────────────────


def _standardized(segments: DataFrame) -> km.Standardized:
    return km.standardize(segments, S.KEY, fv.CLUSTER_FEATURES)


def zscore(segments: DataFrame) -> DataFrame:
    std = _standardized(segments)
    return std.points.select(S.KEY, *[F.round(c, 6).alias(c) for c in std.columns])


def _assigned(segments: DataFrame) -> tuple[km.Standardized, DataFrame]:
    std = _standardized(segments)
    return std, km.assign_clusters(std.points, std.columns, CENTROIDS)


def centroid_distance(segments: DataFrame) -> DataFrame:
    std = _standardized(segments)
    d = km.distances(std.columns, CENTROIDS)
    return std.points.select(S.KEY, *[F.round(x, 6).alias(f"d{i}") for i, x in enumerate(d)])


def assign_clusters(segments: DataFrame) -> DataFrame:
    return _assigned(segments)[1].select(S.KEY, "cluster")


def update_centroids(segments: DataFrame) -> DataFrame:
    std, assigned = _assigned(segments)
    means = km.update_centroids(assigned, std.columns)
    return means.select("cluster", "n", *[F.round(c, 6).alias(c) for c in std.columns])


def inertia(segments: DataFrame) -> DataFrame:
    std, assigned = _assigned(segments)
    return km.inertia(assigned, std.columns, CENTROIDS).select(
        F.round("inertia", 3).alias("inertia")
    )


def _named(segments: DataFrame) -> DataFrame:
    assigned = S.attach_clusters(segments, _standardized(segments), CENTROIDS)
    return SG.with_cluster_names(assigned, SG.name_clusters(assigned, CENTROIDS))


def name_clusters(segments: DataFrame) -> DataFrame:
    assigned = S.attach_clusters(segments, _standardized(segments), CENTROIDS)
    return SG.name_clusters(assigned, CENTROIDS)


def centroids_real(segments: DataFrame) -> DataFrame:
    std = _standardized(segments)
    rows = [(i, *[round(v, 6) for v in c]) for i, c in enumerate(SG.centroids_real(std, CENTROIDS))]
    ddl = "cluster int, " + ", ".join(f"{f} double" for f in std.features)
    return segments.sparkSession.createDataFrame(rows, ddl)


def silhouette_sample(segments: DataFrame) -> DataFrame:
    std, assigned = _assigned(segments)
    return silhouette(assigned, S.KEY, std.columns, 500).select(
        "n_scored", F.round("silhouette", 6).alias("silhouette")
    )


def silhouette_linear(segments: DataFrame) -> DataFrame:
    """The sample of 500 scored against every row."""
    std, assigned = _assigned(segments)
    return silhouette(assigned, S.KEY, std.columns, 500, against_all=True).select(
        "n_scored", F.round("silhouette", 6).alias("silhouette")
    )


def stability_raw(segments: DataFrame) -> DataFrame:
    std = _standardized(segments)
    sets = shifted_centroids()
    labelled = ST.with_run_labels(std.points, S.KEY, std.columns, sets)
    names = [f"run_{i}" for i in range(len(sets))]
    return ST.stability(labelled, names, len(CENTROIDS), fv.STABILITY_AGREEMENT)


#: Digits of sums over many floats, whose last places depend on the order of addition.
DIGITS = {"inertia": 3, "mean_inertia": 3, "cv_pct": 6, "silhouette": 6}


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in DIGITS.items() if c in df.columns})


def fitted(spark: SparkSession, sf_dir: str) -> S.Segmentation:
    seg = marts.stored(spark, sf_dir, "segments")
    return once(spark, ("fit",), sf_dir, lambda: S.segment(seg))


def fitted_runs(spark: SparkSession, sf_dir: str) -> V.StabilityRuns:
    seg = marts.stored(spark, sf_dir, "segments")
    return once(spark, ("runs",), sf_dir, lambda: V.stability_runs(seg))


def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = marts.stored(spark, sf_dir, "segments")
    return V.summary(seg, fitted_runs(spark, sf_dir).raw(), SPEC)


# ── the registry ────────────────────────────────────────────────────────────


def source_queries() -> dict[str, Query]:
    return {
        "src_csv_strings": src_csv_strings,
        "src_typed": _roundtrip("items", schemas.VIDEOS_CLEAN, "csv"),
        "sink_roundtrip": _roundtrip("segments", schemas.CREATORS_CLEAN, "parquet"),
        "export_segments": export_segments,
        "sql_views": _seg(Q.gap_by_sub_tier, SPEC),
        "sql_video_buckets": _table("items", Q.video_buckets, SPEC),
    }


def cleaning_queries() -> dict[str, Query]:
    def creators(fn):
        return _table("creators_messy", fn)

    def videos(fn):
        return _table("videos_messy", fn)

    return {
        "clean_strip": creators(clean_strip),
        "dedup_keep_first": creators(dedup_keep_first),
        "normalize_niche": creators(_normalized("niche_category", fv.NICHE_SYNONYMS)),
        "normalize_archetype": creators(_normalized("archetype", fv.ARCHETYPE_SYNONYMS)),
        "normalize_niche_rows": creators(_normalized_rows("niche_category", fv.NICHE_SYNONYMS)),
        "normalize_archetype_rows": creators(_normalized_rows("archetype", fv.ARCHETYPE_SYNONYMS)),
        "parse_count": creators(
            _parsed("creator_id", ("subscriber_count", "subscriber_count", parse_count))
        ),
        "parse_currency": creators(
            _parsed("creator_id", ("revenue_90d", "revenue_90d", parse_currency))
        ),
        "parse_age": creators(
            _parsed("creator_id", ("channel_age_years", "channel_age_years", age_years))
        ),
        "parse_rate": creators(
            _parsed("creator_id", ("upload_freq_per_month", "upload_freq_per_month", parse_rate))
        ),
        "lenient_cast": creators(
            _parsed(
                "creator_id",
                *[(c, c, lenient_double) for c in _DOUBLES],
                ("monthly_views", "monthly_views", lenient_long),
            )
        ),
        "null_invalid": creators(null_invalid),
        "drop_zero": creators(drop_zero),
        "impute_group_median": _clean_creators(
            "creator_id", "archetype", *fv.CREATOR_IMPUTE_COLUMNS
        ),
        "len_consistency": _clean_creators(
            "creator_id", "avg_video_len_std", "len_consistency_score"
        ),
        "tier_right_closed": _clean_creators("creator_id", "subscriber_count", "subscriber_tier"),
        "final_types": lambda spark, sf: cleaned_creators(spark, sf).clean,
        "dedup_videos": videos(dedup_videos),
        "parse_dates": videos(_parsed("video_id", ("publish_date", "publish_date", parse_date))),
        "parse_duration": videos(
            _parsed("video_id", ("video_length_mins", "video_length_mins", duration_minutes))
        ),
        "parse_views": videos(_parsed("video_id", ("views", "views", parse_views))),
        "drop_chargebacks": drop_chargebacks,
        "chargeback_rows": chargeback_rows,
        "lenient_cast_videos": videos(
            _parsed(
                "video_id",
                ("video_id", "video_number", lenient_long),
                ("creator_id", "creator_number", lenient_long),
                *[(c, c, lenient_double) for c in ("retention_rate", "ctr", "rpm")],
            )
        ),
        "impute_creator_median": lambda spark, sf: cleaned_videos(spark, sf).clean,
    }


def profile_queries() -> dict[str, Query]:
    return {
        "null_audit": _seg(P.null_audit),
        "table_shape": lambda spark, sf: P.table_shape(
            creators=marts.stored(spark, sf, "segments"),
            videos=marts.stored(spark, sf, "items").drop(POSITION),
        ),
        "distinct_before_after": _table("creators_messy", distinct_before_after),
        "cleaning_ledger": cleaning_query(C.cleaning_ledger),
        "cleaning_summary": cleaning_query(C.cleaning_summary),
        "feature_moments": _seg(P.feature_moments, fv.PROFILE_FEATURES),
        "histogram": _seg(histogram),
        "corr_matrix": _seg(P.corr_matrix, fv.CORRELATION_COLUMNS),
        "corr_verdict": _seg(
            P.corr_verdict, "subscriber_count", "avg_retention_rate", fv.WEAK_CORRELATION
        ),
        "zone_counts": _seg(
            P.zone_counts, "avg_retention_rate", fv.HIGH_RETENTION_ZONE, "rpm", (0.0, 6000.0)
        ),
        "tier_internal_std": _seg(tier_internal_std),
        "tier_share": _seg(
            P.tier_share, "subscriber_tier", SPEC.tier_labels()[::-1], "revenue_90d"
        ),
    }


def report_queries() -> dict[str, Query]:
    s = _seg

    def v(fn, *args):
        return _table("items", fn, *args)

    return {
        "q1_1_total": s(R.total_creators),
        "q1_2_niche": s(R.by_niche),
        "q1_3_deciles": s(R.subscriber_deciles),
        "q1_4_age": s(R.by_channel_age),
        "q1_5_cadence": s(R.by_cadence, SPEC),
        "q1_6_niche_ret": s(R.niche_retention),
        "q2_1_tier_revenue": s(R.tier_revenue, SPEC),
        "q2_2_concentration": s(R.revenue_concentration),
        "q2_3_tier_rpm": s(R.tier_rpm, SPEC),
        "q2_4_mid_tier": s(R.mid_tier, SPEC),
        "q2_5_tier_scatter": s(R.tier_scatter, SPEC),
        "q3_1_archetype": s(R.archetype_profile),
        "q3_2_head_to_head": s(R.head_to_head, SPEC),
        "q3_3_target_tiers": s(R.target_tiers, SPEC),
        "q3_4_crosstab": s(R.tier_archetype_crosstab, SPEC),
        "q3_5_target_niche": s(R.target_niches, SPEC),
        "q3_6_age": s(R.archetype_age),
        "q4_1_parity": s(R.parity_benchmark, SPEC),
        "q4_2_creator_gap": s(R.creator_gap, SPEC),
        "q4_3_headline": s(R.gap_headline, SPEC),
        "q4_4_gap_niche": s(R.gap_by_niche, SPEC),
        "q4_5_gap_subtier": s(R.gap_by_sub_tier, SPEC),
        "q4_6_video_buckets": v(R.video_retention_buckets, SPEC),
        "q5_1_broad_base": s(R.broad_base_check, SPEC),
        "q5_2_subtier_dir": s(R.sub_tier_direction, SPEC),
        "q5_3_age_confound": s(R.age_confound, SPEC),
        "q5_4_video_consistency": v(R.video_consistency, SPEC),
        "q5_5_trim_ntile": s(R.trim_by_ntile, SPEC),
        "q5_6_summary": s(R.validation_one_row, SPEC),
        "scalar_share": s(R.base_share, "niche_category"),
    }


def window_queries() -> dict[str, Query]:
    return {
        "win_ntile": _seg(win_ntile),
        "win_percent_rank": _seg(win_percent_rank),
        "win_total": _seg(win_total),
        "global_rank": _seg(global_rank),
    }


def cluster_queries() -> dict[str, Query]:
    return {
        "zscore": _seg(zscore),
        "centroid_distance": _seg(centroid_distance),
        "assign_clusters": _seg(assign_clusters),
        "update_centroids": _seg(update_centroids),
        "inertia": _seg(inertia),
        "name_clusters": _seg(name_clusters),
        "centroids_real": _seg(centroids_real),
        "silhouette_sample": _seg(silhouette_sample),
        "silhouette_linear": _seg(silhouette_linear),
        "cluster_summary": _seg(lambda s: SG.cluster_summary(_named(s))),
        "profile_minmax": _seg(lambda s: SG.profile_minmax(_named(s))),
        "scatter_feed": _seg(lambda s: SG.scatter_feed(_named(s))),
        "kmeans_fit": lambda spark, sf: _rounded(km.runs_frame(spark, fitted(spark, sf).runs)),
        "kmeans_history": lambda spark, sf: _rounded(km.history_frame(spark, fitted(spark, sf).best)),
        "segment_fit": lambda spark, sf: _rounded(fitted(spark, sf).summary()),
        "k_sweep": _seg(lambda seg: _rounded(S.k_sweep(seg))),
    }


def gap_queries() -> dict[str, Query]:
    return {
        "gap_export": _seg(
            lambda s: G.gap_export(s, SPEC).select(
                "creator_id", "archetype", "views_90d", "revenue_at_parity", "revenue_gap"
            )
        ),
        "gap_summary": _seg(G.gap_summary, SPEC),
        "gap_by_category": _seg(G.gap_by_category, SPEC),
        "gap_bridge": _seg(G.gap_bridge, SPEC),
        "gap_distribution": _seg(V.gap_distribution, SPEC),
    }


def validation_queries() -> dict[str, Query]:
    return {
        "trim_quantile": _seg(V.outlier_trim, SPEC),
        "broad_base": _seg(V.broad_base, SPEC),
        "stability_raw": _seg(stability_raw),
        "stability_labels": lambda spark, sf: fitted_runs(spark, sf).labels(),
        "stability_runs": lambda spark, sf: fitted_runs(spark, sf).raw(),
        "stability_aligned": lambda spark, sf: fitted_runs(spark, sf).aligned(),
        "seed_inertia": lambda spark, sf: _rounded(fitted_runs(spark, sf).inertia_table()),
        "inertia_cv": lambda spark, sf: _rounded(ST.inertia_cv(fitted_runs(spark, sf).inertia_table())),
        "validation_summary": validation_summary,
    }


def all_queries() -> dict[str, Query]:
    return {
        **source_queries(),
        **cleaning_queries(),
        **profile_queries(),
        **report_queries(),
        **window_queries(),
        **cluster_queries(),
        **gap_queries(),
        **validation_queries(),
    }
