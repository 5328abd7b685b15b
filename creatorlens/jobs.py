"""The pipeline as separate jobs that hand over stored tables.

    python -m creatorlens.jobs clean    --data DIR
    python -m creatorlens.jobs profile  --data DIR
    python -m creatorlens.jobs segment  --data DIR
    python -m creatorlens.jobs gap      --data DIR
    python -m creatorlens.jobs validate --data DIR
    python -m creatorlens.jobs sql      --data DIR --query FILE [--param NAME=VALUE ...]

``DIR`` holds ``creators_messy.csv`` and ``videos_messy.csv`` (files or
folders) and receives the results. ``--csv`` also writes headered CSV.

``sql`` runs one statement over the stored tables ``creators``, ``videos`` and, once there is one,
``creator_segments``; ``:NAME`` in it takes the text of the parameter.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixed_values as fv
from .operators import gap as G
from .operators import profile as P
from .operators import segments as SG
from .plans import cleaning as C
from .plans import reports as R
from .plans import segmentation as S
from .plans import validation as V
from .session import build_session, drop_scratch, materialize
from .sources import schemas
from .sources.readers import MissingInputError, read_strings, read_typed, write_table
from .sources.sql import run_sql
from .specs import DEFAULT_SPEC, SegmentSpec


def _save(df: DataFrame, data: str, name: str, csv: bool) -> None:
    write_table(df, f"{data}/{name}")
    if csv:
        write_table(read_typed(df.sparkSession, f"{data}/{name}", df.schema), f"{data}/{name}_csv", "csv")


def load_clean(spark: SparkSession, data: str) -> tuple[DataFrame, DataFrame]:
    return (
        read_typed(spark, f"{data}/creators_clean", schemas.CREATORS_CLEAN, made_by="the clean job"),
        read_typed(spark, f"{data}/videos_clean", schemas.VIDEOS_CLEAN, made_by="the clean job"),
    )


def load_segments(spark: SparkSession, data: str) -> DataFrame:
    return read_typed(
        spark, f"{data}/creator_segments", schemas.CREATOR_SEGMENTS, made_by="the segment job"
    )


def clean(spark: SparkSession, data: str, csv: bool = False, spec: SegmentSpec = DEFAULT_SPEC) -> dict:
    creators = C.clean_creators(
        read_strings(spark, f"{data}/creators_messy.csv", schemas.CREATORS_MESSY), spec
    )
    videos = C.clean_videos(read_strings(spark, f"{data}/videos_messy.csv", schemas.VIDEOS_MESSY))
    _save(creators.clean.select(*schemas.CREATORS_CLEAN.names), data, "creators_clean", csv)
    _save(videos.clean.select(*schemas.VIDEOS_CLEAN.names), data, "videos_clean", csv)
    return {
        "ledger": C.cleaning_ledger(creators, videos),
        "summary": C.cleaning_summary(creators, videos),
        "audit_before": P.null_audit(creators.raw),
        "audit_after": P.null_audit(load_clean(spark, data)[0]),
    }


def profile(spark: SparkSession, data: str, spec: SegmentSpec = DEFAULT_SPEC) -> dict:
    creators, videos = load_clean(spark, data)
    mid = F.coalesce(F.col("subscriber_tier") == spec.tier_labels()[2], F.lit(False))
    return {
        "shape": P.table_shape(creators=creators, videos=videos),
        "nulls": P.null_audit(creators),
        "tiers": P.tier_share(creators, "subscriber_tier", spec.tier_labels()[::-1], "revenue_90d"),
        "moments": P.feature_moments(creators, fv.PROFILE_FEATURES),
        "correlations": P.corr_matrix(creators, fv.CORRELATION_COLUMNS),
        "scale_vs_quality": P.corr_verdict(
            creators, "subscriber_count", "avg_retention_rate", fv.WEAK_CORRELATION
        ),
        "zones": P.zone_counts(
            creators, "avg_retention_rate", fv.HIGH_RETENTION_ZONE, "rpm", fv.LOW_RPM_ZONE
        ),
        "mid_tier_spread": P.subset_spread(creators, mid, "avg_retention_rate"),
        "mid_tier_inside": P.histogram(creators.filter(mid), "avg_retention_rate", 40),
        "mid_tier_outside": P.histogram(creators.filter(~mid), "avg_retention_rate", 40),
        "histograms": P.histograms(creators, fv.PROFILE_FEATURES, 40),
    }


def segment(spark: SparkSession, data: str, csv: bool = False, k: int = 5, n_init: int = 20,
            sweep: bool = True, spec: SegmentSpec = DEFAULT_SPEC) -> dict:
    creators, _ = load_clean(spark, data)
    out = {"k_sweep": S.k_sweep(creators)} if sweep else {}
    seg = S.segment(creators, k=k, n_init=n_init)
    _save(S.export(seg, spec), data, "creator_segments", csv)
    out |= {
        "fit": seg.summary(),
        "centroids": S.centroid_table(seg),
        "clusters": SG.cluster_summary(seg.named),
        "profiles": SG.profile_minmax(seg.named),
    }
    return out


def gap(spark: SparkSession, data: str, spec: SegmentSpec = DEFAULT_SPEC) -> dict:
    segments = load_segments(spark, data)
    return {
        "headline": R.gap_headline(segments, spec),
        "summary": G.gap_summary(segments, spec),
        "by_category": G.gap_by_category(segments, spec),
        "by_sub_tier": R.gap_by_sub_tier(segments, spec),
        "bridge": G.gap_bridge(segments, spec),
        "distribution": V.gap_distribution(segments, spec),
    }


def validate(spark: SparkSession, data: str, spec: SegmentSpec = DEFAULT_SPEC) -> dict:
    segments = load_segments(spark, data)
    creators, _ = load_clean(spark, data)
    runs = V.stability_runs(creators)
    stability = materialize(runs.raw(), "stability")
    return {
        "outlier_trim": V.outlier_trim(segments, spec),
        "broad_base": V.broad_base(segments, spec),
        "inertia": runs.inertia_table(),
        "stability": stability,
        "stability_aligned": runs.aligned(),
        "summary": V.summary(segments, stability, spec),
    }


def sql(spark: SparkSession, data: str, query: str, params: dict[str, str] | None = None) -> dict:
    """The result of one SQL statement over the stored tables."""
    creators, videos = load_clean(spark, data)
    tables = {"creators": creators, "videos": videos}
    try:
        tables["creator_segments"] = load_segments(spark, data)
    except MissingInputError:
        pass  # a statement that asks for it fails with its name
    return {"result": run_sql(spark, query, params, **tables)}


SHOWN = 40  # rows of a result that the command line prints

JOBS = {"clean": clean, "profile": profile, "segment": segment, "gap": gap, "validate": validate, "sql": sql}


def store_results(results: dict[str, DataFrame], data: str, job: str) -> dict[str, DataFrame]:
    """Write every result whole below the data folder; the frames read what was written."""
    out = {}
    for name, df in results.items():
        path = f"{data}/results/{job}/{name}"
        write_table(df, path)
        out[name] = df.sparkSession.read.parquet(path)
    return out


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawTextHelpFormatter)
    p.add_argument("job", choices=JOBS)
    p.add_argument("--data", required=True)
    p.add_argument("--master", default=None)
    p.add_argument("--csv", action="store_true")
    p.add_argument("--query", type=argparse.FileType("r", encoding="utf-8"))
    p.add_argument("--param", action="append", default=[], metavar="NAME=VALUE")
    a = p.parse_args(argv)
    if (a.job == "sql") != (a.query is not None):
        p.error("sql needs --query, and only sql takes it")
    spark = build_session(f"creatorlens-{a.job}", a.master)
    extra = {"csv": a.csv} if a.job in ("clean", "segment") else {}
    if a.job == "sql":
        extra = {"query": a.query.read(), "params": dict(x.split("=", 1) for x in a.param)}
    for name, df in store_results(JOBS[a.job](spark, a.data, **extra), a.data, a.job).items():
        n = df.count()
        print(f"\n{name}: {n} rows in {a.data}/results/{a.job}/{name}" + (f", first {SHOWN}" if n > SHOWN else ""))
        df.show(SHOWN, truncate=False)
    drop_scratch(spark)


if __name__ == "__main__":
    main()
