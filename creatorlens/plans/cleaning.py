"""Cleaning jobs: all-text exports to typed, deduplicated, imputed tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import (
    age_years,
    bucketize,
    clip,
    duration_minutes,
    lenient_double,
    lenient_long,
    parse_count,
    parse_currency,
    parse_date,
    parse_rate,
    parse_views,
    round_float,
    round_scaled,
    strip,
)
from ..operators.dedup import keep_first, repeated_keys
from ..operators.impute import impute_group_median
from ..operators.lookup import normalize_labels
from ..operators.quantile import GROUP_LIMIT
from ..session import materialize
from ..sources.readers import POSITION
from ..specs import DEFAULT_SPEC, SegmentSpec

# typed value of each raw creator / video column
CREATOR_PARSERS = {
    "subscriber_count": parse_count,
    "revenue_90d": parse_currency,
    "channel_age_years": age_years,
    "upload_freq_per_month": parse_rate,
    "avg_retention_rate": lenient_double,
    "avg_ctr": lenient_double,
    "avg_video_length_mins": lenient_double,
    "avg_video_len_std": lenient_double,
    "rpm": lenient_double,
    "monthly_views": lenient_long,
}
VIDEO_PARSERS = {
    "publish_date": parse_date,
    "video_length_mins": duration_minutes,
    "views": parse_views,
    "revenue": lenient_double,
    "retention_rate": lenient_double,
    "ctr": lenient_double,
    "rpm": lenient_double,
}


def strip_strings(df: DataFrame) -> DataFrame:
    """Trim Unicode white space in every text column."""
    text = {n for n, t in df.dtypes if t == "string"}
    return df.select(*[strip(F.col(c)).alias(c) if c in text else F.col(c) for c in df.columns])


# columns rounded after parsing
ROUNDED = {"channel_age_years": 2, "video_length_mins": 2}


def parse_columns(df: DataFrame, parsers: dict) -> DataFrame:
    """Typed columns. Rounding uses its input many times, so it gets a projection
    of its own and every text is parsed once."""
    typed = df.select(
        *[parsers[c](F.col(c)).alias(c) if c in parsers else F.col(c) for c in df.columns]
    )
    digits = {c: d for c, d in ROUNDED.items() if c in parsers and c in df.columns}
    if not digits:
        return typed
    return typed.withColumns({c: round_float(F.col(c), d) for c, d in digits.items()})


def null_invalid(df: DataFrame) -> DataFrame:
    """Impossible readings become null: retention above 100, negative rpm."""
    return df.withColumns(
        {
            "avg_retention_rate": F.when(
                F.col("avg_retention_rate") <= 100, F.col("avg_retention_rate")
            ),
            "rpm": F.when(F.col("rpm") >= 0, F.col("rpm")),
        }
    )


def len_consistency(df: DataFrame, digits: int | None = 1) -> Column:
    """100 minus the length spread as a percentage of the largest spread, in [0, 100]."""
    largest = df.agg(F.max("avg_video_len_std").alias("m")).scalar()
    share = F.col("avg_video_len_std") / F.nullif(largest, F.lit(0.0)) * F.lit(100.0)
    score = clip(F.lit(100.0) - share, 0, 100)
    return score if digits is None else round_scaled(score, digits)


def tier_label(spec: SegmentSpec = DEFAULT_SPEC) -> Column:
    """Stored tier: right-closed bins, no tier at or below zero."""
    return bucketize(
        F.col("subscriber_count"), spec.tier_edges, spec.tier_labels(), closed="right", floor=0
    )


def require_ids(df: DataFrame, column: str) -> DataFrame:
    """Strict integer ids: bad or missing text fails the job."""
    value = F.col(column).cast("bigint")
    checked = F.when(value.isNotNull(), value).otherwise(
        F.raise_error(F.lit(f"{column} must be present")).cast("bigint")
    )
    return df.withColumn(column, checked)


@dataclass
class Cleaned:
    """A clean table with its stages and the counts of its ledger."""

    raw: DataFrame
    staged: DataFrame  # one typed row per id, flags kept, nothing dropped yet
    clean: DataFrame
    counts: dict[str, int]  # rows per step; "rows" staged and "kept" of them


def _stage(raw: DataFrame, key: str, typed: Callable[[DataFrame], DataFrame], counts: dict[str, Column], label: str):
    """The stored staged table, and its counts, taken while it is written.

    The counts stand on top of the plan, so they belong to the tasks that write the files: each
    counts once, also when executors are lost. Duplicates come from the counted repeated keys, so
    the raw table is not read for them.
    """
    rows = strip_strings(raw)
    repeated = repeated_keys(rows, [key])
    staged = typed(keep_first(rows, [key], POSITION, repeated=repeated).drop(POSITION))
    seen = Observation(label)
    stored = materialize(staged.observe(seen, *[c.cast("bigint").alias(name) for name, c in counts.items()]), label)
    dropped = repeated.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0))).first()[0]
    # a plan without rows may be replaced by an empty one that counts nothing
    found = dict.fromkeys(counts, 0) if stored.isEmpty() else {name: n or 0 for name, n in seen.get.items()}
    return stored, {"duplicates_dropped": dropped, **found}


def _typed_creators(df: DataFrame) -> DataFrame:
    """Labels normalised, columns parsed; impossible values flagged and nulled."""
    df = normalize_labels(df, "niche_category", fv.NICHE_SYNONYMS)
    df = normalize_labels(df, "archetype", fv.ARCHETYPE_SYNONYMS)
    df = parse_columns(df, CREATOR_PARSERS)
    df = df.withColumns(
        {
            "_bad_retention": F.coalesce(F.col("avg_retention_rate") > 100, F.lit(False)),
            "_bad_rpm": F.coalesce(F.col("rpm") < 0, F.lit(False)),
            "_zero_subs": F.coalesce(F.col("subscriber_count") == 0, F.lit(False)),
        }
    )
    return null_invalid(df)


def _creator_counts() -> dict[str, Column]:
    live = F.coalesce(F.col("subscriber_count") != 0, F.lit(False))
    return {
        "retention_nulled": F.count_if("_bad_retention"),
        "rpm_nulled": F.count_if("_bad_rpm"),
        "zero_subscribers_dropped": F.count_if("_zero_subs"),
        "unknown_subscribers_dropped": F.count_if(F.col("subscriber_count").isNull()),
        **{f"imputed_{c}": F.count_if(live & F.col(c).isNull()) for c in fv.CREATOR_IMPUTE_COLUMNS},
        "rows": F.count("*"),
        "kept": F.count_if(live),
    }


def _video_counts() -> dict[str, Column]:
    return {
        "dates_unparsable": F.count_if(F.col("publish_date").isNull()),
        "chargebacks_dropped": F.count_if("_chargeback"),
        **{f"imputed_{c}": F.count_if(~F.col("_chargeback") & F.col(c).isNull()) for c in fv.VIDEO_IMPUTE_COLUMNS},
        "rows": F.count("*"),
        "kept": F.count_if(~F.col("_chargeback")),
    }


def clean_creators(
    raw: DataFrame, spec: SegmentSpec = DEFAULT_SPEC, limit: int = GROUP_LIMIT
) -> Cleaned:
    """Raw text creators to the clean table.

    The staged rows feed the medians, the largest spread and the final
    projection, so they are stored once after the dedup shuffle.
    """
    staged, counts = _stage(raw, "creator_id", _typed_creators, _creator_counts(), "creators-staged")
    kept = staged.filter(F.col("subscriber_count") != 0).drop(
        "_bad_retention", "_bad_rpm", "_zero_subs"
    )
    full = impute_group_median(kept, "archetype", fv.CREATOR_IMPUTE_COLUMNS, 2, limit)
    out = full.withColumn("len_consistency_score", len_consistency(kept)).withColumn(
        "subscriber_tier", tier_label(spec)
    )
    return Cleaned(raw, staged, require_ids(out, "creator_id"), counts)


def clean_videos(
    raw: DataFrame, normalize_archetype: bool = True, limit: int = GROUP_LIMIT
) -> Cleaned:
    """Raw text videos to the clean table; rows without revenue are kept."""

    def typed(df: DataFrame) -> DataFrame:
        if normalize_archetype and "archetype" in df.columns:
            df = normalize_labels(df, "archetype", fv.ARCHETYPE_SYNONYMS)
        df = parse_columns(df, VIDEO_PARSERS)
        return df.withColumn("_chargeback", F.coalesce(F.col("revenue") < 0, F.lit(False)))

    staged, counts = _stage(raw, "video_id", typed, _video_counts(), "videos-staged")
    kept = staged.filter(~F.col("_chargeback")).drop("_chargeback")
    full = impute_group_median(kept, "creator_id", fv.VIDEO_IMPUTE_COLUMNS, 2, limit)
    out = full.withColumns(
        {c: lenient_long(F.col(c)) for c in ("video_id", "creator_id")}
    )
    return Cleaned(raw, staged, out, counts)


def chargebacks(staged: DataFrame) -> DataFrame:
    """The refund rows that :func:`clean_videos` leaves out."""
    return staged.filter("_chargeback").drop("_chargeback")


def cleaning_ledger(creators: Cleaned, videos: Cleaned) -> DataFrame:
    """(table_name, step, n_rows): rows dropped, nulled or imputed per step, as counted when the
    staged tables were written."""
    rows = [
        (name, step, n)
        for name, c in (("creators", creators), ("videos", videos))
        for step, n in c.counts.items()
        if step not in ("rows", "kept")
    ]
    return creators.staged.sparkSession.createDataFrame(rows, "table_name string, step string, n_rows bigint")


def cleaning_summary(creators: Cleaned, videos: Cleaned) -> DataFrame:
    """(table_name, n_before, n_after, n_dropped), as counted when the staged tables were written."""
    rows = []
    for name, c in (("creators", creators), ("videos", videos)):
        before, after = c.counts["rows"] + c.counts["duplicates_dropped"], c.counts["kept"]
        rows.append((name, before, after, before - after))
    return creators.staged.sparkSession.createDataFrame(rows, "table_name string, n_before bigint, n_after bigint, n_dropped bigint")
