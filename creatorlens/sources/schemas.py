"""Explicit schemas; nothing in the library infers a schema from data."""

from __future__ import annotations

from pyspark.sql import types as T

CREATOR_MESSY_COLUMNS = (
    "creator_id", "archetype", "niche_category", "subscriber_count",
    "channel_age_years", "avg_retention_rate", "avg_ctr",
    "upload_freq_per_month", "avg_video_length_mins", "avg_video_len_std",
    "rpm", "monthly_views", "revenue_90d",
)
VIDEO_MESSY_COLUMNS = (
    "video_id", "creator_id", "publish_date", "video_length_mins", "views",
    "revenue", "retention_rate", "ctr", "rpm", "archetype",
)


def all_strings(columns) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), True) for c in columns])


_TYPES = {
    "bigint": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "date": T.DateType(),
}


def _schema(text: str) -> T.StructType:
    """'name type, ...' as a schema; needs no running session, unlike a DDL string."""
    pairs = (field.split() for field in text.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind], True) for name, kind in pairs])


CREATORS_MESSY = all_strings(CREATOR_MESSY_COLUMNS)
VIDEOS_MESSY = all_strings(VIDEO_MESSY_COLUMNS)

CREATORS_CLEAN = _schema(
    "creator_id bigint, archetype string, niche_category string, subscriber_count bigint, "
    "channel_age_years double, avg_retention_rate double, avg_ctr double, "
    "upload_freq_per_month double, avg_video_length_mins double, avg_video_len_std double, "
    "rpm double, monthly_views bigint, revenue_90d double, len_consistency_score double, "
    "subscriber_tier string"
)
VIDEOS_CLEAN = _schema(
    "video_id bigint, creator_id bigint, publish_date date, video_length_mins double, "
    "views bigint, revenue double, retention_rate double, ctr double, rpm double, "
    "archetype string"
)
CREATOR_SEGMENTS = _schema(
    "creator_id bigint, archetype string, subscriber_tier string, niche_category string, "
    "subscriber_count bigint, channel_age_years double, avg_retention_rate double, "
    "avg_ctr double, upload_freq_per_month double, avg_video_length_mins double, "
    "len_consistency_score double, rpm double, monthly_views bigint, views_90d bigint, "
    "revenue_90d double, revenue_at_parity double, revenue_gap double"
)
