"""Reports as SQL text over the tables ``creator_segments`` and ``videos``.

Roles and bins are parameters, so a statement holds for any SegmentSpec.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.sql import run_sql
from ..specs import DEFAULT_SPEC, SegmentSpec

GAP_BY_SUB_TIER = """
WITH parity AS (SELECT avg(rpm) AS rate FROM creator_segments WHERE archetype = :benchmark),
gaps AS (
  SELECT *, CASE
      WHEN subscriber_count IS NULL THEN element_at(:labels, -1)
      ELSE element_at(:labels, 1 + size(filter(:edges, e -> subscriber_count >= e)))
    END AS sub_tier,
    views_90d * (SELECT rate FROM parity) / 1000D - revenue_90d AS difference
  FROM creator_segments WHERE archetype = :target
)
SELECT sub_tier, count(*) AS n_creators,
  round(avg(avg_retention_rate), 2) AS avg_retention, round(avg(rpm), 2) AS avg_rpm,
  round(avg(CASE WHEN difference > 0 THEN difference WHEN difference <= 0 THEN 0D END), 0) AS avg_gap_per_creator,
  round(sum(CASE WHEN difference > 0 THEN difference WHEN difference <= 0 THEN 0D END), 0) AS total_gap
FROM gaps GROUP BY sub_tier ORDER BY sub_tier
"""

VIDEO_BUCKETS = """
WITH bucketed AS (
  SELECT *, CASE
      WHEN retention_rate IS NULL THEN element_at(:labels, 1)
      ELSE element_at(:labels, 1 + size(filter(:edges, e -> retention_rate >= e)))
    END AS retention_bucket
  FROM videos
)
SELECT retention_bucket, count(*) AS n_videos, round(avg(rpm), 2) AS avg_rpm,
  round(avg(revenue / nullif(views, 0) * 1000D), 4) AS revenue_per_1000_views,
  round(avg(double(views)), 0) AS avg_views_per_video
FROM bucketed GROUP BY retention_bucket ORDER BY retention_bucket
"""


def gap_by_sub_tier(segments: DataFrame, spec: SegmentSpec = DEFAULT_SPEC) -> DataFrame:
    params = {"benchmark": spec.benchmark, "target": spec.target, "edges": spec.sub_tier_edges, "labels": spec.sub_tier_labels()}
    return run_sql(segments.sparkSession, GAP_BY_SUB_TIER, params, creator_segments=segments)


def video_buckets(videos: DataFrame, spec: SegmentSpec = DEFAULT_SPEC) -> DataFrame:
    params = {"edges": spec.video_retention_edges, "labels": spec.video_retention_labels}
    return run_sql(videos.sparkSession, VIDEO_BUCKETS, params, videos=videos)
