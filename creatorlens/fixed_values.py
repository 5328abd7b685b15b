"""Label vocabularies, bin edges, thresholds and feature lists.

Everything here is configuration that must stay literally as it is for results
to be comparable. Logic lives elsewhere.
"""

from __future__ import annotations

# --- Fixed values: canonical niche label -> accepted spellings (lower case) ---
NICHE_SYNONYMS: dict[str, tuple[str, ...]] = {
    "Personal Finance": (
        "personal finance", "personal_finance", "fin", "personal fin.",
    ),
    "Tech Deep-Dive Reviews": (
        "tech reviews", "tech deep dive", "tech_reviews", "technology reviews",
    ),
    "Health & Fitness Coaching": (
        "health and fitness", "health&fitness", "health/fitness", "fitness",
    ),
    "Education / Test Prep": (
        "education", "edu / test prep", "education/testprep", "test prep",
    ),
    "DIY & Craft Tutorials": (
        "diy", "crafts", "diy & crafts", "diy/crafts",
    ),
    "Entertainment": ("entmt", "entertain."),
    "Gaming": ("games", "game content"),
    "Food & Cooking": ("food", "cooking", "food and cooking", "food/cook"),
    "Travel": ("travelling", "travel vlogs"),
    "Lifestyle": ("life style", "lifestyle"),
}

# --- Fixed values: canonical archetype label -> accepted spellings ---
ARCHETYPE_SYNONYMS: dict[str, tuple[str, ...]] = {
    "Subscriber Giants": (
        "subscriber giants", "sub giants", "subscribergiants",
    ),
    "High-Retention Niche Specialists": (
        "high retention niche specialists", "high-retention niche specialists",
        "hr niche specialists", "niche specialists",
    ),
    "Viral Spike Chasers": (
        "viral spike chasers", "viral chasers", "viralspikechaser", "spike chasers",
    ),
    "Consistent Volume Builders": (
        "consistent volume builders", "volume builders", "consistent builders", "cvb",
    ),
    "Emerging Dabblers": ("emerging dabblers", "dabblers", "new dabblers"),
}

# --- Fixed values: archetype labels by role ---
GIANTS = "Subscriber Giants"
SPECIALISTS = "High-Retention Niche Specialists"
VIRAL = "Viral Spike Chasers"
VOLUME = "Consistent Volume Builders"
DABBLERS = "Emerging Dabblers"

# --- Fixed values: bucket edges ---
TIER_EDGES = (1_000, 10_000, 100_000, 500_000)
SUB_TIER_EDGES = (10_000, 25_000, 50_000, 100_000)
CADENCE_EDGES = (2, 6, 12, 20)
VIDEO_RETENTION_EDGES = (20, 35, 50)

# --- Fixed values: labels of the intervals, lowest first ---
CADENCE_LABELS = (
    "A. Very Low  (<2/mo)",
    "B. Low       (2–6/mo)",
    "C. Medium    (6–12/mo)",
    "D. High      (12–20/mo)",
    "E. Very High (20+/mo)",
)
VIDEO_RETENTION_LABELS = (
    "D. Very Low (<20%)",
    "C. Low    (20–35%)",
    "B. Medium (35–50%)",
    "A. High   (50%+)",
)

# --- Fixed values: labels of report rows ---
TOP_DECILE = "Top 10% by revenue"
BOTTOM_HALF = "Bottom 50% by revenue"
GAP_POSITIVE = "positive"
GAP_NOT_POSITIVE = "zero / negative"
TRIM_RETAINED = "Retained (bottom 95%)"
TRIM_REMOVED = "Removed  (top 5% view-spike)"

# --- Fixed values: thresholds of the profiling zones and validation checks ---
HIGH_RETENTION_ZONE = (48.0, 80.0)
LOW_RPM_ZONE = (0.0, 2.0)
WEAK_CORRELATION = 0.3
HIGH_RETENTION_VIDEO = 45
TRIM_QUANTILE = 0.95
TRIM_PASS_PCT = 85.0
BROAD_BASE_PASS_PCT = 80.0
STABILITY_PASS_PCT = 85.0
STABILITY_RUNS = 20
STABILITY_AGREEMENT = 18

# --- Fixed values: column groups ---
CLUSTER_FEATURES = (
    "avg_retention_rate",
    "avg_ctr",
    "upload_freq_per_month",
    "avg_video_length_mins",
    "len_consistency_score",
)
PROFILE_FEATURES = (
    "avg_retention_rate",
    "avg_ctr",
    "upload_freq_per_month",
    "avg_video_length_mins",
    "rpm",
)
CORRELATION_COLUMNS = (
    "subscriber_count",
    "avg_retention_rate",
    "avg_ctr",
    "upload_freq_per_month",
    "avg_video_length_mins",
    "rpm",
    "revenue_90d",
)
CREATOR_IMPUTE_COLUMNS = (
    "avg_retention_rate",
    "avg_ctr",
    "rpm",
    "avg_video_length_mins",
    "upload_freq_per_month",
)
VIDEO_IMPUTE_COLUMNS = ("retention_rate", "ctr")
SEGMENT_EXPORT_COLUMNS = (
    "creator_id", "archetype", "subscriber_tier", "niche_category",
    "subscriber_count", "channel_age_years",
    "avg_retention_rate", "avg_ctr", "upload_freq_per_month",
    "avg_video_length_mins", "len_consistency_score",
    "rpm", "monthly_views", "views_90d",
    "revenue_90d", "revenue_at_parity", "revenue_gap",
)
