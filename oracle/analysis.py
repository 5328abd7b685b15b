"""Oracle SQL of profiling, windows, clustering steps, gap and validation."""

from __future__ import annotations

from .base import GAPS, SEGMENTS, pct
from .cleaning import gap_export
from .reports import share

PROFILE = ("avg_retention_rate", "avg_ctr", "upload_freq_per_month", "avg_video_length_mins", "rpm")
CORR = (
    "subscriber_count", "avg_retention_rate", "avg_ctr", "upload_freq_per_month",
    "avg_video_length_mins", "rpm", "revenue_90d",
)
FEATURES = (
    "avg_retention_rate", "avg_ctr", "upload_freq_per_month", "avg_video_length_mins",
    "len_consistency_score",
)
SEGMENT_COLS = (
    "creator_id", "archetype", "niche_category", "subscriber_count", "channel_age_years",
    "avg_retention_rate", "avg_ctr", "upload_freq_per_month", "avg_video_length_mins",
    "avg_video_len_std", "monthly_views", "revenue_90d", "views_90d", "rpm", "subscriber_tier",
    "len_consistency_score",
)
# --- Fixed values: reference centroids in z-score units ---
CENTROIDS = (
    (1.0, 0.5, 0.0, 0.0, 0.0),
    (-0.5, 1.0, 0.5, 0.0, 0.0),
    (0.0, -0.5, 1.0, 0.5, -0.5),
    (0.0, 0.0, -0.5, 1.0, 0.5),
    (-0.5, -0.5, -0.5, -0.5, 0.5),
)
TIERS = ["Mega (400K+)", "Large (250K-400K)", "Mid (100K-250K)", "Small (25K-100K)", "Micro (<25K)"]


def _dist(c) -> str:
    terms = [f"(f{j} - ({v!r})::DOUBLE) * (f{j} - ({v!r})::DOUBLE)" for j, v in enumerate(c)]
    return f"sqrt({' + '.join(terms)})"


def _nearest(centroids) -> str:
    d = ", ".join(_dist(c) for c in centroids)
    return f"CAST(list_position([{d}], list_min([{d}])) - 1 AS INT)"


_complete = " AND ".join(f"{c} IS NOT NULL" for c in FEATURES)
_stats = ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(FEATURES))
_z = ", ".join(
    f"({c} - m{i}) / (CASE WHEN s{i} = 0 THEN 1 ELSE s{i} END) AS f{i}" for i, c in enumerate(FEATURES)
)
POINTS = SEGMENTS + f""",
whole AS (SELECT * FROM segments WHERE {_complete}),
st AS (SELECT {_stats} FROM whole),
points AS (SELECT whole.*, {_z} FROM whole, st),
assigned AS (SELECT *, {_nearest(CENTROIDS)} AS cluster FROM points)"""


def _argmax(j: int) -> int:
    return max(range(len(CENTROIDS)), key=lambda c: (CENTROIDS[c][j], -c))


# roles by centroid position are constants of the fixed centroids; giants come from the data
NAMED = POINTS + f""",
giants AS (SELECT cluster FROM assigned GROUP BY cluster ORDER BY avg(subscriber_count) DESC, cluster LIMIT 1),
roles AS (SELECT c, CASE WHEN c = {_argmax(2)} THEN 'Consistent Volume Builders'
    WHEN c = {_argmax(1)} THEN 'Viral Spike Chasers'
    WHEN c = {_argmax(0)} THEN 'High-Retention Niche Specialists'
    WHEN c = (SELECT cluster FROM giants) THEN 'Subscriber Giants' END AS role
  FROM (SELECT unnest([0, 1, 2, 3, 4]) AS c)),
names AS (SELECT CAST(c AS INT) AS cluster, coalesce(role,
    CASE WHEN c = (SELECT min(c) FROM roles WHERE role IS NULL) THEN 'Emerging Dabblers'
         ELSE 'Cluster_' || c END) AS archetype FROM roles),
named AS (SELECT a.* EXCLUDE (archetype), n.archetype FROM assigned a JOIN names n USING (cluster))"""


def _shifted(runs: int = 20):
    sets = [
        [[v + 0.01 * r * (1 if j % 2 == 0 else -1) for j, v in enumerate(c)] for c in CENTROIDS]
        for r in range(runs)
    ]
    sets[-1] = sets[-1][1:] + sets[-1][:1]
    return sets


def _stability() -> str:
    labels = ", ".join(_nearest(s) for s in _shifted())
    hits = ", ".join(f"len(list_filter(l, lambda x: x = {k}))" for k in range(5))
    return f"""WITH {POINTS}, lab AS (SELECT [{labels}] AS l FROM points),
        m AS (SELECT greatest({hits}) AS modal FROM lab)
        SELECT count(*) AS n, count(*) FILTER (WHERE modal >= 18) AS n_stable,
          round(avg(CASE WHEN modal >= 18 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END), 1) AS pct_stable
        FROM m"""


def _hist(table: str, col: str, bins: int, extra: str = "") -> str:
    """Rows of (bin, lo, hi, n) over a non-constant column."""
    return f"""SELECT {extra} CAST(b.bin AS INT) AS bin,
        e.a + (e.z - e.a) / {bins}e0 * b.bin AS lo, e.a + (e.z - e.a) / {bins}e0 * (b.bin + 1) AS hi,
        coalesce(c.n, 0) AS n
      FROM (SELECT unnest(range({bins})) AS bin) b
      CROSS JOIN (SELECT CAST(min({col}) AS DOUBLE) AS a, CAST(max({col}) AS DOUBLE) AS z FROM {table}) e
      LEFT JOIN (SELECT least(CAST(floor(({col} - (SELECT CAST(min({col}) AS DOUBLE) FROM {table}))
            / (SELECT CAST(max({col}) - min({col}) AS DOUBLE) FROM {table}) * {bins}) AS INT), {bins - 1}) AS bin,
            count(*) AS n FROM {table} WHERE {col} IS NOT NULL GROUP BY 1) c ON b.bin = c.bin"""


def _median(table: str, col: str) -> str:
    return f"(SELECT median({col}) FROM {table})"


def analysis() -> dict[str, str]:
    seg, gap, pts = f"WITH {SEGMENTS} ", f"WITH {GAPS} ", f"WITH {POINTS} "
    q = {}
    q["null_audit"] = seg + "SELECT * FROM (" + " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) - count({c}) AS n_null,
            round({pct(f"count(*) - count({c})", "count(*)")}, 1) AS pct_null FROM segments"""
        for c in SEGMENT_COLS
    ) + ") WHERE n_null > 0"
    q["table_shape"] = """SELECT 'creators' AS table_name, count(*) AS n_rows,
        CAST(16 AS INT) AS n_cols FROM orders
        UNION ALL SELECT 'videos', count(*), CAST(10 AS INT) FROM lineitem"""
    q["feature_moments"] = seg + " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, round(skewness({c}), 3) AS skew,
            round(median({c}), 2) AS median FROM segments""" for c in PROFILE
    )
    q["histogram"] = seg + " UNION ALL ".join(
        f"""SELECT feature, bin, round(lo, 8) AS lo, round(hi, 8) AS hi, n
            FROM ({_hist("segments", c, 40, f"'{c}' AS feature,")})""" for c in PROFILE
    )
    q["corr_matrix"] = seg + " UNION ALL ".join(
        f"""SELECT '{a}' AS a, '{b}' AS b, {'round(corr(' + a + ', ' + b + '), 3) + 0.0' if a != b
            else 'any_value(1.0::DOUBLE)'} AS r FROM segments"""
        for a in CORR for b in CORR
    )
    q["corr_verdict"] = seg + """SELECT 'subscriber_count' AS a, 'avg_retention_rate' AS b,
        round(corr(subscriber_count, avg_retention_rate), 3) + 0.0 AS r,
        CASE WHEN abs(round(corr(subscriber_count, avg_retention_rate), 3)) < 0.3
             THEN 'weak' ELSE 'not weak' END AS verdict FROM segments"""
    q["zone_counts"] = seg + """SELECT coalesce(avg_retention_rate BETWEEN 48 AND 80, false) AS in_x_zone,
        coalesce(rpm BETWEEN 0 AND 6000, false) AS in_y_zone, count(*) AS n
        FROM segments GROUP BY 1, 2"""
    mid = "coalesce(subscriber_tier = 'Mid (100K-250K)', false)"
    q["tier_internal_std"] = seg + f"""SELECT count(*) FILTER (WHERE {mid}) AS n_inside,
        count(*) FILTER (WHERE NOT {mid}) AS n_outside,
        round(stddev_samp(avg_retention_rate) FILTER (WHERE {mid}), 2) AS std_inside,
        round(avg(avg_retention_rate) FILTER (WHERE {mid}), 2) AS mean_inside,
        round(avg(avg_retention_rate) FILTER (WHERE NOT {mid}), 2) AS mean_outside FROM segments"""
    order = ", ".join(f"({i}, '{t}')" for i, t in enumerate(TIERS))
    q["tier_share"] = seg + f""", ord(tier_rank, tier) AS (VALUES {order}),
        agg AS (SELECT subscriber_tier, count(*) AS n, avg(revenue_90d) AS a, sum(revenue_90d) AS s
                FROM segments WHERE subscriber_tier IS NOT NULL GROUP BY 1)
        SELECT CAST(tier_rank AS INT) AS tier_rank, tier AS subscriber_tier, n AS n_creators,
          round(a, 2) AS avg_rev, round(s, 2) AS total_rev,
          round({pct("n", "(SELECT sum(n) FROM agg)")}, 2) AS pct_creators,
          round({pct("s", "(SELECT sum(s) FROM agg)")}, 2) AS pct_revenue
        FROM ord LEFT JOIN agg ON tier = subscriber_tier"""
    q["scalar_share"] = seg + f"""SELECT niche_category, count(*) AS n,
        {share("count(*)", "(SELECT count(*) FROM segments)")} AS pct_of_base
        FROM segments GROUP BY 1"""
    q["win_ntile"] = seg + """SELECT creator_id, subscriber_count,
        CAST(ntile(10) OVER (ORDER BY subscriber_count NULLS FIRST, creator_id) AS INT) AS decile
        FROM segments"""
    q["win_percent_rank"] = seg + """SELECT creator_id, revenue_90d,
        percent_rank() OVER (ORDER BY revenue_90d NULLS FIRST) AS pct_rank FROM segments"""
    q["win_total"] = seg + "SELECT creator_id, views_90d, count(*) OVER () AS cnt FROM segments"
    q["global_rank"] = seg + """SELECT creator_id, views_90d,
        rank() OVER (ORDER BY views_90d NULLS FIRST) AS rnk, count(*) OVER () AS n_total,
        row_number() OVER (ORDER BY views_90d NULLS FIRST, creator_id) AS rn FROM segments"""
    f_cols = [f"f{j}" for j in range(5)]
    q["zscore"] = pts + f"""SELECT creator_id,
        {", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in f_cols)} FROM points"""
    q["centroid_distance"] = pts + f"""SELECT creator_id,
        {", ".join(f"round({_dist(c)}, 6) AS d{i}" for i, c in enumerate(CENTROIDS))} FROM points"""
    q["assign_clusters"] = pts + "SELECT creator_id, cluster FROM assigned"
    q["update_centroids"] = pts + f"""SELECT cluster, count(*) AS n,
        {", ".join(f"round(avg({c}), 6) + 0.0 AS {c}" for c in f_cols)} FROM assigned GROUP BY 1"""
    nearest2 = "list_min([" + ", ".join(_dist(c) for c in CENTROIDS) + "])"
    q["inertia"] = pts + f"SELECT round(sum({nearest2} * {nearest2}), 3) AS inertia FROM points"
    named = f"WITH {NAMED} "
    q["name_clusters"] = named + "SELECT cluster, archetype FROM names"
    q["centroids_real"] = pts + " UNION ALL ".join(
        f"SELECT CAST({i} AS INT) AS cluster, "
        + ", ".join(
            f"round(({v!r})::DOUBLE * s{j} + m{j}, 6) AS {f}" for j, (v, f) in enumerate(zip(c, FEATURES))
        ) + " FROM st"
        for i, c in enumerate(CENTROIDS)
    )
    sq = " + ".join(f"(a.f{j} - b.f{j}) * (a.f{j} - b.f{j})" for j in range(5))
    q["silhouette_sample"] = pts + f""", smp AS (SELECT creator_id, cluster, {", ".join(f_cols)}
          FROM assigned ORDER BY md5(creator_id || ':0'), creator_id LIMIT 500),
        d AS (SELECT a.creator_id AS i, a.cluster AS own, b.cluster AS other, count(*) AS n,
                sum(sqrt({sq})) AS total FROM smp a CROSS JOIN smp b GROUP BY 1, 2, 3),
        p AS (SELECT i, max(CASE WHEN own = other THEN n END) AS n_own,
                max(CASE WHEN own = other THEN total END) AS s_own,
                min(CASE WHEN own <> other THEN total / n END) AS b FROM d GROUP BY 1),
        s AS (SELECT CASE WHEN n_own <= 1 OR b IS NULL THEN 0.0
                ELSE (b - s_own / (n_own - 1)) / greatest(b, s_own / (n_own - 1)) END AS score
              FROM p)
        SELECT count(*) AS n_scored, round(avg(score), 6) AS silhouette FROM s"""
    q["silhouette_linear"] = q["silhouette_sample"].replace("smp a CROSS JOIN smp b", "smp a CROSS JOIN assigned b")
    q["cluster_summary"] = named + """SELECT archetype, count(creator_id) AS n,
        round(avg(avg_retention_rate), 2) AS avg_retention, round(avg(avg_ctr), 2) AS avg_ctr,
        round(avg(rpm), 2) AS avg_rpm FROM named GROUP BY archetype"""
    means = ", ".join(f"avg({c}) AS {c}" for c in FEATURES)
    scaled = ", ".join(
        f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER () + 1e-9), 6) AS {c}"
        for c in FEATURES
    )
    q["profile_minmax"] = named + f""", prof AS (SELECT archetype, {means} FROM named GROUP BY 1)
        SELECT archetype, {scaled} FROM prof"""
    q["scatter_feed"] = named + "SELECT creator_id, archetype, avg_ctr, avg_retention_rate FROM named"
    q["gap_export"] = gap_export()
    rev_all = "(SELECT sum(revenue_90d) FROM segments)"
    q["gap_summary"] = gap + f"""SELECT count(*) AS n_creators, round(max(parity_rpm), 4) AS parity_rpm,
        round(avg(revenue_90d), 2) AS avg_current, round(avg(revenue_at_parity), 2) AS avg_parity,
        round(avg(gap), 2) AS avg_gap, round(sum(gap), 2) AS total_gap,
        {share("sum(gap)", rev_all)} AS pct_of_platform FROM gaps"""
    q["gap_by_category"] = gap + f"""SELECT niche_category, count(creator_id) AS n_creators,
        round(sum(revenue_90d), 0) AS current_rev, round(sum(revenue_at_parity), 0) AS parity_rev,
        round(sum(gap), 0) AS gap, {share("sum(gap)", "(SELECT sum(gap) FROM gaps)")} AS gap_pct
        FROM gaps GROUP BY 1"""
    q["gap_bridge"] = gap + """SELECT round(sum(revenue_90d), 2) AS current_revenue,
        round(sum(gap), 2) AS unrealised_gap,
        round(sum(revenue_90d) + sum(gap), 2) AS parity_target FROM gaps"""
    q["gap_distribution"] = gap + f"""SELECT bin, round(lo, 2) AS lo, round(hi, 2) AS hi, n,
        round({_median("gaps", "gap")}, 2) AS median_gap,
        round((SELECT avg(gap) FROM gaps), 2) AS mean_gap FROM ({_hist("gaps", "gap", 35)})"""
    q["trim_quantile"] = gap + f""", cut AS (SELECT quantile_cont(CAST(views_90d AS DOUBLE), 0.95) AS c FROM gaps),
        m AS (SELECT count(*) - count(*) FILTER (WHERE views_90d <= (SELECT c FROM cut)) AS n_removed,
            sum(gap) AS full_gap, sum(gap) FILTER (WHERE views_90d <= (SELECT c FROM cut)) AS kept FROM gaps)
        SELECT n_removed, round(full_gap, 0) AS gap_before, round(kept, 0) AS gap_after,
          round({pct("kept", "full_gap")}, 1) AS pct_retained,
          CASE WHEN {pct("kept", "full_gap")} >= 85 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM m"""
    base = "avg(CASE WHEN gap > 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END)"
    q["broad_base"] = gap + f"""SELECT round({base}, 1) AS pct_positive,
        round(100.0 - {base}, 1) AS pct_zero,
        CASE WHEN {base} >= 80 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM gaps"""
    q["stability_raw"] = _stability()
    return q
