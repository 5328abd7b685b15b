"""Oracle SQL of the 29 reporting queries."""

from __future__ import annotations

from .base import (
    BENCH, GAPS, ITEMS, RANKED_TIER, SEGMENTS, SHORT_TIER, SUB_TIER, TARGET, big, cases, pct,
)

_CAD = ["A. Very Low  (<2/mo)", "B. Low       (2–6/mo)", "C. Medium    (6–12/mo)",
        "D. High      (12–20/mo)", "E. Very High (20+/mo)"]
_RET = ["D. Very Low (<20%)", "C. Low    (20–35%)", "B. Medium (35–50%)", "A. High   (50%+)"]


def share(part: str, whole: str) -> str:
    return f"round({pct(part, whole)}, 1)"


def reports() -> dict[str, str]:
    seg = f"WITH {SEGMENTS} "
    gap = f"WITH {GAPS} "
    pos = f"{big('sum(CASE WHEN gap > 0 THEN 1 ELSE 0 END)')}"
    base_pct = "avg(CASE WHEN gap > 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END)"
    total_gap = "(SELECT sum(gap) FROM gaps)"
    sub_tier_cols = f"""{SUB_TIER} AS sub_tier, count(*) AS n_creators,
        round(avg(avg_retention_rate), 2) AS avg_retention, round(avg(rpm), 2) AS avg_rpm,
        round(avg(gap), 0) AS avg_gap_per_creator"""
    q = {}
    q["q1_1_total"] = "SELECT count(*) AS total_creators FROM orders"
    q["q1_2_niche"] = seg + """SELECT niche_category, count(*) AS creator_count,
        round(avg(subscriber_count), 0) AS avg_subscribers,
        round(avg(avg_retention_rate), 2) AS avg_retention, round(avg(rpm), 2) AS avg_rpm,
        round(sum(revenue_90d), 0) AS total_revenue_90d
        FROM segments GROUP BY niche_category ORDER BY creator_count DESC"""
    q["q1_3_deciles"] = seg + """, d AS (SELECT subscriber_count,
        ntile(10) OVER (ORDER BY subscriber_count NULLS FIRST, creator_id) AS decile FROM segments)
        SELECT CAST(decile AS INT) AS decile, count(*) AS n_creators,
        min(subscriber_count) AS min_subs, max(subscriber_count) AS max_subs,
        round(avg(subscriber_count), 0) AS avg_subs FROM d GROUP BY decile ORDER BY decile"""
    q["q1_4_age"] = seg + """SELECT CAST(trunc(channel_age_years) AS INT) AS age_floor,
        count(*) AS creators, round(avg(revenue_90d), 0) AS avg_revenue_90d,
        round(avg(rpm), 2) AS avg_rpm, round(avg(avg_retention_rate), 2) AS avg_retention
        FROM segments GROUP BY 1 ORDER BY 1"""
    q["q1_5_cadence"] = seg + f"""SELECT
        {cases("upload_freq_per_month", (2, 6, 12, 20), _CAD, _CAD[-1])} AS cadence_bucket,
        count(*) AS creator_count, round(avg(avg_retention_rate), 2) AS avg_retention,
        round(avg(rpm), 2) AS avg_rpm FROM segments GROUP BY 1 ORDER BY 1"""
    q["q1_6_niche_ret"] = seg + """SELECT niche_category,
        round(avg(avg_retention_rate), 2) AS avg_retention,
        round(min(avg_retention_rate), 2) AS min_retention,
        round(max(avg_retention_rate), 2) AS max_retention,
        round(avg(rpm), 2) AS avg_rpm, count(*) AS n_creators
        FROM segments GROUP BY niche_category ORDER BY avg_retention DESC"""
    n_all, rev_all = "(SELECT count(*) FROM segments)", "(SELECT sum(revenue_90d) FROM segments)"
    q["q2_1_tier_revenue"] = seg + f"""SELECT {RANKED_TIER} AS subscriber_tier,
        count(*) AS n_creators, {share("count(*)", n_all)} AS pct_of_base,
        round(avg(revenue_90d), 0) AS avg_rev_per_creator,
        round(sum(revenue_90d), 0) AS total_tier_revenue,
        {share("sum(revenue_90d)", rev_all)} AS pct_of_platform_rev
        FROM segments GROUP BY 1 ORDER BY 1"""
    q["q2_2_concentration"] = seg + f""", ranked AS (SELECT revenue_90d,
        percent_rank() OVER (ORDER BY revenue_90d NULLS FIRST) AS pr FROM segments)
        SELECT 'Top 10% by revenue' AS segment, count(*) AS n_creators,
          round(sum(revenue_90d), 0) AS total_revenue,
          {share("sum(revenue_90d)", rev_all)} AS pct_of_total FROM ranked WHERE pr >= 0.9::DOUBLE
        UNION ALL
        SELECT 'Bottom 50% by revenue', count(*), round(sum(revenue_90d), 0),
          {share("sum(revenue_90d)", rev_all)} FROM ranked WHERE pr < 0.5::DOUBLE"""
    q["q2_3_tier_rpm"] = seg + f"""SELECT {RANKED_TIER} AS subscriber_tier,
        round(avg(rpm), 2) AS avg_rpm, round(avg(avg_retention_rate), 2) AS avg_retention,
        round(avg(avg_retention_rate) / nullif(avg(rpm), 0), 2) AS retention_per_rpm_dollar
        FROM segments GROUP BY 1 ORDER BY 1"""
    q["q2_4_mid_tier"] = seg + """SELECT 'Mid tier (100K–250K)' AS segment, count(*) AS n_creators,
        round(avg(avg_retention_rate), 2) AS mean_retention,
        round(min(avg_retention_rate), 2) AS min_retention,
        round(max(avg_retention_rate), 2) AS max_retention,
        round(avg(rpm), 2) AS mean_rpm, round(min(rpm), 2) AS min_rpm, round(max(rpm), 2) AS max_rpm
        FROM segments WHERE subscriber_count BETWEEN 100000 AND 250000"""
    q["q2_5_tier_scatter"] = seg + f"""SELECT {SHORT_TIER} AS tier_short, count(*) AS n_creators,
        {share("count(*)", n_all)} AS pct_creators,
        {share("sum(revenue_90d)", rev_all)} AS pct_revenue,
        round(avg(revenue_90d), 0) AS avg_rev FROM segments GROUP BY 1"""
    q["q3_1_archetype"] = seg + f"""SELECT archetype, count(*) AS n_creators,
        {share("count(*)", n_all)} AS pct_of_base,
        round(avg(subscriber_count), 0) AS avg_subscribers,
        round(avg(avg_retention_rate), 2) AS avg_retention, round(avg(avg_ctr), 2) AS avg_ctr,
        round(avg(upload_freq_per_month), 1) AS avg_uploads_per_month,
        round(avg(len_consistency_score), 1) AS avg_len_consistency,
        round(avg(rpm), 2) AS avg_rpm, round(avg(revenue_90d), 0) AS avg_revenue_90d,
        round(sum(revenue_90d), 0) AS total_archetype_revenue
        FROM segments GROUP BY archetype ORDER BY avg_retention DESC"""
    both = f"archetype IN ('{TARGET}', '{BENCH}')"
    q["q3_2_head_to_head"] = seg + f"""SELECT archetype,
        round(avg(avg_retention_rate), 2) AS avg_retention, round(avg(rpm), 2) AS avg_rpm,
        round(avg(avg_retention_rate) / nullif(avg(rpm), 0), 2) AS retention_per_rpm_dollar,
        round(avg(subscriber_count), 0) AS avg_subscribers, count(*) AS n_creators
        FROM segments WHERE {both} GROUP BY archetype"""
    tgt = f"archetype = '{TARGET}'"
    n_tgt = f"(SELECT count(*) FROM segments WHERE {tgt})"
    q["q3_3_target_tiers"] = seg + f"""SELECT subscriber_tier, count(*) AS niche_specialist_count,
        {share("count(*)", n_tgt)} AS pct_of_archetype
        FROM segments WHERE {tgt} GROUP BY subscriber_tier ORDER BY pct_of_archetype DESC"""

    def cell(label, name):
        return (
            f"round(avg(CASE WHEN archetype = '{label}' THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END), 1)"
            f" AS pct_{name}"
        )

    cells = ", ".join(
        cell(a, b)
        for a, b in (("1-URGENT", "giants"), ("2-HIGH", "viral"), ("3-MEDIUM", "volume"),
                     ("4-NOT SPECIFIED", "dabblers"), ("5-LOW", "niche"))
    )
    q["q3_4_crosstab"] = seg + f"""SELECT subscriber_tier, {cells}, count(*) AS total_in_tier
        FROM segments GROUP BY subscriber_tier ORDER BY min(subscriber_count) DESC"""
    q["q3_5_target_niche"] = seg + f"""SELECT niche_category, count(*) AS n_creators,
        round(avg(avg_retention_rate), 2) AS avg_retention, round(avg(rpm), 2) AS avg_rpm,
        round(sum(revenue_90d), 0) AS total_revenue_90d,
        round(avg(subscriber_count), 0) AS avg_subscribers
        FROM segments WHERE {tgt} GROUP BY niche_category ORDER BY n_creators DESC"""
    age = """SELECT archetype, round(avg(channel_age_years), 1) AS avg_channel_age,
        round(avg(rpm), 2) AS avg_rpm, round(avg(avg_retention_rate), 2) AS avg_retention,
        count(*) AS n_creators FROM segments"""
    q["q3_6_age"] = seg + age + " GROUP BY archetype ORDER BY avg_rpm DESC"
    q["q4_1_parity"] = seg + f"""SELECT round(avg(rpm), 4) AS parity_rpm_benchmark
        FROM segments WHERE archetype = '{BENCH}'"""
    q["q4_2_creator_gap"] = gap + """SELECT creator_id, niche_category, subscriber_tier,
        subscriber_count, avg_retention_rate, rpm AS actual_rpm, round(parity_rpm, 4) AS parity_rpm,
        views_90d, round(revenue_90d, 2) AS current_revenue,
        round(revenue_at_parity, 2) AS revenue_at_parity, round(gap, 2) AS revenue_gap
        FROM gaps ORDER BY revenue_gap DESC, creator_id"""
    q["q4_3_headline"] = gap + f"""SELECT count(*) AS n_niche_creators,
        {pos} AS creators_with_positive_gap, round(sum(gap), 0) AS total_gap_usd,
        round(avg(gap), 0) AS avg_gap_per_creator,
        {share("sum(gap)", rev_all)} AS gap_as_pct_of_platform_revenue FROM gaps"""
    q["q4_4_gap_niche"] = gap + f"""SELECT niche_category, count(*) AS n_creators,
        round(sum(revenue_90d), 0) AS current_total_rev,
        round(sum(revenue_at_parity), 0) AS parity_total_rev, round(sum(gap), 0) AS total_gap,
        {share("sum(gap)", total_gap)} AS pct_of_total_gap
        FROM gaps GROUP BY niche_category ORDER BY total_gap DESC"""
    q["q4_5_gap_subtier"] = gap + f"""SELECT {sub_tier_cols}, round(sum(gap), 0) AS total_gap
        FROM gaps GROUP BY 1 ORDER BY 1"""
    q["q4_6_video_buckets"] = f"WITH {ITEMS} " + f"""SELECT
        {cases("retention_rate", (20, 35, 50), _RET, _RET[0])} AS retention_bucket,
        count(*) AS n_videos, round(avg(rpm), 2) AS avg_rpm,
        round(avg(CAST(revenue AS DOUBLE) / nullif(CAST(views AS DOUBLE), 0) * 1000), 4)
          AS revenue_per_1000_views,
        round(avg(CAST(views AS DOUBLE)), 0) AS avg_views_per_video
        FROM items GROUP BY 1 ORDER BY 1"""
    q["q5_1_broad_base"] = gap + f"""SELECT count(*) AS total_niche_creators,
        {pos} AS creators_positive_gap, round({base_pct}, 1) AS pct_with_positive_gap,
        CASE WHEN {base_pct} >= 80 THEN 'PASS' ELSE 'FAIL' END AS check_result FROM gaps"""
    q["q5_2_subtier_dir"] = gap + f"""SELECT {sub_tier_cols},
        CASE WHEN avg(gap) > 0 THEN 'positive' ELSE 'zero / negative' END AS gap_direction
        FROM gaps GROUP BY 1 ORDER BY 1"""
    q["q5_3_age_confound"] = seg + age + f" WHERE {both} GROUP BY archetype"
    q["q5_4_video_consistency"] = f"WITH {ITEMS} " + f"""SELECT archetype, count(*) AS total_videos,
        round(avg(retention_rate), 2) AS avg_video_retention,
        round(avg(CASE WHEN retention_rate >= 45 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END), 1)
          AS pct_high_retention_videos, round(avg(rpm), 2) AS avg_video_rpm
        FROM items WHERE {both} GROUP BY archetype"""
    q["q5_5_trim_ntile"] = gap + f""", ranked AS (SELECT gap,
        ntile(20) OVER (ORDER BY views_90d NULLS FIRST, creator_id) AS v FROM gaps)
        SELECT CASE WHEN v < 20 THEN 'Retained (bottom 95%)'
                    ELSE 'Removed  (top 5% view-spike)' END AS group_label,
        count(*) AS n_creators, round(sum(gap), 0) AS total_gap,
        {share("sum(gap)", total_gap)} AS pct_of_total_gap FROM ranked GROUP BY 1"""
    q["q5_6_summary"] = gap + f""", ranked AS (SELECT views_90d,
          row_number() OVER (ORDER BY views_90d NULLS FIRST) AS rn, count(*) OVER () AS cnt FROM gaps),
        cut AS (SELECT max(views_90d) AS c FROM ranked
                WHERE rn = CAST(trunc(cnt * 0.95::DOUBLE) AS BIGINT)),
        m AS (SELECT {base_pct} AS base,
          {pct("sum(CASE WHEN views_90d <= (SELECT c FROM cut) THEN gap ELSE 0 END)", "sum(gap)")} AS trim
          FROM gaps)
        SELECT round(base, 1) AS pct_creators_with_positive_gap,
          CASE WHEN base >= 80 THEN 'PASS' ELSE 'FAIL' END AS broadbase_check,
          round(trim, 1) AS pct_gap_after_trim,
          CASE WHEN trim >= 85 THEN 'PASS' ELSE 'FAIL' END AS outlier_trim_check FROM m"""
    # the same reports, asked as SQL over views
    q["sql_views"], q["sql_video_buckets"] = q["q4_5_gap_subtier"], q["q4_6_video_buckets"]
    return q
