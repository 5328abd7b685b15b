"""The reporting queries, grouped by subject.

``creators`` is a typed creator table, ``videos`` a typed video table. Segment
roles and bins come from a SegmentSpec. Grouped results are a handful of rows,
so shares are taken over the aggregate and final ordering sorts only those rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import bucketize, pct_of, safe_div, total_over_groups
from ..operators.gap import (
    parity_gap,
    platform_revenue,
    positive_share,
    target_rows,
)
from ..operators.quantile import GROUP_LIMIT, binned_values, kth_value, kth_values
from ..operators.ranking import global_ntile, kth_pair, percent_rank_cutoff
from ..specs import DEFAULT_SPEC, SegmentSpec

def _n(name: str) -> Column:
    return F.count("*").alias(name)



def _avg(c: str, digits: int) -> Column:
    return F.round(F.avg(c), digits)


def _sum(c: str, digits: int = 0) -> Column:
    return F.round(F.sum(c), digits)


def _share(part: Column, whole: Column) -> Column:
    return F.round(pct_of(part, whole), 1)


def _share_of_total(c: str) -> Column:
    """Share of a grouped column in its total over all groups."""
    return _share(F.col(c), total_over_groups(F.col(c)))


def _pass(value: Column, threshold: float) -> Column:
    return F.when(value >= threshold, F.lit("PASS")).otherwise(F.lit("FAIL"))


def report_tier(spec: SegmentSpec) -> Column:
    """Left-closed tier with sortable labels; a missing count lands in the lowest tier."""
    labels = spec.ranked_tier_labels()
    return bucketize(F.col("subscriber_count"), spec.tier_edges, labels, null_label=labels[0])


def sub_tier(spec: SegmentSpec) -> Column:
    labels = spec.sub_tier_labels()
    return bucketize(F.col("subscriber_count"), spec.sub_tier_edges, labels, null_label=labels[-1])


# ── overview ────────────────────────────────────────────────────────────────


def total_creators(creators: DataFrame) -> DataFrame:
    return creators.agg(_n("total_creators"))


def by_niche(creators: DataFrame) -> DataFrame:
    return (
        creators.groupBy("niche_category")
        .agg(
            _n("creator_count"),
            _avg("subscriber_count", 0).alias("avg_subscribers"),
            _avg("avg_retention_rate", 2).alias("avg_retention"),
            _avg("rpm", 2).alias("avg_rpm"),
            _sum("revenue_90d").alias("total_revenue_90d"),
        )
        .orderBy(F.col("creator_count").desc())
    )


def subscriber_deciles(creators: DataFrame, tiles: int = 10) -> DataFrame:
    """Size, range and mean of each tile of the subscriber counts; unknown counts come first.

    Rows of equal count that a cut divides have the same count on both sides, so the values at the
    first and last rank of each tile and one sum over the table tell everything: no row is ranked.
    """
    count = F.col("subscriber_count")
    sizes = creators.agg(F.count("*").alias("n"), F.count_if(count.isNull()).alias("unknown")).first()
    n, unknown = sizes["n"], sizes["unknown"]
    tiles_of = [(t + 1, n // tiles + (t < n % tiles)) for t in range(tiles)]
    spans, at = [], 0  # tile, rows, first and last rank among the known counts
    for tile, rows in tiles_of:
        if rows:
            spans.append((tile, rows, max(at - unknown, 0) + 1, at + rows - unknown))
        at += rows
    known = creators.select("subscriber_count").where(count.isNotNull())
    value = binned_values(known, "subscriber_count", sorted({r for _, _, a, b in spans if b >= a for r in (a, b)}))
    sums = []  # of the counts strictly between a tile's first and last value, and rows up to and at those
    for tile, _, a, b in spans:
        if b >= a:
            lo, hi = F.lit(value[a]), F.lit(value[b])
            inner = F.sum(F.when((count > lo) & (count < hi), count))
            sums += [inner.alias(f"inner{tile}"), F.count_if(count <= lo).alias(f"first{tile}"), F.count_if(count < hi).alias(f"last{tile}")]
    total = known.agg(*sums).first() if sums else {}
    out = []
    for tile, rows, a, b in spans:
        if b < a:
            out.append((tile, rows, None, None, None))
            continue
        lo, hi = value[a], value[b]
        if lo == hi:
            whole = lo * (b - a + 1)
        else:
            whole = lo * (total[f"first{tile}"] - a + 1) + (total[f"inner{tile}"] or 0) + hi * (b - total[f"last{tile}"])
        out.append((tile, rows, lo, hi, whole / (b - a + 1)))
    kind = creators.schema["subscriber_count"].dataType.simpleString()
    ddl = f"decile int, n_creators long, min_subs {kind}, max_subs {kind}, avg double"
    table = creators.sparkSession.createDataFrame(out, ddl)
    return table.select("decile", "n_creators", "min_subs", "max_subs", F.round("avg", 0).alias("avg_subs")).orderBy("decile")


def by_channel_age(creators: DataFrame) -> DataFrame:
    return (
        creators.groupBy(F.col("channel_age_years").cast("int").alias("age_floor"))
        .agg(
            _n("creators"),
            _avg("revenue_90d", 0).alias("avg_revenue_90d"),
            _avg("rpm", 2).alias("avg_rpm"),
            _avg("avg_retention_rate", 2).alias("avg_retention"),
        )
        .orderBy("age_floor")
    )


def by_cadence(creators: DataFrame, spec: SegmentSpec = DEFAULT_SPEC) -> DataFrame:
    labels = list(spec.cadence_labels)
    bucket = bucketize(
        F.col("upload_freq_per_month"), spec.cadence_edges, labels, null_label=labels[-1]
    )
    return (
        creators.groupBy(bucket.alias("cadence_bucket"))
        .agg(
            _n("creator_count"),
            _avg("avg_retention_rate", 2).alias("avg_retention"),
            _avg("rpm", 2).alias("avg_rpm"),
        )
        .orderBy("cadence_bucket")
    )


def niche_retention(creators: DataFrame) -> DataFrame:
    return (
        creators.groupBy("niche_category")
        .agg(
            _avg("avg_retention_rate", 2).alias("avg_retention"),
            F.round(F.min("avg_retention_rate"), 2).alias("min_retention"),
            F.round(F.max("avg_retention_rate"), 2).alias("max_retention"),
            _avg("rpm", 2).alias("avg_rpm"),
            _n("n_creators"),
        )
        .orderBy(F.col("avg_retention").desc())
    )


# ── tiers ───────────────────────────────────────────────────────────────────


def _tier_totals(creators: DataFrame, tier: Column, name: str) -> DataFrame:
    return creators.groupBy(tier.alias(name)).agg(
        _n("n"), F.avg("revenue_90d").alias("avg_rev"), F.sum("revenue_90d").alias("rev")
    )


def tier_revenue(creators: DataFrame, spec: SegmentSpec = DEFAULT_SPEC) -> DataFrame:
    agg = _tier_totals(creators, report_tier(spec), "subscriber_tier")
    return agg.select(
        "subscriber_tier",
        F.col("n").alias("n_creators"),
        _share_of_total("n").alias("pct_of_base"),
        F.round("avg_rev", 0).alias("avg_rev_per_creator"),
        F.round("rev", 0).alias("total_tier_revenue"),
        _share_of_total("rev").alias("pct_of_platform_rev"),
    ).orderBy("subscriber_tier")


def revenue_concentration(creators: DataFrame, limit: int = GROUP_LIMIT) -> DataFrame:
    """Top 10% against bottom 50% by percent rank of revenue.

    Percent rank depends only on how many rows are strictly lower, so each
    cut is one order statistic: rows above the c-th smallest value have at
    least c lower rows. No row is ever sorted or ranked.
    """
    rows = creators.select("revenue_90d")
    c = rows.agg(_n("n"), F.count("revenue_90d").alias("k")).first()
    n, nulls = c["n"], c["n"] - c["k"]
    x = F.col("revenue_90d")

    cuts = [percent_rank_cutoff(n, share) for share in (0.90, 0.50)]
    values = kth_values(rows, "revenue_90d", [c - nulls for c in cuts], limit, n)

    def at_least(lower: int, v) -> Column:
        """Rows with at least ``lower`` rows strictly below them; nulls rank first."""
        if lower == 0:
            return F.lit(True)
        if lower <= nulls:
            return x.isNotNull()
        if v is None:  # the cut lies beyond the last row
            return F.lit(False)
        return F.coalesce(x > F.lit(v), F.lit(False))

    top, half = (at_least(c, v) for c, v in zip(cuts, values))
    parts = ((fv.TOP_DECILE, top), (fv.BOTTOM_HALF, ~half))
    # both segments and the total in one pass
    sums = rows.agg(
        F.sum(x).alias("all"),
        *[F.count_if(m).alias(f"n{i}") for i, (_, m) in enumerate(parts)],
        *[F.sum(F.when(m, x)).alias(f"s{i}") for i, (_, m) in enumerate(parts)],
    )
    cells = [
        F.struct(
            F.lit(label).alias("segment"),
            F.col(f"n{i}").alias("n_creators"),
            F.round(f"s{i}", 0).alias("total_revenue"),
            _share(F.col(f"s{i}"), F.col("all")).alias("pct_of_total"),
        )
        for i, (label, _) in enumerate(parts)
    ]
    return sums.select(F.inline(F.array(*cells)))


def tier_rpm(creators: DataFrame, spec: SegmentSpec = DEFAULT_SPEC) -> DataFrame:
    return (
        creators.groupBy(report_tier(spec).alias("subscriber_tier"))
        .agg(
            _avg("rpm", 2).alias("avg_rpm"),
            _avg("avg_retention_rate", 2).alias("avg_retention"),
            F.round(safe_div(F.avg("avg_retention_rate"), F.avg("rpm")), 2).alias(
                "retention_per_rpm_dollar"
            ),
        )
        .orderBy("subscriber_tier")
    )


def mid_tier(creators: DataFrame, spec: SegmentSpec = DEFAULT_SPEC) -> DataFrame:
    def spread(c: str, name: str) -> list[Column]:
        return [
            F.round(f(c), 2).alias(f"{p}_{name}")
            for p, f in (("mean", F.avg), ("min", F.min), ("max", F.max))
        ]

    rows = creators.filter(F.col("subscriber_count").between(*spec.mid_range))
    agg = rows.agg(
        _n("n_creators"), *spread("avg_retention_rate", "retention"), *spread("rpm", "rpm")
    )
    return agg.select(F.lit(spec.mid_label()).alias("segment"), "*")


def tier_scatter(creators: DataFrame, spec: SegmentSpec = DEFAULT_SPEC) -> DataFrame:
    names = ["Micro", "Small", "Mid", "Large", "Mega"]
    tier = bucketize(F.col("subscriber_count"), spec.tier_edges, names, null_label=names[0])
    agg = _tier_totals(creators, tier, "tier_short")
    return agg.select(
        "tier_short",
        F.col("n").alias("n_creators"),
        _share_of_total("n").alias("pct_creators"),
        _share_of_total("rev").alias("pct_revenue"),
        F.round("avg_rev", 0).alias("avg_rev"),
    )


# ── archetypes ──────────────────────────────────────────────────────────────


def archetype_profile(segments: DataFrame) -> DataFrame:
    agg = segments.groupBy("archetype").agg(
        _n("n_creators"),
        _avg("subscriber_count", 0).alias("avg_subscribers"),
        _avg("avg_retention_rate", 2).alias("avg_retention"),
        _avg("avg_ctr", 2).alias("avg_ctr"),
        _avg("upload_freq_per_month", 1).alias("avg_uploads_per_month"),
        _avg("len_consistency_score", 1).alias("avg_len_consistency"),
        _avg("rpm", 2).alias("avg_rpm"),
        _avg("revenue_90d", 0).alias("avg_revenue_90d"),
        _sum("revenue_90d").alias("total_archetype_revenue"),
    )
    return agg.withColumn("pct_of_base", _share_of_total("n_creators")).orderBy(
        F.col("avg_retention").desc()
    )


def head_to_head(segments: DataFrame, spec: SegmentSpec = DEFAULT_SPEC) -> DataFrame:
    return (
        segments.filter(F.col("archetype").isin(spec.target, spec.benchmark))
        .groupBy("archetype")
        .agg(
            _avg("avg_retention_rate", 2).alias("avg_retention"),
            _avg("rpm", 2).alias("avg_rpm"),
            F.round(safe_div(F.avg("avg_retention_rate"), F.avg("rpm")), 2).alias(
                "retention_per_rpm_dollar"
            ),
            _avg("subscriber_count", 0).alias("avg_subscribers"),
            _n("n_creators"),
        )
    )


def target_tiers(segments: DataFrame, spec: SegmentSpec = DEFAULT_SPEC) -> DataFrame:
    agg = target_rows(segments, spec).groupBy("subscriber_tier").agg(
        _n("niche_specialist_count")
    )
    return agg.withColumn(
        "pct_of_archetype", _share_of_total("niche_specialist_count")
    ).orderBy(F.col("pct_of_archetype").desc())


def tier_archetype_crosstab(
    segments: DataFrame, spec: SegmentSpec = DEFAULT_SPEC
) -> DataFrame:
    """Row percentages; largest tier first."""
    shares = [
        F.round(
            F.avg(F.when(F.col("archetype") == label, F.lit(100.0)).otherwise(F.lit(0.0))), 1
        ).alias(f"pct_{short}")
        for short, label in spec.crosstab
    ]
    return (
        segments.groupBy("subscriber_tier")
        .agg(*shares, _n("total_in_tier"), F.min("subscriber_count").alias("_low"))
        .orderBy(F.col("_low").desc())
        .drop("_low")
    )


def target_niches(segments: DataFrame, spec: SegmentSpec = DEFAULT_SPEC) -> DataFrame:
    return (
        target_rows(segments, spec)
        .groupBy("niche_category")
        .agg(
            _n("n_creators"),
            _avg("avg_retention_rate", 2).alias("avg_retention"),
            _avg("rpm", 2).alias("avg_rpm"),
            _sum("revenue_90d").alias("total_revenue_90d"),
            _avg("subscriber_count", 0).alias("avg_subscribers"),
        )
        .orderBy(F.col("n_creators").desc())
    )


def archetype_age(segments: DataFrame) -> DataFrame:
    return (
        segments.groupBy("archetype")
        .agg(
            _avg("channel_age_years", 1).alias("avg_channel_age"),
            _avg("rpm", 2).alias("avg_rpm"),
            _avg("avg_retention_rate", 2).alias("avg_retention"),
            _n("n_creators"),
        )
        .orderBy(F.col("avg_rpm").desc())
    )


# ── gap ─────────────────────────────────────────────────────────────────────


def parity_benchmark(segments: DataFrame, spec: SegmentSpec = DEFAULT_SPEC) -> DataFrame:
    bench = segments.filter(F.col("archetype") == spec.benchmark)
    return bench.agg(_avg("rpm", 4).alias("parity_rpm_benchmark"))


def creator_gap(segments: DataFrame, spec: SegmentSpec = DEFAULT_SPEC) -> DataFrame:
    return (
        parity_gap(segments, spec)
        .select(
            "creator_id",
            "niche_category",
            "subscriber_tier",
            "subscriber_count",
            "avg_retention_rate",
            F.col("rpm").alias("actual_rpm"),
            F.round("parity_rpm", 4).alias("parity_rpm"),
            "views_90d",
            F.round("revenue_90d", 2).alias("current_revenue"),
            F.round("revenue_at_parity", 2).alias("revenue_at_parity"),
            F.round("revenue_gap", 2).alias("revenue_gap"),
        )
        # the id spreads the many gaps of zero over the partitions of the sort
        .orderBy(F.col("revenue_gap").desc(), "creator_id")
    )


def gap_headline(segments: DataFrame, spec: SegmentSpec = DEFAULT_SPEC) -> DataFrame:
    """Flagship: size of the gap and its share of platform revenue."""
    gap = F.col("revenue_gap")
    return parity_gap(segments, spec).agg(
        _n("n_niche_creators"),
        F.sum(F.when(gap > 0, 1).otherwise(0)).alias("creators_with_positive_gap"),
        F.round(F.sum(gap), 0).alias("total_gap_usd"),
        F.round(F.avg(gap), 0).alias("avg_gap_per_creator"),
        _share(F.sum(gap), platform_revenue(segments)).alias("gap_as_pct_of_platform_revenue"),
    )


def gap_by_niche(segments: DataFrame, spec: SegmentSpec = DEFAULT_SPEC) -> DataFrame:
    agg = parity_gap(segments, spec).groupBy("niche_category").agg(
        _n("n_creators"),
        _sum("revenue_90d").alias("current_total_rev"),
        _sum("revenue_at_parity").alias("parity_total_rev"),
        F.sum("revenue_gap").alias("gap"),
    )
    return agg.select(
        "niche_category",
        "n_creators",
        "current_total_rev",
        "parity_total_rev",
        F.round("gap", 0).alias("total_gap"),
        _share_of_total("gap").alias("pct_of_total_gap"),
    ).orderBy(F.col("total_gap").desc())


def _sub_tier_gap(segments: DataFrame, spec: SegmentSpec, *extra: Column) -> DataFrame:
    return (
        parity_gap(segments, spec)
        .groupBy(sub_tier(spec).alias("sub_tier"))
        .agg(
            _n("n_creators"),
            _avg("avg_retention_rate", 2).alias("avg_retention"),
            _avg("rpm", 2).alias("avg_rpm"),
            _avg("revenue_gap", 0).alias("avg_gap_per_creator"),
            *extra,
        )
        .orderBy("sub_tier")
    )


def gap_by_sub_tier(segments: DataFrame, spec: SegmentSpec = DEFAULT_SPEC) -> DataFrame:
    return _sub_tier_gap(segments, spec, _sum("revenue_gap").alias("total_gap"))


def video_retention_buckets(videos: DataFrame, spec: SegmentSpec = DEFAULT_SPEC) -> DataFrame:
    labels = list(spec.video_retention_labels)
    bucket = bucketize(
        F.col("retention_rate"), spec.video_retention_edges, labels, null_label=labels[0]
    )
    per_thousand = safe_div(F.col("revenue"), F.col("views")) * F.lit(1000.0)
    return (
        videos.groupBy(bucket.alias("retention_bucket"))
        .agg(
            _n("n_videos"),
            _avg("rpm", 2).alias("avg_rpm"),
            F.round(F.avg(per_thousand), 4).alias("revenue_per_1000_views"),
            F.round(F.avg(F.col("views").cast("double")), 0).alias("avg_views_per_video"),
        )
        .orderBy("retention_bucket")
    )


# ── validation ──────────────────────────────────────────────────────────────


def broad_base_check(segments: DataFrame, spec: SegmentSpec = DEFAULT_SPEC) -> DataFrame:
    gap = F.col("revenue_gap")
    agg = parity_gap(segments, spec).agg(
        _n("total_niche_creators"),
        F.sum(F.when(gap > 0, 1).otherwise(0)).alias("creators_positive_gap"),
        positive_share(gap).alias("pct"),
    )
    return agg.select(
        "total_niche_creators",
        "creators_positive_gap",
        F.round("pct", 1).alias("pct_with_positive_gap"),
        _pass(F.col("pct"), fv.BROAD_BASE_PASS_PCT).alias("check_result"),
    )


def sub_tier_direction(segments: DataFrame, spec: SegmentSpec = DEFAULT_SPEC) -> DataFrame:
    direction = F.when(F.avg("revenue_gap") > 0, fv.GAP_POSITIVE).otherwise(fv.GAP_NOT_POSITIVE)
    return _sub_tier_gap(segments, spec, direction.alias("gap_direction"))


def age_confound(segments: DataFrame, spec: SegmentSpec = DEFAULT_SPEC) -> DataFrame:
    return (
        segments.filter(F.col("archetype").isin(spec.target, spec.benchmark))
        .groupBy("archetype")
        .agg(
            _avg("channel_age_years", 1).alias("avg_channel_age"),
            _avg("rpm", 2).alias("avg_rpm"),
            _avg("avg_retention_rate", 2).alias("avg_retention"),
            _n("n_creators"),
        )
    )


def video_consistency(videos: DataFrame, spec: SegmentSpec = DEFAULT_SPEC) -> DataFrame:
    high = F.when(
        F.col("retention_rate") >= fv.HIGH_RETENTION_VIDEO, F.lit(100.0)
    ).otherwise(F.lit(0.0))
    return (
        videos.filter(F.col("archetype").isin(spec.target, spec.benchmark))
        .groupBy("archetype")
        .agg(
            _n("total_videos"),
            _avg("retention_rate", 2).alias("avg_video_retention"),
            F.round(F.avg(high), 1).alias("pct_high_retention_videos"),
            _avg("rpm", 2).alias("avg_video_rpm"),
        )
    )


def trim_by_ntile(
    segments: DataFrame,
    spec: SegmentSpec = DEFAULT_SPEC,
    tiles: int = 20,
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Gap kept when the top 1/tiles of the target by views is removed.

    Only the last tile's first row matters, so it is selected by rank instead
    of numbering all rows.
    """
    rows = parity_gap(segments, spec).select("views_90d", "creator_id", "revenue_gap")
    n = rows.count()
    if n < tiles:
        kept_n = n  # with fewer rows than tiles the last tile is empty
    else:
        kept_n = n - n // tiles
    v, last_id = kth_pair(rows, "views_90d", "creator_id", kept_n, limit)
    views, cid = F.col("views_90d"), F.col("creator_id")
    if last_id is None:
        kept = F.lit(False)
    elif v is None:
        kept = views.isNull() & (cid <= F.lit(last_id))
    else:
        kept = (
            views.isNull() | (views < F.lit(v)) | ((views == F.lit(v)) & (cid <= F.lit(last_id)))
        )
    label = F.when(kept, F.lit(fv.TRIM_RETAINED)).otherwise(
        F.lit(fv.TRIM_REMOVED)
    )
    agg = rows.groupBy(label.alias("group_label")).agg(
        _n("n_creators"), F.sum("revenue_gap").alias("gap")
    )
    return agg.select(
        "group_label",
        "n_creators",
        F.round("gap", 0).alias("total_gap"),
        _share_of_total("gap").alias("pct_of_total_gap"),
    )


def validation_one_row(
    segments: DataFrame, spec: SegmentSpec = DEFAULT_SPEC, limit: int = GROUP_LIMIT
) -> DataFrame:
    """Broad-base and trim percentages with their verdicts.

    The trim cutoff is the views value at row int(0.95 n), nulls first.
    """
    rows = parity_gap(segments, spec).select("views_90d", "revenue_gap")
    c = rows.agg(_n("n"), F.count("views_90d").alias("k")).first()
    place = int(c["n"] * fv.TRIM_QUANTILE) - (c["n"] - c["k"])
    cutoff = F.lit(kth_value(rows, "views_90d", place, limit, c["k"])).cast("bigint")
    gap = F.col("revenue_gap")
    kept = F.sum(F.when(F.col("views_90d") <= cutoff, gap).otherwise(F.lit(0.0)))
    metrics = rows.agg(
        positive_share(gap).alias("base"), pct_of(kept, F.sum(gap)).alias("trim")
    )
    return metrics.select(
        F.round("base", 1).alias("pct_creators_with_positive_gap"),
        _pass(F.col("base"), fv.BROAD_BASE_PASS_PCT).alias("broadbase_check"),
        F.round("trim", 1).alias("pct_gap_after_trim"),
        _pass(F.col("trim"), fv.TRIM_PASS_PCT).alias("outlier_trim_check"),
    )


def base_share(segments: DataFrame, group: str) -> DataFrame:
    """Rows per group and their share of the base."""
    agg = segments.groupBy(group).agg(_n("n"))
    return agg.withColumn("pct_of_base", _share_of_total("n"))
