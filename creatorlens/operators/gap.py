"""Parity gap: what the target segment would earn at the benchmark's mean rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import floor_zero, pct_of, round_scaled, total_over_groups
from ..specs import DEFAULT_SPEC, SegmentSpec


def benchmark_rate(df: DataFrame, spec: SegmentSpec = DEFAULT_SPEC) -> Column:
    """Mean rpm of the benchmark segment as a scalar subquery (computed once, no join)."""
    bench = df.filter(F.col("archetype") == spec.benchmark)
    return bench.agg(F.avg("rpm").alias("parity_rpm")).scalar()


def target_rows(df: DataFrame, spec: SegmentSpec = DEFAULT_SPEC) -> DataFrame:
    return df.filter(F.col("archetype") == spec.target)


def parity_gap(
    df: DataFrame, spec: SegmentSpec = DEFAULT_SPEC, round_cents: bool = False
) -> DataFrame:
    """Target rows with parity_rpm, revenue_at_parity and revenue_gap (>= 0 or null)."""
    out = (
        target_rows(df, spec)
        .withColumn("parity_rpm", benchmark_rate(df, spec))
        .withColumn("revenue_at_parity", F.col("views_90d") * F.col("parity_rpm") / F.lit(1000.0))
    )
    if round_cents:
        out = out.withColumn("revenue_at_parity", round_scaled(F.col("revenue_at_parity"), 2))
    gap = floor_zero(F.col("revenue_at_parity") - F.col("revenue_90d"))
    return out.withColumn("revenue_gap", round_scaled(gap, 2) if round_cents else gap)


def gap_export(df: DataFrame, spec: SegmentSpec = DEFAULT_SPEC) -> DataFrame:
    """All rows with views_90d and cent-rounded gap columns; 0 outside the target."""
    is_target = F.coalesce(F.col("archetype") == spec.target, F.lit(False))
    base = df.withColumn("views_90d", F.col("monthly_views") * 3)
    at_parity = round_scaled(F.col("views_90d") * benchmark_rate(df, spec) / F.lit(1000.0), 2)
    base = base.withColumn(
        "revenue_at_parity", F.when(is_target, at_parity).otherwise(F.lit(0.0))
    )
    gap = round_scaled(floor_zero(F.col("revenue_at_parity") - F.col("revenue_90d")), 2)
    return base.withColumn("revenue_gap", F.when(is_target, gap).otherwise(F.lit(0.0)))


def platform_revenue(df: DataFrame) -> Column:
    return df.agg(F.sum("revenue_90d").alias("rev")).scalar()


def gap_summary(df: DataFrame, spec: SegmentSpec = DEFAULT_SPEC) -> DataFrame:
    return parity_gap(df, spec).agg(
        F.count("*").alias("n_creators"),
        F.round(F.max("parity_rpm"), 4).alias("parity_rpm"),
        F.round(F.avg("revenue_90d"), 2).alias("avg_current"),
        F.round(F.avg("revenue_at_parity"), 2).alias("avg_parity"),
        F.round(F.avg("revenue_gap"), 2).alias("avg_gap"),
        F.round(F.sum("revenue_gap"), 2).alias("total_gap"),
        F.round(pct_of(F.sum("revenue_gap"), platform_revenue(df)), 1).alias("pct_of_platform"),
    )


def gap_by_category(
    df: DataFrame, spec: SegmentSpec = DEFAULT_SPEC, category: str = "niche_category"
) -> DataFrame:
    """Gap per category with its share of the total, largest gap first."""
    agg = (
        parity_gap(df, spec)
        .filter(F.col(category).isNotNull())
        .groupBy(category)
        .agg(
            F.count("creator_id").alias("n_creators"),
            F.coalesce(F.sum("revenue_90d"), F.lit(0.0)).alias("current_rev"),
            F.coalesce(F.sum("revenue_at_parity"), F.lit(0.0)).alias("parity_rev"),
            F.coalesce(F.sum("revenue_gap"), F.lit(0.0)).alias("gap"),
        )
    )
    return agg.select(
        category,
        "n_creators",
        F.round("current_rev", 0).alias("current_rev"),
        F.round("parity_rev", 0).alias("parity_rev"),
        F.round("gap", 0).alias("gap"),
        F.round(pct_of(F.col("gap"), total_over_groups(F.col("gap"))), 1).alias("gap_pct"),
    ).orderBy(F.col("gap").desc())


def gap_bridge(df: DataFrame, spec: SegmentSpec = DEFAULT_SPEC) -> DataFrame:
    """Current revenue, unrealised gap and their sum."""
    sums = parity_gap(df, spec).agg(
        F.sum("revenue_90d").alias("cur"), F.sum("revenue_gap").alias("gap")
    )
    return sums.select(
        F.round("cur", 2).alias("current_revenue"),
        F.round("gap", 2).alias("unrealised_gap"),
        F.round(F.col("cur") + F.col("gap"), 2).alias("parity_target"),
    )


def positive_share(gap: Column) -> Column:
    """Percentage of rows with a positive gap; a missing gap counts as not positive."""
    return F.avg(F.when(gap > 0, F.lit(100.0)).otherwise(F.lit(0.0)))

