"""Profiling: null audits, moments, histograms, correlations, shares."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pct_of, total_over_groups
from ..session import literal_frame
from .quantile import GROUP_LIMIT, exact_quantiles


def null_audit(df: DataFrame) -> DataFrame:
    """(column_name, n_null, pct_null) of the columns that hold nulls; one pass."""
    cols = df.columns
    counts = df.agg(
        F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols]
    )
    cells = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_null")) for c in cols]
    )
    return (
        counts.select("_n", F.inline(cells))
        .filter("n_null > 0")
        .select("column_name", "n_null", F.round(pct_of(F.col("n_null"), F.col("_n")), 1).alias("pct_null"))
    )


def table_shape(**tables: DataFrame) -> DataFrame:
    """(table_name, n_rows, n_cols) per table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_cols")
        )
        out = one if out is None else out.unionByName(one)
    return out


def corrected_skewness(column: str) -> Column:
    """Sample skewness with the bias correction sqrt(n(n-1))/(n-2)."""
    n = F.count(column).cast("double")
    factor = F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    return F.when(n > 2, F.skewness(column) * factor)


def feature_moments(
    df: DataFrame, columns: Sequence[str], limit: int = GROUP_LIMIT
) -> DataFrame:
    """(feature, skew, median) per column."""
    columns = list(columns)
    medians = exact_quantiles(df.select(*columns), columns, 0.5, (), limit)
    skews = df.agg(*[corrected_skewness(c).alias(c) for c in columns])

    def long(one_row: DataFrame, name: str) -> DataFrame:
        cells = [F.struct(F.lit(c).alias("feature"), F.col(c).alias(name)) for c in columns]
        return one_row.select(F.inline(F.array(*cells)))

    return (
        long(skews, "skew")
        .join(F.broadcast(long(medians, "median")), "feature")
        .select("feature", F.round("skew", 3).alias("skew"), F.round("median", 2).alias("median"))
    )


def histograms(df: DataFrame, columns: Sequence[str], bins: int) -> DataFrame:
    """Equal-width bins over each column's range: (feature, bin, lo, hi, n).

    One scan finds all ranges (two numbers per column), a second counts all
    bins on the map side. Nulls are left out, the last bin is closed, empty
    bins are kept, a constant column gets a range of width 1.
    """
    columns = list(columns)
    ends = df.agg(
        *[F.min(c).cast("double").alias(f"lo{i}") for i, c in enumerate(columns)],
        *[F.max(c).cast("double").alias(f"hi{i}") for i, c in enumerate(columns)],
    ).first()
    cells, ranges = [], []
    for i, c in enumerate(columns):
        lo, hi = ends[f"lo{i}"], ends[f"hi{i}"]
        if lo is not None and lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        low, high = F.lit(lo).cast("double"), F.lit(hi).cast("double")
        place = F.floor((F.col(c).cast("double") - low) / (high - low) * F.lit(float(bins)))
        inside = F.when(F.col(c).isNotNull(), F.least(place, F.lit(bins - 1)))
        cells.append(F.struct(F.lit(c).alias("_f"), inside.cast("int").alias("_b")))
        ranges.append(F.struct(F.lit(c).alias("feature"), low.alias("a"), high.alias("z")))
    counts = (
        df.select(F.inline(F.array(*cells)))
        .filter(F.col("_b").isNotNull())
        .groupBy("_f", "_b")
        .agg(F.count("*").alias("c"))
    )
    every = df.sparkSession.range(bins).select(
        F.col("id").cast("int").alias("bin"), F.inline(F.array(*ranges))
    )
    width = (F.col("z") - F.col("a")) / F.lit(float(bins))
    # at most one row per feature and bin
    joined = every.join(
        F.broadcast(counts),
        (F.col("feature") == F.col("_f")) & (F.col("bin") == F.col("_b")),
        "left",
    )
    return joined.select(
        "feature",
        "bin",
        (F.col("a") + width * F.col("bin")).alias("lo"),
        (F.col("a") + width * (F.col("bin") + 1)).alias("hi"),
        F.coalesce("c", F.lit(0)).cast("bigint").alias("n"),
    )


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, lo, hi, n) of one column."""
    return histograms(df, [column], bins).drop("feature")


def corr_matrix(df: DataFrame, columns: Sequence[str], digits: int = 3) -> DataFrame:
    """Pairwise-complete Pearson matrix in long form (a, b, r); one pass.

    A column with itself is 1 (null if it has no spread).
    """
    cols = list(columns)
    wide = df.agg(
        *[F.corr(a, b).alias(f"{a}|{b}") for a, b in combinations(cols, 2)],
        *[
            F.when(F.stddev_pop(c) > 0, F.lit(1.0)).alias(f"{c}|{c}")
            for c in cols
        ],
    )
    cells = []
    for a in cols:
        for b in cols:
            key = f"{a}|{b}" if f"{a}|{b}" in wide.columns else f"{b}|{a}"
            cells.append(
                F.struct(
                    F.lit(a).alias("a"), F.lit(b).alias("b"),
                    F.round(F.col(f"`{key}`"), digits).alias("r"),
                )
            )
    return wide.select(F.inline(F.array(*cells)))


def corr_verdict(df: DataFrame, a: str, b: str, weak_below: float, digits: int = 3) -> DataFrame:
    r = F.round(F.corr(a, b), digits)
    return df.agg(r.alias("r")).select(
        F.lit(a).alias("a"), F.lit(b).alias("b"), "r",
        F.when(F.abs("r") < weak_below, "weak").otherwise("not weak").alias("verdict"),
    )


def zone_counts(df: DataFrame, x: str, x_zone, y: str, y_zone) -> DataFrame:
    """Rows per combination of 'x in its zone' and 'y in its zone' (bounds included)."""
    in_x = F.coalesce(F.col(x).between(*x_zone), F.lit(False)).alias("in_x_zone")
    in_y = F.coalesce(F.col(y).between(*y_zone), F.lit(False)).alias("in_y_zone")
    return df.groupBy(in_x, in_y).agg(F.count("*").alias("n"))


def subset_spread(df: DataFrame, member: Column, column: str) -> DataFrame:
    """Spread of ``column`` inside a subset and in its complement, in one pass."""
    inside = F.coalesce(member, F.lit(False))
    x_in, x_out = F.when(inside, F.col(column)), F.when(~inside, F.col(column))
    return df.agg(
        F.count_if(inside).alias("n_inside"),
        F.count_if(~inside).alias("n_outside"),
        F.round(F.stddev_samp(x_in), 2).alias("std_inside"),
        F.round(F.avg(x_in), 2).alias("mean_inside"),
        F.round(F.avg(x_out), 2).alias("mean_outside"),
    )


def tier_share(
    df: DataFrame, tier: str, tier_order: Sequence[str], amount: str
) -> DataFrame:
    """Per tier: rows, mean and sum of ``amount``, shares; absent tiers stay as null rows.

    Shares are taken over the few aggregated rows; the table is read once.
    """
    order = literal_frame(df.sparkSession, ("tier_rank", "_tier"), list(enumerate(tier_order)))
    agg = df.filter(F.col(tier).isin(*tier_order)).groupBy(tier).agg(
        F.count("*").alias("n_creators"),
        F.avg(amount).alias("avg_rev"),
        F.sum(amount).alias("total_rev"),
    )
    return order.join(agg, F.col("_tier") == F.col(tier), "left").select(
        "tier_rank",
        F.col("_tier").alias("subscriber_tier"),
        "n_creators",
        F.round("avg_rev", 2).alias("avg_rev"),
        F.round("total_rev", 2).alias("total_rev"),
        F.round(pct_of(F.col("n_creators"), total_over_groups(F.col("n_creators"))), 2).alias(
            "pct_creators"
        ),
        F.round(pct_of(F.col("total_rev"), total_over_groups(F.col("total_rev"))), 2).alias(
            "pct_revenue"
        ),
    )


def distinct_before_after(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """(column_name, n_before, n_after): distinct non-null values of raw vs clean columns.

    Each pair is first reduced to its distinct combinations on the map side;
    distinct counts then run on that small result.
    """
    out = None
    for name, (raw, clean) in pairs.items():
        combos = df.groupBy(F.col(raw).alias("r"), F.col(clean).alias("c")).agg(F.count("*").alias("n"))
        one = combos.agg(
            F.count_distinct("r").alias("n_before"), F.count_distinct("c").alias("n_after")
        ).select(F.lit(name).alias("column_name"), "n_before", "n_after")
        out = one if out is None else out.unionByName(one)
    return out
