"""Group-median imputation with a global fallback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import round_scaled
from ..session import materialize
from . import quantile as Q
from .quantile import GROUP_LIMIT, exact_quantiles
from .skew import lookup_join


def impute_group_median(
    df: DataFrame,
    key: str,
    columns: Sequence[str],
    digits: int = 2,
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Fill nulls with the median of the row's group, else with the global median.

    ``df`` should be a stored table. A null key has no group, so it takes the
    global median. Medians are taken of the groups that have a gap. Many groups (too many to broadcast their medians): rows
    without a gap pass through untouched and only incomplete rows are joined,
    with dominant keys kept out of the shuffle.
    """
    columns = list(columns)
    any_gap = F.lit(False)
    for c in columns:
        any_gap = any_gap | F.col(c).isNull()
    medians = exact_quantiles(_rows_of_needed(df, key, columns, any_gap), columns, 0.5, [key], limit)
    medians = materialize(
        medians.filter(F.col(key).isNotNull()).select(
            F.col(key).alias("_key"), *[F.col(c).alias(f"_med_{c}") for c in columns]
        ),
        "group-medians",
    )
    fallback = exact_quantiles(df.select(*columns), columns, 0.5, (), limit).first().asDict()

    def cell(c: str):
        median = F.coalesce(F.col(f"_med_{c}"), F.lit(fallback[c]).cast("double"))
        return F.coalesce(F.col(c), round_scaled(median, digits)).alias(c)

    def fill(rows: DataFrame) -> DataFrame:
        joined = lookup_join(rows, medians, key, "_key", "left", limit)
        return joined.select(*[cell(c) if c in columns else F.col(c) for c in df.columns])

    if medians.count() <= Q.BROADCAST_ROWS:  # one scan, nothing shuffled
        return fill(df)
    return df.filter(~any_gap).unionByName(fill(df.filter(any_gap)))


def _rows_of_needed(df: DataFrame, key: str, columns: Sequence[str], any_gap: Column) -> DataFrame:
    """The key and values of groups with a gap; of all groups if those with one are too many to
    send to every task."""
    needed = df.filter(any_gap & F.col(key).isNotNull()).select(F.col(key).alias("_needed")).distinct()
    needed = materialize(needed, "needed-keys")
    rows = df.select(key, *columns)
    if needed.count() > Q.BROADCAST_ROWS:
        return rows
    return rows.join(F.broadcast(needed), F.col(key) == F.col("_needed"), "left_semi")
