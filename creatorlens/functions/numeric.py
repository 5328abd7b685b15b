"""Null-safe arithmetic and the three rounding conventions in use.

* report figures: ``F.round`` (half away from zero)
* bulk column rounding in cleaning: :func:`round_scaled` (scale, half-even, unscale)
* rounding of one parsed number: :func:`round_float` (half-even on the exact
  binary value, so text like ``2.675`` becomes 2.67)
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def floor_zero(x: Column) -> Column:
    """max(0, x) that keeps null (``greatest`` would turn null into 0)."""
    return F.when(x > 0, x).when(x <= 0, F.lit(0.0))


def safe_div(a: Column, b: Column) -> Column:
    """a / b as double, null when b is 0 or either side is null."""
    return F.try_divide(_lit(a).cast("double"), _lit(b).cast("double"))


def pct_of(part: Column, whole: Column) -> Column:
    """part as a percentage of whole (null when whole is 0)."""
    return safe_div(_lit(part).cast("double") * F.lit(100.0), whole)


def total_over_groups(x: Column) -> Column:
    """Total of a column of an aggregated result.

    For results with one row per group (tiers, niches, archetypes): a window
    over those few rows costs nothing, a scalar subquery would scan again.
    """
    return F.sum(x).over(Window.partitionBy(F.lit(0)))


def clip(x: Column, lo: float, hi: float) -> Column:
    """Limit to [lo, hi]; null stays null."""
    return F.when(x < lo, F.lit(float(lo))).when(x > hi, F.lit(float(hi))).otherwise(x)


def round_scaled(x: Column, digits: int) -> Column:
    scale = float(10**digits)
    return F.rint(x * F.lit(scale)) / F.lit(scale)


def round_float(x: Column, digits: int) -> Column:
    """Half-even rounding of the exact binary value.

    ``x * scale`` is split into its rounded product and the exact remainder
    (Dekker's product); the remainder settles products that land on a half.
    """
    scale = float(10**digits)
    product = x * F.lit(scale)
    big = x * F.lit(134217729.0)  # 2**27 + 1 splits a double into two halves
    high = big - (big - x)
    low = x - high
    remainder = (high * F.lit(scale) - product) + low * F.lit(scale)
    on_half = product - F.floor(product) == F.lit(0.5)
    rounded = (
        F.when(~on_half | (remainder == 0), F.rint(product))
        .when(remainder > 0, F.ceil(product).cast("double"))
        .otherwise(F.floor(product).cast("double"))
    )
    exact = F.abs(product) < F.lit(2.0**52)
    return F.when(exact, rounded / F.lit(scale)).otherwise(x)
