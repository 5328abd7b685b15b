"""Keep-first deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

REPEATED_ROWS = 2_000_000  # repeated keys whose 64-bit hashes are sent to every task


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(_key..., _n): the keys with several rows, null keys being one, and their rows; stored."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    return materialize(counted.select(*[F.col(k).alias(f"_{k}") for k in keys], "_n"), "repeated-keys")


def keep_first(
    df: DataFrame,
    keys: list[str],
    position: str,
    repeated_limit: int = REPEATED_ROWS,
    repeated: DataFrame | None = None,
) -> DataFrame:
    """The row with the smallest ``position`` per key; null keys form one group.

    Keys alone are counted first (``repeated`` if the caller has done so). Rows of a key that
    occurs once pass through where they are; only rows of repeated keys are reduced to their
    first. Tasks tell them by the hash of the key; a single key of an equal hash is reduced too,
    to itself. If more than ``repeated_limit`` keys are repeated, too many to send to every task,
    all rows are reduced.
    """
    repeated = repeated_keys(df, keys) if repeated is None else repeated
    n = repeated.count()
    if n > repeated_limit:
        return _first_rows(df, keys, position)
    hashes = F.broadcast(repeated.select(F.xxhash64(*[F.col(f"_{k}") for k in keys]).alias("_hash")))
    same = F.xxhash64(*[df[k] for k in keys]) == F.col("_hash")
    once = df.join(hashes, same, "left_anti")
    return once.unionByName(_first_rows(df.join(hashes, same, "left_semi"), keys, position)) if n else once


def _first_rows(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """An aggregate, not a ranking window: each task first reduces its own rows to one per key,
    so a key repeated in a third of the table sends one row per task through the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.col(position)).alias("_first")
    return df.groupBy(*keys).agg(first).select(
        *[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns]
    )
