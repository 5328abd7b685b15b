"""Lookup joins that stay balanced when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import quantile as Q


LEAST_SUPPORT = 1e-4  # share of the rows below which the sketch finds no keys


def heavy_keys(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """(_heavy, _heavy_rows): the keys with more than ``limit`` rows, and how many.

    A sketch of frequent items names every key above a share of the rows, and others; only the
    named ones, at most rows/limit, are counted. Every key is counted where that share is below
    what the sketch resolves.
    """
    keyed = rows.filter(F.col(key).isNotNull()).select(key)
    n = keyed.count()
    if n <= limit:
        return keyed.limit(0).select(F.col(key).alias("_heavy"), F.lit(0).cast("bigint").alias("_heavy_rows"))
    if limit / n >= LEAST_SUPPORT:
        named = keyed.stat.freqItems([key], limit / n).select(F.explode(f"{key}_freqItems").alias("_named"))
        named = materialize(named.distinct(), "frequent-keys")
        keyed = keyed.join(F.broadcast(named), F.col(key) == F.col("_named"), "left_semi")
    counted = keyed.groupBy(key).agg(F.count("*").alias("_rows"))
    return counted.filter(F.col("_rows") > limit).select(F.col(key).alias("_heavy"), F.col("_rows").alias("_heavy_rows"))


def lookup_join(
    rows: DataFrame,
    dim: DataFrame,
    row_key: str,
    dim_key: str,
    how: str = "left",
    limit: int = Q.GROUP_LIMIT,
) -> DataFrame:
    """Join ``rows`` to ``dim``, which has one row per ``dim_key``.

    A small ``dim`` (counted) is broadcast. Otherwise keys with more than
    ``limit`` rows are found (:func:`heavy_keys`); there are at most rows/limit
    of them, so their ``dim`` rows are broadcast and their rows stay where they
    are. Heavy keys too many for that are spread over salts, with a copy of their
    ``dim`` row for each. Only the remaining rows are shuffled by key. Rows
    without a key never meet the shuffle. Pass stored tables: ``rows`` is scanned per part.
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be 'left' or 'inner'")
    on = F.col(row_key) == F.col(dim_key)
    if dim.count() <= Q.BROADCAST_ROWS:
        return rows.join(F.broadcast(dim), on, how)
    heavy = materialize(heavy_keys(rows, row_key, limit), "heavy-keys")
    keyed, parts = rows.filter(F.col(row_key).isNotNull()), []
    n, most = heavy.agg(F.count("*"), F.max("_heavy_rows")).first()
    if n > Q.BROADCAST_ROWS:
        spread, keyed = _salted(keyed, dim, heavy, row_key, dim_key, -(-most // limit))
        parts.append(spread if how == "left" else spread.filter(F.col(dim_key).isNotNull()))
    elif n:
        b = F.broadcast(heavy)
        hot_dim = dim.join(b, F.col(dim_key) == F.col("_heavy"), "left_semi")
        is_heavy = F.col(row_key) == F.col("_heavy")
        hot = keyed.join(b, is_heavy, "left_semi")
        parts.append(hot.join(Q.bounded_broadcast(hot_dim, n), on, how))
        keyed = keyed.join(b, is_heavy, "left_anti")
    parts.append(keyed.join(dim, on, how))
    if how == "left":
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in dim.schema]
        parts.append(rows.filter(F.col(row_key).isNull()).select("*", *empty))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _salted(
    rows: DataFrame, dim: DataFrame, heavy: DataFrame, row_key: str, dim_key: str, salts: int
) -> tuple[DataFrame, DataFrame]:
    """Rows of heavy keys with their ``dim`` columns (null if there is none), and the other rows.

    The join is on key and salt, so a key's rows go to as many tasks as there are salts. A heavy
    key without a ``dim`` row takes part too, or its rows would meet in one task later."""
    hot = heavy.join(dim, F.col("_heavy") == F.col(dim_key), "left").drop("_heavy_rows")
    hot = hot.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int")
    salted = rows.withColumn("_row_salt", salt)
    marked = salted.join(hot, (F.col(row_key) == F.col("_heavy")) & (F.col("_row_salt") == F.col("_salt")), "left")
    marked = materialize(marked.drop("_salt", "_row_salt"), "salted-rows")
    rest = marked.filter(F.col("_heavy").isNull()).select(*rows.columns)
    return marked.filter(F.col("_heavy").isNotNull()).drop("_heavy"), rest
