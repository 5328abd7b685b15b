"""Global ranks without a single-task window.

An un-partitioned ranking window pulls the whole table into one task. Here the
rows are range-partitioned on a *unique* order (value, then id), so even a
value shared by a third of all rows is spread over many partitions. Each row's
place inside its partition plus the partition's offset is its global row
number. The ordered narrow frame is stored once, because offsets and rows must
come from the same partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import materialize
from .quantile import GROUP_LIMIT, kth_value

_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def ntile_of(rn: Column, n: Column, tiles: int) -> Column:
    """NTILE from a row number: the first n mod tiles buckets hold one more row."""
    k = F.lit(int(tiles))
    q, r = F.floor(n / k), n % k
    big = r * (q + 1)
    return F.when(
        rn <= big, F.ceil(rn / (q + 1))
    ).otherwise(r + F.ceil((rn - big) / F.nullif(q, F.lit(0)))).cast("int")


def _ordered(df: DataFrame, order: Sequence[str]) -> tuple[DataFrame, DataFrame, int]:
    """Stored rows with (_part, _idx), and per-partition sizes with offsets."""
    keys = [F.col(c).asc_nulls_first() for c in order]
    placed = materialize(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id()),
        "ordered",
    )
    part = F.shiftright("_at", _ROW_BITS)
    idx = F.col("_at") - F.shiftleft(part, _ROW_BITS)
    rows = placed.select(*df.columns, part.alias("_part"), idx.alias("_idx"))
    # one row per shuffle partition
    sizes = rows.groupBy("_part").agg((F.max("_idx") + 1).alias("size")).collect()
    total, offsets = 0, []
    for r in sorted(sizes, key=lambda r: r["_part"]):
        offsets.append((r["_part"], total))
        total += r["size"]
    table = df.sparkSession.createDataFrame(offsets, "_op bigint, _offset bigint")
    return rows, table, total


def global_row_number(
    df: DataFrame, order: Sequence[str], rn: str = "rn", total: str = "n_total"
) -> DataFrame:
    """Adds the 1-based global row number (nulls first) and the row count.

    ``order`` must identify a row, e.g. (value, id). Pass only the columns
    needed later: the frame is shuffled and stored once.
    """
    rows, offsets, n = _ordered(df, order)
    joined = rows.join(F.broadcast(offsets), F.col("_part") == F.col("_op"))
    return joined.select(
        *df.columns,
        (F.col("_offset") + F.col("_idx") + 1).alias(rn),
        F.lit(n).cast("bigint").alias(total),
    )


def global_ntile(
    df: DataFrame, order: Sequence[str], tiles: int, name: str = "tile"
) -> DataFrame:
    ranked = global_row_number(df, order, "_rn", "_n")
    return ranked.withColumn(name, ntile_of(F.col("_rn"), F.col("_n"), tiles)).drop("_rn", "_n")


def global_rank(
    df: DataFrame,
    value: str,
    tiebreak: Sequence[str],
    rank: str = "rank",
    total: str = "n_total",
    rn: str | None = None,
) -> DataFrame:
    """Adds the competition rank of ``value`` (equal values share the lowest rank),
    the row count and, if named, the row number.

    A run of equal values is found per partition; a run that crosses partitions
    takes its start from the first partition that holds the value. That table
    has two rows per partition and is broadcast.
    """
    rows, offsets, n = _ordered(df, [value, *tiebreak])
    placed = rows.join(F.broadcast(offsets), F.col("_part") == F.col("_op")).withColumn(
        "_rn", F.col("_offset") + F.col("_idx") + 1
    )
    runs = Window.partitionBy("_part", value)
    local = placed.withColumn("_run", F.min("_rn").over(runs))
    last = placed.groupBy("_part").agg(F.max_by(value, "_rn").alias("_last"))
    last = F.broadcast(last.withColumnRenamed("_part", "_lp"))
    last_runs = placed.join(
        last, (F.col("_part") == F.col("_lp")) & F.col(value).eqNullSafe(F.col("_last"))
    )
    # a value that ends several partitions in a row starts in the first of them
    starts = last_runs.groupBy(F.col(value).alias("_bv")).agg(F.min("_rn").alias("_start"))
    return local.join(F.broadcast(starts), F.col(value).eqNullSafe(F.col("_bv")), "left").select(
        *df.columns,
        F.least(F.col("_run"), F.col("_start")).alias(rank),
        *([F.col("_rn").alias(rn)] if rn else []),
        F.lit(n).cast("bigint").alias(total),
    )


def percent_rank_of(rank: Column, n: Column) -> Column:
    return F.when(n > 1, (rank - 1).cast("double") / (n - 1).cast("double")).otherwise(F.lit(0.0))


def global_percent_rank(
    df: DataFrame, value: str, tiebreak: Sequence[str], name: str = "pct_rank"
) -> DataFrame:
    ranked = global_rank(df, value, tiebreak, "_rank", "_n")
    return ranked.withColumn(name, percent_rank_of(F.col("_rank"), F.col("_n"))).drop("_rank", "_n")


def percent_rank_cutoff(n: int, share: float) -> int:
    """Smallest count c of lower-ranked rows with percent rank c/(n-1) >= share."""
    if n <= 1:
        return 0 if share <= 0 else 1
    c = max(0, int(share * (n - 1)) - 2)
    while c / (n - 1) < share:
        c += 1
    return c


def kth_pair(df: DataFrame, value: str, tiebreak: str, k: int, limit: int = GROUP_LIMIT):
    """(value, tiebreak) of the k-th row in (value nulls first, tiebreak) order.

    Two selections instead of a sort. Returns (None, None) when k < 1.
    """
    if k < 1:
        return None, None
    x = F.col(value)
    c = df.agg(F.count("*").alias("n"), F.count(value).alias("k")).first()
    nulls = c["n"] - c["k"]
    if k <= nulls:
        return None, kth_value(df.filter(x.isNull()), tiebreak, k, limit, nulls)
    v = kth_value(df, value, k - nulls, limit, c["k"])
    if v is None:
        return None, None
    at = df.agg(F.count_if(x < F.lit(v)).alias("below"), F.count_if(x == F.lit(v)).alias("ties"))
    t = at.first()
    ties = df.filter(x == F.lit(v))
    return v, kth_value(ties, tiebreak, k - nulls - t["below"], limit, t["ties"])
