"""Exact order statistics and quantiles that never gather a big group in one task.

Spark's exact ``percentile`` keeps every distinct value of a group in one
task. That is right for small groups and is used for them. A group above
``limit`` rows is narrowed first: an approximate equi-depth grid brackets the
wanted rank, one counting pass verifies the bracket exactly, and the bracket
shrinks by orders of magnitude per pass until only about ``limit`` rows are
left to be ranked. Every pass is a scan with map-side aggregation; the data
itself is never sorted or shuffled. Results are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import materialize

GROUP_LIMIT = 1_000_000
BROADCAST_ROWS = 100_000
GRID_STEPS = 500
GRID = [i / GRID_STEPS for i in range(GRID_STEPS + 1)]
ACCURACY = 10_000
MARGIN = 2.0 / ACCURACY
SMALL_GROUP = 1_000  # mean rows of groups whose rows are shuffled as they are
MAX_PASSES = 24  # narrowing by grids; brackets still above the limit are cut into bins instead

BINS = 1024  # into which a pass of bisect_ranks cuts every bracket

RankOf = Callable[[Column], Column]  # non-null count -> 1-based rank


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a frame whose row count was measured and is small."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _unpivot(df: DataFrame, groups: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(groups..., metric, v) with nulls removed; nothing is shuffled."""
    if len(values) == 1:
        long = df.select(*groups, F.lit(values[0]).alias("metric"), F.col(values[0]).alias("v"))
    else:
        cells = F.array(
            *[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in values]
        )
        long = df.select(*groups, F.inline(cells))
    return long.filter(F.col("v").isNotNull())


def _grid_bounds(
    low: Column, high: Column, n: Column, margin: float = MARGIN
) -> tuple[Column, Column]:
    """Grid values around ranks low..high out of n, ``margin`` to either side."""
    below = F.floor((low / n - margin) * GRID_STEPS) - 1
    above = F.ceil((high / n + margin) * GRID_STEPS) + 1
    lo = F.element_at("grid", (F.greatest(below, F.lit(0)) + 1).cast("int"))
    hi = F.element_at("grid", (F.least(above, F.lit(GRID_STEPS)) + 1).cast("int"))
    return lo, hi


def _same(keys: Sequence[str], df: DataFrame) -> Column:
    """Null-safe equality of ``df``'s keys with the other side's ``_``-prefixed ones."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & df[k].eqNullSafe(F.col(f"_{k}"))
    return cond


def _prefixed(keys: Sequence[str]) -> list[Column]:
    return [F.col(k).alias(f"_{k}") for k in keys]


def select_ranks(
    df: DataFrame,
    value_cols: Sequence[str],
    low_rank: RankOf,
    high_rank: RankOf,
    group_cols: Sequence[str] = (),
    limit: int = GROUP_LIMIT,
    rows: int | None = None,
) -> DataFrame:
    """Per group and metric: n, and the values at ranks low and high (low <= high).

    ``rows`` is the size of the largest group when the caller has counted it.
    Output: group_cols..., metric, n, v_low, v_high (null for ranks outside 1..n).
    """
    groups = list(group_cols)
    keys = [*groups, "metric"]
    long = _unpivot(df, groups, value_cols)
    n = F.col("n")
    if rows is None or rows > limit:
        sizes = long.groupBy(*keys).agg(F.count("v").alias("n"))
        size = sizes.agg(F.count("*").alias("groups"), F.max("n").alias("largest")).first()
        groups_n, rows = size["groups"], size["largest"] or 0
    if rows <= limit:  # nothing to narrow: rank all values
        counts = long.groupBy(*keys, "v").agg(F.count("*").alias("c"))
        counts = counts.withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
        counts = counts.withColumn("r_low", low_rank(n)).withColumn("r_high", high_rank(n))
        return _pick_ranks(counts.withColumn("below", F.lit(0)), keys)

    grid = F.percentile_approx("v", GRID, ACCURACY).alias("grid")
    stats = long.groupBy(*keys).agg(F.count("v").alias("n"), grid)
    ranks = stats.withColumn("r_low", low_rank(n)).withColumn("r_high", high_rank(n))
    lo, hi = _grid_bounds(F.col("r_low"), F.col("r_high"), n)
    brackets = materialize(
        ranks.filter("r_low >= 1 and r_high <= n").select(
            *keys, "n", "r_low", "r_high", lo.alias("lo"), hi.alias("hi")
        ),
        "rank-grid",
    )
    margin = MARGIN
    brackets = brackets.withColumn("prev", n + 1)
    for left in range(MAX_PASSES, -1, -1):
        counted = materialize(_count_bracket(long, keys, brackets, groups_n), "rank-bracket")
        # a bracket that missed its rank (approximation error) falls back to the full range
        hit = (F.col("below") < F.col("r_low")) & (F.col("r_high") <= F.col("below") + F.col("inside"))
        # repeated values cannot be narrowed; they collapse when they are counted
        shrinks = (
            (F.col("inside") > limit) & (F.col("lo") < F.col("hi")) & (F.col("inside") < F.col("prev"))
        )
        checks = counted.agg(
            F.bool_and(hit).alias("all_hit"), F.bool_or(shrinks).alias("any_shrinks")
        ).first()
        if checks["all_hit"] is None:  # no group has the wanted rank
            break
        if not checks["all_hit"]:
            margin *= 4
            full = ~hit | F.lit(left <= 1)
            brackets = counted.select(
                *keys, "n", "r_low", "r_high",
                F.when(full, F.col("v_min")).otherwise(F.col("lo")).alias("lo"),
                F.when(full, F.col("v_max")).otherwise(F.col("hi")).alias("hi"),
                (n + 1).alias("prev"),
            )
            continue
        if not checks["any_shrinks"] or left <= 1:
            break
        low, high = F.col("r_low") - F.col("below"), F.col("r_high") - F.col("below")
        lo, hi = _grid_bounds(low, high, F.col("inside"), margin)
        brackets = counted.select(
            *keys, "n", "r_low", "r_high", lo.alias("lo"), hi.alias("hi"),
            F.col("inside").alias("prev"),
        )
    wide = counted.where((F.col("inside") > limit) & (F.col("lo") < F.col("hi")))
    n_wide = wide.count()
    if not n_wide:
        return _rank_inside(long, keys, counted, groups_n)
    found = _bisect_wide(long, keys, wide, n_wide)
    done = counted.where((F.col("inside") <= limit) | (F.col("lo") >= F.col("hi")))
    return _rank_inside(long, keys, done, groups_n).unionByName(found)


def _bisect_wide(long: DataFrame, keys: Sequence[str], wide: DataFrame, rows: int) -> DataFrame:
    """The wanted values of groups whose brackets hold more than one task should rank."""
    rank = F.explode(F.array_distinct(F.array("r_low", "r_high"))).alias("rank")
    # the bracket is not used: its values may repeat without end, and bins find them either way
    found = bisect_ranks(long, keys, wide.select(*keys, rank), 2 * rows)
    b = bounded_broadcast(wide.select(*_prefixed(keys), "n", "r_low", "r_high"), rows)

    def at(rank: str) -> Column:
        return F.max(F.when(F.col("rank") == F.col(rank), F.col("v")))

    return found.join(b, _same(keys, found)).groupBy(*keys, "n").agg(at("r_low").alias("v_low"), at("r_high").alias("v_high"))


def bisect_ranks(long: DataFrame, keys: Sequence[str], wanted: DataFrame, rows: int) -> DataFrame:
    """(keys..., rank, v): the value at each rank of ``wanted`` (keys..., rank; ``rows`` of them, counted)
    among the non-null ``v`` of its group in ``long``. Ranks outside 1..n give no row.

    All ranks share the passes. A pass cuts the bracket of each rank into BINS by value, counts
    every bin with its least and greatest value, and goes on in the bin that holds the rank; ranks
    in the same bracket are counted once. A bin of a single value ends the search, so repeated
    values cost nothing, and nothing is sorted but BINS rows per bracket. Passes alternate between
    bins of equal width and of equal ratio, so that far outliers do not hold the search up.
    """
    keys = list(keys)
    span = [*keys, "lo", "hi", "below"]
    ends = long.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n"))
    b = bounded_broadcast(wanted.select(*_prefixed(keys), F.col("rank").cast("bigint")), rows)
    state = ends.join(b, _same(keys, ends)).where("rank between 1 and n").select(*keys, "rank", "lo", "hi", F.lit(0).cast("bigint").alias("below"))
    state = materialize(state, "rank-bins")
    even = True
    while not state.where("lo < hi").isEmpty():
        brackets = bounded_broadcast(state.where("lo < hi").select(*_prefixed(keys), "lo", "hi", "below").distinct(), rows)
        inside = long.join(brackets, _same(keys, long) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        reach = _reach if even else _log_reach
        place = F.floor(reach("v") / F.nullif(reach("hi"), F.lit(0.0)) * BINS)
        # each end has a bin of its own, so that every pass cuts something off
        place = F.when(F.col("v") == F.col("lo"), -1).when(F.col("v") == F.col("hi"), BINS + 1).otherwise(F.coalesce(place, F.lit(0)))
        bins = inside.groupBy(*span, place.alias("bin")).agg(
            F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("greatest")
        )
        order = Window.partitionBy(*span).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        bins = bins.withColumn("upto", F.col("below") + F.sum("c").over(order))
        bins = bins.select(*_prefixed(span), (F.col("upto") - F.col("c")).alias("before"), "upto", "least", "greatest")
        open_ = state.where("lo < hi")
        holds = (F.col("before") < F.col("rank")) & (F.col("rank") <= F.col("upto"))
        nearer = open_.join(bins, _same(span, open_) & holds).select(
            *keys, "rank", F.col("least").alias("lo"), F.col("greatest").alias("hi"), F.col("before").alias("below")
        )
        state = materialize(state.where("lo >= hi").unionByName(nearer), "rank-bins")
        even = not even
    return state.select(*keys, "rank", F.col("lo").alias("v"))


def _reach(name: str) -> Column:
    """How far a column is above ``lo``; null if that is beyond its type."""
    return F.try_subtract(name, "lo").cast("double")


def _log_reach(name: str) -> Column:
    def scale(c: Column) -> Column:
        return F.signum(c) * F.log1p(F.abs(c))

    return scale(F.col(name).cast("double")) - scale(F.col("lo").cast("double"))


def _count_bracket(
    long: DataFrame, keys: Sequence[str], brackets: DataFrame, rows: int
) -> DataFrame:
    b = bounded_broadcast(
        brackets.select(*_prefixed(keys), "n", "r_low", "r_high", "lo", "hi", "prev"), rows
    )
    joined = long.join(b, _same(keys, long))
    inside = (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))
    return joined.groupBy(*keys, "n", "r_low", "r_high", "lo", "hi", "prev").agg(
        F.count_if(F.col("v") < F.col("lo")).alias("below"),
        F.count_if(inside).alias("inside"),
        F.min("v").alias("v_min"),
        F.max("v").alias("v_max"),
        F.percentile_approx(F.when(inside, F.col("v")), GRID, ACCURACY).alias("grid"),
    )


def _rank_inside(
    long: DataFrame, keys: Sequence[str], brackets: DataFrame, rows: int
) -> DataFrame:
    """Rank the distinct values inside each bracket and pick the wanted ones."""
    b = bounded_broadcast(
        brackets.select(*_prefixed(keys), "n", "r_low", "r_high", "lo", "hi", "below"), rows
    )
    in_bracket = (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))
    kept = long.join(b, _same(keys, long) & in_bracket)
    counts = kept.groupBy(*keys, "n", "r_low", "r_high", "below", "v").agg(
        F.count("*").alias("c")
    )
    return _pick_ranks(counts, keys)


def _pick_ranks(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.withColumn("upto", F.col("below") + F.sum("c").over(order))

    def pick(rank: str) -> Column:
        reached = (F.col("upto") >= F.col(rank)) & F.col(rank).between(F.lit(1), F.col("n"))
        return F.min(F.when(reached, F.col("v")))

    return upto.groupBy(*keys, "n").agg(
        pick("r_low").alias("v_low"), pick("r_high").alias("v_high")
    )


def _interpolated(q: float) -> tuple[RankOf, RankOf, Column]:
    pos = F.lit(float(q)) * (F.col("n") - 1)
    value = F.when(
        F.floor(pos) == F.ceil(pos), F.col("v_low").cast("double")
    ).otherwise(
        (F.ceil(pos) - pos) * F.col("v_low") + (pos - F.floor(pos)) * F.col("v_high")
    )
    low = lambda n: F.floor(F.lit(float(q)) * (n - 1)) + 1
    high = lambda n: F.ceil(F.lit(float(q)) * (n - 1)) + 1
    return low, high, value


def _narrowed_quantiles(
    df: DataFrame, value_cols: Sequence[str], q: float, groups: Sequence[str], limit: int
) -> DataFrame:
    low, high, value = _interpolated(q)
    picked = select_ranks(df, value_cols, low, high, groups, limit)
    long = picked.select(*groups, "metric", value.alias("q"))
    wide = [
        F.max(F.when(F.col("metric") == c, F.col("q"))).alias(c) for c in value_cols
    ]
    return long.groupBy(*groups).agg(*wide) if groups else long.agg(*wide)


def exact_quantiles(
    df: DataFrame,
    value_cols: Sequence[str],
    q: float = 0.5,
    group_cols: Sequence[str] = (),
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Linearly interpolated quantile of each column, one row per group.

    Groups with at most ``limit`` rows use the built-in aggregate; larger ones
    are narrowed as described in the module text. ``df`` is scanned once to
    measure the groups, so pass a stored or narrow frame. With many small groups
    the rows are shuffled by group and aggregated there: the aggregate's buffers
    (a map of values per group and column) would be several times their size.
    """
    groups = list(group_cols)
    builtin = [F.percentile(F.col(c), F.lit(float(q))).alias(c) for c in value_cols]
    if not groups:
        if df.count() <= limit:
            return df.agg(*builtin)
        return _narrowed_quantiles(df, value_cols, q, [], limit)
    sizes = df.groupBy(*groups).agg(F.count("*").alias("_rows"))
    measured = sizes.agg(
        F.count("*").alias("groups"), F.sum("_rows").alias("rows"), F.count_if(F.col("_rows") > limit).alias("hot")
    ).first()
    n_hot, n_groups = measured["hot"], measured["groups"]

    def aggregated(rows: DataFrame) -> DataFrame:
        if n_groups > BROADCAST_ROWS and measured["rows"] <= SMALL_GROUP * n_groups:
            rows = rows.repartition(*groups)
        return rows.groupBy(*groups).agg(*builtin)

    if n_hot == 0:
        return aggregated(df)
    hot = materialize(sizes.filter(F.col("_rows") > limit).select(*groups), "hot-groups")
    b = bounded_broadcast(hot.select(*_prefixed(groups)), n_hot)
    cond = _same(groups, df)
    cold = aggregated(df.join(b, cond, "left_anti"))
    large = _narrowed_quantiles(df.join(b, cond, "left_semi"), value_cols, q, groups, limit)
    return cold.unionByName(large)


def kth_values(
    df: DataFrame,
    column: str,
    ks: Sequence[int],
    limit: int = GROUP_LIMIT,
    rows: int | None = None,
) -> list:
    """The k-th smallest non-null values (1-based); None for ranks outside 1..n.

    ``rows`` is an upper bound of the row count when the caller knows one.
    """
    if rows is None:
        rows = df.count()
    wanted = sorted({k for k in ks if 1 <= k <= rows})
    if not wanted:
        return [None for _ in ks]
    if rows <= limit:
        v = F.col(column)
        counts = df.filter(v.isNotNull()).groupBy(v.alias("v")).agg(F.count("*").alias("c"))
        order = Window.partitionBy(F.lit(0)).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        upto = counts.withColumn("upto", F.sum("c").over(order))
        row = upto.agg(
            *[F.min(F.when(F.col("upto") >= k, F.col("v"))).alias(f"k{k}") for k in wanted]
        ).first()
        found = {k: row[f"k{k}"] for k in wanted}
    else:
        found = binned_values(df, column, wanted)
    return [found.get(k) for k in ks]


def binned_values(df: DataFrame, column: str, ks: Sequence[int]) -> dict:
    """{rank: value} of the non-null values of a column; all ranks share the passes."""
    if not ks:
        return {}
    long = _unpivot(df, (), [column])
    wanted = df.sparkSession.range(1).select(F.lit(column).alias("metric"), F.explode(F.array(*[F.lit(int(k)) for k in ks])).alias("rank"))
    return {r["rank"]: r["v"] for r in bisect_ranks(long, ["metric"], wanted, len(ks)).collect()}


def kth_value(
    df: DataFrame, column: str, k: int, limit: int = GROUP_LIMIT, rows: int | None = None
):
    return kth_values(df, column, [k], limit, rows)[0]
