"""Multi-restart k-means as a short series of Spark jobs.

All restarts (and all K of a sweep) advance together: one pass over the points
per iteration assigns every point under every live run and reduces to one row
per (run, cluster). Only those sums reach the driver. Points are packed into
blocks once and reduced with matrix products inside each task, so no per-point
row leaves a task, and none is converted in a pass. A block's products give the
distances to all centroids up to a constant; where two of a run's are as near as
rounding, the point is measured again in plain differences, so that products
decide no tie.

Once a run moves little, most of its points cannot change cluster: by the triangle
inequality a point keeps its cluster while no centroid has moved by half of its
margin, the distance to the second nearest centroid less that to the nearest. A pass
then splits the points: those of a wide margin are settled and stay in as sums, the
others, a bounded number, come to the driver, and the run goes on from the settled
sums and the few open points, without a job per iteration, until its centroids have
moved by half the margin. Then a pass over all points begins anew. Labels are those
of plain iteration; settled points are not measured again.

Where a table is so large that its open points would be too many for the driver, they
stay with the blocks: a pass that narrows a run settles what has a wide margin and
writes down, per block, the places of the run's open points. The passes that follow
measure these places alone, until the centroids have moved by half the margin.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


SMALL_TASK = 200_000  # rows per core below which a table counts as small
OPEN_SHARE = 0.25  # of the points that a split may leave open
OPEN_ROWS = 400_000  # open points, of all runs together, that may come to the driver
#: Margins counted in a pass, as upper ends; a run's margin is chosen among them.
MARGINS = 10.0 ** np.arange(-7, 1.01, 0.125)
COUNTED = 8, 64  # one of so many points is counted, fewer in large tables; the counts only choose a margin
COUNTED_ROWS = 100_000  # points of a run that are enough to count
BLOCK = 32_768  # points packed together; at most 65,536, places in a block are 16-bit numbers
PART_BYTES = 32_000_000  # of packed points in a partition, about
SCORES = 131_072  # of a matrix product, so that what follows finds them in the cache
LISTED_ROWS = 1_000_000  # points from which the open ones of a run are written down with the blocks
SETTLING = 2.5  # passes over a run's points that narrowing it costs
GAIN = 0.7  # of the work of a pass: what narrowing must bring it below
LASTS = 3  # passes that a narrowed run must be expected to last
COUNTED_EVERY = 4  # passes of a run in a large table from one count of margins to the next
NEAR_TIE = 1e-11  # of the squared sizes: a difference of squared distances that products may get wrong
REACH = 6.0, 60.0  # a margin is at least and about at most so many times the last move of the centroids
PATIENCE = 3  # passes that a run ready to be split waits until half of the others are
STARTS_SPARE = 6.0  # standard deviations of spare in the expected number of start candidates


def portable_hash(key: str, seed: int = 0) -> Column:
    """Pseudo-random order of rows by key that any SQL engine can reproduce."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


@dataclass
class Standardized:
    """Z-scored feature rows and the statistics to undo it."""

    points: DataFrame  # key, f0..f{d-1}
    features: list[str]
    columns: list[str]
    mean: list[float]
    std: list[float]
    n: int
    n_rejected: int


def complete_row(features: Sequence[str]) -> Column:
    """Every feature present and a number: the rows that can be placed."""
    complete = F.lit(True)
    for c in features:
        complete = complete & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return complete


def standardize(df: DataFrame, key: str, features: Sequence[str]) -> Standardized:
    """(x - mean) / population std per feature, std 0 read as 1.

    Rows with a missing feature cannot be placed; they are left out and counted.
    Statistics take one aggregate and come back as literals.
    """
    features = list(features)
    complete = complete_row(features)
    whole = [F.when(complete, F.col(c).cast("double")) for c in features]
    stats = df.agg(
        F.count_if(complete).alias("n"),
        F.count("*").alias("all"),
        *[F.avg(x).alias(f"m{i}") for i, x in enumerate(whole)],
        *[F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(whole)],
    ).first()
    d = range(len(features))
    mean = [stats[f"m{i}"] or 0.0 for i in d]
    std = [stats[f"s{i}"] or 1.0 for i in d]
    cols = [f"f{i}" for i in d]
    points = df.filter(complete).select(
        key,
        *[
            ((F.col(c).cast("double") - F.lit(m)) / F.lit(s)).alias(f)
            for c, m, s, f in zip(features, mean, std, cols)
        ],
    )
    return Standardized(points, features, cols, mean, std, stats["n"], stats["all"] - stats["n"])


def distances(columns: Sequence[str], centroids) -> list[Column]:
    """Euclidean distance to each centroid as plain arithmetic (stays in codegen)."""
    out = []
    for c in centroids:
        total = None
        for f, v in zip(columns, c):
            diff = F.col(f) - F.lit(float(v))
            total = diff * diff if total is None else total + diff * diff
        out.append(F.sqrt(total))
    return out


def nearest(columns: Sequence[str], centroids) -> Column:
    """Index of the nearest centroid, the lowest on ties."""
    d = F.array(*distances(columns, centroids))
    return (F.array_position(d, F.array_min(d)) - 1).cast("int")


def assign_clusters(points: DataFrame, columns: Sequence[str], centroids) -> DataFrame:
    return points.withColumn("cluster", nearest(columns, centroids))


def update_centroids(assigned: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean of each cluster; map-side partial sums, one row per cluster."""
    return assigned.groupBy("cluster").agg(
        F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns]
    )


def inertia(assigned: DataFrame, columns: Sequence[str], centroids) -> DataFrame:
    """Sum of squared distances to the assigned centroid."""
    total = F.lit(0.0)
    for j, f in enumerate(columns):
        center = F.element_at(
            F.array(*[F.lit(float(c[j])) for c in centroids]), F.col("cluster") + 1
        )
        diff = F.col(f) - center
        total = total + diff * diff
    return assigned.agg(F.sum(total).alias("inertia"))


@dataclass
class Run:
    """One restart: its centroids before and after the last update."""

    k: int
    seed: int
    restart: int
    centroids: np.ndarray
    label_centroids: np.ndarray | None = None
    history: list[float] = field(default_factory=list)
    done: bool = False
    restarted: int = 0  # clusters that were emptied and placed anew so far
    moved: float = np.inf  # largest move of a centroid in the last iteration
    margins: np.ndarray | None = None  # points of the last pass with a margin up to each of MARGINS
    points: int = 0  # of the last pass
    distances: int = 0  # point-to-centroid distances measured
    counted_at: int = -COUNTED_EVERY  # iterations before the last count of margins
    listed: int | None = None  # open points written down with the blocks; None: every point is open
    settled: np.ndarray | None = None  # (n, squared norm, sums) of the other points of each cluster
    bounds: list[tuple[np.ndarray, float]] = field(default_factory=list)  # centroids and margin of the settled points

    @property
    def inertia(self) -> float:
        return self.history[-1]

    def slack(self) -> float:
        """How much the centroids may still move, at least, before a settled point can change cluster, doubled."""
        return min((m * (1 - 1e-9) - 2 * _shift(self.centroids - base) for base, m in self.bounds), default=np.inf)

    def reopen(self) -> None:
        """Every point is open again."""
        self.listed, self.settled, self.bounds = None, None, []


def _shift(moves: np.ndarray) -> float:
    """The longest of the moves."""
    return float(np.sqrt((moves**2).sum(axis=1)).max())


def start_points(
    points: DataFrame, key: str, columns: Sequence[str], orders: Sequence[tuple[int, int]], count: int
) -> dict[tuple[int, int], np.ndarray]:
    """The first ``count`` points of the whole table in the order of each (seed, restart).

    The order is that of md5(key:seed:restart), which any SQL engine can repeat; the key's
    features break ties. Only rows whose hash lies below a share of all hashes that holds enough
    rows are ordered at all; the share grows where it held too few.
    """
    cols, orders = list(columns), list(dict.fromkeys(orders))
    n = points.count()
    out: dict[tuple[int, int], np.ndarray] = {}
    expected = count + STARTS_SPARE * count**0.5 + STARTS_SPARE**2
    while len(out) < len(orders):
        open_ = [o for o in orders if o not in out]
        share = expected / n if n else 1.0
        # hashes are uniform: those below the share hold about ``expected`` rows
        limit = None if share >= 1 else f"{int(share * 16**12):012x}"
        text = F.col(key).cast("string")
        hashes = [F.struct(F.lit(i).alias("slot"), _order_hash(text, *o).alias("h")) for i, o in enumerate(open_)]
        near = F.array(*hashes) if limit is None else F.filter(F.array(*hashes), lambda x: x["h"] < limit)
        order = Window.partitionBy("slot").orderBy("h", *cols)
        # in compiled code; arrays are made of the few rows that are below the limit in some order
        least = reduce(F.least, [_order_hash(text, *o) for o in open_])
        some = points if limit is None else points.where(least < limit)
        rows = some.select(F.inline(near), *cols).withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= count).collect()
        found: dict[int, list] = {i: [] for i in range(len(open_))}
        for r in sorted(rows, key=lambda r: (r["slot"], r["rn"])):
            found[r["slot"]].append([r[c] for c in cols])
        for i, o in enumerate(open_):
            if limit is None or len(found[i]) == count:
                out[o] = np.array(found[i], dtype=float).reshape(len(found[i]), len(cols))
        expected *= 4  # too few below the share: look further
    return out


def _order_hash(key: Column, seed: int, restart: int) -> Column:
    """Place of a row in an order; a row without key hashes as the empty text."""
    return F.md5(F.concat(F.coalesce(key, F.lit("")), F.lit(f":{seed}:{restart}")))


def make_runs(
    points: DataFrame, key: str, columns: Sequence[str], specs: Sequence[tuple[int, int, int]]
) -> list[Run]:
    """A run per (k, seed, restart), started at the first k points of its order."""
    starts = start_points(points, key, columns, [s[1:] for s in specs], max(s[0] for s in specs))
    for k, seed, restart in specs:
        if k > len(starts[seed, restart]):
            raise ValueError(f"cannot place {k} centroids on {len(starts[seed, restart])} points")
    return [Run(k, seed, restart, starts[seed, restart][:k].copy()) for k, seed, restart in specs]


def _measured(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of points to centroids."""
    dist = np.zeros((len(x), len(centroids)))
    for j in range(x.shape[1]):
        diff = x[:, j : j + 1] - centroids[:, j]
        dist += diff * diff
    return dist


def _summed(x: np.ndarray, dist: np.ndarray, near: np.ndarray, k: int) -> np.ndarray:
    """(k, d + 2): n, squared distance and sums of the points of each cluster."""
    weights = [None, dist[np.arange(len(x)), near], *x.T]
    return np.stack([np.bincount(near, weights=w, minlength=k) for w in weights], axis=1)


def _margin(dist: np.ndarray) -> np.ndarray:
    """Distance to the second nearest centroid less that to the nearest."""
    if dist.shape[1] < 2:
        return np.full(len(dist), np.inf)
    rows, near = np.arange(len(dist)), np.argmin(dist, axis=1)
    first = dist[rows, near]
    rest = dist.copy()
    rest[rows, near] = np.inf
    return np.sqrt(rest.min(axis=1)) - np.sqrt(first)


def _packed(points: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The points as blocks: the doubles of up to BLOCK points, column after column."""

    def pack(batches):
        import pyarrow as pa

        rest = np.zeros((len(columns), 0))
        for batch in batches:
            rest = np.concatenate([rest, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])], axis=1)
            whole = rest.shape[1] // BLOCK * BLOCK
            if whole:
                yield blocks(pa, rest[:, :whole])
                rest = rest[:, whole:]
        if rest.shape[1]:
            yield blocks(pa, rest)

    def blocks(pa, x: np.ndarray):
        parts = [x[:, lo : lo + BLOCK].astype(float).tobytes() for lo in range(0, x.shape[1], BLOCK)]
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], names=["block"])

    return points.select(*columns).mapInArrow(pack, "block binary")


class _Sums:
    """(squared norms, n, sums) of the points of each cluster, of all given centroid sets at once."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        stacked = np.concatenate(sets)
        self.norms = (stacked * stacked).sum(axis=1)
        self.factors = np.column_stack([self.norms, -2 * stacked])
        self.totals = np.zeros((len(stacked), stacked.shape[1] + 2))
        self.settled = np.zeros_like(self.totals)
        self.ends = np.cumsum([len(c) for c in sets])
        #: (first row, sets, K) of neighbouring sets of the same K
        self.groups: list[tuple[int, int, int]] = []
        for end, c in zip(self.ends, sets):
            if self.groups and self.groups[-1][2] == len(c):
                a, n, k = self.groups.pop()
                self.groups.append((a, n + 1, k))
            else:
                self.groups.append((int(end) - len(c), 1, len(c)))
        self.at_once = max(1, SCORES // len(stacked))
        self.spaces = np.empty(0), np.empty(0)

    def add(self, x: np.ndarray) -> None:
        """Count the points ``x`` (d, n) to their nearest centroids."""
        for lo in range(0, x.shape[1], self.at_once):
            self._add(x[:, lo : lo + self.at_once])

    def _scored(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """What is summed of points, (d + 2, n); their squared distances to the centroids less those to the
        origin; what products may get wrong in a difference of these. The arrays are used again."""
        rows, n = len(self.factors), x.shape[1]
        if len(self.spaces[0]) < rows * n:
            self.spaces = np.empty(rows * n), np.empty((len(x) + 2) * n)
        scores = self.spaces[0][: rows * n].reshape(rows, n)
        summed = self.spaces[1][: (len(x) + 2) * n].reshape(-1, n)
        np.einsum("ij,ij->j", x, x, out=summed[0])
        summed[1] = 1
        summed[2:] = x
        np.matmul(self.factors, summed[1:], out=scores)
        return summed, scores, NEAR_TIE * (summed[0].max() + self.norms.max())

    def _add(self, x: np.ndarray) -> None:
        n = x.shape[1]
        summed, hits, wrong = self._scored(x)
        for a, sets, k in self.groups:
            score = hits[a : a + sets * k].reshape(sets, k, n)
            np.less_equal(score, score.min(axis=1, keepdims=True) + wrong, out=score, casting="unsafe")
        found = hits @ summed.T
        if found[:, 1].sum() != len(self.sets) * n or not np.isfinite(wrong):
            self._settle_ties(x, hits)
            found = hits @ summed.T
        self.totals += found

    def _settle_ties(self, x: np.ndarray, hits: np.ndarray) -> None:
        for end, c in zip(self.ends, self.sets):
            own = hits[end - len(c) : end]
            tied = np.flatnonzero(own.sum(axis=0) != 1)
            if len(tied):
                near = np.argmin(_measured(x[:, tied].T, c), axis=1)
                own[:, tied] = 0
                own[near, tied] = 1

    def settle(self, x: np.ndarray, margin: float) -> np.ndarray:
        """Settle the points ``x`` (d, n) whose margin is wider, of the only centroid set; places of the others."""
        return np.concatenate([np.zeros(0, np.int64), *(lo + self._settle(x[:, lo : lo + self.at_once], margin) for lo in range(0, x.shape[1], self.at_once))])

    def _settle(self, x: np.ndarray, margin: float) -> np.ndarray:
        summed, scores, wrong = self._scored(x)
        first = scores.min(axis=0)
        hits = scores == first
        np.copyto(scores, np.inf, where=hits)
        second = scores.min(axis=0)
        # the least margin that the products allow
        widths = [np.sqrt(np.maximum(s + summed[0], 0) + wrong) for s in (first, second)]
        far = (second - first - 2 * wrong) / (widths[0] + widths[1]) > margin
        np.logical_and(hits, far, out=scores, casting="unsafe")
        found = scores @ summed.T
        if found[:, 1].sum() != np.count_nonzero(far):  # a tie leaves the point open
            far &= hits.sum(axis=0) == 1
            found = (hits & far) @ summed.T
        self.settled += found
        return np.flatnonzero(~far)

    def result(self) -> list[np.ndarray]:
        """Per set the array of :func:`_summed`."""
        return [_around(self.totals[end - len(c) : end, [1, 0, *range(2, self.totals.shape[1])]], c) for end, c in zip(self.ends, self.sets)]


def _around(totals: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(n, squared norms, sums) of each cluster with squared distances to its centroid in place of squared norms."""
    out = totals.copy()
    out[:, 1] += out[:, 0] * (centroids * centroids).sum(axis=1) - 2 * (centroids * out[:, 2:]).sum(axis=1)
    return out


@dataclass
class _Lists:
    """What a pass does with the places written down with the blocks: one entry per set."""

    slots: list[int]  # the set's number, the same in all passes
    total: int  # numbers in use
    listed: list[bool]  # measured at its places only
    narrowed: list[float | None]  # the margin to settle at; the places of open points are written down


def _places(written: bytes, total: int) -> list[np.ndarray]:
    """Per slot the places written down with a block."""
    if not written:
        return [np.zeros(0, np.uint16)] * total
    ends = np.frombuffer(written, np.int64, total)
    return np.split(np.frombuffer(written, np.uint16, offset=8 * total), ends[:-1])


def _written(places: list[np.ndarray]) -> bytes:
    ends = np.cumsum([len(p) for p in places]).astype(np.int64)
    return ends.tobytes() + np.concatenate(places).astype(np.uint16).tobytes()


def _scan(columns: Sequence[str], sets: list[np.ndarray], counted: list[int], margins: list[float | None], lists: _Lists):
    """The function of a pass over packed points. A row of its output is (part, slot, numbers): sums of
    the measured points of a cluster or, in a slot beyond all clusters, of those settled now (part 0),
    counted margins of a run (part 1), or an open point of a run (part 2). Where a run is narrowed it
    also has the blocks and the places of open points (part 3)."""
    d = len(columns)
    ends = np.cumsum([len(s) for s in sets]).tolist()
    spans = list(zip([0, *ends[:-1]], ends))
    width = d + 2
    lines = -(-len(MARGINS) // width)  # rows that hold the counted margins of a run
    narrowed = any(m is not None for m in lists.narrowed)
    limits = [s if n is None else n for s, n in zip(margins, lists.narrowed)]
    whole = [i for i, m in enumerate(limits) if m is None and not lists.listed[i]]
    alone = [i for i in range(len(sets)) if i not in whole]
    steps = {i: counted[i] for i in whole if counted[i]}
    used = {slot for slot, on, n in zip(lists.slots, lists.listed, lists.narrowed) if on or n is not None}
    names = ["part", "slot", *(f"t{w}" for w in range(width))]

    def run(batches):
        import pyarrow as pa

        counts = np.zeros((len(sets), lines * width))
        sums = _Sums([sets[i] for i in whole]) if whole else None
        own = {i: _Sums([sets[i]]) for i in alone}

        def batch_of(part: int, slots: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            cells = [np.full(len(slots), part, np.int32), slots.astype(np.int32), *np.ascontiguousarray(values.T)]
            none = [pa.nulls(len(slots), pa.binary())] * 2 if narrowed else []
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cells] + none, names=names + (["block", "places"] if narrowed else []))

        def block_of(block, places: list[np.ndarray]) -> pa.RecordBatch:
            cells = [pa.array([v], pa.int32()) for v in (3, 0)] + [pa.nulls(1, pa.float64())] * width
            return pa.RecordBatch.from_arrays([*cells, pa.array([block.as_py()], pa.binary()), pa.array([_written(places)], pa.binary())], names=[*names, "block", "places"])

        for batch in batches:
            for block, written in zip(batch.column(0), batch.column(1)):
                x = np.frombuffer(block.as_buffer()).reshape(d, -1)
                places = _places(written.as_py(), lists.total)
                if sums:
                    sums.add(x)
                for i, step in steps.items():
                    margin = np.sort(_margin(_measured(x[:, ::step].T, sets[i])))
                    counts[i, : len(MARGINS)] += step * np.searchsorted(margin, MARGINS, side="right")
                for i in alone:
                    at = places[lists.slots[i]] if lists.listed[i] else None
                    part = x if at is None else x.take(at, axis=1)
                    if limits[i] is not None:
                        open_ = own[i].settle(part, limits[i])
                        part = part[:, open_]
                        if lists.narrowed[i] is None:
                            yield batch_of(2, np.full(len(open_), i), np.pad(part.T, ((0, 0), (0, 2))))
                            continue
                        places[lists.slots[i]] = open_ if at is None else at[open_]
                    own[i].add(part)
                if narrowed:
                    yield block_of(block, [p if slot in used else p[:0] for slot, p in enumerate(places)])
        totals = np.zeros((2 * ends[-1], width))
        for i, end in zip(whole, sums.ends if sums else []):
            totals[slice(*spans[i])] = sums.totals[end - len(sets[i]) : end]
        for i in alone:
            a, b = spans[i]
            totals[a:b], totals[ends[-1] + a : ends[-1] + b] = own[i].totals, own[i].settled
        totals[:, [0, 1]] = totals[:, [1, 0]]
        yield batch_of(0, np.arange(len(totals)), totals)
        for i in steps:
            yield batch_of(1, i * lines + np.arange(lines), counts[i].reshape(lines, width))

    schema = ", ".join(["part int, slot int", *[f"t{w} double" for w in range(width)], *(["block binary, places binary"] if narrowed else [])])
    return run, schema, spans, lines


@dataclass
class _Found:
    """What a pass found, per set."""

    measured: list[np.ndarray]  # (K, d + 2): n, squared norms and sums of the measured points
    settled: list[np.ndarray]  # the same of the points settled in this pass
    counts: list[np.ndarray]  # counted margins
    open_points: list[np.ndarray] | None  # of the sets with a margin; None if they are more than OPEN_ROWS
    rows: DataFrame | None  # checkpointed, with the blocks and the new places, if a run was narrowed


def _pass(
    points: DataFrame,
    columns: Sequence[str],
    sets: list[np.ndarray],
    counted: list[int],
    margins: list[float | None],
    lists: _Lists,
) -> _Found:
    """One scan of the packed points for centroid sets.

    Each task reduces its points to one row per (set, cluster); those are summed over tasks."""
    run, schema, spans, lines = _scan(columns, sets, counted, margins, lists)
    found = points.mapInArrow(run, schema)
    split = any(m is not None for m in margins)
    narrowed = any(m is not None for m in lists.narrowed)
    # read by its sums, its size and its rows; blocks are read by all later passes, whose plans must not grow
    if narrowed:
        found = found.localCheckpoint()
    elif split:
        found = found.persist()
    names = [f"t{w}" for w in range(len(columns) + 2)]
    totals = np.zeros((2 * spans[-1][1], len(names)))
    counts = np.zeros((len(sets) * lines, len(names)))
    summed = found.where("part < 2").groupBy("part", "slot").agg(*[F.sum(n) for n in names])
    for part, slot, *values in summed.collect():
        (totals if part == 0 else counts)[slot] = values
    open_points: list[np.ndarray] | None = [np.zeros((0, len(columns)))] * len(sets)
    if split:
        rows = found.where("part = 2").select("slot", *names[: len(columns)])
        if rows.count() > OPEN_ROWS:
            open_points = None
        else:
            table = rows.toArrow()
            slot = table["slot"].to_numpy()
            x = np.column_stack([table[n].to_numpy() for n in names[: len(columns)]])
            open_points = [x[slot == i] for i in range(len(sets))]
    if split and not narrowed:
        found.unpersist()
    measured, settled = ([half[a:b] for a, b in spans] for half in np.split(totals, 2))
    counts = list(counts.reshape(len(sets), -1)[:, : len(MARGINS)])
    return _Found(measured, settled, counts, open_points, found if narrowed else None)


def _advance(run: Run, totals: np.ndarray, tol: float, place=None) -> bool:
    """Move a run's centroids to the means of its clusters; False, and nothing done, if a cluster is
    empty and ``place`` gives no centroid for it."""
    n, sq, sums = totals[:, 0], totals[:, 1], totals[:, 2:]
    filled = n > 0
    if not filled.all() and place is None:
        return False
    new = np.empty_like(run.centroids)
    new[filled] = sums[filled] / n[filled, None]
    for c, point in zip(np.flatnonzero(~filled), place(int((~filled).sum())) if not filled.all() else ()):
        new[c] = point
    # spread around the new means: shift the sums taken around the old ones
    moved = ((new - run.centroids) ** 2).sum(axis=1)
    run.history.append(float((sq[filled] - n[filled] * moved[filled]).sum()))
    run.label_centroids, run.centroids = run.centroids, new
    run.moved = float(np.sqrt(moved.max()))
    run.done = bool(run.moved < tol)
    return True


def _go_on(run: Run, settled: np.ndarray, points: np.ndarray, margin: float, max_iter: int, tol: float) -> None:
    """Iterate on settled sums and open points while the settled ones cannot change cluster."""
    base = run.centroids
    around = settled[:, 2:] - settled[:, :1] * base  # sums of the differences from ``base``
    while not run.done and len(run.history) < max_iter:
        shift = run.centroids - base
        if 2 * _shift(shift) >= margin * (1 - 1e-9) or run.slack() <= 0:
            return
        totals = settled.copy()
        totals[:, 1] += settled[:, 0] * (shift**2).sum(axis=1) - 2 * (shift * around).sum(axis=1)
        dist = _measured(points, run.centroids)
        totals += _summed(points, dist, np.argmin(dist, axis=1), run.k)
        run.distances += dist.size
        if not _advance(run, totals, tol):
            return


def _chosen_margin(run: Run, rows: int) -> float | None:
    """A counted margin that leaves few points open, at most ``rows``, and is worth a split, if there is one."""
    if run.margins is None or run.k < 2:
        return None
    fits = MARGINS[run.margins <= min(rows, OPEN_SHARE * run.points)]
    fits = fits[fits >= REACH[0] * run.moved]
    if not len(fits):
        return None
    enough = fits[fits >= REACH[1] * run.moved]
    return float(enough[0] if len(enough) else fits[-1])


def _narrow_margin(run: Run) -> float | None:
    """The counted margin that makes a run's next passes cheapest if it is narrowed now, if that is worth it.

    A margin lasts until the centroids have moved by half of it. Until then a pass measures the points
    within the margin and its part of the work of narrowing, which begins from the points now open."""
    if run.margins is None or run.k < 2 or run.points < LISTED_ROWS or not 0 < run.moved < np.inf:
        return None
    now = 1.0 if run.listed is None else run.listed / run.points
    share = run.margins / run.points
    lasts = np.minimum(MARGINS, run.slack()) / (2 * run.moved)
    cost = np.where((lasts >= LASTS) & (share <= OPEN_SHARE), SETTLING * now / np.maximum(lasts, LASTS) + share, np.inf)
    best = int(np.argmin(cost))
    return float(MARGINS[best]) if cost[best] < GAIN * now else None


def lloyd(
    points: DataFrame,
    key: str,
    columns: Sequence[str],
    runs: list[Run],
    max_iter: int = 300,
    tol: float = 1e-6,
) -> list[Run]:
    """Advance all runs until each converges or reaches ``max_iter``.

    A run ends when its largest centroid shift falls below ``tol``; finished
    runs drop out of the pass. A cluster that lost all points restarts at the
    next point of the run's own order.
    """
    _iterate(points, _dealt(points, columns), key, columns, runs, max_iter, tol)
    return runs


def _dealt(points: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The packed points without places; those of a large table in parts of like size, a few per core, as every
    pass waits for its longest task."""
    packed = _packed(points, columns)
    cores = points.sparkSession.sparkContext.defaultParallelism
    n = points.count()
    if n > cores * SMALL_TASK:
        packed = packed.repartition(cores * -(-n * len(columns) * 8 // (cores * PART_BYTES)))
    return packed.select("block", F.lit("").cast("binary").alias("places"))


def _count_step(run: Run) -> int:
    """One of so many points is counted; 0 in a pass without count."""
    if run.moved >= MARGINS[-1] / REACH[0] or run.points >= LISTED_ROWS and len(run.history) < run.counted_at + COUNTED_EVERY:
        return 0
    least, most = COUNTED
    return max(least, min(most, run.points // COUNTED_ROWS))


@dataclass
class _Patience:
    """Runs that are ready for a step wait until half of the others are, or for a few passes."""

    waited: int = 0

    def checked(self, asked: list[float | None], others: int) -> list[float | None]:
        ready = sum(m is not None for m in asked)
        self.waited = self.waited + 1 if ready else 0
        if 2 * ready < others and self.waited < PATIENCE:
            return [None] * len(asked)
        self.waited = 0
        return asked


def _iterate(
    points: DataFrame, packed: DataFrame, key: str, columns: Sequence[str], runs: list[Run], max_iter: int, tol: float
) -> None:
    first, kept = packed.persist(), None  # the blocks, and the rows that have them with their places
    splits, narrows = _Patience(), _Patience()
    try:
        while live := [r for r in runs if not r.done and len(r.history) < max_iter]:
            for r in live:
                if r.slack() <= 0:
                    r.reopen()
            margins = splits.checked([_chosen_margin(r, OPEN_ROWS // len(live)) for r in live], len(live))
            narrow = narrows.checked([_narrow_margin(r) if m is None else None for r, m in zip(live, margins)], sum(r.listed is None for r in live))
            counted = [_count_step(r) if r.listed is None and m is None and n is None else 0 for r, m, n in zip(live, margins, narrow)]
            before = [r.centroids for r in live]
            lists = _Lists([next(i for i, other in enumerate(runs) if other is r) for r in live], len(runs), [r.listed is not None for r in live], narrow)
            found = _pass(packed, columns, before, counted, margins, lists)
            if found.rows is not None:
                _forget(first, kept)
                kept, packed = found.rows, found.rows.where("part = 3").select("block", "places")
            for i, r in enumerate(live):
                _take(r, i, found, counted[i], margins[i], narrow[i], points, key, columns, max_iter, tol)
    finally:
        _forget(first, kept)


def _forget(first: DataFrame, kept: DataFrame | None) -> None:
    """Free the blocks of earlier passes."""
    if kept is None:
        first.unpersist()
    else:
        kept._jdf.queryExecution().logical().rdd().unpersist(False)


def _take(
    r: Run, i: int, found: _Found, asked: int, margin: float | None, narrow: float | None,
    points: DataFrame, key: str, columns: Sequence[str], max_iter: int, tol: float,
) -> None:
    """Go on with a run after a pass in which it was the set ``i``."""
    measured, newly = found.measured[i], found.settled[i]
    settled = newly if r.settled is None else r.settled + newly
    if margin is not None:
        if found.open_points is None:
            r.margins = None  # out of date: to be counted again before the next split
            r.counted_at = -COUNTED_EVERY
            r.reopen()
            return
        r.points = int(settled[:, 0].sum()) + len(found.open_points[i])
        r.distances += r.k * (int(newly[:, 0].sum()) + len(found.open_points[i]))
        iterations = len(r.history)
        _go_on(r, _around(settled, r.centroids), found.open_points[i], margin, max_iter, tol)
        if len(r.history) == iterations:
            r.margins = None  # a cluster is empty: the next pass places it
        return
    r.points = int(settled[:, 0].sum() + measured[:, 0].sum())
    r.distances += r.k * int(newly[:, 0].sum() + measured[:, 0].sum())
    if narrow is not None:
        r.settled, r.listed, r.bounds = settled, int(measured[:, 0].sum()), [*r.bounds, (r.centroids, narrow)]
    if asked:
        r.margins, r.counted_at = found.counts[i], len(r.history)

    def place(wanted: int) -> list[np.ndarray]:
        order = start_points(points, key, columns, [(r.seed, r.restart)], r.k + r.restarted + wanted)[r.seed, r.restart]
        r.restarted += wanted
        return [order[(r.k + r.restarted - wanted + j) % len(order)] for j in range(wanted)]

    _advance(r, _around(settled + measured, r.centroids), tol, place)


def spread_points(std: Standardized) -> DataFrame:
    """Points cached for the iterations.

    A small table is spread over the cores; a large one already comes in enough
    scan partitions and is not shuffled. Float sums then add up in another order,
    which may move the last digits and, at the tolerance, the number of passes.
    """
    cores = std.points.sparkSession.sparkContext.defaultParallelism
    points = std.points
    if std.n <= cores * SMALL_TASK:
        points = points.repartition(max(1, min(cores, -(-std.n // 2000))))
    return points.persist()


def best_of(runs: list[Run]) -> Run:
    return min(runs, key=lambda r: r.inertia)


def kmeans(
    std: Standardized,
    key: str,
    k: int,
    n_init: int = 20,
    max_iter: int = 300,
    tol: float = 1e-6,
    seed: int = 42,
) -> tuple[Run, list[Run]]:
    """Best of ``n_init`` restarts by inertia, and all restarts."""
    points = spread_points(std)
    try:
        runs = make_runs(points, key, std.columns, [(k, seed, i) for i in range(n_init)])
        lloyd(points, key, std.columns, runs, max_iter, tol)
    finally:
        points.unpersist()
    return best_of(runs), runs


def runs_frame(spark, runs: list[Run]) -> DataFrame:
    """(k, seed, restart, n_iter, inertia) per run."""
    rows = [(r.k, r.seed, r.restart, len(r.history), float(r.inertia)) for r in runs]
    return spark.createDataFrame(
        rows, "k int, seed int, restart int, n_iter int, inertia double"
    )


def history_frame(spark, run: Run) -> DataFrame:
    rows = [(i + 1, float(v)) for i, v in enumerate(run.history)]
    return spark.createDataFrame(rows, "iteration int, inertia double")
