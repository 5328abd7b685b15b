"""How consistently points land in the same cluster over repeated runs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def modal_count(labels: Sequence[Column], k: int) -> Column:
    """How often a row's most frequent label occurs among ``labels`` (row-local)."""
    hits = []
    for c in range(k):
        total = None
        for lab in labels:
            one = F.when(lab == c, 1).otherwise(0)
            total = one if total is None else total + one
        hits.append(total)
    return F.greatest(*hits) if k > 1 else hits[0]


def stability(
    labelled: DataFrame, label_columns: Sequence[str], k: int, agreement: int
) -> DataFrame:
    """(n, n_stable, pct_stable): rows whose modal label holds in >= agreement runs.

    The labels of a row sit side by side, so nothing is shuffled.
    """
    steady = modal_count([F.col(c) for c in label_columns], k) >= agreement
    return labelled.agg(
        F.count("*").alias("n"),
        F.count_if(steady).alias("n_stable"),
        F.round(F.avg(F.when(steady, F.lit(100.0)).otherwise(F.lit(0.0))), 1).alias("pct_stable"),
    )


def with_run_labels(
    points: DataFrame, key: str, columns: Sequence[str], centroid_sets
) -> DataFrame:
    """(key, run_0, run_1, ...): the nearest centroid under each run, one scan."""
    cols = list(columns)
    sets = [np.ascontiguousarray(c, dtype=float) for c in centroid_sets]
    names = [f"run_{i}" for i in range(len(sets))]

    def label(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
            out = [batch.column(0)]
            for c in sets:
                dist = np.zeros((len(x), len(c)))
                for j in range(x.shape[1]):
                    diff = x[:, j : j + 1] - c[:, j]
                    dist += diff * diff
                out.append(pa.array(np.argmin(dist, axis=1).astype(np.int32)))
            yield pa.RecordBatch.from_arrays(out, names=[key, *names])

    kind = dict(points.dtypes)[key]
    schema = ", ".join([f"{key} {kind}", *[f"{n} int" for n in names]])
    return points.select(key, *cols).mapInArrow(label, schema)


def align_to_first(centroid_sets: list[np.ndarray]) -> list[np.ndarray]:
    """Reorder each run's centroids to sit closest to the first run's.

    Cluster numbers are arbitrary per run. The order of least total distance is
    an assignment problem on the K x K distances, for any K.
    """
    base = centroid_sets[0]
    out = [base]
    for c in centroid_sets[1:]:
        cost = np.sqrt(((base[:, None, :] - c[None, :, :]) ** 2).sum(axis=2))
        out.append(c[least_cost_order(cost)])
    return out


def least_cost_order(cost: np.ndarray) -> list[int]:
    """For each row its column, all different, of least total cost: rows join one by one,
    each along the shortest augmenting path over reduced costs."""
    k = len(cost)
    row_of = np.full(k + 1, -1)  # by column; column k is where a new row starts
    row_price, column_price = np.zeros(k), np.zeros(k + 1)
    for row in range(k):
        row_of[k], column = row, k
        best, came_from, seen = np.full(k, np.inf), np.full(k, k), np.zeros(k + 1, dtype=bool)
        while row_of[column] >= 0:
            seen[column] = True
            open_ = ~seen[:k]
            reduced = cost[row_of[column]] - row_price[row_of[column]] - column_price[:k]
            nearer = open_ & (reduced < best)
            best[nearer], came_from[nearer] = reduced[nearer], column
            nearest = int(np.where(open_, best, np.inf).argmin())
            step = best[nearest]
            row_price[row_of[seen]] += step
            column_price[seen] -= step
            best[open_] -= step
            column = nearest
        while column != k:  # hand the columns over along the path
            row_of[column] = row_of[came_from[column]]
            column = int(came_from[column])
    order = np.empty(k, dtype=int)
    order[row_of[:k]] = np.arange(k)
    return order.tolist()


def inertia_cv(runs: DataFrame) -> DataFrame:
    """Population std of the runs' inertia as a percentage of its mean."""
    return runs.agg(
        F.count("*").alias("n_runs"),
        F.avg("inertia").alias("mean_inertia"),
        (F.stddev_pop("inertia") / F.nullif(F.avg("inertia"), F.lit(0.0)) * 100.0).alias("cv_pct"),
    )
