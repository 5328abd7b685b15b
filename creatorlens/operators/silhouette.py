"""Silhouette score with plain Euclidean distance.

The points to be scored form a bounded block that is sent to the tasks; every
task reduces its share of the reference points to distance sums per (scored
point, cluster). Pairs are never materialised as rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .kmeans import portable_hash

BLOCK = 2048


def hash_sample(points: DataFrame, key: str, size: int, seed: int = 0) -> DataFrame:
    """Exactly ``size`` rows (or all), the first in hash order of the key."""
    return points.orderBy(portable_hash(key, seed), key).limit(size)


def _sums(reference: DataFrame, columns: Sequence[str], block: np.ndarray) -> DataFrame:
    """(i, cluster, n, total): distances from block row i to each cluster's points."""
    cols, block = list(columns), np.ascontiguousarray(block)

    def reduce_task(batches):
        import numpy as np
        import pyarrow as pa

        totals: dict[int, np.ndarray] = {}
        counts: dict[int, int] = {}
        for batch in batches:
            arrays = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            labels, x = arrays[0], np.column_stack(arrays[1:])
            for lo in range(0, len(x), 1024):
                part, lab = x[lo : lo + 1024], labels[lo : lo + 1024]
                dist = np.zeros((len(block), len(part)))
                for j in range(part.shape[1]):
                    diff = block[:, j : j + 1] - part[:, j]
                    dist += diff * diff
                dist = np.sqrt(dist)
                for c in np.unique(lab):
                    mine = lab == c
                    totals[c] = totals.get(c, 0.0) + dist[:, mine].sum(axis=1)
                    counts[c] = counts.get(c, 0) + int(mine.sum())
        for c, t in totals.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(len(block), dtype=np.int32)),
                    pa.array(np.full(len(block), c, dtype=np.int32)),
                    pa.array(np.full(len(block), counts[c], dtype=np.int64)),
                    pa.array(t),
                ],
                names=["i", "cluster", "n", "total"],
            )

    partial = reference.select("cluster", *cols).mapInArrow(
        reduce_task, "i int, cluster int, n bigint, total double"
    )
    return partial.groupBy("i", "cluster").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total")
    )


def _scores(sums: DataFrame, own: DataFrame) -> DataFrame:
    return _point_scores(sums.join(F.broadcast(own), "i"))


def _point_scores(sums: DataFrame) -> DataFrame:
    """One score per scored point: (b - a) / max(a, b), 0 for a lone point."""
    same = F.col("cluster") == F.col("own")
    per_point = (
        sums.groupBy("i")
        .agg(
            F.max(F.when(same, F.col("n"))).alias("n_own"),
            F.max(F.when(same, F.col("total"))).alias("sum_own"),
            F.min(F.when(~same, F.col("total") / F.col("n"))).alias("b"),
        )
    )
    a = F.col("sum_own") / (F.col("n_own") - 1)
    widest = F.greatest(a, F.col("b"))
    score = F.when((F.col("n_own") <= 1) | F.col("b").isNull(), F.lit(0.0)).otherwise(
        F.coalesce((F.col("b") - a) / F.nullif(widest, F.lit(0.0)), F.lit(0.0))
    )
    return per_point.select(score.alias("score"))


def silhouette(
    labelled: DataFrame,
    key: str,
    columns: Sequence[str],
    sample_size: int | None = 500,
    seed: int = 0,
    against_all: bool = False,
) -> DataFrame:
    """(n_scored, silhouette) of rows that carry ``cluster``.

    With a sample size both sides are the sample, or, ``against_all``, the sample is scored
    against every row: one pass, its work linear in the table. With ``None`` every row is
    scored against every row, whatever its key: the rows are dealt to a grid of
    blocks, so the work is quadratic in the table but no driver loop, and no
    pair is a row. Fewer than two clusters score 0.
    """
    spark = labelled.sparkSession
    narrow = labelled.select(key, "cluster", *columns)
    if not sample_size:
        return _all_points(narrow, columns)
    sample = hash_sample(narrow, key, sample_size, seed).collect()
    reference = narrow if against_all else spark.createDataFrame(sample, narrow.schema)
    n, total = _score_block(reference, columns, sample)
    return spark.createDataFrame(
        [(n, total / n if n else 0.0)], "n_scored bigint, silhouette double"
    )


def _all_points(labelled: DataFrame, columns: Sequence[str]) -> DataFrame:
    cols = list(columns)
    other = [f"o{j}" for j in range(len(cols))]
    rows = materialize(
        labelled.select("cluster", *cols).withColumn("row", F.monotonically_increasing_id()), "silhouette"
    )
    blocks = max(1, -(-rows.count() // BLOCK))
    dealt = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    scored = rows.select(dealt.alias("r"), every.alias("c"), "row", "cluster", *cols)
    against = rows.select(
        every.alias("r"), dealt.alias("c"), F.col("cluster").alias("other"), *[F.col(c).alias(o) for c, o in zip(cols, other)]
    )

    def cell(left, right):
        import pyarrow as pa

        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            dist = np.zeros((left.num_rows, right.num_rows))
            for c, o in zip(cols, other):
                diff = left[c].to_numpy()[:, None] - right[o].to_numpy()
                dist += diff * diff
            dist = np.sqrt(dist)
            lab = right["other"].to_numpy()
            for c in np.unique(lab):
                mine = lab == c
                size = left.num_rows
                parts.append((
                    left["row"].to_numpy(), left["cluster"].to_numpy().astype(np.int32), np.full(size, c, np.int32),
                    np.full(size, mine.sum(), np.int64), dist[:, mine].sum(axis=1),
                ))
        names = ("i", "own", "cluster", "n", "total")
        return pa.table(dict(zip(names, (np.concatenate(x) for x in zip(*parts)))))

    sums = (
        scored.groupBy("r", "c")
        .cogroup(against.groupBy("r", "c"))
        .applyInArrow(cell, "i long, own int, cluster int, n long, total double")
        .groupBy("i", "own", "cluster")
        .agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    )
    return _point_scores(sums).agg(
        F.count("*").alias("n_scored"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("silhouette")
    )


def _score_block(reference: DataFrame, columns: Sequence[str], block: list) -> tuple[int, float]:
    spark = reference.sparkSession
    if not block:
        return 0, 0.0
    x = np.array([[r[c] for c in columns] for r in block], dtype=float)
    own = spark.createDataFrame(
        [(i, int(r["cluster"])) for i, r in enumerate(block)], "i int, own int"
    )
    row = _scores(_sums(reference, columns, x), own).agg(
        F.count("*").alias("n"), F.sum("score").alias("total")
    ).first()
    return row["n"], row["total"] or 0.0
