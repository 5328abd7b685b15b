"""Exact top-k search by inner product.

Queries and candidates are dealt to a grid of tiles of bounded size. Each cell of the
grid multiplies one query tile with a few candidate tiles as matrices, keeps the best k
of each tile and merges them; per-query lists of the cells are then merged in a tree of
fixed fan-in. No pair of vectors ever is a row.

Edge cases: a vector that is null, or that holds a null or non-finite component, takes
no part, nor does a row without id. Rows that share an id are rows of their own: each is a
candidate for the others, and each query row gets its list. Ties go to the smaller id.
Vectors of unequal length are compared on their common positions. A score must fit a long;
beyond it the job fails. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

TILE_ROWS = 2048
TILES_PER_CELL = 4
FAN_IN = 8


def scaled(df: DataFrame, vector: str, factor: float) -> Column:
    """floor(factor * x) of each component, null where the vector can take no part."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(finite, F.transform(x, lambda v: F.floor(v.cast("double") * factor)))


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int,
    id_col: str = "vec_id",
    vector_col: str = "vector",
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with ``is_query`` the k other rows of
    highest integer inner product, ties to the smaller id."""
    one = (
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
        .where(F.col("id").isNotNull() & F.col("v").isNotNull())
        .withColumn("row", F.monotonically_increasing_id())
    )
    one = stored(one, "topk-vectors")  # which also fixes the row numbers
    n, n_queries = one.agg(F.count("*"), F.count_if("q")).first()
    query_tiles = max(1, math.ceil(n_queries / tile_rows))
    tiles = max(1, math.ceil(n / tile_rows))
    columns = max(1, math.ceil(tiles / TILES_PER_CELL))

    def dealt(seed: int, count: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(count)).cast("int")

    left = one.where("q").select(
        dealt(1, query_tiles).alias("r"),
        F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("c"),
        "row", "id", "v",
    )
    right = one.select(
        F.explode(F.sequence(F.lit(0), F.lit(query_tiles - 1))).alias("r"),
        dealt(2, columns).alias("c"),
        F.col("row").alias("crow"), F.col("id").alias("cid"), F.col("v").alias("cv"),
    )

    def cell(key, q: pa.Table, c: pa.Table) -> pa.Table:
        return _best_of_cell(key[1].as_py(), q, c, k, tile_rows)

    lists = (
        left.groupBy("r", "c")
        .cogroup(right.groupBy("r", "c"))
        .applyInArrow(cell, "query_row long, query_id long, branch int, top array<struct<neg:long,vec_id:long,row:long>>")
    )
    while columns > 1:
        columns = math.ceil(columns / FAN_IN)
        lists = lists.groupBy("query_row", "query_id", F.floor(F.col("branch") / FAN_IN).cast("int").alias("branch")).agg(
            F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top")
        )
    return lists.select("query_id", F.posexplode("top").alias("rank", "hit")).select(
        "query_id",
        (F.col("rank") + 1).cast("int").alias("rank"),
        F.col("hit.vec_id").alias("vec_id"),
        (-F.col("hit.neg")).alias("score"),
    )


def _matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows padded with zeros to ``width``."""
    rows = lists.combine_chunks()
    rows = rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows
    flat = rows.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(rows.offsets.to_numpy())
    if (lengths == width).all():
        return flat.reshape(len(rows), width)
    out = np.zeros((len(rows), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _scores(q: np.ndarray, c: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Exact inner products as int64, where ``wanted``."""
    reach = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(c.astype(float)).max(initial=0)) * q.shape[1]
    if reach < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if reach < 2**62:
        return q @ c.T
    wide = q.astype(object) @ c.astype(object).T
    return np.where(wanted, wide, 0).astype(np.int64)  # raises OverflowError where a score is no long


def _best_of_tile(q_rows, q, c_rows, c, k):
    """k best of one tile: (query, score, candidate's place in the tile), unordered. The candidates
    stand in the order that decides ties."""
    others = np.ones((len(q), len(c)), dtype=bool)
    sorter = np.argsort(c_rows)
    at = sorter[np.minimum(np.searchsorted(c_rows, q_rows, sorter=sorter), len(c_rows) - 1)]
    own = c_rows[at] == q_rows
    others[np.flatnonzero(own), at[own]] = False
    s = _scores(q, c, others)
    place = len(c_rows) - 1 - np.arange(len(c_rows))
    if np.abs(s.astype(float)).max(initial=0) < 2**62 / len(c_rows):
        key = s * len(c_rows) + place  # unique: a tie goes to the smaller id
        key[~others] = np.iinfo(np.int64).min
        best = np.argpartition(key, -k, axis=1)[:, -k:] if k < key.shape[1] else np.broadcast_to(np.arange(key.shape[1]), key.shape)
    else:
        best = np.stack([np.lexsort((place, row, ok))[-k:] for row, ok in zip(s, others)])
    rows = np.repeat(np.arange(len(q_rows)), best.shape[1])
    best = best.ravel()
    ok = others[rows, best]
    rows, best = rows[ok], best[ok]
    return rows, s[rows, best], best


def _best_of_cell(branch: int, q: pa.Table, c: pa.Table, k: int, tile_rows: int) -> pa.Table:
    found = [(np.zeros(0, np.int64),) * 3]
    q_ids, q_rows = (q[n].to_numpy() if q.num_rows else np.zeros(0, np.int64) for n in ("id", "row"))
    c_ids = c_rows = np.zeros(0, np.int64)
    if q.num_rows and c.num_rows:  # the table of a missing side has no columns
        c_ids, c_rows = c["cid"].to_numpy(), c["crow"].to_numpy()
        width = max(pc.max(pc.list_value_length(v)).as_py() for v in (q["v"], c["cv"]))
        qm, cm = _matrix(q["v"], width), _matrix(c["cv"], width)
        order = np.lexsort((c_rows, c_ids))
        c_ids, c_rows, cm = c_ids[order], c_rows[order], cm[order]
        for i in range(0, len(q_ids), tile_rows):
            for j in range(0, len(c_ids), tile_rows):
                rows, score, places = _best_of_tile(
                    q_rows[i : i + tile_rows], qm[i : i + tile_rows], c_rows[j : j + tile_rows], cm[j : j + tile_rows], k
                )
                found.append((rows + i, score, places + j))
    rows, score, places = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((places, -score, rows))
    rows, score, places = rows[order], score[order], places[order]
    first = np.searchsorted(rows, rows)
    keep = np.arange(len(rows)) - first < k
    rows, score, places = rows[keep], score[keep], places[keep]
    offsets = np.searchsorted(rows, np.arange(len(q_ids) + 1)).astype(np.int32)
    top = pa.ListArray.from_arrays(
        pa.array(offsets), pa.StructArray.from_arrays([pa.array(-score), pa.array(c_ids[places]), pa.array(c_rows[places])], names=["neg", "vec_id", "row"])
    )
    return pa.table({"query_row": pa.array(q_rows, pa.int64()), "query_id": pa.array(q_ids, pa.int64()), "branch": pa.array([branch] * len(q_ids), pa.int32()), "top": top})
