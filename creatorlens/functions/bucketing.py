"""One bucketizer for every binning convention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucketize(
    col: Column,
    edges: Sequence[float],
    labels: Sequence[str],
    closed: str = "left",
    floor: float | None = None,
    null_label: str | None = None,
) -> Column:
    """Label of the interval that holds ``col``.

    ``labels`` has one more entry than ``edges``, lowest interval first.
    ``closed="left"`` puts an edge value into the interval above it,
    ``closed="right"`` into the one below. With ``floor``, values at or below it
    (right) or below it (left) get no label. Null gets ``null_label``.
    """
    if len(labels) != len(edges) + 1:
        raise ValueError("need exactly one more label than edges")
    if closed not in ("left", "right"):
        raise ValueError("closed must be 'left' or 'right'")
    right = closed == "right"
    out = F.when(col.isNull(), F.lit(null_label).cast("string"))
    if floor is not None:
        out = out.when(col <= floor if right else col < floor, F.lit(None).cast("string"))
    for edge, label in zip(edges, labels):
        out = out.when(col <= edge if right else col < edge, F.lit(label))
    return out.otherwise(F.lit(labels[-1]))
