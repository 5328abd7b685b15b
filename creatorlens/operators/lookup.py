"""Label normalisation by synonym table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strip
from ..session import literal_frame


def synonym_table(spark: SparkSession, synonyms: dict[str, tuple[str, ...]]) -> DataFrame:
    rows = [(v, canon) for canon, variants in synonyms.items() for v in variants]
    return literal_frame(spark, ("_variant", "_canonical"), rows)


def normalize_labels(
    df: DataFrame, column: str, synonyms: dict[str, tuple[str, ...]]
) -> DataFrame:
    """Replace known spellings by their canonical label; others stay as they are.

    The synonym table is a fixed list, so broadcasting it is safe at any size
    of ``df`` and the rows are not shuffled.
    """
    names = df.columns
    table = F.broadcast(synonym_table(df.sparkSession, synonyms))
    joined = df.join(table, F.lower(strip(F.col(column))) == F.col("_variant"), "left")
    return joined.select(
        *[
            F.coalesce("_canonical", column).alias(c) if c == column else F.col(c)
            for c in names
        ]
    )
