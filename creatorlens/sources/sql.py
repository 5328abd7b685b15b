"""SQL statements over registered tables, with named parameters."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import register_views


def _argument(value) -> object:
    """Lists become array literals; anything else is bound as it is."""
    if isinstance(value, Sequence) and not isinstance(value, (str, bytes)):
        return F.array(*[v if isinstance(v, Column) else F.lit(v) for v in value])
    return value


@contextmanager
def views(spark: SparkSession, **tables: DataFrame) -> Iterator[None]:
    """``tables`` as temporary views inside the block. A view that had a name before gets it back."""
    before = {t.name: spark.table(t.name) for t in spark.catalog.listTables() if t.isTemporary and t.name in tables}
    register_views(**tables)
    try:
        yield
    finally:
        for name in tables:
            spark.catalog.dropTempView(name)
        register_views(**before)


def run_sql(spark: SparkSession, statement: str, params: Mapping[str, object] | None = None, **tables: DataFrame) -> DataFrame:
    """Result of one statement that names ``tables`` and takes ``:name`` parameters.

    Values are bound, never pasted into the text. A name that the statement uses and ``params``
    lacks fails the analysis; further entries are not used. The result stays valid after the
    views are gone, since names are resolved here."""
    with views(spark, **tables):
        return spark.sql(statement, args={k: _argument(v) for k, v in (params or {}).items()})
