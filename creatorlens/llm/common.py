"""What the operators share: table access, stored intermediates, Arrow columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from creatorlens.session import scratch_path

_PATHS: dict[tuple[str, str], list[str]] = {}
_SCOPE = [""]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh folder below spark.checkpoint.dir, remembered under the current scope."""
    path = scratch_path(spark, label)
    _PATHS.setdefault((spark.sparkContext.applicationId, _SCOPE[-1]), []).append(path)
    return path


@contextmanager
def scope(spark: SparkSession, name: str) -> Iterator[None]:
    """Folders made inside belong to ``name``. Those that it made before are deleted, so what
    was built on them must have been written or read to the end."""
    drop_paths(spark, _PATHS.pop((spark.sparkContext.applicationId, name), []))
    _SCOPE.append(name)
    try:
        yield
    finally:
        _SCOPE.pop()


def stored_at(df: DataFrame, path: str) -> DataFrame:
    """``df`` written once and read back: cuts the lineage and survives lost executors."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``stored_at`` a fresh folder."""
    return stored_at(df, new_path(df.sparkSession, label))


def drop_paths(spark: SparkSession, names: Sequence[str]) -> None:
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, so that the Python copies of their texts stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def with_arrow_columns(
    df: DataFrame,
    fields: Sequence[T.StructField],
    make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
    drop: Sequence[str] = (),
) -> DataFrame:
    """``df`` plus columns that a Python function computes batch by batch.

    ``make`` runs once per task and returns the function. A new column replaces an
    old one of its name; the columns of ``drop`` are inputs only.
    """
    gone = {f.name for f in fields} | set(drop)
    kept = [i for i, f in enumerate(df.schema) if f.name not in gone]
    schema = T.StructType([df.schema[i] for i in kept] + list(fields))
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in small_batches(batches):
            columns = [batch.column(i) for i in kept]
            yield pa.RecordBatch.from_arrays(columns + compute(batch), names=names)

    return df.mapInArrow(run, schema)


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def word_parts(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words between the white space of ``data``, those of about ``size`` bytes at a time; no
    word is cut. ``data`` has no white space but spaces."""
    at = 0
    while at < len(data):
        stop = data.find(b" ", at + size)
        stop = len(data) if stop < 0 else stop
        yield data[at:stop].split()
        at = stop
