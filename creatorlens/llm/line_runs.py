"""Line dedup by levelled sorted runs of line hashes.

The documents come in batches. A batch's line hashes are counted per document, anti-joined
with the hashes already known to be frequent, and written as a sorted run. When a level
holds ``FAN_IN`` runs they are merged: hashes that reach the limit go to the frequent run,
the others become one run of the next level. At the end the remaining runs are merged.
Lines with a frequent hash are dropped everywhere, also in earlier batches. Hashes become
frequent in merges only, so one job writes all runs between two merges; while none is
frequent the counted batches are the runs.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased; it is
hashed to 128 bits. Empty keys never count.

Edge cases: null or empty text is one empty line. A line that a document repeats counts
once for it. Every row is a document, repeated rows too. An empty table gives no rows.
Columns of the input stay; an output column replaces one of its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_texts, drop_paths, new_path, with_arrow_columns

BATCHES = 8
FAN_IN = 4
KEY = ("hi", "lo")


def line_key(line: bytes) -> bytes:
    return line.strip().lower()  # on bytes both act on ASCII only


def key_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _hashes(text: bytes, min_chars: int) -> set[bytes]:
    keys = {line_key(x) for x in text.split(b"\n")}
    keys.discard(b"")
    if min_chars > 1:
        keys = {k for k in keys if len(k.decode()) >= min_chars}
    return {key_hash(k) for k in keys}


def distinct_hashes(docs: DataFrame, carried: list[str], min_chars: int) -> DataFrame:
    """One row per document and distinct line: the carried columns, hi, lo."""
    fields = [docs.schema[c] for c in carried]
    schema = T.StructType([*fields, T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_hashes(t, min_chars) for t in byte_texts(batch.column(len(carried)))]
            data = np.frombuffer(b"".join(h for hs in found for h in hs), dtype="<i8").reshape(-1, 2)
            row = pa.array(np.repeat(np.arange(len(found)), [len(hs) for hs in found]))
            columns = [batch.column(i).take(row) for i in range(len(carried))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(data[:, 0].copy()), pa.array(data[:, 1].copy())], names=schema.names
            )

    return docs.select(*carried, "text").mapInArrow(run, schema)


def write_batches(counts: DataFrame, path: str) -> None:
    """(hi, lo, documents, batch) as a folder of sorted files per batch."""
    counts.sortWithinPartitions("batch", *KEY).write.partitionBy("batch").parquet(path)


class LineRuns:
    """Runs of (hi, lo, documents) by level, and the hashes known to be frequent."""

    def __init__(self, spark, min_docs: int, fan_in: int = FAN_IN):
        self.spark, self.min_docs, self.fan_in = spark, min_docs, fan_in
        self.levels: list[list[str]] = [[]]
        self.frequent: list[str] = []

    def _read(self, paths: list[str]) -> DataFrame:
        schema = "hi long, lo long, documents long"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def frequent_hashes(self) -> DataFrame:
        return self._read(self.frequent).select(*KEY)

    def _unknown(self, counts: DataFrame) -> DataFrame:
        return counts.join(self.frequent_hashes(), list(KEY), "left_anti") if self.frequent else counts

    def _folders(self, path: str, column: str, values: list) -> list[str]:
        """The partitions of a stored table, those that have rows."""
        found = [self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{column}={v}") for v in values]
        return [p.toString() for p in found if p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)]

    def add(self, counts: DataFrame) -> None:
        """A batch: (hi, lo, documents), each hash once."""
        path = new_path(self.spark, "line-run")
        self._unknown(counts).sortWithinPartitions(*KEY).write.parquet(path)
        self._hold([path])

    def add_batches(self, path: str, batches: int) -> None:
        """All batches of a table stored by ``write_batches``; its folders may become runs."""
        at = 0
        while at < batches:
            numbers = list(range(at, min(batches, at + self.fan_in - len(self.levels[0]))))
            at += len(numbers)
            runs = self._folders(path, "batch", numbers)
            if runs and self.frequent:
                counts = self.spark.read.schema("hi long, lo long, documents long, batch int").option("basePath", path).parquet(*runs)
                to = new_path(self.spark, "line-run")
                write_batches(self._unknown(counts), to)
                drop_paths(self.spark, runs)
                runs = self._folders(to, "batch", numbers)
            self._hold(runs)

    def _hold(self, runs: list[str]) -> None:
        self.levels[0] += runs
        level = 0
        while len(self.levels[level]) >= self.fan_in:
            self._merge([level], level + 1)
            level += 1

    def _merge(self, from_levels: list[int], to_level: int) -> None:
        runs = [p for n in from_levels for p in self.levels[n]]
        if not runs:
            return
        merged = self._read(runs).groupBy(*KEY).agg(F.sum("documents").alias("documents"))
        if self.frequent:
            merged = merged.join(self.frequent_hashes(), list(KEY), "left_anti")
        path = new_path(self.spark, "line-merged")
        (
            merged.withColumn("frequent", F.col("documents") >= self.min_docs)
            .sortWithinPartitions("frequent", *KEY)
            .write.partitionBy("frequent")
            .parquet(path)
        )
        for n in from_levels:
            self.levels[n] = []
        drop_paths(self.spark, runs)
        while len(self.levels) <= to_level:
            self.levels.append([])
        self.frequent += self._folders(path, "frequent", ["true"])
        self.levels[to_level] += self._folders(path, "frequent", ["false"])

    def finish(self) -> DataFrame:
        """Merge what is left; (hi, lo) of all frequent lines."""
        self._merge(list(range(len(self.levels))), len(self.levels))
        return self.frequent_hashes()


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = BATCHES) -> DataFrame:
    """``docs`` with ``text`` cut to the lines kept, plus n_lines and n_dropped."""
    spark = docs.sparkSession
    # equal rows lose the same lines, and a document that is given another's frequent hashes
    # besides its own loses no other line: a 64-bit hash serves as the row's key
    rest = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    keyed = docs.select(
        F.struct(*rest).alias("_doc"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text").alias("_row")
    )
    path = new_path(spark, "line-batches")
    counts = distinct_hashes(keyed.withColumn("batch", F.pmod("_row", F.lit(batches)).cast("int")), ["batch"], min_chars)
    write_batches(counts.groupBy("batch", *KEY).agg(F.count("*").alias("documents")), path)
    runs = LineRuns(spark, min_docs)
    runs.add_batches(path, batches)
    frequent = runs.finish()
    drop_paths(spark, [path])
    hits = (
        distinct_hashes(keyed, ["_row"], min_chars)
        .join(frequent, list(KEY), "left_semi")
        .groupBy("_row")
        .agg(F.collect_set(F.struct(*KEY)).alias("_frequent"))
    )
    joined = keyed.join(hits, "_row", "left").select("_doc", "text", "_frequent")

    def cut():
        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            texts, totals, dropped = [], [], []
            for text, frequent in zip(byte_texts(batch.column("text")), batch.column("_frequent").to_pylist()):
                lines = text.split(b"\n")
                kept = lines
                if frequent:
                    gone = {np.array([f["hi"], f["lo"]], dtype="<i8").tobytes() for f in frequent}
                    kept = [x for x in lines if not _frequent(x, gone, min_chars)]
                texts.append(b"\n".join(kept))
                totals.append(len(lines))
                dropped.append(len(lines) - len(kept))
            return [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(totals, pa.int64()), pa.array(dropped, pa.int64())]

        return compute

    fields = [T.StructField("_kept", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    out = with_arrow_columns(joined, fields, cut, drop=["text", "_frequent"])
    return out.select(*[F.col("_doc").getField(c).alias(c) for c in rest], F.col("_kept").alias("text"), "n_lines", "n_dropped")


def _frequent(line: bytes, gone: set[bytes], min_chars: int) -> bool:
    key = line_key(line)
    return bool(key) and (min_chars <= 1 or len(key.decode()) >= min_chars) and key_hash(key) in gone
