"""CSV files with line breaks in quoted cells, read by as many tasks as their blocks allow.

Lines are read as text, block by block. Whether a line begins a record depends on the quotes
before it in its file: an even number, and it does. A first pass counts the quotes of each block;
the prefix sum of those counts tells in which state a block begins. The second pass joins the
lines of each block into records. A record that crosses the end of a block leaves fragments, at
most two per block, which are put together by an aggregate. Line ends are \\n or \\r\\n, quotes are
doubled inside quotes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STATES_SENT = 100_000  # blocks that begin inside quotes, listed to the tasks; beyond, both states are tried

_HEADS = "file string, header string"
_RECORDS = "file string, block long, row long, inside boolean, head boolean, open boolean, text string"
PLACED = ("value", "_metadata.file_path AS file", "_metadata.file_block_start AS block")


def first_lines(spark: SparkSession, path: str | Sequence[str]) -> list[tuple[str, str]]:
    """(file, first line) of each file that has one. A task reads the beginning of one block and stops."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = 1 if batch.column(2)[0].as_py() == 0 else 0
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(0, keep), batch.column(0).slice(0, keep)], names=["file", "header"])
                return

    lines = spark.read.text(path).selectExpr(*PLACED)
    cost = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(cost)
    # as dear to open as a task may read: one block per task
    spark.conf.set(cost, spark.conf.get("spark.sql.files.maxPartitionBytes"))
    try:
        rows = lines.mapInArrow(first, _HEADS).collect()
    finally:
        spark.conf.set(cost, before)
    return [(r.file, r.header.removeprefix("﻿")) for r in rows]


def _assembled(inside: dict | None):
    """Records and fragments of blocks, under the known state of each or under both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        makers: list[_Records] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            text, files, blocks = batch.column(0), batch.column(1), batch.column(2)
            changed = np.ones(len(text), dtype=bool)
            changed[1:] = pc.or_(pc.not_equal(files[1:], files[:-1]), pc.not_equal(blocks[1:], blocks[:-1])).to_numpy(zero_copy_only=False)
            edges = [*np.flatnonzero(changed).tolist(), len(text)]
            for a, b in zip(edges, edges[1:]):
                here = (files[a].as_py(), blocks[a].as_py())
                if here != at:
                    for m in makers:
                        yield from m.rest()
                    states = (False, True) if inside is None else (here in inside,)
                    at, makers = here, [_Records(*here, s) for s in states]
                for m in makers:
                    yield from m.lines(text.slice(a, b - a))
        for m in makers:
            yield from m.rest()

    return run


class _Records:
    """Joins the lines of one block that begins inside quotes or not."""

    def __init__(self, file: str, block: int, inside: bool):
        self.key = (file, block, inside)
        self.odd = inside
        self.row = 0
        self.held: list[str] = []  # lines of the record not yet ended
        self.held_row = -1 if inside else 0

    def lines(self, text: pa.Array) -> Iterator[pa.RecordBatch]:
        quotes = pc.count_substring(text, '"').to_numpy(zero_copy_only=False)
        after = (np.cumsum(quotes) + self.odd) % 2
        begins = np.concatenate([[self.odd], after[:-1]]) == 0
        starts = np.flatnonzero(begins)
        stops = np.append(starts[1:], len(text))
        first = int(starts[0]) if len(starts) else len(text)
        self.held += text.slice(0, first).to_pylist()
        if len(starts):
            # the last record may go on in the next batch
            whole = starts[:-1][stops[:-1] - starts[:-1] == 1]
            long = [(int(a), int(b)) for a, b in zip(starts[:-1], stops[:-1]) if b - a > 1]
            if self.held:
                yield self._batch([self.held_row], ["\n".join(self.held)])
            yield self._batch(self.row + whole, text.take(pa.array(whole)))
            if long:
                yield self._batch([self.row + a for a, _ in long], ["\n".join(text.slice(a, b - a).to_pylist()) for a, b in long])
            last = int(starts[-1])
            self.held, self.held_row = text.slice(last).to_pylist(), self.row + last
        self.row += len(text)
        self.odd = bool(after[-1])

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield self._batch([self.held_row], ["\n".join(self.held)], open_=self.odd)

    def _batch(self, rows, texts, open_: bool = False) -> pa.RecordBatch:
        rows, n = np.asarray(rows, dtype=np.int64), len(rows)
        file, block, inside = self.key
        same = [pa.array([v] * n, t) for v, t in ((file, pa.string()), (block, pa.int64()))]
        flags = [pa.array([inside] * n, pa.bool_()), pa.array(rows < 0), pa.array([open_] * n, pa.bool_())]
        text = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays([*same, pa.array(rows), *flags, text], names=["file", "block", "row", "inside", "head", "open", "text"])


def records(spark: SparkSession, files: Sequence[str], states_sent: int = STATES_SENT) -> DataFrame:
    """(file, block, row, text): one row per record, header records included; ``block`` and ``row`` are the
    place of its first line."""
    lines = spark.read.option("lineSep", "\n").text(list(files)).selectExpr(*PLACED)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    blocks = lines.groupBy("file", "block").agg(F.sum(quotes).alias("quotes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = blocks.select("file", "block", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"))
    odd = inside.where("inside").select("file", "block").limit(states_sent + 1).collect()
    if len(odd) <= states_sent:
        parts = lines.mapInArrow(_assembled({(r.file, r.block) for r in odd}), _RECORDS)
    else:
        parts = lines.mapInArrow(_assembled(None), _RECORDS).join(inside, ["file", "block", "inside"], "left_semi")
    whole = parts.where("not head and not open").select("file", "block", "row", "text")
    # a fragment that opens a record begins a group, the heads of the following blocks go on with it
    order = Window.partitionBy("file").orderBy("block", F.desc("head"))
    broken = parts.where("head or open").withColumn("group", F.sum(F.when(F.col("open") & ~F.col("head"), 1).otherwise(0)).over(order))
    pieces = F.sort_array(F.collect_list(F.struct("block", ~F.col("head"), "text")))
    joined = broken.groupBy("file", "group").agg(F.min_by(F.struct("block", "row"), F.struct("block", ~F.col("head"))).alias("first"), pieces.alias("pieces"))
    text = F.array_join(F.col("pieces.text"), "\n")
    return whole.unionByName(joined.select("file", F.col("first.block").alias("block"), F.col("first.row").alias("row"), text.alias("text")))
