"""Benchmark decontamination by a prefix-filtered set join over word windows.

Each benchmark item is cut into windows of consecutive words. A document contains a window
only if it contains every shingle of it, so one shingle - the necessary prefix of a
containment join - is enough to find candidates; the rarest in the corpus is taken. The
documents' shingles are matched with these prefixes; a match gives the window's place,
which must lie inside the document (length and position bounds), and the words there are
compared one by one.

Items are taken in blocks of bounded size, whose windows are sent to all tasks; every
block sees all documents. Shingle frequencies are counted over all documents.

Edge cases: null or empty text has no words; an item without words has no window; an item
shorter than a window is one window. Equal windows of several items count for each. Items
without item_id mark words but are not listed. Very long texts are matched whole; repeated rows
each get their result. An empty table gives no rows, an empty benchmark no hits. Columns of the documents stay; an output
column replaces one of its name.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_texts, stored, with_arrow_columns

WINDOW = 10
SHINGLE = 5
BLOCK_WORDS = 2_000_000

_WORD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, A-Z lower-cased."""
    return text.translate(_WORD).split()


class Windows:
    """The windows of a block of items, numbered, and the shingles in them.

    Words are numbers; 0 is a word that no item has. Windows are sorted in groups of one
    length, each a matrix."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int, shingle: int):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set] = defaultdict(set)
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                owners[tuple(ids[i : i + window])].add(item_id)
        by_length: dict[int, list[tuple[int, ...]]] = defaultdict(list)
        for w in owners:
            by_length[len(w)].append(w)
        self.groups = [(n, min(n, shingle), np.array(ws, dtype=np.int64)) for n, ws in sorted(by_length.items())]
        self.owners = [[owners[w] for w in ws] for _, ws in sorted(by_length.items())]
        self.mix = np.cumprod(np.full(shingle, _ODD, dtype=np.uint64))
        self.sizes = sorted({k for _, k, _ in self.groups})
        # all shingles of the windows, by size
        self.shingles = {
            k: np.unique(np.concatenate([self.rolled(m, k).ravel() for _, size, m in self.groups if size == k])) for k in self.sizes
        }

    def rolled(self, ids: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the k-word shingles along the last axis."""
        n = ids.shape[-1] - k + 1
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * _ODD
        mixed ^= mixed >> np.uint64(29)
        h = np.zeros(ids.shape[:-1] + (n,), dtype=np.uint64)
        for j in range(k):
            h += mixed[..., j : j + n] * self.mix[j]
        return h ^ (h >> np.uint64(32))

    def numbers(self, text: bytes) -> np.ndarray:
        get, ws = self.vocabulary.get, words(text)
        return np.fromiter((get(w, 0) for w in ws), dtype=np.int64, count=len(ws))

    def found(self, ids: np.ndarray, k: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of shingles of size k that are in ``wanted`` (sorted), and where there."""
        if len(ids) < k or not len(wanted):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        gaps = np.concatenate([[0], np.cumsum(ids == 0)])
        whole = np.flatnonzero(gaps[k:] == gaps[: len(ids) - k + 1])  # only words of items
        if not len(whole):
            return whole, whole
        h = self.rolled(ids, k)[whole]
        at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
        hit = wanted[at] == h
        return whole[hit], at[hit]


class Prefixes:
    """Each window's rarest shingle, sorted for lookup."""

    def __init__(self, windows: Windows, counts: dict[int, np.ndarray]):
        self.windows = windows
        self.tables = []
        for n, k, matrix in windows.groups:
            h = windows.rolled(matrix, k)
            seen = counts[k][np.searchsorted(windows.shingles[k], h)]
            offset = seen.argmin(axis=1)  # ties: the first in the window
            key = h[np.arange(len(h)), offset]
            order = np.argsort(key, kind="stable")
            unique, first = np.unique(key[order], return_index=True)
            self.tables.append((unique, np.append(first, len(key)), order, offset[order]))

    def match(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], set]:
        """Hit word ranges (start, end), in any order, and the owners of the windows found."""
        ranges: list[tuple[int, int]] = []
        owners: set = set()
        for (n, k, matrix), who, (unique, first, order, offset) in zip(self.windows.groups, self.windows.owners, self.tables):
            if len(ids) < n:  # length bound
                continue
            at, entry = self.windows.found(ids, k, unique)
            many = first[entry + 1] - first[entry]
            place = np.repeat(at, many)
            slot = np.repeat(first[entry] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(many) else at
            start = place - offset[slot]
            inside = (start >= 0) & (start + n <= len(ids))  # position bounds
            start, window = start[inside], order[slot[inside]]
            for j in range(n):  # exact containment
                same = ids[start + j] == matrix[window, j]
                start, window = start[same], window[same]
            ranges += [(int(s), int(s) + n) for s in np.unique(start)]
            for w in np.unique(window):
                owners |= who[w]
        return ranges, owners


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def shingle_counts(texts: DataFrame, windows) -> DataFrame:
    """(size, place, n): how often each shingle of the items occurs in all texts. A task
    sends one row for each shingle it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = windows.value
        total = {k: np.zeros(len(s), dtype=np.int64) for k, s in w.shingles.items()}
        for batch in batches:
            for text in byte_texts(batch.column(0)):
                ids = w.numbers(text)
                for k in w.sizes:
                    total[k] += np.bincount(w.found(ids, k, w.shingles[k])[1], minlength=len(total[k]))
        for k, n in total.items():
            met = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(met), k, np.int32)), pa.array(met.astype(np.int64)), pa.array(n[met])], names=["size", "place", "n"]
            )

    return texts.select("text").mapInArrow(run, "size int, place long, n long").groupBy("size", "place").agg(F.sum("n").alias("n"))


_HITS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    shingle: int = SHINGLE,
    block_words: int = BLOCK_WORDS,
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (default all) plus n_words, hits (word ranges inside occurrences of windows) and items (ids
    of the items with occurring windows)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    letters = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(letters / (6 * block_words)))
    names = ("n_words", "hits", "items")
    rest = [c for c in (keep or docs.columns) if c not in names]
    out = docs.select(
        F.struct(*rest).alias("_doc"), "text",
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast(_HITS).alias("hits"),
        F.array().cast("array<long>").alias("items"),
    )
    for n in range(blocks):
        block = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == n).collect()  # bounded by block_words
        windows = Windows([(r.item_id, r.text.encode()) for r in block], window, shingle)
        sent = spark.sparkContext.broadcast(windows)
        counts = {k: np.zeros(len(s), dtype=np.int64) for k, s in windows.shingles.items()}
        for r in shingle_counts(docs, sent).collect():  # one row per shingle of the block at most
            counts[r["size"]][r["place"]] = r["n"]
        out = _probe(out, spark.sparkContext.broadcast(Prefixes(windows, counts)), last=n + 1 == blocks)
        if n + 1 < blocks:
            out = stored(out, "decontaminate")
    return out.select(*[F.col("_doc").getField(c).alias(c) for c in rest], *names)


def _probe(docs: DataFrame, prefixes, last: bool) -> DataFrame:
    """Add the hits of one block of items; the last needs the text no more."""

    def make():
        p = prefixes.value

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            totals, hits, items = [], [], []
            for text, old, known in zip(byte_texts(batch.column("text")), batch.column("hits").to_pylist(), batch.column("items").to_pylist()):
                ids = p.windows.numbers(text)
                ranges, owners = p.match(ids)
                totals.append(len(ids))
                hits.append([{"start": a, "end": b} for a, b in _merged(ranges + [(h["start"], h["end"]) for h in old])])
                items.append(sorted({*known, *(x for x in owners if x is not None)}))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            return [pa.array(totals, pa.int64()), pa.array(hits, kind), pa.array(items, pa.list_(pa.int64()))]

        return compute

    fields = [T.StructField("n_words", T.LongType()), T.StructField("hits", _HITS), T.StructField("items", T.ArrayType(T.LongType()))]
    return with_arrow_columns(docs, fields, make, drop=["text"] if last else [])


def n_hit(hits):
    """Words inside the ranges."""
    return F.aggregate(hits, F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])
