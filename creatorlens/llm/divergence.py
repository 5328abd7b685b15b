"""How far the sources of a language are apart in their words, by run-length columns.

A group is a (lang, source) of the documents. A language keeps the terms found in enough of
its documents; a group gives each kept term the smoothed share ``p`` per thousand million.
The kept terms are put in an order that clusters equal counts: by the counts in the sources
with the fewest distinct counts, then by a hash of all counts, so that terms with the same
counts everywhere are neighbours. In that order each group's counts are a column of runs.
For a pair of groups the run boundaries are intersected, and each common run adds f times
its length. The order is cut into blocks, and sources into tiles, so that a task holds one
block of the columns of two tiles; sums of the blocks are added by an aggregate.

Edge cases: null lang, source and text are empty. Documents without terms, empty and
repeated ones make their group occur. Very long texts are counted in parts; a term of any
length is whole. A language without kept terms gives 0 for every pair. A language with one
source has no pairs. An empty table gives no rows. Other columns of the input are not read,
whatever their names. Ties in value go by the UTF-8 order of the item.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_texts, small_batches, stored, word_parts

MIN_DOCS = 10
TOP_TERMS = 10
SCALE = 3  # p counts in units of 1000^-SCALE
LEADING = 8  # sources whose counts lead the order of terms
BLOCK_BITS = 14  # a block has up to 2^14 terms
TILE_SOURCES = 128  # mean number of sources of a tile
TALLIED = 200_000  # (group, term) entries that a task holds before it hands them on

#: A-Z lower-cased, other ASCII but letters a space; every other byte belongs to a term
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_COUNTS = "lang string, source string, term string, n long, docs long"
_SUMS = "lang string, source string, item string, value long"


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each (lang, source, term); a group's null term marks that
    the group occurs."""
    occurrences: dict[tuple[str, str], Counter] = {}
    documents: dict[tuple[str, str], Counter] = {}

    def handed() -> pa.RecordBatch:
        langs, sources, terms, n, docs = [], [], [], [], []
        for (lang, source), counts in occurrences.items():
            found = documents[lang, source]
            terms += [None, *counts]
            n += [0, *counts.values()]
            docs += [0, *(found[t] for t in counts)]
            langs += [lang] * (len(counts) + 1)
            sources += [source] * (len(counts) + 1)
        occurrences.clear()
        documents.clear()
        columns = [pa.array(c, pa.string()) for c in (langs, sources, terms)] + [pa.array(c, pa.int64()) for c in (n, docs)]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    for batch in small_batches(batches):
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_texts(batch.column(2))):
            counts = occurrences.setdefault((lang, source), Counter())
            found: set[bytes] = set()
            for words in word_parts(text.translate(_TABLE)):
                counts.update(words)
                found.update(words)
            documents.setdefault((lang, source), Counter()).update(found)
        if sum(map(len, occurrences.values())) > TALLIED:
            yield handed()
    yield handed()


def share(count: Column, total: Column) -> Column:
    """1 + floor(1000^SCALE * count / total) by long division, three digits at a time, so that no
    step leaves a long while total is below 9e15."""
    out, rest = F.lit(0).cast("long"), count
    thousand = F.lit(1000).cast("long")
    for _ in range(SCALE):
        rest = rest * thousand
        out = out * thousand + F.call_function("div", rest, total)
        rest = rest % total
    return out + 1


def shares(count: np.ndarray, total: int) -> np.ndarray:
    """``share`` of an array."""
    out, rest = np.zeros_like(count), count
    for _ in range(SCALE):
        whole, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + whole
    return out + 1


def runs(place: np.ndarray, count: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Run-length encoding of a column with ``count`` at the ascending ``place`` and else 0:
    the end of each run and its count."""
    head = np.ones(len(place), dtype=bool)
    head[1:] = (np.diff(place) != 1) | (np.diff(count) != 0)
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(place)) - 1
    ends = np.full(2 * len(first) + 1, length, dtype=np.int64)
    counts = np.zeros(len(ends), dtype=np.int64)
    if len(first):
        ends[0:-1:2], ends[1::2], counts[1::2] = place[first], place[last] + 1, count[first]
    real = np.diff(ends, prepend=0) > 0
    return ends[real], counts[real]


def common_sum(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Sum of f over two columns of runs (end, p): f once per common run, times its length."""
    ends = np.union1d(a[0], b[0])
    p, q = a[1][np.searchsorted(a[0], ends)], b[1][np.searchsorted(b[0], ends)]
    return int(((p - q) * (p - q) // (p + q) * np.diff(ends, prepend=0)).sum())


def _cell(key, entries: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums of all pairs of sources of a cell: one block of the terms, one pair of tiles."""
    lang, tiles = key[0].as_py(), (key[2].as_py(), key[3].as_py())
    names, sides = groups["source"].to_pylist(), groups["tile"].to_pylist()
    totals = groups["total"].to_pylist()
    start, length = groups["start"][0].as_py(), groups["length"][0].as_py()
    number = {name: i for i, name in enumerate(names)}
    owner = np.array([number[s] for s in entries["source"].to_pylist()], dtype=np.int64)
    place, count = entries["at"].to_numpy() - start, entries["n"].to_numpy()
    order = np.lexsort((place, owner))
    owner, place, count = owner[order], place[order], count[order]
    edges = np.searchsorted(owner, np.arange(len(names) + 1))
    columns = []
    for i, total in enumerate(totals):
        ends, counts = runs(place[edges[i] : edges[i + 1]], count[edges[i] : edges[i + 1]], length)
        columns.append((ends, shares(counts + 2, total)))
    out = [
        (lang, names[i], names[j], common_sum(columns[i], columns[j]))
        for i in range(len(names))
        for j in (range(i) if tiles[0] == tiles[1] else range(len(names)))
        if tiles[0] == tiles[1] or (sides[i], sides[j]) == tiles
    ]
    cols = list(zip(*out)) or [()] * 4
    return pa.table([pa.array(c, t) for c, t in zip(cols, [pa.string()] * 3 + [pa.int64()])], names=["lang", "source", "item", "value"])


class Audit:
    """The counted tables that both reports read, stored once."""

    def __init__(self, docs: DataFrame, min_docs: int = MIN_DOCS, tile_sources: int = TILE_SOURCES):
        text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
        counts = docs.select(*text).mapInArrow(_tallied, _COUNTS).groupBy("lang", "source", "term")
        counts = stored(counts.agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")
        found = counts.where(F.col("term").isNotNull())

        # the leading sources of a language: those with the fewest distinct counts
        tastes = found.groupBy("lang", "source").agg(F.approx_count_distinct("n").alias("distinct"))
        place = F.row_number().over(Window.partitionBy("lang").orderBy("distinct", "source"))
        leading = tastes.withColumn("place", place).where(F.col("place") <= LEADING).drop("distinct")
        keys = [F.max(F.when(F.col("place") == i + 1, F.col("n"))).alias(f"k{i}") for i in range(LEADING)]
        kept = (
            found.join(leading, ["lang", "source"], "left")
            .groupBy("lang", "term")
            .agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.bit_xor(F.xxhash64("source", "n")).alias("same"), *keys)
            .where(F.col("docs") >= min_docs)
        )
        order = ["lang", *(f"k{i}" for i in range(LEADING)), "same", "term"]
        ordered = kept.repartitionByRange(*order).sortWithinPartitions(*order)
        #: (lang, term, lang_n, at): kept terms; ``at`` is the place in the order
        self.terms = stored(ordered.select("lang", "term", "lang_n", F.monotonically_increasing_id().alias("at")), "divergence-terms")
        #: (lang, source, term, n, lang_n, at): counts of kept terms
        self.entries = stored(found.drop("docs").join(self.terms, ["lang", "term"]), "divergence-entries")

        sizes = self.terms.groupBy("lang").agg(F.count("*").alias("v"))
        totals = self.entries.groupBy("lang", "source").agg(F.sum("n").alias("held"))
        groups = (
            counts.where(F.col("term").isNull()).select("lang", "source")
            .join(sizes, "lang", "left")
            .join(totals, ["lang", "source"], "left")
            .fillna(0, ["v", "held"])
        )
        langs = groups.groupBy("lang").agg(F.sum("held").alias("lang_held"), F.ceil(F.count("*") / tile_sources).alias("tiles"))
        smooth = F.lit(2).cast("long") * F.col("v")
        #: (lang, source, total, lang_total, tiles, tile): denominators and tile of each group
        self.groups = stored(
            groups.join(langs, "lang").select(
                "lang", "source", (F.col("held") + smooth).alias("total"), (F.col("lang_held") + smooth).alias("lang_total"),
                "tiles", F.pmod(F.xxhash64("source"), "tiles").alias("tile"),
            ),
            "divergence-groups",
        )

    def pairs(self) -> DataFrame:
        """(lang, source, item, value): each group with each other source of its language."""
        block = F.shiftright("at", BLOCK_BITS)
        blocks = self.terms.groupBy("lang", block.alias("block")).agg(F.min("at").alias("start"), F.count("*").alias("length"))
        # a block of no terms makes every language occur
        none = self.groups.select("lang", F.lit(-1).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long")).distinct()
        blocks = blocks.union(none)
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other")
        cells = self.groups.select("lang", "source", "total", "tile", other)
        tiles = [F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b")]
        entries = self.entries.select("lang", "source", "at", "n", block.alias("block"))
        left = entries.join(cells, ["lang", "source"]).select("lang", "block", *tiles, "source", "at", "n")
        right = blocks.join(cells, "lang").select("lang", "block", *tiles, "source", "tile", "total", "start", "length")
        by = ["lang", "block", "a", "b"]
        sums = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_cell, _SUMS)
        sums = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
        there, back = (F.struct(F.col(s).alias("source"), F.col(i).alias("item")) for s, i in (("source", "item"), ("item", "source")))
        return sums.select("lang", F.inline(F.array(there, back)), "value").select("lang", "source", "item", "value")

    def terms_above(self) -> DataFrame:
        """(lang, source, item, value): kept terms that a group holds more often than its language."""
        both = self.entries.join(self.groups.select("lang", "source", "total", "lang_total"), ["lang", "source"])
        p, q = share(F.col("n") + 2, F.col("total")), share(F.col("lang_n") + 2, F.col("lang_total"))
        both = both.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
        return both.select("lang", "source", "item", F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, tile_sources: int = TILE_SOURCES) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group all other sources of its language
    (part ``pair``) and its ``top_terms`` most telling terms (part ``term``), largest value first."""
    found = Audit(docs, min_docs, tile_sources)
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    columns = ["lang", "source", "part", "item", "value"]
    pairs = found.pairs().withColumn("part", F.lit("pair")).select(*columns, place)
    terms = found.terms_above().withColumn("part", F.lit("term")).select(*columns, place).where(F.col("rank") <= top_terms)
    return pairs.union(terms)
