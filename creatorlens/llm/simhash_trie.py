"""SimHash near-duplicates by a self-join of the binary trie of fingerprints.

The trie is walked in pairs of nodes of one depth. A pair carries the number of bits in
which its prefixes differ and is dropped as soon as that exceeds the budget. Upper levels
are walked by Spark on counted nodes: a pair whose nodes hold few fingerprints becomes a
task of its own, a larger one is split further down, so a crowded subtree is divided until
its parts are small. A task walks the rest of its pair on sorted arrays. It returns a
spanning forest of the links it found, which keeps every connection, and the forests are
joined into components by alternating large-star and small-star steps.

Only distinct fingerprints enter the join: exact copies collapse before it.

Edge cases: null or empty text has no words and the fingerprint zero, linked like any
other. Fewer words than a shingle has: the whole sequence is one shingle. Rows without
doc_id get the component of their fingerprint, or null if no row of it has an id. Columns
of the input stay; an output column replaces one of its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_texts, stored, with_arrow_columns

BITS = 64
STEP = 4  # bits per level of the walk
PAIR_LIMIT = 1 << 18  # fingerprints of a node pair that one task takes
BLOCK = 1 << 16  # shingle hashes unpacked, or node pairs expanded, at a time
SEED = 42


def fingerprint(text: bytes, words_per_shingle: int) -> int:
    """64-bit SimHash of the word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    k = words_per_shingle
    joined = b" ".join(words)
    if len(words) <= k:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())),
        dtype="<u8", count=len(words) - k + 1,
    )
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), BLOCK):
        part = hashes[i : i + BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, words_per_shingle: int, name: str = "fp") -> DataFrame:
    """``docs`` plus the fingerprint as a signed long."""

    def make():
        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            found = [fingerprint(t, words_per_shingle) for t in byte_texts(batch.column("_text"))]
            return [pa.array(np.array(found, dtype=np.uint64).view(np.int64))]

        return compute

    return with_arrow_columns(docs.withColumn("_text", F.col("text")), [T.StructField(name, T.LongType())], make, drop=["_text"])


def _prefix(fp, depth: int):
    """The first ``depth`` bits of a fingerprint."""
    return F.shiftrightunsigned(fp, BITS - depth) if depth else F.lit(0).cast("long")


def _node_pairs(fps: DataFrame, max_bits: int, limit: int) -> DataFrame:
    """Walk the upper trie: (depth, a, b, differing) of the pairs small enough for a task.

    Each round counts the nodes of the next depth below the pairs still too large, and
    expands those pairs, so its work follows the number of large nodes."""
    spark = fps.sparkSession
    ready = []
    large = spark.range(1).select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).alias("differing"))
    depth = 0
    while depth < BITS:
        depth += STEP
        parents = large.select(F.col("a").alias("parent")).union(large.select("b")).distinct()
        nodes = (
            fps.select(_prefix(F.col("fp"), depth).alias("node"))
            .groupBy("node")
            .agg(F.count("*").alias("n"))
            .withColumn("parent", F.shiftrightunsigned("node", STEP))
            .join(parents, "parent", "left_semi")
        )
        nodes = stored(nodes, "trie-nodes")
        left = nodes.select(F.col("parent").alias("a"), F.col("node").alias("na"), F.col("n").alias("n_a"))
        right = nodes.select(F.col("parent").alias("b"), F.col("node").alias("nb"), F.col("n").alias("n_b"))
        low = (1 << STEP) - 1
        differing = F.col("differing") + F.bit_count(F.col("na").bitwiseXOR(F.col("nb")).bitwiseAND(F.lit(low)))
        pairs = (
            large.join(left, "a")
            .join(right, "b")
            .where(((F.col("a") != F.col("b")) | (F.col("na") <= F.col("nb"))) & (differing <= max_bits))
            .select(F.col("na").alias("a"), F.col("nb").alias("b"), differing.alias("differing"), "n_a", "n_b")
        )
        pairs = stored(pairs, "trie-pairs")
        held = F.when(F.col("a") == F.col("b"), F.col("n_a")).otherwise(F.col("n_a") + F.col("n_b"))
        small = (held <= limit) if depth < BITS else F.lit(True)
        ready.append(pairs.where(small).select(F.lit(depth).alias("depth"), "a", "b", "differing"))
        large = pairs.where(~small).select("a", "b", "differing")
        if large.isEmpty():
            break
    out = ready[0]
    for more in ready[1:]:
        out = out.union(more)
    return out


def _hook(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the trees of linked nodes in place; a root is its tree's smallest node."""
    while True:
        ri, rj = root[i], root[j]
        low, high = np.minimum(ri, rj), np.maximum(ri, rj)
        open_ = low < high
        if not open_.any():
            return
        np.minimum.at(root, high[open_], low[open_])
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root[:] = jumped


def walk_pair(a: np.ndarray, b: np.ndarray, depth: int, max_bits: int) -> np.ndarray:
    """Walk one pair of subtrees; the root of every leaf (those of b follow those of a).

    a, b: sorted, distinct; ``b is a`` for a subtree with itself. The pairs are expanded
    depth first in blocks, so memory stays bounded however many there are."""
    same = a is b
    root = np.arange(len(a) if same else len(a) + len(b))
    shift = np.uint64(BITS - depth)
    differing = int((int(a[0] >> shift) ^ int(b[0] >> shift)).bit_count()) if depth else 0
    stack = [(depth, np.array([[0, len(a), 0, len(b), differing]], dtype=np.int64))]
    while stack:
        depth, pairs = stack.pop()
        single = (pairs[:, 1] - pairs[:, 0] == 1) & (pairs[:, 3] - pairs[:, 2] == 1)
        i, j = pairs[single, 0], pairs[single, 2]  # leaves: compare the remaining bits at once
        near = np.bitwise_count(a[i] ^ b[j]) <= max_bits
        _hook(root, i[near], j[near] + (0 if same else len(a)))
        pairs = pairs[~single]
        if not len(pairs):
            continue
        if len(pairs) > BLOCK:
            stack += [(depth, pairs[k : k + BLOCK]) for k in range(0, len(pairs), BLOCK)]
            continue
        bit = np.uint64(1 << (BITS - 1 - depth))
        a0, a1, b0, b1, d = pairs.T
        am, bm = _middle(a, a0, a1, bit), _middle(b, b0, b1, bit)
        children = [
            np.stack([a0, am, b0, bm, d]), np.stack([am, a1, bm, b1, d]),
            np.stack([a0, am, bm, b1, d + 1]), np.stack([am, a1, b0, bm, d + 1]),
        ]
        if same:  # a node with itself: its mixed pair occurs once
            children[3] = children[3][:, (a0 != b0) | (a1 != b1)]
        nxt = np.concatenate(children, axis=1).T
        nxt = nxt[(nxt[:, 4] <= max_bits) & (nxt[:, 1] > nxt[:, 0]) & (nxt[:, 3] > nxt[:, 2])]
        if len(nxt):
            stack.append((depth + 1, nxt))
    return root


def _middle(fp: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """Where the one-child begins in each node's sorted range: a bisection of all ranges at once."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        one = open_ & ((fp[np.minimum(mid, len(fp) - 1)] & bit) != 0)
        hi = np.where(one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)


def links(fps: DataFrame, max_bits: int, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """(u, v): edges between distinct fingerprints that connect exactly those which a chain
    of links of at most ``max_bits`` differing bits connects. fps: distinct ``fp``."""
    pairs = _node_pairs(fps, max_bits, pair_limit).withColumn("pair", F.monotonically_increasing_id())
    pairs = stored(pairs, "trie-ready")
    depths = [r[0] for r in pairs.select("depth").distinct().collect()]
    if not depths:
        return fps.sparkSession.createDataFrame([], "u long, v long")
    node_of = F.array(*[F.struct(F.lit(d).alias("depth"), _prefix(F.col("fp"), d).alias("node")) for d in sorted(depths)])
    at = fps.select("fp", F.inline(node_of))
    # a pair of a node with itself needs its fingerprints once
    sides = pairs.select("depth", F.col("a").alias("node"), "pair").union(
        pairs.where("a <> b").select("depth", F.col("b").alias("node"), "pair")
    )
    cells = at.join(sides, ["depth", "node"]).select("pair", "depth", "fp")

    def walk(key, rows):
        depth = key[1].as_py()
        fp = np.sort(rows["fp"].to_numpy().view(np.uint64))
        prefix = fp >> np.uint64(BITS - depth)
        cut = int(np.searchsorted(prefix, prefix[0], side="right"))  # the other node's fingerprints
        a, b = (fp, fp) if cut == len(fp) else (fp[:cut], fp[cut:])
        root = walk_pair(a, b, depth, max_bits)
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"u": fp[moved].view(np.int64), "v": fp[root[moved]].view(np.int64)})

    return cells.groupBy("pair", "depth").applyInArrow(walk, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node reachable; nodes without edges are left out.

    Large-star and small-star steps in turn, each an aggregate and a join on the edges,
    stored after every round, until nothing changes."""
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star-edges")
    before = None
    while True:
        wide = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = wide.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = wide.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        edges = stored(small, "star-edges")
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def near_duplicates(
    docs: DataFrame,
    words_per_shingle: int = 3,
    max_bits: int = 2,
    pair_limit: int = PAIR_LIMIT,
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (default all) plus ``fp`` (long), ``component_id``
    (smallest doc_id reachable by links) and ``first``, true for one row of each component: a
    row with that doc_id."""
    names = ("fp", "component_id", "first")
    rest = [c for c in (keep or docs.columns) if c not in names]
    keyed = docs.select(F.struct(*rest).alias("_doc"), F.col("doc_id").alias("_id"), "text")
    keyed = with_fingerprints(keyed, words_per_shingle).drop("text").withColumn("_row", F.monotonically_increasing_id())
    keyed = stored(keyed, "simhash")
    head = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    heads = stored(keyed.groupBy("fp").agg(F.min(head).alias("head")), "simhash-heads")
    roots = components(links(heads.select("fp"), max_bits, pair_limit))
    # nodes are fingerprints; the smallest doc_id of a component is looked up by its root
    grouped = heads.join(roots, heads["fp"] == roots["node"], "left").select("fp", "head", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("head").alias("least"))
    ids = grouped.join(least, "root").select("fp", "least")
    return keyed.join(ids, "fp").select(
        *[F.col("_doc").getField(c).alias(c) for c in rest],
        "fp", F.col("least.id").alias("component_id"), (F.col("_row") == F.col("least.row")).alias("first"),
    )
