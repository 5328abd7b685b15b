"""Quality classifier: supervised subword embeddings.

A document is the mean of the learned vectors of its hashed words and byte n-grams; a
softmax over two classes follows. Vectors and output weights are trained together by
stochastic gradient descent in numpy, on at most ``SAMPLE_PER_CLASS`` labelled documents
of each class, those with the smallest hash of doc_id. A task that gets the sample's features
trains and returns the weights; texts and features never reach the driver. Scores are corrected
for the share of the classes among all labelled rows.

Because mean and output layer are linear, a trained model is one weight per bucket: a task
adds up the weights of a document's features and applies the logistic function.

Edge cases: null or empty text has no features; its score follows from the shares of the
classes. Labels other than 0 and 1, labels without doc_id and documents with contradictory
labels teach nothing. Very long texts are read whole, in slices. Repeated rows are scored
alike; those in the training sample count up to its size. An empty table gives no rows. Without labels of both classes every score is 0.5. Columns of the
documents stay; an output column replaces one of its name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_texts, with_arrow_columns
from .subwords import buckets

BITS = 16
SIZES = (3, 4, 5)
DIMENSION = 16
EPOCHS = 5
RATE = 0.25
SAMPLE_PER_CLASS = 2000

_TABLE = bytes(32 if c in b" \t\n\x0b\x0c\r" else c for c in range(256))  # case is kept


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; no id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def feature_counts(text: bytes) -> np.ndarray:
    total = np.zeros(1 << BITS, dtype=np.int64)
    for b in buckets(text, _TABLE, SIZES, BITS, words=True):
        total += np.bincount(b, minlength=len(total))
    return total


@dataclass
class Model:
    weights: np.ndarray  # log odds of class 1 that a feature adds, by bucket
    bias: float

    def score(self, text: bytes) -> float:
        total, n = 0.0, 0
        for b in buckets(text, _TABLE, SIZES, BITS, words=True):
            total += float(self.weights[b].sum(dtype=np.float64))
            n += len(b)
        z = self.bias + (total / n if n else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _sample(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(quality, text) of the sampled documents, and all labelled rows by class."""
    clear = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
        .where("quality = other")
        .select("doc_id", "quality")
    )
    sizes = {r["quality"]: r["count"] for r in clear.groupBy("quality").count().collect()}
    ordered = [clear.where(F.col("quality") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    chosen = F.broadcast(ordered[0].union(ordered[1]))  # 2 * per_class rows of two numbers at most
    return docs.select("doc_id", "text").join(chosen, "doc_id").select("quality", "text"), sizes


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, seed: int = 0) -> Model:
    """Learn from ``labels`` (doc_id, quality) of ``docs`` (doc_id, text)."""
    sample, sizes = _sample(docs, labels, per_class)

    def make():
        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            ids, counts = [], []
            for text in byte_texts(batch.column("text")):
                total = feature_counts(text)
                met = np.flatnonzero(total)
                ids.append(met.astype("<u2").tobytes())
                counts.append((total[met] / max(1, total.sum())).astype("<f4").tobytes())
            return [pa.array(ids, pa.binary()), pa.array(counts, pa.binary())]

        return compute

    fields = [T.StructField("ids", T.BinaryType()), T.StructField("shares", T.BinaryType())]
    # repeated documents would otherwise outnumber the sample
    rows = with_arrow_columns(sample, fields, make, drop=["text"]).orderBy(F.xxhash64("ids", "shares"), "quality").limit(2 * per_class)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = [], []
        for batch in batches:  # in the order of the sort
            y += batch.column("quality").to_pylist()
            x += zip(_views(batch.column("ids"), "<u2"), _views(batch.column("shares"), "<f4"))
        if len(set(y)) == 2:
            weights, bias = _descend(x, np.array(y, dtype=np.int64), seed)
            shift = np.log(sizes[1] / sizes[0]) - np.log(y.count(1) / y.count(0))
            columns = [pa.array([weights.astype("<f4").tobytes()], pa.binary()), pa.array([bias + float(shift)])]
            yield pa.RecordBatch.from_arrays(columns, names=["weights", "bias"])

    for fitted in rows.mapInArrow(fit, "weights binary, bias double").collect():  # the limit leaves one task, so one row
        return Model(np.frombuffer(fitted["weights"], "<f4"), fitted["bias"])
    return Model(np.zeros(1 << BITS, np.float32), 0.0)


def _views(column: pa.Array, dtype: str) -> list[np.ndarray]:
    """Arrays over the cells of a binary column without nulls; nothing is copied."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, "<i8")[column.offset : column.offset + len(column) + 1] // np.dtype(dtype).itemsize
    cells = np.frombuffer(data, dtype) if data else np.empty(0, dtype)
    return [cells[i:j] for i, j in zip(at, at[1:])]


def _descend(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int) -> tuple[np.ndarray, float]:
    """Stochastic gradient descent on the softmax loss, one document a step."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSION, 1 / DIMENSION, (1 << BITS, DIMENSION)).astype(np.float32)
    output = np.zeros((DIMENSION, 2), dtype=np.float32)
    bias = np.zeros(2, dtype=np.float32)
    steps, done = EPOCHS * len(x), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(x)):
            rate = RATE * (1 - done / steps)
            done += 1
            ids, share = x[i]
            hidden = share @ vectors[ids]
            z = hidden @ output + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = output @ p
            output -= rate * np.outer(hidden, p)
            bias -= rate * p
            # a feature's step is scaled by its share of the document, times the features it has
            vectors[ids] -= np.outer((rate * len(ids)) * share, back)
    return (vectors @ (output[:, 1] - output[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` plus score (of label 1) and predicted (1 from 0.5 on)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS weights

    def make():
        m = sent.value

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array([m.score(t) for t in byte_texts(batch.column("_text"))], pa.float64())]

        return compute

    out = with_arrow_columns(docs.withColumn("_text", F.col("text")), [T.StructField("score", T.DoubleType())], make, drop=["_text"])
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
