"""Language identification by multilingual mixture inference.

Every language has a distribution over hashed byte n-grams, counted over all labelled
texts. A document's n-grams are seen as drawn from a mixture of languages. The set of
languages grows from the best single one: expectation-maximisation fits the proportions,
and a language is added while the log likelihood rises by more than a penalty that grows
with the log of the document's length. The prediction is the largest proportion.

Edge cases: null text and text without a letter give ``und`` with score 0, as does every
text if nothing could be learned. Null languages teach nothing. Ties go to the language
that sorts first. Very long texts are counted whole, in slices; repeated rows teach and are
predicted as often as they occur. An empty table gives no rows. Columns of the documents stay; an output column replaces one of its name.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_texts, with_arrow_columns
from .subwords import buckets

BITS = 16
SIZES = (1, 2, 3)
SMOOTHING = 0.1
PENALTY = 4.0
ROUNDS = 40
UNKNOWN = "und"

# ASCII letters in lower case and all non-ASCII bytes count; the rest separates words
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def gram_counts(text: bytes) -> np.ndarray:
    total = np.zeros(1 << BITS, dtype=np.int64)
    for b in buckets(text, _TABLE, SIZES, BITS, words=False):
        total += np.bincount(b, minlength=len(total))
    return total


def has_letter(text: bytes) -> bool:
    return any(97 <= c <= 122 for c in set(text.translate(_TABLE))) or any(c.isalpha() for c in text.decode())


@dataclass
class Model:
    languages: list[str]
    likelihood: np.ndarray  # of each n-gram, by language

    def proportions(self, counts: np.ndarray) -> np.ndarray:
        """Mixture weights by language, zero outside the selected set."""
        met = np.flatnonzero(counts)
        q, p = counts[met].astype(np.float64), self.likelihood[:, met]
        n = q.sum()
        chosen = [int((np.log(p) @ q).argmax())]
        weights, mixed = np.ones(1), p[chosen[0]]
        fit = float(np.log(mixed) @ q)
        penalty = PENALTY * np.log(n + 1)
        while len(chosen) < len(p):
            gain = (p / mixed) @ q / n
            gain[chosen] = 0
            best = int(gain.argmax())
            # the likelihood is concave in the weights: this bounds what any addition can win
            if gain[best] <= 0 or n * np.log(gain[best]) <= penalty:
                break
            wider = [*chosen, best]
            w, m = self._fit(p[wider], q, n)
            wider_fit = float(np.log(m) @ q)
            if wider_fit - fit <= penalty:
                break
            chosen, weights, mixed, fit = wider, w, m, wider_fit
        out = np.zeros(len(p))
        out[chosen] = weights
        return out

    @staticmethod
    def _fit(p: np.ndarray, q: np.ndarray, n: float) -> tuple[np.ndarray, np.ndarray]:
        """Expectation-maximisation of the weights of a fixed set of languages."""
        w = np.full(len(p), 1 / len(p))
        for _ in range(ROUNDS):
            mixed = w @ p
            new = w * (p @ (q / mixed)) / n
            moved, w = np.abs(new - w).max(), new
            if moved < 1e-4:
                break
        return w, w @ p

    def predict(self, text: bytes | None) -> tuple[str, float]:
        if not text or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        counts = gram_counts(text)
        w = self.proportions(counts)
        best = int(w.argmax())
        return self.languages[best], float(min(1.0, w[best]))


def train(docs: DataFrame, lang_col: str = "lang") -> Model:
    """Count n-grams per language over all of ``docs`` with a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(1 << BITS, dtype=np.int64))
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1))):
                total = totals[lang]
                for b in buckets(text, _TABLE, SIZES, BITS, words=False):
                    total += np.bincount(b, minlength=len(total))
        for lang, total in totals.items():
            met = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(met), pa.string()), pa.array(met.astype(np.int32)), pa.array(total[met])],
                names=["lang", "bucket", "n"],
            )

    labelled = docs.select(F.col(lang_col).cast("string").alias("lang"), "text").where("lang is not null")
    counted = labelled.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = counted.toArrow()  # one row per language and bucket at most
    languages = sorted(set(rows["lang"].to_pylist()))
    counts = np.zeros((len(languages), 1 << BITS))
    place = {lang: i for i, lang in enumerate(languages)}
    at = np.array([place[x] for x in rows["lang"].to_pylist()], dtype=np.int64)
    counts[at, rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    counts += SMOOTHING
    return Model(languages, counts / counts.sum(axis=1, keepdims=True) if languages else counts)


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` plus lang_pred and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # languages * 2^BITS numbers

    def make():
        m = sent.value

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            found = [m.predict(t) for t in byte_texts(batch.column("_text"))]
            return [pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]

        return compute

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return with_arrow_columns(docs.withColumn("_text", F.col("text")), fields, make, drop=["_text"])
