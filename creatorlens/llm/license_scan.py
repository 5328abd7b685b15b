"""Licence statements in texts, by ordered signature rules.

A text becomes its words, lower-cased, with one space between them, so that punctuation and line
breaks do not matter. A rule is tried only if the text holds all its gate words. Matches are
intervals of words. Rules are ordered by kind, then by place in the list; an interval inside
another one of a better kind, or inside a longer one of the same kind, is dropped. Of equal
intervals of a kind the earlier rule's stays. Phrases are rules of the last kind; all their places
are reported besides.

Edge cases: null text is empty and has no words. Very long texts are split into words in parts and
matched whole. Repeated rows each get their result. A text without a statement has empty arrays and
score 0; an empty table gives no rows. Columns of the input stay; an output column replaces one of
its name.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_texts, with_arrow_columns, word_parts
from .license_rules import KINDS, PHRASES, Rule, rules

#: A-Z lower-cased; ASCII but letters and digits a space; every other byte belongs to a word
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_ORDER = {kind: i for i, kind in enumerate(KINDS)}

Hit = tuple[int, int, int, int]  # order of the kind, rule, first word, word behind the last


class Scanner:
    """Compiled rules; one per task."""

    def __init__(self, signatures: Sequence[Rule], phrases: Sequence[tuple[str, str]]):
        phrase_rules = [Rule(label, "phrase", frozenset(words.split()), re.escape(words)) for label, words in phrases]
        self.rules = [*signatures, *phrase_rules]
        self.patterns = [re.compile(rb"(?<![^ ])(?:" + r.expression.encode() + rb")(?![^ ])") for r in self.rules]
        self.gates: dict[bytes, list[int]] = {}  # a rule stands under one of its gate words
        self.rest: list[frozenset[bytes]] = []
        shared = [w for r in self.rules for w in r.gate]
        for i, rule in enumerate(self.rules):
            first = min(sorted(rule.gate), key=shared.count)
            self.gates.setdefault(first.encode(), []).append(i)
            self.rest.append(frozenset(w.encode() for w in rule.gate))

    def tried(self, words: set[bytes]) -> list[int]:
        """Rules whose gate words are all among the words."""
        return sorted(i for w in self.gates.keys() & words for i in self.gates[w] if self.rest[i] <= words)

    def hits(self, text: bytes, chosen: Sequence[int]) -> list[Hit]:
        """All matches of the chosen rules in joined words."""
        found = [(i, m.start(), m.end()) for i in chosen for m in self.patterns[i].finditer(text)]
        if not found:
            return []
        spaces = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 32)
        first = np.searchsorted(spaces, [f[1] for f in found]).tolist()
        last = np.searchsorted(spaces, [f[2] for f in found]).tolist()
        return [(_ORDER[self.rules[i].kind], i, a, b + 1) for (i, _, _), a, b in zip(found, first, last)]

    def __call__(self, text: bytes) -> tuple[int, list[Hit]]:
        """The number of words, and all matches."""
        n, vocabulary, parts = 0, set(), []
        for words in word_parts(text.translate(_TABLE)):
            n += len(words)
            vocabulary.update(words)
            parts.append(b" ".join(words))
        chosen = self.tried(vocabulary)
        return n, self.hits(b" ".join(p for p in parts if p), chosen) if chosen else []


def resolved(found: list[Hit]) -> list[Hit]:
    """The matches that no better one contains."""
    kept: list[Hit] = []
    for _, level in groupby(sorted(found, key=lambda h: (h[0], h[2], -h[3], h[1])), key=lambda h: h[0]):
        better = sorted((h[2], h[3]) for h in kept)
        starts = [s for s, _ in better]
        reach = np.maximum.accumulate([e for _, e in better]).tolist() if better else []
        top = -1  # furthest end in this kind so far; all of those began before or here
        for hit in level:
            at = bisect_right(starts, hit[2])
            if hit[3] > top and not (at and hit[3] <= reach[at - 1]):
                kept.append(hit)
                top = hit[3]
    return kept


_PLACE = pa.struct([("label", pa.string()), ("start", pa.int64())])
_FOUND = pa.struct([("label", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("base", T.ArrayType(T.StructType().add("label", "string").add("start", "long"))),
    T.StructField("found", T.ArrayType(T.StructType().add("label", "string").add("kind", "string").add("start", "long").add("stop", "long"))),
    T.StructField("score", T.DoubleType()),
]


def scan(docs: DataFrame, signatures: Sequence[Rule] | None = None, phrases: Sequence[tuple[str, str]] = tuple(PHRASES)) -> DataFrame:
    """``docs`` plus n_words, base (all places of the phrases, by start), found (the statements that stay, by
    start: label, kind, words from start to before stop) and score (trust in the best of them)."""
    signatures = rules() if signatures is None else list(signatures)

    def make():
        scanner = Scanner(signatures, phrases)
        labels = [r.label for r in scanner.rules]
        kinds = list(KINDS)

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            n_words, base, found, score = [], [], [], []
            for text in byte_texts(batch.column("_text")):
                n, hits = scanner(text)
                stay = sorted(resolved(hits), key=lambda h: (h[2], h[3], h[0], h[1])) if hits else []
                n_words.append(n)
                base.append([{"label": labels[i], "start": a} for k, i, a, _ in sorted(hits, key=lambda h: h[2]) if kinds[k] == "phrase"])
                found.append([{"label": labels[i], "kind": kinds[k], "start": a, "stop": b} for k, i, a, b in stay])
                score.append(max((KINDS[kinds[h[0]]] for h in stay), default=0.0))
            return [pa.array(n_words, pa.int64()), pa.array(base, pa.list_(_PLACE)), pa.array(found, pa.list_(_FOUND)), pa.array(score, pa.float64())]

        return compute

    return with_arrow_columns(docs.withColumn("_text", F.col("text")), FIELDS, make, drop=["_text"])
