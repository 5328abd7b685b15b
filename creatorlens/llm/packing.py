"""Best-fit packing of tokenized documents into sequences of fixed length.

Pieces are dealt evenly over tasks. Each task packs its stream online with a fixed
number of open bins. A bitset has a bit for every free space that some open bin offers,
so the best fit is the lowest set bit at or above the piece's length. When no bin fits
and all are in use, the fullest is closed.

Edge cases: null text is empty text, which gives the end id alone. Every row is packed,
repeated rows and null ids included. Very long texts are encoded in parts cut at white space
and packed as full pieces and a rest. Of bins with equal free space that opened or used last
takes the next piece. An empty table gives no rows. Other columns of the input are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, small_batches

OPEN_BINS = 1024
CHARS_PER_TASK = 1 << 25
CACHED_WORDS = 400_000  # of each of two generations
TEXT_BYTES = 1 << 22
PUNCTUATION = b".,!?;:|*#%&$"
END_OF_WORD = "</w>"

_PIECE = "doc_id long, piece int, start long, length long, ids binary, slot long"
_PACKED = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"


_NO_IDS = np.zeros(0, dtype="<u4")
_WHITE = re.compile(rb"[ \t\n\v\f\r]")


def _cut(text: bytes) -> Iterator[bytes]:
    """Parts of about TEXT_BYTES, cut at white space."""
    at = 0
    while len(text) - at > TEXT_BYTES:
        white = _WHITE.search(text, at + TEXT_BYTES)
        if not white:
            break
        yield text[at : white.start()]
        at = white.end()
    yield text[at:]


class WordEncoder:
    """Ids of whole texts, by a bounded cache of white-space-separated words.

    The tokenizer never joins what ASCII white space separates, so a text's ids are those
    of its words in a row. Unknown words go to the tokenizer many at a time. The cache has
    two generations: words of the older that occur again move to the younger; when that is
    full, it becomes the older.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for word, i in vocab.items() if word.endswith(END_OF_WORD)]] = True
        # lower-case words of letters need no normalizer and no pattern to split them
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        if hasattr(self.plain.model, "_resize_cache"):
            self.plain.model._resize_cache(0)  # words seen before never get there
        probe = "the größe déjà niño naïve strength The GRÖSSE Ünïcode"
        self.by_word = bool(self.ends.any()) and all(
            self.plain.encode(w.lower(), add_special_tokens=False).ids == self.tokenizer.encode(w, add_special_tokens=False).ids
            for w in [*probe.split(), probe]
        )
        self.added = [str(t.content).lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text, as unsigned 32-bit numbers."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        parts: list[tuple[int, bytes]] = []
        size = 0
        for n, text in enumerate(texts):
            for part in _cut(text):
                parts.append((n, part))
                size += len(part)
                if size >= TEXT_BYTES:
                    self._encode_parts(parts, out)
                    parts, size = [], 0
        self._encode_parts(parts, out)
        return [p[0] if len(p) == 1 else np.concatenate([*p, _NO_IDS]) for p in out]

    def _encode_parts(self, parts: list[tuple[int, bytes]], out: list[list[np.ndarray]]) -> None:
        """Append the ids of each part to those of its text. A word that occurs often is looked up once."""
        if not parts:
            return
        split = pc.ascii_split_whitespace(pa.array([self._lower(p) for _, p in parts], pa.string()))
        coded = split.values.dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_pylist()
        ids = list(map(self.young.get, words))
        unknown = [i for i, x in enumerate(ids) if x is None]
        new = {words[i] for i in unknown}
        again = [w for w in new if w in self.old]
        self.young.update([(w, self.old[w]) for w in again])
        self._learn(new.difference(again))
        for i in unknown:
            ids[i] = self.young[words[i]]
        # the ids of all words in a row, then those of each occurrence gathered
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        every = np.frombuffer(b"".join(ids), dtype="<u4")
        code = coded.indices.to_numpy()
        held = lengths[code]
        ends = np.concatenate([[0], np.cumsum(held)])
        at = np.repeat((np.cumsum(lengths) - lengths)[code] - ends[:-1], held)
        found = every[at + np.arange(len(at))]
        edges = ends[split.offsets.to_numpy()]
        for (n, _), a, b in zip(parts, edges[:-1].tolist(), edges[1:].tolist()):
            out[n].append(found[a:b])
        if len(self.young) > CACHED_WORDS:
            self.old, self.young = self.young, {}

    def _lower(self, text: bytes) -> bytes:
        """Lower-case ASCII letters make fewer words, and such a tokenizer makes them so itself; but it
        looks for its added tokens before."""
        lower = text.lower()
        return lower if self.by_word and not any(token in lower for token in self.added) else text

    def _learn(self, words: set[bytes]) -> None:
        """Put the ids of new words into the cache. A word of letters with punctuation behind it is the
        ids of both in turn, since the tokenizer splits there; any other word is encoded on its own."""
        ended: list[bytes] = []
        cores: list[bytes] = []
        alone: list[bytes] = []
        plain: set[bytes] = set()
        words.discard(b"")  # beside leading white space
        self.young[b""] = b""
        for word in words if self.by_word else ():
            core = word.rstrip(PUNCTUATION)
            if not core.isalpha():  # more than ASCII letters
                text = core.decode()
                lower = text.lower()
                if not lower.isalpha() or "Σ" in text or not unicodedata.is_normalized("NFC", text):
                    alone.append(word)
                    continue
                core = lower.encode()
            plain.add(core)
            if core != word:
                ended.append(word)
                cores.append(core)
        young = self.young
        todo = []
        for core in plain:
            if core not in young:
                known = self.old.get(core)
                if known:
                    young[core] = known
                else:
                    todo.append(core)
        for i in range(0, len(todo), 250):
            self._encode_letters(todo[i : i + 250])
        rests = [word[len(word.rstrip(PUNCTUATION)) :] for word in ended]
        tails = list(set(rests))
        ends = dict(zip(tails, self._encode_each(tails)))
        for word, core, rest in zip(ended, cores, rests):
            young[word] = young[core] + ends[rest]
        alone = alone if self.by_word else list(words)
        young.update(zip(alone, self._encode_each(alone)))

    def _encode_letters(self, words: list[bytes]) -> None:
        """Words of letters only: each ends where a token with the end mark stands."""
        ids = np.array(self.plain.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):
            self.young.update(zip(words, self._encode_each(words)))
            return
        data, stops = ids.tobytes(), (stops * 4).tolist()
        self.young.update(zip(words, [data[a:b] for a, b in zip([0, *stops], stops)]))

    def _encode_each(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False) if words else []
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per Python worker; workers are reused, so the cache outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int, end_id: int = 0) -> DataFrame:
    """One row per piece; ``slot`` numbers the pieces for an even deal."""
    end = np.array([end_id], dtype="<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        task, count = TaskContext.get().partitionId(), 0
        for batch in small_batches(batches):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(byte_texts(batch.column(1)))):
                ids = np.concatenate([ids, end])
                for n, at in enumerate(range(0, len(ids), max_tokens)):
                    part = ids[at : at + max_tokens]
                    rows.append((doc_id, n, at, len(part), part.tobytes(), (task << 40) + count))
                    count += 1
            yield _batch(rows, ("doc_id", "piece", "start", "length", "ids", "slot"))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _PIECE)


_TYPES = {"piece": pa.int32(), "ids": pa.binary()}


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES.get(n, pa.int64())) for n, c in zip(names, columns)], names=list(names))


class OpenBins:
    """A bounded number of open bins, found by free space."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits = 0
        self.at: dict[int, list[list]] = defaultdict(list)
        self.count = 0

    def _take(self, free: int) -> list:
        held = self.at[free].pop()
        if not self.at[free]:
            self.bits ^= 1 << free
        self.count -= 1
        return held

    def add(self, item, length: int) -> list[list]:
        """Place an item; the bins that this closes, each a list of (item, offset)."""
        closed = []
        above = self.bits >> length
        if above:
            free = length + (above & -above).bit_length() - 1
            held = self._take(free)
        else:
            if self.count == self.most:
                closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
            free, held = self.capacity, []
        held.append((item, self.capacity - free))
        free -= length
        if free:
            self.at[free].append(held)
            self.bits |= 1 << free
            self.count += 1
        else:
            closed.append(held)
        return closed

    def rest(self) -> Iterator[list]:
        for free in sorted(self.at):
            yield from self.at[free]


def pack(
    docs: DataFrame, tokenizer_path: str, max_tokens: int = 2048, open_bins: int = OPEN_BINS, end_id: int = 0
) -> DataFrame:
    """Pieces with their ids (little-endian unsigned 32 bit), sequence and offset in it."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    tasks = max(1, math.ceil(chars / CHARS_PER_TASK))
    names = ("doc_id", "piece", "start", "length", "ids", "sequence_id", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, rows = OpenBins(max_tokens, open_bins), []
        number = TaskContext.get().partitionId() << 40

        def close(held: list) -> None:
            nonlocal number
            rows.extend((*item, number, offset) for item, offset in held)
            number += 1

        for batch in small_batches(batches):
            for item in zip(*(batch.column(i).to_pylist() for i in range(5))):
                for held in bins.add(item, item[3]):
                    close(held)
            yield _batch(rows, names)
            rows.clear()
        for held in bins.rest():
            close(held)
        yield _batch(rows, names)

    return pieces(docs, tokenizer_path, max_tokens, end_id).repartition(tasks, F.xxhash64("slot")).mapInArrow(run, _PACKED)
