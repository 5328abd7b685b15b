"""Hashed subword features of a text, computed on whole byte arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLICE = 1 << 20  # bytes of a text taken at a time
SPACE = 32
REPEATED = 0  # bucket of all bigrams of a word with itself
_BASE = np.uint64(0x100000001B3)
_BACK = np.uint64(pow(0x100000001B3, -1, 1 << 64))
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _powers(base: np.uint64) -> np.ndarray:
    out = np.full(SLICE + 64, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


_UP, _DOWN = _powers(_BASE), _powers(_BACK)


def slices(text: bytes) -> Iterator[bytes]:
    """Parts of at most SLICE bytes, cut at a space if there is one."""
    at = 0
    while len(text) - at > SLICE:
        cut = text.rfind(b" ", at + 1, at + SLICE)
        cut = cut if cut > at else at + SLICE
        yield text[at:cut]
        at = cut
    yield text[at:]


def buckets(text: bytes, table: bytes, sizes: tuple[int, ...], bits: int, words: bool) -> Iterator[np.ndarray]:
    """Bucket numbers (``bits`` wide) of the byte n-grams inside words and, if asked, of the
    words and of bigrams of a word with itself. ``table`` maps bytes; what it maps to a space separates words. An n-gram may hold
    the space before or behind its word."""
    for part in slices(text.translate(table)):
        data = np.frombuffer(b" " + part + b" ", dtype=np.uint8)
        space = data == SPACE
        spaces = np.concatenate([[0], np.cumsum(space)])
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[: len(data)], out=total[1:])

        def hashed(start: np.ndarray, stop: np.ndarray, salt: int) -> np.ndarray:
            h = (total[stop] - total[start]) * _DOWN[start] + np.uint64(salt)
            return (h ^ (h >> np.uint64(31))) * _MIX

        def bucket(h: np.ndarray) -> np.ndarray:
            return (h >> np.uint64(64 - bits)).astype(np.int64)

        for n in sizes:
            if len(data) < n:
                continue
            start = np.arange(len(data) - n + 1)
            inner = spaces[start + n - 1] - spaces[start + 1] if n > 1 else spaces[start + 1] - spaces[start]
            blank = spaces[start + n] - spaces[start] == n
            start = start[(inner == 0) & ~blank]
            yield bucket(hashed(start, start + n, n))
        if words:
            edges = np.flatnonzero(space)
            start, stop = edges[:-1] + 1, edges[1:]
            real = stop > start
            h = hashed(start[real], stop[real], 0)
            yield bucket(h)
            yield np.full(np.count_nonzero(h[1:] == h[:-1]), REPEATED, dtype=np.int64)
