"""Whole-array text helpers for Arrow batches: words, word hashes, n-gram hashes, ragged ranges.

A batch is cut into pieces of half a megabyte (never inside a document), and every step below works on
all bytes or all words of a piece at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 19
#: The bytes that separate words: space and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_GRAM = 0xD6E8FEB86659FD93


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 (base is odd) for i below ``size`` at least; kept for the next call."""
    if base not in _POWERS or len(_POWERS[base][0]) < size:
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(1 << max(16, int(size).bit_length()), b, dtype=np.uint64)
            steps[0] = 1
            out.append(np.cumprod(steps, dtype=np.uint64))
        _POWERS[base] = out[0], out[1]
    return _POWERS[base]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (lengths[0] of them), then the same for the next."""
    lengths = np.asarray(lengths, dtype=np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, dtype=np.int64) - before, lengths)


class Texts:
    """The UTF-8 bytes of some documents, one after another; a null text is empty."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
        self.raw = raw[offsets[0] : offsets[-1]] if len(offsets) else raw[:0]
        self.bounds = offsets - offsets[0] if len(offsets) else np.zeros(1, dtype=np.int64)

    def __len__(self) -> int:
        return len(self.bounds) - 1


class Words:
    """Word limits in the bytes of ``Texts``, and ``doc``: the index of each document's first word."""

    def __init__(self, texts: Texts, raw: np.ndarray | None = None):
        self.raw = texts.raw if raw is None else raw
        bounds, n = texts.bounds, len(self.raw)
        if not n:
            self.start = self.end = np.zeros(0, dtype=np.int64)
            self.doc = np.zeros(len(bounds), dtype=np.int64)
            return
        space = SPACE[self.raw]
        first = np.empty(n, dtype=bool)
        first[0] = True
        first[1:] = space[:-1]
        first[bounds[:-1][bounds[:-1] < n]] = True
        last = np.empty(n, dtype=bool)
        last[-1] = True
        last[:-1] = space[1:]
        last[bounds[1:][bounds[1:] > 0] - 1] = True
        word = ~space
        self.start = np.flatnonzero(word & first)
        self.end = np.flatnonzero(word & last) + 1
        self.doc = np.searchsorted(self.start, bounds)

    def hashes(self) -> np.ndarray:
        """64 bits for each word, the same for equal words everywhere."""
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        up, down = powers(_BASE, len(self.raw) + 1)
        total = np.zeros(len(self.raw) + 1, dtype=np.uint64)
        np.cumsum((self.raw.astype(np.uint64) + np.uint64(1)) * up[: len(self.raw)], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def counts(self) -> np.ndarray:
        return np.diff(self.doc)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """64 bits for the ``n`` words from each position; the caller drops those that cross documents."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(_GRAM, len(words) + 1)
    total = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    size = len(words) - n + 1
    return mix((total[n:] - total[:size]) * down[:size])


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches between rows so that a piece holds about ``limit`` bytes of ``column``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        bounds = Texts(batch.column(column)).bounds
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
