"""Tokens of words seen before: a bounded table in each Python worker."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from granary.llm.text import ranges

Encoder = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


class _Codes(dict):
    """Numbers keys in the order in which they first come up."""

    def __init__(self, keys: list[str] = ()):
        super().__init__(zip(keys, range(len(keys))))
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        code = self[key] = len(self)
        self.fresh.append(key)
        return code


class ChunkTable:
    """Ids of distinct chunks. ``encode`` gives, for a list of chunks, their numbers of ids and all ids.

    A table of more than ``limit`` chunks is cut to those that came up most, half as many at most, so its
    size does not grow with the input.
    """

    def __init__(self, encode: Encoder, limit: int = 600_000):
        self.encode, self.limit = encode, limit
        self.codes = _Codes()
        self.start = self.size = self.uses = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.int32)

    def ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks one after another, and how many each has."""
        code = np.fromiter(map(self.codes.__getitem__, chunks), dtype=np.int64, count=len(chunks))
        fresh = self.codes.fresh
        if fresh:
            size, flat = self.encode(fresh)
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
            self.uses = np.concatenate([self.uses, np.zeros(len(fresh), dtype=np.int64)])
            self.codes.fresh = []
        size = self.size[code]
        out = self.flat[ranges(self.start[code], size)], size
        self.uses += np.bincount(code, minlength=len(self.uses))
        if len(self.codes) > self.limit:
            self._shrink()
        return out

    def _shrink(self) -> None:
        least = np.sort(self.uses)[-(self.limit // 2)]
        keep = np.flatnonzero(self.uses > least)
        keys = list(self.codes)
        self.codes = _Codes([keys[k] for k in keep.tolist()])
        size = self.size[keep]
        self.flat = self.flat[ranges(self.start[keep], size)]
        self.start, self.size, self.uses = np.cumsum(size) - size, size, self.uses[keep]


def document_ids(table: ChunkTable, texts: list[str], split: Callable[[str], list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and the number of ids of each."""
    chunks: list[str] = []
    counts = []
    for text in texts:
        own = split(text) if text else []
        counts.append(len(own))
        chunks += own
    ids, size = table.ids(chunks)
    total = np.append(0, np.cumsum(size))
    bounds = np.append(0, np.cumsum(np.array(counts, dtype=np.int64)))
    return ids, total[bounds[1:]] - total[bounds[:-1]]
