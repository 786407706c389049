"""Vectorised word splitting and hashing over batches of texts."""

from __future__ import annotations

import numpy as np

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        out = np.empty(max(n, 4096), dtype=np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(np.full(len(out) - 1, _BASE, dtype=np.uint64), out=out[1:])
        _POWERS = out
    return _POWERS


_POWERS = np.ones(1, dtype=np.uint64)


def hash_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of bytes; the runs cover ``data`` without gaps."""
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    length = end - start
    letters = data.astype(np.uint64) + np.uint64(1)
    letters *= _powers(int(length.max()) + 1)[np.arange(len(letters)) - np.repeat(start, length)]
    return mix(np.add.reduceat(letters, start) + length.astype(np.uint64) * _MULT)


class Words:
    """Words of a batch of texts: ``hash`` of each, ``start`` and ``end`` byte, and ``first[i]:first[i+1]`` of text i."""

    def __init__(self, texts: list[bytes], table: np.ndarray = _LOWER, space: np.ndarray = _SPACE):
        data = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
        offsets = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
        gap = space[data]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, offsets)
        self.data, self.offsets = data, offsets
        if len(self.start):
            length = self.end - self.start
            end = np.cumsum(length)
            self.hash = hash_runs(table[data[~gap]], end - length, end)
        else:
            self.hash = np.empty(0, dtype=np.uint64)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``size`` words from each word on, and which of these lie within one text."""
        n = len(self.hash)
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        return self.runs(self.hash, size), np.arange(n) + size <= self.first[text + 1] if n else np.zeros(0, dtype=bool)

    @staticmethod
    def runs(words: np.ndarray, size: int) -> np.ndarray:
        """Hash of the ``size`` words from each word on; those at the end, where there are fewer, mean nothing."""
        n = len(words)
        out = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            part = np.zeros(n, dtype=np.uint64)
            part[: max(0, n - k)] = words[k:]
            out = mix(out * _MULT + part)
        return out
