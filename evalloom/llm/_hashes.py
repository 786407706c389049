"""Rolling hashes of fixed-length byte windows, and sliding minima, with numpy."""

from __future__ import annotations

import numpy as np

from ._words import mix

_M = np.uint64(0x9E3779B97F4A7C15)


def windows(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of ``data[i : i + size]`` for each i: built from hashes of lengths that are powers of two."""
    n = len(data) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    level = mix(np.arange(256, dtype=np.uint64) + np.uint64(77))[data]
    out, at, width, rest = None, 0, 1, size
    while rest:
        if rest & 1:
            part = level[at : at + n]
            out = part.copy() if out is None else (out * _M) ^ (part + (out >> np.uint64(29)))
            at += width
        rest >>= 1
        if rest:
            level = (level[:-width] * _M) ^ (level[width:] + (level[:-width] >> np.uint64(31)))
            width *= 2
    return mix(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``x[i : i + width]`` for each i, from block-wise prefix and suffix minima."""
    n = len(x) - width + 1
    if n <= 0:
        return np.empty(0, dtype=x.dtype)
    pad = -len(x) % width
    full = np.concatenate((x, np.full(pad, np.iinfo(x.dtype).max, dtype=x.dtype))).reshape(-1, width)
    prefix = np.minimum.accumulate(full, axis=1).ravel()
    suffix = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suffix[:n], prefix[width - 1 : width - 1 + n])
