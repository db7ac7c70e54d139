"""Words of whole texts (runs of anything but space and \\t to \\r) and hashes of word shingles, for many texts at once."""

from __future__ import annotations

import numpy as np

from .common import mix
from .spans import span_hashes

_DARK = np.ones(256, bool)
_DARK[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and len + 1 offsets into them by text."""
    dark = _DARK[data]
    begin, stop = dark.copy(), dark.copy()
    begin[1:] &= ~dark[:-1]
    stop[:-1] &= ~dark[1:]
    full = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    begin[first] = dark[first]
    stop[last] = dark[last]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of `width` words, in order, and len + 1 offsets by text; fewer words make one shingle."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    starts, ends, at = words(data, offsets)
    h = span_hashes(data, starts, ends)
    acc = np.full(max(0, len(h) - width + 1), width, np.uint64)
    for j in range(width):
        acc = mix(acc * _STEP + h[j : j + len(acc)])
    size = np.diff(at)
    counts = np.where(size >= width, size - width + 1, np.minimum(size, 1))
    out_at = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(int(out_at[-1]), np.uint64)
    long_ = np.flatnonzero(size >= width)
    own = counts[long_]
    run = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
    out[np.repeat(out_at[long_], own) + run] = acc[np.repeat(at[long_], own) + run]
    for i in np.flatnonzero((size > 0) & (size < width)):
        one = np.full(1, size[i], np.uint64)
        for x in h[at[i] : at[i + 1]]:
            one = mix(one * _STEP + x)
        out[out_at[i]] = one[0]
    return out, out_at
