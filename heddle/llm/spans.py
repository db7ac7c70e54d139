"""Hashes of byte spans by the million, and a table of what was computed for a span before."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .common import mix, ragged

_BASE = 0xD1342543DE82EF95
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_BLOCK = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    step = np.full(n, base, np.uint64)
    step[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(step)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of `data` with ascending starts, each in constant time, from prefix sums of a polynomial.

    Prefix sums are taken over a block of the data at a time, so what is held doesn't grow with it but for spans as long.
    """
    out = np.empty(len(starts), np.uint64)
    powers = inverses = np.ones(1, np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + _BLOCK)))
        low, high = int(starts[i]), int(ends[i:j].max())
        if len(powers) <= high - low:
            powers, inverses = _powers(_BASE, high - low + 1), _powers(pow(_BASE, -1, 1 << 64), high - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_VALUES[data[low:high]] * powers[: high - low], out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (sums[e] - sums[s]) * inverses[s]
        i = j
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)) | np.uint64(1)


class SpanTable:
    """What `learn` gave for spans: runs of integers in `flat`, found by hash; a span's bytes are compared with those learnt.

    learn(data, starts, ends) returns flat integers and their count for each span. `most` spans are kept, of `most_bytes`
    in all; beyond that what isn't kept is computed again when it occurs, so that memory is bounded and results are the same.
    """

    def __init__(self, learn: Callable, kind: type, most: int = 200_000, most_bytes: int = 8 << 20):
        self.learn, self.most, self.most_bytes = learn, most, most_bytes
        self.mask = (1 << (2 * most - 1).bit_length()) - 1
        self.keys = np.zeros(self.mask + 1, np.uint64)
        self.slot = np.zeros(self.mask + 1, np.int32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.counts = np.zeros(1 << 14, np.int64)
        self.flat = np.zeros(1 << 16, kind)
        self.places = np.zeros(1 << 14, np.int64)
        self.sizes = np.zeros(1 << 14, np.int64)
        self.bytes = np.zeros(1 << 16, np.uint8)
        self.n = self.used = self.held = 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        at = (h >> np.uint64(20)).astype(np.int64) & self.mask
        left = np.arange(len(h))
        while len(left):
            k = self.keys[at]
            hit = k == h[left]
            out[left[hit]] = self.slot[at[hit]]
            on = ~hit & (k != 0)
            left, at = left[on], (at[on] + 1) & self.mask
        return out

    def _put(self, h: np.ndarray, slot: np.ndarray) -> None:
        at = (h >> np.uint64(20)).astype(np.int64) & self.mask
        while len(h):
            free = self.keys[at] == 0
            self.keys[at[free]] = h[free]
            won = free & (self.keys[at] == h)
            self.slot[at[won]] = slot[won]
            h, slot, at = h[~won], slot[~won], (at[~won] + 1) & self.mask

    def _same(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, other: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Whether spans of `data` have the bytes that as many bytes of `other` have at `places`."""
        differ = np.concatenate([[0], np.cumsum(data[ragged(starts, sizes)] != other[ragged(places, sizes)])])
        ends = np.cumsum(sizes)
        return differ[ends] == differ[ends - sizes]

    def _room(self, name: str, n: int) -> None:
        own = getattr(self, name)
        if n > len(own):
            grown = np.zeros(max(n, 2 * len(own)), own.dtype)
            grown[: len(own)] = own
            setattr(self, name, grown)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat results of all spans (with ascending starts), in order, and the count for each span."""
        h = span_hashes(data, starts, ends)
        at = self._find(h)
        sizes = ends - starts
        odd = np.flatnonzero(at >= 0)  # spans that only have another's hash
        odd = odd[sizes[odd] != self.sizes[at[odd]]]
        at[odd] = -2
        hit = np.flatnonzero(at >= 0)
        at[hit[~self._same(data, starts[hit], sizes[hit], self.bytes, self.places[at[hit]])]] = -2
        missing = np.flatnonzero(at == -1)
        n, used = self.n, self.used
        own, first, back = np.unique(h[missing], return_index=True, return_inverse=True)
        first = missing[first]
        clash = sizes[missing] != sizes[first[back]]
        even = np.flatnonzero(~clash)
        clash[even] = ~self._same(data, starts[missing[even]], sizes[missing[even]], data, starts[first[back[even]]])
        at[missing] = n + back
        at[missing[clash]] = -2
        odd = np.flatnonzero(at == -2)
        at[odd] = n + len(own) + np.arange(len(odd))
        new = np.concatenate([first, odd])
        if len(new):
            flat, counts = self.learn(data, starts[new], ends[new])
            for name in ("starts", "counts", "sizes", "places"):
                self._room(name, n + len(new))
            self._room("flat", used + len(flat))
            self.flat[used : used + len(flat)] = flat
            self.counts[n : n + len(new)] = counts
            self.starts[n : n + len(new)] = used + np.cumsum(counts) - counts
            more = int(sizes[first].sum())
            if n + len(own) <= self.most and self.held + more <= self.most_bytes:
                self._room("bytes", self.held + more)
                self.bytes[self.held : self.held + more] = data[ragged(starts[first], sizes[first])]
                self.sizes[n : n + len(own)] = sizes[first]
                self.places[n : n + len(own)] = self.held + np.cumsum(sizes[first]) - sizes[first]
                self._put(own, np.arange(n, n + len(own)))
                self.n, self.used, self.held = n + len(own), used + int(counts[: len(own)].sum()), self.held + more
        counts = self.counts[at]
        return self.flat[ragged(self.starts[at], counts)], counts


def cuts_before_spaces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that begin at a text's start or at a space after a character that isn't white space, and for each text its first span.

    Three-byte characters of the blocks that hold Unicode's white space count as white space here: that only makes spans longer.
    """
    begin = np.zeros(len(data) + 1, bool)
    if len(data):
        space = data == 32
        dark = (data > 32) & ((data < 0x1C) | (data > 0x1F))
        if (data > 127).any():
            two, three = data[:-1], data[:-2]
            wide = np.flatnonzero((two == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))) + 1
            dark[wide] = False
            wide = np.flatnonzero(((three == 0xE1) & (data[1:-1] == 0x9A)) | ((three == 0xE2) & ((data[1:-1] == 0x80) | (data[1:-1] == 0x81))) | ((three == 0xE3) & (data[1:-1] == 0x80))) + 2
            dark[wide] = False
        begin[1 : len(data)] = space[1:] & dark[:-1]
    full = offsets[:-1] < offsets[1:]
    begin[offsets[:-1][full]] = True
    begin[len(data)] = False
    starts = np.flatnonzero(begin)
    return starts, np.searchsorted(starts, offsets)
