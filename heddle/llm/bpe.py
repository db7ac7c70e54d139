"""Byte-level BPE ids of many texts, fast: texts are cut where the pre-tokeniser always cuts, and each distinct chunk is encoded once."""

from __future__ import annotations

import json
import re

import numpy as np
import tiktoken
from public_tokenizers import PATTERN

from .common import held, ragged
from .spans import SpanTable, cuts_before_spaces


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ChunkedBpe:
    """ids of whole texts by a byte-level BPE `tokenizer.json`.

    added: whether strings of added tokens have these tokens' ids, as in `tokenizers`; else they count as ordinary text.
    """

    def __init__(self, path: str, most: int = 200_000, added: bool = False):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        own = spec.get("added_tokens", ())
        special = {t["content"] for t in own}
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.encoding = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        #: bytes of each token
        self.added = {t["content"].encode(): t["id"] for t in own} if added else {}
        if added and any(t.get(x) for t in own for x in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take in or look at what is around them are not supported")
        #: of several that begin at one place, the longest
        self.find = re.compile(b"|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.width = np.zeros(max([*ranks.values(), *self.added.values()]) + 1, np.int64)
        for token, i in [*ranks.items(), *self.added.items()]:
            self.width[i] = len(token)
        self.table = SpanTable(self._learn, np.uint32, most)

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunks that begin with a space and end dark stay apart when joined; others are encoded alone."""
        apart = (data[starts] == 32) & (data[ends - 1] > 32) & (data[ends - 1] < 127)
        lengths = ends - starts
        counts = np.zeros(len(starts), np.int64)
        found: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(starts)
        if apart.any():
            own = np.flatnonzero(apart)
            joined = b"".join([data[s:e].tobytes() for s, e in zip(starts[own].tolist(), ends[own].tolist(), strict=True)])
            ids = np.array(self.encoding.encode_ordinary(joined.decode()), np.uint32)
            at = np.cumsum(self.width[ids]) - self.width[ids]
            counts[own] = np.bincount(np.searchsorted(np.cumsum(lengths[own]), at, "right"), minlength=len(own))
        alone = np.flatnonzero(~apart)
        for i in alone:
            found[i] = np.array(self.encoding.encode_ordinary(data[starts[i] : ends[i]].tobytes().decode()), np.uint32)
            counts[i] = len(found[i])
        if not apart.any():
            return np.concatenate(found) if found else np.zeros(0, np.uint32), counts
        out = np.zeros(int(counts.sum()), np.uint32)
        place = np.repeat(apart, counts)
        out[place] = ids
        if len(alone):
            out[~place] = np.concatenate([found[i] for i in alone])
        return out, counts

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts (UTF-8, end to end, with len + 1 offsets), and len + 1 offsets into the ids."""
        if self.find is not None and self.find.search(data):
            own = [m for s, e in zip(offsets.tolist(), offsets[1:].tolist(), strict=False) for m in self.find.finditer(data, s, e)]
            if own:
                return self._encode_around(data, offsets, own)
        return self._encode_plain(data, offsets)

    def _encode_around(self, data: np.ndarray, offsets: np.ndarray, own: list[re.Match]) -> tuple[np.ndarray, np.ndarray]:
        """Texts are cut at the added tokens found; each of these has one id, and what lies between is encoded for itself."""
        begin = np.array([m.start() for m in own], np.int64)
        edges = np.unique(np.concatenate([offsets, begin, np.array([m.end() for m in own], np.int64)]))
        ids, at = self._encode_plain(data, edges)
        counts = np.diff(at)
        part = np.searchsorted(edges, begin)
        keep = np.ones(len(ids), bool)
        keep[ragged(at[part], counts[part])] = False
        keep[at[part]] = True
        ids[at[part]] = [self.added[m[0]] for m in own]
        counts[part] = 1
        return ids[keep], np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(edges, offsets)]

    def _encode_plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, first = cuts_before_spaces(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        ids, counts = self.table(data, starts, np.append(starts[1:], len(data)))
        return ids, np.concatenate([[0], np.cumsum(counts)])[first]


def held_as(path: str) -> tuple[str, str]:
    return "bpe", path


def loaded(path: str) -> ChunkedBpe:
    """One per Python worker and stage."""
    return held(held_as(path), lambda: ChunkedBpe(path, added=True))
