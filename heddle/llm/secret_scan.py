"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

Patterns find assignments to secret-like names, access keys and long hexadecimal runs. Further candidates are long runs of
the characters of a class: hexadecimal in any case, one case with digits (base 32 and 36), letters of one case, and base 64
(both alphabets). Runs end at '=' and, but for base 64, at '+', '/', '_' and '-', so names and separators don't hide a key.
The Shannon entropy of a window is kept up by counts that change by one character in and one out, and windows at or above
the class's threshold are joined to spans. Hexadecimal spans need a letter and two digits, those of one case a digit at a
lower threshold than without; base 64 ones both cases and two digits, or changes of case or between letters and digits at
a quarter of a window's characters, which words, paths and names in camel case don't have.

What an allow-list pattern finds is cut out of the candidates before. Parts of a span that lie in a pattern's span or in
one of a class before it go; the rest stays.

Offsets are code points, ends exclusive. Null texts count as empty and have no spans. Long texts are scanned whole.
Repeated rows give equal results; extra columns are passed through or ignored as stated.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fresh, mapped, slices, utf8

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_b36", "entropy_b64")
_NAMES = "password|passwd|secret|token|api_?key"
_ASSIGN = re.compile(rf"(?:{_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{16,}")  # runs of the pattern [0-9a-f]+ that are long enough
_CANDIDATE = re.compile("[A-Za-z0-9+/_-]+")
_HEX_CLASS = re.compile("[0-9A-Fa-f]+")
_ONE_CASE = (re.compile("[a-z0-9]+"), re.compile("[A-Z0-9]+"))
_LETTERS = re.compile("[a-z]+|[A-Z]+")
_BREAK = re.compile("(?<=[a-z])[A-Z]|(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]|(?<=[A-Z]{2})[a-z]")
#: parts of candidates that are no secrets: UUIDs, runs of the alphabet or digits, the word example
ALLOW = (r"(?<![0-9a-fA-F])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9a-fA-F])", "abcdefghij|ABCDEFGHIJ|0123456789|9876543210", "(?i:example)")


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[*chars.encode()]] = True
    return table


_LOWER_HEX = _class("0123456789abcdef")
_KEY = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")


def _long_runs(data: np.ndarray, table: np.ndarray, least: int) -> np.ndarray:
    """Starts of the runs of a class of bytes."""
    inside = np.concatenate([[False], table[data], [False]])
    change = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = change[::2], change[1::2]
    return starts[ends - starts >= least]


def hot_windows(run: str, window: int, threshold: float) -> list[tuple[int, int]]:
    """Joined windows of `run` whose entropy in bits is at least the threshold, by incremental counts."""
    if len(run) < window:
        return []
    term = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    total = 0.0  # sum of c log c; entropy is log n - total / n
    for ch in run[:window]:
        c = counts.get(ch, 0)
        total += term[c + 1] - term[c]
        counts[ch] = c + 1
    least = (math.log2(window) - threshold) * window + 1e-9
    out: list[tuple[int, int]] = []
    for start in range(len(run) - window + 1):
        if start:
            gone, new = run[start - 1], run[start + window - 1]
            c = counts[gone]
            total += term[c - 1] - term[c]
            counts[gone] = c - 1
            c = counts.get(new, 0)
            total += term[c + 1] - term[c]
            counts[new] = c + 1
        if total <= least:
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], start + window)
            else:
                out.append((start, start + window))
    return out


def without(start: int, end: int, others: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of a span that lie in none of the others."""
    out = []
    for s, e in sorted(others):
        if s < end and e > start:
            if s > start:
                out.append((start, s))
            start = max(start, e)
    return out + [(start, end)] if start < end else out


class Scanner:
    def __init__(self, window: int = 20, hex_bits: float = 3.0, b64_bits: float = 3.8, allow: tuple[str, ...] = ALLOW, b36_bits: float = 3.5, letter_bits: float = 3.8):
        self.window, self.hex_bits, self.b64_bits, self.b36_bits, self.letter_bits = window, hex_bits, b64_bits, b36_bits, letter_bits
        self.allow = [re.compile(a) for a in allow]

    def _hot(self, pattern: re.Pattern, run: str, bits: float) -> Iterator[tuple[int, int, str]]:
        for m in pattern.finditer(run):
            for s, e in hot_windows(m[0], self.window, bits):
                yield m.start() + s, m.start() + e, m[0][s:e]

    def _mixed(self, part: str) -> list[tuple[int, int]]:
        """Joined windows of which a quarter of the characters change case or go from letters to digits or back."""
        at = [0] * (len(part) + 1)
        for m in _BREAK.finditer(part):
            at[m.start() + 1] = 1
        for i in range(len(part)):
            at[i + 1] += at[i]
        out: list[tuple[int, int]] = []
        for s in range(len(part) - self.window + 1):
            if 4 * (at[s + self.window] - at[s]) >= self.window:
                if out and s <= out[-1][1]:
                    out[-1] = (out[-1][0], s + self.window)
                else:
                    out.append((s, s + self.window))
        return out

    def entropy_spans(self, run: str) -> list[tuple[int, str, int]]:
        """Spans of a run of key characters, the classes one after the other."""
        out = []
        for s, e, part in self._hot(_HEX_CLASS, run, self.hex_bits):
            if sum(c.isdigit() for c in part) >= 2 and not part.isdigit():
                out.append((s, "entropy_hex", e))
        for one_case in _ONE_CASE:
            out += [(s, "entropy_b36", e) for s, e, part in self._hot(one_case, run, self.b36_bits) if any(c.isdigit() for c in part) and not part.isdigit()]
        out += [(s, "entropy_b36", e) for s, e, _ in self._hot(_LETTERS, run, self.letter_bits)]
        for s, e in hot_windows(run, self.window, self.b64_bits):
            part = run[s:e]
            if sum(c.isdigit() for c in part) >= 2 and part != part.lower() and part != part.upper():
                out.append((s, "entropy_b64", e))
            else:
                out += [(s + a, "entropy_b64", s + b) for a, b in self._mixed(part)]
        return out

    def spans(self, text: str) -> list[tuple[int, str, int]]:
        """(start, kind, end), by start, then in the order of KINDS."""
        base = [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
        base += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
        base += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
        more = []
        for m in _CANDIDATE.finditer(text):
            if m.end() - m.start() < self.window:
                continue
            near = [(s, e) for s, _, e in base if s < m.end() and e > m.start()]
            cuts = [x.span() for a in self.allow for x in a.finditer(m[0])]
            for start, end in without(0, m.end() - m.start(), cuts):
                taken = near.copy()
                for s, kind, e in self.entropy_spans(m[0][start:end]):
                    left = without(m.start() + start + s, m.start() + start + e, taken)
                    more += [(a, kind, b) for a, b in left]
                    taken += left
        return sorted(base + more, key=lambda x: (x[0], KINDS.index(x[1]), x[2]))

    def scan(self, texts: pa.Array) -> list[list[tuple[int, str, int]]]:
        """Spans of each text; only texts with something like a secret are read by the patterns."""
        data, offsets = utf8(texts)
        n = len(offsets) - 1
        out: list[list[tuple[int, str, int]]] = [[] for _ in range(n)]
        # a line feed after each text, so that no run goes on into the next
        ends = offsets + np.arange(n + 1)
        apart = np.full(int(ends[-1]), 10, np.uint8)
        apart[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets))] = data
        places = [_long_runs(apart, _LOWER_HEX, 16), _long_runs(apart, _KEY, min(20, self.window))]
        a = np.flatnonzero(apart == 65)
        a = a[a + 3 < len(apart)]
        places.append(a[(apart[a + 1] == 75) & (apart[a + 2] == 73) & (apart[a + 3] == 65)])
        look = np.zeros(n, bool)
        for p in places:
            look[np.searchsorted(ends, p, "right") - 1] = True
        look |= pc.fill_null(pc.match_substring_regex(texts, _NAMES, ignore_case=True), False).to_numpy(zero_copy_only=False).astype(bool)
        for i in np.flatnonzero(look):
            out[i] = self.spans(data[offsets[i] : offsets[i + 1]].tobytes().decode())
        return out


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", scanner: Scanner | None = None) -> DataFrame:
    """id, spans (array of kind, start, end) of each whole text."""
    scanner = scanner or Scanner()
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("spans", T.ArrayType(span))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [[{"kind": k, "start": s, "end": e} for s, k, e in x] for x in scanner.scan(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=schema.names)

    return mapped(docs.select(docs[id_col], docs[text].alias("text")), run, schema)


def digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text", scanner: Scanner | None = None) -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256 and spans (joined) of each whole text."""
    scanner = scanner or Scanner()
    names = ("n_assign", "n_access", "n_hex")
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *[T.StructField(n, T.LongType()) for n in names], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = scanner.scan(batch.column(1))
            base = [[x for x in f if x[1] in KINDS[:3]] for f in found]
            counts = [pa.array([sum(x[1] == k for x in b) for b in base], pa.int64()) for k in KINDS[:3]]
            sha = [hashlib.sha256(joined(b).encode()).hexdigest() for b in base]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(sha, pa.string()), pa.array([joined(f) for f in found], pa.string())], names=schema.names)

    return mapped(docs.select(docs[id_col], docs[text].alias("text")), run, schema)


def redact(df: DataFrame, text: str = "text", mark: str = "[secret]", scanner: Scanner | None = None, count: str | None = None) -> DataFrame:
    """df with each span of the text (overlapping ones joined) replaced by a mark; `count` names a column for the spans found."""
    scanner = scanner or Scanner()
    fields = [*df.schema.fields] + ([T.StructField(fresh(df, count), T.LongType())] if count else [])
    schema, where = T.StructType(fields), df.columns.index(text)

    def cleaned(body: str, spans: list[tuple[int, str, int]]) -> str:
        parts, at = [], 0
        for s, _, e in spans:
            if s >= at:
                parts += [body[at:s], mark]
            at = max(at, e)
        return "".join(parts) + body[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            column = batch.column(where)
            found = scanner.scan(column)
            if any(found):
                body = column.to_pylist()
                column = pa.array([cleaned(b, f) if f else b for b, f in zip(body, found, strict=True)], column.type)
            columns = [*batch.columns[:where], column, *batch.columns[where + 1 :]]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array([len(f) for f in found], pa.int64())] if count else []), names=schema.names)

    return mapped(df, run, schema)
