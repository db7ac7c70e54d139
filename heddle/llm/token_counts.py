"""Token counts of sections by offset-mapped attribution.

A document is encoded once, as a whole. Token spans are then joined with section spans (both sorted, so the interval
join is a merge), and a token that crosses a boundary is allotted by a stated rule:

* ``first``: to the section that holds its first byte's character (the default),
* ``last``: to the section that holds its last one,
* ``majority``: to the section with most of its bytes, the earliest of equals,
* ``split``: to each section by its share of the bytes, so counts are fractions.

Under each rule the counts of a document's sections add up to the document's tokens.

Null texts count as empty; a text with no characters has no sections and gives no rows. Repeated rows give repeated
results. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import held_as, loaded
from .common import fresh, mapped, ragged, slices, utf8

RULES = ("first", "last", "majority", "split")


def joined_fields(df: DataFrame, fields: list[str], sep: str = "\n") -> tuple[Column, Column]:
    """One text of several string fields (null: empty), and where each field's section begins; a separator belongs to the field before it."""
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in fields]
    at, starts = F.lit(0), []
    for p in parts:
        starts.append(at)
        at = at + F.char_length(p) + len(sep)
    return F.concat_ws(sep, *parts), F.array(*starts)


def allot(starts: np.ndarray, ends: np.ndarray, edges: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens (or shares of them) of each section, and the tokens that it shares with another. Section i is [edges[i], edges[i + 1])."""
    n = len(edges) - 1
    low = np.searchsorted(edges, starts, "right") - 1
    high = np.searchsorted(edges, ends, "left") - 1
    cross = np.flatnonzero(low != high)
    spread = high[cross] - low[cross] + 1
    token, section = np.repeat(cross, spread), ragged(low[cross], spread)
    shared = np.bincount(section, minlength=n)
    if rule == "first" or not len(cross):
        return np.bincount(low, minlength=n).astype(float), shared
    if rule == "last":
        return np.bincount(high, minlength=n).astype(float), shared
    part = np.minimum(ends[token], edges[section + 1]) - np.maximum(starts[token], edges[section])
    whole = np.bincount(np.delete(low, cross), minlength=n).astype(float)
    if rule == "split":
        return whole + np.bincount(section, part / (ends - starts)[token], minlength=n), shared
    begin = np.cumsum(spread) - spread
    best = np.maximum.reduceat(part, begin)
    top = np.flatnonzero(part == np.repeat(best, spread))
    _, first = np.unique(token[top], return_index=True)
    return whole + np.bincount(section[top[first]], minlength=n), shared


def section_tokens(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str | Column = "text", bounds: Column | None = None, rule: str = "first") -> DataFrame:
    """A row for each section of each document: its id, section (from 0), start and end in code points, n_tokens, n_shared.

    bounds: ascending code point starts of the sections, the first 0; without it, sections are lines with their line feeds.
    tokenizer: path of a byte-level BPE tokenizer.json.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    count = T.DoubleType() if rule == "split" else T.LongType()
    out = T.StructType([df.select(id_col).schema[0], T.StructField("section", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("n_tokens", count), T.StructField("n_shared", T.LongType())])
    text = F.col(text) if isinstance(text, str) else text
    narrow = df.select(F.col(id_col).alias("id"), text.alias("text"), *([bounds.alias("bounds")] if bounds is not None else []))
    kind = pa.float64() if rule == "split" else pa.int64()
    by_lines = bounds is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer)
        for batch in slices(batches, "text"):
            data, offsets = utf8(batch.column(1))
            if not len(data):
                continue
            ids, at = bpe.encode(data, offsets)
            widths = bpe.width[ids]
            ends = np.cumsum(widths)
            lead = (data & 0xC0) != 0x80
            chars = np.concatenate([[0], np.cumsum(lead)])
            if by_lines:
                edges = np.union1d(np.flatnonzero(data == 10) + 1, offsets[:-1][offsets[:-1] < offsets[1:]])
                edges = edges[edges < len(data)]
            else:
                given = batch.column(2)
                sizes = np.array([len(x) if x is not None else 0 for x in given.to_pylist()])
                places = np.concatenate([[0], np.flatnonzero(lead), [len(data)]])[1:]
                own = np.repeat(np.arange(len(sizes)), sizes)
                inside = np.array(given.flatten().to_pylist(), np.int64)
                total = chars[offsets[1:]] - chars[offsets[:-1]]
                keep = inside < total[own]
                edges = places[chars[offsets[:-1]][own[keep]] + inside[keep]]
                edges = np.union1d(edges, offsets[:-1][offsets[:-1] < offsets[1:]])
            doc = np.searchsorted(offsets, edges, "right") - 1
            section = np.arange(len(edges)) - np.searchsorted(edges, offsets)[doc]
            full = np.append(edges, len(data))
            n, shared = allot(ends - widths, ends, full, rule)
            base = chars[offsets[doc]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(section), pa.array(chars[full[:-1]] - base), pa.array(chars[full[1:]] - base), pa.array(n if rule == "split" else n.astype(np.int64), kind), pa.array(shared.astype(np.int64))], names=out.names)

    return mapped(narrow, run, out, held_as(tokenizer))


def total_tokens(df: DataFrame, tokenizer: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """df with the token count of each whole text in column `out` (renamed if df has it)."""
    name = fresh(df, out)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])
    where = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer)
        for batch in slices(batches, text):
            _, at = bpe.encode(*utf8(batch.column(where)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(at))], names=schema.names)

    return mapped(df, run, schema, held_as(tokenizer))
