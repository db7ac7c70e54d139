"""Document fingerprints by consistent weighted sampling.

Terms are shingles of `width` words, weighted by their count in the text. For each of `samples` draws and each term three
numbers follow from a hash of both: r and c from the gamma distribution of shape 2, and b, uniform. With
t = floor(ln weight / r + b), the term with the least ln c - r (t - b + 1) is drawn, and (term, t) is the sample. Two
texts draw the same sample with a chance equal to the generalised Jaccard similarity of their weights, so the share of
equal samples estimates it. A sample is kept as 16 bits.

A text without words, and a null one, has the fingerprint of zeros; it is like another such text (1) and unlike all
others (0). Equal texts have equal fingerprints. The next document of `with_edits` is the next by ascending id, null ids
first, rows with equal ids by their text, so repeated rows follow each other; after the last comes the first. Ids are of
any type with an order. An empty table gives no rows. Texts of any length are read whole. Extra columns are ignored.
Samples are made of numbers of 16 bits, which tell terms apart well until a text has many times 65,536 different ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, mix, search, slices, utf8
from .words import shingles


def _gamma2() -> np.ndarray:
    """65,536 midpoint quantiles of the gamma distribution of shape 2: roots of 1 - (1 + x) exp(-x) = q."""
    q = (np.arange(65536) + 0.5) / 65536
    low, high = np.zeros(65536), np.full(65536, 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        right = 1 - (1 + mid) * np.exp(-mid) < q
        low, high = np.where(right, mid, low), np.where(right, high, mid)
    return (low + high) / 2


class Sampler:
    def __init__(self, samples: int = 64, width: int = 2):
        self.samples, self.width = samples, width
        gamma = _gamma2()
        self.r, self.ln = gamma.astype(np.float32), np.log(gamma).astype(np.float32)
        self.b = ((np.arange(65536) + 0.5) / 65536).astype(np.float32)
        self.seeds = mix(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))

    def draws(self, terms: np.ndarray, weights: np.ndarray, rows: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """For each weighted term, its value and its 16 bits in each draw."""
        value, bits = np.empty((len(terms), self.samples), np.float32), np.empty((len(terms), self.samples), np.uint16)
        ln = np.log(weights).astype(np.float32)
        for i in range(0, len(terms), rows):
            z = mix(terms[i : i + rows, None] ^ self.seeds)
            parts = z.view(np.uint16).reshape(*z.shape, 4)  # four independent numbers of 16 bits
            r, c, b = self.r[parts[..., 0]], self.ln[parts[..., 1]], self.b[parts[..., 2]]
            value[i : i + rows] = c - r * (1 - b)
            bits[i : i + rows] = parts[..., 3]
            more = np.flatnonzero(weights[i : i + rows] > 1)  # at weight 1 t is 0
            if len(more):
                t = np.floor(ln[i + more, None] / r[more] + b[more])
                value[i + more] = c[more] - r[more] * (t - b[more] + 1)
                bits[i + more] += (t.astype(np.int64) * 40503).astype(np.uint16)
        return value, bits

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Samples of each text, a row of uint16 for each; of a text without words, zeros."""
        hashes, at = shingles(data, offsets, self.width)
        n = len(offsets) - 1
        out = np.zeros((n, self.samples), np.uint16)
        full = np.flatnonzero(np.diff(at) > 0)
        if not len(full):
            return out
        own = [np.unique(hashes[at[i] : at[i + 1]], return_counts=True) for i in full]
        sizes = np.array([len(t) for t, _ in own])
        terms, weights = np.concatenate([t for t, _ in own]), np.concatenate([c for _, c in own])
        _, first, back = np.unique(mix(terms) + weights.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), return_index=True, return_inverse=True)
        value, bits = self.draws(terms[first], weights[first])
        column, ends = np.arange(self.samples), np.cumsum(sizes)
        for i, s, e in zip(full, ends - sizes, ends, strict=True):
            at_ = back[s:e]
            out[i] = bits[at_[value[at_].argmin(0)], column]
        out[full] = np.maximum(out[full], 1)  # zeros stand for no words
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples, row by row."""
    return (a == b).mean(axis=-1)


def written_out(samples: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in samples.astype(">u2")]


def fingerprints(docs: DataFrame, samples: int = 64, width: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id and fingerprint (hexadecimal, four digits a sample) of each whole text."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples, width)
        for batch in slices(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(written_out(sampler(*utf8(batch.column(1)))), pa.string())], names=schema.names)

    return mapped(docs.select(docs[id_col], docs[text].alias("text")), run, schema)


def with_next(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(bucket, tail, id, text) by ascending id in each bucket, dealt by ranges of ids; each bucket ends with a tail row, the first of the bucket after it."""
    spark = docs.sparkSession
    named = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if isinstance(named.schema["id"].dataType, T.NumericType):
        cuts = named.select(F.percentile_approx("id", [i / parts for i in range(1, parts)], 20 * parts)).first()[0] if parts > 1 else None
    else:  # of other ids, a sample of about 100 for each bucket; it only makes buckets even
        seen = sorted(r[0] for r in named.filter("id is not null").select("id").sample(min(1.0, 100 * parts / max(1, named.count())), 3).collect())
        cuts = [seen[len(seen) * i // parts] for i in range(1, parts)] if seen else None
    cuts = sorted(set(cuts or []))
    bucket = search(cuts, F.col("id"))
    named = named.select(bucket.cast("int").alias("bucket"), F.lit(False).alias("tail"), "id", "text")
    # the first row of each bucket goes with the bucket before it, too: at most a row for each bucket
    firsts = named.groupBy("bucket").agg(F.min("id").alias("id"), F.count_if(F.col("id").isNull()).alias("nulls")).collect()
    order = sorted(r["bucket"] for r in firsts)
    if not order:
        return named
    before = {b: order[i - 1] for i, b in enumerate(order)}
    heads = spark.createDataFrame([(r["bucket"], before[r["bucket"]], None if r["nulls"] else r["id"]) for r in firsts], T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("before", T.IntegerType()), T.StructField("head", named.schema["id"].dataType)]))
    tails = named.join(F.broadcast(heads), "bucket").filter(F.col("id").eqNullSafe(F.col("head")))
    tails = tails.groupBy(F.col("before").alias("bucket"), "id").agg(F.min("text").alias("text")).select("bucket", F.lit(True).alias("tail"), "id", "text")
    return named.unionByName(tails).repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket", "tail", F.col("id").asc_nulls_first(), "text")


def edited(text: str, next_text: str) -> str:
    """The last half of the code points (rounded down) replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + next_text[:half]


def with_edits(docs: DataFrame, samples: int = 64, width: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = with_next(docs, id_col, text)
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples, width)
        held: pa.RecordBatch | None = None
        for batch in slices(batches, "text", 1 << 20):
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            held = batch.slice(batch.num_rows - 1)
            n = batch.num_rows - 1
            if not n:
                continue
            texts = batch.column(3).to_pylist()
            changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
            own = sampler(*utf8(batch.column(3)))
            other = sampler(*utf8(pa.array(changed, pa.string())))
            sha = [hashlib.sha256(x.encode()).hexdigest() for x in changed]
            # a tail row is followed by the next bucket's rows; it isn't a row of the result
            yield pa.RecordBatch.from_arrays([batch.column(2).slice(0, n), pa.array([len(x) for x in texts[:n]], pa.int64()), pa.array(sha, pa.string()), pa.array(written_out(own[:n]), pa.string()), pa.array(written_out(other), pa.string()), pa.array(likeness(own[:n], other)), pa.array(likeness(own[:n], own[1:]))], names=schema.names).filter(pc.invert(batch.column(1).slice(0, n)))

    return mapped(rows.select("bucket", "tail", "id", "text"), run, schema)
