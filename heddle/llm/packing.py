"""Harmonic packing of token sequences.

A document is its ids and an end id. It is cut into pieces: whole sequences first, then its rest r. r belongs to class
k = capacity // r, of which k pieces fill a sequence. If k such pieces would leave more than `slack` of a sequence
empty, the largest harmonic size capacity // (k + 1) is cut off first and the rule is applied to what remains. So each
class's sequences hold a fixed number of pieces and are nearly full, whichever pieces of the class meet there, and
workers fill them without knowing of each other: all that is shared is a count for each class and bucket.

The last, incomplete sequence of each class is opened again: these pieces, fewer than the sum of k over the classes
whatever the input, are packed by first fit, the longest first.

Null texts count as empty: one piece, the end id. Repeated rows are packed each for itself. Documents of any length are
cut; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import held_as, loaded
from .common import mapped, slices, utf8, written


def cut(rest: int, capacity: int, slack: float) -> list[int]:
    """Lengths of the pieces of a rest shorter than a sequence."""
    out = []
    while rest:
        k = capacity // rest
        if capacity - k * rest <= slack * capacity:
            out.append(rest)
            break
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return out


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, slack: float, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", id_type)] + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "k")])
    rests = [cut(r, capacity, slack) for r in range(capacity)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer)
        for batch in slices(batches, "text"):
            ids, at = bpe.encode(*utf8(batch.column(1)))
            rows: list[tuple[int, int, int, int, int, int]] = []
            for i in range(batch.num_rows):
                own = np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)).astype("<u4")
                start = 0
                for length in [capacity] * (len(own) // capacity) + rests[len(own) % capacity]:
                    rows.append((i, start, length, zlib.crc32(own[start : start + length].tobytes()), len(own), capacity // length))
                    start += length
            table = np.array(rows, np.int64).T
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(table[0])), *map(pa.array, table[1:])], names=schema.names)

    return mapped(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), run, schema, held_as(tokenizer))


def first_fit(frame: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """sequence_id (from 0) and offset of each piece, the longest first."""
    frame = frame.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable", ignore_index=True)
    room: list[int] = []
    seq, off = [], []
    for length in frame["length"]:
        i = next((i for i, r in enumerate(room) if r >= length), len(room))
        if i == len(room):
            room.append(capacity)
        seq.append(i)
        off.append(capacity - room[i])
        room[i] -= length
    return frame.assign(sequence_id=np.array(seq, np.int64), offset=np.array(off, np.int64))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048, slack: float = 0.02, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Sequence ids are gapless from 0."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut_up = written(pieces(docs, tokenizer, end_id, capacity, slack, id_col, text)).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    counts = cut_up.groupBy("k", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = written(counts.select("k", "bucket", "n", F.coalesce(before, F.lit(0)).alias("before")))
    totals = {r["k"]: r["n"] for r in counts.groupBy("k").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    base, bases = 0, []
    for k in sorted(totals):
        bases.append((k, base, totals[k] // k))
        base += totals[k] // k
    if not bases:
        return cut_up.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    classes = F.broadcast(spark.createDataFrame(bases, "k long, base long, full long"))  # a row for each class
    place = Window.partitionBy("k", "bucket").orderBy("doc_id", "start", "length", "ids_crc32")
    ranked = (
        cut_up.withColumn("rank", F.row_number().over(place) - 1)
        .join(counts.select("k", "bucket", "before"), ["k", "bucket"])
        .join(classes, "k")
        .withColumn("rank", F.col("rank") + F.col("before"))
        .withColumn("slot", F.floor(F.col("rank") / F.col("k")))
    )
    ranked = written(ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "k", "rank", "slot", "base", "full"))
    in_bin = Window.partitionBy("k", "slot").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    full = ranked.filter("slot < full").select(*names, (F.col("base") + F.col("slot")).alias("sequence_id"), F.coalesce(F.sum("length").over(in_bin), F.lit(0)).alias("offset"))
    left = ranked.filter("slot >= full").select(*names)
    schema = T.StructType([*left.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    rest = left.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(lambda f: first_fit(f.drop(columns="all"), capacity), schema)
    return full.unionByName(rest.withColumn("sequence_id", F.col("sequence_id") + base))
