"""Helpers shared by the training-data operators: scratch tables, Arrow text access, ragged numpy arrays."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join is broadcast only if it was counted and has at most this many rows of fixed width.
BROADCAST_ROWS = 2_000_000
#: Python code works on slices of at most about this many bytes of text at a time (one longer text is a slice of its own).
SLICE_BYTES = 1 << 20
#: About what an Arrow batch holds that Python workers are sent.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):
    _trim = None
_held: dict[Hashable, Any] = {}


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """An object that a Python worker makes once and keeps for the stage that it works for."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def drop_held(keeps: Hashable) -> None:
    for key in [k for k in _held if k != keeps]:
        del _held[key]


def release() -> None:
    """Freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str, keeps: Hashable = None) -> DataFrame:
    """df.mapInArrow that leaves no memory behind in workers, which live on: only what is held under `keeps` stays.

    Batches are bounded by bytes as well as by rows, for the session.
    """
    conf = df.sparkSession.conf
    if not 0 < int("".join(filter(str.isdigit, conf.get(_BATCH))) or 0) <= BATCH_BYTES:
        conf.set(_BATCH, str(BATCH_BYTES))

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held(keeps)
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(tidied, schema)


def scratch_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, as in local tests, one below the warehouse is set.

    The warehouse is shared by driver and executors wherever tables are.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch")
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared scratch folder: cuts lineage, survives lost executors, gives true sizes to the planner.

    The table goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are few; beyond the limit Spark shuffles."""
    return F.broadcast(df) if rows <= limit else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def search(edges: list, value: Column, strict: bool = False) -> Column:
    """How many of the ascending edges are at most (strict: below) value, by a binary search in one expression; 0 for null."""
    if not edges:
        return F.lit(0)
    table = F.array(*[F.lit(e) for e in edges])
    steps = F.array(*[F.lit(1 << i) for i in range(len(edges).bit_length() - 1, -1, -1)])

    def step(at: Column, size: Column) -> Column:
        edge = F.get(table, at + size - 1)
        return F.when(F.coalesce(edge < value if strict else edge <= value, F.lit(False)), at + size).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have, whatever its case."""
    have = {c.lower() for c in df.columns}
    while stem.lower() in have:
        stem += "_"
    return stem


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, end to end, and len + 1 offsets into them; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, ends, data = texts.buffers()
    if len(texts) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    ends = np.frombuffer(ends, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice holds about `most` bytes of `column`; bounds what Python holds at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, ends = utf8(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs [start, start + length), one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
