"""Windowed keyed aggregation of unbounded streams. Late records are let in up to the watermark; state older than it goes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.analytics import calculation


def read_folder(spark: SparkSession, path: str, schema: object, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed(df: DataFrame, ts: str, every: str, late: str, keys: list[str], results: dict[str, tuple[str, str, float | None]], slide: str | None = None) -> DataFrame:
    """Tumbling (or sliding) windows by key: results maps a column to (function, attribute, constant) of keyedMath; _count is always there."""
    window = F.window(ts, every, slide) if slide else F.window(ts, every)
    own: list[Column] = [F.count("*").alias("_count")]
    for name, (f, attr, c) in results.items():
        if f in ("QUANTILE",):
            raise ValueError("QUANTILE gathers a group; use MEDIAN or a batch")
        own.append(calculation(f, F.col(attr).cast("double"), c).alias(name))
    grouped = df.withWatermark(ts, late).groupBy(window.alias("w"), *keys).agg(*own)
    return grouped.select(F.col("w.start").alias("window_start"), *keys, "_count", *results)


def sessions(df: DataFrame, ts: str, gap: str, late: str, keys: list[str]) -> DataFrame:
    """Sessions of a key: records less than a gap apart."""
    grouped = df.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("_count"))
    return grouped.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "_count")


def drain(df: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over what there is and returns its result as a table of files beside the checkpoint; complete results replace each other, else batches add up. The files go with the driver."""
    spark = df.sparkSession
    base = checkpoint or spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_streams"
    own = f"{base.rstrip('/')}/{name}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{own}-result-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    made: list[str] = []

    def keep(batch: DataFrame, i: int) -> None:
        # a batch that is run again replaces its own files
        made[:] = [] if mode == "complete" else [f for f in made if not f.endswith(f"/batch={i}")]
        made.append(path.toString() if mode == "complete" else f"{path.toString()}/batch={i}")
        batch.write.mode("overwrite").parquet(made[-1])

    query = df.writeStream.foreachBatch(keep).queryName(name).outputMode(mode).option("checkpointLocation", own).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(*made) if made else spark.createDataFrame([], df.schema)
