"""Sources and sinks by verb."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lang.lexer import ScriptError
from ..operators.registry import INPUTS, OUTPUTS, REQUIRED, Verb
from ..operators.scalar import text
from ..operators.transforms import csv_line
from ..stream import KEY, OBJECT, VALUE, RecordContext, Stream, quoted

#: Codec names of scripts and Spark's for them.
CODECS = {"NONE": "none", "GZ": "gzip", "GZIP": "gzip", "BZ2": "bzip2", "SNAPPY": "snappy", "LZ4": "lz4", "ZST": "zstd", "ZSTD": "zstd"}


def _register(table: dict[str, Verb], name: str, run: Any, accepts: tuple[str, ...] = (), **params: Any) -> None:
    table[name.lower()] = Verb(name, run, params, {"": accepts})


def paths_of(path: str) -> list[str]:
    """Comma-separated paths; commas in braces belong to a pattern."""
    out, depth, now = [], 0, ""
    for c in path:
        depth += (c == "{") - (c == "}")
        if c == "," and not depth:
            out.append(now)
            now = ""
        else:
            now += c
    return [p for p in [*out, now] if p]


def subfolders(spark: SparkSession, path: str) -> dict[str, str]:
    """Folders below a path, by name, as any Hadoop file system lists them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return {s.getPath().getName(): s.getPath().toString() for s in fs.listStatus(p) if s.isDirectory()}


def keyed(df: DataFrame, by: str) -> DataFrame:
    """The key of a new stream: a hash of the record, of its file, or a random number."""
    if by == "RANDOM":
        key: Column = F.floor(F.rand() * 2**31).cast("int")
    elif by == "SOURCE":
        key = F.xxhash64(F.col("__source"))
    else:
        own = [F.to_json(c) if c == OBJECT else F.col(quoted(c)) for c in df.columns if c != "__source"]
        key = F.xxhash64(*own)
    return df.withColumn(KEY, key).drop("__source")


def _source(params: dict[str, Any]) -> list[Column]:
    """The file of a record, where keys are made of it."""
    return [F.col("_metadata.file_path").alias("__source")] if params.get("__by") == "SOURCE" else []


def _text(spark: SparkSession, path: str, params: dict[str, Any], columns: list[str]) -> tuple[DataFrame, str, list[str]]:
    return spark.read.text(paths_of(path)).select(VALUE, *_source(params)), "text", []


def _csv(spark: SparkSession, path: str, params: dict[str, Any], columns: list[str]) -> tuple[DataFrame, str, list[str]]:
    reader = spark.read.option("sep", params["delimiter"]).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").option("enforceSchema", "true")
    if params["schema_from_file"]:
        df = reader.option("header", "true").csv(paths_of(path))
        names = columns or df.columns
        return df.select(*[F.col(quoted(n)) for n in names], *_source(params)), "columnar", names
    if not columns:
        raise ScriptError("columns are needed, or @schema_from_file=TRUE")
    schema = ", ".join(f"`c{i}` string" for i in range(len(columns)))
    kept = [(i, n) for i, n in enumerate(columns) if n != "_"]
    df = reader.schema(schema).csv(paths_of(path))
    return df.select(*[F.col(f"c{i}").alias(n) for i, n in kept], *_source(params)), "columnar", [n for _, n in kept]


def _parquet(spark: SparkSession, path: str, params: dict[str, Any], columns: list[str]) -> tuple[DataFrame, str, list[str]]:
    df = spark.read.parquet(*paths_of(path))
    names = [c for c in columns if c != "_"] or df.columns
    own = [F.col(quoted(n)).cast("string").alias(n) if params["as_text"] else F.col(quoted(n)) for n in names]
    return df.select(*own, *_source(params)), "columnar", names


def _parquet_structured(spark: SparkSession, path: str, params: dict[str, Any], columns: list[str]) -> tuple[DataFrame, str, list[str]]:
    df = spark.read.parquet(*paths_of(path))
    names = columns or df.columns
    return df.select(F.to_variant_object(F.struct(*[F.col(quoted(n)) for n in names])).alias(OBJECT), *_source(params)), "structured", names


def _jdbc(spark: SparkSession, path: str, params: dict[str, Any], columns: list[str]) -> tuple[DataFrame, str, list[str]]:
    """path: a query; two question marks in it are the first and last number of a partition, from 0."""
    parts = params.get("__parts") or 1
    out = None
    for i in range(parts if "?" in path else 1):
        query = path
        for bound in (i, i) if "?" in path else ():
            query = query.replace("?", str(bound), 1)
        reader = spark.read.format("jdbc").option("driver", params["driver"]).option("url", params["url"]).option("query", query)
        for k in ("user", "password"):
            reader = reader.option(k, params[k]) if params[k] else reader
        df = reader.load()
        out = df if out is None else out.unionByName(df)
    names = [c for c in columns if c != "_"] or out.columns
    return out.select(*[F.col(quoted(n)) for n in names], F.lit(params["url"]).alias("__source")), "columnar", names


def with_keys(spark: SparkSession, params: dict[str, Any]) -> None:
    """Access to an S3-like store, for paths of s3a."""
    conf = spark._jsc.hadoopConfiguration()
    for k, name in (("access_key", "fs.s3a.access.key"), ("secret_key", "fs.s3a.secret.key"), ("endpoint", "fs.s3a.endpoint"), ("region", "fs.s3a.endpoint.region")):
        if params.get(k):
            conf.set(name, params[k])


def s3_path(path: str) -> str:
    return "s3a://" + path.split("://", 1)[1] if path.startswith(("s3://", "s3n://")) else path


def _s3_text(spark: SparkSession, path: str, params: dict[str, Any], columns: list[str]) -> tuple[DataFrame, str, list[str]]:
    with_keys(spark, params)
    return _text(spark, s3_path(path), params, columns)


def _s3_columnar(spark: SparkSession, path: str, params: dict[str, Any], columns: list[str]) -> tuple[DataFrame, str, list[str]]:
    with_keys(spark, params)
    if path.rstrip("/*").endswith(".parquet"):
        return _parquet(spark, s3_path(path), {**params, "as_text": True}, columns)
    return _csv(spark, s3_path(path), params, columns)


_S3 = {"access_key": ("text", None), "secret_key": ("text", None), "endpoint": ("text", None), "region": ("text", None)}
_DB = {"driver": ("text", REQUIRED), "url": ("text", REQUIRED), "user": ("text", None), "password": ("text", None)}
_register(INPUTS, "hadoopText", _text)
_register(INPUTS, "textColumnar", _csv, delimiter=("text", "\t"), schema_from_file=("bool", False))
_register(INPUTS, "parquetColumnar", _parquet, as_text=("bool", False))
_register(INPUTS, "parquetStructured", _parquet_structured)
_register(INPUTS, "jdbcColumnar", _jdbc, **_DB)
_register(INPUTS, "s3directText", _s3_text, **_S3)
_register(INPUTS, "s3directColumnar", _s3_columnar, delimiter=("text", "\t"), schema_from_file=("bool", True), **_S3)


# -- sinks
def _cells(s: Stream, columns: list[str]) -> list[Column]:
    ctx = RecordContext(s)
    return [F.col(KEY).cast("string") if n == KEY else text(ctx.attr(n)) for n in columns or s.names]


def _codec(params: dict[str, Any]) -> str:
    name = (params.get("codec") or "NONE").upper()
    if name not in CODECS:
        raise ScriptError(f"codec is one of {', '.join(CODECS)}")
    return CODECS[name]


def _write_text(s: Stream, path: str, params: dict[str, Any], columns: list[str]) -> None:
    line = F.col(VALUE) if s.kind == "text" else csv_line(_cells(s, columns), params["delimiter"])
    s.df.select(line.alias(VALUE)).write.option("compression", _codec(params)).text(path)


def _write_parquet(s: Stream, path: str, params: dict[str, Any], columns: list[str]) -> None:
    ctx = RecordContext(s)
    own = [(F.coalesce(text(ctx.attr(n)), F.lit("")) if params["as_text"] else ctx.attr(n).c).alias(n) for n in columns or s.names]
    s.df.select(*own).write.option("compression", _codec(params)).parquet(path)


def _write_jdbc(s: Stream, path: str, params: dict[str, Any], columns: list[str]) -> None:
    """path: the table."""
    ctx = RecordContext(s)
    writer = s.df.select(*[ctx.attr(n).c.alias(n) for n in columns or s.names]).write.format("jdbc").mode("append").option("driver", params["driver"]).option("url", params["url"]).option("dbtable", path).option("batchsize", params["batch_size"])
    for k in ("user", "password"):
        writer = writer.option(k, params[k]) if params[k] else writer
    writer.save()


def _s3_write(write: Any) -> Any:
    def run(s: Stream, path: str, params: dict[str, Any], columns: list[str]) -> None:
        with_keys(s.df.sparkSession, params)
        write(s, s3_path(path), params, columns)

    return run


_CODEC = {"codec": ("text", "NONE")}
_register(OUTPUTS, "hadoopText", _write_text, ("text", "columnar"), delimiter=("text", "\t"), **_CODEC)
_register(OUTPUTS, "columnarParquet", _write_parquet, ("columnar",), as_text=("bool", False), **_CODEC)
_register(OUTPUTS, "jdbcColumnar", _write_jdbc, ("columnar",), batch_size=("int", 500), **_DB)
_register(OUTPUTS, "s3directText", _s3_write(_write_text), ("text", "columnar"), delimiter=("text", "\t"), content_type=("text", None), **_CODEC, **_S3)
_register(OUTPUTS, "s3directParquet", _s3_write(_write_parquet), ("columnar",), as_text=("bool", False), content_type=("text", None), **_CODEC, **_S3)
