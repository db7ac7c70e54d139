"""Joins, unions, keys, partitions, samples and key statistics of streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lang.lexer import ScriptError
from ..stream import GEO, KEY, OBJECT, PART, RESERVED, Stream, quoted
from .scalar import NUMERIC, type_name


def default_key(columns: list[str]) -> Column:
    """A hash of the whole record: streams without a key of their own join on equal records."""
    return F.xxhash64(*[F.col(quoted(c)) for c in columns]) if columns else F.lit(0).cast("long")


def _same(a: DataFrame, b: DataFrame, left: str, right: str) -> Column:
    """Keys match null-safely and only within a family of types."""
    x, y = type_name(a.schema[left].dataType), type_name(b.schema[right].dataType)
    if x != y and not (x in NUMERIC and y in NUMERIC) and "null" not in (x, y):
        return F.lit(False)
    return F.col(left).eqNullSafe(F.col(right))


def dealt(df: DataFrame) -> DataFrame:
    """Rows in equal parts, before a join in which each may become many: few tasks may hold them, or those of one key."""
    session = df.sparkSession
    return df.repartition(max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism))


def _prefixed(s: Stream, i: int) -> DataFrame:
    own = [F.col(KEY).alias(f"__key{i}")]
    if GEO in s.df.columns:
        own.append(F.col(GEO).alias(f"__geo{i}"))
    if s.kind == "structured":
        own.append(F.col(OBJECT).alias(f"{s.name}.{OBJECT}"))
    return s.df.select(*own, *[F.col(quoted(c)).alias(f"{s.name}.{c}") for c in s.columns])


def join(how: str, streams: list[Stream], name: str) -> Stream:
    first, last = streams[0], streams[-1]
    if how == "left_anti":
        df = first.df
        for s in streams[1:]:
            df = df.alias("a").join(s.df.select(F.col(KEY).alias("__other")), _same(df, s.df.select(F.col(KEY).alias("__other")), KEY, "__other"), "left_anti")
        return first.made("FILTERED", name, name=name, df=df)
    if how == "right_anti":
        df = last.df
        for s in streams[:-1]:
            other = s.df.select(F.col(KEY).alias("__other"))
            df = df.join(other, _same(df, other, KEY, "__other"), "left_anti")
        return last.made("FILTERED", name, name=name, df=df)
    spark_how = {"inner": "inner", "left": "left", "right": "right", "outer": "full"}[how]
    df, key = _prefixed(first, 0), "__key0"
    for i, s in enumerate(streams[1:], 1):
        right = _prefixed(s, i)
        if i > 1:
            df = dealt(df)
        df = df.join(right, _same(df, right, key, f"__key{i}"), spark_how)
        if how == "outer":
            df = df.withColumn(key, F.coalesce(key, f"__key{i}"))
        elif how == "right":
            df = df.withColumn(key, F.col(f"__key{i}"))
    main = last if how == "right" else first
    order = range(len(streams) - 1, -1, -1) if how == "right" else range(len(streams))
    geo = [F.col(f"__geo{i}") for i in order if GEO in streams[i].df.columns and streams[i].kind == main.kind]
    names = [c for c in df.columns if not c.startswith(("__key", "__geo"))]
    kind = main.kind if geo else "columnar"
    out = [F.col(key).alias(KEY), *([F.coalesce(*geo).alias(GEO)] if geo else []), *[F.col(quoted(c)) for c in names]]
    return Stream(name, df.select(*out), kind, {("value" if kind == "columnar" else main.level): names}, (*main.lineage, ("AUGMENTED", ",".join(s.name for s in streams))))


def _comparable(s: Stream) -> DataFrame:
    """Without partition numbers; variants as JSON, so that records can be compared."""
    df = s.df.drop(PART)
    return df.withColumn(OBJECT, F.to_json(OBJECT)) if s.kind == "structured" else df


def union(how: str, streams: list[Stream], name: str) -> Stream:
    first = streams[0]
    for s in streams[1:]:
        if s.kind != first.kind or set(s.names) != set(first.names):
            raise ScriptError(f"UNION of {first.name} and {s.name}: types or attributes differ")
    dfs = [_comparable(s) for s in streams]
    if how == "cat":
        out = dfs[0]
        for d in dfs[1:]:
            out = out.unionByName(d)
    elif how == "and":
        out = dfs[0]
        for d in dfs[1:]:
            out = out.intersectAll(d.select(*[F.col(quoted(c)) for c in out.columns]))
    else:
        names = dfs[0].columns
        tagged = None
        for i, d in enumerate(dfs):
            d = d.select(*[F.col(quoted(c)) for c in names], F.lit(i).alias("__from"))
            tagged = d if tagged is None else tagged.union(d)
        # map-side sums of each record's origins; a record of one origin comes back as often as it was there
        counted = tagged.groupBy(*[F.col(quoted(c)) for c in names]).agg(F.min("__from").alias("__low"), F.max("__from").alias("__high"), F.count("*").alias("__n"))
        out = counted.filter("__low = __high").select(*[F.col(quoted(c)) for c in names], F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n")))).drop("col")
    if first.kind == "structured":
        out = out.withColumn(OBJECT, F.parse_json(OBJECT))
    return first.made("AUGMENTED", ",".join(s.name for s in streams), name=name, df=out)


def rekeyed(s: Stream, key: Column, source: str) -> Stream:
    return s.but(df=s.df.withColumn(KEY, key), keyed=source)


def repartitioned(s: Stream, parts: int | None, by_key: bool) -> Stream:
    """Records dealt to numbered partitions: by key (an integer k goes to k mod n), else evenly by their hash. The number stays with the record."""
    n = parts or max(1, int(s.df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if n < 1:
        raise ScriptError("PARTITION needs a positive number")
    df = s.df
    if by_key:
        t = type_name(df.schema[KEY].dataType)
        k = F.col(KEY).cast("long") if t in ("int", "long") else F.try_variant_get(F.col(KEY), "$", "long") if t == "var" else None
        number = F.pmod(F.coalesce(k, F.lit(0)), F.lit(n)) if k is not None else F.pmod(F.xxhash64(KEY), F.lit(n))
    else:
        own = [F.to_json(F.col(OBJECT)) if c == OBJECT else F.col(quoted(c)) for c in df.columns if c != PART]
        number = F.pmod(F.xxhash64(*own), F.lit(n))
    df = df.withColumn(PART, number.cast("int"))
    return s.but(df=df.repartitionById(n, F.col(PART)))


def pruned(s: Stream, parts: object) -> Stream:
    """Only the records of some partitions."""
    own = [int(p) for p in (parts if isinstance(parts, (list, tuple)) else [parts])]
    df = s.df if PART in s.df.columns else s.df.withColumn(PART, F.spark_partition_id())
    return s.but(df=df.filter(F.col(PART).isin(own)))


def sampled(df: DataFrame, n: float, percent: bool, exact: bool) -> DataFrame:
    """About n records (or n per cent), each taken by chance; exact takes the first n that come."""
    if percent:
        if not 0 < n <= 100:
            raise ScriptError("LIMIT takes 0 to 100 per cent")
        return df.sample(False, n / 100)
    if n < 0:
        raise ScriptError("LIMIT can't be negative")
    if exact:
        return df.limit(int(n))
    count = df.count()
    return df if n >= count else df.sample(False, n / count)


METRICS = ["_name", "_type", "_parts", "_counter", "_total", "_unique", "_average", "_median"]


def analyzed(s: Stream, key: Column, counter: str, deep: bool) -> DataFrame:
    """Per stream, or per partition: records, distinct keys, and the mean and median of records per key."""
    df = s.df.withColumn("__k", key)
    part = F.col(PART) if PART in s.df.columns else F.spark_partition_id()
    df = df.withColumn("__p", part) if deep else df
    by = ["__p"] if deep else []
    counts = df.groupBy(*by, "__k").agg(F.count("*").alias("n"))
    parts = s.df.rdd.getNumPartitions() if not deep else None
    own = [F.sum("n").cast("long").alias("_total"), F.count("*").cast("long").alias("_unique"), F.avg("n").alias("_average"), F.percentile("n", 0.5).alias("_median")]
    out = counts.groupBy(*by).agg(*own) if by else counts.agg(*own)
    head = [F.lit(s.name).alias("_name"), F.lit(s.kind).alias("_type"), (F.col("__p") if deep else F.lit(parts)).cast("int").alias("_parts" if not deep else "_part_no"), F.lit(counter).alias("_counter")]
    return out.select(*head, F.coalesce("_total", F.lit(0).cast("long")).alias("_total"), "_unique", F.coalesce("_average", F.lit(0.0)).alias("_average"), F.coalesce("_median", F.lit(0.0)).alias("_median"))


def distinct(s: Stream) -> Stream:
    """Distinct pairs of key and record."""
    df = _comparable(s).dropDuplicates()
    return s.but(df=df.withColumn(OBJECT, F.parse_json(OBJECT)) if s.kind == "structured" else df)


def plain_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in RESERVED]
