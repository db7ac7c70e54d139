"""Operations: aggregation and analysis of keyed streams as native plans with partial aggregation."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lang.lexer import ScriptError
from ..stream import KEY, RecordContext, Stream, quoted
from .registry import ATTRIBUTED, EVERY, REQUIRED, SIGNAL, operation
from .scalar import V, double, text

Streams = dict[str, Stream]


def _columnar(s: Stream, df: DataFrame, names: list[str], what: str) -> Stream:
    return s.made("GENERATED", what, df=df.select(KEY, *[F.col(quoted(n)) for n in names]), kind="columnar", attrs={"value": names})


def _attr(s: Stream, name: str) -> V:
    return RecordContext(s).attr(name)


def _key_or(s: Stream, name: str | None) -> Column:
    return text(_attr(s, name)) if name else F.col(KEY).cast("string")


@operation("countByKey", EVERY, also_transform=True)
def count_by_key(inputs: Streams, params: dict[str, Any]) -> Streams:
    s = inputs[""]
    return {"": _columnar(s, s.df.groupBy(KEY).agg(F.count("*").alias("_count")), ["_count"], "countByKey")}


def quantile(values: Column, q: float) -> Column:
    """With m = floor(n q): the mean of elements m - 1 and m of an even number of values, element m of an odd one (from 0)."""
    own = F.sort_array(F.collect_list(values))
    n = F.size(own)
    m = F.least(F.floor(n * q).cast("int"), n - 1)
    return F.when(n == 0, F.lit(None)).when(n % 2 == 0, (F.get(own, m) + F.get(own, F.greatest(m - 1, F.lit(0)))) / 2).otherwise(F.get(own, m))


def calculation(name: str, x: Column, c: float | None) -> Column:
    zero, one = F.lit(c if c is not None else 0.0), F.lit(c if c is not None else 1.0)
    n = F.count(x)
    if name == "SUM":
        return zero + F.sum(x)
    if name == "SUBTRACT":
        return zero - F.sum(x)
    if name in ("AVERAGE", "MEAN"):
        return (zero + F.sum(x)) / n
    if name in ("POWERMEAN", "POWER_MEAN"):
        if c is None:
            raise ScriptError("POWERMEAN needs calc_const")
        return F.pow(F.sum(F.pow(x, F.lit(c))) / n, F.lit(1 / c))
    if name == "RMS":
        return F.sqrt(F.sum(x * x) / n)
    if name == "MIN":
        return F.min(x) if c is None else F.greatest(F.min(x), F.lit(c))
    if name == "MAX":
        return F.max(x) if c is None else F.least(F.max(x), F.lit(c))
    if name in ("MUL", "MULTIPLY"):
        return F.product(x) * one
    if name in ("DIV", "DIVIDE"):
        return one / F.product(x)
    if name == "EQUALITY":
        # without an order all values must agree; with a constant they must differ by less
        return F.when((F.max(x) == F.min(x)) if c is None else (F.max(x) - F.min(x) < c), F.lit(1.0)).otherwise(F.lit(0.0))
    if name == "MEDIAN":
        return F.percentile(x, F.lit(0.5))
    if name == "QUANTILE":
        return quantile(x, 0.5 if c is None else c)
    raise ScriptError(f"unknown calc_function {name}")


@operation("keyedMath", ATTRIBUTED, calc_results=("list", REQUIRED), source_attr__ANY=("text", None), calc_function__ANY=("text", None), calc_const__ANY=("double", None))
def keyed_math(inputs: Streams, params: dict[str, Any]) -> Streams:
    s = inputs[""]
    own = []
    for r in params["calc_results"]:
        if r not in params["source_attr_"] or r not in params["calc_function_"]:
            raise ScriptError(f"keyedMath needs @source_attr_{r} and @calc_function_{r}")
        own.append(calculation(params["calc_function_"][r].upper(), double(_attr(s, params["source_attr_"][r])), params["calc_const_"].get(r)).alias(r))
    return {"": _columnar(s, s.df.groupBy(KEY).agg(*own), params["calc_results"], "keyedMath")}


@operation("seriesMath", ATTRIBUTED, also_transform=True, calc_attr=("text", REQUIRED), calc_function=("STDDEV|NORMALIZE", REQUIRED), calc_const=("double", 100.0))
def series_math(inputs: Streams, params: dict[str, Any]) -> Streams:
    """The whole series is summed to one row, which goes to all records."""
    s = inputs[""]
    x = double(_attr(s, params["calc_attr"]))
    if params["calc_function"] == "NORMALIZE":
        whole = s.df.agg(F.max(x).alias("__max"), F.min(x).alias("__min"))
        result = F.lit(params["calc_const"]) - (F.col("__max") - x) / (F.col("__max") - F.col("__min")) * params["calc_const"]
    else:
        whole = s.df.agg(F.avg(x).alias("__mean"), F.when(F.count(x) < 30, F.stddev_pop(x)).otherwise(F.stddev_samp(x)).alias("__sd"))
        result = (x - F.col("__mean")) / F.col("__sd")
    df = s.df.crossJoin(F.broadcast(whole)).withColumn("_result", result).select(*[F.col(quoted(c)) for c in s.df.columns], "_result")
    return {"": s.made("AUGMENTED", "seriesMath", df=df, attrs={**s.attrs, s.level: [*s.names, "_result"]})}


@operation("countUniques", ATTRIBUTED, also_transform=True, count_attrs=("list", REQUIRED))
def count_uniques(inputs: Streams, params: dict[str, Any]) -> Streams:
    s = inputs[""]
    own = {a: _attr(s, a) for a in params["count_attrs"]}
    exprs = [(F.count_distinct(v.c if v.t != "var" else text(v)) + F.coalesce(F.max(v.c.isNull().cast("long")), F.lit(0))).cast("long").alias(a) for a, v in own.items()]
    return {"": _columnar(s, s.df.groupBy(KEY).agg(*exprs), params["count_attrs"], "countUniques")}


def percent_ranks(values: DataFrame, by: list[str]) -> DataFrame:
    """(values strictly less) / (N - 1), from counts of distinct values: running sums per bucket of the value range, then within it, so that no window holds all rows."""
    counts = values.groupBy(*by, "_value").agg(F.count("*").alias("n"))
    spark = values.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = Window.partitionBy(*by)
    if by:
        less = F.coalesce(F.sum("n").over(whole.orderBy("_value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return counts.withColumns({"less": less, "total": F.sum("n").over(whole)})
    cuts = counts.select(F.percentile_approx("_value", [i / buckets for i in range(1, buckets)], 1000).alias("c")).first()["c"] if buckets > 1 else []
    cuts = sorted(set(cuts or []))
    bucket = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= F.col("_value"))) if cuts else F.lit(0)
    counts = counts.withColumn("bucket", bucket)
    sums = counts.groupBy("bucket").agg(F.sum("n").alias("m"))
    order = Window.orderBy("bucket")  # a row for each bucket
    sums = sums.select("bucket", F.coalesce(F.sum("m").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("m").over(Window.partitionBy()).alias("total"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("_value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("inside", inside).join(F.broadcast(sums), "bucket").withColumn("less", F.col("inside") + F.col("before"))


@operation("percentRankInc", ATTRIBUTED, also_transform=True, value_attr=("text", REQUIRED), per_key=("bool", False))
def percent_rank_inc(inputs: Streams, params: dict[str, Any]) -> Streams:
    s = inputs[""]
    x = double(_attr(s, params["value_attr"])).alias("_value")
    by = [KEY] if params["per_key"] else []
    counts = percent_ranks(s.df.select(KEY, x), by)
    rank = F.when(F.col("total") > 1, F.col("less") / (F.col("total") - 1)).otherwise(F.lit(math.nan))
    key = F.col(KEY) if by else F.col("n")
    rows = counts.select(key.alias(KEY), "_value", rank.alias("_rank"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select(KEY, "_value", "_rank")
    return {"": _columnar(s, rows, ["_value", "_rank"], "percentRankInc")}


@operation("frequency", SIGNAL, also_transform=True, frequency_attr=("text", REQUIRED), reference_attr=("text", None))
def frequency(inputs: Streams, params: dict[str, Any]) -> Streams:
    s = inputs[""]
    rows = s.df.select(_key_or(s, params["reference_attr"]).alias("ref"), text(_attr(s, params["frequency_attr"])).alias("v"))
    counts = rows.groupBy("ref", "v").agg(F.count("*").alias("n"))
    totals = counts.groupBy("ref").agg(F.sum("n").alias("t"))
    shares = counts.join(totals, counts["ref"].eqNullSafe(totals["ref"])).select("v", (F.col("n") / F.col("t")).alias("share"))
    return {"": _columnar(s, shares.groupBy(F.col("v").alias(KEY)).agg(F.percentile("share", 0.5).alias("_frequency")), ["_frequency"], "frequency")}


_PAIR = {"signals": SIGNAL, "target": SIGNAL}
_USERS = {"signals_userid_attr": ("text", REQUIRED), "target_userid_attr": ("text", REQUIRED), "target_grouping_attr": ("text", REQUIRED)}


@operation("dwellTime", _PAIR, **_USERS)
def dwell_time(inputs: Streams, params: dict[str, Any]) -> Streams:
    a, b = inputs["signals"], inputs["target"]
    users = a.df.groupBy(text(_attr(a, params["signals_userid_attr"])).alias("u")).agg(F.count("*").alias("all"))
    own = b.df.groupBy(text(_attr(b, params["target_userid_attr"])).alias("u"), text(_attr(b, params["target_grouping_attr"])).alias(KEY)).agg(F.count("*").alias("n"))
    return {"": _columnar(b, own.join(users, "u").groupBy(KEY).agg(F.avg(F.col("n") / F.col("all")).alias("_dwelltime")), ["_dwelltime"], "dwellTime")}


@operation("reach", _PAIR, **_USERS)
def reach(inputs: Streams, params: dict[str, Any]) -> Streams:
    a, b = inputs["signals"], inputs["target"]
    total = a.df.agg(F.count_distinct(text(_attr(a, params["signals_userid_attr"]))).alias("total"))
    own = b.df.groupBy(text(_attr(b, params["target_grouping_attr"])).alias(KEY)).agg(F.count_distinct(text(_attr(b, params["target_userid_attr"]))).alias("n"))
    return {"": _columnar(b, own.crossJoin(F.broadcast(total)).select(KEY, (F.col("n") / F.col("total")).alias("_reach")), ["_reach"], "reach")}


@operation("parametricScore", {"values": SIGNAL, "multipliers": ("columnar", "structured")}, grouping_attr=("text", REQUIRED), value_attr=("text", None), count_attr=("text", REQUIRED), match_attr=("text", None), multiplier_attr=("text", REQUIRED), top_scores=("int", 1))
def parametric_score(inputs: Streams, params: dict[str, Any]) -> Streams:
    """Counts by (count, group, value) times the multiplier of the count attribute, summed; equal scores of a group count as one, by the least value."""
    v, m = inputs["values"], inputs["multipliers"]
    top = params["top_scores"]
    counts = v.df.groupBy(text(_attr(v, params["count_attr"])).alias("c"), text(_attr(v, params["grouping_attr"])).alias(KEY), _key_or(v, params["value_attr"]).alias("v")).agg(F.count("*").alias("n"))
    factors = m.df.select(_key_or(m, params["match_attr"]).alias("c"), double(_attr(m, params["multiplier_attr"])).alias("m"))
    scores = counts.join(factors, "c").groupBy(KEY, "v").agg(F.sum(F.col("n") * F.col("m")).alias("s"))
    scores = scores.groupBy(KEY, "s").agg(F.min("v").alias("v"))
    ranked = scores.withColumn("r", F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("s")))).filter(F.col("r") <= top)
    names, own = [], []
    for i in range(1, top + 1):
        names += [f"_value_{i}", f"_score_{i}"]
        own += [F.max(F.when(F.col("r") == i, F.col("v"))).alias(f"_value_{i}"), F.max(F.when(F.col("r") == i, F.col("s"))).alias(f"_score_{i}")]
    return {"": _columnar(v, ranked.groupBy(KEY).agg(*own), names, "parametricScore")}
