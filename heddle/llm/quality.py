"""Quality rules: base counts of a text, and robust multivariate outliers by language and source, as DataFrame expressions only.

Base counts follow the words [^ \\t-\\r]+ of the whole text. A text fails the base rules with fewer than `min_words` words
or if more than `max_repeat` per cent of its words lie in five-word windows found twice or more.

For the others a vector of four transformed statistics is compared with those of the same language and source, by a
regularised minimum-covariance-determinant estimate: from several starts (scales by median absolute deviation, and the
same with correlations of signs) concentration steps move to the share `support` of the rows that lie nearest; the
start whose determinant is least wins. The nearest rows have too small a covariance for all, so it is multiplied by the
factor that makes it right for normal data, and a row is rejected if its squared Mahalanobis distance exceeds the
`quantile` of chi-square. A concentration step is one pass: rows are summed by (group, start, bucket of distance), and running sums over the
buckets give the moments of the nearest rows; so no group is gathered anywhere, and one may hold any share of the rows.

The nearest share is taken by buckets of ln distance, 5 % wide: rows of the bucket that the share ends in all count, so it
may hold a few rows more.

Groups with fewer than `min_rows` rows are pooled by language, and pools with too few over all languages; if even that
pool is small, no row is an outlier. `estimate` says for each row which of these judged it. `floors` are standard
deviations that count where a statistic is equal in most rows: the shares are 0 in most texts and anything in some good
ones, so floors keep other values from being infinitely far, and let each statistic reject by itself (symbols from about
5 % of the characters, words from 17 % repeated).

Null texts count as empty and fail; null language or source is a group of its own. Repeated rows and ties count each.
An empty table gives no rows. Texts of any length are read whole. Extra columns, whatever their names, don't matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sized, written

#: What white space is to words and lines.
_SPACES = "[ \\t\\n\\x0B\\f\\r]+"
_STATS = ("s0", "s1", "s2", "s3")
#: ln of the mean word length; angles of the shares of symbols, repeated lines and repeated words
FLOORS = (0.06, 0.045, 0.216, 0.081)
_BUCKETS, _STEP = 400, 0.05  # of ln distance
#: Estimates (about 30 numbers a row) are broadcast if they were counted and are at most this many; else Spark shuffles.
GROUPS = 100_000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def chi2_share(x: float, d: int) -> float:
    """The share of a chi-square distribution with an even number d of degrees that lies below x."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(d // 2))


def chi2_quantile(share: float, d: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_share(mid, d) < share else (low, mid)
    return high


def consistency(support: float, d: int) -> float:
    """What the covariance of the nearest share of normal rows must be multiplied by."""
    return support / chi2_share(chi2_quantile(support, d), d + 2) if support < 1 else 1.0


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long) of each whole text."""
    names = df.columns
    body = F.coalesce(F.col(text), F.lit(""))
    df = df.select("*", F.filter(F.split(body, _SPACES), lambda w: w != "").alias("__words"), F.filter(F.split(body, "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]")).alias("__lines"), (F.char_length(body) - F.char_length(F.regexp_replace(body, "[#*$%&|<>]+", ""))).alias("__symbols"))
    n = F.size("__words")
    df = df.select(*names, "__words", "__lines", "__symbols", F.when(n >= 5, F.transform(F.sequence(F.lit(1), n - 4), lambda i: F.xxhash64(F.slice("__words", i, 5)))).alias("__hashes"))
    # equal windows have equal hashes, so a text whose hashes differ repeats nothing; else the windows themselves are compared
    twice = F.size("__hashes") > F.size(F.array_distinct("__hashes"))
    windows = F.when(twice, F.sort_array(F.transform(F.sequence(F.lit(1), n - 4), lambda i: F.struct(F.array_join(F.slice("__words", i, 5), " ").alias("w"), i.alias("i")))))
    df = df.select(*names, "__words", "__lines", "__symbols", windows.alias("__windows"))
    near = lambda i, j: F.coalesce(F.get("__windows", i)["w"] == F.get("__windows", j)["w"], F.lit(False))
    found = F.sort_array(F.transform(F.filter(F.transform("__windows", lambda x, k: F.struct(x["i"].alias("i"), (near(k, k - 1) | near(k, k + 1)).alias("d"))), lambda x: x["d"]), lambda x: x["i"]))
    df = df.select(*names, "__words", "__lines", "__symbols", found.alias("__at"))
    covered = F.aggregate("__at", F.struct(F.lit(0).alias("n"), F.lit(-9).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(5), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    return df.select(
        *names,
        F.size("__words").cast("long").alias("n_words"),
        F.char_length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.col("__symbols").cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def vector() -> list[Column]:
    """The transformed statistics, from the counts."""
    angle = lambda a, b: F.asin(F.sqrt(F.least(F.lit(1.0), F.col(a) / F.greatest(F.col(b), F.lit(1)))))
    return [F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))), angle("n_symbols", "word_chars"), angle("n_dup_lines", "n_lines"), angle("n_repeat_words", "n_words")]


def _lower(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d) for j in range(i + 1)]


def _with_factor(df: DataFrame, cov: dict[tuple[int, int], Column], d: int) -> DataFrame:
    """df with the Cholesky factor l_i_j of a covariance, and its log determinant."""
    for i in range(d):
        df = df.withColumns({f"c_{i}_{j}": cov[i, j] for j in range(i + 1)})
    for i, j in _lower(d):
        rest = F.col(f"c_{i}_{j}")
        for k in range(j):
            rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
        df = df.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l_{j}_{j}"))
    return df.withColumn("logdet", sum((2 * F.log(F.col(f"l_{i}_{i}")) for i in range(d)), F.lit(0.0))).drop(*[f"c_{i}_{j}" for i, j in _lower(d)])


def _with_distance(df: DataFrame, d: int) -> DataFrame:
    """df with the squared Mahalanobis distance of s0.. from m_i under l_i_j."""
    for i in range(d):
        rest = F.col(_STATS[i]) - F.col(f"m_{i}")
        for j in range(i):
            rest = rest - F.col(f"l_{i}_{j}") * F.col(f"y_{j}")
        df = df.withColumn(f"y_{i}", rest / F.col(f"l_{i}_{i}"))
    return df.withColumn("d2", sum((F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(d)), F.lit(0.0))).drop(*[f"y_{i}" for i in range(d)])


def grouped(stats: DataFrame, min_rows: int) -> tuple[DataFrame, DataFrame]:
    """stats (passing rows only are counted) with `group`; and how keys map to groups: a row for each language and source."""
    sizes = stats.filter("not base_failed").groupBy("g_lang", "g_source").agg(F.count("*").alias("n"))
    small = F.col("n") < min_rows
    by_lang = F.sum(F.when(small, F.col("n")).otherwise(0)).over(Window.partitionBy("g_lang"))
    group = F.when(~small, F.to_json(F.array("g_lang", "g_source"))).when(by_lang >= min_rows, F.to_json(F.array("g_lang"))).otherwise("[]")
    keys = written(sizes.select("g_lang", "g_source", group.alias("group")))
    return stats.join(sized(keys, keys.count(), GROUPS), ["g_lang", "g_source"], "left"), keys


def estimates(stats: DataFrame, support: float = 0.75, steps: int = 5, floors: tuple[float, ...] = FLOORS, min_rows: int = 40) -> DataFrame:
    """A row for each group: m_i, l_i_j, logdet, n. stats: rows with `group` and s0.. that passed the base rules."""
    d = len(floors)
    # medians and deviations from mergeable sketches; only a start, so their small error does not matter
    first = written(stats.groupBy("group").agg(F.count("*").alias("n"), *[F.percentile_approx(s, 0.5, 10000).alias(f"m_{i}") for i, s in enumerate(_STATS)]).filter(F.col("n") >= min_rows))
    groups = first.count()
    # without the hint, rows of a hot group would meet in one task wherever the planner doesn't see how small this is
    spread = stats.join(sized(first, groups, GROUPS), "group").groupBy("group").agg(
        *[F.percentile_approx(F.abs(F.col(s) - F.col(f"m_{i}")), 0.5, 10000).alias(f"a_{i}") for i, s in enumerate(_STATS)],
        *[F.avg(F.signum(F.col(_STATS[i]) - F.col(f"m_{i}")) * F.signum(F.col(_STATS[j]) - F.col(f"m_{j}"))).alias(f"r_{i}_{j}") for i, j in _lower(d) if i != j],
    )
    first = first.join(spread, "group")
    scale = [F.greatest(1.4826 * F.col(f"a_{i}"), F.lit(floors[i])) for i in range(d)]
    starts = []
    for s, weight in enumerate((0.0, 0.5)):
        cov = {(i, j): scale[i] * scale[j] * (F.lit(1.0) if i == j else weight * F.col(f"r_{i}_{j}")) for i, j in _lower(d)}
        starts.append(_with_factor(first, cov, d).select("group", "n", F.lit(s).alias("start"), *[f"m_{i}" for i in range(d)], *[f"l_{i}_{j}" for i, j in _lower(d)], "logdet"))
    now = written(starts[0].unionByName(starts[1]))
    moments = [*_STATS, *[f"p_{i}_{j}" for i, j in _lower(d)]]
    for _ in range(steps):
        rows = _with_distance(stats.join(sized(now, 2 * groups, GROUPS), "group"), d)
        # values relative to the centre keep the sums exact enough
        rows = rows.withColumns({s: F.col(s) - F.col(f"m_{i}") for i, s in enumerate(_STATS)})
        rows = rows.withColumns({f"p_{i}_{j}": F.col(_STATS[i]) * F.col(_STATS[j]) for i, j in _lower(d)})
        bucket = F.greatest(F.lit(0), F.least(F.lit(_BUCKETS), F.floor((F.log(F.col("d2") + 1e-6) + 14) / _STEP)))
        sums = rows.groupBy("group", "start", bucket.alias("bucket")).agg(F.count("*").alias("h"), F.first("n").alias("n"), *[F.sum(c).alias(c) for c in moments])
        order = Window.partitionBy("group", "start").orderBy("bucket")
        upto = order.rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.select("group", "start", "bucket", F.coalesce(F.sum("h").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("prior"), F.sum("h").over(upto).alias("h"), F.ceil(F.col("n") * support).alias("need"), *[F.sum(c).over(upto).alias(c) for c in moments])
        near = sums.filter("prior < need and h >= need").join(now.select("group", "start", "n", *[F.col(f"m_{i}").alias(f"o_{i}") for i in range(d)]), ["group", "start"])
        mean = [F.col(s) / F.col("h") for s in _STATS]
        cov = {(i, j): F.col(f"p_{i}_{j}") / F.col("h") - mean[i] * mean[j] + (F.lit(floors[i] ** 2) if i == j else F.lit(0.0)) for i, j in _lower(d)}
        now = written(_with_factor(near.withColumns({f"m_{i}": F.col(f"o_{i}") + mean[i] for i in range(d)}), cov, d).select("group", "n", "start", *[f"m_{i}" for i in range(d)], *[f"l_{i}_{j}" for i, j in _lower(d)], "logdet"))
    best = F.row_number().over(Window.partitionBy("group").orderBy("logdet", "start"))
    return written(now.withColumn("turn", best).filter("turn = 1").drop("turn", "start"))


def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", min_words: int = 10, max_repeat: int = 20, support: float = 0.75, steps: int = 5, quantile: float = 0.999, floors: tuple[float, ...] = FLOORS, min_rows: int = 40) -> DataFrame:
    """doc_id, text_hash, the base counts, base_failed, kept, distance2 and estimate (null where no estimate applies)."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.to_json(F.array(F.col(lang).cast("string"))).alias("g_lang"), F.to_json(F.array(F.col(source).cast("string"))).alias("g_source"), F.col(text).alias("text"))
    counts = with_counts(named).drop("text")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    stats = written(counts.withColumn("base_failed", failed).withColumns(dict(zip(_STATS, vector(), strict=True))))
    stats, _ = grouped(stats, min_rows)
    fit = estimates(stats.filter("not base_failed").select("group", *_STATS), support, steps, floors, min_rows)
    far = _with_distance(stats.join(sized(fit, fit.count(), GROUPS), "group", "left"), len(floors)).withColumn("d2", F.col("d2") / consistency(support, len(floors)))
    used = F.when(F.col("group") == F.to_json(F.array("g_lang", "g_source")), "language and source").when(F.col("group") == F.to_json(F.array("g_lang")), "language").otherwise("all")
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("d2") > chi2_quantile(quantile, len(floors)), F.lit(False))
    return far.select("doc_id", "text_hash", *BASE, "base_failed", kept.alias("kept"), F.when(~F.col("base_failed"), F.round("d2", 6)).alias("distance2"), F.when(~F.col("base_failed") & F.col("d2").isNotNull(), used).alias("estimate"))
