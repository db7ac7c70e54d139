"""Queries over the shared tables, each a script with the stream it ends in, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..engine import Engine
from ..stream import GEO, KEY


@dataclass(frozen=True)
class Plan:
    script: str
    out: str
    sql: str | None
    key: bool = False
    digits: int = 6


PLANS: dict[str, Plan] = {}

#: Sources that most scripts begin with.
_LOADS = {
    "lineitem": "CREATE lineitem parquetColumnar FROM '{d}/lineitem.parquet';",
    "orders": "CREATE orders parquetColumnar FROM '{d}/orders.parquet';",
    "customer": "CREATE customer parquetColumnar FROM '{d}/customer.parquet';",
    "supplier": "CREATE supplier parquetColumnar FROM '{d}/supplier.parquet';",
    "part": "CREATE part parquetColumnar FROM '{d}/part.parquet';",
    "nation": "CREATE nation parquetColumnar FROM '{d}/nation.parquet';",
    "region": "CREATE region parquetColumnar FROM '{d}/region.parquet';",
    "events": "CREATE events parquetColumnar FROM '{d}/events.parquet';",
}


def plan(name: str, loads: str, script: str, out: str, sql: str | None, key: bool = False, digits: int = 6) -> None:
    PLANS[name] = Plan("\n".join(_LOADS[t] for t in loads.split()) + script, out, sql, key, digits)


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """Doubles to a few digits, since sums come in any order; the key column is called k."""
    own = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            c = F.round(c, digits) + F.lit(0.0)
        own.append(c.alias("k" if f.name == KEY else f.name))
    return df.select(*own)


def scratch(spark: SparkSession) -> str:
    """A folder of its own where tables are shared; it goes with the driver."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/plan-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    p = PLANS[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        script = p.script.replace("{d}", sf_dir)
        engine = Engine(spark).execute(script.replace("{t}", scratch(spark)) if "{t}" in script else script)
        return rounded(engine.frame(p.out, p.key).drop(GEO), p.digits)

    return query


# -- projection, filters, expressions
plan("scan_project", "lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue, l_quantity + 0.5 AS q FROM lineitem INTO o;", "o", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) + 0.0 AS revenue, l_quantity + 0.5 AS q FROM lineitem")
plan("filter_between_in", "lineitem", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem INTO o WHERE l_quantity BETWEEN 5 AND 20 AND l_returnflag IN ['A','R'] AND l_linenumber NOT IN [1,2];", "o", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 5 AND 20 AND l_returnflag IN ('A','R') AND l_linenumber NOT IN (1,2)")
plan("filter_like", "part", "SELECT p_partkey, p_name FROM part INTO o WHERE p_type LIKE '.*[AEIOU]L.*' OR p_brand MATCH '/brand#1[0-9]/i';", "o", "SELECT p_partkey, p_name FROM part WHERE regexp_full_match(p_type, '.*[AEIOU]L.*') OR regexp_full_match(p_brand, '(?i)brand#1[0-9]')")
plan("filter_unknown", "orders", "SELECT * FROM orders INTO o WHERE unknown IS NOT NULL;", "o", "SELECT * FROM orders WHERE 1 = 0")
plan("select_star", "region", "SELECT * FROM region INTO o;", "o", "SELECT * FROM region")
plan("select_literals", "nation", "SELECT n_name, 'at once' AS a, -17.25 AS b, 40960 AS c, NULL AS d, FALSE AS e FROM nation INTO o;", "o", "SELECT n_name, 'at once' AS a, -17.25::DOUBLE AS b, 40960::INTEGER AS c, NULL::VARCHAR AS d, FALSE AS e FROM nation")
plan("ternary_default", "events", "SELECT event_id, value > 50 ? 'high' : 'low' AS band, (user_id = 3 ? event_type) : 'none' AS t FROM events INTO o;", "o", "SELECT event_id, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS band, CASE WHEN user_id = 3 THEN event_type ELSE 'none' END AS t FROM events")
plan("null_logic", "events", "SELECT event_id, event_type, (event_type = 'click' ? value) AS v FROM events INTO a; SELECT event_id, v > 10 AND event_id > 5 AS a, v > 10 OR event_id > 5 AS b, v > 10 XOR event_id > 5 AS c, NOT v > 10 AS d, v = 3 AS e, v != 3 AS f, v == 3 AS g, v <> 3 AS h FROM a INTO o;", "o",
     "WITH a AS (SELECT event_id, CASE WHEN event_type = 'click' THEN value END AS v FROM events) SELECT event_id, CASE WHEN v IS NULL THEN NULL ELSE v > 10 AND event_id > 5 END AS a, coalesce(v > 10, FALSE) OR event_id > 5 AS b, coalesce(v > 10, FALSE) <> (event_id > 5) AS c, NOT v > 10 AS d, coalesce(v = 3, FALSE) AS e, coalesce(v <> 3, FALSE) AS f, v = 3 AS g, v <> 3 AS h FROM a")
plan("arithmetic", "lineitem", "SELECT l_orderkey, l_linenumber, l_orderkey / 7 AS a, l_orderkey % 7 AS b, l_linenumber ^ 2 AS c, l_orderkey & 12 AS d, l_orderkey | 5 AS e, l_orderkey # 9 AS f, l_orderkey << 2 AS g, l_orderkey >> 1 AS h, ~ l_orderkey AS i, l_linenumber * 3 - 1 AS j FROM lineitem INTO o;", "o",
     "SELECT l_orderkey, l_linenumber, round(l_orderkey / 7, 6) AS a, (l_orderkey % 7)::DOUBLE AS b, pow(l_linenumber, 2) AS c, l_orderkey & 12 AS d, l_orderkey | 5 AS e, xor(l_orderkey, 9::BIGINT) AS f, l_orderkey << 2 AS g, l_orderkey >> 1 AS h, ~l_orderkey AS i, l_linenumber * 3 - 1 AS j FROM lineitem")
plan("casts", "lineitem", "SELECT l_orderkey, l_linenumber, INT l_extendedprice AS a, LONG l_quantity AS b, DOUBLE l_linenumber AS c, STRING l_linenumber AS d, BOOL l_returnflag AS e, l_returnflag || '-' || l_linestatus AS f FROM lineitem INTO o;", "o",
     "SELECT l_orderkey, l_linenumber, trunc(l_extendedprice)::INTEGER AS a, trunc(l_quantity)::BIGINT AS b, l_linenumber::DOUBLE AS c, l_linenumber::VARCHAR AS d, lower(l_returnflag) = 'true' AS e, l_returnflag || '-' || l_linestatus AS f FROM lineitem")
plan("digests", "customer", "SELECT c_custkey, c_name DIGEST 'MD5' AS a, c_name DIGEST 'SHA-1' AS b, c_name HASH 'SHA-256' AS c FROM customer INTO o;", "o", "SELECT c_custkey, md5(c_name) AS a, sha1(c_name) AS b, sha256(c_name) AS c FROM customer")
plan("several_from_into", "nation region", "SELECT REC_KEY() IS NOT NULL AS keyed FROM nation INTO a FROM region INTO b; SELECT * FROM UNION a, b INTO o;", "o", "SELECT TRUE AS keyed FROM nation UNION ALL SELECT TRUE FROM region")

# -- keys, partitions, distinct, limits
plan("distinct_keyed", "events", "ALTER events KEY user_id; SELECT DISTINCT event_type FROM events INTO o;", "o", "SELECT DISTINCT user_id AS k, event_type FROM events", True)
plan("partition_select", "orders", "ALTER orders KEY o_orderkey PARTITION 5; SELECT o_orderkey, o_totalprice FROM orders PARTITION [1,3] INTO o;", "o", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 5 IN (1, 3)")
plan("limit_percent_all", "orders", "SELECT o_orderkey FROM orders INTO o LIMIT 100%;", "o", "SELECT o_orderkey FROM orders")
plan("rekey_expression", "orders", "ALTER orders KEY o_orderstatus || o_orderpriority; CALL countByKey() INPUT orders OUTPUT o;", "o", "SELECT o_orderstatus || o_orderpriority AS k, count(*) AS _count FROM orders GROUP BY 1", True)

# -- joins
_KEYED = "ALTER customer KEY c_custkey; ALTER orders KEY o_custkey; SELECT * FROM orders INTO big WHERE o_totalprice > 200000;"
plan("join_inner", "customer orders", _KEYED + 'SELECT "customer.c_name" AS c_name, "big.o_orderkey" AS o_orderkey FROM JOIN customer, big INTO o;', "o", "SELECT c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000")
plan("join_left", "customer orders", _KEYED + 'SELECT "customer.c_name" AS c_name, "big.o_orderkey" AS o_orderkey FROM LEFT JOIN customer, big INTO o;', "o", "SELECT c_name, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000")
plan("join_right", "customer orders", _KEYED + 'SELECT "customer.c_name" AS c_name, "big.o_orderkey" AS o_orderkey FROM RIGHT JOIN big, customer INTO o;', "o", "SELECT c_name, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000")
plan("join_outer", "customer orders", _KEYED + "SELECT * FROM customer INTO some WHERE c_acctbal > 5000; SELECT REC_KEY() AS id, \"some.c_name\" AS c_name, \"big.o_orderkey\" AS o_orderkey FROM OUTER JOIN some, big INTO o;", "o", "SELECT coalesce(c_custkey, o_custkey) AS id, c_name, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 5000) c FULL JOIN (SELECT * FROM orders WHERE o_totalprice > 200000) o ON c_custkey = o_custkey")
plan("join_left_anti", "customer orders", _KEYED + "SELECT c_custkey FROM LEFT ANTI JOIN customer, big INTO o;", "o", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
plan("join_right_anti", "customer orders", _KEYED + "SELECT c_custkey FROM RIGHT ANTI JOIN big, customer INTO o;", "o", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
plan("join_three", "nation customer supplier", "ALTER nation KEY n_nationkey; ALTER customer KEY c_nationkey; ALTER supplier KEY s_nationkey; SELECT \"nation.n_name\" AS n, \"customer.c_custkey\" AS c, \"supplier.s_suppkey\" AS s FROM JOIN nation, customer, supplier INTO o;", "o", "SELECT n_name AS n, c_custkey AS c, s_suppkey AS s FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN supplier ON n_nationkey = s_nationkey")
plan("join_whole_record", "nation", "SELECT n_name, n_regionkey FROM nation INTO a WHERE n_regionkey < 3; SELECT n_name, n_regionkey FROM nation INTO b WHERE n_regionkey > 0; SELECT * FROM LEFT ANTI JOIN a, b INTO o;", "o", "SELECT n_name, n_regionkey FROM nation WHERE n_regionkey < 1")
plan("subquery_in", "orders customer", "$rich = SELECT c_custkey FROM customer WHERE c_acctbal > 9000; SELECT o_orderkey FROM orders INTO o WHERE o_custkey IN $rich;", "o", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
plan("subquery_not_in", "events orders", "SELECT event_id, (event_type = 'click' ? user_id) AS u FROM events INTO e; $some = SELECT o_custkey FROM orders WHERE o_totalprice > 150000; SELECT event_id, u FROM e INTO o WHERE u NOT IN $some AND event_id > 10;", "o", "SELECT event_id, u FROM (SELECT event_id, CASE WHEN event_type = 'click' THEN user_id END AS u FROM events) WHERE (u IS NULL OR u NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)) AND event_id > 10")
plan("filter_integers", "orders", "SELECT o_orderkey, (o_orderkey & 63) * 4503599627370496 + 1 AS big FROM orders INTO a; SELECT o_orderkey FROM a INTO o WHERE big IN [9007199254740993, 18014398509481984] OR big = 13510798882111489 OR big = 13510798882111488;", "o", "SELECT o_orderkey FROM (SELECT o_orderkey, (o_orderkey & 63) * 4503599627370496 + 1 AS big FROM orders) WHERE big IN (9007199254740993, 18014398509481984, 13510798882111489, 13510798882111488)")

# -- unions
_SLICES = "SELECT o_custkey, o_orderstatus FROM orders INTO a WHERE o_totalprice < 150000; SELECT o_custkey, o_orderstatus FROM orders INTO b WHERE o_totalprice > 100000; SELECT o_custkey, o_orderstatus FROM orders INTO c WHERE o_orderstatus = 'F'; ALTER a KEY o_custkey; ALTER b KEY o_custkey; ALTER c KEY o_custkey;"
_SQL = "WITH a AS (SELECT o_custkey, o_orderstatus FROM orders WHERE o_totalprice < 150000), b AS (SELECT o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 100000), c AS (SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F') "
plan("union_cat", "orders", _SLICES + "SELECT * FROM UNION a, b, c INTO o;", "o", _SQL + "SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c")
plan("union_and", "orders", _SLICES + "SELECT * FROM UNION AND a, b, c INTO o;", "o", _SQL + "SELECT * FROM a INTERSECT ALL SELECT * FROM b INTERSECT ALL SELECT * FROM c")
plan("union_xor", "orders", _SLICES + "SELECT * FROM UNION XOR a, b, c INTO o;", "o", _SQL + ", t AS (SELECT *, 1 AS i FROM a UNION ALL SELECT *, 2 FROM b UNION ALL SELECT *, 3 FROM c), g AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM t GROUP BY ALL HAVING min(i) = max(i)) SELECT o_custkey, o_orderstatus FROM (SELECT o_custkey, o_orderstatus, unnest(range(n)) FROM g)")
plan("union_wildcard", "orders", "LOOP $s IN ['F','O','P'] BEGIN SELECT o_orderkey FROM orders INTO \"by_{$s}\" WHERE o_orderstatus = $s; END; SELECT * FROM UNION by_ * INTO o;", "o", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F','O','P')")

# -- operations
plan("count_by_key", "lineitem", "ALTER lineitem KEY l_suppkey; CALL countByKey() INPUT lineitem OUTPUT o;", "o", "SELECT l_suppkey AS k, count(*) AS _count FROM lineitem GROUP BY 1", True)
_MATH = {
    "sum": ("SUM", "-4.5", "-4.5 + sum(x)"), "subtract": ("SUBTRACT", "7", "7 - sum(x)"), "average": ("AVERAGE", "3", "(3 + sum(x)) / count(x)"), "powermean": ("POWERMEAN", "3", "pow(sum(pow(x, 3)) / count(x), 1 / 3.0)"), "rms": ("RMS", None, "sqrt(sum(x * x) / count(x))"), "min": ("MIN", "3", "greatest(min(x), 3)"), "max": ("MAX", "40", "least(max(x), 40)"),
    "equality": ("EQUALITY", None, "CASE WHEN min(x) = max(x) THEN 1.0::DOUBLE ELSE 0.0 END"), "median": ("MEDIAN", None, "quantile_cont(x, 0.5)"), "quantile": ("QUANTILE", "0.25", "CASE WHEN count(x) % 2 = 0 THEN (list_sort(list(x))[floor(count(x) * 0.25)::INT + 1] + list_sort(list(x))[greatest(floor(count(x) * 0.25)::INT, 1)]) / 2 ELSE list_sort(list(x))[floor(count(x) * 0.25)::INT + 1] END"),
}
for _name, (_f, _c, _sql) in _MATH.items():
    plan(f"keyed_{_name}", "lineitem", f"ALTER lineitem KEY l_partkey; CALL keyedMath(@calc_results=[r], @source_attr_r=l_quantity, @calc_function_r={_f}" + (f", @calc_const_r={_c}" if _c else "") + ") INPUT lineitem OUTPUT o;", "o", f"SELECT l_partkey AS k, round(({_sql})::DOUBLE, 6) + 0.0 AS r FROM (SELECT l_partkey, l_quantity AS x FROM lineitem) GROUP BY 1", True)
for _name, _f, _sql in (("mul", "MUL", "2 * product(x)"), ("div", "DIV", "2 / product(x)")):
    plan(f"keyed_{_name}", "lineitem", f"SELECT l_orderkey, 1 + l_discount AS x FROM lineitem INTO a; ALTER a KEY l_orderkey; CALL keyedMath(@calc_results=[r], @source_attr_r=x, @calc_function_r={_f}, @calc_const_r=2) INPUT a OUTPUT o;", "o", f"SELECT l_orderkey AS k, round({_sql}, 6) + 0.0 AS r FROM (SELECT l_orderkey, 1 + l_discount AS x FROM lineitem) GROUP BY 1", True)
plan("series_normalize", "part", "CALL seriesMath(@calc_attr=p_retailprice, @calc_function=NORMALIZE) INPUT part OUTPUT a; SELECT p_partkey, _result FROM a INTO o;", "o", "SELECT p_partkey, round(100 - (max(p_retailprice) OVER () - p_retailprice) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()) * 100, 6) + 0.0 AS _result FROM part")
plan("series_stddev", "part", "CALL seriesMath(@calc_attr=p_retailprice, @calc_function=STDDEV) INPUT part OUTPUT a; SELECT p_partkey, _result FROM a INTO o;", "o", "SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER (), 6) + 0.0 AS _result FROM part")
plan("count_uniques", "events", "ALTER events KEY user_id; CALL countUniques(@count_attrs=[event_type,value]) INPUT events OUTPUT o;", "o", "SELECT user_id AS k, count(DISTINCT event_type) + max((event_type IS NULL)::BIGINT) AS event_type, count(DISTINCT value) + max((value IS NULL)::BIGINT) AS value FROM events GROUP BY 1", True)
plan("percent_rank", "orders", "CALL percentRankInc(@value_attr=o_totalprice) INPUT orders OUTPUT o;", "o", "SELECT o_totalprice AS _value, round(percent_rank() OVER (ORDER BY o_totalprice), 6) + 0.0 AS _rank FROM orders")
plan("percent_rank_keyed", "orders", "ALTER orders KEY o_orderpriority; CALL percentRankInc(@value_attr=o_totalprice, @per_key=true) INPUT orders OUTPUT o;", "o", "SELECT o_orderpriority AS k, o_totalprice AS _value, round(percent_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice), 6) + 0.0 AS _rank FROM orders", True)
plan("frequency", "events", "CALL frequency(@frequency_attr=event_type, @reference_attr=user_id) INPUT events OUTPUT o;", "o", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT event_type, n / sum(n) OVER (PARTITION BY user_id) AS s FROM c) SELECT event_type AS k, round(median(s), 6) + 0.0 AS _frequency FROM s GROUP BY 1", True)
_TARGET = "SELECT * FROM events INTO t WHERE value > 20;"
plan("dwell_time", "events", _TARGET + "CALL dwellTime(@signals_userid_attr=user_id, @target_userid_attr=user_id, @target_grouping_attr=event_type) INPUT signals FROM events, target FROM t OUTPUT o;", "o", "WITH s AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), t AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE value > 20 GROUP BY ALL) SELECT event_type AS k, round(avg(t.n / s.n), 6) + 0.0 AS _dwelltime FROM t JOIN s USING (user_id) GROUP BY 1", True)
plan("reach", "events", _TARGET + "CALL reach(@signals_userid_attr=user_id, @target_userid_attr=user_id, @target_grouping_attr=event_type) INPUT signals events, target t OUTPUT o;", "o", "SELECT event_type AS k, round(count(DISTINCT user_id) / (SELECT count(DISTINCT user_id) FROM events), 6) + 0.0 AS _reach FROM events WHERE value > 20 GROUP BY 1", True)
plan("parametric_score", "events", "SELECT user_id, event_type, user_id % 7 AS grp FROM events INTO e; SELECT user_id, user_id % 5 + 1 AS m FROM events INTO f; ALTER f KEY user_id; SELECT DISTINCT user_id, m FROM f INTO mult; SELECT STRING user_id AS user_id, event_type, STRING grp AS grp FROM e INTO v; CALL parametricScore(@top_scores=2, @grouping_attr=grp, @value_attr=event_type, @count_attr=user_id, @multiplier_attr=m) INPUT values v, multipliers mult OUTPUT o;", "o",
     "WITH s AS (SELECT (user_id % 7)::DOUBLE AS g, event_type AS v, sum((user_id % 5 + 1)::DOUBLE) AS s FROM events GROUP BY ALL), d AS (SELECT g, s, min(v) AS v FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY s DESC) AS r FROM d) SELECT g::VARCHAR AS k, max(CASE WHEN r = 1 THEN v END) AS _value_1, max(CASE WHEN r = 1 THEN s END) AS _score_1, max(CASE WHEN r = 2 THEN v END) AS _value_2, max(CASE WHEN r = 2 THEN s END) AS _score_2 FROM r WHERE r <= 2 GROUP BY 1", True)
plan("analyze", "lineitem orders", "ANALYZE lineitem KEY l_orderkey; ANALYZE orders KEY o_custkey; SELECT _name, _type, _counter, _total, _unique, _average, _median FROM _metrics INTO o;", "o", "WITH a AS (SELECT 'lineitem' AS _name, 'l_orderkey' AS _counter, count(*) AS n FROM lineitem GROUP BY l_orderkey UNION ALL SELECT 'orders', 'o_custkey', count(*) FROM orders GROUP BY o_custkey) SELECT _name, 'columnar' AS _type, _counter, sum(n)::BIGINT AS _total, count(*) AS _unique, round(avg(n), 6) AS _average, median(n) AS _median FROM a GROUP BY ALL")
plan("analyze_partitions", "orders", "ALTER orders KEY o_custkey PARTITION 4; ANALYZE orders KEY o_custkey PARTITION; SELECT _part_no, _total, _unique FROM _metrics_orders INTO o;", "o", "SELECT (o_custkey % 4)::INTEGER AS _part_no, count(*) AS _total, count(DISTINCT o_custkey) AS _unique FROM orders GROUP BY 1")

# -- functions
plan("functions_string", "part", "SELECT p_partkey, STR_REPLACE(p_name, '[aeiou]', '_') AS a, STR_SLICE(p_name, 1, 4) AS b, STR_LENGTH(p_name) AS c, STR_LOWER(p_type) AS d, STR_UPPER(p_name) AS e, STR_STARTS(p_type, 'S') AS f, STR_ENDS(p_brand, '1') AS g, STR_CONTAINS(p_name, 'a') AS h, STR_FORMAT('%s-%d', p_brand, p_size) AS i, STR_BASE64(p_name) AS j, STR_DECODE64(STR_BASE64(p_name)) AS l, ARR_LENGTH(STR_SPLIT(p_name, ' ', 0)) AS m FROM part INTO o;", "o",
     "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '_', 'g') AS a, substr(p_name, 2, 3) AS b, length(p_name)::INTEGER AS c, lower(p_type) AS d, upper(p_name) AS e, starts_with(p_type, 'S') AS f, ends_with(p_brand, '1') AS g, contains(p_name, 'a') AS h, p_brand || '-' || p_size AS i, base64(p_name::BLOB) AS j, p_name AS l, len(string_split(p_name, ' '))::INTEGER AS m FROM part")
plan("functions_array", "part", "SELECT p_partkey, ARR_JOIN(ARR_MAKE(p_brand, p_type), '/') AS a, ARR_ITEM(ARR_MAKE(p_size, 7), 1) AS b, ARR_LENGTH(ARR_RANGE(1, p_size)) AS c, ARR_EMPTY(ARR_MAKE()) AS d, ARR_CONTAINS(ARR_MAKE(p_size, 3), 3) AS e, ARR_MEDIAN(ARR_MAKE(p_size, 4, 10)) AS f, ARR_MEAN(ARR_MAKE(p_size, 2)) AS g, ARR_JOIN(ARR_SLICE(ARR_RANGE(1, 9), 2, 4), ',') AS h, ARR_JOIN(ARR_ADD(ARR_MAKE(p_size), 5), ',') AS i, ARR_JOIN(ARR_INSERT(ARR_MAKE(p_size, 1), 1, 9), ',') AS j, ARR_JOIN(ARR_FILL(3, p_size), '') AS l FROM part INTO o;", "o",
     "SELECT p_partkey, p_brand || '/' || p_type AS a, 7 AS b, p_size AS c, TRUE AS d, TRUE AS e, list_sort([p_size, 4, 10])[2]::DOUBLE AS f, (p_size + 2) / 2 AS g, '3,4' AS h, p_size || ',5' AS i, p_size || ',9,1' AS j, p_size::VARCHAR || p_size || p_size AS l FROM part")
plan("functions_math", "lineitem", "SELECT l_orderkey, l_linenumber, CEIL(l_extendedprice) AS a, FLOOR(l_extendedprice) AS b, ROUND(l_extendedprice) AS c, LOG(2, l_quantity) AS d, LN(l_quantity) AS e, LG(l_quantity) AS f, SIN(l_quantity) AS g, COS(l_quantity) AS h, TAN(l_discount) AS i, SINH(l_discount) AS j, COSH(l_discount) AS l, TANH(l_discount) AS m, ASIN(l_discount) AS n, ACOS(l_discount) AS p, ATAN(l_quantity) AS q, ATAN2(l_quantity, l_linenumber) AS r, RAD(l_quantity) AS s, DEG(l_discount) AS t, SIGN(l_discount) AS u, ABS(0 - l_quantity) AS v, MAX(l_quantity, l_linenumber) AS w, MIN(l_quantity, l_linenumber) AS x, MEDIAN(l_quantity, l_linenumber, 5) AS y, MEAN(l_quantity, l_linenumber) AS z, PI() AS aa, E() AS bb FROM lineitem INTO o;", "o",
     "SELECT l_orderkey, l_linenumber, ceil(l_extendedprice) AS a, floor(l_extendedprice) AS b, floor(l_extendedprice + 0.5)::BIGINT AS c, round(ln(l_quantity) / ln(2), 6) AS d, round(ln(l_quantity), 6) AS e, round(log10(l_quantity), 6) AS f, round(sin(l_quantity), 6) AS g, round(cos(l_quantity), 6) AS h, round(tan(l_discount), 6) AS i, round(sinh(l_discount), 6) AS j, round(cosh(l_discount), 6) AS l, round(tanh(l_discount), 6) AS m, round(asin(l_discount), 6) AS n, round(acos(l_discount), 6) AS p, round(atan(l_quantity), 6) AS q, round(atan2(l_quantity, l_linenumber), 6) AS r, round(radians(l_quantity), 6) AS s, round(degrees(l_discount), 6) AS t, sign(l_discount)::DOUBLE AS u, abs(l_quantity) AS v, greatest(l_quantity, l_linenumber)::DOUBLE AS w, least(l_quantity, l_linenumber)::DOUBLE AS x, list_sort([l_quantity, l_linenumber, 5])[2]::DOUBLE AS y, round((l_quantity + l_linenumber) / 2, 6) AS z, round(pi(), 6) AS aa, 2.718282::DOUBLE AS bb FROM lineitem")
plan("functions_date", "events", "SELECT event_id, DT_YEAR('UTC', ts) AS a, DT_MONTH('UTC', ts) AS b, DT_DAY('UTC', ts) AS c, DT_HOUR('UTC', ts) AS d, DT_MINUTE('UTC', ts) AS e, DT_SECOND('UTC', ts) AS f, DT_DOW('UTC', ts) AS g, DT_EPOCH(ts) AS h, DT_FORMAT('UTC', 'yyyy-MM-dd HH:mm', ts) AS i, DT_BEFORE(ts, '2024-01-10T00:00:00Z') AS j, DT_AFTER(ts, '2024-01-10T00:00:00Z') AS l, DT_PARSE('UTC', 'yyyy-MM-dd HH:mm', DT_FORMAT('UTC', 'yyyy-MM-dd HH:mm', ts)) AS m, DT_HOUR('Asia/Tokyo', ts) AS n FROM events INTO o;", "o",
     "SELECT event_id, year(ts)::INTEGER AS a, month(ts)::INTEGER AS b, day(ts)::INTEGER AS c, hour(ts)::INTEGER AS d, minute(ts)::INTEGER AS e, second(ts)::INTEGER AS f, isodow(ts)::INTEGER AS g, floor(epoch(ts))::BIGINT AS h, strftime(ts, '%Y-%m-%d %H:%M') AS i, ts < TIMESTAMP '2024-01-10' AS j, ts > TIMESTAMP '2024-01-10' AS l, epoch(date_trunc('minute', ts))::BIGINT AS m, ((hour(ts) + 9) % 24)::INTEGER AS n FROM events")
plan("functions_record", "nation", "ALTER nation KEY n_nationkey; SELECT REC_KEY() AS a, REC_ATTR('n_name') AS b, ARR_LENGTH(REC_ATTRS()) AS c, ARR_JOIN(REC_PIVOT(), '|') AS d, ATTR(REC_OBJECT(), 'n_name') AS e, STRUCT_ATTR(STRUCT_FROM_ARRAY(ARR_MAKE('x', n_name), TRUE), n_name) AS f, ATTR(ATTR_PUT(REC_OBJECT(), 'n_name', 'new'), 'n_name') AS g, ATTR(COLUMNAR_MAKE(ARR_MAKE('p', 'q'), ARR_MAKE(n_name, 'z')), 'q') AS h, ARR_LENGTH(ATTRS(ATTR_REMOVE(REC_OBJECT(), 'n_name'))) AS i FROM nation INTO o;", "o",
     "SELECT n_nationkey AS a, n_name AS b, 3 AS c, n_nationkey || '|' || n_name || '|' || n_regionkey AS d, n_name AS e, '1' AS f, 'new' AS g, 'z' AS h, 2 AS i FROM nation")
plan("hashcodes", "nation", "SELECT n_name, HASHCODE n_name AS a, HASHCODE n_nationkey AS b FROM nation INTO o;", "o", "SELECT n_name, ((list_reduce(list_prepend(0::BIGINT, list_transform(string_split(n_name, ''), lambda c: ord(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) + 2147483648) % 4294967296 - 2147483648)::INTEGER AS a, n_nationkey AS b FROM nation")

# -- transforms
plan("json_paths", "events", "SELECT STRING event_id || '' AS id, props FROM events INTO a; ALTER a KEY id; ALTER a columnarToStructured(@template='\\{\"id\": \"$id$\", \"p\": $props$\\}') VALUE (id, props); ALTER a structuredToColumnar(@column_id='id', @column_p='p') VALUE (id, p); SELECT id, p FROM a INTO n; ALTER a columnarToStructured(@template='\\{\"deep\": [0, \\{\"k\": $p$\\}], \"id\": \"$id$\"\\}'); SELECT id, \"deep[1].k.k\" AS k FROM a INTO o;", "o", "SELECT event_id::VARCHAR AS id, (props::JSON ->> '$.k') AS k FROM events")
plan("text_columnar_round", "nation", "ALTER nation columnarToText(@delimiter=',') VALUE (n_nationkey, n_name); ALTER nation textToColumnar(@delimiter=',') VALUE (id, name); SELECT id, name FROM nation INTO o;", "o", "SELECT n_nationkey::VARCHAR AS id, n_name AS name FROM nation")
plan("structured_select", "nation", "ALTER nation columnarToStructured(@template='\\{\"a\": \\{\"b\": [\"$n_name$\", $n_regionkey$]\\}\\}'); SELECT \"a.b[0]\" AS name, \"a.b[1]\" AS region FROM nation INTO o WHERE \"a.b[1]\" > 1;", "o", "SELECT n_name AS name, n_regionkey::VARCHAR AS region FROM nation WHERE n_regionkey > 1")
plan("structured_json", "nation", "ALTER nation columnarToStructured(@template='\\{\"n\":\"$n_name$\"\\}'); ALTER nation structuredToJson; SELECT value FROM nation INTO o;", "o", "SELECT '{\"n\":\"' || n_name || '\"}' AS value FROM nation")
plan("points", "customer", "SELECT c_custkey, c_custkey % 90 AS lat, c_custkey % 180 AS lon FROM customer INTO a; ALTER a columnarToPoint(@lat_column=lat, @lon_column=lon, @radius_default=300) POINT (c_custkey); ALTER a pointToColumnar; SELECT c_custkey, _center_lat, _center_lon, _radius FROM a INTO o;", "o", "SELECT c_custkey, (c_custkey % 90)::DOUBLE AS _center_lat, (c_custkey % 180)::DOUBLE AS _center_lon, 300.0::DOUBLE AS _radius FROM customer")
plan("tracks", "events", "SELECT event_id, user_id, DT_EPOCH(ts) AS t, event_type, user_id % 60 AS lat, value % 100 AS lon FROM events INTO a; ALTER a columnarToTrack(@lat_column=lat, @lon_column=lon, @ts_column=t, @userid_column=user_id) POINT (event_id); SELECT TRK_POINTS(REC_OBJECT()) AS n, TRK_SEGMENTS(REC_OBJECT()) AS segments, _userid FROM a INTO o;", "o", "SELECT count(*)::INTEGER AS n, 1 AS segments, user_id::VARCHAR AS _userid FROM events GROUP BY user_id")
_TRACKS = "SELECT event_id, user_id, LONG DT_EPOCH(ts) AS t, event_type, user_id % 60 AS lat, event_id % 50 AS lon FROM events INTO a; ALTER a columnarToTrack(@lat_column=lat, @lon_column=lon, @ts_column=t, @userid_column=user_id, @trackid_column=event_type) POINT (event_id, event_type);"
_RUNS = "WITH e AS (SELECT *, epoch(date_trunc('second', ts))::BIGINT AS t, user_id % 60 AS lat, event_id % 50 AS lon FROM events), n AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY t) THEN 0 ELSE 1 END AS new FROM e) "
plan("track_points", "events", _TRACKS + "ALTER a trackToPoint POINT (_userid, _trackid, event_id, _ts); SELECT _userid, _trackid, event_id, _ts, POINT_LAT(REC_OBJECT()) AS lat, POINT_LON(REC_OBJECT()) AS lon FROM a INTO o;", "o", _RUNS + "SELECT user_id::VARCHAR AS _userid, event_type AS _trackid, event_id::VARCHAR AS event_id, t::VARCHAR AS _ts, lat::DOUBLE AS lat, lon::DOUBLE AS lon FROM e")
plan("track_segments", "events", _TRACKS + "SELECT _userid, TRK_SEGMENTS(REC_OBJECT()) AS segments, TRK_POINTS(REC_OBJECT()) AS points FROM a INTO o;", "o", _RUNS + "SELECT user_id::VARCHAR AS _userid, sum(new)::INTEGER AS segments, count(*)::INTEGER AS points FROM n GROUP BY 1")
plan("track_filters", "events", _TRACKS + "SELECT * FROM a INTO b WHERE POINT event_type = 'click'; SELECT * FROM b INTO c WHERE SEGMENT _trackid = 'click'; SELECT * FROM c INTO d WHERE TRACK _userid != '3'; SELECT _userid, TRK_SEGMENTS(REC_OBJECT()) AS segments, TRK_POINTS(REC_OBJECT()) AS points FROM d INTO o;", "o", _RUNS + "SELECT user_id::VARCHAR AS _userid, sum(new)::INTEGER AS segments, count(*)::INTEGER AS points FROM n WHERE event_type = 'click' AND user_id <> 3 GROUP BY 1")
plan("track_stats", "events", _TRACKS + "CALL trackStats(@pinning_mode=TRACK_STARTS) INPUT tracks FROM a OUTPUT b; SELECT _userid, _points, _duration FROM b INTO o;", "o", _RUNS + ", d AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t) AS part FROM n), g AS (SELECT user_id, part, count(*) AS c, max(t) - min(t) AS w FROM d GROUP BY ALL) SELECT user_id::VARCHAR AS _userid, sum(c)::DOUBLE AS _points, sum(w)::DOUBLE AS _duration FROM g GROUP BY 1")
plan("track_centroids", "events", _TRACKS + "CALL spatialCentroid(@tracks_mode=TRACKS) INPUT a OUTPUT b; SELECT _userid, POINT_LAT(REC_OBJECT()) AS lat, POINT_LON(REC_OBJECT()) AS lon FROM b INTO o;", "o", _RUNS + "SELECT user_id::VARCHAR AS _userid, avg(lat)::DOUBLE AS lat, round(avg(lon), 6) + 0.0 AS lon FROM e GROUP BY 1")
plan("track_gpx", "events", _TRACKS + "ALTER a trackToGpx(@ts_attr='_ts'); ALTER a gpxToTrack; ALTER a trackToPoint POINT (_userid, _ts); SELECT _userid, _ts, POINT_LAT(REC_OBJECT()) AS lat, POINT_LON(REC_OBJECT()) AS lon FROM a INTO o;", "o", _RUNS + "SELECT user_id::VARCHAR AS _userid, t::VARCHAR AS _ts, lat::DOUBLE AS lat, lon::DOUBLE AS lon FROM e")
_GRID = "SELECT c_custkey, c_custkey % 80 AS lat, (c_custkey * 7) % 170 AS lon FROM customer INTO a; ALTER a columnarToPoint(@lat_column=lat, @lon_column=lon) POINT (c_custkey);"
plan("area_covers", "customer supplier", _GRID + "SELECT STR_FORMAT('\\{\"type\":\"Feature\",\"properties\":\\{\"id\":\"%s\"\\},\"geometry\":\\{\"type\":\"Polygon\",\"coordinates\":[[[%s,%s],[%s,%s],[%s,%s],[%s,%s],[%s,%s]]]\\}\\}', s_suppkey, s_suppkey % 9 * 15 + 0.5, s_suppkey % 7 * 10 + 0.5, s_suppkey % 9 * 15 + 12.5, s_suppkey % 7 * 10 + 0.5, s_suppkey % 9 * 15 + 12.5, s_suppkey % 7 * 10 + 9.5, s_suppkey % 9 * 15 + 0.5, s_suppkey % 7 * 10 + 9.5, s_suppkey % 9 * 15 + 0.5, s_suppkey % 7 * 10 + 0.5) AS j FROM supplier INTO b; ALTER b columnarToStructured(@template='$j$'); ALTER b structuredToJson; ALTER b geoJsonToPolygon POLYGON (id); CALL areaCovers() INPUT points FROM a, polygons FROM b OUTPUT target INTO hit; ALTER hit pointToColumnar VALUE (c_custkey, id); SELECT c_custkey, id FROM hit INTO o;", "o",
     "SELECT c_custkey, s_suppkey::VARCHAR AS id FROM customer, supplier WHERE (c_custkey * 7) % 170 BETWEEN s_suppkey % 9 * 15 + 0.5 AND s_suppkey % 9 * 15 + 12.5 AND c_custkey % 80 BETWEEN s_suppkey % 7 * 10 + 0.5 AND s_suppkey % 7 * 10 + 9.5")
_BOXES = "SELECT STR_FORMAT('\\{\"type\":\"Feature\",\"properties\":\\{\"id\":\"%s\"\\},\"geometry\":\\{\"type\":\"Polygon\",\"coordinates\":[[[%s,%s],[%s,%s],[%s,%s],[%s,%s],[%s,%s]]]\\}\\}', s_suppkey, s_suppkey % 9 * 15 + 0.5, s_suppkey % 7 * 10 + 0.5, s_suppkey % 9 * 15 + 12.5, s_suppkey % 7 * 10 + 0.5, s_suppkey % 9 * 15 + 12.5, s_suppkey % 7 * 10 + 9.5, s_suppkey % 9 * 15 + 0.5, s_suppkey % 7 * 10 + 9.5, s_suppkey % 9 * 15 + 0.5, s_suppkey % 7 * 10 + 0.5) AS j FROM supplier INTO b; ALTER b columnarToStructured(@template='$j$'); ALTER b structuredToJson; ALTER b geoJsonToPolygon POLYGON (id);"
_REPEATED = "SELECT c_custkey % 8 * 10 AS lat, c_custkey % 17 * 10 AS lon FROM customer INTO a; ALTER a columnarToPoint(@lat_column=lat, @lon_column=lon) POINT (lat, lon);"
_IN_BOX = "lon BETWEEN s_suppkey % 9 * 15 + 0.5 AND s_suppkey % 9 * 15 + 12.5 AND lat BETWEEN s_suppkey % 7 * 10 + 0.5 AND s_suppkey % 7 * 10 + 9.5"
plan("area_covers_once", "customer supplier", _REPEATED.replace("* 10 AS lat", "* 10 + 5 AS lat") + _BOXES + "CALL areaCovers(@encounter_mode=ONCE) INPUT points FROM a, polygons FROM b OUTPUT target INTO hit, evicted INTO miss; SELECT lat, lon, 'in' AS side FROM hit INTO h; SELECT lat, lon, 'out' AS side FROM miss INTO m; ALTER h pointToColumnar VALUE (lat, lon, side); ALTER m pointToColumnar VALUE (lat, lon, side); SELECT lat, lon, side FROM UNION h, m INTO o;", "o",
     f"SELECT lat, lon, CASE WHEN EXISTS (SELECT 1 FROM supplier WHERE {_IN_BOX}) THEN 'in' ELSE 'out' END AS side FROM (SELECT (c_custkey % 8 * 10 + 5)::DOUBLE AS lat, (c_custkey % 17 * 10)::DOUBLE AS lon FROM customer)")


def geodesic_sql(lat1: str, lon1: str, lat2: str, lon2: str, source: str, keep: str, rounds: int = 8) -> str:
    """Rows of `source` with the length d of the geodesic between two points of WGS 84, by Vincenty's inverse formula."""
    f, b = "(1 / 298.257223563)", "(6378137.0 * (1 - 1 / 298.257223563))"
    q = f"SELECT {keep}, atan((1 - {f}) * tan(radians({lat1}))) AS u1, atan((1 - {f}) * tan(radians({lat2}))) AS u2, radians({lon2} - {lon1}) AS l, radians({lon2} - {lon1}) AS x FROM {source}"
    for last in [False] * rounds + [True]:
        q = f"SELECT {keep}, u1, u2, l, x, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(x) AS cs, sqrt(pow(cos(u2) * sin(x), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(x), 2)) AS ss FROM ({q})"
        q = f"SELECT *, atan2(ss, cs) AS s, CASE WHEN ss = 0 THEN 0 ELSE cos(u1) * cos(u2) * sin(x) / ss END AS sa FROM ({q})"
        q = f"SELECT *, CASE WHEN abs(1 - sa * sa) < 1e-15 THEN 0 ELSE cs - 2 * sin(u1) * sin(u2) / (1 - sa * sa) END AS cm, {f} / 16 * (1 - sa * sa) * (4 + {f} * (4 - 3 * (1 - sa * sa))) AS c FROM ({q})"
        if not last:
            q = f"SELECT {keep}, u1, u2, l, l + (1 - c) * {f} * sa * (s + c * ss * (cm + c * cs * (2 * cm * cm - 1))) AS x FROM ({q})"
    q = f"SELECT *, (1 - sa * sa) * (pow(6378137.0, 2) - pow({b}, 2)) / pow({b}, 2) AS w FROM ({q})"
    q = f"SELECT *, 1 + w / 16384 * (4096 + w * (w * (320 - 175 * w) - 768)) AS ka, w / 1024 * (256 + w * (w * (74 - 47 * w) - 128)) AS kb FROM ({q})"
    return f"SELECT {keep}, {b} * ka * (s - kb * ss * (cm + kb / 4 * (cs * (2 * cm * cm - 1) - kb / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))) AS d FROM ({q})"


_POIS = "SELECT s_suppkey, s_suppkey % 80 AS lat, (s_suppkey * 13) % 170 AS lon FROM supplier INTO b; ALTER b columnarToPoint(@lat_column=lat, @lon_column=lon, @radius_default=400000) POINT (s_suppkey);"
_PAIRS = geodesic_sql("c_custkey % 80", "(c_custkey * 7) % 170", "s_suppkey % 80", "(s_suppkey * 13) % 170", "customer, supplier", "c_custkey, s_suppkey")
plan("proximity", "customer supplier", _GRID + _POIS + "CALL proximity() INPUT points FROM a, pois FROM b OUTPUT target INTO hit, evicted INTO miss; ALTER hit pointToColumnar VALUE (c_custkey, s_suppkey, _distance); SELECT c_custkey, s_suppkey, _distance FROM hit INTO o;", "o", f"SELECT c_custkey, s_suppkey, round(d, 1) + 0.0 AS _distance FROM ({_PAIRS}) WHERE d <= 400000", digits=1)
plan("proximity_evicted", "customer supplier", _GRID + _POIS + "CALL proximity(@encounter_mode=ONCE) INPUT points FROM a, pois FROM b OUTPUT target INTO hit, evicted INTO miss; ALTER miss pointToColumnar VALUE (c_custkey); SELECT c_custkey FROM miss INTO o;", "o", f"SELECT c_custkey FROM ({_PAIRS}) GROUP BY 1 HAVING min(d) > 400000")
plan("proximity_all", "customer supplier", _REPEATED + "SELECT DISTINCT s_suppkey % 3 AS n, s_suppkey % 3 * 5 + 20 AS lat, s_suppkey % 2 * 30 + 40 AS lon FROM supplier INTO b; ALTER b columnarToPoint(@lat_column=lat, @lon_column=lon, @radius_default=4500000) POINT (n); CALL proximity(@encounter_mode=ALL) INPUT points FROM a, pois FROM b OUTPUT target INTO hit; ALTER hit pointToColumnar VALUE (lat, lon); SELECT lat, lon FROM hit INTO o;", "o",
     "SELECT lat, lon FROM (" + geodesic_sql("lat", "lon", "slat", "slon", "(SELECT c_custkey, (c_custkey % 8 * 10)::DOUBLE AS lat, (c_custkey % 17 * 10)::DOUBLE AS lon FROM customer), (SELECT DISTINCT s_suppkey % 3 * 5 + 20 AS slat, s_suppkey % 2 * 30 + 40 AS slon FROM supplier)", "c_custkey, lat, lon") + ") GROUP BY c_custkey, lat, lon HAVING max(d) <= 4500000")
plan("points_geojson", "customer", _GRID + "ALTER a pointToGeoJson POINT (c_custkey); ALTER a geoJsonToPoint POINT (c_custkey); SELECT c_custkey, POINT_LAT(REC_OBJECT()) AS lat, POINT_LON(REC_OBJECT()) AS lon FROM a INTO o;", "o", "SELECT c_custkey::VARCHAR AS c_custkey, (c_custkey % 80)::DOUBLE AS lat, ((c_custkey * 7) % 170)::DOUBLE AS lon FROM customer")
plan("polygons_geojson", "supplier", _BOXES + "ALTER b polygonToGeoJson POLYGON (id); ALTER b geoJsonToPolygon POLYGON (id); SELECT id, POLY_VERTICES(REC_OBJECT()) AS v, POLY_HOLES(REC_OBJECT()) AS h FROM b INTO c; SELECT id, v, h FROM c INTO o;", "o", "SELECT s_suppkey::VARCHAR AS id, 4 AS v, 0 AS h FROM supplier")
plan("point_functions", "customer", "SELECT c_custkey, POINT_LAT(POINT_MAKE(c_custkey % 80, 3)) AS a, POINT_LON(POI_MAKE(1, c_custkey % 170, 7)) AS b, POI_RADIUS(POI_MAKE(1, 2, c_custkey)) AS c, POINT_LON(POINT_FROM_JSON(STR_FORMAT('\\{\"type\":\"Point\",\"coordinates\":[%s,2]\\}', c_custkey % 90))) AS d, GEO_DISTANCE(POINT_MAKE(c_custkey % 80, 10), POINT_MAKE(20, c_custkey % 50)) AS e FROM customer INTO o;", "o",
     "SELECT c_custkey, (c_custkey % 80)::DOUBLE AS a, (c_custkey % 170)::DOUBLE AS b, c_custkey::DOUBLE AS c, (c_custkey % 90)::DOUBLE AS d, round(d, 1) + 0.0 AS e FROM (" + geodesic_sql("c_custkey % 80", "10", "20", "c_custkey % 50", "customer", "c_custkey") + ")", digits=1)
plan("h3_functions", "customer", "SELECT c_custkey, H3(7, c_custkey % 80, (c_custkey * 7) % 170) AS a, GEO_H3(POINT_MAKE(c_custkey % 80, (c_custkey * 7) % 170), 5) AS b FROM customer INTO o;", "o", None)
plan("h3_coverage", "supplier", _BOXES + "ALTER b h3UniformCoverage(@hash_level=3) VALUE (id, _hash); SELECT id, _hash FROM b INTO o;", "o", None)

# -- sinks and sources
plan("sink_text", "orders", "COPY orders hadoopText(@delimiter=';', @codec='GZ') VALUE (o_orderkey, o_orderpriority) INTO '{t}'; CREATE back textColumnar(@delimiter=';') VALUE (id, priority) FROM '{t}/orders'; SELECT id, priority FROM back INTO o;", "o", "SELECT o_orderkey::VARCHAR AS id, o_orderpriority AS priority FROM orders")
plan("source_lines", "nation", "COPY nation hadoopText(@delimiter=',') VALUE (n_nationkey, n_name) INTO '{t}'; CREATE back hadoopText FROM '{t}/nation'; SELECT value FROM back INTO o;", "o", "SELECT n_nationkey || ',' || n_name AS value FROM nation")
plan("sink_parquet", "orders", "COPY orders columnarParquet(@codec='SNAPPY') VALUE (o_orderkey, o_totalprice) INTO '{t}'; CREATE back parquetColumnar FROM '{t}/orders'; SELECT o_orderkey, o_totalprice FROM back INTO o WHERE o_totalprice > 1000;", "o", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000")
plan("source_structured", "region", "CREATE deep parquetStructured FROM '{d}/orders.parquet'; SELECT o_orderkey, o_orderstatus FROM deep INTO o WHERE o_orderstatus = 'F' AND o_orderkey > 9;", "o", "SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_orderkey > 9")
plan("s3_round", "nation", "COPY nation s3directText(@delimiter=',') VALUE (n_nationkey, n_name) INTO '{t}/a'; COPY nation s3directParquet VALUE (n_nationkey, n_name) INTO '{t}/b'; CREATE a s3directColumnar(@delimiter=',', @schema_from_file=FALSE) VALUE (id, name) FROM '{t}/a/nation'; CREATE b s3directText FROM '{t}/a/nation'; CREATE c parquetColumnar FROM '{t}/b/nation'; SELECT id || name AS v FROM a INTO x; SELECT STR_REPLACE(value, ',', '') AS v FROM b INTO y; SELECT n_nationkey || n_name AS v FROM c INTO z; SELECT v FROM UNION x, y, z INTO o;", "o", "SELECT n_nationkey || n_name AS v FROM nation, range(3)")
plan("options_drop_raise", "orders", "OPTIONS @exact_limit=TRUE, @loop_iteration_limit=100; CREATE FUNCTION f(@x) AS $x; DROP FUNCTION f; CREATE FUNCTION f(@x) AS $x + 1; RAISE INFO 'on'; SELECT o_orderkey FROM orders INTO a LIMIT 9; ANALYZE a; SELECT f(_total) AS n FROM _metrics INTO o;", "o", "SELECT 10::BIGINT AS n")
plan("structs", "nation", "SELECT n_name, ARR_JOIN(STRUCT_ATTRS(STRUCT_FROM_ARRAY(ARR_MAKE(n_name, 'b'), FALSE)), ',') AS a, ARR_JOIN(STRUCT_PIVOT(STRUCT_FROM_ARRAY(ARR_MAKE(n_name, 'b'), FALSE)), ',') AS b, ARR_PUT(ARR_MAKE('x', n_name), 1, 'y') AS c, PLAINTEXT n_regionkey AS d, STRUCT_ATTR(STRUCT STR_FORMAT('\\{\"k\":\"%s\"\\}', n_name), 'k') AS e, RANDOM n_nationkey < n_nationkey + 1 AS f FROM nation INTO o;", "o", "SELECT n_name, '0,1' AS a, n_name || ',b' AS b, n_name AS c, n_regionkey::VARCHAR AS d, n_name AS e, TRUE AS f FROM nation")

# -- scripting
plan("user_functions", "orders", "CREATE FUNCTION net(@x, @rate = 0.2) AS RETURN $x * (1 - $rate); CREATE FUNCTION size(@x) AS BEGIN IF $x > 200000 THEN RETURN 'large'; ELSE IF $x > 100000 THEN RETURN 'medium'; END; END; RETURN 'small'; END; SELECT o_orderkey, net(o_totalprice, 0.1) AS n, size(o_totalprice) AS s FROM orders INTO o;", "o", "SELECT o_orderkey, round(o_totalprice * (1 - 0.1), 6) AS n, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_totalprice > 100000 THEN 'medium' ELSE 'small' END AS s FROM orders")
plan("user_transform", "nation", "CREATE TRANSFORM twice FROM COLUMNAR INTO COLUMNAR VALUE (name, copy) AS BEGIN FETCH INTO @k, @r; IF $NOTFOUND THEN RETURN; END; LOOP $i IN [1, 2] BEGIN YIELD $k, COLUMNAR_MAKE(['name', 'copy'], ARR_MAKE($r.n_name, STRING $i)); END; END; ALTER nation twice; SELECT name, copy FROM nation INTO o;", "o", "SELECT n_name AS name, unnest(['1', '2']) AS copy FROM nation")
plan("procedure", "orders", "CREATE PROCEDURE split(@status, @into) AS BEGIN SELECT o_orderkey FROM orders INTO \"{$into}\" WHERE o_orderstatus = $status; END; CALL split(@status='F', @into='f'); CALL split(@status='O', @into='o1'); SELECT * FROM UNION f, o1 INTO o;", "o", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O')")
plan("control_flow", "orders", "LET $n = 0; LOOP $i IN RANGE[1,4] BEGIN IF $i % 2 = 0 THEN $n = $n + $i; END; END; SELECT o_orderkey, $n AS n FROM orders INTO o;", "o", "SELECT o_orderkey, 6 AS n FROM orders")
plan("flagship", "lineitem orders", "SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem INTO li WHERE l_returnflag != 'N'; ALTER li KEY l_orderkey; ALTER orders KEY o_orderkey; SELECT \"orders.o_orderpriority\" AS priority, \"li.revenue\" AS revenue FROM JOIN li, orders INTO j; ALTER j KEY priority; CALL keyedMath(@calc_results=[total,mean,top], @source_attr_total=revenue, @calc_function_total=SUM, @source_attr_mean=revenue, @calc_function_mean=AVERAGE, @source_attr_top=revenue, @calc_function_top=MAX) INPUT j OUTPUT o;", "o", "SELECT o_orderpriority AS k, round(sum(l_extendedprice * (1 - l_discount)), 4) AS total, round(avg(l_extendedprice * (1 - l_discount)), 4) AS mean, round(max(l_extendedprice * (1 - l_discount)), 4) AS top FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'N' GROUP BY 1", True, digits=4)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: run(n) for n in PLANS}


def oracle_sql() -> dict[str, str]:
    return {n: p.sql for n, p in PLANS.items() if p.sql}
