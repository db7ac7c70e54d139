"""Filters reach the Parquet scan, and integers compare as integers."""

import re

import pytest

from heddle.engine import Engine

BIG = 9007199254740992  # 2^53


def scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"PushedFilters: \[(.*?)\], ReadSchema: struct<(.*?)>", plan)


@pytest.mark.parametrize(
    ("where", "pushed"),
    [
        ("l_orderkey = 5", "EqualTo(l_orderkey,5)"),
        ("l_orderkey == 5", "EqualTo(l_orderkey,5)"),
        ("l_orderkey > 5", "GreaterThan(l_orderkey,5)"),
        ("l_linenumber <= 3", "LessThanOrEqual(l_linenumber,3)"),
        ("l_quantity < 20", "LessThan(l_quantity,20.0)"),
        ("l_quantity BETWEEN 5 AND 20", "GreaterThanOrEqual(l_quantity,5.0)"),
        ("l_linenumber BETWEEN 2 AND 3", "LessThanOrEqual(l_linenumber,3)"),
        ("l_returnflag = 'A'", "EqualTo(l_returnflag,A)"),
        ("l_returnflag != 'A'", "Not(EqualTo(l_returnflag,A))"),
        ("l_returnflag IN ['A', 'R']", "In(l_returnflag, [A,R])"),
        ("l_orderkey IN [1, 2, 3]", "In(l_orderkey, [1,2,3])"),
        ("l_quantity > 30 AND l_returnflag = 'R'", "EqualTo(l_returnflag,R)"),
        ("l_orderkey < 3 OR l_linenumber = 7", "Or(LessThan(l_orderkey,3),EqualTo(l_linenumber,7))"),
    ],
)
def test_filters_reach_the_scan(spark, sf, where, pushed):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    e = Engine(spark).execute(f"CREATE li parquetColumnar FROM '{sf}/lineitem.parquet'; SELECT l_orderkey FROM li INTO o WHERE {where};")
    ((filters, columns),) = scans(e.frame("o"))
    assert pushed in filters
    assert "metadata" not in columns and columns.count(":") <= 3


def test_null_logic_of_filters(spark):
    df = spark.createDataFrame([(1, None, None), (2, 3, "a"), (3, None, "b"), (4, 4, None)], "id int, x int, s string")
    own = {
        "x = 3": {2}, "x != 3": {4}, "x <> 3": {4}, "NOT x = 3": {1, 3, 4}, "NOT x > 3": {2}, "x > 3 OR s = 'b'": {3, 4}, "x > 2 AND s = 'a'": {2}, "x IN [3]": {2}, "x NOT IN [3]": {1, 3, 4},
        "x > 2 AND NOT s = 'a'": {4}, "x > 3 XOR s = 'b'": {3, 4}, "x = '3'": {2}, "x = '3.0'": {2}, "s != 3": {2, 3}, "x != 'a'": {2, 4}, "x BETWEEN 2.5 AND 3.5": {2}, "x NOT BETWEEN 2.5 AND 3.5": {4}, "s IN ['a', 'b'] OR x IS NULL": {1, 2, 3},
    }
    for where, want in own.items():
        e = Engine(spark)
        e.register("t", df)
        e.execute(f"SELECT id FROM t INTO o WHERE {where}; SELECT id, ({where}) AS w FROM t INTO p;")
        assert {r["id"] for r in e.frame("o").collect()} == want, where
        assert {r["id"] for r in e.frame("p").collect() if r["w"]} == want, where


@pytest.mark.parametrize(("test", "want"), [("x = {b}", False), ("x != {b}", True), ("x > {b}", True), ("x <= {b}", False), ("x IN [{b}]", False), ("x IN [{a}]", True), ("x = '{a}'", True), ("x = '{b}'", False), ("x BETWEEN 0 AND {b}", False), ("x = {b}.0", True)])
def test_integers_beyond_doubles(spark, test, want):
    own = test.format(a=BIG + 1, b=BIG)
    e = Engine(spark)
    e.register("t", spark.createDataFrame([(BIG + 1,)], "x long"))
    e.execute(f"SELECT ({own}) AS w FROM t INTO p; LET $x = {BIG + 1}; LET $w = {own.replace('x ', '$x ')};")
    assert e.frame("p").first()["w"] is want
    if "BETWEEN" not in test:
        assert e.variable("w") is want


def test_subqueries_are_joins(spark):
    t = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "id int, x int")
    u = spark.createDataFrame([(5,), (None,), (9,)], "y long")
    for where, want, join in (("x IN $q", {1}, "LeftSemi"), ("x NOT IN $q", {2, 3}, "ExistenceJoin"), ("id > 1 AND x IN $q OR id = 3", {3}, "ExistenceJoin"), ("id = 1 AND x IN $q", {1}, "LeftSemi")):
        e = Engine(spark)
        e.register("t", t)
        e.register("u", u)
        e.execute(f"$q = SELECT y FROM u WHERE y < 9; SELECT id FROM t INTO o WHERE {where};")
        assert "values" not in vars(e.answer("q")), "collected"
        plan = e.frame("o")._jdf.queryExecution().executedPlan().toString()
        assert join in plan and "NestedLoop" not in plan
        assert {r["id"] for r in e.frame("o").collect()} == want, where
    e.execute("SELECT id, x IN $q AS w FROM t INTO p; LOOP $i IN $q BEGIN SELECT id FROM t INTO \"l{$i}\"; END;")
    assert {r["id"] for r in e.frame("p").filter("w").collect()} == {1} and "l5" in e.streams
    e.execute("CREATE FUNCTION known(@v) AS BEGIN LOOP $i IN $q BEGIN IF $i = $v THEN RETURN TRUE; END; END; RETURN FALSE; END; SELECT id FROM t INTO r WHERE known(x);")
    assert {r["id"] for r in e.frame("r").collect()} == {1}
