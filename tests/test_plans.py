"""Each query against its SQL in DuckDB."""

import math

import duckdb
import pytest

from heddle.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5) + 0.0
    return x


@pytest.mark.parametrize("name", sorted(catalog.PLANS))
def test_plan(spark, sf, duck, name):
    p = catalog.PLANS[name]
    df = catalog.run(name)(spark, sf)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)
    if p.sql is None:
        assert got
        return
    rel = duck.sql(p.sql)
    assert sorted(rel.columns) == sorted(df.columns)
    order = [rel.columns.index(c) for c in sorted(rel.columns)]
    want = sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=str)
    assert len(got) == len(want)
    kinds = dict(zip(rel.columns, map(str, rel.types), strict=True))
    names = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for c, t in df.dtypes:
        assert names.get(t, kinds[c]) == kinds[c], (c, t, kinds[c])
    assert got == want


@pytest.mark.parametrize("name", ["stream_hourly", "stream_sessions"])
def test_streaming(spark, sf, duck, name):
    from heddle.streaming import queries

    df = queries.queries()[name](spark, sf)
    rel = duck.sql(queries.oracle_sql()[name])
    want = sorted(tuple(plain(x) for x in r) for r in rel.fetchall())
    assert sorted(tuple(plain(r[c]) for c in rel.columns) for r in df.collect()) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
