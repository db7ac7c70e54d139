"""Work that must not grow with copies: what spatial joins test, and how joins and streams are dealt."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from heddle.engine import Engine
from heddle.operators import geo
from heddle.streaming import windows


@pytest.fixture
def engine(spark):
    return Engine(spark)


def rows(engine, name, *columns):
    return sorted(tuple(r[c] for c in columns) for r in engine.frame(name, True).collect())


def counted(spark, result):
    """A function of constant result, and the number of rows that it is asked for."""
    asked = spark.sparkContext.accumulator(0)

    def run(x: pd.Series) -> pd.Series:
        asked.add(len(x))
        return pd.Series([result] * len(x))

    return F.pandas_udf(run, "double" if isinstance(result, float) else "boolean"), asked


def test_copies_of_points_and_circles_cost_one_distance(spark, engine, monkeypatch):
    """300 copies of a point by 200 of a circle are 60000 hits, whose distance is measured for one pair."""
    distance, asked = counted(spark, 7.0)
    monkeypatch.setattr(geo.sp, "distance_udf", lambda *columns: distance(columns[0]))
    engine.register("p", spark.range(301).selectExpr("id", "if(id < 300, 10D, 50D) AS lat", "20D + id % 1 AS lon"))
    engine.register("q", spark.range(200).selectExpr("id AS poi", "10D + id % 1 AS lat", "20D + id % 1 AS lon"))
    engine.execute("""
    ALTER p columnarToPoint(@lat_column=lat, @lon_column=lon) POINT (id); ALTER q columnarToPoint(@lat_column=lat, @lon_column=lon, @radius_default=9) POINT (poi);
    CALL proximity() INPUT points FROM p, pois FROM q OUTPUT target INTO each, evicted INTO far;
    CALL proximity(@encounter_mode=ONCE) INPUT points FROM p, pois FROM q OUTPUT target INTO one, evicted INTO none;
    CALL proximity(@encounter_mode=ALL) INPUT points FROM p, pois FROM q OUTPUT target INTO all, evicted INTO some;
    """)
    assert rows(engine, "each", "id", "poi", "_distance") == [(i, j, 7.0) for i in range(300) for j in range(200)]
    assert rows(engine, "far", "id") == rows(engine, "none", "id") == rows(engine, "some", "id") == [(300,)]
    assert rows(engine, "one", "id") == rows(engine, "all", "id") == [(i,) for i in range(300)]
    assert 0 < asked.value < 100


def test_copies_of_points_and_polygons_cost_one_test(spark, engine, monkeypatch):
    asked, inside = counted(spark, True)[::-1]
    exact = geo.in_ring
    monkeypatch.setattr(geo, "in_ring", lambda ring, lat, lon: exact(ring, lat, lon) & inside(lat + F.get(ring, 0)["lat"]))
    doc = '{"type":"Feature","properties":{"box":"%s"},"geometry":{"type":"Polygon","coordinates":[[[19.5,9.5],[20.5,9.5],[20.5,10.5],[19.5,10.5],[19.5,9.5]]]}}'
    engine.register("p", spark.range(301).selectExpr("id", "if(id < 300, 10D, 50D) AS lat", "20D + id % 1 AS lon"))
    engine.register("g", spark.createDataFrame([(doc % i,) for i in range(200)], "value string"), "text")
    monkeypatch.setattr(F, "exists", lambda holes, test: F.lit(False))  # no Python within a lambda; there are no holes
    engine.execute("""
    ALTER p columnarToPoint(@lat_column=lat, @lon_column=lon) POINT (id); ALTER g geoJsonToPolygon POLYGON (box);
    CALL areaCovers() INPUT points FROM p, polygons FROM g OUTPUT target INTO each, evicted INTO far;
    """)
    assert rows(engine, "each", "id", "box") == [(i, j) for i in range(300) for j in sorted(map(str, range(200)))]
    assert rows(engine, "far", "id") == [(300,)] and 0 < asked.value < 100


def test_third_join_has_its_rows_dealt(spark, engine):
    """Two keys, and all rows of one task: each task of the last join has its share, before and after it."""
    for name, n in (("a", 2), ("b", 4000), ("c", 50)):
        engine.register(name, spark.range(0, n, 1, 1).selectExpr("id % 2 AS k", f"id AS {name}"), key="k")
    engine.execute('SELECT "a.a" AS a, "b.b" AS b, "c.c" AS c FROM JOIN a, b, c INTO o;')
    sizes = [r["count"] for r in engine.frame("o").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 100_000 and len(sizes) >= 8 and max(sizes) <= 1.5 * sum(sizes) / len(sizes)


def test_stream_results_stay_out_of_the_driver(spark, tmp_path):
    spark.range(100).selectExpr("id % 3 AS k", "timestamp_seconds(id * 60) AS ts").write.parquet(f"{tmp_path}/in")
    stream = lambda: windows.read_folder(spark, f"{tmp_path}/in", "k long, ts timestamp")
    got = windows.drain(windows.sessions(stream(), "ts", "6 hours", "12 hours", ["k"]), "s1", checkpoint=f"{tmp_path}/c")
    assert got.inputFiles() and sorted((r["k"], r["_count"]) for r in got.collect()) == [(0, 34), (1, 33), (2, 33)]
    more = windows.drain(stream(), "s2", "append", f"{tmp_path}/c")
    assert more.count() == 100 and windows.drain(stream(), "s2", "append", f"{tmp_path}/c").count() == 0


def test_points_of_one_time_are_in_the_order_of_their_attributes(spark, engine):
    """In whichever order they come, and as numbers: 9 before 10."""
    points = [(10, 5, "b"), (9, 5, "a"), (11, 5, "a"), (8, 6, "a"), (12, 4, "b")]
    for name, own in (("x", points), ("y", points[::-1])):
        engine.register(name, spark.createDataFrame([(1, *p, 1.0 / p[0], 2.0) for p in own], "u int, id long, t long, kind string, lat double, lon double"))
        engine.execute(f"ALTER {name} columnarToTrack(@lat_column=lat, @lon_column=lon, @ts_column=t, @userid_column=u, @trackid_column=kind) POINT (id);")
        segments = engine.frame(name).collect()[0]["_geo"]["segments"]
        assert [[int(p["props"]["id"]) for p in g["points"]] for g in segments] == [[12], [9], [10], [11, 8]]
