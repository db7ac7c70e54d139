"""The script language: parsing, expressions in both evaluators, statements, sources and sinks, tools."""

import io
import math
import random

import pytest

from heddle.cli import Shell, main, run_tasks, variables
from heddle.engine import Engine
from heddle.lang.lexer import ScriptError, number
from heddle.lang.parser import parse, parse_expression
from heddle.stream import KEY, RecordContext, Stream


@pytest.fixture
def engine(spark):
    return Engine(spark)


def rows(engine, name, *columns):
    df = engine.frame(name, True)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_numbers():
    assert [number(x) for x in ("12", "-3l", "0x1F", "0FFh", "1.5", "2e3", "7d", "abc", "", "99999999999")] == [12, -3, 31, 255, 1.5, 2000.0, 7.0, None, None, 99999999999]


@pytest.mark.parametrize(("text", "want"), [
    ("1 + 2 * 3", 7), ("(1 + 2) * 3", 9), ("2 ^ 3 ^ 2", 512.0), ("7 / 2", 3.5), ("1 / 0", math.inf), ("7 % 4", 3.0), ("NULL : 5", 5), ("TRUE ? 'a' : 'b'", "a"), ("FALSE ? 'a' : 'b'", "b"),
    ("NOT TRUE AND FALSE", False), ("NULL AND FALSE", None), ("NULL OR TRUE", True), ("NULL OR NULL", None), ("NULL XOR TRUE", True), ("NULL = NULL", False), ("NULL == 1", None), ("'5' = 5", False), ("5 = '5'", True), ("3 IN [1, 2, 3]", True), ("'x' NOT IN ['y']", True),
    ("5 BETWEEN 1 AND 9", True), ("5 NOT BETWEEN 1 AND 9", False), ("NULL IS NULL", True), ("1 IS NOT NULL", True), ("'abc' LIKE 'a.c'", True), ("'xabc' LIKE 'abc'", False), ("'ABC' LIKE '/abc/i'", True), ("'a' || 'b' || 1", "ab1"), ("INT '12.7'", 12), ("BOOL 'True'", True), ("HASHCODE 'hello'", 99162322), ("HASHCODE NULL", 0),
    ("6 & 3 | 8", 10), ("1 << 4 >> 2", 4), ("~ 0", -1), ("-3 + 5", 2), ("5 -3", 2), ("'abc' DIGEST 'MD5'", "900150983cd24fb0d6963f7d28e17f72"), ("STR_SLICE('hello', 1, 3)", "el"), ("STR_REPLACE('aXbX', 'X', '-')", "a-b-"), ("ARR_LENGTH(STR_SPLIT('a,b,,', ',', 0))", 2), ("ROUND(-2.5)", -2), ("MAX(1, 5, 3)", 5.0), ("MEDIAN(1, 2, 9)", 2.0), ("ARR_JOIN(RANGE[3, 1], '-')", "3-2-1"),
    ("DT_TZ('America/Lima', 1700000000)", "2023-11-14T17:13:20-05:00[America/Lima]"), ("DT_DOW('UTC', '2024-01-07T00:00:00Z')", 7), ("DT_PARSE('UTC', 'yyyy-MM-dd HH:mm', '2024-01-02 03:04')", 1704164640), ("STRUCT_ATTR(STRUCT '{\"a\":{\"b\":[1,2]}}', 'a.b[1]')".replace("{", "\\{").replace("}", "\\}"), 2),
])
def test_values(engine, text, want):
    assert engine.evaluate(text) == want


def test_evaluators_agree(spark, engine):
    """Random expressions give the same in Python and as Columns."""
    rnd = random.Random(7)

    def make(depth):
        if depth == 0 or rnd.random() < 0.2:
            return rnd.choice(["NULL", "TRUE", "FALSE", str(rnd.randint(0, 9)), f"{rnd.randint(0, 50) / 4}", "'a'", "'7'", "'2.5'", "'true'"])
        op = rnd.choice([":", "?", "OR", "XOR", "AND", "=", "==", "!=", "<>", ">", "<=", "+", "-", "*", "/", "%", "||", "NOT", "BOOL", "INT", "DOUBLE"])
        if op in ("NOT", "BOOL", "INT", "DOUBLE"):
            return f"({op} {make(depth - 1)})"
        return f"({make(depth - 1)} {op} {make(depth - 1)})"

    own, typed = [], 0
    for _ in range(250):
        text = make(2)
        e = parse_expression(text)
        try:
            want = engine.param(e)
        except Exception:
            continue
        own.append((text, e, want))
    compiler = engine.compiler(RecordContext(engine.streams["dual"]))
    df = engine.streams["dual"].df
    for at in range(0, len(own), 25):
        part = own[at : at + 25]
        got = df.select(*[compiler.value(e).c.alias(f"c{i}") for i, (_, e, _) in enumerate(part)]).collect()[0]
        for i, (text, _, want) in enumerate(part):
            g = got[i]
            if isinstance(want, float) and math.isnan(want):
                assert g is None or math.isnan(g), text
            elif isinstance(want, (int, float)) and not isinstance(want, bool) and not isinstance(g, (str, bool)) and g is not None:
                assert g == pytest.approx(want), text
                typed += 1
            elif isinstance(want, bool) or want is None:
                assert g == want or (g is not None and str(g).lower() == str(want).lower()), text
    assert typed > 10


@pytest.mark.parametrize("bad", ["SELECT a FROM b;", "SELECT FROM x INTO y;", "LOOP $a IN [1] BEGIN", "CREATE x;", "IF TRUE SELECT", "LET $x = 1 +;", "SELECT 'open FROM x INTO y;", "ALTER x;"])
def test_syntax_errors(bad):
    with pytest.raises(ScriptError):
        parse(bad)


def test_messages_name_the_line(engine):
    with pytest.raises(ScriptError, match="line 3"):
        engine.execute("LET $a = 1;\n\nSELECT * FROM nothing INTO x;")


def test_text_sources_and_sinks(engine, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text('1,"x, y",p\n2,z,q\n3,,r\n')
    (tmp_path / "in/b.tsv").write_text("id\tname\n7\tseven\n")
    engine.execute(f"""
    CREATE a textColumnar(@delimiter=',') VALUE (id, _, c) FROM '{tmp_path}/in/a.csv' PARTITION 2 BY SOURCE;
    CREATE b textColumnar(@schema_from_file=TRUE) FROM '{tmp_path}/in/b.tsv';
    CREATE t hadoopText() FROM '{tmp_path}/in/a.csv';
    CREATE whole textColumnar(@delimiter=',') VALUE (id, name, c) FROM '{tmp_path}/in/a.csv';
    COPY whole hadoopText(@delimiter=';') INTO '{tmp_path}/out';
    COPY whole columnarParquet(@codec='GZ') VALUE (id, name) INTO '{tmp_path}/pq';
    CREATE again parquetColumnar FROM '{tmp_path}/pq/whole';
    CREATE nested parquetStructured FROM '{tmp_path}/pq/whole';
    SELECT name FROM nested INTO n WHERE id = '2';
    COPY again hadoopText(@codec='GZ') INTO '{tmp_path}/gz';
    """)
    assert rows(engine, "a", "id", "c") == [("1", "p"), ("2", "q"), ("3", "r")] and len({r[0] for r in rows(engine, "a", KEY)}) == 1
    assert rows(engine, "b", "id", "name") == [("7", "seven")] and len(rows(engine, "t", "value")) == 3
    assert sorted(x for f in (tmp_path / "out/whole").glob("part*") for x in f.read_text().splitlines()) == ["1;x, y;p", "2;z;q", "3;;r"]
    assert rows(engine, "again", "id", "name") == [("1", "x, y"), ("2", "z"), ("3", None)] and rows(engine, "n", "name") == [("z",)]
    assert list((tmp_path / "gz/again").glob("part*.gz"))
    with pytest.raises(ScriptError):
        engine.execute(f"CREATE a hadoopText() FROM '{tmp_path}/in/a.csv';")
    with pytest.raises(ScriptError):
        engine.execute(f"COPY whole hadoopText(@codec='ZIP') INTO '{tmp_path}/x';")


def test_folders_become_streams(engine, tmp_path):
    for n in ("one", "two"):
        (tmp_path / n).mkdir()
        (tmp_path / n / "f.txt").write_text(n + "\n")
    engine.execute(f"CREATE x * hadoopText() FROM '{tmp_path}'; SELECT * FROM UNION x * INTO u;")
    assert {"x/one", "x/two"} <= set(engine.streams) and rows(engine, "u", "value") == [("one",), ("two",)]


def test_control_flow(engine):
    engine.execute("""
    OPTIONS @loop_iteration_limit=5;
    LET $n = 0; $list = ['a', 'b'];
    LOOP $x IN $list BEGIN $n = $n + 1; LOOP $y IN [1,2] BEGIN $n = $n + 10; END LOOP; END LOOP;
    LOOP $x IN $none BEGIN $m = 1; ELSE $m = 2; END;
    IF $none THEN LET $k = 1; ELSE LET $k = 2; END IF;
    $s = 'v{$n + 1}\\{x\\}';
    """)
    assert engine.scopes.flat() == {"n": 42, "list": ["a", "b"], "k": 2, "s": "v43{x}"}
    with pytest.raises(ScriptError):
        engine.execute("LOOP $x IN RANGE[1,6] BEGIN LET $q = 1; END;")
    with pytest.raises(ScriptError):
        engine.execute("RAISE 'stop';")
    with pytest.raises(ScriptError, match="nested"):
        engine.execute("LOOP $a IN [1] BEGIN LOOP $b IN [1] BEGIN LOOP $c IN [1] BEGIN LOOP $d IN [1] BEGIN LET $q = 1; END; END; END; END;")


def test_definitions(spark, engine):
    engine.register("t", spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "n int, s string"), key="n")
    engine.execute("""
    CREATE FUNCTION fact(@n) AS BEGIN LET $r = 1; LOOP $i IN ARR_RANGE(1, $n) BEGIN $r = $r * $i; END; RETURN $r; END;
    CREATE FUNCTION sign(@x) AS BEGIN IF $x > 2 THEN RETURN 'big'; END; RETURN 'small'; END;
    CREATE FUNCTION tagged() RECORD AS RETURN s || '-' || REC_KEY();
    CREATE OR REPLACE FUNCTION twice(@x) AS $x * 2;
    CREATE PROCEDURE make(@to, @least = 1) AS BEGIN SELECT n FROM t INTO "{$to}" WHERE n > $least; END;
    CREATE TRANSFORM numbered FROM COLUMNAR INTO COLUMNAR VALUE (i, s) AS BEGIN LET $i = 0; LOOP $forever IN RANGE[1, 30] BEGIN FETCH INTO @k, @r; IF $NOTFOUND THEN RETURN; END; $i = $i + 1; YIELD $k, COLUMNAR_MAKE(['i', 's'], ARR_MAKE($i, $r.s)); END; END;
    SELECT n, fact(n) AS f, sign(n) AS g, twice(twice(n)) AS h, tagged() AS t FROM t INTO o;
    CALL make(@to='p'); CALL make(@to='q', @least=2);
    ALTER UNION t, t numbered INTO w;
    """)
    assert rows(engine, "o", "n", "f", "g", "h", "t") == [(1, "1", "small", 4, "a-1"), (2, "2", "small", 8, "b-2"), (3, "6", "big", 12, None)]
    assert rows(engine, "p", "n") == [(2,), (3,)] and rows(engine, "q", "n") == [(3,)] and len(rows(engine, "w", "i", "s")) == 6
    assert engine.evaluate("fact(5)") == 120
    with pytest.raises(ScriptError, match="already"):
        engine.execute("CREATE FUNCTION twice(@x) AS $x;")
    engine.execute("DROP FUNCTION twice, sign;")
    with pytest.raises(ScriptError):
        engine.execute("SELECT twice(n) AS x FROM t INTO z;")


def test_structured_paths(spark, engine):
    docs = ['{"crate": {"fruit": [{"kind": "pear", "kg": 4.5}, {"kind": "plum", "kg": 2}], "tags": ["ripe", "cold"]}, "no": 11}', '{"crate": {"fruit": [{"kind": "fig"}]}, "no": 12}', '[["a", 7], ["b", 8]]']
    engine.register("t", spark.createDataFrame([(d,) for d in docs], "value string"), "text")
    engine.execute("""
    ALTER t jsonToStructured;
    SELECT * FROM t INTO a WHERE "crate.fruit[1].kind" = 'plum';
    SELECT * FROM t INTO b WHERE "crate.tags" IS NULL AND no > 11;
    SELECT * FROM t INTO c WHERE "crate.fruit[0].kg" > 4;
    SELECT * FROM t INTO d WHERE 'cold' IN "crate.tags[*]";
    SELECT "[0:2]" AS s, "[1][1]" AS n FROM t INTO e WHERE "[0][0]" = 'a';
    """)
    assert [engine.frame(n).count() for n in "abcd"] == [1, 1, 1, 1]
    assert engine.frame("e").collect()[0]["n"] == "8"


def test_tracks(spark, engine):
    own = [(u, i, 50 + i / 100, 10.0 + u, 1000 + i, "car" if i % 2 else "foot", "t1" if i < 4 else "t2") for u in (1, 2) for i in range(6)]
    engine.register("t", spark.createDataFrame(own, "userid int, num int, lat double, lon double, ts int, type string, trackid string"))
    engine.execute("""
    ALTER t columnarToTrack(@userid_column=userid, @lat_column=lat, @lon_column=lon, @ts_column=ts, @trackid_column=trackid);
    SELECT * FROM t INTO cars WHERE POINT type = 'car';
    SELECT * FROM t INTO some WHERE SEGMENT _trackid = 't2';
    SELECT * FROM t INTO one WHERE TRACK _userid = '1';
    SELECT * FROM t INTO none WHERE POINT type = 'boat';
    CALL trackStats(@pinning_mode=TRACK_STARTS) INPUT tracks FROM t OUTPUT stats;
    CALL spatialCentroid(@tracks_mode=TRACKS) INPUT t OUTPUT mid;
    ALTER t trackToGpx(@ts_attr='_ts') ; ALTER t gpxToTrack;
    SELECT TRK_POINTS(REC_OBJECT()) AS p, TRK_SEGMENTS(REC_OBJECT()) AS s FROM t INTO counts;
    """)
    size = lambda n: sum(len(g["points"]) for r in engine.frame(n).collect() for g in r["_geo"]["segments"])
    assert size("cars") == 6 and size("some") == 4 and size("one") == 6 and engine.frame("none").count() == 0
    assert rows(engine, "counts", "p", "s") == [(6, 2), (6, 2)]
    r = engine.frame("stats").collect()[0]
    assert r["_points"] == 6 and r["_duration"] == 4 and 4400 < r["_distance"] < 5600 and engine.frame("mid").count() == 2


def test_shapes(spark, engine):
    docs = ['{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"name":"sq"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,1],[0,0]],[[0.4,0.4],[0.6,0.4],[0.6,0.6],[0.4,0.6],[0.4,0.4]]]}}]}']
    roads = ['{"type":"Feature","properties":{"n":"r","t":"primary","w":"10"},"geometry":{"type":"LineString","coordinates":[[0,0],[0.01,0],[0.01,0.01]]}}']
    engine.register("g", spark.createDataFrame([(d,) for d in docs], "value string"), "text")
    engine.register("r", spark.createDataFrame([(d,) for d in roads], "value string"), "text")
    engine.register("p", spark.createDataFrame([(1, 0.5, 0.5), (2, 0.2, 0.2), (3, 5.0, 5.0)], "id int, lat double, lon double"))
    engine.execute("""
    ALTER g geoJsonToPolygon POLYGON (name);
    SELECT POLY_AREA(REC_OBJECT()) AS a, POLY_PERIMETER(REC_OBJECT()) AS l, POLY_HOLES(REC_OBJECT()) AS h, POLY_VERTICES(REC_OBJECT()) AS v FROM g INTO m;
    ALTER r geoJsonToRoadMap(@name_prop=n, @type_prop=t, @width_prop=w);
    ALTER p columnarToPoint(@lat_column=lat, @lon_column=lon, @radius_default=1000) POINT (id);
    SELECT POINT_INVERSE(POINT_MAKE(0, 0), POINT_MAKE(0, 1)) AS i, POINT_LAT(POINT_DIRECT(REC_OBJECT(), 1000, 0)) AS n FROM p INTO q;
    CALL areaCovers() INPUT points FROM p, polygons FROM g OUTPUT target INTO hit, evicted INTO miss;
    SELECT *, 0 AS azi FROM p INTO eye;
    """.replace("SELECT *, 0 AS azi FROM p INTO eye;", "SELECT id, 90 AS azi FROM p INTO eye; ALTER eye polygonEyeView(@azimuth_prop=azi) POLYGON (id); ALTER eye polygonToGeoJson;"))
    m = engine.frame("m").collect()[0]
    assert m["a"] == pytest.approx(12308778361.469 * 0.96, rel=2e-3) and m["l"] == pytest.approx(443770.917, rel=1e-6) and (m["h"], m["v"]) == (1, 4)
    assert engine.frame("r").count() == 5
    q = engine.frame("q").collect()[0]
    assert q["i"] == pytest.approx([111319.4907932, 90, 90]) and q["n"] > 0
    assert rows(engine, "hit", "id") == [(2,)] and rows(engine, "miss", "id") == [(1,), (3,)]
    assert "Polygon" in engine.frame("eye").collect()[0]["value"]


def test_spatial_joins_of_repeated_points_and_unlike_sizes(spark, engine):
    """Equal points are kept each; one shape of the world's size among many small ones costs a few cells."""
    ring = lambda x, y, w, h: ",".join(f"[{a},{b}]" for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)))
    boxes = [("world", ring(-179, -89, 358, 178))] + [(f"s{i}", ring(i % 300 - 150, i // 300 % 100 - 50, 0.01, 0.01)) for i in range(6000)]
    docs = [(f'{{"type":"Feature","properties":{{"id":"{n}"}},"geometry":{{"type":"Polygon","coordinates":[[{r}]]}}}}',) for n, r in boxes]
    engine.register("g", spark.createDataFrame(docs, "value string"), "text")
    engine.register("p", spark.createDataFrame([(-149.995, -49.995), (-149.995, -49.995), (10.5, 20.5), (179.5, 0.0)], "lon double, lat double"))
    engine.register("q", spark.createDataFrame([(-149.995, -49.995, 900.0), (-149.996, -49.995, 900.0), (10.5, 20.5, 1.0)], "lon double, lat double, r double"))
    engine.execute("""
    ALTER g geoJsonToPolygon POLYGON (id);
    ALTER p columnarToPoint(@lat_column=lat, @lon_column=lon) POINT (lon); ALTER q columnarToPoint(@lat_column=lat, @lon_column=lon, @radius_column=r) POINT (r);
    CALL areaCovers(@encounter_mode=ONCE) INPUT points FROM p, polygons FROM g OUTPUT target INTO once, evicted INTO out;
    CALL areaCovers() INPUT points FROM p, polygons FROM g OUTPUT target INTO every;
    SELECT * FROM q INTO near WHERE r > 2;
    CALL proximity(@encounter_mode=ALL) INPUT points FROM p, pois FROM near OUTPUT target INTO all, evicted INTO some;
    CALL proximity(@encounter_mode=ALL) INPUT points FROM p, pois FROM q OUTPUT target INTO nobody;
    CALL proximity(@encounter_mode=ONCE) INPUT points FROM p, pois FROM q OUTPUT target INTO one;
    CALL proximity() INPUT points FROM p, pois FROM q OUTPUT target INTO each;
    """)
    size = lambda n: engine.frame(n).count()
    assert rows(engine, "once", "lon") == [(-149.995,), (-149.995,), (10.5,)] and rows(engine, "out", "lon") == [(179.5,)]
    assert rows(engine, "every", "id") == [("s0",), ("s0",), ("world",), ("world",), ("world",)]
    assert (size("all"), size("some"), size("nobody"), size("one"), size("each")) == (2, 2, 0, 3, 5)


def test_jdbc_both_ways(spark, engine, tmp_path):
    """By Derby, which comes with Spark."""
    db = f"@driver='org.apache.derby.jdbc.EmbeddedDriver', @url='jdbc:derby:{tmp_path}/db;create=true'"
    engine.register("t", spark.createDataFrame([(i, f"n{i}") for i in range(9)], "id int, name string"))
    engine.execute(f"""
    COPY t jdbcColumnar({db}, @batch_size=4) VALUE (id, name) INTO 'things';
    CREATE whole jdbcColumnar({db}) FROM 'SELECT * FROM things WHERE "id" < 5';
    CREATE parts jdbcColumnar({db}) FROM 'SELECT * FROM things WHERE MOD("id", 3) BETWEEN ? AND ?' PARTITION 3;
    """)
    assert rows(engine, "whole", "id", "name") == [(i, f"n{i}") for i in range(5)] and rows(engine, "parts", "id") == [(i,) for i in range(9)]


def test_parameters_are_checked(spark, engine):
    engine.register("t", spark.createDataFrame([(1, 2.0)], "k int, v double"), key="k")
    for bad in ("CALL keyedMath(@calc_results=[a]) INPUT t OUTPUT o;", "CALL countByKey(@x=1) INPUT t OUTPUT o;", "CALL nothing() INPUT t OUTPUT o;", "CALL seriesMath(@calc_attr=v, @calc_function=OTHER) INPUT t OUTPUT o;", "CALL reach(@signals_userid_attr=a, @target_userid_attr=a, @target_grouping_attr=a) INPUT signals FROM t OUTPUT o;", "ALTER t jsonToStructured;", "SELECT * FROM UNION t, dual INTO o;", "ALTER dual KEY 1;"):
        with pytest.raises(ScriptError):
            engine.execute(bad)


def test_limit_and_single_values(spark, engine):
    engine.register("t", spark.range(100).toDF("n"))
    engine.execute("OPTIONS @exact_limit=TRUE; SELECT n FROM t INTO a LIMIT 7; SELECT n FROM t INTO b LIMIT 1000; CALL percentRankInc(@value_attr=n) INPUT a OUTPUT c; SELECT n FROM t INTO one WHERE n = 3; SELECT n FROM t INTO x WHERE 3 = n; CALL percentRankInc(@value_attr=n) INPUT x OUTPUT d;")
    assert engine.frame("a").count() == 7 and engine.frame("b").count() == 100
    assert math.isnan(engine.frame("d").collect()[0]["_rank"])


def test_joins_match_null_keys_and_types(spark, engine):
    engine.register("a", spark.createDataFrame([(1, "x"), (None, "n")], "k int, v string"), key="k")
    engine.register("b", spark.createDataFrame([("1", "s"), (None, "m")], "k string, w string"), key="k")
    engine.register("c", spark.createDataFrame([(None, "o")], "k int, w string"), key="k")
    engine.execute("SELECT * FROM JOIN a, b INTO ab; SELECT * FROM JOIN a, c INTO ac;")
    assert engine.frame("ab").count() == 0 and rows(engine, "ac", "a.v", "c.w") == [("n", "o")]


def test_shell_tasks_and_command_line(engine, tmp_path):
    out = io.StringIO()
    shell = Shell(engine, out)
    for line in ("LET $x = 2", "+ 3;", "\\eval $x * 2", "\\print dual 1", "\\show ds", "\\describe dual", "\\show variables", "\\renounce dual", "\\bad", "SELECT broken;", "\\help"):
        assert not shell.onecmd(line)
    assert "10" in out.getvalue() and "ScriptError" in out.getvalue() and shell.onecmd("\\quit") and "dual" not in engine.streams
    (tmp_path / "a.csv").write_text("1,x\n2,y\n")
    tasks = {"t": [{"name": "s", "source": {"adapter": "hadoopText", "path": f"{tmp_path}/a.csv"}, "transform": [{"verb": "textToColumnar", "params": {"delimiter": ","}, "columns": {"VALUE": ["id", "v"]}}], "dest": {"adapter": "columnarParquet", "path": f"{tmp_path}/out"}}]}
    assert run_tasks(engine, tasks) == ["t_s"] and engine.spark.read.parquet(f"{tmp_path}/out/t_s").count() == 2
    assert variables("# c\nA=[1,2.5]\nB='x''y'\nC='p','q'\nD=plain\nE=\nF=['z']") == {"A": [1, 2.5], "B": "x'y", "C": ["p", "q"], "D": "plain", "E": None, "F": ["z"]}
    good, bad = tmp_path / "good.txt", tmp_path / "bad.txt"
    good.write_text("LET $a = 1;")
    bad.write_text("LET $a = ;")
    assert main(["-d", str(good)]) == 0 and main(["-d", str(bad)]) == 2


def test_lineage_and_metrics(spark, engine):
    engine.register("t", spark.createDataFrame([(1,), (1,), (2,)], "k int"), key="k")
    engine.execute("ALTER t PARTITION 2; ANALYZE t; SELECT k FROM t INTO u WHERE k > 1;")
    assert rows(engine, "_metrics", "_name", "_total", "_unique", "_average", "_median") == [("t", 3, 2, 1.5, 1.5)]
    assert engine.lineage("u")[-1] == ("FILTERED", "t")
    assert isinstance(engine.streams["u"], Stream)
