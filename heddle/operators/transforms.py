"""Transforms: changes of a stream's type or attributes."""

from __future__ import annotations

import re
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import spatial as sp
from ..functions.records import structured_get
from ..geo import h3, shapes
from ..lang.lexer import ScriptError
from ..stream import GEO, KEY, OBJECT, PART, VALUE, RecordContext, Stream, quoted
from .registry import EVERY, REQUIRED, transform
from .scalar import double, text

Columns = dict[str, list[str]]
TRACK = "struct<segments:array<struct<props:map<string,string>,points:array<struct<lat:double,lon:double,props:map<string,string>>>>>>"


def _keep(s: Stream) -> list[Column]:
    return [F.col(c) for c in (KEY, PART) if c in s.df.columns]


def _attr(s: Stream, name: str) -> Any:
    return RecordContext(s).attr(name)


def _made(s: Stream, what: str, df: Any, kind: str, attrs: Columns) -> Stream:
    return s.made("TRANSFORMED", what, df=df, kind=kind, attrs=attrs)


@transform("passthru", EVERY)
def passthru(s: Stream, params: dict[str, Any], columns: Columns) -> Stream:
    names = columns.get(s.level)
    if s.kind == "text" or (names is None and not columns):
        return s
    if s.kind == "structured":
        own = [structured_get(F.col(OBJECT), n).c.alias(n) for n in names]
        return _made(s, "passthru", s.df.select(*_keep(s), F.to_variant_object(F.struct(*own)).alias(OBJECT)), s.kind, {"value": names})
    df = s.df
    if s.kind == "track":
        keep = lambda m, own: F.map_filter(m, lambda k, _: k.isin(own))
        segments = F.transform(F.col(GEO)["segments"], lambda g: F.struct((keep(g["props"], columns["segment"]) if "segment" in columns else g["props"]).alias("props"), F.transform(g["points"], lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"), (keep(p["props"], columns["point"]) if "point" in columns else p["props"]).alias("props"))).alias("points")))
        df = df.withColumn(GEO, F.struct(segments.alias("segments")))
    names = names if names is not None else s.columns
    geo = [F.col(GEO)] if GEO in df.columns else []
    out = s.but(df=df)
    return _made(s, "passthru", df.select(*_keep(s), *geo, *[_attr(out, n).c.alias(n) for n in names]), s.kind, {**s.attrs, **columns, s.level: names})


@transform("textToColumnar", ("text",), delimiter=("text", "\t"))
def text_to_columnar(s: Stream, params: dict[str, Any], columns: Columns) -> Stream:
    names = columns.get("value")
    if not names:
        raise ScriptError("textToColumnar needs VALUE columns")
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    parsed = F.from_csv(VALUE, F.lit(schema), {"sep": params["delimiter"], "mode": "PERMISSIVE"}).alias("r")
    df = s.df.select(*_keep(s), parsed)
    own = [F.col(f"r.c{i}").alias(n) for i, n in enumerate(names) if n != "_"]
    return _made(s, "textToColumnar", df.select(*_keep(s), *own), "columnar", {"value": [n for n in names if n != "_"]})


def csv_line(cells: list[Column], delimiter: str) -> Column:
    """Cells joined by a delimiter, quoted only where they must be; nulls are empty."""
    special = "[\"\\r\\n" + re.sub(r"([\\\]\[^-])", r"\\\1", delimiter) + "]"
    own = [F.coalesce(F.when(c.rlike(special), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c), F.lit("")) for c in cells]
    return F.concat_ws(delimiter, *own)


@transform("columnarToText", ("columnar",), delimiter=("text", "\t"))
def columnar_to_text(s: Stream, params: dict[str, Any], columns: Columns) -> Stream:
    names = columns.get("value") or s.names
    cells = [F.col(KEY).cast("string") if n == KEY else text(_attr(s, n)) for n in names]
    return _made(s, "columnarToText", s.df.select(*_keep(s), csv_line(cells, params["delimiter"]).alias(VALUE)), "text", {})


@transform("jsonToStructured", ("text",))
def json_to_structured(s: Stream, params: dict[str, Any], columns: Columns) -> Stream:
    return _made(s, "jsonToStructured", s.df.select(*_keep(s), F.try_parse_json(VALUE).alias(OBJECT)), "structured", {"value": columns.get("value", [])})


@transform("structuredToJson", ("structured",))
def structured_to_json(s: Stream, params: dict[str, Any], columns: Columns) -> Stream:
    return _made(s, "structuredToJson", s.df.select(*_keep(s), F.to_json(OBJECT).alias(VALUE)), "text", {})


@transform("structuredToColumnar", ("structured",), column__ANY=("text", None))
def structured_to_columnar(s: Stream, params: dict[str, Any], columns: Columns) -> Stream:
    names = columns.get("value") or [*params["column_"]]
    own = [text(structured_get(F.col(OBJECT), params["column_"].get(n, n))).alias(n) for n in names]
    return _made(s, "structuredToColumnar", s.df.select(*_keep(s), *own), "columnar", {"value": names})


@transform("columnarToStructured", ("columnar",), template=("text", REQUIRED))
def columnar_to_structured(s: Stream, params: dict[str, Any], columns: Columns) -> Stream:
    names = columns.get("value") or s.names
    body = F.lit(params["template"])
    for n in names:
        body = F.replace(body, F.lit(f"${n}$"), F.coalesce(text(_attr(s, n)), F.lit("null")))
    return _made(s, "columnarToStructured", s.df.select(*_keep(s), F.try_parse_json(body).alias(OBJECT)), "structured", {"value": names})


@transform("columnarToPoint", ("columnar",), lat_column=("text", REQUIRED), lon_column=("text", REQUIRED), radius_column=("text", None), radius_default=("double", float("nan")))
def columnar_to_point(s: Stream, params: dict[str, Any], columns: Columns) -> Stream:
    names = columns.get("point") or s.names
    default = F.lit(params["radius_default"])
    radius = F.coalesce(double(_attr(s, params["radius_column"])), default) if params["radius_column"] else default
    geo = sp.point(double(_attr(s, params["lat_column"])), double(_attr(s, params["lon_column"])), radius)
    return _made(s, "columnarToPoint", s.df.select(*_keep(s), geo.alias(GEO), *[_attr(s, n).c.alias(n) for n in names]), "point", {"point": names})


@transform("pointToColumnar", ("point",))
def point_to_columnar(s: Stream, params: dict[str, Any], columns: Columns) -> Stream:
    made = {"_center_lat": F.col(GEO)["lat"], "_center_lon": F.col(GEO)["lon"], "_radius": F.col(GEO)["radius"]}
    names = columns.get("value") or [*s.columns, *made]
    return _made(s, "pointToColumnar", s.df.select(*_keep(s), *[made.get(n, _attr(s, n).c).alias(n) for n in names]), "columnar", {"value": names})


@transform("columnarToTrack", ("columnar",), lat_column=("text", REQUIRED), lon_column=("text", REQUIRED), ts_column=("text", REQUIRED), userid_column=("text", REQUIRED), trackid_column=("text", None))
def columnar_to_track(s: Stream, params: dict[str, Any], columns: Columns) -> Stream:
    """Points of a user by time, those of one time by their attributes in the order named; a change of the track id starts a segment. The key is the user."""
    names = columns.get("point") or s.names
    props = F.map_from_arrays(F.array(*[F.lit(n) for n in [*names, "_ts"]]), F.array(*[text(_attr(s, n)) for n in [*names, params["ts_column"]]]))
    track = text(_attr(s, params["trackid_column"])) if params["trackid_column"] else F.lit(None).cast("string")
    own = [_attr(s, n) for n in names]
    tie = F.struct(*[(v.c if v.t in ("int", "long", "double", "bool") else text(v)).alias(f"c{i}") for i, v in enumerate(own)], F.coalesce(track, F.lit("")).alias("track"), double(_attr(s, params["lat_column"])).alias("lat"), double(_attr(s, params["lon_column"])).alias("lon"))
    rows = s.df.select(text(_attr(s, params["userid_column"])).alias("user"), double(_attr(s, params["ts_column"])).alias("ts"), F.coalesce(track, F.lit("")).alias("track"), tie.alias("tie"), F.struct(double(_attr(s, params["lat_column"])).alias("lat"), double(_attr(s, params["lon_column"])).alias("lon"), props.alias("props")).alias("point"))
    order = Window.partitionBy("user").orderBy("ts", "tie")
    new = F.coalesce((F.col("track") != F.lag("track").over(order)).cast("int"), F.lit(1))
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("new", new).withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = rows.groupBy("user", "part").agg(F.first("track").alias("track"), F.sort_array(F.collect_list(F.struct("n", F.col("point")["lat"].alias("lat"), F.col("point")["lon"].alias("lon"), F.map_entries(F.col("point")["props"]).alias("props")))).alias("points"))
    points = F.transform("points", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"), F.map_from_entries(p["props"]).alias("props")))
    segment = F.struct(F.col("part"), F.create_map(F.lit("_userid"), F.col("user"), F.lit("_trackid"), F.col("track")).alias("props"), points.alias("points"))
    whole = parts.select("user", segment.alias("g")).groupBy("user").agg(F.array_sort(F.collect_list("g"), lambda a, b: (a["part"] - b["part"]).cast("int")).alias("g"))
    segments = F.transform("g", lambda g: F.struct(g["props"].alias("props"), g["points"].alias("points")))
    df = whole.select(F.col("user").alias(KEY), F.struct(segments.alias("segments")).alias(GEO), F.col("user").alias("_userid"))
    return _made(s, "columnarToTrack", df, "track", {"track": ["_userid"], "segment": ["_userid", "_trackid"], "point": [*names, "_ts"]})


@transform("trackToPoint", ("track",))
def track_to_point(s: Stream, params: dict[str, Any], columns: Columns) -> Stream:
    """One record for each point; a point's attributes win over its segment's, and those over the track's."""
    names = columns.get("point") or list(dict.fromkeys([*s.attrs.get("track", s.columns), *s.attrs.get("segment", []), *s.attrs.get("point", [])]))
    rows = s.df.select("*", F.explode(F.col(GEO)["segments"]).alias("__g")).select("*", F.explode(F.col("__g")["points"]).alias("__p"))
    own = [F.coalesce(F.col("__p")["props"][n], F.col("__g")["props"][n], F.col(quoted(n)).cast("string") if n in s.columns else F.lit(None)).alias(n) for n in names]
    df = rows.select(*_keep(s), sp.point(F.col("__p")["lat"], F.col("__p")["lon"]).alias(GEO), *own)
    return _made(s, "trackToPoint", df, "point", {"point": names})


_FEATURES = "struct<type:string,features:array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"


def _features(s: Stream) -> Any:
    """A row for each feature: properties, geometry type and coordinates as JSON."""
    read = F.from_json(VALUE, _FEATURES).alias("d")
    one = F.array(F.struct(F.col("d.properties").alias("properties"), F.col("d.geometry").alias("geometry")))
    return s.df.select(*_keep(s), read).select(*_keep(s), F.explode(F.when(F.col("d.features").isNotNull(), F.col("d.features")).otherwise(one)).alias("f")).select(*_keep(s), F.col("f.properties").alias("p"), F.col("f.geometry.type").alias("t"), F.col("f.geometry.coordinates").alias("c"))


def _props(names: list[str]) -> list[Column]:
    return [F.col("p")[n].alias(n) for n in names]


@transform("geoJsonToPoint", ("text",), radius_default=("double", float("nan")), radius_prop=("text", None))
def geojson_to_point(s: Stream, params: dict[str, Any], columns: Columns) -> Stream:
    names = columns.get("point", [])
    rows = _features(s)
    one = F.array(F.from_json("c", "array<double>"))
    many = F.from_json("c", "array<array<double>>")
    shells = F.when(F.col("t") == "Polygon", F.array(F.get(F.from_json("c", "array<array<array<double>>>"), 0))).otherwise(F.transform(F.from_json("c", "array<array<array<array<double>>>>"), lambda p: F.get(p, 0)))
    points = rows.filter(F.col("t").isin("Point", "MultiPoint")).withColumn("at", F.explode(F.when(F.col("t") == "Point", one).otherwise(many)))
    points = points.select(*_keep(s), "p", sp.point(F.get("at", 1), F.get("at", 0)).alias("g"))
    areas = rows.filter(F.col("t").isin("Polygon", "MultiPolygon")).withColumn("shell", F.explode(shells)).select(*_keep(s), "p", sp.centroid_udf(sp._ring_of(F.col("shell"))).alias("g"))
    default = F.lit(params["radius_default"])
    radius = F.coalesce(F.col("p")[params["radius_prop"]].try_cast("double"), default) if params["radius_prop"] else default
    all_ = points.unionByName(areas)
    return _made(s, "geoJsonToPoint", all_.select(*_keep(s), sp.point(F.col("g")["lat"], F.col("g")["lon"], radius).alias(GEO), *_props(names)), "point", {"point": names})


@transform("geoJsonToPolygon", ("text",))
def geojson_to_polygon(s: Stream, params: dict[str, Any], columns: Columns) -> Stream:
    names = columns.get("polygon", [])
    rows = _features(s).filter(F.col("t").isin("Polygon", "MultiPolygon"))
    parts = F.when(F.col("t") == "Polygon", F.array(F.from_json("c", "array<array<array<double>>>"))).otherwise(F.from_json("c", "array<array<array<array<double>>>>"))
    df = rows.withColumn("part", F.explode(parts)).select(*_keep(s), sp.polygon_of(F.col("part")).alias(GEO), *_props(names))
    return _made(s, "geoJsonToPolygon", df, "polygon", {"polygon": names})


@transform("h3ColumnarToPolygon", ("columnar",), hash_column=("text", REQUIRED))
def h3_columnar_to_polygon(s: Stream, params: dict[str, Any], columns: Columns) -> Stream:
    """The outline of the H3 cell that a column names."""
    names = columns.get("polygon") or s.names

    def outline(cells: pd.Series) -> pd.Series:
        out = []
        for c in cells:
            lat, lon = h3.boundary(int(c, 16)) if c is not None else ((), ())
            ring = [{"lat": float(a), "lon": float(b)} for a, b in zip(lat, lon, strict=True)]
            out.append(ring + ring[:1] if ring else None)
        return pd.Series(out, dtype=object)

    shell = F.pandas_udf(outline, sp.RING)(text(_attr(s, params["hash_column"])))
    df = s.df.select(*_keep(s), F.struct(shell.alias("shell"), F.array().cast(f"array<{sp.RING}>").alias("holes")).alias(GEO), *[_attr(s, n).c.alias(n) for n in names])
    return _made(s, "h3ColumnarToPolygon", df, "polygon", {"polygon": names})


def _covered(s: Stream, name: str, columns: Columns, cover: Any) -> Stream:
    """A row for each cell (`_hash`, `_level`) that `cover` gives for the polygon's shell and holes."""
    names = columns.get("value") or s.names

    def run(geo: pd.DataFrame) -> pd.Series:
        ring = lambda r: np.array([(p["lat"], p["lon"]) for p in r]).reshape(-1, 2)
        return pd.Series([[{"_hash": f"{c:x}", "_level": int(r)} for c, r in cover(ring(shell), [ring(h) for h in (holes if holes is not None else ())])] if shell is not None and len(shell) > 2 else [] for shell, holes in zip(geo["shell"], geo["holes"], strict=True)], dtype=object)

    cells = F.explode(F.pandas_udf(run, "array<struct<_hash:string,_level:int>>")(F.col(GEO))).alias("__c")
    made = {"_hash": F.col("__c._hash"), "_level": F.col("__c._level")}
    df = s.df.select("*", cells)
    return _made(s, name, df.select(*_keep(s), *[made.get(n, _attr(s, n).c).alias(n) for n in names]), "columnar", {"value": names})


@transform("h3UniformCoverage", ("polygon",), hash_level=("int", 9))
def h3_uniform_coverage(s: Stream, params: dict[str, Any], columns: Columns) -> Stream:
    """The H3 cells of a level whose centre lies in the polygon."""
    level = params["hash_level"]
    return _covered(s, "h3UniformCoverage", columns, lambda shell, holes: [(c, level) for c in h3.polyfill(shell, holes, level).tolist()])


@transform("h3CompactCoverage", ("polygon",), hash_level_from=("int", 1), hash_level_to=("int", 9))
def h3_compact_coverage(s: Stream, params: dict[str, Any], columns: Columns) -> Stream:
    """H3 cells of several levels: coarse ones well inside the polygon, finer ones towards its edge, the finest beyond it by one."""
    low, high = params["hash_level_from"], params["hash_level_to"]
    return _covered(s, "h3CompactCoverage", columns, lambda shell, holes: h3.compact(shell, holes, low, high))


@transform("geoJsonToRoadMap", ("text",), name_prop=("text", REQUIRED), type_prop=("text", REQUIRED), width_prop=("text", REQUIRED), road_types=("list", ["primary", "secondary", "tertiary"]), type_multiplier__ANY=("double", None))
def geojson_to_road_map(s: Stream, params: dict[str, Any], columns: Columns) -> Stream:
    """Roads as polygons: a 12-gon at each vertex and a quadrilateral for each leg, half a road's width around its line."""
    rows = _features(s).filter(F.col("t").isin("LineString", "MultiLineString"))
    kind, width = F.col("p")[params["type_prop"]], F.col("p")[params["width_prop"]].try_cast("double")
    factor = F.lit(None).cast("double")
    for t, m in params["type_multiplier_"].items():
        factor = F.when(kind == t, F.lit(m)).otherwise(factor)
    lines = F.when(F.col("t") == "LineString", F.array(F.from_json("c", "array<array<double>>"))).otherwise(F.from_json("c", "array<array<array<double>>>"))
    rows = rows.filter(kind.isin(params["road_types"])).select(*_keep(s), "p", (width * F.coalesce(factor, F.lit(1.0)) / 2).alias("half"), F.explode(lines).alias("line")).filter(F.col("half").isNotNull() & F.col("p")[params["name_prop"]].isNotNull())
    outline = F.pandas_udf(lambda line, half: pd.Series([shapes.road(x, h) for x, h in zip(line, half, strict=True)]), f"array<{sp.RING}>")
    shell = rows.select(*_keep(s), "p", F.explode(outline("line", "half")).alias("shell"))
    geo = F.struct(F.col("shell"), F.array().cast(f"array<{sp.RING}>").alias("holes")).alias(GEO)
    names = [params["name_prop"], params["type_prop"], params["width_prop"]]
    return _made(s, "geoJsonToRoadMap", shell.select(*_keep(s), geo, *_props(names)), "polygon", {"polygon": names})


def _feature(s: Stream, geometry: Column, names: list[str]) -> Column:
    own = F.struct(*[text(_attr(s, n)).alias(n) for n in names]) if names else F.create_map().cast("map<string,string>")
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), own.alias("properties")))


@transform("pointToGeoJson", ("point",))
def point_to_geojson(s: Stream, params: dict[str, Any], columns: Columns) -> Stream:
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.col(GEO)["lon"], F.col(GEO)["lat"]).alias("coordinates"))
    return _made(s, "pointToGeoJson", s.df.select(*_keep(s), _feature(s, geometry, columns.get("point") or s.names).alias(VALUE)), "text", {})


@transform("polygonToGeoJson", ("polygon",))
def polygon_to_geojson(s: Stream, params: dict[str, Any], columns: Columns) -> Stream:
    pair = lambda ring: F.transform(ring, lambda p: F.array(p["lon"], p["lat"]))
    rings = F.concat(F.array(pair(F.col(GEO)["shell"])), F.transform(F.col(GEO)["holes"], pair))
    geometry = F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates"))
    return _made(s, "polygonToGeoJson", s.df.select(*_keep(s), _feature(s, geometry, columns.get("polygon") or s.names).alias(VALUE)), "text", {})


@transform("gpxToTrack", ("text",), userid_attr=("text", "_userid"), ts_attr=("text", "_ts"))
def gpx_to_track(s: Stream, params: dict[str, Any], columns: Columns) -> Stream:
    """Tracks of GPX documents; the user is the track's name, or else a number made of its points; times are epoch seconds, or else ordinals."""
    user, ts = params["userid_attr"], params["ts_attr"]
    read = F.pandas_udf(lambda docs: pd.Series([shapes.gpx_tracks(d, user, ts) for d in docs]), f"array<struct<user:string,track:{TRACK}>>")
    df = s.df.select(F.explode(read(VALUE)).alias("t")).select(F.col("t.user").alias(KEY), F.col("t.track").alias(GEO), F.col("t.user").alias(user))
    return _made(s, "gpxToTrack", df, "track", {"track": [user], "segment": [user], "point": [user, ts]})


@transform("trackToGpx", ("track",), name_attr=("text", None), ts_attr=("text", None))
def track_to_gpx(s: Stream, params: dict[str, Any], columns: Columns) -> Stream:
    ts = params["ts_attr"]
    name = text(_attr(s, params["name_attr"])) if params["name_attr"] else F.col(KEY).cast("string")
    write = F.pandas_udf(lambda body, names: pd.Series([shapes.gpx_document(b, n, ts) for b, n in zip(body, names, strict=True)]), "string")
    return _made(s, "trackToGpx", s.df.select(*_keep(s), write(F.to_json(F.col(GEO)), name).alias(VALUE)), "text", {})


@transform("polygonEyeView", ("point",), azimuth_prop=("text", REQUIRED), angle_prop=("text", None), angle_default=("double", 110.0))
def polygon_eye_view(s: Stream, params: dict[str, Any], columns: Columns) -> Stream:
    """A fan of 13 points at the point's radius, spread over an angle around an azimuth, closed at the point."""
    names = columns.get("polygon") or s.names
    angle = F.coalesce(double(_attr(s, params["angle_prop"])), F.lit(params["angle_default"])) if params["angle_prop"] else F.lit(params["angle_default"])
    fan = F.pandas_udf(lambda lat, lon, radius, azimuth, spread: pd.Series([shapes.fan(*x) for x in zip(lat, lon, radius, azimuth, spread, strict=True)]), sp.RING)
    shell = fan(F.col(GEO)["lat"], F.col(GEO)["lon"], F.col(GEO)["radius"], double(_attr(s, params["azimuth_prop"])), angle)
    df = s.df.select(*_keep(s), F.struct(shell.alias("shell"), F.array().cast(f"array<{sp.RING}>").alias("holes")).alias(GEO), *[_attr(s, n).c.alias(n) for n in names])
    return _made(s, "polygonEyeView", df, "polygon", {"polygon": names})
