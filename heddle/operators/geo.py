"""Spatial operations: centroids, track statistics, and spatial joins by grid cells."""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spatial as sp
from ..geo import geodesic
from ..lang.lexer import ScriptError
from ..stream import GEO, KEY, RecordContext, Stream, quoted
from .analytics import Streams
from .registry import SPATIAL, operation
from .relational import dealt
from .scalar import text

_METRES = 110_000.0  # less than a degree of latitude has


@operation("spatialCentroid", ("polygon", "track"), also_transform=True, tracks_mode=("SEGMENTS|TRACKS|BOTH", "BOTH"))
def spatial_centroid(inputs: Streams, params: dict[str, Any]) -> Streams:
    s = inputs[""]
    geo = F.col(GEO)
    flat = lambda segs: F.flatten(F.transform(segs, lambda g: F.transform(g["points"], lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))))
    if s.kind == "polygon":
        df = s.df.withColumn(GEO, sp.centroid_udf(geo["shell"]))
        names = s.columns
    else:
        track, segments = flat(geo["segments"]), F.transform(geo["segments"], lambda g: F.transform(g["points"], lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))))
        rings = {"TRACKS": F.array(track), "SEGMENTS": segments, "BOTH": F.concat(F.array(track), segments)}[params["tracks_mode"]]
        names = s.columns
        df = s.df.withColumn("__ring", F.explode(rings)).withColumn(GEO, mean_udf("__ring")).drop("__ring")
    return {"": s.made("GENERATED", "spatialCentroid", df=df, kind="point", attrs={"point": names})}


@sp.arrow_udf(sp.POINT)
def mean_udf(ring: pd.Series) -> pd.DataFrame:
    """The mean of a line's points, with the distance to its extremes."""
    rows = []
    for r in ring:
        la, lo = np.array([p["lat"] for p in r]), np.array([p["lon"] for p in r])
        rows.append((np.nan,) * 3 if not len(la) else (la.mean(), lo.mean(), geodesic.extent_radius(la.mean(), lo.mean(), la, lo)))
    return pd.DataFrame(rows, columns=["lat", "lon", "radius"])


_PINS = "SEGMENT_CENTROIDS|TRACK_CENTROIDS|SEGMENT_STARTS|TRACK_STARTS|INPUT_PINS"


@operation("trackStats", {"tracks": ("track",), "pins": ("point",)}, optional=("pins",), pinning_mode=(_PINS, "INPUT_PINS"), pins_userid_prop=("text", None), tracks_userid_prop=("text", "_userid"), tracks_ts_prop=("text", "_ts"))
def track_stats(inputs: Streams, params: dict[str, Any]) -> Streams:
    """_points, _duration, _distance, _radius and azimuths of tracks, segments and points; a radius is measured from the pin."""
    s, mode, ts = inputs["tracks"], params["pinning_mode"], params["tracks_ts_prop"]
    df = s.df
    if mode == "INPUT_PINS":
        pins = inputs.get("pins")
        if pins is None:
            raise ScriptError("trackStats with INPUT_PINS needs pins")
        ctx = RecordContext(pins)
        pin_user = text(ctx.attr(params["pins_userid_prop"])) if params["pins_userid_prop"] else F.col(KEY).cast("string")
        own = pins.df.select(pin_user.alias("__user"), F.col(GEO)["lat"].alias("__lat"), F.col(GEO)["lon"].alias("__lon")).dropDuplicates(["__user"])
        df = df.join(own, text(RecordContext(s).attr(params["tracks_userid_prop"])) == F.col("__user"), "inner").drop("__user")
    else:
        df = df.withColumns({"__lat": F.lit(None).cast("double"), "__lon": F.lit(None).cast("double")})

    def stats(points: list[dict], pin: tuple[float, float]) -> tuple[dict, list[dict]]:
        la, lo = np.array([p["lat"] for p in points]), np.array([p["lon"] for p in points])
        when = np.array([float((p["props"] or {}).get(ts) or "nan") for p in points])
        leg, azi, _ = geodesic.inverse(la[:-1], lo[:-1], la[1:], lo[1:]) if len(la) > 1 else (np.zeros(0),) * 3
        gap = np.diff(when)
        away = geodesic.inverse(pin[0], pin[1], la, lo)[0]
        to, home, _ = geodesic.inverse(pin[0], pin[1], la, lo)[0], *geodesic.inverse(la, lo, pin[0], pin[1])[1:]
        whole = {"_points": len(la), "_duration": float(np.nansum(gap)), "_distance": float(leg.sum()), "_radius": float(away.max())}
        each = [{"_points": 1, "_duration": float(gap[i - 1]) if i else 0.0, "_distance": float(leg[i - 1]) if i else 0.0, "_radius": float(to[i]), "_azi_from_prev": float(azi[i - 1]) if i else None, "_azi_to_next": float(azi[i]) if i < len(la) - 1 else None, "_azi_to_pin": float(home[i])} for i in range(len(la))]
        return whole, each

    def shown(d: dict) -> dict[str, str]:
        return {k: str(v) for k, v in d.items() if v is not None and v == v}

    def run(geo: pd.DataFrame, lat: pd.Series, lon: pd.Series) -> pd.Series:
        out = []
        for segments, a, b in zip(geo["segments"], lat, lon, strict=True):
            segs = [{"props": dict(g["props"] or {}), "points": [{**p, "props": dict(p["props"] or {})} for p in g["points"]]} for g in segments]
            every = [p for g in segs for p in g["points"]]
            if not every:
                out.append({"segments": [], "stats": {}})
                continue
            mean = lambda ps: (float(np.mean([p["lat"] for p in ps])), float(np.mean([p["lon"] for p in ps])))
            first = lambda ps: (ps[0]["lat"], ps[0]["lon"])
            pin_of = {"SEGMENT_CENTROIDS": mean, "SEGMENT_STARTS": first}.get(mode)
            track_pin = mean(every) if mode in ("TRACK_CENTROIDS", "SEGMENT_CENTROIDS") else (a, b) if mode == "INPUT_PINS" else first(every)
            total = {"_points": 0, "_duration": 0.0, "_distance": 0.0, "_radius": float(geodesic.inverse(track_pin[0], track_pin[1], np.array([p["lat"] for p in every]), np.array([p["lon"] for p in every]))[0].max())}
            new = []
            for g in (g for g in segs if g["points"]):
                whole, each = stats(g["points"], pin_of(g["points"]) if pin_of else track_pin)
                for k in ("_points", "_duration", "_distance"):
                    total[k] += whole[k]
                new.append({"props": {**g["props"], **shown(whole)}, "points": [{**p, "props": {**p["props"], **shown(x)}} for p, x in zip(g["points"], each, strict=True)]})
            out.append({"segments": new, "stats": shown(total)})
        return pd.DataFrame(out)

    kind = "struct<segments:array<struct<props:map<string,string>,points:array<struct<lat:double,lon:double,props:map<string,string>>>>>,stats:map<string,string>>"
    measured = F.pandas_udf(run, kind)(F.col(GEO), "__lat", "__lon")
    made = ["_points", "_duration", "_distance", "_radius"]
    keep = [F.col(quoted(c)) for c in s.columns if c not in made]
    df = df.withColumn("__m", measured).select(KEY, F.struct(F.col("__m.segments").alias("segments")).alias(GEO), *keep, *[F.col("__m.stats")[m].try_cast("double").alias(m) for m in made])
    attrs = {"track": [*s.attrs.get("track", s.columns), *made], "segment": [*s.attrs.get("segment", []), *made], "point": [*s.attrs.get("point", []), *made, "_azi_from_prev", "_azi_to_next", "_azi_to_pin"]}
    return {"": s.made("AUGMENTED", "trackStats", df=df, attrs=attrs)}


# -- spatial joins
#: Grids by level: level k has cells of 360 / 2^k degrees.
_COARSE, _FINE = 3, 20
PLACE = ["__la", "__lo"]


def level_of(extent: Column) -> Column:
    """The finest grid whose cells are at least as large as a shape's extent, so that a shape of any size lies in few cells."""
    fits = F.floor(F.log2(F.lit(360.0) / F.greatest(extent, F.lit(360.0 / 2**_FINE))))
    return F.greatest(F.lit(_COARSE), F.least(F.lit(_FINE), fits)).cast("int")


def _across(level: Column) -> Column:
    return F.pow(F.lit(2.0), level).cast("long")


def cell_of(lat: Column, lon: Column, level: Column) -> Column:
    size = F.lit(360.0) / _across(level)
    return F.struct(level.alias("k"), F.floor((lat + 90) / size).alias("y"), F.pmod(F.floor((lon + 180) / size), _across(level)).alias("x"))


def cells_over(low_lat: Column, high_lat: Column, low_lon: Column, high_lon: Column, level: Column) -> Column:
    """All cells of a box; longitudes may go on beyond the date line."""
    size = F.lit(360.0) / _across(level)
    ys = F.sequence(F.floor((low_lat + 90) / size), F.floor((high_lat + 90) / size))
    xs = F.array_distinct(F.transform(F.sequence(F.floor((low_lon + 180) / size), F.floor((high_lon + 180) / size)), lambda x: F.pmod(x, _across(level))))
    return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(level.alias("k"), y.alias("y"), x.alias("x")))))


def with_cells(points: DataFrame, shapes: DataFrame) -> DataFrame:
    """Places once for each level that shapes have (18 at most), with their cell."""
    levels = sorted(r["__level"] for r in shapes.select("__level").distinct().collect())
    at = F.explode(F.array(*[F.lit(k) for k in levels])) if levels else F.explode(F.array().cast("array<int>"))
    points = points.withColumn("__k", at)
    return points.withColumn("__cell", cell_of(F.col("__la"), F.col("__lo"), F.col("__k"))).drop("__k")


def _merged(points: Stream, shapes: Stream, hits: DataFrame, more: list[str]) -> tuple[DataFrame, list[str]]:
    """Attributes of both; the point's win."""
    names = list(dict.fromkeys([*points.columns, *shapes.columns, *more]))
    own = [F.col(quoted(f"p.{n}")) if n in points.columns else F.col(quoted(f"s.{n}")) if n in shapes.columns else F.col(n) for n in names]
    return hits.select(F.col("__pkey").alias(KEY), F.col("__pgeo").alias(GEO), *[c.alias(n) for c, n in zip(own, names, strict=True)]), names


def _placed(points: Stream) -> DataFrame:
    """Records with the place that they are tested at."""
    return points.df.withColumn("__at", _centre(points)).withColumns({"__la": F.col("__at")["lat"], "__lo": F.col("__at")["lon"]}).drop("__at")


def _expanded(points: Stream, shapes: Stream, own: DataFrame, shape: dict[str, Column], pairs: DataFrame) -> DataFrame:
    """Pairs of a place and a shape as pairs of records. They are dealt evenly before each join, since a place may have many points, and a shape many records."""
    p = own.select(F.col(KEY).alias("__pkey"), F.col(GEO).alias("__pgeo"), *PLACE, *[F.col(quoted(c)).alias(f"p.{c}") for c in points.columns])
    s = shapes.df.select(*[c.alias(n) for n, c in shape.items()], *[F.col(quoted(c)).alias(f"s.{c}") for c in shapes.columns])
    return dealt(dealt(pairs).join(p, PLACE)).join(s, list(shape))


def _centre(s: Stream) -> Column:
    g = F.col(GEO)
    if s.kind == "point":
        return F.struct(g["lat"].alias("lat"), g["lon"].alias("lon"))
    if s.kind == "polygon":
        c = sp.centroid_udf(g["shell"])
    else:
        c = mean_udf(F.flatten(F.transform(g["segments"], lambda x: F.transform(x["points"], lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))))))
    return F.struct(c["lat"].alias("lat"), c["lon"].alias("lon"))


def in_ring(ring: Column, lat: Column, lon: Column) -> Column:
    """Ray casting over the sides of a ring, as an expression."""
    n = F.size(ring)
    crossings = F.aggregate(
        F.sequence(F.lit(0), n - 1),
        F.lit(0),
        lambda a, i: a + F.when(((F.get(ring, i)["lat"] > lat) != (F.get(ring, (i + 1) % n)["lat"] > lat)) & (lon < (F.get(ring, (i + 1) % n)["lon"] - F.get(ring, i)["lon"]) * (lat - F.get(ring, i)["lat"]) / (F.get(ring, (i + 1) % n)["lat"] - F.get(ring, i)["lat"]) + F.get(ring, i)["lon"]), 1).otherwise(0),
    )
    return F.when(n > 0, crossings % 2 == 1).otherwise(F.lit(False))


def _outcome(points: Stream, shapes: Stream, own: DataFrame, shape: dict[str, Column], pairs: DataFrame, mode: str, what: str, more: list[str]) -> Streams:
    """target: for COPY each hit, with the attributes of both; else the points that have one, as they are. evicted: the other points.

    Points of one place are hit alike, and equal shapes hit alike, so pairs are of places and shapes that differ.
    """
    found = pairs.select(*PLACE).distinct()
    if mode == "COPY":
        df, names = _merged(points, shapes, _expanded(points, shapes, own, shape, pairs), more)
        target = points.made("FILTERED", what, df=df, attrs={**points.attrs, points.level: names})
    else:
        target = points.made("FILTERED", what, df=own.join(found, PLACE, "left_semi").drop(*PLACE))
    return {"target": target, "evicted": points.made("FILTERED", what, df=own.join(found, PLACE, "left_anti").drop(*PLACE))}


@operation("areaCovers", {"points": SPATIAL, "polygons": ("polygon",)}, outputs=("target", "evicted"), optional=("evicted",), encounter_mode=("ONCE|COPY", "COPY"))
def area_covers(inputs: Streams, params: dict[str, Any]) -> Streams:
    """Points (or centroids) in polygons: an equi-join of places and distinct shapes on the cells of grids, then the exact test."""
    points, shapes = inputs["points"], inputs["polygons"]
    own, body = _placed(points), F.to_json(GEO)
    shape = {"__sid": F.xxhash64(body), "__sid2": F.xxhash64(F.lit(17), body)}  # 128 bits that equal shapes share and, but for chance, no others
    s = shapes.df.select(*[c.alias(n) for n, c in shape.items()], F.col(GEO).alias("__sgeo")).dropDuplicates([*shape])
    shell = F.col("__sgeo")["shell"]
    box = {"__s": F.array_min(F.transform(shell, lambda x: x["lat"])), "__n": F.array_max(F.transform(shell, lambda x: x["lat"])), "__w": F.array_min(F.transform(shell, lambda x: x["lon"])), "__e": F.array_max(F.transform(shell, lambda x: x["lon"]))}
    s = s.withColumns(box).filter("__n is not null and __e is not null")
    s = s.withColumn("__level", level_of(F.greatest(F.col("__n") - F.col("__s"), F.col("__e") - F.col("__w"))))
    p = with_cells(own.select(*PLACE).distinct(), s)
    s = s.withColumn("__cell", F.explode(cells_over(F.col("__s"), F.col("__n"), F.col("__w"), F.col("__e"), F.col("__level"))))
    lat, lon = F.col("__la"), F.col("__lo")
    inside = in_ring(F.col("__sgeo")["shell"], lat, lon) & ~F.exists(F.col("__sgeo")["holes"], lambda h: in_ring(h, lat, lon))
    pairs = p.join(s, "__cell").filter(lat.between(F.col("__s"), F.col("__n")) & lon.between(F.col("__w"), F.col("__e")) & inside).select(*PLACE, *shape)
    return _outcome(points, shapes, own, shape, pairs, params["encounter_mode"], "areaCovers", [])


@operation("proximity", {"points": SPATIAL, "pois": ("point",)}, outputs=("target", "evicted"), optional=("evicted",), encounter_mode=("ONCE|COPY|ALL", "COPY"))
def proximity(inputs: Streams, params: dict[str, Any]) -> Streams:
    """Points within the radius of points of interest: places and distinct circles by cells of grids, then geodesic distances. ALL: near every one of them."""
    points, pois = inputs["points"], inputs["pois"]
    own = _placed(points)
    shape = {"__lat": F.col(GEO)["lat"], "__lon": F.col(GEO)["lon"], "__r": F.col(GEO)["radius"]}
    circles = pois.df.select(*[c.alias(n) for n, c in shape.items()]).distinct()
    s = circles.filter(F.col("__r") >= 0)
    up = F.col("__r") / _METRES
    side = F.least(up / F.greatest(F.cos(F.radians(F.least(F.abs(F.col("__lat")) + up, F.lit(89.9)))), F.lit(0.001)), F.lit(180.0))
    s = s.withColumn("__level", level_of(2 * F.greatest(up, side)))
    p = with_cells(own.select(*PLACE).distinct(), s)
    near = s.withColumn("__cell", F.explode(cells_over(F.greatest(F.col("__lat") - up, F.lit(-90.0)), F.least(F.col("__lat") + up, F.lit(90.0)), F.col("__lon") - side, F.col("__lon") + side, F.col("__level"))))
    pairs = p.join(near, "__cell").withColumn("_distance", sp.distance_udf("__la", "__lo", "__lat", "__lon")).filter(F.col("_distance") <= F.col("__r")).select(*PLACE, *shape, "_distance")
    if params["encounter_mode"] == "ALL":
        # circles count once on both sides, however many points of interest share one; one without a radius is near nothing
        whole = circles.agg(F.count("*").alias("n"), F.min(F.coalesce(F.col("__r") >= 0, F.lit(False))).alias("all")).first()
        need = whole["n"] if whole["all"] else -1
        pairs = pairs.groupBy(*PLACE).agg(F.count("*").alias("n")).filter(F.col("n") == need)
    return _outcome(points, pois, own, shape, pairs, params["encounter_mode"], "proximity", ["_distance"])
