"""Functions on points, polygons and tracks. A spatial value is a struct: point (lat, lon, radius), polygon (shell, holes), track (segments)."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..geo import geodesic, h3
from ..operators.scalar import V, double, long, text
from .registry import function

POINT = "struct<lat:double,lon:double,radius:double>"
RING = "array<struct<lat:double,lon:double>>"
POLYGON = f"struct<shell:{RING},holes:array<{RING}>>"


def arrow_udf(kind: str) -> Callable:
    """A pandas UDF that is made when it is called, so that workers can import this module without a session."""

    def wrap(f: Callable) -> Callable:
        return lambda *columns: F.pandas_udf(f, kind)(*columns)

    return wrap


def point(lat: Column, lon: Column, radius: Column | None = None) -> Column:
    return F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon"), (radius if radius is not None else F.lit(float("nan"))).cast("double").alias("radius"))


@arrow_udf("array<double>")
def inverse_udf(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    d, a, b = geodesic.inverse(lat1.to_numpy(), lon1.to_numpy(), lat2.to_numpy(), lon2.to_numpy())
    return pd.Series([None if np.isnan(x) else [x, y, z] for x, y, z in zip(d.tolist(), a.tolist(), b.tolist(), strict=True)])


@arrow_udf("double")
def distance_udf(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    return pd.Series(geodesic.inverse(lat1.to_numpy(), lon1.to_numpy(), lat2.to_numpy(), lon2.to_numpy())[0])


@arrow_udf("struct<lat:double,lon:double>")
def direct_udf(lat: pd.Series, lon: pd.Series, azimuth: pd.Series, distance: pd.Series) -> pd.DataFrame:
    a, b = geodesic.direct(lat.to_numpy(), lon.to_numpy(), azimuth.to_numpy(), distance.to_numpy())
    return pd.DataFrame({"lat": a, "lon": b})


def _ring(points: object) -> tuple[np.ndarray, np.ndarray]:
    own = [(p["lat"], p["lon"]) for p in points] if points is not None else []
    if len(own) > 1 and own[0] == own[-1]:
        own.pop()
    return np.array([a for a, _ in own]), np.array([b for _, b in own])


@arrow_udf("double")
def area_udf(shell: pd.Series, holes: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else geodesic.ring_area(*_ring(s)) - sum(geodesic.ring_area(*_ring(h)) for h in (hs if hs is not None else [])) for s, hs in zip(shell, holes, strict=True)], dtype=float)


@arrow_udf("double")
def perimeter_udf(shell: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else geodesic.ring_perimeter(*_ring(s)) for s in shell], dtype=float)


@arrow_udf(POINT)
def centroid_udf(shell: pd.Series) -> pd.DataFrame:
    rows = []
    for s in shell:
        la, lo = _ring(s)
        if not len(la):
            rows.append((np.nan,) * 3)
            continue
        a, b = geodesic.centroid(la, lo)
        rows.append((a, b, geodesic.extent_radius(a, b, la, lo)))
    return pd.DataFrame(rows, columns=["lat", "lon", "radius"])


def _numbers(x: pd.Series) -> np.ndarray:
    return x.to_numpy(dtype=float, na_value=np.nan)


@arrow_udf("string")
def h3_udf(level: pd.Series, lat: pd.Series, lon: pd.Series) -> pd.Series:
    return pd.Series(h3.addresses_of(_numbers(lat), _numbers(lon), _numbers(level)), dtype=object)


def _middle(geo: dict) -> tuple[float, float]:
    """A point, or the centroid of a polygon, or the mean of a track's points."""
    if "shell" in geo:
        return tuple(float(x) for x in geodesic.centroid(*_ring(geo["shell"])))
    if "segments" in geo:
        own = [(p["lat"], p["lon"]) for g in geo["segments"] for p in g["points"]]
        return tuple(np.mean(own, axis=0).tolist()) if own else (np.nan, np.nan)
    return geo["lat"], geo["lon"]


@arrow_udf("string")
def geo_h3_udf(geo: pd.DataFrame, level: pd.Series) -> pd.Series:
    own = np.array([_middle(dict(r)) for r in geo.to_dict("records")], dtype=float).reshape(-1, 2)
    return pd.Series(h3.addresses_of(own[:, 0], own[:, 1], _numbers(level)), dtype=object)


def _py_h3(level: int, lat: float, lon: float) -> str | None:
    return h3.addresses_of(np.array([float(lat)]), np.array([float(lon)]), np.array([float(level)]))[0]


def _py_inverse(p: dict, q: dict) -> list[float]:
    return [float(x) for x in geodesic.inverse(p["lat"], p["lon"], q["lat"], q["lon"])]


def _py_direct(p: dict, d: float, a: float) -> dict:
    lat, lon = geodesic.direct(p["lat"], p["lon"], a, d)
    return {**p, "lat": float(lat), "lon": float(lon)}


def _direct(p: V, d: V, a: V) -> V:
    got = direct_udf(p.c["lat"], p.c["lon"], double(a), double(d))
    return V(point(got["lat"], got["lon"], p.c["radius"]), "rec")


def _ring_of(coordinates: Column) -> Column:
    return F.transform(coordinates, lambda c: F.struct(F.get(c, 1).alias("lat"), F.get(c, 0).alias("lon")))


def point_from_json(s: Column) -> Column:
    c = F.from_json(s, "struct<geometry:struct<coordinates:array<double>>,coordinates:array<double>>")
    at = F.coalesce(c["geometry"]["coordinates"], c["coordinates"])
    return F.when(at.isNotNull(), point(F.get(at, 1), F.get(at, 0)))


def polygon_of(coordinates: Column) -> Column:
    return F.struct(_ring_of(F.get(coordinates, 0)).alias("shell"), F.transform(F.slice(coordinates, 2, F.greatest(F.size(coordinates) - 1, F.lit(0))), _ring_of).alias("holes"))


def polygon_from_json(s: Column) -> Column:
    c = F.from_json(s, "struct<geometry:struct<coordinates:array<array<array<double>>>>,coordinates:array<array<array<double>>>>")
    at = F.coalesce(c["geometry"]["coordinates"], c["coordinates"])
    return F.when(at.isNotNull(), polygon_of(at))


function("POINT_MAKE", (2, 3), lambda a, b, _=None: V(point(double(a), double(b)), "rec"), lambda a, b, c=None: {**(c or {}), "lat": float(a), "lon": float(b), "radius": float("nan")})
function("POI_MAKE", (3, 4), lambda a, b, r, _=None: V(point(double(a), double(b), double(r)), "rec"), lambda a, b, r, c=None: {**(c or {}), "lat": float(a), "lon": float(b), "radius": float(r)})
function("POINT_LAT", 1, lambda p: V(p.c["lat"], "double"), lambda p: p["lat"])
function("POINT_LON", 1, lambda p: V(p.c["lon"], "double"), lambda p: p["lon"])
function("POI_RADIUS", 1, lambda p: V(p.c["radius"], "double"), lambda p: p["radius"])
function("POINT_DIRECT", 3, _direct, _py_direct)
function("POINT_INVERSE", 2, lambda p, q: V(inverse_udf(p.c["lat"], p.c["lon"], q.c["lat"], q.c["lon"]), "arr"), _py_inverse)
function("POLY_AREA", 1, lambda p: V(area_udf(p.c["shell"], p.c["holes"]), "double"))
function("POLY_PERIMETER", 1, lambda p: V(perimeter_udf(p.c["shell"]), "double"))
function("POLY_HOLES", 1, lambda p: V(F.coalesce(F.size(p.c["holes"]), F.lit(0)), "int"))
function("POLY_VERTICES", 1, lambda p: V(F.size(p.c["shell"]) - F.when(F.element_at(p.c["shell"], 1) == F.element_at(p.c["shell"], -1), 1).otherwise(0), "int"))
function("TRK_SEGMENTS", 1, lambda t: V(F.size(t.c["segments"]), "int"))
function("TRK_POINTS", 1, lambda t: V(F.aggregate(t.c["segments"], F.lit(0), lambda a, s: a + F.size(s["points"])), "int"))
function("POINT_FROM_JSON", 1, lambda s: V(point_from_json(text(s)), "rec"))
function("POLY_FROM_JSON", 1, lambda s: V(polygon_from_json(text(s)), "rec"))
function("STRUCT_FROM_GEO", 1, lambda g: V(F.to_variant_object(g.c), "var"), lambda g: json.loads(json.dumps(g)))
function("GEO_DISTANCE", 2, lambda p, q: V(distance_udf(p.c["lat"], p.c["lon"], q.c["lat"], q.c["lon"]), "double"), lambda p, q: _py_inverse(p, q)[0])
function("H3", 3, lambda level, lat, lon: V(h3_udf(long(level), double(lat), double(lon)), "str"), _py_h3)
function("GEO_H3", 2, lambda g, level: V(geo_h3_udf(g.c, long(level)), "str"), lambda g, level: _py_h3(level, *_middle(g)))
function("REC_H3", 1, lambda ctx, level: V(geo_h3_udf(ctx.record().c, long(level)), "str"), record=True)
