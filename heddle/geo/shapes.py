"""Shapes made of points: outlines of roads, fans, and GPX documents."""

from __future__ import annotations

import hashlib
import json
import xml.etree.ElementTree as xml
from datetime import datetime, timezone
from typing import Any
from xml.sax.saxutils import escape

import numpy as np

from . import geodesic


def _ring(lat: np.ndarray, lon: np.ndarray) -> list[dict[str, float]]:
    own = [{"lat": float(a), "lon": float(b)} for a, b in zip(lat, lon, strict=True)]
    return [*own, own[0]]


def road(line: Any, half: float) -> list[list[dict[str, float]]]:
    """Rings around a line: one at each vertex, one along each leg."""
    points = [(float(p[1]), float(p[0])) for p in line]
    turns = np.arange(12) * 30.0
    out = [_ring(*geodesic.direct(np.full(12, a), np.full(12, b), turns, np.full(12, half))) for a, b in points]
    for (a1, b1), (a2, b2) in zip(points, points[1:], strict=False):
        _, z1, z2 = geodesic.inverse(a1, b1, a2, b2)
        lat, lon = geodesic.direct(np.array([a1, a2, a2, a1]), np.array([b1, b2, b2, b1]), np.array([z1 - 90, z2 - 90, z2 + 90, z1 + 90]), np.full(4, half))
        out.append(_ring(lat, lon))
    return out


def fan(lat: float, lon: float, radius: float, azimuth: float, angle: float) -> list[dict[str, float]] | None:
    if any(x is None or np.isnan(x) for x in (lat, lon, radius, azimuth, angle)):
        return None
    a, b = geodesic.direct(np.full(13, lat), np.full(13, lon), azimuth + angle * np.arange(-6, 7) / 12, np.full(13, radius))
    return _ring(np.append(lat, a), np.append(lon, b))


def _plain(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def gpx_tracks(document: str | None, user: str, ts: str) -> list[dict]:
    if not document:
        return []
    try:
        root = xml.fromstring(document)
    except xml.ParseError:
        return []
    out = []
    for trk in (e for e in root.iter() if _plain(e.tag) == "trk"):
        name = next((e.text for e in trk if _plain(e.tag) == "name" and e.text), None)
        segments, ordinal = [], 0
        for seg in (e for e in trk if _plain(e.tag) == "trkseg"):
            points = []
            for p in (e for e in seg if _plain(e.tag) == "trkpt"):
                stamp = next((e.text for e in p if _plain(e.tag) == "time" and e.text), None)
                when = str(int(datetime.fromisoformat(stamp.strip().replace("Z", "+00:00")).timestamp())) if stamp else str(ordinal)
                ordinal += 1
                points.append({"lat": float(p.get("lat")), "lon": float(p.get("lon")), "props": {ts: when}})
            segments.append({"props": {}, "points": points})
        if name is None:
            name = hashlib.md5(json.dumps(segments, sort_keys=True).encode()).hexdigest()
        for seg in segments:
            seg["props"] = {user: name}
            for p in seg["points"]:
                p["props"] = {user: name, **p["props"]}
        out.append({"user": name, "track": {"segments": segments}})
    return out


def gpx_document(body: str, name: str | None, ts: str | None) -> str:
    track = json.loads(body) if body else {"segments": []}
    parts = ['<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" creator="heddle" xmlns="http://www.topografix.com/GPX/1/1"><trk>']
    if name is not None:
        parts.append(f"<name>{escape(name)}</name>")
    for seg in track.get("segments", []):
        parts.append("<trkseg>")
        for p in seg.get("points", []):
            stamp = (p.get("props") or {}).get(ts) if ts else None
            when = f"<time>{datetime.fromtimestamp(float(stamp), timezone.utc).strftime('%Y-%m-%dT%H:%M:%SZ')}</time>" if stamp else ""
            parts.append(f'<trkpt lat="{p["lat"]}" lon="{p["lon"]}">{when}</trkpt>')
        parts.append("</trkseg>")
    return "".join(parts) + "</trk></gpx>"
