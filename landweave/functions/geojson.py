"""Reading geometry texts as people and programs write them.

Pure functions on one text; the operators call them in Arrow batches.
"""

from __future__ import annotations

import json
import math
from typing import Any

#: Where true positions of this project lie, in degrees.
LON_RANGE = (67.0, 98.0)
LAT_RANGE = (6.0, 38.0)

Ring = list[tuple[float, float]]
Polygon = list[Ring]


def _number(x: Any) -> float:
    if isinstance(x, bool):
        raise ValueError("a boolean is no ordinate")
    v = float(x)
    if not math.isfinite(v):
        raise ValueError("not finite")
    return v


def place(x: Any, y: Any) -> tuple[float, float] | None:
    """(lon, lat) with exchanged axes read the right way round; null if outside or unreadable."""
    try:
        a, b = _number(x), _number(y)
    except (TypeError, ValueError):
        return None
    if LON_RANGE[0] <= a <= LON_RANGE[1] and LAT_RANGE[0] <= b <= LAT_RANGE[1]:
        return a, b
    if LON_RANGE[0] <= b <= LON_RANGE[1] and LAT_RANGE[0] <= a <= LAT_RANGE[1]:
        return b, a
    return None


def _ring(points: Any) -> Ring | None:
    out = []
    for p in points:
        q = place(p[0], p[1])
        if q is None:
            return None
        out.append(q)
    if len(out) > 1 and out[0] == out[-1]:
        out.pop()
    return out if len(out) >= 3 else None


def _polygon(rings: Any) -> Polygon | None:
    out = [_ring(r) for r in rings]
    if not out or any(r is None for r in out):
        return None
    return out  # type: ignore[return-value]


def load(text: str | None) -> dict | None:
    """The geometry object of a text: a geometry or a feature; null if it can't be read."""
    if not text or not text.strip():
        return None
    try:
        g = json.loads(text)
    except (ValueError, RecursionError):
        return None
    if isinstance(g, dict) and str(g.get("type", "")).lower() == "feature":
        g = g.get("geometry")
    return g if isinstance(g, dict) else None


def shape(text: str | None) -> tuple[str, Any] | None:
    """('point', (lon, lat)) or ('area', polygons) with open rings, the first of each the outer one.

    Lines, several points, empty, damaged and outlying geometries give null.
    """
    g = load(text)
    if g is None:
        return None
    kind, c = str(g.get("type", "")).lower(), g.get("coordinates")
    try:
        if kind == "point":
            p = place(c[0], c[1])
            return ("point", p) if p else None
        if kind in ("polygon", "multipolygon"):
            polygons = [_polygon(p) for p in ([c] if kind == "polygon" else c)]
            if polygons and all(polygons):
                return "area", polygons
    except (TypeError, IndexError, KeyError, ValueError):
        pass
    return None


#: Geometry types that are accepted.
TYPES = ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon", "GeometryCollection")


def positions(c: Any, depth: int = 0) -> list[tuple[float, float]]:
    """All positions of nested coordinates, to a depth of 20."""
    if depth > 20 or not isinstance(c, (list, tuple)) or not c:
        return []
    if not isinstance(c[0], (list, tuple)):
        try:
            return [(_strict(c[0]), _strict(c[1]))] if len(c) >= 2 else []
        except (TypeError, ValueError):
            return []
    return [p for x in c for p in positions(x, depth + 1)]


def _strict(x: Any) -> float:
    """A number as it stands: texts are none here."""
    if isinstance(x, str):
        raise ValueError("a text is no ordinate")
    return _number(x)


def _rings(c: Any) -> Polygon:
    out = []
    for r in c:
        ring = [(_strict(p[0]), _strict(p[1])) for p in r]
        if len(ring) > 1 and ring[0] == ring[-1]:
            ring.pop()
        if len(ring) < 3:
            raise ValueError("a ring needs three corners")
        out.append(ring)
    return out


def parsed(text: str | None) -> tuple[str, str, Any]:
    """(outcome, type, parts) of a geometry text as it stands, axes not exchanged.

    Outcome is OK, NO_GEOMETRY, UNREADABLE, BAD_TYPE, NO_COORDINATES, EMPTY or BROKEN; parts are polygons
    with open rings, else the positions.
    """
    if text is None or not text.strip():
        return "NO_GEOMETRY", "", None
    g = load(text)
    if g is None:
        return "UNREADABLE", "", None
    kind = g.get("type")
    if kind not in TYPES:
        return "BAD_TYPE", str(kind or ""), None
    if kind == "GeometryCollection":
        inner = [positions(x.get("coordinates")) for x in g.get("geometries") or [] if isinstance(x, dict)]
        return ("OK" if any(inner) else "EMPTY"), kind, [p for x in inner for p in x]
    c = g.get("coordinates")
    if c is None:
        return "NO_COORDINATES", kind, None
    if not c:
        return "EMPTY", kind, None
    try:
        if kind == "Polygon":
            return "OK", kind, [_rings(c)]
        if kind == "MultiPolygon":
            return "OK", kind, [_rings(p) for p in c]
    except (TypeError, IndexError, KeyError, ValueError):
        return "BROKEN", kind, None
    found = positions([c] if kind == "Point" else c)
    return ("OK" if found else "BROKEN"), kind, found
