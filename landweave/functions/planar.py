"""Measures of geometries: column expressions for boxes and kernels for any polygon.

The kernels are numpy-free, exact for simple polygons, and are called in Arrow batches.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landweave.config import RIPPLE_M_PER_DEG, RIPPLE_SQM_PER_DEG2  # noqa: F401 - scales of this module's users
from landweave.functions import geojson
from landweave.functions.columns import step
from landweave.functions.geojson import Polygon, Ring
from landweave.functions.triangles import area2, triangulate


def lat_metres(lat: Column) -> Column:
    """Metres of a degree of latitude."""
    r = F.radians(lat)
    return 111132.92 - 559.82 * F.cos(2 * r) + 1.175 * F.cos(4 * r)


def lon_metres(lat: Column) -> Column:
    """Metres of a degree of longitude."""
    r = F.radians(lat)
    return 111412.84 * F.cos(r) - 93.5 * F.cos(3 * r)


def box_area_sqm(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    lat = (miny + maxy) / 2
    return (maxx - minx) * (maxy - miny) * lat_metres(lat) * lon_metres(lat)


def overlap(alo: Column, ahi: Column, blo: Column, bhi: Column) -> Column:
    """Length that two intervals share, 0 if none."""
    return F.greatest(F.lit(0.0), F.least(ahi, bhi) - F.greatest(alo, blo))


def box_measures(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Adds iou, hausdorff_m, area_diff and centroid_m of two boxes whose bounds are columns ``{a}minx`` and so on.

    A corner's signed distances to the other box along each axis are above 0 outside it. All corners
    of a box combine its two distances along x with its two along y, so the farthest corner outside is
    that of the greatest of each, and the deepest inside that of the least of each.
    """
    c = lambda p, n: F.col(p + n)
    signed = lambda p, q, axis: [F.greatest(c(q, f"min{axis}") - c(p, f"{end}{axis}"), c(p, f"{end}{axis}") - c(q, f"max{axis}")) for end in ("min", "max")]
    ends = {}
    for k, (p, q) in enumerate(((a, b), (b, a))):
        for axis in "xy":
            ends[f"_far{axis}{k}"], ends[f"_deep{axis}{k}"] = F.greatest(*signed(p, q, axis)), F.least(*signed(p, q, axis))
    plain = lambda p: (c(p, "maxx") - c(p, "minx")) * (c(p, "maxy") - c(p, "miny"))
    inter = overlap(c(a, "minx"), c(a, "maxx"), c(b, "minx"), c(b, "maxx")) * overlap(c(a, "miny"), c(a, "maxy"), c(b, "miny"), c(b, "maxy"))
    mid = ((c(a, "miny") + c(a, "maxy")) / 2 + (c(b, "miny") + c(b, "maxy")) / 2) / 2
    out = step(pairs, **ends, _inter=inter, _a=plain(a), _b=plain(b), _mlat=lat_metres(mid), _mlon=lon_metres(mid))
    f = F.col
    outside = [F.when((f(f"_farx{k}") > 0) | (f(f"_fary{k}") > 0), F.sqrt(F.pow(F.greatest(f(f"_farx{k}"), F.lit(0.0)), F.lit(2)) + F.pow(F.greatest(f(f"_fary{k}"), F.lit(0.0)), F.lit(2)))).otherwise(0.0) for k in (0, 1)]
    inside = [F.when((f(f"_deepx{k}") <= 0) & (f(f"_deepy{k}") <= 0), -F.greatest(f"_deepx{k}", f"_deepy{k}")).otherwise(0.0) for k in (0, 1)]
    dx = ((c(a, "minx") + c(a, "maxx")) - (c(b, "minx") + c(b, "maxx"))) / 2 * f("_mlon")
    dy = ((c(a, "miny") + c(a, "maxy")) / 2 - (c(b, "miny") + c(b, "maxy")) / 2) * f("_mlat")
    out = step(out, iou=f("_inter") / (f("_a") + f("_b") - f("_inter")), hausdorff_m=F.greatest(*outside, *inside) * ((f("_mlat") + f("_mlon")) / 2),
               area_diff=F.abs(f("_a") - f("_b")) / F.greatest("_a", "_b"), centroid_m=F.sqrt(dx * dx + dy * dy))
    return out.drop(*ends, "_inter", "_a", "_b", "_mlat", "_mlon")


def clip_area2(p: list[tuple[float, float]], q: list[tuple[float, float]]) -> float:
    """Twice the area that two convex counter-clockwise rings share."""
    out = p
    for (x1, y1), (x2, y2) in zip(q, q[1:] + q[:1]):
        side = [(x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) for x, y in out]
        nxt = []
        for i, (s, e) in enumerate(zip(out, out[1:] + out[:1])):
            a, b = side[i], side[(i + 1) % len(out)]
            if a >= 0:
                nxt.append(s)
            if (a > 0 > b) or (a < 0 < b):
                t = a / (a - b)
                nxt.append((s[0] + t * (e[0] - s[0]), s[1] + t * (e[1] - s[1])))
        out = nxt
        if len(out) < 3:
            return 0.0
    return abs(area2(out))


def _local(polygons: list[Polygon], origin: tuple[float, float]) -> list[Polygon]:
    return [[[(x - origin[0], y - origin[1]) for x, y in r] for r in p] for p in polygons]


def plain_area(polygons: list[Polygon]) -> float:
    """Area in square degrees, holes taken off."""
    return sum(abs(area2(p[0])) - sum(abs(area2(h)) for h in p[1:]) for p in polygons) / 2


def convex(polygon: Polygon) -> Ring | None:
    """The counter-clockwise ring of a convex polygon without holes, or null."""
    if len(polygon) > 1:
        return None
    ring = polygon[0]
    turn = 0
    for (x0, y0), (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], ring[2:] + ring[:2]):
        c = (x1 - x0) * (y2 - y1) - (y1 - y0) * (x2 - x1)
        if c:
            if turn and (c > 0) != (turn > 0):
                return None
            turn = 1 if c > 0 else -1
    # A ring that winds more than once turns one way too.
    if not turn or sum((y1 > y0) != (y2 > y1) for (_, y0), (_, y1), (_, y2) in zip(ring, ring[1:] + ring[:1], ring[2:] + ring[:2]) if y1 != y0 and y2 != y1) > 2:
        return None
    return ring if turn > 0 else ring[::-1]


def pieces(polygons: list[Polygon], origin: tuple[float, float]) -> list[Ring]:
    """Convex counter-clockwise pieces about a local origin: a convex outline whole, others as triangles."""
    out: list[Ring] = []
    for p in _local(polygons, origin):
        ring = convex(p)
        out += [ring] if ring else [list(t) for t in triangulate(p)]
    return out


def intersection_area(a: list[Polygon], b: list[Polygon]) -> float:
    """Area in square degrees that two areas share, over pairs of convex pieces."""
    o = a[0][0][0]
    tb = pieces(b, o)
    return sum(clip_area2(s, t) for s in pieces(a, o) for t in tb) / 2


def even_odd(polygon: Polygon) -> list[Polygon]:
    """The area of rings that cross themselves or each other, by the even-odd rule, as trapezoids between the heights of corners and crossings."""
    o = polygon[0][0]
    edges = [(a, b) if a[1] < b[1] else (b, a) for r in _local([polygon], o)[0] for a, b in zip(r, r[1:] + r[:1]) if a[1] != b[1]]
    ys = {y for e in edges for _, y in e}
    for i, ((ax, ay), (bx, by)) in enumerate(edges):
        for (cx, cy), (dx, dy) in edges[:i]:
            den = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
            if den:
                t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / den
                y = ay + t * (by - ay)
                if max(ay, cy) < y < min(by, dy):
                    ys.add(y)
    out: list[Polygon] = []
    levels = sorted(ys)
    for y0, y1 in zip(levels, levels[1:]):
        mid = (y0 + y1) / 2
        at = lambda e, y: e[0][0] + (e[1][0] - e[0][0]) * (y - e[0][1]) / (e[1][1] - e[0][1])
        crossing = sorted((at(e, mid), e) for e in edges if e[0][1] < mid < e[1][1])
        for (_, e), (_, f) in zip(crossing[::2], crossing[1::2]):
            ring = [(at(e, y0), y0), (at(f, y0), y0), (at(f, y1), y1), (at(e, y1), y1)]
            ring = [p for p, q in zip(ring, ring[1:] + ring[:1]) if p != q]
            if len(ring) >= 3:
                out.append([[(x + o[0], y + o[1]) for x, y in ring]])
    return out


def _plainly_convex(ring: Ring) -> bool:
    """Whether every corner turns the same way and the ring winds once, so that no two edges meet but at their corner."""
    d = [(q[0] - p[0], q[1] - p[1]) for p, q in zip(ring, ring[1:] + ring[:1])]
    turns = [a[0] * b[1] - a[1] * b[0] for a, b in zip(d, d[1:] + d[:1])]
    if not (min(turns) > 0 or max(turns) < 0):
        return False
    rises = [y > 0 for _, y in d if y]
    return sum(a != b for a, b in zip(rises, rises[1:] + rises[:1])) == 2


def crosses_itself(polygon: Polygon) -> bool:
    """Whether edges of a polygon's rings cross or touch elsewhere than at their common corners."""
    if len(polygon) == 1 and _plainly_convex(polygon[0]):
        return False
    edges = [e for r in polygon for e in zip(r, r[1:] + r[:1])]
    turn = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    on = lambda p, q, r: min(p[0], q[0]) <= r[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= r[1] <= max(p[1], q[1])
    for i, (a, b) in enumerate(edges):
        for c, d in edges[:i]:
            shared = len({a, b} & {c, d})
            if shared == 2:
                return True
            t1, t2, t3, t4 = turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)
            if shared == 1:
                if t1 == 0 and t2 == 0:  # one edge folds back on the other
                    far = [p for p in (c, d) if p not in (a, b)] + [p for p in (a, b) if p not in (c, d)]
                    if any(on(a, b, p) for p in far[:1]) or any(on(c, d, p) for p in far[1:]):
                        return True
                continue
            if t1 * t2 < 0 and t3 * t4 < 0:
                return True
            if (t1 == 0 and on(a, b, c)) or (t2 == 0 and on(a, b, d)) or (t3 == 0 and on(c, d, a)) or (t4 == 0 and on(c, d, b)):
                return True
    return False


def _segment_distance(p: tuple[float, float], a: tuple[float, float], b: tuple[float, float]) -> float:
    dx, dy = b[0] - a[0], b[1] - a[1]
    n = dx * dx + dy * dy
    t = 0.0 if n == 0 else max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / n))
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def hausdorff(a: list[Polygon], b: list[Polygon]) -> float:
    """Discrete Hausdorff distance in degrees: vertices of either to the other's outline."""

    def one(p: list[Polygon], q: list[Polygon]) -> float:
        edges = [e for poly in q for r in poly for e in zip(r, r[1:] + r[:1])]
        return max(min(_segment_distance(v, *e) for e in edges) for poly in p for r in poly for v in r)

    return max(one(a, b), one(b, a))


def centroid(polygons: list[Polygon]) -> tuple[float, float]:
    """Centre of area."""
    x0, y0 = polygons[0][0][0]
    total = cx = cy = 0.0
    for p in polygons:
        for k, r in enumerate(p):
            sign = 1 if k == 0 else -1
            s = area2(r)
            sign *= 1 if s > 0 else -1
            for (x1, y1), (x2, y2) in zip(r, r[1:] + r[:1]):
                w = sign * ((x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0))
                total, cx, cy = total + w, cx + w * (x1 + x2 - 2 * x0), cy + w * (y1 + y2 - 2 * y0)
    return (x0 + cx / (3 * total), y0 + cy / (3 * total)) if total else (x0, y0)


def length_inside(line: Ring, polygons: list[Polygon]) -> float:
    """Length in degrees of a line within an area, by cutting its segments at the rings."""
    from landweave.functions.triangles import inside

    total = 0.0
    for a, b in zip(line, line[1:]):
        cuts = {0.0, 1.0}
        for p in polygons:
            for r in p:
                for c, d in zip(r, r[1:] + r[:1]):
                    den = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
                    if den:
                        t = ((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0])) / den
                        u = ((c[0] - a[0]) * (b[1] - a[1]) - (c[1] - a[1]) * (b[0] - a[0])) / den
                        if 0 < t < 1 and 0 <= u <= 1:
                            cuts.add(t)
        ts = sorted(cuts)
        size = math.hypot(b[0] - a[0], b[1] - a[1])
        for s, e in zip(ts, ts[1:]):
            m = (s + e) / 2
            if inside(polygons, a[0] + m * (b[0] - a[0]), a[1] + m * (b[1] - a[1])):
                total += (e - s) * size
    return total


def measures(a: str | None, b: str | None) -> tuple[float, float, float, float] | None:
    """(iou, hausdorff_m, area_diff, centroid_m) of two GeoJSON geometries; null if either can't be read.

    Where one side is a point, iou is -1 and the area difference that of nothing to something.
    """
    p, q = geojson.shape(a), geojson.shape(b)
    if not p or not q:
        return None
    if p[0] != "area" or q[0] != "area":
        return _point_measures(p, q)
    sa, sb = plain_area(p[1]), plain_area(q[1])
    inter = intersection_area(p[1], q[1])
    union = sa + sb - inter
    ca, cb = centroid(p[1]), centroid(q[1])
    m = lambda lat: (111132.92 - 559.82 * math.cos(2 * lat) + 1.175 * math.cos(4 * lat), 111412.84 * math.cos(lat) - 93.5 * math.cos(3 * lat))
    mlat, mlon = m(math.radians((ca[1] + cb[1]) / 2))
    iou = inter / union if union > 0 else float(sa == sb)
    d = math.hypot((ca[0] - cb[0]) * mlon, (ca[1] - cb[1]) * mlat)
    return iou, hausdorff(p[1], q[1]) * (mlat + mlon) / 2, abs(sa - sb) / max(sa, sb) if max(sa, sb) else 0.0, d


def _point_measures(p: tuple, q: tuple) -> tuple[float, float, float, float]:
    corners = lambda g: [g[1]] if g[0] == "point" else [v for poly in g[1] for r in poly for v in r]
    edges = lambda g: [(g[1], g[1])] if g[0] == "point" else [e for poly in g[1] for r in poly for e in zip(r, r[1:] + r[:1])]
    far = max(max(min(_segment_distance(v, *e) for e in edges(y)) for v in corners(x)) for x, y in ((p, q), (q, p)))
    ca, cb = (g[1] if g[0] == "point" else centroid(g[1]) for g in (p, q))
    lat = math.radians((ca[1] + cb[1]) / 2)
    mlat, mlon = 111132.92 - 559.82 * math.cos(2 * lat) + 1.175 * math.cos(4 * lat), 111412.84 * math.cos(lat) - 93.5 * math.cos(3 * lat)
    return -1.0, far * (mlat + mlon) / 2, 0.0 if p[0] == q[0] else 1.0, math.hypot((ca[0] - cb[0]) * mlon, (ca[1] - cb[1]) * mlat)


def measures_col(a: Column, b: Column) -> Column:
    """struct of ``measures`` over two GeoJSON columns."""

    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = [measures(p, q) or (None,) * 4 for p, q in zip(x, y)]
        return pd.DataFrame(rows, columns=["iou", "hausdorff_m", "area_diff", "centroid_m"], dtype="float64")

    return F.pandas_udf(run, "iou double, hausdorff_m double, area_diff double, centroid_m double")(a, b)
