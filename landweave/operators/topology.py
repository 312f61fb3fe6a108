"""Corrections of conflicting outlines, and the ripple checks against lines and roads.

Outlines are GeoJSON areas. Differences are built exactly as convex pieces: a triangle outside a
convex ring is cut along the ring's edges, each piece outside one edge and inside those before it.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landweave.functions import geojson, planar
from landweave.functions.geojson import Polygon
from landweave.functions.triangles import area2, triangulate
from landweave.operators.matching import source_weight

Ring = list[tuple[float, float]]
#: Degrees of a cell in which lines and areas meet.
CELL_DEG = 0.001
#: Limits of the corrections, in metres and square metres.
LEAST_OVERLAP_DEG2, LEAST_OVERLAP_SQM, GAP_SQM, GAP_M, ALIGN_FROM_M, ALIGN_TO_M = 1e-12, 0.1, 50.0, 20.0, 0.5, 5.0
#: Metres of a degree in the corrections, with fewer terms than in the measures.
LAT_M, LON_M = (111_132.92, 559.82), 111_412.84


def _half(ring: Ring, a: tuple[float, float], b: tuple[float, float], inside: bool) -> Ring:
    """The part of a convex ring left of the line a-b, or right of it."""
    side = [((b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0])) * (1 if inside else -1) for x, y in ring]
    out: Ring = []
    for i, (p, q) in enumerate(zip(ring, ring[1:] + ring[:1])):
        s, e = side[i], side[(i + 1) % len(ring)]
        if s >= 0:
            out.append(p)
        if (s > 0 > e) or (s < 0 < e):
            t = s / (s - e)
            out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
    return out if len(out) >= 3 and abs(area2(out)) > 1e-18 else []


def difference(a: list[Polygon], b: list[Polygon]) -> list[Polygon]:
    """Convex pieces of ``a`` that lie outside ``b``."""
    pieces: list[Ring] = [list(t) for p in a for t in triangulate(p)]
    for cut in (list(t) for p in b for t in triangulate(p)):
        nxt: list[Ring] = []
        for piece in pieces:
            rest = piece
            for s, e in zip(cut, cut[1:] + cut[:1]):
                out = _half(rest, s, e, False)
                if out:
                    nxt.append(out)
                rest = _half(rest, s, e, True)
                if not rest:
                    break
        pieces = nxt
    return [[p] for p in pieces]


def union(a: list[Polygon], b: list[Polygon]) -> list[Polygon]:
    """``a`` and, as convex pieces, what ``b`` has beyond it."""
    return a + difference(b, a)


def to_geojson(polygons: list[Polygon]) -> str:
    return json.dumps({"type": "MultiPolygon", "coordinates": [[[list(q) for q in r + r[:1]] for r in p] for p in polygons]})


def _lat_m(lat: float) -> float:
    return LAT_M[0] - LAT_M[1] * math.cos(2 * math.radians(lat))


def _sqm(deg2: float, lat: float) -> float:
    return deg2 * _lat_m(lat) * LON_M * math.cos(math.radians(lat))


def distance(a: list[Polygon], b: list[Polygon]) -> float:
    """Least distance in degrees of two outlines that don't meet."""
    edges = lambda s: [e for poly in s for r in poly for e in zip(r, r[1:] + r[:1])]
    near = lambda s, t: min(planar._segment_distance(v, *e) for poly in s for r in poly for v in r for e in edges(t))
    return min(near(a, b), near(b, a))


def length(polygons: list[Polygon]) -> float:
    return sum(math.dist(p, q) for poly in polygons for r in poly for p, q in zip(r, r[1:] + r[:1]))


def translate(polygons: list[Polygon], dx: float, dy: float) -> list[Polygon]:
    return [[[(x + dx, y + dy) for x, y in r] for r in p] for p in polygons]


Correction = tuple[str, float, str | None, str | None]


def split_overlap(p: list[Polygon], q: list[Polygon], first_keeps: bool) -> Correction:
    """The heavier outline, the first of equals, keeps what both claim; nothing where little is shared or a side would vanish."""
    shared = planar.intersection_area(p, q)
    sqm = _sqm(shared, planar.centroid(p)[1])
    if shared < LEAST_OVERLAP_DEG2 or sqm < LEAST_OVERLAP_SQM:
        return "NONE", sqm, None, None
    rest = difference(q, p) if first_keeps else difference(p, q)
    if not rest:
        return "NONE", sqm, None, None
    a, b = (p, rest) if first_keeps else (rest, q)
    return "OVERLAP_SPLIT", sqm, to_geojson(a), to_geojson(b)


def fill_gap(p: list[Polygon], q: list[Polygon]) -> Correction:
    """Each outline joined with itself moved half the gap toward the other's centre; a gap of over 50 square metres or 20 m is left to people."""
    if planar.intersection_area(p, q) > 1e-14:
        return "NONE", 0.0, None, None
    gap = distance(p, q)
    if gap <= 0:
        return "NONE", 0.0, None, None
    ca, cb = planar.centroid(p), planar.centroid(q)
    # The gap is taken for as long as a quarter of the shorter outline.
    sqm = _sqm(gap * min(length(p), length(q)) / 4, ca[1])
    if sqm > GAP_SQM or gap * _lat_m(ca[1]) > GAP_M:
        return "GAP_LARGE", sqm, None, None
    d = max(math.dist(ca, cb), 1e-12)
    dx, dy = (cb[0] - ca[0]) / d * gap / 2, (cb[1] - ca[1]) / d * gap / 2
    return "GAP_FILL", sqm, to_geojson(union(p, translate(p, dx, dy))), to_geojson(union(q, translate(q, -dx, -dy)))


def align(p: list[Polygon], q: list[Polygon], first_keeps: bool) -> Correction:
    """The lighter outline's corners put on the heavier's corners or edges where near; offsets of 0.5 to 5 m only."""
    metres = planar.hausdorff(p, q) * _lat_m((planar.centroid(p)[1] + planar.centroid(q)[1]) / 2)
    if metres < ALIGN_FROM_M:
        return "NONE", metres, None, None
    if metres > ALIGN_TO_M:
        return "OFFSET_TOO_LARGE", metres, None, None
    keep, move = (p, q) if first_keeps else (q, p)
    reach = metres * 1.5 / planar.RIPPLE_M_PER_DEG
    edges = [e for poly in keep for r in poly for e in zip(r, r[1:] + r[:1])]
    corners = [v for poly in keep for r in poly for v in r]

    def snap(v: tuple[float, float]) -> tuple[float, float]:
        c = min(corners, key=lambda k: math.dist(k, v))
        if math.dist(c, v) <= reach:
            return c
        a, b = min(edges, key=lambda e: planar._segment_distance(v, *e))
        if planar._segment_distance(v, a, b) > reach:
            return v
        n = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
        t = max(0.0, min(1.0, ((v[0] - a[0]) * (b[0] - a[0]) + (v[1] - a[1]) * (b[1] - a[1])) / n)) if n else 0.0
        return a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])

    moved = [[[snap(v) for v in r] for r in poly] for poly in move]
    a, b = (keep, moved) if first_keeps else (moved, keep)
    return "BOUNDARY_ALIGN", metres, to_geojson(a), to_geojson(b)


def correct(kind: str, a: str | None, b: str | None, first_keeps: bool) -> Correction:
    """(outcome, amount, corrected a, corrected b) by conflict kind; amount in square metres, of an offset in metres. NO_AREA where a side is none."""
    p, q = geojson.shape(a), geojson.shape(b)
    if not p or not q or p[0] != "area" or q[0] != "area":
        return "NO_AREA", 0.0, None, None
    if kind == "OVERLAP":
        return split_overlap(p[1], q[1], first_keeps)
    if kind == "GAP":
        return fill_gap(p[1], q[1])
    if kind == "BOUNDARY_OFFSET":
        return align(p[1], q[1], first_keeps)
    return "NONE", 0.0, None, None


def corrected(kind: Column, a: Column, b: Column, first_keeps: Column) -> Column:
    """struct of outcome, amount, a_after and b_after of ``correct``."""

    def run(k: pd.Series, x: pd.Series, y: pd.Series, f: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([correct(*row) for row in zip(k, x, y, f)], columns=["outcome", "amount", "a_after", "b_after"])

    return F.pandas_udf(run, "outcome string, amount double, a_after string, b_after string")(kind, a, b, first_keeps)


def corrections(conflicts: DataFrame, members: DataFrame) -> DataFrame:
    """Corrections of conflicting pairs (parcel_id, a_record_id, b_record_id, conflict_type) by the members' outlines and source weights."""
    m = members.select("record_id", "geometry", source_weight(F.col("source_type")).alias("w"))
    p = conflicts.join(m.select(*[F.col(c).alias(f"a_{c}") for c in m.columns]), "a_record_id").join(m.select(*[F.col(c).alias(f"b_{c}") for c in m.columns]), "b_record_id")
    return p.select("parcel_id", "a_record_id", "b_record_id", "conflict_type", F.inline(F.array(corrected(F.col("conflict_type"), F.col("a_geometry"), F.col("b_geometry"), F.col("a_w") >= F.col("b_w")))))


def _line_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, case_id, part, cx, cy) of each cell that a part of a line may meet, with the part's box; a piece is at most a cell long."""
    for df in frames:
        rows = set()
        for key, case, text in zip(df["key"], df["case_id"], df["line"]):
            for k, part in enumerate(line_parts(text)):
                line = json.dumps([list(p) for p in part])
                box = _box(part)
                for a, b in zip(part, part[1:]):
                    n = max(1, math.ceil(max(abs(b[0] - a[0]), abs(b[1] - a[1])) / CELL_DEG))
                    ts = [(a[0] + (b[0] - a[0]) * i / n, a[1] + (b[1] - a[1]) * i / n) for i in range(n + 1)]
                    for (x0, y0), (x1, y1) in zip(ts, ts[1:]):
                        rows |= {(key, case, k, line, i, j, *box) for i in _span(x0, x1) for j in _span(y0, y1)}
        yield pd.DataFrame(sorted(rows, key=repr), columns=["key", "case_id", "part", "line", "cx", "cy", "lx0", "ly0", "lx1", "ly1"])


def _box(positions: list[tuple[float, float]]) -> tuple[float, float, float, float]:
    xs, ys = [p[0] for p in positions], [p[1] for p in positions]
    return min(xs), min(ys), max(xs), max(ys)


def _span(a: float, b: float) -> range:
    return range(math.floor(min(a, b) / CELL_DEG), math.floor(max(a, b) / CELL_DEG) + 1)


def _area_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in frames:
        rows = []
        for key, case, text in zip(df["area_key"], df["case_id"], df["area"]):
            s = geojson.shape(text)
            if s and s[0] == "area":
                x0, y0, x1, y1 = _box([v for poly in s[1] for r in poly for v in r])
                rows += [(key, case, text, i, j, x0, y0, x1, y1) for i in _span(x0, x1) for j in _span(y0, y1)]
        yield pd.DataFrame(rows, columns=["area_key", "case_id", "area", "cx", "cy", "ax0", "ay0", "ax1", "ay1"])


def line_parts(text: str | None) -> list[list[tuple[float, float]]]:
    """Lines of a LineString or MultiLineString with exchanged axes put right; none where a position is outside or unreadable."""
    g = geojson.load(text)
    kind = str(g.get("type", "")).lower() if g else ""
    if kind not in ("linestring", "multilinestring"):
        return []
    try:
        parts = [[geojson.place(p[0], p[1]) for p in line] for line in ([g["coordinates"]] if kind == "linestring" else g["coordinates"])]
    except (TypeError, IndexError, KeyError):
        return []
    return [] if any(p is None for line in parts for p in line) else [line for line in parts if len(line) > 1]  # type: ignore[misc]


def lines_on_areas(lines: DataFrame, areas: DataFrame, apart: bool = True) -> DataFrame:
    """(key, area_key, inside_m, on_outline_m) of lines (key, case_id, line) and areas (area_key, case_id, area) of one case that may meet.

    Every cell that a line's pieces cross is joined with every cell of an area's box; keys are unique.
    Without ``apart``, a part and an area whose boxes don't meet, which would have no length, are left out before they are measured.
    """
    types = lambda df, k: df.schema[k].dataType.simpleString()
    left = lines.mapInPandas(_line_rows, f"key {types(lines, 'key')}, case_id string, part int, line string, cx bigint, cy bigint, lx0 double, ly0 double, lx1 double, ly1 double")
    right = areas.mapInPandas(_area_rows, f"area_key {types(areas, 'area_key')}, case_id string, area string, cx bigint, cy bigint, ax0 double, ay0 double, ax1 double, ay1 double")
    meet = left.drop("line").join(right.drop("area"), ["case_id", "cx", "cy"])
    if not apart:
        c = F.col
        meet = meet.where((c("lx0") <= c("ax1") + 1e-9) & (c("ax0") <= c("lx1") + 1e-9) & (c("ly0") <= c("ay1") + 1e-9) & (c("ay0") <= c("ly1") + 1e-9))
    meet = meet.select("key", "part", "area_key").distinct()
    whole = meet.join(left.select("key", "part", "line").distinct(), ["key", "part"]).join(areas.select("area_key", "area"), "area_key")
    m = whole.select("key", "area_key", F.inline(F.array(line_measures(F.col("line"), F.col("area")))))
    return m.groupBy("key", "area_key").agg(F.sum("inside_m").alias("inside_m"), F.sum("on_outline_m").alias("on_outline_m"))


def crossing_m(line: list[tuple[float, float]], area: list[Polygon]) -> float:
    """Metres of a line inside an area, by the ripple checks' rough scale."""
    return planar.length_inside(line, area) * planar.RIPPLE_M_PER_DEG


def collinear_m(pts: list[tuple[float, float]], area: list[Polygon]) -> float:
    """Metres that a line runs on an area's outline; a line that only crosses it has none."""
    total = 0.0
    for a, b in zip(pts, pts[1:]):
        n = math.dist(a, b)
        for poly in area:
            for r in poly:
                for c, d in zip(r, r[1:] + r[:1]):
                    cross = lambda p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])  # noqa: B023, E731
                    if n and cross(c) == 0 and cross(d) == 0:
                        at = sorted(((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / n for p in (c, d))
                        total += max(0.0, min(n, at[1]) - max(0.0, at[0]))
    return total * planar.RIPPLE_M_PER_DEG


def line_measures(line: Column, area: Column) -> Column:
    """struct of inside_m and on_outline_m of a line (JSON positions) and an area."""

    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = []
        for p, q in zip(x, y):
            pts, s = [tuple(v[:2]) for v in json.loads(p)], geojson.shape(q)
            rows.append((crossing_m(pts, s[1]), collinear_m(pts, s[1])) if s and s[0] == "area" else (None, None))
        return pd.DataFrame(rows, columns=["inside_m", "on_outline_m"], dtype="float64")

    return F.pandas_udf(run, "inside_m double, on_outline_m double")(line, area)
