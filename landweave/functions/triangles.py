"""Ear clipping, a bounding-volume hierarchy over triangles, and exact point tests with numpy."""

from __future__ import annotations

import numpy as np

from landweave.functions.geojson import Polygon, Ring

Triangle = tuple[tuple[float, float], tuple[float, float], tuple[float, float]]


def _cross(o: tuple[float, float], a: tuple[float, float], b: tuple[float, float]) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def area2(ring: Ring) -> float:
    """Twice the signed area, about the first vertex so that small rings far from 0 keep their digits."""
    x0, y0 = ring[0]
    return sum((a[0] - x0) * (b[1] - y0) - (b[0] - x0) * (a[1] - y0) for a, b in zip(ring, ring[1:] + ring[:1]))


def _bridge(outer: Ring, hole: Ring) -> Ring:
    """The outer ring with a hole joined to it by a bridge to a visible vertex."""
    k = max(range(len(hole)), key=lambda i: hole[i])
    h = hole[k]

    def crosses(a: tuple[float, float], b: tuple[float, float]) -> bool:
        return _cross(h, p, a) * _cross(h, p, b) < 0 and _cross(a, b, h) * _cross(a, b, p) < 0

    edges = list(zip(outer, outer[1:] + outer[:1])) + list(zip(hole, hole[1:] + hole[:1]))
    order = sorted(range(len(outer)), key=lambda i: (outer[i][0] - h[0]) ** 2 + (outer[i][1] - h[1]) ** 2)
    at = order[0]
    for i in order:
        p = outer[i]
        if not any(crosses(a, b) for a, b in edges):
            at = i
            break
    return outer[: at + 1] + hole[k:] + hole[: k + 1] + outer[at:]


def triangulate(polygon: Polygon) -> list[Triangle]:
    """Triangles of a polygon with holes by ear clipping.

    Where no ear is left (a ring that crosses itself) the rest is cut into a fan; callers that need
    exact membership test the polygon again.
    """
    outer = polygon[0] if area2(polygon[0]) > 0 else polygon[0][::-1]
    if len(polygon) == 1 and len(outer) <= 4 and all(_cross(a, b, c) > 0 for a, b, c in zip(outer, outer[1:] + outer[:1], outer[2:] + outer[:2])):
        return [(outer[0], outer[i], outer[i + 1]) for i in range(1, len(outer) - 1)]  # every corner is an ear
    for hole in sorted(polygon[1:], key=lambda r: -max(p[0] for p in r)):
        outer = _bridge(outer, hole if area2(hole) < 0 else hole[::-1])
    ring = list(outer)
    out: list[Triangle] = []
    while len(ring) > 3:
        for i in range(len(ring)):
            a, b, c = ring[i - 1], ring[i], ring[(i + 1) % len(ring)]
            turn = _cross(a, b, c)
            if turn < 0:
                continue
            if turn > 0 and any(p not in (a, b, c) and _cross(a, b, p) >= 0 and _cross(b, c, p) >= 0 and _cross(c, a, p) >= 0 for p in ring):
                continue
            if turn > 0:
                out.append((a, b, c))
            ring.pop(i)
            break
        else:
            out += [(ring[0], ring[i], ring[i + 1]) for i in range(1, len(ring) - 1)]
            return out
    if len(ring) == 3:
        out.append((ring[0], ring[1], ring[2]))
    return out


def inside(polygons: list[Polygon], x: float, y: float) -> bool:
    """Even-odd test over all rings, edges straight in lon/lat; a point on an outer edge counts as inside."""
    for polygon in polygons:
        odd = False
        for ring in polygon:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
                if min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2) and (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1):
                    return True
                if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                    odd = not odd
        if odd:
            return True
    return False


def inside_many(edges: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """``inside`` of many points at once; ``edges`` has rows (part, x1, y1, x2, y2) of all that meet the points' range of y.

    The even-odd test is made for each part, a polygon of its own; a point on an edge is inside.
    """
    part, (x1, y1, x2, y2) = edges[:, 0], edges[:, 1:].T
    x, y = xy[:, :1], xy[:, 1:]
    dx, dy = x2 - x1, y2 - y1
    on = (np.minimum(x1, x2) <= x) & (x <= np.maximum(x1, x2)) & (np.minimum(y1, y2) <= y) & (y <= np.maximum(y1, y2)) & (dx * (y - y1) == dy * (x - x1))
    with np.errstate(divide="ignore", invalid="ignore"):
        right = ((y1 > y) != (y2 > y)) & (x < dx * (y - y1) / dy + x1)
    got = on.any(axis=1)
    for p in np.unique(part):
        got |= right[:, part == p].sum(axis=1) % 2 == 1
    return got


class Hierarchy:
    """Bounding boxes of triangles in a binary tree, split at the median of the longer axis."""

    LEAF = 8

    def __init__(self, triangles: np.ndarray):
        """``triangles`` is n x 3 x 2."""
        self.tri = triangles
        low, high = triangles.min(axis=1), triangles.max(axis=1)
        mid = (low + high) / 2
        self.nodes: list[tuple[np.ndarray, np.ndarray, int, int, np.ndarray | None]] = []

        def build(idx: np.ndarray) -> int:
            at = len(self.nodes)
            lo, hi = low[idx].min(axis=0), high[idx].max(axis=0)
            self.nodes.append((lo, hi, -1, -1, idx))
            if len(idx) > self.LEAF:
                axis = int(np.argmax(hi - lo))
                half = len(idx) // 2
                part = idx[np.argpartition(mid[idx, axis], half)]
                left, right = build(part[:half]), build(part[half:])
                self.nodes[at] = (lo, hi, left, right, None)
            return at

        if len(triangles):
            build(np.arange(len(triangles)))

    def hits(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, triangle) index pairs where the closed triangle holds the point, by descent with all points at once."""
        got_p: list[np.ndarray] = []
        got_t: list[np.ndarray] = []
        stack = [(0, np.arange(len(points)))] if self.nodes and len(points) else []
        while stack:
            at, idx = stack.pop()
            lo, hi, left, right, tri = self.nodes[at]
            p = points[idx]
            idx = idx[((p >= lo) & (p <= hi)).all(axis=1)]
            if not len(idx):
                continue
            if tri is None:
                stack += [(left, idx), (right, idx)]
                continue
            p, t = points[idx][:, None, :], self.tri[tri][None, :, :, :]
            side = [
                (t[:, :, (i + 1) % 3, 0] - t[:, :, i, 0]) * (p[:, :, 1] - t[:, :, i, 1]) - (t[:, :, (i + 1) % 3, 1] - t[:, :, i, 1]) * (p[:, :, 0] - t[:, :, i, 0])
                for i in range(3)
            ]
            eps = 1e-15  # candidates only: the exact test follows
            ok = ((side[0] >= -eps) & (side[1] >= -eps) & (side[2] >= -eps)) | ((side[0] <= eps) & (side[1] <= eps) & (side[2] <= eps))
            a, b = np.nonzero(ok)
            got_p.append(idx[a])
            got_t.append(tri[b])
        if not got_p:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate(got_p), np.concatenate(got_t)
