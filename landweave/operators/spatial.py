"""Points near other points, and the areas around points, among hundreds of millions.

Near: both sides are hashed to cells a little wider than the distance; the observations are copied
to the neighbouring cells, so that one equi-join finds every pair, and the great-circle distance
decides. Within: areas are cut into triangles by ear clipping, triangles are copied to the cells of
a coarse grid that their boxes meet, and each cell's triangles form a bounding-volume hierarchy
through which the cell's points descend all at once; candidates are tested exactly against the
edges of their polygon in the cell's band of latitude, and an area that two of its triangles or boundaries report counts once. A cell with many
points is salted: its points are spread over parts and its other side is copied to each, by a
table of cell counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landweave.functions import geojson, triangles
from landweave.functions.columns import salted
from landweave.session import Stage

EARTH_M = 6_371_008.8
#: Rows of one side of a cell that a task takes; a fuller cell is salted.
CELL_ROWS = 20_000
#: Points that one exact test holds against an area's edges at once.
TEST_POINTS = 4096


def right_way(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(lon, lat) with exchanged axes put right; both null for impossible positions."""
    (w, e), (s, n) = geojson.LON_RANGE, geojson.LAT_RANGE
    ok = lon.between(w, e) & lat.between(s, n)
    swapped = lat.between(w, e) & lon.between(s, n)
    return F.when(ok, lon).when(swapped, lat), F.when(ok, lat).when(swapped, lon)


def _shapes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in frames:
        rows = []
        for key, text in zip(df["key"], df["geometry"]):
            s = geojson.shape(text)
            if s and s[0] == "point":
                rows.append((key, s[1][0], s[1][1], None))
            elif s:
                rows.append((key, None, None, [[[list(map(float, p)) for p in r] for r in poly] for poly in s[1]]))
        yield pd.DataFrame(rows, columns=["key", "lon", "lat", "area"])


def shapes(rows: DataFrame, key: str, geometry: str) -> DataFrame:
    """(key, lon, lat, area): a point's position, or an area's polygons; other geometries give no row."""
    return rows.select(F.col(key).cast("bigint").alias("key"), F.col(geometry).alias("geometry")).mapInPandas(
        _shapes, "key bigint, lon double, lat double, area array<array<array<array<double>>>>"
    )


def great_circle_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Distance by the haversine formula on a sphere of ``EARTH_M``."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(dlat), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), F.lit(2))
    return F.asin(F.sqrt(F.least(F.lit(1.0), h))) * (2 * EARTH_M)


def near(marks: DataFrame, points: DataFrame, metres: float) -> DataFrame:
    """(id, key, distance_m) of marks (id, lon, lat) and points (key, lon, lat) at most ``metres`` apart.

    Every row counts, repeated ones too; null positions have no neighbours.
    """
    lat_step = metres * 1.001 / (np.pi / 180 * EARTH_M)
    # Cells are as many degrees of longitude wide as the distance takes in the latitude band farthest from the equator.
    lon_step = lat_step / np.cos(np.radians(geojson.LAT_RANGE[1] + 1))
    cx, cy = F.floor(F.col("lon") / lon_step), F.floor(F.col("lat") / lat_step)
    m = marks.where(F.col("lon").isNotNull() & F.col("lat").isNotNull()).select("id", "lon", "lat", cx.alias("cx"), cy.alias("cy"))
    p = points.where(F.col("lon").isNotNull() & F.col("lat").isNotNull()).select(
        "key", F.col("lon").alias("lon2"), F.col("lat").alias("lat2"), cx.alias("px"), cy.alias("py")
    )
    p = p.withColumn("cx", F.explode(F.sequence(F.col("px") - 1, F.col("px") + 1))).withColumn("cy", F.explode(F.sequence(F.col("py") - 1, F.col("py") + 1))).drop("px", "py")
    m, p = salted(m, p, ["cx", "cy"], "id", "key", CELL_ROWS)
    d = great_circle_m(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2"))
    return m.join(p, ["cx", "cy", "salt_l", "salt_r"]).withColumn("distance_m", d).where(F.col("distance_m") <= metres).select("id", "key", "distance_m")


def _cut(step: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = []
            for key, area in zip(df["key"], df["area"]):
                polygons = [[[tuple(p) for p in r] for r in poly] for poly in area]
                cells: dict[tuple[int, int], list[float]] = {}
                bands: dict[int, list[float]] = {}
                for k, poly in enumerate(polygons):
                    for t in triangles.triangulate(poly):
                        xs, ys = [p[0] for p in t], [p[1] for p in t]
                        flat = [v for p in t for v in p]
                        for i in range(int(np.floor(min(xs) / step)), int(np.floor(max(xs) / step)) + 1):
                            for j in range(int(np.floor(min(ys) / step)), int(np.floor(max(ys) / step)) + 1):
                                cells.setdefault((i, j), []).extend(flat)
                    for ring in poly:
                        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
                            for j in range(int(np.floor(min(y1, y2) / step)), int(np.floor(max(y1, y2) / step)) + 1):
                                bands.setdefault(j, []).extend((k, x1, y1, x2, y2))
                # The even-odd test of a cell's points needs the edges of its band of latitude only, however many cells the area has.
                rows += [(key, i, j, flat, bands.get(j, [])) for (i, j), flat in cells.items()]
            yield pd.DataFrame(rows, columns=["key", "cx", "cy", "flat", "edges"])

    return run


def _descend(points: pd.DataFrame, areas: pd.DataFrame) -> pd.DataFrame:
    """Pairs of one cell: points through the hierarchy of the cell's triangles, then the exact test, an area at a time."""
    none = pd.DataFrame({"id": pd.Series(dtype="int64"), "key": pd.Series(dtype="int64")})
    if not len(points) or not len(areas):
        return none
    tri = [np.asarray(f, dtype=float).reshape(-1, 3, 2) for f in areas["flat"]]
    owner = np.repeat(np.arange(len(tri)), [len(t) for t in tri])
    xy = points[["lon", "lat"]].to_numpy(float)
    p, t = triangles.Hierarchy(np.concatenate(tri)).hits(xy)
    pairs = np.unique(np.stack([owner[t], p], axis=1), axis=0)
    if not len(pairs):
        return none
    keep = np.zeros(len(pairs), dtype=bool)
    starts = np.flatnonzero(np.r_[True, pairs[1:, 0] != pairs[:-1, 0]])
    for s, e in zip(starts, np.r_[starts[1:], len(pairs)]):
        edges = np.asarray(areas["edges"].iloc[pairs[s, 0]], dtype=float).reshape(-1, 5)
        for at in range(s, e, TEST_POINTS):
            upto = min(e, at + TEST_POINTS)
            keep[at:upto] = triangles.inside_many(edges, xy[pairs[at:upto, 1]])
    pairs = pairs[keep]
    return pd.DataFrame({"id": points["id"].to_numpy()[pairs[:, 1]], "key": areas["key"].to_numpy()[pairs[:, 0]]})


def within(marks: DataFrame, areas: DataFrame, cell_degrees: float = 0.01) -> DataFrame:
    """(id, key) of marks (id, lon, lat) and the areas (key, area) that contain them, holes excluded.

    A mark on an outer boundary is inside; one that two areas share belongs to both, once each.
    """
    t = areas.where(F.col("area").isNotNull()).select("key", "area").mapInPandas(
        _cut(cell_degrees), "key bigint, cx bigint, cy bigint, flat array<double>, edges array<double>"
    )
    t = Stage(areas.sparkSession).write(t)  # its cells are counted first, and triangles aren't cut twice for that
    m = marks.where(F.col("lon").isNotNull() & F.col("lat").isNotNull()).select(
        "id", "lon", "lat", F.floor(F.col("lon") / cell_degrees).alias("cx"), F.floor(F.col("lat") / cell_degrees).alias("cy")
    )
    m, t = salted(m, t, ["cx", "cy"], "id", "key", CELL_ROWS)
    on = ["cx", "cy", "salt_l", "salt_r"]
    return m.groupBy(*on).cogroup(t.groupBy(*on)).applyInPandas(_descend, "id bigint, key bigint")
