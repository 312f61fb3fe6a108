"""Readers of feature files: GeoJSON, CSV, GeoParquet, GeoPackage, Shapefile, TIFF metadata and ZIP.

GeoParquet is read as Parquet, split and pruned like any table. Of the other formats a file is one task: ``binaryFile`` distributes the files and a parser turns the bytes of each into rows
(path, feature_idx, geometry, properties, capture_timestamp). A file that can't be read gives one row
with ``error``.
"""

from __future__ import annotations

import csv
import io
import json
import os
import sqlite3
import struct
import tempfile
import zipfile
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landweave.functions import projections

#: Extensions by format.
FORMATS = {
    ".geojson": "geojson", ".json": "geojson", ".csv": "csv", ".gpkg": "geopackage", ".shp": "shapefile", ".tif": "geotiff", ".tiff": "geotiff", ".zip": "zip", ".parquet": "geoparquet",
}
#: Column names that hold a geometry, a latitude or a longitude, and dates that become the time of capture.
WKT_COLUMNS = ("wkt", "geometry", "geom", "wkt_geometry")
LAT_COLUMNS = ("lat", "latitude", "y", "lat_deg", "latitude_deg")
LON_COLUMNS = ("lon", "lng", "longitude", "x", "lon_deg", "longitude_deg")
DATE_FIELDS = ("date", "survey_date", "capture_date", "Date", "Survey_Date")

Row = tuple[str | None, dict[str, str], str | None]
SCHEMA = "path string, feature_idx int, geometry string, properties map<string,string>, capture_timestamp string, error string"


def _text(v: Any) -> str | None:
    return None if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) if isinstance(v, (dict, list)) else str(v)


def _split_date(props: dict[str, Any]) -> tuple[dict[str, str], str | None]:
    """Properties as texts without the date field, and its value; the last given date field counts."""
    given = [k for k in DATE_FIELDS if props.get(k)]
    return {k: _text(v) for k, v in props.items() if k not in DATE_FIELDS and v is not None}, _text(props[given[-1]]) if given else None  # type: ignore[misc]


def read_geojson(data: bytes) -> list[Row]:
    """Features of a collection, a single feature, or a list of features; capture_date, else survey_date, becomes the time."""
    doc = json.loads(data.decode("utf-8-sig"))
    features = doc if isinstance(doc, list) else doc.get("features", []) if doc.get("type") == "FeatureCollection" else [doc]
    out: list[Row] = []
    for f in features:
        props = dict(f.get("properties") or {})
        first, second = props.pop("capture_date", None), None if "survey_date" not in props else props["survey_date"]
        if first is None and second is not None:
            first = props.pop("survey_date")
        g = f.get("geometry")
        out.append((json.dumps(g) if g else None, {k: _text(v) for k, v in props.items() if v is not None}, _text(first)))  # type: ignore[misc]
    return out


def parse_wkt(text: str) -> dict | None:
    """GeoJSON object of a POINT, LINESTRING, POLYGON or MULTIPOLYGON text; null if it is none."""
    head, _, body = text.strip().partition("(")
    kind = {"POINT": "Point", "LINESTRING": "LineString", "POLYGON": "Polygon", "MULTIPOLYGON": "MultiPolygon"}.get(head.strip().upper().replace(" Z", ""))
    if not kind or not body.endswith(")"):
        return None
    number = lambda p: "[" + ",".join(p.split()) + "]"
    nested = "(" + body
    pieces, word = [], ""
    for ch in nested:
        if ch in "(),":
            if word.strip():
                pieces.append(number(word))
            pieces.append({"(": "[", ")": "]", ",": ","}[ch])
            word = ""
        else:
            word += ch
    try:
        c = json.loads("".join(pieces))
    except ValueError:
        return None
    return {"type": kind, "coordinates": c[0] if kind == "Point" else c}


def read_csv(data: bytes) -> list[Row]:
    """Rows with a geometry from a well-known text column, else from latitude and longitude; rows without keep a null one."""
    rows = list(csv.DictReader(io.StringIO(data.decode("utf-8-sig"))))
    if not rows:
        return []
    by = {k.lower().strip(): k for k in rows[0] if k}
    pick = lambda names: next((by[n] for n in names if n in by), None)
    wkt_col, lat_col, lon_col = pick(WKT_COLUMNS), pick(LAT_COLUMNS), pick(LON_COLUMNS)
    out: list[Row] = []
    for r in rows:
        g = None
        if wkt_col and r.get(wkt_col):
            g = parse_wkt(r[wkt_col])
        elif lat_col and lon_col:
            try:
                g = {"type": "Point", "coordinates": [float(r[lon_col]), float(r[lat_col])]}
            except (TypeError, ValueError):
                g = None
        props, when = _split_date({k: v for k, v in r.items() if k and k not in (wkt_col, lat_col, lon_col)})
        out.append((json.dumps(g) if g else None, props, when))
    return out


def parse_wkb(b: bytes, at: int = 0) -> tuple[dict, int]:
    """(GeoJSON object, end) of well-known binary; further ordinates are dropped."""
    end = "<" if b[at] else ">"
    kind = struct.unpack_from(end + "I", b, at + 1)[0]
    extra = {0: 0, 1: 1, 2: 1, 3: 2}[(kind & 0xFFFF) // 1000] + (1 if kind & 0x80000000 else 0)
    kind = (kind & 0xFFFF) % 1000
    at += 5
    width = 2 + extra

    def point(p: int) -> tuple[list[float], int]:
        return list(struct.unpack_from(f"{end}{width}d", b, p))[:2], p + 8 * width

    def many(p: int, part: Any) -> tuple[list, int]:
        n = struct.unpack_from(end + "I", b, p)[0]
        p += 4
        out = []
        for _ in range(n):
            v, p = part(p)
            out.append(v)
        return out, p

    if kind == 1:
        c, at = point(at)
        return {"type": "Point", "coordinates": c}, at
    if kind == 2:
        c, at = many(at, point)
        return {"type": "LineString", "coordinates": c}, at
    if kind == 3:
        c, at = many(at, lambda p: many(p, point))
        return {"type": "Polygon", "coordinates": c}, at
    if kind in (4, 5, 6):
        parts, at = many(at, lambda p: parse_wkb(b, p))
        return {"type": {4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}[kind], "coordinates": [g["coordinates"] for g in parts]}, at
    raise ValueError(f"well-known binary of kind {kind}")


def geopackage_layers(data: bytes) -> list[str]:
    with tempfile.NamedTemporaryFile(suffix=".gpkg") as f:  # a file of this task only, gone with it
        f.write(data)
        f.flush()
        with sqlite3.connect(f.name) as db:
            return [r[0] for r in db.execute("SELECT table_name FROM gpkg_contents WHERE data_type = 'features' ORDER BY rowid")]


def read_geopackage(data: bytes, layer: str | None = None) -> list[Row]:
    """Rows of a layer, by default the first."""
    name = layer or geopackage_layers(data)[0]
    out: list[Row] = []
    with tempfile.NamedTemporaryFile(suffix=".gpkg") as f:
        f.write(data)
        f.flush()
        with sqlite3.connect(f.name) as db:
            col = db.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (name,)).fetchone()[0]
            cur = db.execute(f'SELECT * FROM "{name}"')
            cols = [c[0] for c in cur.description]
            for r in cur:
                v = dict(zip(cols, r))
                blob = v.pop(col)
                g = None
                if blob:
                    g = parse_wkb(blob, 8 + (0, 32, 48, 48, 64)[(blob[3] >> 1) & 7])[0]
                props, when = _split_date(v)
                out.append((json.dumps(g) if g else None, props, when))
    return out


def _reprojected(geometry: dict | None, prj: bytes | None) -> dict | None:
    """A geometry in degrees by the text of a .prj; as it stands where that is none, already in degrees or unknown."""
    text = (prj or b"").decode("utf-8", "replace").strip()
    to = projections.inverse(text) if geometry and text.upper().startswith("PROJCS") else None
    if to is None or geometry is None:
        return geometry
    move = lambda c: list(to(c[0], c[1])) if c and not isinstance(c[0], list) else [move(x) for x in c]
    return {**geometry, "coordinates": move(geometry["coordinates"])}


def read_shapefile(shp: bytes, dbf: bytes | None, prj: bytes | None = None) -> list[Row]:
    """Points, lines and polygons of a shapefile with the attributes of its table, in degrees where the .prj is a known projection."""
    shapes: list[dict | None] = []
    at = 100
    while at + 8 <= len(shp):
        size = struct.unpack_from(">i", shp, at + 4)[0] * 2
        kind = struct.unpack_from("<i", shp, at + 8)[0] % 10
        b = at + 12
        if kind == 1:
            shapes.append({"type": "Point", "coordinates": list(struct.unpack_from("<2d", shp, b))})
        elif kind in (3, 5):
            parts, points = struct.unpack_from("<2i", shp, b + 32)
            starts = [*struct.unpack_from(f"<{parts}i", shp, b + 40), points]
            xy = struct.unpack_from(f"<{2 * points}d", shp, b + 40 + 4 * parts)
            rings = [[[xy[2 * i], xy[2 * i + 1]] for i in range(s, e)] for s, e in zip(starts, starts[1:])]
            if kind == 3:
                shapes.append({"type": "LineString", "coordinates": rings[0]} if len(rings) == 1 else {"type": "MultiLineString", "coordinates": rings})
            else:  # an outer ring runs clockwise and begins a polygon
                clockwise = lambda r: sum((b[0] - a[0]) * (b[1] + a[1]) for a, b in zip(r, r[1:])) > 0
                polygons: list[list] = []
                for r in rings:
                    if clockwise(r) or not polygons:
                        polygons.append([r])
                    else:
                        polygons[-1].append(r)
                shapes.append({"type": "Polygon", "coordinates": polygons[0]} if len(polygons) == 1 else {"type": "MultiPolygon", "coordinates": polygons})
        else:
            shapes.append(None)
        at += 8 + size
    table: list[dict[str, Any]] = [{} for _ in shapes]
    if dbf:
        n, head, width = struct.unpack_from("<IHH", dbf, 4)
        fields, p, start = [], 32, 1
        while dbf[p] != 0x0D:
            length = dbf[p + 16]
            fields.append((dbf[p : p + 11].split(b"\0")[0].decode(), start, length))
            start += length
            p += 32
        for i in range(min(n, len(shapes))):
            row = dbf[head + i * width : head + (i + 1) * width]
            table[i] = {name: row[s : s + k].decode("utf-8", "replace").strip() or None for name, s, k in fields}
    return [(json.dumps(_reprojected(g, prj)) if g else None, *_split_date(props)) for g, props in zip(shapes, table)]


def read_geotiff(data: bytes) -> list[Row]:
    """One feature: the extent as a polygon, and size, bands and pixel size; no pixels are read."""
    end = {b"II": "<", b"MM": ">"}[data[:2]]
    at = struct.unpack_from(end + "I", data, 4)[0]
    tags: dict[int, tuple] = {}
    sizes = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 12: ("d", 8)}
    for i in range(struct.unpack_from(end + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(end + "HHI", data, at + 2 + 12 * i)
        if kind in sizes:
            code, k = sizes[kind]
            where = at + 10 + 12 * i
            if n * k > 4:
                where = struct.unpack_from(end + "I", data, where)[0]
            tags[tag] = struct.unpack_from(f"{end}{n}{code}", data, where)
    w, h = tags[256][0], tags[257][0]
    props = {"width": str(w), "height": str(h), "bands": str(tags.get(277, (1,))[0])}
    props["dtype"] = {1: "uint", 2: "int", 3: "float"}.get(tags.get(339, (1,))[0], "void") + str(tags.get(258, (1,))[0])
    if 42113 in tags:
        props["nodata"] = b"".join(tags[42113]).split(b"\0")[0].decode("ascii", "replace").strip()
    # Keys of four numbers each after a head of four: 3072 names a projected system, 2048 a geographic one.
    keys = tags.get(34735, ())
    epsg = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    crs = epsg.get(3072) or epsg.get(2048)
    if crs and crs != 32767:  # the number of a system defined by the user
        props["crs"] = f"EPSG:{crs}"
    g = None
    if 33550 in tags and 33922 in tags:
        sx, sy = tags[33550][:2]
        x0, y1 = tags[33922][3] - tags[33922][0] * sx, tags[33922][4] + tags[33922][1] * sy
        x1, y0 = x0 + w * sx, y1 - h * sy
        to = projections.inverse(props.get("crs")) or (lambda x, y: (x, y))
        g = json.dumps({"type": "Polygon", "coordinates": [[list(to(*p)) for p in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]]})
        props |= {"pixel_x": str(sx), "pixel_y": str(sy)}
    return [(g, props, None)]


def read_geoparquet(data: bytes) -> list[Row]:
    """Rows of a GeoParquet file; the geometry column is the one its footer names."""
    import pyarrow.parquet as pq

    t = pq.read_table(io.BytesIO(data))
    meta = json.loads((t.schema.metadata or {}).get(b"geo", b"{}"))
    col = meta.get("primary_column", "geometry")
    out: list[Row] = []
    for r in t.to_pylist():
        blob = r.pop(col, None)
        g = parse_wkb(blob)[0] if isinstance(blob, bytes) else None
        props, when = _split_date({k: v for k, v in r.items() if v == v})
        out.append((json.dumps(g) if g else None, props, when))
    return out


def read_zip(data: bytes) -> list[Row]:
    """The first readable member in the archive's order, else a shapefile."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        members = z.namelist()
        for n in members:
            kind = FORMATS.get(os.path.splitext(n)[1].lower())
            if kind in ("geojson", "geopackage", "geoparquet"):
                return READERS[kind](z.read(n))
        for n in members:
            if n.lower().endswith(".shp"):
                beside = lambda end: next((z.read(m) for m in members if m.lower() == n.lower()[:-4] + end), None)  # noqa: B023, E731
                return read_shapefile(z.read(n), beside(".dbf"), beside(".prj"))
    raise ValueError("no readable member")


READERS = {"geojson": read_geojson, "csv": read_csv, "geopackage": read_geopackage, "geotiff": read_geotiff, "zip": read_zip, "geoparquet": read_geoparquet}
#: Files that belong to a shapefile and are read with it.
BESIDE = (".dbf", ".prj", ".shx", ".cpg", ".sbn", ".sbx")


def read_features(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """Features of all files below ``path``, the format by extension; unknown extensions and damaged files give an error row.

    A shapefile takes its table and projection from the files of the same name beside it; ``layer`` picks
    one of a GeoPackage. Parquet files are read by ``read_geoparquet_table``, not in one task each.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = []
            for p, data, dbf, prj in zip(df["path"], df["content"], df["dbf"], df["prj"]):
                kind = FORMATS.get(os.path.splitext(p)[1].lower())
                try:
                    if kind is None:
                        raise ValueError("unknown format")
                    read = read_shapefile(data, dbf, prj) if kind == "shapefile" else read_geopackage(data, layer) if kind == "geopackage" else READERS[kind](data)
                    rows += [(p, i, g, props, when, None) for i, (g, props, when) in enumerate(read)]
                except Exception as e:  # a damaged file must not end the job
                    rows.append((p, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"feature_idx": "Int32"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    end, stem = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)), F.lower(F.regexp_replace("path", r"\.[^./]*$", ""))
    files = files.select("path", "content", end.alias("end"), stem.alias("stem"))
    side = lambda e, name: files.where(F.col("end") == e).groupBy("stem").agg(F.min("content").alias(name))
    shapes = files.where(F.col("end") == ".shp").join(side(".dbf", "dbf"), "stem", "left").join(side(".prj", "prj"), "stem", "left")
    none = F.lit(None).cast("binary")
    others = files.where(~F.col("end").isin(".shp", ".parquet", *BESIDE)).withColumn("dbf", none).withColumn("prj", none)
    out = others.select("path", "content", "dbf", "prj").unionByName(shapes.select("path", "content", "dbf", "prj")).mapInPandas(run, SCHEMA)
    # Whether there is any Parquet file is a question to the file listing, not to the files.
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path")
    return out if listed.isEmpty() else out.unionByName(read_geoparquet_table(spark, path))


def read_geoparquet_table(spark: SparkSession, path: str, geometry: str | None = None, properties: tuple[str, ...] | None = None) -> DataFrame:
    """Rows of GeoParquet files as Spark reads them: splits of a file are tasks of their own, and only the ``properties`` asked for are read.

    ``geometry`` names the column of well-known binary; by default it is the first of the usual names
    that the files have. Fields of all files are merged; a file's rows are numbered from 0.
    """
    t = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").option("mergeSchema", "true").parquet(path)
    geometry = geometry or next((c for c in ("geometry", "geom", "wkb_geometry", "wkb") if c in t.columns), None)
    rest = [c for c in t.columns if c != geometry and (properties is None or c in properties)]
    dates = [c for c in DATE_FIELDS if c in rest]

    def text(s: pd.Series) -> pd.Series:
        def one(b: bytes | None) -> str | None:
            try:
                return None if not b else json.dumps(parse_wkb(bytes(b))[0])
            except (ValueError, struct.error, IndexError):
                return None

        return s.map(one)

    shape = F.pandas_udf(text, "string")(F.col(geometry).cast("binary")) if geometry else F.lit(None).cast("string")
    plain = lambda c: F.to_json(F.col(f"`{c}`")) if t.schema[c].dataType.typeName() in ("struct", "array", "map") else F.col(f"`{c}`").cast("string")
    pairs = [x for c in rest if c not in dates for x in (F.lit(c), plain(c))]
    props = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    when = F.coalesce(*[F.nullif(plain(c), F.lit("")) for c in reversed(dates)]) if dates else F.lit(None).cast("string")
    return t.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").cast("int").alias("feature_idx"), shape.alias("geometry"), props.alias("properties"), when.alias("capture_timestamp"), F.lit(None).cast("string").alias("error")
    )


def coverage(features: DataFrame) -> DataFrame:
    """(path, crs, extent, context) of TIFF files as evidence of where imagery or heights exist; files without an extent cover nothing."""
    p = lambda n: F.element_at("properties", n)
    tif = features.where(F.lower("path").rlike(r"\.tiff?$") & F.col("geometry").isNotNull())
    context = F.map_filter(F.create_map(*[x for n in ("width", "height", "bands", "dtype", "nodata", "pixel_x", "pixel_y") for x in (F.lit(n), p(n))]), lambda _, v: v.isNotNull())
    return tif.select("path", p("crs").alias("crs"), F.col("geometry").alias("extent"), context.alias("context"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, length) of all files below ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha256"), "length")


def formats(spark: SparkSession) -> DataFrame:
    """(extension, format) of the formats that are read."""
    return spark.createDataFrame(list(FORMATS.items()), "extension string, format string").orderBy(F.col("extension"))
