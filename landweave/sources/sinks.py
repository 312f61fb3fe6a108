"""Exports: GeoJSON features, GeoPackage files and evidence packages."""

from __future__ import annotations

import hashlib
import io
import json
import sqlite3
import struct
import zipfile
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def geojson_features(df: DataFrame, key: str, geometry: str, properties: tuple[str, ...]) -> DataFrame:
    """(key, feature): one GeoJSON feature a row as JSON text; an unreadable geometry is null. Written as text this is NDJSON at any size."""
    feature = F.struct(F.lit("Feature").alias("type"), F.col(key).alias("id"), F.try_parse_json(F.col(geometry)).alias("geometry"), F.struct(*properties).alias("properties"))
    return df.select(key, F.to_json(feature).alias("feature"))


#: Features that one collection document holds at most; it is a page, the whole table goes out as NDJSON.
COLLECTION_ROWS = 10_000


def feature_collection(features: DataFrame, key: str, limit: int = COLLECTION_ROWS) -> str:
    """One GeoJSON document of the first ``limit`` features by ``key`` of the result of ``geojson_features``."""
    page = features.orderBy(key).limit(min(limit, COLLECTION_ROWS)).select("feature").collect()
    return '{"type":"FeatureCollection","features":[' + ",".join(r[0] for r in page) + "]}"


#: Collections that are offered, with their tables' keys, and the classes they conform to.
COLLECTIONS = {"parcels": "canonical_id", "source-records": "record_id", "conflicts": "parcel_id"}
CONFORMANCE = tuple(f"http://www.opengis.net/spec/ogcapi-features-1/1.0/conf/{c}" for c in ("core", "geojson"))
#: Items of a page at most.
PAGE_ROWS = 1000


def collections(base: str) -> list[dict]:
    """Descriptions of the collections with links to their items."""
    return [{"id": n, "title": n.replace("-", " "), "itemType": "feature", "links": [{"rel": "items", "href": f"{base}/collections/{n}/items", "type": "application/geo+json"}]} for n in COLLECTIONS]


def items(features: DataFrame, key: str, base: str, collection: str, offset: int = 0, limit: int = 100) -> dict:
    """A page of features in order of ``key`` with the number of all, and links to itself, the next and the page before."""
    limit, offset = max(1, min(limit, PAGE_ROWS)), max(0, offset)
    total = features.count()
    rows = [json.loads(r[0]) for r in features.orderBy(key).offset(offset).limit(limit).select("feature").collect()]  # at most a page
    link = lambda rel, at: {"rel": rel, "href": f"{base}/collections/{collection}/items?offset={at}&limit={limit}", "type": "application/geo+json"}
    links = [link("self", offset)] + ([link("next", offset + limit)] if offset + limit < total else []) + ([link("prev", max(0, offset - limit))] if offset else [])
    return {"type": "FeatureCollection", "features": rows, "numberMatched": total, "numberReturned": len(rows), "links": links}


def item(features: DataFrame, key: str, value: str) -> dict | None:
    """The feature of one key, or null."""
    found = features.where(F.col(key) == value).select("feature").head()
    return json.loads(found[0]) if found else None


#: Members of a package, in order, before its manifest.
MEMBERS = ("source_manifest.json", "normalized_features.geojson", "proposal.geojson", "conflicts.json", "confidence.json", "validation.json", "decision.json", "audit.jsonl")


def _zip(key: str, members: dict[str, bytes]) -> tuple[str, int, str, bytes]:
    """Name, size, hash of the manifest and bytes of a package; the same members give the same bytes."""
    manifest = "".join(f"{hashlib.sha256(b).hexdigest()}  {n}\n" for n, b in members.items()).encode()
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for n, b in [*members.items(), ("manifest.sha256", manifest)]:
            z.writestr(zipfile.ZipInfo(f"parcel_{key}/{n}", (1980, 1, 1, 0, 0, 0)), b)
    data = buffer.getvalue()
    return f"{key}.zip", len(data), hashlib.sha256(manifest).hexdigest(), data


def packages(rows: DataFrame) -> DataFrame:
    """(name, size, manifest_hash, content): one evidence ZIP a row of (id, members), members a map of ``MEMBERS`` to their texts.

    A member that a row lacks is written as an empty object, the audit trail as no lines.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            out = []
            for key, given in df.itertuples(index=False):
                have = dict(given) if given is not None else {}
                out.append(_zip(key, {n: (have.get(n) or ("" if n.endswith("l") else "{}")).encode() for n in MEMBERS}))
            yield pd.DataFrame(out, columns=["name", "size", "manifest_hash", "content"])

    return rows.mapInPandas(run, "name string, size bigint, manifest_hash string, content binary")


def wkb(geometry: dict) -> bytes:
    """Well-known binary of a Point, LineString, Polygon or MultiPolygon."""
    kind, c = geometry["type"], geometry["coordinates"]
    pts = lambda ps: struct.pack("<I", len(ps)) + b"".join(struct.pack("<dd", *p[:2]) for p in ps)
    if kind == "Point":
        return struct.pack("<BIdd", 1, 1, *c[:2])
    if kind == "LineString":
        return struct.pack("<BI", 1, 2) + pts(c)
    if kind == "Polygon":
        return struct.pack("<BII", 1, 3, len(c)) + b"".join(pts(r) for r in c)
    if kind == "MultiPolygon":
        return struct.pack("<BII", 1, 6, len(c)) + b"".join(wkb({"type": "Polygon", "coordinates": p}) for p in c)
    raise ValueError(f"no binary form of {kind}")


def write_geopackage(path: str, layers: dict[str, DataFrame], geometry: str = "geometry") -> None:
    """One GeoPackage file with a table a layer. The format is a single file, so rows stream through the driver one partition at a time."""
    db = sqlite3.connect(path)
    db.executescript(
        "PRAGMA application_id = 1196444487;"
        "CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT, srs_id INTEGER PRIMARY KEY, organization TEXT, organization_coordsys_id INTEGER, definition TEXT);"
        "INSERT INTO gpkg_spatial_ref_sys VALUES ('WGS 84', 4326, 'EPSG', 4326, 'GEOGCS');"
        "CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT, identifier TEXT, srs_id INTEGER);"
        "CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z INTEGER, m INTEGER);"
    )
    for name, df in layers.items():
        others = [c for c in df.columns if c != geometry]
        quoted = ", ".join(f'"{c}"' for c in others)
        db.execute(f'CREATE TABLE "{name}" (fid INTEGER PRIMARY KEY AUTOINCREMENT, geom BLOB, {quoted})')
        db.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?, 4326)", (name, name))
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'GEOMETRY', 4326, 0, 0)", (name,))
        for row in df.select(geometry, *others).toLocalIterator():
            db.execute(f'INSERT INTO "{name}" (geom, {quoted}) VALUES ({", ".join("?" * (len(others) + 1))})', (_blob(row[0]), *[_plain(v) for v in row[1:]]))
    db.commit()
    db.close()


def _plain(v: Any) -> Any:
    return v if v is None or isinstance(v, (int, float, str, bytes)) else json.dumps(v, default=str)


def _blob(text: str | None) -> bytes | None:
    try:
        return b"GP\x00\x01" + struct.pack("<i", 4326) + wkb(json.loads(text)) if text else None
    except (ValueError, KeyError, TypeError, struct.error):
        return None
