"""Checks and projections on delivered records: ids, times, positions, schema, areas and the adapters of observations."""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landweave import config
from landweave.functions import geojson, planar, projections
from landweave.functions.columns import step
from landweave.functions.text import field_name, indel_ratio, indel_ratio_col


def _pairs(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def record_id(get: dict[str, Column], dataset: Column, ordinal: Column) -> Column:
    """First non-empty of id, record_id, parcel_id, property_id, khasra_no after the dataset's id, else a number."""
    given = F.coalesce(*[F.nullif(get[k], F.lit("")) for k in ("id", "record_id", "parcel_id", "property_id", "khasra_no")])
    return F.concat(dataset, F.lit("::"), F.coalesce(given, F.format_string("rec-%06d", ordinal)))


CHECKED = (
    "outcome string, geom_type string, geometry string, minx double, miny double, maxx double, maxy double, max_abs double, max_abs_y double, "
    "centroid_lon double, centroid_lat double, deg2 double, content_hash string"
)


def _check(geometry: str | None, attributes: str | None, crs: str | None, reproject: bool, hashed: bool = True) -> tuple:
    """One row of ``CHECKED``."""
    digest = canonical_hash(geometry, attributes, crs) if hashed else None
    outcome, kind, parts = geojson.parsed(geometry)
    if outcome != "OK":
        return (outcome, kind, *(None,) * 10, digest)
    area = kind in ("Polygon", "MultiPolygon")
    corners = [p for poly in parts for r in poly for p in r] if area else parts
    text = geometry
    if reproject and not crs_is_degrees(crs):
        to = projections.inverse(crs)
        if to is None:
            return ("UNKNOWN_CRS", kind, *(None,) * 10, digest)
        if area:
            parts = [[[to(*p) for p in r] for r in poly] for poly in parts]
            corners = [p for poly in parts for r in poly for p in r]
        else:
            parts = corners = [to(*p) for p in parts]
        text = topology_text(kind, parts)
    if area and any(planar.crosses_itself(p) for p in parts):
        fixed = [q for p in parts for q in (planar.even_odd(p) if planar.crosses_itself(p) else [p])]
        if fixed:
            parts, outcome, kind = fixed, "REPAIRED", "MultiPolygon"
            text = topology_text(kind, parts)
    xs, ys = [p[0] for p in corners], [p[1] for p in corners]
    c = planar.centroid(parts) if area else (sum(xs) / len(xs), sum(ys) / len(ys))
    reach = max(max(map(abs, xs)), max(map(abs, ys)))
    return outcome, kind, text, min(xs), min(ys), max(xs), max(ys), reach, max(map(abs, ys)), c[0], c[1], planar.plain_area(parts) if area else 0.0, digest


def topology_text(kind: str, parts: list) -> str:
    """GeoJSON of polygons with open rings, or of positions."""
    if kind in ("Polygon", "MultiPolygon"):
        polygons = [[[list(q) for q in r + r[:1]] for r in p] for p in parts]
        return json.dumps({"type": "MultiPolygon", "coordinates": polygons} if len(polygons) > 1 or kind == "MultiPolygon" else {"type": "Polygon", "coordinates": polygons[0]})
    return json.dumps({"type": kind, "coordinates": list(parts[0]) if kind == "Point" else [list(p) for p in parts]})


def crs_is_degrees(crs: str | None) -> bool:
    return not crs or crs.upper().replace(" ", "") in {n.upper() for n in config.WGS84_NAMES}


def canonical_hash(geometry: str | None, attributes: str | None, crs: str | None) -> str:
    """SHA-256 of the canonical JSON of geometry, attributes and declared system: sorted keys, no blanks. Unreadable texts stay texts."""

    def value(t: str | None) -> object:
        try:
            return None if t is None else json.loads(t)
        except (ValueError, RecursionError):
            return t

    whole = {"geometry": value(geometry), "attributes": value(attributes), "source_crs": crs}
    return hashlib.sha256(json.dumps(whole, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode("utf-8", "surrogatepass")).hexdigest()


def hashed_col(geometry: Column, attributes: Column, crs: Column) -> Column:
    """``canonical_hash`` over columns."""

    def run(g: pd.Series, a: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([canonical_hash(*row) for row in zip(g, a, c)], dtype="object")

    return F.pandas_udf(run, "string")(geometry, attributes, crs)


def checked(geometry: Column, attributes: Column, crs: Column, reproject: bool = False, hashed: bool = True) -> Column:
    """struct of ``CHECKED``: validity, repair, bounds, centre and area of a geometry, and the hash of its row's content.

    An outline that crosses itself is REPAIRED: its area by the even-odd rule, as trapezoids.
    ``reproject`` turns declared UTM and web Mercator systems into degrees first. Without ``hashed``
    there is no hash, nearly half the work, and attributes aren't read.
    """
    names = [f.split()[0] for f in CHECKED.split(", ")]
    if not hashed:

        def plain(g: pd.Series, c: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([_check(x, None, z, reproject, False) for x, z in zip(g, c)], columns=names)

        return F.pandas_udf(plain, CHECKED)(geometry, crs)

    def run(g: pd.Series, a: pd.Series, c: pd.Series) -> pd.DataFrame:
        rows = [_check(x, y, z, reproject) for x, y, z in zip(g, a, c)]
        return pd.DataFrame(rows, columns=names)

    return F.pandas_udf(run, CHECKED)(geometry, attributes, crs)


def reject_reason(c: str = "", strict: bool = True) -> Column:
    """Why a row of ``checked`` is not taken, or null: projected metres, latitude, geometry, reference system, in this order."""
    col = lambda n: F.col(f"{c}{n}")
    gate = crs_gate(col("minx"), col("miny"), col("maxx"), col("maxy"))
    return F.coalesce(
        range_reject(col("max_abs"), col("max_abs_y")), F.when(~col("outcome").isin("OK", "REPAIRED"), F.concat(F.lit("GEOMETRY_"), col("outcome"))),
        F.when(gate.isin("IMPOSSIBLE_EXTENT", "AXIS_ORDER"), F.concat(F.lit("CRS_"), gate)),
    )


def canonical(rows: DataFrame, key: str, attributes: str, at: float = config.DEFAULT.fuzzy_field_at) -> DataFrame:
    """Adds ``canonical`` (field to value), ``methods`` (property to ALIAS, FUZZY or UNMAPPED) and ``area_sqm`` to rows with unique ``key``.

    A property whose name is an alias sets its field, the last of several; a property that only
    resembles one sets it where no alias does, the first of several. Null values set nothing. The
    stated area is read from alias properties only, in the unit that the row states. Unreadable
    attributes give empty maps.
    """
    r = step(rows, _attributes=F.from_json(F.col(attributes), "map<string,string>"))
    r = r.select("*", F.inline(F.array(_mapped(F.map_keys("_attributes"), F.map_values("_attributes"), at))))
    return r.withColumn("area_sqm", area_sqm(F.col("_area"), F.col("_unit"))).drop("_attributes", "_area", "_unit")


MAPPED = "canonical map<string,string>, methods map<string,string>, _area string, _unit string"


@lru_cache(maxsize=100_000)
def _field_of(name: str, at: float) -> tuple[str | None, str | None]:
    """(field by alias, else field by likeness) of a property name, as ``canonical_field`` and ``fuzzy_fields`` give them."""
    plain = re.sub("[^a-z0-9_]", "_", name.strip(" ").lower())
    if plain in config.ALIASES:
        return config.ALIASES[plain], None
    best, field = at, None
    for alias, f in config.ALIASES.items():
        score = indel_ratio(plain, alias)
        if score > best or (field is None and score == best):
            best, field = score, f
    return None, field


def _map(names: list[str], values: list[str | None], at: float) -> tuple[list, list, str | None, str | None]:
    """One row of ``MAPPED`` from the properties of a row, in their order."""
    exact: dict[str, str] = {}
    loose: dict[str, str] = {}
    methods: dict[str, str] = {}
    for name, value in zip(names, values):
        field, near = _field_of(name, at)
        methods[name] = "ALIAS" if field else "FUZZY" if near else "UNMAPPED"
        if value is not None and field:
            exact[field] = value
        elif value is not None and near:
            loose.setdefault(near, value)
    return list((exact | {f: v for f, v in loose.items() if f not in exact}).items()), list(methods.items()), exact.get("area"), exact.get("area_unit")


def _mapped(names: Column, values: Column, at: float) -> Column:
    """struct of ``MAPPED`` of the names and values of a row's properties; empty maps for none."""

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        rows = [_map(n or [], v or [], at) for n, v in zip(x.to_pylist(), y.to_pylist())]
        kinds = (pa.map_(pa.string(), pa.string()),) * 2 + (pa.string(),) * 2
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [c.split()[0] for c in MAPPED.split(", ")])

    return F.arrow_udf(run, MAPPED)(names, values)


def range_reject(max_abs: Column, max_abs_y: Column) -> Column:
    """Reason to reject a geometry before its reference system is looked at, or null."""
    return F.when(max_abs > 1000, "PROJECTED_METRES").when(max_abs_y > 90, "LATITUDE_OUTSIDE")


def crs_gate(minx: Column, miny: Column, maxx: Column, maxy: Column, declared: Column | None = None) -> Column:
    """IMPOSSIBLE_EXTENT, AXIS_ORDER, PLAUSIBILITY (a warning) or NONE; other declared systems aren't checked."""
    far = F.greatest(F.abs(miny), F.abs(maxy)) > 90
    wide = F.greatest(F.abs(minx), F.abs(maxx)) > 180
    swapped = minx.between(6, 38) & maxx.between(6, 38) & miny.between(67, 98) & maxy.between(67, 98)
    near = (minx >= 57) & (maxx <= 108) & (miny >= -4) & (maxy <= 48)
    gate = F.when(far | wide, "IMPOSSIBLE_EXTENT").when(swapped, "AXIS_ORDER").when(~near, "PLAUSIBILITY").otherwise("NONE")
    return gate if declared is None else F.when(~declared.isin(*config.WGS84_NAMES), "NONE").otherwise(gate)


def canonical_field(name: Column) -> Column:
    """Canonical field of a property name by alias, or null."""
    return F.element_at(_pairs(config.ALIASES), field_name(name))


def fuzzy_fields(names: DataFrame, column: str, at: float = config.DEFAULT.fuzzy_field_at) -> DataFrame:
    """(name, canonical, score) of distinct property names whose best alias reaches ``at``, the first of equals.

    Names are distinct and few; the aliases are a fixed list of about a hundred.
    """
    session = names.sparkSession
    aliases = session.createDataFrame([(a, f, i) for i, (a, f) in enumerate(config.ALIASES.items())], "alias string, canonical string, ord int")
    n = names.select(F.col(column).alias("name")).distinct()
    n = n.withColumn("alias_list", F.lit(1)).join(F.broadcast(aliases.withColumn("alias_list", F.lit(1))), "alias_list")
    s = n.withColumn("score", indel_ratio_col(field_name(F.col("name")), F.col("alias"))).where(F.col("score") >= at)
    best = s.groupBy("name").agg(F.max_by(F.struct("canonical", "score"), F.struct("score", -F.col("ord"))).alias("b"))
    return best.select("name", "b.canonical", "b.score")


def area_sqm(value: Column, unit: Column) -> Column:
    """Stated area in square metres; an unknown or missing unit changes nothing."""
    factor = F.coalesce(F.element_at(_pairs(config.AREA_UNITS), F.lower(F.trim(unit))), F.lit(1.0))
    return F.regexp_replace(value, ",", "").try_cast("double") * factor


def gnss_method(raw: Column) -> Column:
    """First known method that the text holds."""
    t = F.regexp_replace(F.lower(raw), "[- ]", "_")
    out = F.lit("unknown")
    for m in reversed(list(config.GNSS_QUALITY)):
        out = F.when(t.contains(m), m).otherwise(out)
    return F.when(raw.isNull() | (raw == ""), "unknown").otherwise(out)


def gnss_accuracy(method: Column, pdop: Column, baseline_km: Column) -> Column:
    """Estimated horizontal accuracy in metres from the method, the dilution and the baseline."""
    base = F.element_at(_pairs(config.GNSS_ACCURACY_M), method) * F.when(pdop > 0, F.greatest(F.lit(1.0), pdop / 1.5)).otherwise(1.0)
    return base + F.when((baseline_km != 0) & method.isin("rtk_cors", "rtk_local"), baseline_km * 0.001).otherwise(0.0)


def gnss_weight(method: Column, accuracy_m: Column) -> Column:
    w = F.element_at(_pairs(config.GNSS_QUALITY), method)
    return F.when(accuracy_m > 2, F.least(w, F.lit(0.60))).when(accuracy_m > 0.5, F.least(w, F.lit(0.85))).otherwise(w)


def gt_category(raw: Column) -> Column:
    """Known category that the text equals or whose first six letters it begins with, in fixed order; else other."""
    t = F.regexp_replace(F.trim(F.lower(raw)), "[ -]", "_")
    out = F.lit("other")
    for c in reversed(config.GT_CATEGORIES):
        out = F.when(t.startswith(c[:6]), c).otherwise(out)
    return F.when(raw.isNull() | (raw == ""), "other").otherwise(out)


def building_height(dsm: Column, dtm: Column) -> Column:
    return F.round(dsm - dtm, 2)


def height_use(height: Column) -> Column:
    """Likely use by height."""
    return (
        F.when(height.isNull(), "unknown").when(height < 0.3, "open_land").when(height < 1.5, "low_vegetation_or_rubble").when(height < 6, "single_storey_building")
        .when(height < 15, "multi_storey_building").otherwise("high_rise")
    )


def imagery_type(provider: Column, flight_height_m: Column, gsd_cm: Column) -> Column:
    p = F.lower(F.coalesce(provider, F.lit("")))
    low = (flight_height_m != 0) & (flight_height_m < 500)
    return (
        F.when(p.contains("drone") | p.contains("uav") | F.coalesce(low, F.lit(False)), "drone_ori").when(p.contains("satellite") & (gsd_cm > 0) & (gsd_cm < 50), "satellite_high_res")
        .when(p.contains("satellite"), "satellite_medium_res").when(p.contains("aerial"), "aerial_photo").otherwise("unknown")
    )
