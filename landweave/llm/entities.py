"""Records of several sources matched to canonical parcels without a common key.

A cascade of rules runs from strong to weak. Each rule is an equi-join of the records that are
still unresolved on derived attributes (the cell of the corrected position, the bucket of the area,
the folded last name, ward and land use), keeps a pair only if its exact measures agree, and takes a
record out only if one parcel fits best. Pairs that canonical parcels already name are the labels:
they give each source dataset its village, its systematic shift and its spread, and each rule its
precision with Laplace smoothing, which is the confidence of its matches. A rule whose labelled
precision is below ``LEAST_PRECISION`` matches nothing.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from landweave.functions import geojson
from landweave.functions.triangles import area2
from landweave.llm import names
from landweave.session import Stage

LEAST_PRECISION = 0.5
#: Relative difference of two statements of one area.
SAME_AREA = 0.045
#: A stated area below this share of the parcel's is that of a structure on it.
STRUCTURE = 0.25
#: Metres of the wide search.
WIDE_M = 40.0
_M = 111_194.93  # metres of one degree on the sphere of 6,371,008.8 m

#: Square metres of a unit.
UNITS = {
    "sqm": 1.0, "sq.m": 1.0, "sq m": 1.0, "sq.m.": 1.0, "m2": 1.0, "sqft": 0.09290304, "sq.ft": 0.09290304, "sq ft": 0.09290304, "ha": 10_000.0,
    "hectare": 10_000.0, "acre": 4046.8564224, "guntha": 101.17141056, "are": 100.0, "sqyd": 0.83612736,
}
#: Land-use words, lower case and without final dots.
LAND_USE = {
    "residential": ("residential", "resi", "housing", "abadi", "r-1"),
    "commercial": ("commercial", "comm", "c-2", "shop", "vanijya"),
    "agricultural": ("agricultural", "agri", "agr", "krishi", "jirayat"),
    "industrial": ("industrial", "ind", "indl", "audyogik"),
    "public": ("public", "institutional", "govt", "psp", "public/semi-public"),
    "open": ("open", "open land", "vacant", "vac", "khali"),
}
_LAND = {w: k for k, words in LAND_USE.items() for w in words}
#: Property names of each attribute, in order of preference.
PROPERTIES = {
    "area": ("Area", "Plot_Area", "Measured_Area", "Extent"),
    "unit": ("Unit",),
    "owner": ("Owner_Name", "Khatadar", "Owner", "Occupant"),
    "owner2": ("Devanagari_Name",),
    "land": ("Land_Use", "Land_Class", "Usage_Type", "Use", "Classification"),
    "ward": ("Ward", "Ward_No", "Zone"),
    "locality": ("Village", "Mohalla", "Locality", "Gram"),
}
_FILL = {"", "-", "na", "n/a", "none", "null", "--"}


def position(text: str | None) -> tuple[float, float, float | None, int] | None:
    """(lon, lat, area in square metres or null, kind): 2 an area's centroid, 1 a point, 0 the mean of what a damaged text still has."""
    s = geojson.shape(text)
    if s and s[0] == "point":
        return s[1][0], s[1][1], None, 1
    if s:
        r = max((p[0] for p in s[1]), key=lambda q: abs(area2(q)))
        x0, y0 = r[0]
        a = cx = cy = 0.0
        for (x1, y1), (x2, y2) in zip(r, r[1:] + r[:1]):
            w = (x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0)
            a, cx, cy = a + w, cx + w * (x1 + x2 - 2 * x0), cy + w * (y1 + y2 - 2 * y0)
        if a:
            lat = y0 + cy / (3 * a)
            return x0 + cx / (3 * a), lat, abs(a) / 2 * _M * _M * math.cos(math.radians(lat)), 2
        return sum(p[0] for p in r) / len(r), sum(p[1] for p in r) / len(r), None, 1
    pts = [q for m in re.findall(r"\[\s*\"?(-?\d+\.\d+)\"?\s*,\s*\"?(-?\d+\.\d+)\"?", text or "") if (q := geojson.place(*m))]
    if pts:
        pts = list(dict.fromkeys(pts))
        return sum(p[0] for p in pts) / len(pts), sum(p[1] for p in pts) / len(pts), None, 0
    return None


def attributes(text: str | None) -> tuple[float | None, float | None, list[str], str | None, str | None, str | None]:
    """(area, square metres of its unit or null, owners, land use, ward, locality) of a JSON text."""
    try:
        a = json.loads(text or "")
    except (ValueError, RecursionError):
        a = None
    if not isinstance(a, dict):
        return None, None, [], None, None, None

    def get(what: str) -> str | None:
        for k in PROPERTIES[what]:
            v = a.get(k)
            if v is not None and str(v).strip().lower() not in _FILL:
                return str(v).strip()
        return None

    value = unit = None
    m = re.match(r"([\d,]*\.?\d+)\s*(.*)", get("area") or "")
    if m:
        value = float(m[1].replace(",", "")) or None
        unit_text = (m[2] or get("unit") or "").strip().lower()
        # A sender without units measures in square metres.
        unit = UNITS.get(unit_text) if unit_text else (1.0 if not any(k in a for k in PROPERTIES["unit"]) else None)
    ward = re.search(r"\d+", get("ward") or "")
    locality = get("locality")
    if locality:
        locality = names.fold(re.sub(r"^(gram|mouza|mauza|village)\s+", "", names.romanise(locality.lower())))
    land = _LAND.get((get("land") or "").lower().rstrip("."))
    return value, unit, [o for o in (get("owner"), get("owner2")) if o], land, ward.group() if ward else None, locality


def _describe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in frames:
        rows = []
        for rid, ds, g, t in zip(df["record_id"], df["dataset"], df["geometry"], df["attributes"]):
            rows.append((rid, ds, *(position(g) or (None, None, None, None)), *attributes(t)))
        yield pd.DataFrame(rows, columns=["record_id", "dataset", "lon", "lat", "shape_sqm", "kind", "area", "unit_sqm", "owners", "land", "ward", "locality"]).astype({"kind": "Int32"})


def _describe_parcels(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in frames:
        rows = []
        for cid, v, g, a, lon, lat, land, owner in df.itertuples(index=False):
            p = position(g) or (None, None, None, None)
            x, y = (p[0], p[1]) if p[3] == 2 else (geojson.place(lon, lat) or (None, None))
            sqm = a if a and a == a else p[2]
            rows.append((cid, v, x, y, sqm, _LAND.get((land or "").lower().rstrip(".")), owner if owner and owner.strip() else None))
        yield pd.DataFrame(rows, columns=["canonical_id", "village", "plon", "plat", "psqm", "pland", "powner"])


@lru_cache(maxsize=200_000)
def _read(name: str) -> tuple[tuple[str, str, str, str], ...]:
    return tuple(names.read(name))


def _edits(a: str, b: str, most: int) -> int:
    """Banded edit distance, a swap of neighbours counting one; ``most`` + 1 if larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        row = [i] + [most + 1] * len(b)
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            row[j] = min(one[j - 1] + (ca != b[j - 1]), one[j] + 1, row[j - 1] + 1)
            if i > 1 and j > 1 and ca == b[j - 2] and a[i - 2] == b[j - 1]:
                row[j] = min(row[j], two[j - 2] + 1)
        two, one = one, row
    return min(one[-1], most + 1)


@lru_cache(maxsize=200_000)
def _letters(t: str) -> int:
    """The letters of a word as bits."""
    bits = 0
    for ch in t:
        bits |= 1 << (ord(ch) & 63)
    return bits


def _alike(a: str, b: str) -> bool:
    if a == b:
        return True
    if len(a) < 2 or len(b) < 2:
        return bool(a and b) and a[0] == b[0]
    # An edit changes the set of letters by two at most.
    if abs(len(a) - len(b)) > 2 or (_letters(a) ^ _letters(b)).bit_count() > 4:
        return False
    return _edits(a, b, 2) <= (2 if min(len(a), len(b)) >= 7 else 1)


def same_owner(a: str, b: str) -> bool:
    """Two written names may be one owner's: one reading of each agrees in all parts both have."""
    for k1, f1, m1, s1 in _read(a):
        for k2, f2, m2, s2 in _read(b):
            if k1 != k2 or not (s1 and s2 and len(s1) > 1 and len(s2) > 1 and _alike(s1, s2)):
                continue
            if k1 != "person":
                return True
            nick = any(len(x) > 2 and x[-1] in "aeiou" and names._stem(y) == x[:-1] for x, y in ((f1, f2), (f2, f1)))
            if (nick or _alike(f1, f2)) and (not m1 or not m2 or _alike(m1, m2)):
                return True
    return False


def _vote(owners: pd.Series, owner: pd.Series) -> pd.Series:
    """1 if one of the record's owners may be the parcel's, -1 if none, 0 if either side is unknown."""
    out = []
    for mine, theirs in zip(owners, owner):
        known = mine is not None and len(mine) and theirs is not None
        out.append((1 if any(same_owner(o, theirs) for o in mine) else -1) if known else 0)
    return pd.Series(out, dtype="int32")


def _last_names(owners: pd.Series) -> pd.Series:
    return owners.map(lambda o: sorted({p[3] for n in (o if o is not None else ()) for p in _read(n) if p[3]}))


def calibration(records: DataFrame, parcels: DataFrame, labels: DataFrame) -> DataFrame:
    """(dataset, village, dx, dy, spread_m): where a dataset lies, its shift in metres and its spread, from labelled records."""
    known = labels.join(records, "record_id").join(parcels, "canonical_id")
    east = (F.col("lon") - F.col("plon")) * _M * F.cos(F.radians("plat"))
    north = (F.col("lat") - F.col("plat")) * _M
    off = known.select("dataset", "village", F.when(F.col("kind") == 2, east).alias("e"), F.when(F.col("kind") == 2, north).alias("n"))
    mid = off.groupBy("dataset").agg(F.mode("village").alias("village"), F.percentile_approx("e", 0.5, 10_000).alias("dx"), F.percentile_approx("n", 0.5, 10_000).alias("dy"))
    far = off.join(mid.select("dataset", "dx", "dy"), "dataset").select("dataset", F.greatest(F.abs(F.col("e") - F.col("dx")), F.abs(F.col("n") - F.col("dy"))).alias("far"))
    return mid.join(far.groupBy("dataset").agg((F.percentile_approx("far", 0.5, 10_000) * 1.2).alias("spread_m")), "dataset")


def _area_fits(tolerance: float) -> Column:
    """The stated area, under its unit or, without one, under any, is the parcel's."""
    fits = lambda sqm: F.abs(F.col("area") * sqm / F.col("psqm") - 1) <= tolerance
    anyway = fits(F.lit(1.0))
    for sqm in sorted(set(UNITS.values()) - {1.0}):
        anyway = anyway | fits(F.lit(sqm))
    return F.coalesce(F.when(F.col("unit_sqm").isNotNull(), fits(F.col("unit_sqm"))).otherwise(anyway), F.lit(False))


def _cells(x: Column, y: Column, step_m: float) -> list[Column]:
    """Cells ``step_m`` high, and as wide at 38 degrees and wider towards the equator."""
    return [F.floor(x * _M * math.cos(math.radians(geojson.LAT_RANGE[1])) / step_m).alias("cx"), F.floor(y * _M / step_m).alias("cy")]


def _at(records: DataFrame, parcels: DataFrame, reach_m: float, all_records: bool = False) -> DataFrame:
    """Pairs of records and parcels within ``reach_m`` after the shift is taken off, with ``d``.

    The smaller side is copied to the neighbouring cells: parcels where all records are looked at,
    the unresolved records later.
    """
    near = lambda df: df.withColumn("cx", F.explode(F.sequence(F.col("cx") - 1, F.col("cx") + 1))).withColumn("cy", F.explode(F.sequence(F.col("cy") - 1, F.col("cy") + 1)))
    p = parcels.where(F.col("plon").isNotNull()).select("*", *_cells(F.col("plon"), F.col("plat"), reach_m))
    r = records.where(F.col("x").isNotNull()).select("*", *_cells(F.col("x"), F.col("y"), reach_m))
    r, p = (r, near(p)) if all_records else (near(r), p)
    d = F.hypot((F.col("x") - F.col("plon")) * _M * F.cos(F.radians("plat")), (F.col("y") - F.col("plat")) * _M)
    return r.join(p, ["cx", "cy"]).withColumn("d", d).where(F.col("d") <= reach_m).drop("cx", "cy")


def _best(pairs: DataFrame, order: list[Column], alone: bool) -> DataFrame:
    """(record_id, canonical_id) of the first pair of each record; with ``alone`` only where no second one ranks with it."""
    w = Window.partitionBy("record_id").orderBy(*order)
    ranked = pairs.withColumn("_r", F.rank().over(w))
    if alone:
        top = ranked.where("_r = 1").groupBy("record_id").agg(F.min("canonical_id").alias("canonical_id"), F.max("canonical_id").alias("_o"))
        return top.where(F.col("canonical_id") == F.col("_o")).drop("_o")
    return ranked.where("_r = 1").groupBy("record_id").agg(F.min("canonical_id").alias("canonical_id"))


def match(source: DataFrame, canonical: DataFrame) -> DataFrame:
    """(record_id, canonical_id, rule, confidence, is_labelled): the parcel that each record describes, if any.

    Repeated deliveries of a record count once; null ids, and records without a fitting parcel,
    give no row. Null, damaged and filler values are missing attributes. ``is_labelled`` tells that
    some canonical parcel names the record already.
    """
    stage = Stage(source.sparkSession)
    described = source.where(F.col("record_id").isNotNull()).select("record_id", F.col("source_dataset_id").alias("dataset"), "geometry", "attributes").mapInPandas(
        _describe,
        "record_id string, dataset string, lon double, lat double, shape_sqm double, kind int, area double, unit_sqm double, owners array<string>, land string, ward string, locality string",
    )
    cols = [c for c in described.columns if c != "record_id"]
    records = stage.write(described.groupBy("record_id").agg(F.max_by(F.struct(*cols), F.hash(*cols)).alias("r")).select("record_id", "r.*"))
    parcels = stage.write(
        canonical.select("canonical_id", "village_code", "geometry", "area_sqm", "centroid_lon", "centroid_lat", "land_use", "owner_reference").mapInPandas(
            _describe_parcels, "canonical_id string, village string, plon double, plat double, psqm double, pland string, powner string"
        )
    )
    labels = stage.write(canonical.select("canonical_id", F.explode("source_record_ids").alias("record_id")).groupBy("record_id").agg(F.min("canonical_id").alias("canonical_id")))
    cal = stage.write(calibration(records, parcels, labels))
    shift_x = F.coalesce("dx", F.lit(0.0)) / (_M * F.cos(F.radians("lat")))
    todo = stage.write(
        records.join(cal, "dataset", "left").select(
            "record_id", "village", "kind", "shape_sqm", "area", "unit_sqm", "owners", "land", "ward", "locality",
            (F.col("lon") - shift_x).alias("x"), (F.col("lat") - F.coalesce("dy", F.lit(0.0)) / _M).alias("y"),
            F.least(F.lit(4.0), F.greatest(F.lit(0.5), F.coalesce("spread_m", F.lit(0.5)))).alias("spread_m"),
        )
    )
    # Ward and locality of a parcel are those of the records it names.
    of = labels.join(records.select("record_id", "ward", "locality"), "record_id").groupBy("canonical_id").agg(F.mode("ward").alias("pward"), F.mode("locality").alias("plocality"))
    parcels = stage.write(parcels.join(of, "canonical_id", "left"))

    fits = _area_fits(SAME_AREA)
    ratio = F.col("area") * F.col("unit_sqm") / F.col("psqm")
    structure = F.coalesce(ratio < STRUCTURE, F.lit(False))
    shape_ok = F.coalesce((F.col("shape_sqm") / F.col("psqm")).between(0.5, 2.0), F.lit(True))
    tight = F.col("d") <= F.greatest(F.lit(1.5), 3.5 * F.col("spread_m"))
    owner_vote = F.pandas_udf(_vote, "int")
    voted = lambda df: df.withColumn("vote", owner_vote("owners", "powner"))
    equal = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    clash = lambda a, b: F.coalesce(F.col(a) != F.col(b), F.lit(False))
    bucket = lambda sqm: F.floor(F.log(sqm) / F.lit(SAME_AREA))
    # Areas are compared in steps, so that only a clearly nearer one counts as better.
    more = [F.desc("vote"), F.desc("same"), F.floor(F.abs(F.col("sqm") / F.col("psqm") - 1) / 0.015)]
    same = equal("land", "pland").cast("int") + equal("ward", "pward").cast("int") + equal("locality", "plocality").cast("int")

    def by_area(r: DataFrame) -> DataFrame:
        """Unresolved records and parcels of their village with the same area, under any unit where none is stated."""
        units = F.when(F.col("unit_sqm").isNotNull(), F.array("unit_sqm")).otherwise(F.array(*[F.lit(u) for u in sorted(set(UNITS.values()))]))
        left = r.where(F.col("area").isNotNull() & F.col("village").isNotNull()).withColumn("sqm", F.explode(F.transform(units, lambda u: F.col("area") * u)))
        left = left.withColumn("b", F.explode(F.array(*[bucket(F.col("sqm")) + i for i in (-1, 0, 1)])))
        right = parcels.where(F.col("psqm") > 0).withColumn("b", bucket(F.col("psqm")))
        pairs = left.join(right, ["village", "b"]).where(F.abs(F.col("sqm") / F.col("psqm") - 1) <= SAME_AREA)
        return pairs.withColumn("same", same)

    def by_owner(r: DataFrame) -> DataFrame:
        """Unresolved records without an area and parcels of their village whose owner's last name or core is the same."""
        key = F.pandas_udf(_last_names, "array<string>")
        left = r.where(F.col("village").isNotNull() & (F.size("owners") > 0)).withColumn("k", F.explode(key("owners")))
        right = parcels.where(F.col("powner").isNotNull()).withColumn("k", F.explode(key(F.array("powner"))))
        return left.join(right, ["village", "k"]).dropDuplicates(["record_id", "canonical_id"]).withColumn("same", same)

    sure_place = F.col("kind") >= 1
    rules: list[tuple[str, object]] = [
        ("position_area", lambda r: _best(_at(r.where(sure_place), parcels, 15.0, True).where(tight & fits), [F.col("d")], False)),
        ("position", lambda r: _best(_at(r.where(sure_place), parcels, 15.0).where(tight & ~structure & shape_ok), [F.col("d")], False)),
        ("near_area_owner", lambda r: _best(voted(_at(r, parcels, WIDE_M).where(fits)).where("vote = 1"), [F.col("d")], False)),
        ("near_area", lambda r: _best(voted(_at(r, parcels, WIDE_M).where(fits & ((F.col("d") <= 12) | (F.col("kind") < 2) & (F.col("d") <= 25)))).where("vote = 0"), [F.col("d")], False)),
        ("near_owner", lambda r: _best(voted(_at(r, parcels, 20.0).where(~structure & F.col("area").isNull())).where("vote = 1"), [F.col("d")], False)),
        ("area_owner", lambda r: _best(voted(by_area(r.where(F.col("x").isNull()))).where("vote = 1"), more, True)),
        ("owner_place", lambda r: _best(voted(by_owner(r.where(F.col("x").isNull()))).where((F.col("vote") == 1) & ~structure & ~clash("ward", "pward") & ~clash("land", "pland")), more[:2], True)),
        ("area_place", lambda r: _best(voted(by_area(r.where(F.col("x").isNull()))).where((F.col("vote") == 0) & (F.col("same") >= 2) & ~clash("land", "pland") & ~clash("ward", "pward")), more, True)),
    ]
    out: DataFrame | None = None
    for name, rule in rules:
        hit = stage.write(rule(todo).withColumn("rule", F.lit(name)))  # type: ignore[operator]
        left = stage.write(todo.join(hit, "record_id", "left_anti"))
        stage.drop(todo)
        todo = left
        out = hit if out is None else out.unionByName(hit)
    assert out is not None
    told = out.join(labels.withColumnRenamed("canonical_id", "label"), "record_id", "left")
    right = (F.col("label") == F.col("canonical_id")).cast("int")
    precision = told.groupBy("rule").agg(F.sum(right).alias("good"), F.count("label").alias("n")).select("rule", ((F.coalesce("good", F.lit(0)) + 1) / (F.col("n") + 2)).alias("confidence"))
    # One row a rule.
    return told.join(F.broadcast(precision), "rule").where(F.col("confidence") >= LEAST_PRECISION).select(
        "record_id", "canonical_id", "rule", "confidence", F.col("label").isNotNull().alias("is_labelled")
    )
