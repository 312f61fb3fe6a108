"""Derived reconciliation records: four sources for each row of ``part``, boxes on a lattice, in whole micro-degrees.

The same rows as DuckDB SQL, for the comparison of results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landweave.tables import table

TYPES = ("CADASTRAL", "REVENUE_ROR", "MUNICIPAL_GIS", "DRONE_ORI")


def records(spark: SparkSession, folder: str) -> DataFrame:
    k, s, size = F.col("k"), F.col("s"), F.col("size")
    r = table(spark, folder, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("long").alias("size"), "p_type", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("s"))
    zero = s == 0
    # Some sites are large with a municipal outline beside them, some drone outlines lie apart, so that all kinds of conflict come out.
    large, apart = k % 17 == 0, (k % 13 == 0) & (s == 3)
    x0 = 73_850_000 + (k % 40) * 8000 + F.when(zero, 0).otherwise((k * (3 + 2 * s)) % 41 - 20) + F.when(large & (s == 2), 600).otherwise(0) + F.when(apart & ~large, 900).otherwise(0)
    y0 = 18_520_000 + F.floor(k / 40) * 8000 + F.when(zero, 0).otherwise((k * (5 + s)) % 31 - 15)
    w = 300 + (size * 7) % 90 + F.when((k + s) % 9 == 0, 25).otherwise(0) + F.when(large, 2400).otherwise(0)
    h = 280 + (size * 11) % 80
    ks = k.cast("string")
    ref = F.when(zero, F.concat(F.lit("K"), ks)).when(s == 1, F.concat(F.lit("k-"), ks)).when(s == 2, F.concat(F.lit("MUN/K"), ks)).when(k % 5 != 0, F.concat(F.lit("K"), ks))
    return r.select(
        F.concat(F.lit("case_"), F.floor(k / 200).cast("string")).alias("case_id"), F.concat(F.lit("DS"), s.cast("string"), F.lit("::"), ks).alias("record_id"), (k * 4 + s).alias("seq"), "k",
        F.concat(F.lit("DS"), s.cast("string")).alias("dataset_id"), F.element_at(F.array(*[F.lit(t) for t in TYPES]), s + 1).alias("source_type"),
        (x0 / 1e6).alias("minx"), (y0 / 1e6).alias("miny"), ((x0 + w) / 1e6).alias("maxx"), ((y0 + h) / 1e6).alias("maxy"),
        ref.alias("parcel_reference"), F.when((s == 2) & (k % 7 == 0), "OTHER").otherwise(F.col("p_type")).alias("land_use"), F.when(s < 3, (k % 20).cast("string")).alias("ward"),
        F.when(~((s == 2) & (k % 6 == 0)), F.date_add(F.lit("2015-01-01").cast("date"), ((k * 37 + s * 211) % 3000).cast("int"))).alias("capture_date"),
        F.when(s < 3, w * h / 100 * (1 + F.when(s == 1, k % 4).otherwise(0) / 25)).alias("area_sqm"),
    )


def box_text(prefix: str) -> Column:
    """GeoJSON of the box whose bounds are columns ``{prefix}minx`` and so on."""
    x0, y0, x1, y1 = (F.col(f"{prefix}{n}").cast("string") for n in ("minx", "miny", "maxx", "maxy"))
    corner = lambda x, y: F.concat(F.lit("["), x, F.lit(","), y, F.lit("]"))
    ring = F.concat_ws(",", corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1), corner(x0, y0))
    return F.concat(F.lit('{"type":"Polygon","coordinates":[['), ring, F.lit("]]}"))


SQL = """
r0 AS (SELECT p_partkey AS k, p_size::BIGINT AS size, p_type, s FROM part, (SELECT unnest([0, 1, 2, 3]) AS s)),
r1 AS (SELECT *, 73850000 + (k % 40) * 8000 + CASE WHEN s = 0 THEN 0 ELSE (k * (3 + 2 * s)) % 41 - 20 END
  + CASE WHEN k % 17 = 0 AND s = 2 THEN 600 WHEN k % 17 <> 0 AND k % 13 = 0 AND s = 3 THEN 900 ELSE 0 END AS x0,
  18520000 + (k // 40) * 8000 + CASE WHEN s = 0 THEN 0 ELSE (k * (5 + s)) % 31 - 15 END AS y0,
  300 + (size * 7) % 90 + CASE WHEN (k + s) % 9 = 0 THEN 25 ELSE 0 END + CASE WHEN k % 17 = 0 THEN 2400 ELSE 0 END AS w, 280 + (size * 11) % 80 AS h FROM r0),
r AS (SELECT 'case_' || (k // 200) AS case_id, 'DS' || s || '::' || k AS record_id, k * 4 + s AS seq, k, 'DS' || s AS dataset_id,
  ['CADASTRAL', 'REVENUE_ROR', 'MUNICIPAL_GIS', 'DRONE_ORI'][s + 1] AS source_type,
  x0 / 1e6 AS minx, y0 / 1e6 AS miny, (x0 + w) / 1e6 AS maxx, (y0 + h) / 1e6 AS maxy,
  CASE WHEN s = 0 THEN 'K' || k WHEN s = 1 THEN 'k-' || k WHEN s = 2 THEN 'MUN/K' || k WHEN k % 5 <> 0 THEN 'K' || k END AS parcel_reference,
  CASE WHEN s = 2 AND k % 7 = 0 THEN 'OTHER' ELSE p_type END AS land_use, CASE WHEN s < 3 THEN (k % 20)::VARCHAR END AS ward,
  CASE WHEN NOT (s = 2 AND k % 6 = 0) THEN DATE '2015-01-01' + ((k * 37 + s * 211) % 3000)::INT END AS capture_date,
  CASE WHEN s < 3 THEN w * h / 100 * (1 + CASE WHEN s = 1 THEN k % 4 ELSE 0 END / 25) END AS area_sqm FROM r1),
cand AS (SELECT a.case_id, a.record_id AS ida, b.record_id AS idb, a.seq AS seqa, b.seq AS seqb, a.minx AS ax0, a.miny AS ay0, a.maxx AS ax1, a.maxy AS ay1,
  b.minx AS bx0, b.miny AS by0, b.maxx AS bx1, b.maxy AS by1, a.parcel_reference AS refa, b.parcel_reference AS refb, a.land_use AS lua, b.land_use AS lub,
  a.ward AS wa, b.ward AS wb, a.capture_date AS da, b.capture_date AS db
  FROM r a JOIN r b ON a.case_id = b.case_id AND a.seq < b.seq AND a.minx - 0.01 <= b.maxx AND b.minx <= a.maxx + 0.01 AND a.miny - 0.01 <= b.maxy AND b.miny <= a.maxy + 0.01)
"""

_MLAT = "(111132.92 - 559.82 * cos(2 * radians({0})) + 1.175 * cos(4 * radians({0})))"
_MLON = "(111412.84 * cos(radians({0})) - 93.5 * cos(3 * radians({0})))"
_CORNER = """CASE WHEN greatest({q}x0 - {x}, {x} - {q}x1, 0.0) > 0 OR greatest({q}y0 - {y}, {y} - {q}y1, 0.0) > 0
  THEN sqrt(greatest({q}x0 - {x}, {x} - {q}x1, 0.0) * greatest({q}x0 - {x}, {x} - {q}x1, 0.0) + greatest({q}y0 - {y}, {y} - {q}y1, 0.0) * greatest({q}y0 - {y}, {y} - {q}y1, 0.0))
  ELSE least({x} - {q}x0, {q}x1 - {x}, {y} - {q}y0, {q}y1 - {y}) END"""
_CORNERS = ", ".join(_CORNER.format(q=q, x=f"{p}{x}", y=f"{p}{y}") for p, q in (("a", "b"), ("b", "a")) for x in ("x0", "x1") for y in ("y0", "y1"))


def measured(source: str) -> str:
    """SQL that adds iou, hd, ad and cd to a relation with the bounds ax0 to by1."""
    lat = "((ay0 + ay1) / 2 + (by0 + by1) / 2) / 2"
    area = lambda p: f"(({p}x1 - {p}x0) * ({p}y1 - {p}y0))"
    inter = "(greatest(0.0, least(ax1, bx1) - greatest(ax0, bx0)) * greatest(0.0, least(ay1, by1) - greatest(ay0, by0)))"
    return f"""SELECT *, {inter} / ((ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) - {inter}) AS iou,
  greatest({_CORNERS}) * ({_MLAT.format(lat)} + {_MLON.format(lat)}) / 2 AS hd,
  abs({area("a")} - {area("b")}) / greatest({area("a")}, {area("b")}) AS ad,
  sqrt((((ax0 + ax1) - (bx0 + bx1)) / 2 * {_MLON.format(lat)}) * (((ax0 + ax1) - (bx0 + bx1)) / 2 * {_MLON.format(lat)})
    + (((ay0 + ay1) / 2 - (by0 + by1) / 2) * {_MLAT.format(lat)}) * (((ay0 + ay1) / 2 - (by0 + by1) / 2) * {_MLAT.format(lat)})) AS cd FROM {source}"""


_ID = "nullif(regexp_replace(lower({0}), '[^a-z0-9]', '', 'g'), '')"
SCORED = f"""
m AS ({measured("cand")}),
sc AS (SELECT *, 0.4 * greatest(0.0, iou) + 0.3 * greatest(0.0, 1 - hd / 500) + 0.2 * (1 - ad) + 0.1 * greatest(0.0, 1 - cd / 500) AS g, round(g, 4) AS sg,
  CASE WHEN trim(refa) = trim(refb) THEN 1.0 WHEN {_ID.format("refa")} = {_ID.format("refb")} THEN 0.9
    WHEN contains({_ID.format("refa")}, {_ID.format("refb")}) OR contains({_ID.format("refb")}, {_ID.format("refa")}) THEN 0.6 ELSE 0.0 END AS si,
  CASE WHEN lua IS NOT NULL AND lub IS NOT NULL AND wa IS NOT NULL AND wb IS NOT NULL THEN (CASE WHEN lower(lua) = lower(lub) THEN 1.0 ELSE 0.2 END + CASE WHEN wa = wb THEN 1.0 ELSE 0.0 END) / 2
    WHEN lua IS NOT NULL AND lub IS NOT NULL THEN CASE WHEN lower(lua) = lower(lub) THEN 1.0 ELSE 0.2 END ELSE 0.5 END AS sa,
  CASE WHEN da IS NULL OR db IS NULL THEN 0.7 WHEN abs(da - db) > 365 THEN 0.4 ELSE 0.9 END AS st FROM m),
ov AS (SELECT *, round(g::DOUBLE * 0.35 + si::DOUBLE * 0.25 + sa::DOUBLE * 0.15 + st::DOUBLE * 0.10 + 0.5::DOUBLE * 0.15, 4) AS overall FROM sc),
mt AS (SELECT * FROM ov WHERE overall >= 0.60)
"""
#: Matched records of one lattice site share its parcel: members with the least record id as the parcel's.
MEMBERS = """
ed AS MATERIALIZED (SELECT ida AS u, idb AS v FROM mt UNION SELECT idb, ida FROM mt),
cc(x, y) AS (SELECT record_id, record_id FROM r UNION SELECT cc.x, ed.v FROM cc JOIN ed ON cc.y = ed.u),
mem AS MATERIALIZED (SELECT g.parcel_id, r.* FROM (SELECT x AS record_id, min(y) AS parcel_id FROM cc GROUP BY x) g JOIN r USING (record_id))
"""


def layers(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes and level lines (of no height) of other layers beside the lattice: layer, case_id, feature_id, k and bounds."""
    r = records(spark, folder).where("source_type IN ('CADASTRAL', 'DRONE_ORI')")
    c, k = F.col, F.col("k")
    one = lambda layer, when, x0, y0, x1, y1: F.when(when, F.struct(F.lit(layer).alias("layer"), F.concat(F.lit(layer + "-"), k.cast("string")).alias("feature_id"),
        x0.alias("minx"), y0.alias("miny"), x1.alias("maxx"), y1.alias("maxy")))
    first = c("source_type") == "CADASTRAL"
    mid = (c("miny") + c("maxy")) / 2
    made = F.array(
        one("utility", ~first & (k % 6 == 0), c("minx") - 0.0001, c("miny"), c("minx") + 0.0002, c("miny")), one("admin", first & (k % 10 == 0), c("minx") - 0.001, mid, c("minx") + 0.00005, mid),
        one("road", first & (k % 15 == 0), c("minx") - 0.001, c("miny") - 0.001, c("minx") + 0.00002, c("maxy") + 0.001),
    )
    return r.select("case_id", "k", F.inline(F.array_compact(made)))


LAYERS_SQL = """
la AS (SELECT 'utility' AS layer, 'utility-' || k AS feature_id, case_id, k, minx - 0.0001 AS x0, miny AS y0, minx + 0.0002 AS x1, miny AS y1 FROM r WHERE source_type = 'DRONE_ORI' AND k % 6 = 0
  UNION ALL SELECT 'admin', 'admin-' || k, case_id, k, minx - 0.001, (miny + maxy) / 2, minx + 0.00005, (miny + maxy) / 2 FROM r WHERE source_type = 'CADASTRAL' AND k % 10 = 0
  UNION ALL SELECT 'road', 'road-' || k, case_id, k, minx - 0.001, miny - 0.001, minx + 0.00002, maxy + 0.001 FROM r WHERE source_type = 'CADASTRAL' AND k % 15 = 0)
"""
