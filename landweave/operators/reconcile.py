"""Conflicts within parcels, proposals with their gates, ripple checks, change over time and review priority."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from landweave import config
from landweave.config import DEFAULT, Config
from landweave.functions import geojson, planar
from landweave.functions.columns import step
from landweave.functions.text import token_set_ratio_col
from landweave.operators.matching import BOUNDS, measured, source_weight


def severity(hausdorff_m: Column, area_diff: Column) -> Column:
    out = F.lit("LOW")
    for name, metres, share in reversed(config.SEVERITY_FROM):
        out = F.when((hausdorff_m >= metres) | (area_diff >= share), name).otherwise(out)
    return out


def member_pairs(members: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """All pairs of one parcel's records, first by ``seq``; a parcel has few records, as many as sources describe it."""
    cols = ["record_id", "seq", *carry]
    a = members.select("parcel_id", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = members.select("parcel_id", *[F.col(c).alias(f"b_{c}") for c in cols])
    return a.join(b, "parcel_id").where("a_seq < b_seq")


def measured_pairs(members: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``member_pairs`` with their measures, of the outlines where members have them."""
    shape = ("geometry",) if "geometry" in members.columns else BOUNDS
    return measured(member_pairs(members, (*shape, *carry)))


def comparison(iou: Column, hausdorff_m: Column, area_diff: Column, shared: Column, cfg: Config = DEFAULT) -> Column:
    """GAP, OVERLAP, BOUNDARY_OFFSET, AREA_MISMATCH or NONE of two geometries; ``shared`` tells whether they share a hundredth of the smaller.

    Gap and overlap need both an iou below 0.95 and a Hausdorff distance of 50 m. Where iou is
    negative, a side is no area and the distance alone decides.
    """
    apart, far = iou < cfg.conflict_iou, hausdorff_m >= cfg.conflict_hausdorff_m
    return (
        F.when(iou < 0, F.when(far, "BOUNDARY_OFFSET").otherwise("NONE"))
        .when(apart & far, F.when(~shared, "GAP").when(iou < 0.5, "BOUNDARY_OFFSET").otherwise("OVERLAP"))
        .when(apart | far, "BOUNDARY_OFFSET").when(area_diff > cfg.conflict_area, "AREA_MISMATCH").otherwise("NONE")
    )


def shares(iou: Column, area_diff: Column) -> Column:
    """Whether two areas share at least a hundredth of the smaller, from their iou and relative difference."""
    # With the larger area 1 and the smaller s = 1 - area_diff, iou = i / (1 + s - i).
    s = 1 - area_diff
    return iou * (1 + s) / (1 + iou) >= 0.01 * s


def geometry_conflicts(pairs: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Conflicts of ``measured_pairs``: kind, severity, and LOW ones resolve by themselves. Pairs without measures have none."""
    c = F.col
    p = step(pairs, _kind=comparison(c("iou"), c("hausdorff_m"), c("area_diff"), shares(c("iou"), c("area_diff")), cfg), severity=severity(c("hausdorff_m"), c("area_diff")))
    p = p.where((c("_kind") != "NONE") & c("iou").isNotNull())
    kind = F.when(c("_kind").isin("OVERLAP", "GAP"), c("_kind")).when((c("area_diff") > 0.02) & (c("iou") >= 0.95), "AREA_MISMATCH").otherwise("BOUNDARY_OFFSET")
    return p.select("parcel_id", "a_record_id", "b_record_id", kind.alias("conflict_type"), "severity", (c("severity") == "LOW").alias("auto_resolvable"), F.round("hausdorff_m", 2).alias("measure"))


def attribute_conflicts(members: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Up to three conflicts of a pair: owners below 0.70 alike, differing land use, stated areas more than 3 % apart.

    Texts are trimmed; what one side lacks is no conflict. Members without an owner column have no
    owner conflicts.
    """
    owners = "owner_reference" in members.columns
    p = member_pairs(members, ("land_use", "area_sqm", *(("owner_reference",) if owners else ())))
    c = F.col
    plain = lambda n: F.nullif(F.trim(F.lower(n)), F.lit(""))
    one = lambda t, s, auto, m: F.struct(F.lit(t).alias("conflict_type"), s.alias("severity"), auto.alias("auto_resolvable"), m.cast("double").alias("measure"))
    diff = F.abs(c("a_area_sqm") - c("b_area_sqm")) / F.greatest("a_area_sqm", "b_area_sqm")
    found = [
        F.when(plain("a_land_use") != plain("b_land_use"), one("LAND_USE_MISMATCH", F.lit("HIGH"), F.lit(False), F.lit(None))),
        F.when((c("a_area_sqm") != 0) & (c("b_area_sqm") != 0) & (diff > cfg.stated_area),
               one("AREA_ATTRIBUTE_MISMATCH", F.when(diff < 0.10, "MEDIUM").otherwise("HIGH"), F.coalesce(diff < 0.05, F.lit(False)), F.round(diff * 100, 2))),
    ]
    if owners:
        x, y = F.trim("a_owner_reference"), F.trim("b_owner_reference")
        p = p.withColumn("_alike", F.when((x != "") & (y != ""), token_set_ratio_col(x, y) / 100))
        found.insert(0, F.when(c("_alike") < cfg.owner_at, one("OWNER_REFERENCE_MISMATCH", F.lit("MEDIUM"), F.lit(False), F.round(c("_alike") * 100, 1))))
    return p.select("parcel_id", "a_record_id", "b_record_id", F.inline(F.array_compact(F.array(*found))))


def provenance_conflicts(told: DataFrame) -> DataFrame:
    """One conflict a parcel, over all its records, from the result of ``lineage.independence``: unknown lineage, or one origin shared by all."""
    bad = told.where(F.col("verdict").isin("UNKNOWN_LINEAGE", "SHARED_ORIGIN"))
    shared = F.col("verdict") == "SHARED_ORIGIN"
    none = F.lit(None)
    return bad.select(
        F.col("group_id").alias("parcel_id"), none.cast("string").alias("a_record_id"), none.cast("string").alias("b_record_id"), F.col("verdict").alias("conflict_type"),
        F.when(shared, "LOW").otherwise("MEDIUM").alias("severity"), shared.alias("auto_resolvable"), none.cast("double").alias("measure"),
    )


def attribute_consensus(members: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(parcel_id, field, value, disagreements): the value of the heaviest source, the first of equals."""
    each = members.select("parcel_id", "seq", source_weight(F.col("source_type")).alias("w"), F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])))
    each = each.where("value IS NOT NULL AND value <> ''")
    return each.groupBy("parcel_id", "field").agg(F.max_by("value", F.struct("w", -F.col("seq"))).alias("value"), (F.count_distinct("value") - 1).alias("disagreements"))


def centroid_consensus(members: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(parcel_id, lon, lat, reference_id, shift_m, fraction, moved_m, dlon, dlat, area_change) of each parcel.

    The reference is the record of the heaviest source, the first of equals. In the consensus it
    weighs 1 and the others as their sources. Below ``noise_m`` it stays; else it moves by the share
    min(0.7, d / 500) of the way. The area changes only by the metres of a degree at its new latitude.
    """
    m = members.withColumn("w", source_weight(F.col("source_type")))
    if "centroid_lon" in members.columns:
        m = m.withColumn("cx", F.col("centroid_lon")).withColumn("cy", F.col("centroid_lat"))
    else:
        m = m.withColumn("cx", (F.col("minx") + F.col("maxx")) / 2).withColumn("cy", (F.col("miny") + F.col("maxy")) / 2)
    c = F.col
    g = m.groupBy("parcel_id").agg(
        F.max_by(F.struct("record_id", "cx", "cy", "w"), F.struct("w", -F.col("seq"))).alias("r"), F.sum(c("w") * c("cx")).alias("sx"), F.sum(c("w") * c("cy")).alias("sy"), F.sum("w").alias("sw")
    )
    # The reference's own weight gives way to 1.
    total = c("sw") - c("r.w") + 1
    g = step(g, lon=(c("sx") + (1 - c("r.w")) * c("r.cx")) / total, lat=(c("sy") + (1 - c("r.w")) * c("r.cy")) / total)
    g = step(g, shift_m=F.sqrt(F.pow((c("lon") - c("r.cx")) * planar.lon_metres(c("r.cy")), F.lit(2)) + F.pow((c("lat") - c("r.cy")) * planar.lat_metres(c("r.cy")), F.lit(2))))
    g = step(g, fraction=F.when(c("shift_m") < cfg.noise_m, 0.0).otherwise(F.least(F.lit(cfg.most_adjustment), c("shift_m") / 500)))
    scale = lambda lat: planar.lat_metres(lat) * planar.lon_metres(lat)
    dlat = (c("lat") - c("r.cy")) * c("fraction")
    return g.select(
        "parcel_id", "lon", "lat", c("r.record_id").alias("reference_id"), "shift_m", "fraction", (c("shift_m") * c("fraction")).alias("moved_m"),
        ((c("lon") - c("r.cx")) * c("fraction")).alias("dlon"), dlat.alias("dlat"), F.abs(scale(c("r.cy") + dlat) / scale(c("r.cy")) - 1).alias("area_change"),
    )


def moved(geometry: Column, dlon: Column, dlat: Column) -> Column:
    """A GeoJSON geometry moved by degrees; as it is where the move is nothing, null where it can't be read."""

    def run(g: pd.Series, dx: pd.Series, dy: pd.Series) -> pd.Series:
        def shift(c: list, x: float, y: float) -> list:
            return [c[0] + x, c[1] + y, *c[2:]] if c and not isinstance(c[0], list) else [shift(i, x, y) for i in c]

        out = []
        for t, x, y in zip(g, dx, dy):
            shape = geojson.load(t)
            if shape is None or not (x or y):
                out.append(t)
            else:
                out.append(json.dumps({**shape, "coordinates": shift(shape.get("coordinates") or [], x, y)}))
        return pd.Series(out, dtype="object")

    return F.when((dlon == 0) & (dlat == 0), geometry).otherwise(F.pandas_udf(run, "string")(geometry, dlon, dlat))


def gates(parcels: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Adds ``failed`` (names of failed gates) and ``status`` to rows with critical, max_offset_m, area_change, confidence and lineages."""
    checks = [
        ("NO_CRITICAL", F.col("critical") > 0), ("OFFSET", F.col("max_offset_m") > cfg.auto_offset_m), ("AREA", F.col("area_change") > cfg.auto_area_share),
        ("CONFIDENCE", F.col("confidence") < cfg.auto_confidence), ("LINEAGES", F.col("lineages") < cfg.auto_lineages),
    ]
    failed = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks]))
    return parcels.withColumn("failed", failed).withColumn("status", F.when(F.size("failed") == 0, "AUTO_APPROVED").otherwise("REVIEW_REQUIRED"))


def overlap_sqm(a: str, b: str) -> Column:
    """Shared area of two boxes by the ripple checks' rough scale."""
    c = lambda p, n: F.col(p + n)
    return planar.overlap(c(a, "minx"), c(a, "maxx"), c(b, "minx"), c(b, "maxx")) * planar.overlap(c(a, "miny"), c(a, "maxy"), c(b, "miny"), c(b, "maxy")) * planar.RIPPLE_SQM_PER_DEG2


def change_events(members: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Geometry and land-use changes between a parcel's records in order of time; unknown times come first."""
    w = Window.partitionBy("parcel_id").orderBy(F.coalesce("capture_date", F.lit("1970-01-01").cast("date")), "seq")
    m = members.withColumn("ord", F.row_number().over(w))
    shape = ("geometry",) if "geometry" in members.columns else BOUNDS
    cols = ("record_id", "ord", "capture_date", "land_use", *shape)
    a = m.select("parcel_id", *[F.col(x).alias(f"a_{x}") for x in cols])
    b = m.select("parcel_id", *[F.col(x).alias(f"b_{x}") for x in cols])
    p = a.join(b, "parcel_id").where("a_ord < b_ord")
    p = measured(p)
    c = F.col
    gap = F.datediff("b_capture_date", "a_capture_date")
    late = F.coalesce(F.abs(gap) > cfg.change_gap_days, F.lit(False))
    noise = (c("hausdorff_m") < 0.5) & (c("area_diff") < 0.01)
    drift = (c("hausdorff_m") <= 3) & (c("area_diff") < 0.02)
    event = lambda t, s: F.struct(t.alias("change_type"), s.alias("severity"))
    shape = F.when(~noise, F.when(drift, event(F.lit("BOUNDARY_DRIFT"), F.lit("LOW"))).when(c("iou") < 0.90, event(F.lit("GEOMETRY_CHANGE"), F.when(late, "MEDIUM").otherwise("HIGH")))
                   .when(c("area_diff") > 0.03, event(F.lit("AREA_CHANGE"), F.lit("MEDIUM"))).otherwise(event(F.lit("GEOMETRY_CHANGE"), F.lit("LOW"))))
    plain = lambda n: F.nullif(F.trim(F.lower(n)), F.lit(""))
    land = F.when(plain("a_land_use") != plain("b_land_use"), event(F.lit("LAND_USE_CHANGE"), F.lit("HIGH")))
    return p.select("parcel_id", "a_record_id", "b_record_id", gap.alias("gap_days"), late.alias("is_temporal"), F.inline(F.array_compact(F.array(shape, land))))


def priority(confidence: Column, unresolved: Column, severity_points: Column, critical_ripple: Column, other_ripple: Column, offset_m: Column) -> Column:
    """Review priority of a proposal, higher first."""
    return (
        F.floor((1 - confidence) * 50) + unresolved * 15 + severity_points + critical_ripple * 30 + other_ripple * 10
        + F.when(offset_m > 5, 30).when(offset_m > 2, 15).otherwise(0)
    ).cast("long")


def severity_points(c: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in config.SEVERITY_POINTS.items() for x in kv])
    return F.coalesce(F.element_at(m, c), F.lit(0))
