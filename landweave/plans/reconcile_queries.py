"""Queries of matching, parcels, conflicts, proposals, ripple and change over the derived records, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landweave.functions import planar
from landweave.operators import components, matching, ml, reconcile, ripple, topology
from landweave.plans import views
from landweave.session import Stage

_PAIR = ("a_record_id", "b_record_id")


def candidate_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return matching.candidates(views.records(spark, folder)).select("case_id", *_PAIR)


def range_query_metres(spark: SparkSession, folder: str) -> DataFrame:
    """Records within 900 m of every twentieth record, whatever its source."""
    r = views.records(spark, folder)
    # Numbers of four sources follow each other in seq, so its fives would be of one source only.
    return matching.near_boxes(r, r.where("(seq + k) % 20 = 0"), 900.0)


def geom_area_centroid_bbox(spark: SparkSession, folder: str) -> DataFrame:
    r = views.records(spark, folder)
    area = planar.box_area_sqm(*[F.col(c) for c in matching.BOUNDS])
    return r.select("record_id", *matching.BOUNDS, F.round((F.col("minx") + F.col("maxx")) / 2, 7).alias("lon"), F.round((F.col("miny") + F.col("maxy")) / 2, 7).alias("lat"), F.round(area, 4).alias("sqm"))


def _measured(spark: SparkSession, folder: str) -> DataFrame:
    return matching.measured(matching.candidates(views.records(spark, folder)))


def geom_pair_measures(spark: SparkSession, folder: str) -> DataFrame:
    return _measured(spark, folder).select(*_PAIR, *[F.round(c, 6).alias(c) for c in ("iou", "area_diff")], *[F.round(c, 4).alias(c) for c in ("hausdorff_m", "centroid_m")])


def geom_compare_class(spark: SparkSession, folder: str) -> DataFrame:
    """Severity and kind of every candidate pair."""
    c = F.col
    kind = reconcile.comparison(c("iou"), c("hausdorff_m"), c("area_diff"), reconcile.shares(c("iou"), c("area_diff")))
    return _measured(spark, folder).select(*_PAIR, reconcile.severity(c("hausdorff_m"), c("area_diff")).alias("severity"), kind.alias("kind"))


def identifier_scores(spark: SparkSession, folder: str) -> DataFrame:
    p = matching.candidates(views.records(spark, folder), carry=("parcel_reference",))
    return p.select(*_PAIR, matching.identifier_score([(F.col("a_parcel_reference"), F.col("b_parcel_reference"))]).alias("score"))


def temporal_scores(spark: SparkSession, folder: str) -> DataFrame:
    p = matching.candidates(views.records(spark, folder), carry=("capture_date",))
    score = matching.temporal_score(F.col("a_capture_date"), F.col("b_capture_date"))
    return p.select(*_PAIR, score.alias("score"))


def _matches(spark: SparkSession, folder: str) -> DataFrame:
    """Matched pairs with all scores; written once for a folder."""
    return Stage(spark).once("lattice matches", f"{folder}/part.parquet", lambda: matching.scored(views.records(spark, folder), matches_only=True))


def match_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _matches(spark, folder).select(*_PAIR, *[f"score_{n}" for n in ("geometry", "identifier", "attribute", "temporal", "provenance")], "overall", "requires_review")


def confidence_explain(spark: SparkSession, folder: str) -> DataFrame:
    return matching.explain(_matches(spark, folder)).select(*_PAIR, "signal", "contribution", "delta")


def confidence_verdict(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict of each matched pair, and the signals that lift and lower it most."""
    return matching.signals(_matches(spark, folder))


def _matched(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Matched pairs, and members: records with the parcel_id of their group."""
    pairs, r = _matches(spark, folder), views.records(spark, folder)

    def members() -> DataFrame:
        groups = components.components(r.select(F.col("record_id").alias("node")), pairs.select(F.col("a_record_id").alias("u"), F.col("b_record_id").alias("v")))
        return r.join(groups.select(F.col("node").alias("record_id"), F.col("label").alias("parcel_id")), "record_id")

    return pairs, Stage(spark).once("lattice members", f"{folder}/part.parquet", members)


def entity_components(spark: SparkSession, folder: str) -> DataFrame:
    return _matched(spark, folder)[1].select("record_id", "parcel_id")


def best_evidence(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(parcel_id, confidence, best_a, best_b): the pair with the highest score of each parcel, the first of equals."""
    p = pairs.join(members.select(F.col("record_id").alias("a_record_id"), "parcel_id", F.col("seq").alias("_a")), "a_record_id").join(members.select(F.col("record_id").alias("b_record_id"), F.col("seq").alias("_b")), "b_record_id")
    top = F.max_by(F.struct("overall", "a_record_id", "b_record_id"), F.struct("overall", -F.col("_a"), -F.col("_b")))
    return p.groupBy("parcel_id").agg(top.alias("t")).select("parcel_id", F.col("t.overall").alias("confidence"), F.col("t.a_record_id").alias("best_a"), F.col("t.b_record_id").alias("best_b"))


def canonical_parcels(spark: SparkSession, folder: str) -> DataFrame:
    """Resolved parcels: members, distinct source types, best pair and best source record."""
    pairs, members = _matched(spark, folder)
    w = matching.source_weight(F.col("source_type"))
    g = members.groupBy("parcel_id").agg(
        F.count("*").alias("records"), F.count_distinct("source_type").alias("independent_lineages"), F.max_by("record_id", F.struct(w, -F.col("seq"))).alias("reference_id")
    )
    return g.join(best_evidence(pairs, members), "parcel_id", "left")


def conflicts_geometry(spark: SparkSession, folder: str) -> DataFrame:
    return reconcile.geometry_conflicts(reconcile.measured_pairs(_matched(spark, folder)[1])).drop("measure")


def conflicts_attribute(spark: SparkSession, folder: str) -> DataFrame:
    return reconcile.attribute_conflicts(_matched(spark, folder)[1]).drop("measure")


def _conflicts(members: DataFrame) -> DataFrame:
    """Geometry and attribute conflicts; the lattice names no lineage nodes, so there are no provenance conflicts."""
    return reconcile.geometry_conflicts(reconcile.measured_pairs(members)).unionByName(reconcile.attribute_conflicts(members))


def flagship_conflict_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Conflicts by type and severity over all resolved parcels."""
    return _conflicts(_matched(spark, folder)[1]).groupBy("conflict_type", "severity").agg(F.count("*").alias("conflicts"), F.count_distinct("parcel_id").alias("parcels"))


def conflict_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _conflicts(_matched(spark, folder)[1]).groupBy("parcel_id").agg(F.count("*").alias("conflicts"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"))


def proposal_attributes(spark: SparkSession, folder: str) -> DataFrame:
    return reconcile.attribute_consensus(_matched(spark, folder)[1], ("parcel_reference", "land_use", "ward"))


def proposal_consensus(spark: SparkSession, folder: str) -> DataFrame:
    c = reconcile.centroid_consensus(_matched(spark, folder)[1])
    return c.select("parcel_id", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"), "reference_id", F.round("shift_m", 3).alias("shift_m"), F.round("fraction", 4).alias("fraction"), F.round("moved_m", 3).alias("moved_m"))


def _proposed(members: DataFrame) -> DataFrame:
    """(parcel_id, case_id, k and bounds of the proposed box, o_ those of the first record's box)."""
    c = reconcile.centroid_consensus(members).select("parcel_id", "reference_id", "dlon", "dlat")
    p = members.join(c, "parcel_id").where(F.col("record_id") == F.col("reference_id"))
    p = p.select("parcel_id", "case_id", "k", *[(F.col(n) + F.col("dlon" if n[-1] == "x" else "dlat")).alias(f"n_{n}") for n in matching.BOUNDS])
    first = members.groupBy("parcel_id").agg(F.min_by(F.struct(*matching.BOUNDS), "seq").alias("f"))
    return p.join(first, "parcel_id").select("*", *[F.col(f"f.{n}").alias(f"o_{n}") for n in matching.BOUNDS]).drop("f")


def _ripple(spark: SparkSession, folder: str) -> DataFrame:
    """Issues of the proposed boxes with what lies around their site: their own municipal outline as a building, utilities, boundaries and roads."""
    members = _matched(spark, folder)[1]
    p = _proposed(members)
    c = F.col
    bounds = lambda x: [c(n).alias(f"b_{n}") for n in matching.BOUNDS]
    b = p.join(members.where("source_type = 'MUNICIPAL_GIS'").select("parcel_id", c("record_id").alias("feature_id"), *bounds("b")), "parcel_id")
    whole = (c("b_maxx") - c("b_minx")) * (c("b_maxy") - c("b_miny")) * planar.RIPPLE_SQM_PER_DEG2
    out = [ripple.found(b, "parcel_id", "feature_id", ripple.building(F.round(whole - reconcile.overlap_sqm("b_", "n_"), 3)))]
    f = p.join(views.layers(spark, folder).select("layer", "case_id", "k", "feature_id", *bounds("b")), ["case_id", "k"])
    across = lambda a: planar.overlap(c(f"{a}minx"), c(f"{a}maxx"), c("b_minx"), c("b_maxx")) * planar.RIPPLE_M_PER_DEG
    on = lambda a: F.when((c("b_miny") == c(f"{a}miny")) | (c("b_miny") == c(f"{a}maxy")), F.round(across(a), 3)).otherwise(0.0)
    out.append(ripple.found(f.where("layer = 'utility'"), "parcel_id", "feature_id", ripple.utility(on("n_"), on("o_"))))
    inside = F.when((c("b_miny") > c("n_miny")) & (c("b_miny") < c("n_maxy")), F.round(across("n_"), 3)).otherwise(0.0)
    out.append(ripple.found(f.where("layer = 'admin'"), "parcel_id", "feature_id", ripple.boundary(inside)))
    out.append(ripple.found(f.where("layer = 'road'"), "parcel_id", "feature_id", ripple.road(F.round(reconcile.overlap_sqm("n_", "b_"), 3))))
    return reduce(DataFrame.unionByName, out)


def _proposals(spark: SparkSession, folder: str) -> DataFrame:
    """Parcels with what the gates look at, their failed gates, ripple issues and status."""
    pairs, members = _matched(spark, folder)
    measured = Stage(spark).once("lattice measured", f"{folder}/part.parquet", lambda: reconcile.measured_pairs(members))
    conflicts = reconcile.geometry_conflicts(measured).unionByName(reconcile.attribute_conflicts(members))
    con = conflicts.groupBy("parcel_id").agg(F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.count_if(~F.col("auto_resolvable")).alias("unresolved"),
                                             F.sum(F.when(~F.col("auto_resolvable"), reconcile.severity_points(F.col("severity"))).otherwise(0)).alias("points"))
    far = measured.groupBy("parcel_id").agg(F.max("hausdorff_m").alias("max_offset_m"))
    best = best_evidence(pairs, members).select("parcel_id", "confidence")
    p = members.groupBy("parcel_id").agg(F.count_distinct("source_type").alias("lineages"))
    p = p.join(reconcile.centroid_consensus(members).select("parcel_id", "area_change"), "parcel_id").join(best, "parcel_id", "left").join(con, "parcel_id", "left").join(far, "parcel_id", "left")
    gated = reconcile.gates(p.na.fill(0, ["critical", "unresolved", "points"]).na.fill(0.0, ["confidence", "max_offset_m", "area_change"]))
    return ripple.override(gated, _ripple(spark, folder))


def proposal_gates(spark: SparkSession, folder: str) -> DataFrame:
    return _proposals(spark, folder).select("parcel_id", "critical", "lineages", F.array_join("failed", ",").alias("failed"), "blocking", "status")


def review_queue_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The hundred most urgent proposals that need review."""
    p = _proposals(spark, folder).where("status = 'REVIEW_REQUIRED'")
    pr = reconcile.priority(*[F.col(n) for n in ("confidence", "unresolved", "points", "critical_ripple", "other_ripple", "max_offset_m")])
    return p.select("parcel_id", pr.alias("priority")).orderBy(F.desc("priority"), "parcel_id").limit(100)


def _boxes(df: DataFrame, prefix: str, *more: str) -> DataFrame:
    return df.select("case_id", *[F.col(c).alias(f"{prefix}{c}") for c in ("record_id", *matching.BOUNDS)], *more)


def ripple_neighbor_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Increase of overlap with a neighbour when a parcel takes the drone outline over the first record's, both widened by 0.004 degrees so that outlines meet."""
    r = views.records(spark, folder)
    grow = lambda df: df.withColumn("minx", F.col("minx") - 0.004).withColumn("maxx", F.col("maxx") + 0.004).withColumn("miny", F.col("miny") - 0.004).withColumn("maxy", F.col("maxy") + 0.004)
    first = grow(r.where("source_type = 'CADASTRAL'"))
    new = grow(r.where("source_type = 'DRONE_ORI'"))
    near = matching.candidates(first, carry=("k",)).select("case_id", F.col("a_k").alias("k"), F.col("b_k").alias("k2"))
    p = near.join(_boxes(new, "n_", "k"), ["case_id", "k"]).join(_boxes(first, "o_", "k"), ["case_id", "k"]).join(_boxes(first, "b_", F.col("k").alias("k2")), ["case_id", "k2"])
    more = reconcile.overlap_sqm("n_", "b_") - reconcile.overlap_sqm("o_", "b_")
    return ripple.found(p, "n_record_id", "b_record_id", ripple.neighbor(F.round(more, 3)))


def ripple_issues(spark: SparkSession, folder: str) -> DataFrame:
    """Issues of proposals with buildings, utilities, boundaries and roads."""
    return _ripple(spark, folder)


def ripple_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Issues of all five kinds with the number that block approval."""
    return ripple.summary(ripple_neighbor_overlap(spark, folder).unionByName(_ripple(spark, folder)))


def topology_overlap_split(spark: SparkSession, folder: str) -> DataFrame:
    """Corrections of the parcels' overlapping pairs: the heavier source keeps what both claim."""
    m = _matched(spark, folder)[1].withColumn("geometry", views.box_text(""))
    return _corrections(m, ("OVERLAP",))


def topology_corrections(spark: SparkSession, folder: str) -> DataFrame:
    """Outcome and amount of the correction of every conflicting pair, by its kind of conflict."""
    m = _matched(spark, folder)[1].withColumn("geometry", views.box_text(""))
    return _corrections(m, ("OVERLAP", "GAP", "BOUNDARY_OFFSET"))


def _corrections(members: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    conflicts = reconcile.geometry_conflicts(reconcile.measured_pairs(members)).where(F.col("conflict_type").isin(*kinds))
    fixed = topology.corrections(conflicts, members)
    return fixed.select("parcel_id", "a_record_id", "b_record_id", "conflict_type", "outcome", F.round("amount", 2).alias("amount"))


def _sites(spark: SparkSession, folder: str) -> DataFrame:
    return views.records(spark, folder).withColumn("parcel_id", F.col("k").cast("string"))


def change_events(spark: SparkSession, folder: str) -> DataFrame:
    return reconcile.change_events(_sites(spark, folder))


def change_summary(spark: SparkSession, folder: str) -> DataFrame:
    return change_events(spark, folder).groupBy("change_type", "severity").agg(F.count("*").alias("events"), F.count_if("is_temporal").alias("temporal"))


def temporal_span(spark: SparkSession, folder: str) -> DataFrame:
    g = _sites(spark, folder).groupBy("parcel_id").agg(F.min("capture_date").alias("earliest"), F.max("capture_date").alias("latest"), F.count("capture_date").alias("dated"))
    return g.select("parcel_id", F.col("earliest").cast("string"), F.col("latest").cast("string"), "dated", F.datediff("latest", "earliest").alias("span_days"))


def ml_features(spark: SparkSession, folder: str) -> DataFrame:
    """Feature vector of matched pairs, each feature within its range."""
    p = _matches(spark, folder)
    return p.select(*_PAIR, *[F.round(v, 5 if n in ("iou", "area_ratio_diff") else 6).alias(n) for n, v in ml.features(p).items()])


QUERIES = {f.__name__: f for f in (
    flagship_conflict_summary, candidate_pairs, range_query_metres, geom_area_centroid_bbox, geom_pair_measures, geom_compare_class, identifier_scores, temporal_scores, match_scores,
    confidence_explain, confidence_verdict, entity_components, canonical_parcels, conflicts_geometry, conflicts_attribute, conflict_counts, proposal_attributes, proposal_consensus, proposal_gates,
    review_queue_topk, ripple_neighbor_overlap, ripple_issues, ripple_summary, topology_overlap_split, topology_corrections, change_events, change_summary, temporal_span, ml_features,
)}

_V = "WITH " + views.SQL
_S = _V + "," + views.SCORED
_M = "WITH RECURSIVE " + views.SQL + "," + views.SCORED + "," + views.MEMBERS
_AREA = f"((maxx - minx) * (maxy - miny) * {views._MLAT.format('(miny + maxy) / 2')} * {views._MLON.format('(miny + maxy) / 2')})"
# The rules below are written from the specification of severities and kinds, not from this package's constants.
_SEV = "CASE WHEN hd >= 5 OR ad >= 0.10 THEN 'CRITICAL' WHEN hd >= 2 OR ad >= 0.05 THEN 'HIGH' WHEN hd >= 0.5 OR ad >= 0.02 THEN 'MEDIUM' ELSE 'LOW' END"
_SHARED = "greatest(0.0, least(ax1, bx1) - greatest(ax0, bx0)) * greatest(0.0, least(ay1, by1) - greatest(ay0, by0))"
_SMALLER = "least((ax1 - ax0) * (ay1 - ay0), (bx1 - bx0) * (by1 - by0))"
_KIND = f"""CASE WHEN iou < 0.95 AND hd >= 50 THEN CASE WHEN {_SHARED} < 0.01 * {_SMALLER} THEN 'GAP' WHEN iou < 0.5 THEN 'BOUNDARY_OFFSET' ELSE 'OVERLAP' END
  WHEN iou < 0.95 OR hd >= 50 THEN 'BOUNDARY_OFFSET' WHEN ad > 0.05 THEN 'AREA_MISMATCH' ELSE 'NONE' END"""
_TWO = """SELECT a.{0} AS parcel_id, a.record_id AS ida, b.record_id AS idb, a.minx AS ax0, a.miny AS ay0, a.maxx AS ax1, a.maxy AS ay1, b.minx AS bx0, b.miny AS by0, b.maxx AS bx1, b.maxy AS by1,
  a.land_use AS lua, b.land_use AS lub, a.area_sqm AS aa, b.area_sqm AS ab, a.capture_date AS da, b.capture_date AS db, a.source_type AS ta, b.source_type AS tb FROM {1} a JOIN {1} b ON a.{0} = b.{0} AND {2}"""
_CON = f""",
mp AS ({_TWO.format("parcel_id", "mem", "a.seq < b.seq")}), mpm AS ({views.measured("mp")}),
gk AS (SELECT *, {_KIND} AS kind, {_SEV} AS severity FROM mpm),
gc AS (SELECT *, CASE WHEN kind IN ('OVERLAP', 'GAP') THEN kind WHEN ad > 0.02 AND iou >= 0.95 THEN 'AREA_MISMATCH' ELSE 'BOUNDARY_OFFSET' END AS conflict_type FROM gk WHERE kind <> 'NONE'),
dif AS (SELECT *, abs(aa - ab) / greatest(aa, ab) AS d FROM mp),
ac AS (SELECT parcel_id, ida, idb, 'LAND_USE_MISMATCH' AS conflict_type, 'HIGH' AS severity, false AS auto_resolvable FROM mp WHERE trim(lower(lua)) <> trim(lower(lub)) AND trim(lua) <> '' AND trim(lub) <> ''
  UNION ALL SELECT parcel_id, ida, idb, 'AREA_ATTRIBUTE_MISMATCH', CASE WHEN d < 0.10 THEN 'MEDIUM' ELSE 'HIGH' END, d < 0.05 FROM dif WHERE aa <> 0 AND ab <> 0 AND d > 0.03),
con AS (SELECT parcel_id, ida, idb, conflict_type, severity, severity = 'LOW' AS auto_resolvable FROM gc UNION ALL SELECT * FROM ac)
"""
_W = "CASE source_type WHEN 'CADASTRAL' THEN 0.8 WHEN 'REVENUE_ROR' THEN 0.75 WHEN 'MUNICIPAL_GIS' THEN 0.7 ELSE 0.9 END"
_BEST = """(SELECT x.parcel_id, max(overall) AS confidence, arg_max(ida, (overall, -x.seq, -y.seq)) AS best_a, arg_max(idb, (overall, -x.seq, -y.seq)) AS best_b
  FROM mt JOIN mem x ON mt.ida = x.record_id JOIN mem y ON mt.idb = y.record_id GROUP BY 1)"""
_CENTRE = f""",
cg AS (SELECT parcel_id, any_value(case_id) AS case_id, any_value(k) AS k, sum(w * cx) AS sx, sum(w * cy) AS sy, sum(w) AS sw, arg_max(record_id, (w, -seq)) AS reference_id, arg_max(cx, (w, -seq)) AS rx, arg_max(cy, (w, -seq)) AS ry, max(w) AS rw,
  arg_max(minx, (w, -seq)) AS rx0, arg_max(miny, (w, -seq)) AS ry0, arg_max(maxx, (w, -seq)) AS rx1, arg_max(maxy, (w, -seq)) AS ry1, arg_min(minx, seq) AS ox0, arg_min(miny, seq) AS oy0, arg_min(maxx, seq) AS ox1, arg_min(maxy, seq) AS oy1
  FROM (SELECT *, ({_W})::DOUBLE AS w, (minx + maxx) / 2 AS cx, (miny + maxy) / 2 AS cy FROM mem) GROUP BY 1),
ch AS (SELECT *, (sx - rw * rx + rx) / (sw - rw + 1) AS lon, (sy - rw * ry + ry) / (sw - rw + 1) AS lat FROM cg),
ci AS (SELECT *, sqrt(pow((lon - rx) * {views._MLON.format("ry")}, 2) + pow((lat - ry) * {views._MLAT.format("ry")}, 2)) AS d FROM ch),
cf AS (SELECT *, CASE WHEN d < 2 THEN 0 ELSE least(0.7, d / 500) END AS fraction FROM ci),
cn AS (SELECT *, (lon - rx) * fraction AS dx, (lat - ry) * fraction AS dy FROM cf),
np AS (SELECT *, rx0 + dx AS nx0, ry0 + dy AS ny0, rx1 + dx AS nx1, ry1 + dy AS ny1 FROM cn)
"""
_RIP = f""",{views.LAYERS_SQL},
ri AS (SELECT p.parcel_id, b.record_id AS feature_id, 'BUILDING_OUTSIDE' AS issue, 'HIGH' AS severity, round((b.maxx - b.minx) * (b.maxy - b.miny) * 12391000000.0
    - greatest(0.0, least(b.maxx, nx1) - greatest(b.minx, nx0)) * greatest(0.0, least(b.maxy, ny1) - greatest(b.miny, ny0)) * 12391000000.0, 3) AS amount FROM np p JOIN mem b ON p.parcel_id = b.parcel_id AND b.source_type = 'MUNICIPAL_GIS'
  UNION ALL SELECT parcel_id, feature_id, 'UTILITY_RUN', 'MEDIUM', CASE WHEN (y0 = ny0 OR y0 = ny1) AND NOT ((y0 = oy0 OR y0 = oy1) AND round(greatest(0.0, least(ox1, x1) - greatest(ox0, x0)) * 111000.0, 3) >= 0.5)
    THEN round(greatest(0.0, least(nx1, x1) - greatest(nx0, x0)) * 111000.0, 3) ELSE 0 END FROM np JOIN la USING (case_id, k) WHERE layer = 'utility'
  UNION ALL SELECT parcel_id, feature_id, 'ADMIN_BOUNDARY', 'HIGH', CASE WHEN y0 > ny0 AND y0 < ny1 THEN round(greatest(0.0, least(nx1, x1) - greatest(nx0, x0)) * 111000.0, 3) ELSE 0 END FROM np JOIN la USING (case_id, k) WHERE layer = 'admin'
  UNION ALL SELECT parcel_id, feature_id, 'ROAD_OVERLAP', 'CRITICAL', round(greatest(0.0, least(nx1, x1) - greatest(nx0, x0)) * greatest(0.0, least(ny1, y1) - greatest(ny0, y0)) * 12391000000.0, 3) FROM np JOIN la USING (case_id, k) WHERE layer = 'road'),
rip AS (SELECT * FROM ri WHERE amount > CASE issue WHEN 'BUILDING_OUTSIDE' THEN 1 WHEN 'ROAD_OVERLAP' THEN 1 ELSE 0.5 END)
"""
_PROP = _CON + _CENTRE + _RIP + f""",
pt AS (SELECT l.parcel_id, l.lineages, coalesce(confidence, 0) AS confidence, coalesce(critical, 0) AS critical, coalesce(unresolved, 0) AS unresolved, coalesce(points, 0) AS points, coalesce(off, 0) AS off,
    abs({views._MLAT.format("(np.ry + np.dy)")} * {views._MLON.format("(np.ry + np.dy)")} / ({views._MLAT.format("np.ry")} * {views._MLON.format("np.ry")}) - 1) AS arc, coalesce(grave, 0) AS grave, coalesce(rest, 0) AS rest, coalesce(blocking, 0) AS blocking
  FROM (SELECT parcel_id, count(DISTINCT source_type) AS lineages FROM mem GROUP BY 1) l JOIN np USING (parcel_id) LEFT JOIN {_BEST} b USING (parcel_id)
  LEFT JOIN (SELECT parcel_id, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (NOT auto_resolvable) AS unresolved,
    sum(CASE WHEN auto_resolvable THEN 0 ELSE CASE severity WHEN 'CRITICAL' THEN 100 WHEN 'HIGH' THEN 70 WHEN 'MEDIUM' THEN 40 ELSE 10 END END) AS points FROM con GROUP BY 1) c USING (parcel_id)
  LEFT JOIN (SELECT parcel_id, count(*) FILTER (severity = 'CRITICAL') AS grave, count(*) FILTER (severity <> 'CRITICAL') AS rest, count(*) FILTER (severity IN ('CRITICAL', 'HIGH')) AS blocking FROM rip GROUP BY 1) r USING (parcel_id)
  LEFT JOIN (SELECT parcel_id, max(hd) AS off FROM mpm GROUP BY 1) f USING (parcel_id)),
gt AS (SELECT *, concat_ws(',', CASE WHEN critical > 0 THEN 'NO_CRITICAL' END, CASE WHEN off > 2 THEN 'OFFSET' END, CASE WHEN arc > 0.05 THEN 'AREA' END, CASE WHEN confidence < 0.82 THEN 'CONFIDENCE' END, CASE WHEN lineages < 2 THEN 'LINEAGES' END) AS failed FROM pt),
gs AS (SELECT *, CASE WHEN failed = '' AND blocking = 0 THEN 'AUTO_APPROVED' ELSE 'REVIEW_REQUIRED' END AS status FROM gt)
"""
_GROW = "minx - 0.004 AS x0, miny - 0.004 AS y0, maxx + 0.004 AS x1, maxy + 0.004 AS y1"
_OV = "greatest(0.0, least({0}.x1, {1}.x1) - greatest({0}.x0, {1}.x0)) * greatest(0.0, least({0}.y1, {1}.y1) - greatest({0}.y0, {1}.y0)) * 12391000000.0"
_NEI = f""",
gf AS (SELECT case_id, k, seq, record_id, {_GROW} FROM r WHERE source_type = 'CADASTRAL'), gn AS (SELECT case_id, k, record_id, {_GROW} FROM r WHERE source_type = 'DRONE_ORI'),
nb AS (SELECT n.record_id AS parcel_id, b.record_id AS feature_id, 'NEIGHBOR_OVERLAP' AS issue, round({_OV.format("n", "b")} - {_OV.format("o", "b")}, 3) AS amount FROM gf o JOIN gn n ON o.k = n.k JOIN gf b ON o.case_id = b.case_id AND o.seq < b.seq
  AND o.x0 - 0.01 <= b.x1 AND b.x0 <= o.x1 + 0.01 AND o.y0 - 0.01 <= b.y1 AND b.y0 <= o.y1 + 0.01),
nbi AS (SELECT parcel_id, feature_id, issue, CASE WHEN amount > 10 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, amount FROM nb WHERE amount > 0.5)
"""
_CHG = f""",
o AS (SELECT *, k::VARCHAR AS site, row_number() OVER (PARTITION BY k ORDER BY coalesce(capture_date, DATE '1970-01-01'), seq) AS ord FROM r),
tp AS ({_TWO.format("site", "o", "a.ord < b.ord")}), tm AS ({views.measured("tp")}),
ev AS (SELECT parcel_id, ida, idb, db - da AS gap_days, coalesce(abs(db - da) > 180, false) AS is_temporal, *
  FROM (SELECT *, CASE WHEN hd < 0.5 AND ad < 0.01 THEN NULL WHEN hd <= 3 AND ad < 0.02 THEN 'BOUNDARY_DRIFT' WHEN iou < 0.90 THEN 'GEOMETRY_CHANGE' WHEN ad > 0.03 THEN 'AREA_CHANGE' ELSE 'GEOMETRY_CHANGE' END AS ct,
    CASE WHEN hd <= 3 AND ad < 0.02 THEN 'LOW' WHEN iou < 0.90 THEN CASE WHEN coalesce(abs(db - da) > 180, false) THEN 'MEDIUM' ELSE 'HIGH' END WHEN ad > 0.03 THEN 'MEDIUM' ELSE 'LOW' END AS sv FROM tm)),
ch AS (SELECT parcel_id, ida AS a_record_id, idb AS b_record_id, gap_days::INT AS gap_days, is_temporal, ct AS change_type, sv AS severity FROM ev WHERE ct IS NOT NULL
  UNION ALL SELECT parcel_id, ida, idb, gap_days::INT, is_temporal, 'LAND_USE_CHANGE', 'HIGH' FROM ev WHERE trim(lower(lua)) <> trim(lower(lub)))
"""
_TLAT = "(111132.92 - 559.82 * cos(2 * radians({0})))"
_TSQM = "{0} * " + _TLAT.format("{1}") + " * 111412.84 * cos(radians({1}))"
_APART = "sqrt(pow(greatest(0.0, bx0 - ax1, ax0 - bx1), 2) + pow(greatest(0.0, by0 - ay1, ay0 - by1), 2))"
_WT = "(CASE {0} WHEN 'CADASTRAL' THEN 0.8 WHEN 'REVENUE_ROR' THEN 0.75 WHEN 'MUNICIPAL_GIS' THEN 0.7 ELSE 0.9 END)"
_TOP = f""",
tq AS (SELECT *, {_SHARED} AS shared, {_TSQM.format(_SHARED, "((ay0 + ay1) / 2)")} AS shared_sqm, {_APART} AS apart, {_TSQM.format(f"{_APART} * least(ax1 - ax0 + ay1 - ay0, bx1 - bx0 + by1 - by0) / 2", "((ay0 + ay1) / 2)")} AS gap_sqm,
  greatest({views._CORNERS}) * {_TLAT.format("(((ay0 + ay1) / 2 + (by0 + by1) / 2) / 2)")} AS off,
  CASE WHEN {_WT.format("ta")} >= {_WT.format("tb")} THEN bx0 >= ax0 AND bx1 <= ax1 AND by0 >= ay0 AND by1 <= ay1 ELSE ax0 >= bx0 AND ax1 <= bx1 AND ay0 >= by0 AND ay1 <= by1 END AS vanishes FROM gc),
tc AS (SELECT parcel_id, ida AS a_record_id, idb AS b_record_id, conflict_type, CASE conflict_type WHEN 'OVERLAP' THEN CASE WHEN shared < 1e-12 OR shared_sqm < 0.1 OR vanishes THEN 'NONE' ELSE 'OVERLAP_SPLIT' END
    WHEN 'GAP' THEN CASE WHEN shared > 1e-14 OR apart <= 0 THEN 'NONE' WHEN gap_sqm > 50 OR apart * {_TLAT.format("((ay0 + ay1) / 2)")} > 20 THEN 'GAP_LARGE' ELSE 'GAP_FILL' END
    ELSE CASE WHEN off < 0.5 THEN 'NONE' WHEN off > 5 THEN 'OFFSET_TOO_LARGE' ELSE 'BOUNDARY_ALIGN' END END AS outcome,
  round(CASE conflict_type WHEN 'OVERLAP' THEN shared_sqm WHEN 'GAP' THEN CASE WHEN shared > 1e-14 THEN 0 ELSE gap_sqm END ELSE off END, 2) AS amount FROM tq WHERE conflict_type <> 'AREA_MISMATCH')
"""
ORACLE = {
    "candidate_pairs": _V + "SELECT case_id, ida AS a_record_id, idb AS b_record_id FROM cand",
    "range_query_metres": _V + """SELECT DISTINCT p.record_id AS probe_id, r.record_id FROM r p JOIN r ON p.case_id = r.case_id AND p.record_id <> r.record_id AND (p.seq + p.k) % 20 = 0
  AND p.minx - 900.0 / 111000.0 <= r.maxx AND r.minx <= p.maxx + 900.0 / 111000.0 AND p.miny - 900.0 / 111000.0 <= r.maxy AND r.miny <= p.maxy + 900.0 / 111000.0""",
    "geom_area_centroid_bbox": _V + f"SELECT record_id, minx, miny, maxx, maxy, round((minx + maxx) / 2, 7) AS lon, round((miny + maxy) / 2, 7) AS lat, round({_AREA}, 4) AS sqm FROM r",
    "geom_pair_measures": _V + f", m AS ({views.measured('cand')}) SELECT ida AS a_record_id, idb AS b_record_id, round(iou, 6) AS iou, round(ad, 6) AS area_diff, round(hd, 4) AS hausdorff_m, round(cd, 4) AS centroid_m FROM m",
    "geom_compare_class": _V + f", m AS ({views.measured('cand')}) SELECT ida AS a_record_id, idb AS b_record_id, {_SEV} AS severity, {_KIND} AS kind FROM m",
    "identifier_scores": _S + "SELECT ida AS a_record_id, idb AS b_record_id, si::DOUBLE AS score FROM sc",
    "temporal_scores": _S + "SELECT ida AS a_record_id, idb AS b_record_id, st::DOUBLE AS score FROM sc",
    "match_scores": _S + "SELECT ida AS a_record_id, idb AS b_record_id, sg AS score_geometry, si::DOUBLE AS score_identifier, round(sa, 4)::DOUBLE AS score_attribute, st::DOUBLE AS score_temporal, 0.5::DOUBLE AS score_provenance, overall, overall < 0.75 AS requires_review FROM mt",
    "confidence_explain": _S + """SELECT ida AS a_record_id, idb AS b_record_id, signal, round(raw * weight, 4)::DOUBLE AS contribution, round((raw - 0.5) * weight, 4)::DOUBLE AS delta FROM (
  SELECT ida, idb, 'geometry' AS signal, sg::DECIMAL(8,4) AS raw, 0.35::DECIMAL(6,4) AS weight FROM mt UNION ALL SELECT ida, idb, 'identifier', si::DECIMAL(8,4), 0.25 FROM mt UNION ALL SELECT ida, idb, 'attribute', sa::DECIMAL(8,4), 0.15 FROM mt
  UNION ALL SELECT ida, idb, 'temporal', st::DECIMAL(8,4), 0.10 FROM mt UNION ALL SELECT ida, idb, 'provenance', 0.5, 0.15 FROM mt)""",
    "confidence_verdict": _S + """, dl AS (SELECT ida, idb, overall, round((sg - 0.5) * 0.35, 4)::DOUBLE AS g, round((si::DOUBLE - 0.5) * 0.25, 4) AS i, round((round(sa, 4)::DOUBLE - 0.5) * 0.15, 4) AS a, round((st::DOUBLE - 0.5) * 0.10, 4) AS t FROM mt),
  dm AS (SELECT *, greatest(g, i, a, t, 0) AS top, least(g, i, a, t, 0) AS low FROM dl)
  SELECT ida AS a_record_id, idb AS b_record_id, overall, CASE WHEN overall >= 0.88 THEN 'HIGH_CONFIDENCE' WHEN overall >= 0.75 THEN 'REVIEW_REQUIRED' ELSE 'LOW_CONFIDENCE' END AS verdict,
    CASE WHEN top > 0.02 THEN CASE top WHEN g THEN 'geometry' WHEN i THEN 'identifier' WHEN a THEN 'attribute' WHEN t THEN 'temporal' END END AS boost,
    CASE WHEN low < -0.02 THEN CASE low WHEN g THEN 'geometry' WHEN i THEN 'identifier' WHEN a THEN 'attribute' WHEN t THEN 'temporal' END END AS drag FROM dm""",
    "entity_components": _M + "SELECT record_id, parcel_id FROM mem",
    "canonical_parcels": _M + f"""SELECT parcel_id, records, independent_lineages, reference_id, confidence, best_a, best_b FROM (
  SELECT parcel_id, count(*) AS records, count(DISTINCT source_type) AS independent_lineages, arg_max(record_id, {_W} * 1000000000 - seq) AS reference_id FROM mem GROUP BY 1) LEFT JOIN {_BEST} USING (parcel_id)""",
    "conflicts_geometry": _M + _CON + "SELECT parcel_id, ida AS a_record_id, idb AS b_record_id, conflict_type, severity, severity = 'LOW' AS auto_resolvable FROM gc",
    "conflicts_attribute": _M + _CON + "SELECT parcel_id, ida AS a_record_id, idb AS b_record_id, conflict_type, severity, auto_resolvable FROM ac",
    "flagship_conflict_summary": _M + _CON + "SELECT conflict_type, severity, count(*) AS conflicts, count(DISTINCT parcel_id) AS parcels FROM con GROUP BY 1, 2",
    "conflict_counts": _M + _CON + "SELECT parcel_id, count(*) AS conflicts, count(*) FILTER (severity = 'CRITICAL') AS critical FROM con GROUP BY 1",
    "proposal_attributes": _M + f"""SELECT parcel_id, field, arg_max(value, {_W} * 1000000000 - seq) AS value, count(DISTINCT value) - 1 AS disagreements FROM (
  SELECT parcel_id, seq, source_type, 'parcel_reference' AS field, parcel_reference AS value FROM mem UNION ALL SELECT parcel_id, seq, source_type, 'land_use', land_use FROM mem
  UNION ALL SELECT parcel_id, seq, source_type, 'ward', ward FROM mem) WHERE value <> '' GROUP BY 1, 2""",
    "proposal_consensus": _M + _CENTRE + "SELECT parcel_id, round(lon, 9) AS lon, round(lat, 9) AS lat, reference_id, round(d, 3) AS shift_m, round(fraction, 4) AS fraction, round(d * fraction, 3) AS moved_m FROM np",
    "proposal_gates": _M + _PROP + "SELECT parcel_id, critical, lineages, failed, blocking, status FROM gs",
    "review_queue_topk": _M + _PROP + """SELECT parcel_id, (floor((1 - confidence) * 50) + unresolved * 15 + points + 30 * grave + 10 * rest + CASE WHEN off > 5 THEN 30 WHEN off > 2 THEN 15 ELSE 0 END)::BIGINT AS priority
  FROM gs WHERE status = 'REVIEW_REQUIRED' ORDER BY priority DESC, parcel_id LIMIT 100""",
    "ripple_neighbor_overlap": _V + _NEI + "SELECT * FROM nbi",
    "ripple_issues": _M + _CENTRE + _RIP + "SELECT parcel_id, feature_id, issue, severity, amount FROM rip",
    "ripple_summary": _M + _CENTRE + _RIP + _NEI + "SELECT issue, count(*) AS issues, count(*) FILTER (severity IN ('CRITICAL', 'HIGH')) AS blocking FROM (SELECT issue, severity FROM rip UNION ALL SELECT issue, severity FROM nbi) GROUP BY 1",
    "topology_overlap_split": _M + _CON + _TOP + "SELECT * FROM tc WHERE conflict_type = 'OVERLAP'",
    "topology_corrections": _M + _CON + _TOP + "SELECT * FROM tc",
    "change_events": _V + _CHG + "SELECT * FROM ch",
    "change_summary": _V + _CHG + "SELECT change_type, severity, count(*) AS events, count(*) FILTER (is_temporal) AS temporal FROM ch GROUP BY 1, 2",
    "temporal_span": _V + "SELECT k::VARCHAR AS parcel_id, min(capture_date)::VARCHAR AS earliest, max(capture_date)::VARCHAR AS latest, count(capture_date) AS dated, (max(capture_date) - min(capture_date))::INT AS span_days FROM r GROUP BY k",
    "ml_features": _S + f"""SELECT ida AS a_record_id, idb AS b_record_id, round(greatest(0, least(1, iou)), 5) AS iou, round(greatest(0, least(1, hd / 500)), 6) AS hausdorff_norm, round(greatest(0, least(1, ad)), 5) AS area_ratio_diff,
  round(greatest(0, least(1, cd / 500)), 6) AS centroid_dist_norm, si::DOUBLE AS identifier_score, round(greatest(0, least(1, coalesce(abs(da - db), 0) / 3650)), 6)::DOUBLE AS temporal_gap_norm, 0.5::DOUBLE AS owner_similarity, coalesce(wa = wb, false)::INT::DOUBLE AS ward_match, 0.0::DOUBLE AS independent_lineages,
  round(abs(({_W.replace("source_type", "[''CADASTRAL'', ''REVENUE_ROR'', ''MUNICIPAL_GIS'', ''DRONE_ORI''][seqa % 4 + 1]".replace("''", "'"))})::DOUBLE - ({_W.replace("source_type", "['CADASTRAL', 'REVENUE_ROR', 'MUNICIPAL_GIS', 'DRONE_ORI'][seqb % 4 + 1]")})::DOUBLE), 6) AS source_quality_diff,
  coalesce(trim(lower(lua)) = trim(lower(lub)), false)::INT::DOUBLE AS land_use_match FROM mt""",
}
