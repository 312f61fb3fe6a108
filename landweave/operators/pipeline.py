"""From delivered rows to reconciled parcels: ingest, matching, conflicts, proposals and review over real outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landweave import config
from landweave.config import DEFAULT, Config
from landweave.functions.columns import few, step
from landweave.operators import components, ingest, lineage, matching, reconcile
from landweave.session import Stage

#: Fields of the canonical attributes that later steps read.
FIELDS = ("parcel_reference", "ulpin", "survey_number", "owner_reference", "land_use", "ward")


def ingested(rows: DataFrame, cfg: Config = DEFAULT, reproject: bool = False, beside: DataFrame | None = None, hashed: bool = True) -> DataFrame:
    """Delivered rows with checks, canonical attributes and ``reject`` (null for those taken).

    ``rows`` has ingest_seq (unique), record_id, source_type, dataset_id, case_id, geometry,
    source_crs, attributes and provenance_node_id; other columns, as captured (a date or null), pass through. ``beside`` has more of them, by ingest_seq. Rejected rows keep their
    reason and nothing else is derived from them. An empty table gives no rows. Without ``hashed`` the hash of a row's content is null.
    """
    c = F.col
    names = [f.split()[0] for f in ingest.CHECKED.split(", ")]
    # Attributes are read several times, so they come before the checks: rows behind a generator are not pruned, and each reading would check all outlines again.
    if beside is not None:
        rows = rows.join(beside, "ingest_seq", "left")  # before Python's batches, after which the layout by ingest_seq isn't known
    r = ingest.canonical(rows, "ingest_seq", "attributes", cfg.fuzzy_field_at)
    r = r.withColumnRenamed("geometry", "_raw").select("*", F.inline(F.array(ingest.checked(c("_raw"), c("attributes"), c("source_crs"), reproject, hashed)))).drop("_raw")
    assert set(names) <= set(r.columns)
    r = r.withColumn("reject", ingest.reject_reason())
    return r.select("*", *[F.element_at("canonical", f).alias(f) for f in FIELDS])


def _taken(rows: DataFrame) -> DataFrame:
    return rows.where("reject IS NULL AND record_id IS NOT NULL AND record_id <> ''")


def replaced(rows: DataFrame) -> DataFrame:
    """(record_id, ingest_seq) of deliveries that were taken and of which a later one was too; few, and written."""
    r = _taken(rows)
    last = r.groupBy("record_id").agg(F.max("ingest_seq").alias("_last"), F.count("*").alias("_n")).where("_n > 1")
    return Stage(rows.sparkSession).write(r.select("record_id", "ingest_seq").join(last, "record_id").where("ingest_seq < _last").select("record_id", "ingest_seq"))


def accepted(rows: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """The latest delivery of each record that was taken, as records for matching; ``seq`` is its number.

    ``earlier`` is the result of ``replaced``; these being few, the rows needn't be laid out by record.
    """
    r = _taken(rows)
    keep = [
        "case_id", "dataset_id", "source_type", "geometry", *matching.BOUNDS, "centroid_lon", "centroid_lat", "deg2", *FIELDS, "area_sqm", F.col("captured").alias("capture_date"), "provenance_node_id", *(["content_hash"] if "content_hash" in rows.columns else []), "canonical",
    ]
    earlier = replaced(rows) if earlier is None else earlier
    return r.join(few(earlier), ["record_id", "ingest_seq"], "left_anti").select("record_id", F.col("ingest_seq").alias("seq"), *keep)


def matched(records: DataFrame, nodes: DataFrame, cfg: Config = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, groups, origins): matched pairs of the source types that make parcels, (record_id, parcel_id) of their records, and the result of ``lineage.origin_pairs``."""
    stage = Stage(records.sparkSession)
    r = records.where(F.col("source_type").isin(*config.PARCEL_TYPES))
    origins = stage.write(lineage.origin_pairs(nodes))
    slim = r.select("case_id", "record_id", "seq", "dataset_id", "source_type", "geometry", *matching.BOUNDS, "deg2", *FIELDS, "capture_date", "provenance_node_id")
    pairs = stage.write(matching.scored(slim, cfg, origins, matches_only=True).drop("a_geometry", "b_geometry"))
    ends = pairs.select(F.col("a_record_id").alias("u"), F.col("b_record_id").alias("v"))
    groups = components.components(ends.select(F.explode(F.array("u", "v")).alias("node")), ends)
    return pairs, stage.write(groups.select(F.col("node").alias("record_id"), F.col("label").alias("parcel_id"))), origins


def several(records: DataFrame, groups: DataFrame) -> DataFrame:
    """Records with ``parcel_id`` of the parcels that have several, by the groups of ``matched``."""
    return records.join(few(groups), "record_id")


def lone(records: DataFrame, groups: DataFrame) -> DataFrame:
    """Records that are a parcel of their own, most of them; nothing that compares a parcel's records has to look at these."""
    r = records.where(F.col("source_type").isin(*config.PARCEL_TYPES))
    return r.join(few(groups.select("record_id")), "record_id", "left_anti").withColumn("parcel_id", F.col("record_id"))


def members(records: DataFrame, groups: DataFrame) -> DataFrame:
    """All records of the source types that make parcels with ``parcel_id``: ``several`` and ``lone`` in one."""
    r = records.where(F.col("source_type").isin(*config.PARCEL_TYPES))
    return r.join(few(groups), "record_id", "left").withColumn("parcel_id", F.coalesce("parcel_id", "record_id"))


def conflicts(members: DataFrame, measured: DataFrame, told: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Geometry, attribute and provenance conflicts of all parcels, in this order."""
    return reconcile.geometry_conflicts(measured, cfg).unionByName(reconcile.attribute_conflicts(members, cfg)).unionByName(reconcile.provenance_conflicts(told))


def evidence(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(parcel_id, confidence) of the best pair of each parcel."""
    p = pairs.join(members.select(F.col("record_id").alias("a_record_id"), "parcel_id"), "a_record_id")
    return p.groupBy("parcel_id").agg(F.max("overall").alias("confidence"))


def proposals(members: DataFrame, pairs: DataFrame, measured: DataFrame, told: DataFrame, found: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One proposal a parcel: reference record, its outline moved towards the consensus, evidence, failed gates and status.

    Lineages are those of the provenance where two records name a node, else the distinct source types.
    """
    con = found.groupBy("parcel_id").agg(
        F.count("*").alias("conflicts"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.count_if(~F.col("auto_resolvable")).alias("unresolved"),
        F.sum(F.when(~F.col("auto_resolvable"), reconcile.severity_points(F.col("severity"))).otherwise(0)).alias("points"),
    )
    far = measured.groupBy("parcel_id").agg(F.max("hausdorff_m").alias("max_offset_m"))
    named = members.groupBy("parcel_id").agg(F.count("*").alias("records"), F.count_distinct("source_type").alias("types"), F.count("provenance_node_id").alias("nodes"))
    centre = reconcile.centroid_consensus(members, cfg)
    outline = members.select(F.col("record_id").alias("reference_id"), "geometry", F.col("source_type").alias("reference_source"))
    p = named.join(centre, "parcel_id").join(outline, "reference_id").join(evidence(pairs, members), "parcel_id", "left")
    p = p.join(con, "parcel_id", "left").join(far, "parcel_id", "left").join(told.select(F.col("group_id").alias("parcel_id"), F.col("lineages").alias("_l")), "parcel_id", "left")
    p = p.withColumn("lineages", F.when(F.col("nodes") >= 2, F.coalesce("_l", F.lit(0))).otherwise(F.col("types"))).drop("_l")
    p = reconcile.gates(p.na.fill(0, ["conflicts", "critical", "unresolved", "points"]).na.fill(0.0, ["confidence", "max_offset_m", "area_change"]), cfg)
    p = p.withColumn("proposed_geometry", reconcile.moved(F.col("geometry"), F.col("dlon"), F.col("dlat")))
    return p.select(
        "parcel_id", "records", "reference_id", "reference_source", "proposed_geometry", F.round("shift_m", 3).alias("shift_m"), F.round("moved_m", 3).alias("moved_m"), F.round("max_offset_m", 2).alias("max_offset_m"),
        *_JUDGED,
    )


_JUDGED = ("area_change", "confidence", "lineages", "conflicts", "critical", "unresolved", "points", "failed", "status")


def lone_proposals(members: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """``proposals`` of parcels with a single record, row by row: its outline as it is, no evidence and no conflicts."""
    none, zero = F.lit(0).cast("long"), F.lit(0.0)
    p = members.select(
        "parcel_id", F.lit(1).cast("long").alias("records"), F.col("record_id").alias("reference_id"), F.col("source_type").alias("reference_source"), F.col("geometry").alias("proposed_geometry"),
        *[zero.alias(n) for n in ("shift_m", "moved_m", "max_offset_m", "area_change", "confidence")], F.lit(1).cast("long").alias("lineages"), *[none.alias(n) for n in ("conflicts", "critical", "unresolved", "points")],
    )
    return reconcile.gates(p, cfg)


def source_geometries(members: DataFrame, proposed: DataFrame | None = None) -> DataFrame:
    """Each parcel's outlines beside the proposed one: record, source, weight, whether it is the reference; without ``proposed``, of parcels with a single record."""
    m = members.withColumn("reference_id", F.col("record_id")) if proposed is None else members.join(proposed.select("parcel_id", "reference_id"), "parcel_id")
    m = m.withColumn("weight", matching.source_weight(F.col("source_type"))).withColumn("is_reference", F.col("record_id") == F.col("reference_id"))
    return m.select("parcel_id", "record_id", "source_type", "geometry", "weight", "is_reference")


def attribute_consensus(members: DataFrame) -> DataFrame:
    """(parcel_id, field, value, disagreements) over all canonical fields, the value of the heaviest source, the first of equals."""
    each = members.select("parcel_id", "seq", matching.source_weight(F.col("source_type")).alias("w"), F.explode("canonical").alias("field", "value"))
    each = each.where(F.col("value").isNotNull() & (F.trim("value") != ""))
    return each.groupBy("parcel_id", "field").agg(F.max_by("value", F.struct("w", -F.col("seq"))).alias("value"), (F.count_distinct("value") - 1).alias("disagreements"))


def queue(proposed: DataFrame, ripple_counts: DataFrame | None = None) -> DataFrame:
    """(parcel_id, priority, status) of the proposals that need review, without order."""
    p = proposed if ripple_counts is None else proposed.join(ripple_counts, "parcel_id", "left")
    for n in ("critical_ripple", "other_ripple"):
        p = p.withColumn(n, F.coalesce(F.col(n), F.lit(0)) if n in p.columns else F.lit(0))
    pr: Column = reconcile.priority(*[F.col(n) for n in ("confidence", "unresolved", "points", "critical_ripple", "other_ripple", "max_offset_m")])
    return step(p.where("status = 'REVIEW_REQUIRED'"), priority=pr).select("parcel_id", "priority", "status")


def decided(queued: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queue, audit) after decisions (parcel_id, decision, decided_by, decided_at).

    Only APPROVED and REJECTED end a review; SURVEY puts it back to PENDING; others are refused and
    change nothing. The latest decision of a parcel counts, the greatest of those of one moment. The
    audit has every decision with the hash of its content, refused ones too.
    """
    content = F.to_json(F.struct("decided_by", "decision", "parcel_id"), {"ignoreNullFields": "false"})
    known = F.col("decision").isin("APPROVED", "REJECTED", "SURVEY")
    audit = decisions.select("parcel_id", "decision", "decided_by", "decided_at", F.coalesce(~known, F.lit(True)).alias("refused"), F.sha2(content, 256).alias("event_hash"))
    last = decisions.where(known).groupBy("parcel_id").agg(F.max_by("decision", F.struct("decided_at", "decision")).alias("decision"))
    q = queued.join(last, "parcel_id", "left")
    state = F.when(F.col("decision") == "SURVEY", "PENDING").otherwise(F.coalesce("decision", "status"))
    return q.select("parcel_id", "priority", state.alias("status")), audit
