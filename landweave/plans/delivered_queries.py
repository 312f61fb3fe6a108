"""The reconciliation of the delivered tables themselves: from source_record, its offices' times and the provenance graph to parcels, conflicts and proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landweave.functions.columns import few
from landweave.operators import ingest, lineage, pipeline, reconcile, ripple, timestamps, topology
from landweave.session import Stage
from landweave.sources import sinks
from landweave.tables import table


def _once(spark: SparkSession, folder: str, key: str, make) -> DataFrame:  # noqa: ANN001
    return Stage(spark).once(key, f"{folder}/source_record.parquet", make)


def _ingested(spark: SparkSession, folder: str) -> DataFrame:
    def make() -> DataFrame:
        # A small file is one task otherwise, and what follows works on each row.
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
        r = table(spark, folder, "source_record").drop("ingest_timestamp", "quality_level").withColumnRenamed("source_dataset_id", "dataset_id").repartition(parts, "ingest_seq")
        dated = timestamps.with_office(r.select("ingest_seq", "dataset_id", F.col("capture_timestamp").alias("value")), "dataset_id", table(spark, folder, "dataset_profile"), table(spark, folder, "survey_office"))
        # Read twice, for the mixtures and for the days, so written.
        parsed = Stage(spark).write(timestamps.readings(dated, "value"))
        days = timestamps.resolve(parsed, timestamps.mixtures(parsed)).select("ingest_seq", F.to_date(F.timestamp_micros("instant_us")).alias("captured"))
        # Years before 1800 and times to come are no times of capture.
        days = days.withColumn("captured", F.when(F.year("captured").between(1800, F.year(F.current_date())), F.col("captured")))
        # What was read from them is kept, the texts are in the source.
        return pipeline.ingested(r.drop("capture_timestamp"), beside=days, hashed=False).drop("attributes", "content_hash")

    return _once(spark, folder, "ingested", make)


def _reconciled(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """records, pairs, origins and groups as ``pipeline.matched`` gives them, and members."""
    kept: dict[str, DataFrame] = {}
    replaced = _once(spark, folder, "replaced", lambda: pipeline.replaced(_ingested(spark, folder)))
    out = {"records": pipeline.accepted(_ingested(spark, folder), replaced)}

    def all_three() -> dict[str, DataFrame]:
        if not kept:
            kept["pairs"], kept["members"], kept["origins"] = pipeline.matched(out["records"], table(spark, folder, "provenance_graph"))
        return kept

    # Of the members, which are read off the deliveries, only the parcels of paired records are kept.
    out |= {to: _once(spark, folder, f"delivered {n}", lambda n=n: all_three()[n]) for to, n in (("pairs", "pairs"), ("groups", "members"), ("origins", "origins"))}
    return out | {"members": pipeline.members(out["records"], out["groups"]), "lone": pipeline.lone(out["records"], out["groups"])}


def _several(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """``_reconciled`` with the records of the parcels that have several."""
    out = _reconciled(spark, folder)
    return out | {"several": _once(spark, folder, "delivered several", lambda: pipeline.several(out["records"], out["groups"]))}


def _measured(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """``_several`` with the measures of each parcel's pairs of outlines."""
    out = _several(spark, folder)
    return out | {"measured": _once(spark, folder, "delivered measured", lambda: reconcile.measured_pairs(out["several"]).drop("a_geometry", "b_geometry"))}


def _compared(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """``_measured`` with what is told of the lineages of parcels with several records; a single record has no verdict that counts."""
    out = _measured(spark, folder)
    nodes = out["several"].select(F.col("parcel_id").alias("group_id"), "record_id", F.col("provenance_node_id").alias("node_id"))
    return out | {"told": _once(spark, folder, "delivered told", lambda: lineage.independence(nodes, out["origins"]))}


def _found(r: dict[str, DataFrame]) -> DataFrame:
    return pipeline.conflicts(r["several"], r["measured"], r["told"])


def delivered_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Why deliveries were not taken, by source type."""
    return _ingested(spark, folder).where("reject IS NOT NULL").groupBy("source_type", F.col("reject").alias("reason")).agg(F.count("*").alias("deliveries"))


def schema_normalize(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical attributes of every delivery, how each property was mapped, and the stated area in square metres."""
    r = _ingested(spark, folder)
    text = lambda c: F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))
    return r.select("ingest_seq", text("canonical").alias("canonical"), text("methods").alias("methods"), F.round("area_sqm", 4).alias("area_sqm"))


def delivered_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Matched pairs with all five scores."""
    p = _reconciled(spark, folder)["pairs"]
    return p.select("a_record_id", "b_record_id", *[f"score_{n}" for n in ("geometry", "identifier", "attribute", "temporal", "provenance")], "owner_similarity", "lineages", "overall", "requires_review")


def delivered_parcels(spark: SparkSession, folder: str) -> DataFrame:
    """Records of each resolved parcel."""
    return _reconciled(spark, folder)["members"].select("parcel_id", "record_id", "source_type")


def delivered_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """All conflicts of the delivered records."""
    return _found(_compared(spark, folder))


def delivered_conflict_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Conflicts by type and severity over all parcels resolved from the deliveries."""
    return _found(_compared(spark, folder)).groupBy("conflict_type", "severity").agg(F.count("*").alias("conflicts"), F.count_distinct("parcel_id").alias("parcels"))


def _proposed(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """``_compared`` with the proposals of the parcels with several records."""
    r = _compared(spark, folder)
    return r | {"proposed": _once(spark, folder, "delivered proposals", lambda: pipeline.proposals(r["several"], r["pairs"], r["measured"], r["told"], _found(r)))}


def _all_proposed(r: dict[str, DataFrame]) -> DataFrame:
    return r["proposed"].unionByName(pipeline.lone_proposals(r["lone"]))


def delivered_proposals(spark: SparkSession, folder: str) -> DataFrame:
    """One proposal a parcel with its moved outline, gates and status."""
    return _all_proposed(_proposed(spark, folder)).withColumn("failed", F.array_join("failed", ","))


def delivered_attributes(spark: SparkSession, folder: str) -> DataFrame:
    """Proposed value of every canonical field of each parcel."""
    return pipeline.attribute_consensus(_reconciled(spark, folder)["members"])


def delivered_geometries(spark: SparkSession, folder: str) -> DataFrame:
    """The outlines behind each proposal with their weights."""
    r = _several(spark, folder)
    return pipeline.source_geometries(r["several"], reconcile.centroid_consensus(r["several"])).unionByName(pipeline.source_geometries(r["lone"]))


def _lines(spark: SparkSession, folder: str, r: dict[str, DataFrame]) -> DataFrame:
    """Issues of proposed outlines with the observed lines of their case, taken as boundaries."""
    lines = table(spark, folder, "gt_observation").select(F.col("ingest_seq").alias("key"), "case_id", F.col("geometry_geojson").alias("line"))
    m = r["several"].groupBy("parcel_id").agg(F.first("case_id").alias("case_id"))
    areas = r["proposed"].join(m, "parcel_id").select(F.col("parcel_id").alias("area_key"), "case_id", F.col("proposed_geometry").alias("area"))
    areas = areas.unionByName(r["lone"].select(F.col("parcel_id").alias("area_key"), "case_id", F.col("geometry").alias("area")))
    met = topology.lines_on_areas(lines, areas, apart=False).withColumn("feature_id", F.col("key").cast("string"))
    return ripple.found(met, "area_key", "feature_id", ripple.boundary(F.round("inside_m", 3)))


def delivered_review_queue(spark: SparkSession, folder: str) -> DataFrame:
    """The hundred most urgent proposals, ripple issues with observed lines counted."""
    r = _proposed(spark, folder)
    p = ripple.override(_all_proposed(r), _lines(spark, folder, r))
    return pipeline.queue(p.drop("blocking", "gravest")).orderBy(F.desc("priority"), "parcel_id").limit(100)


def delivered_topology(spark: SparkSession, folder: str) -> DataFrame:
    """Corrections of conflicting pairs of outlines, by kind of conflict."""
    r = _measured(spark, folder)
    c = reconcile.geometry_conflicts(r["measured"]).where("conflict_type IN ('OVERLAP', 'GAP', 'BOUNDARY_OFFSET')")
    return topology.corrections(c, r["several"]).select("parcel_id", "a_record_id", "b_record_id", "conflict_type", "outcome", F.round("amount", 2).alias("amount"), "a_after", "b_after")


def delivered_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Changes between the records of a parcel in order of their times."""
    return reconcile.change_events(_reconciled(spark, folder)["members"])


def _hashed(spark: SparkSession, folder: str, records: DataFrame) -> DataFrame:
    """Records with the hash of their delivery's content, worked out for these only."""
    raw = table(spark, folder, "source_record").select(F.col("ingest_seq").alias("seq"), F.col("geometry").alias("_raw"), "attributes", "source_crs")
    raw = raw.join(few(records.select("seq")), "seq", "left_semi")
    return records.join(raw.select("seq", ingest.hashed_col(F.col("_raw"), F.col("attributes"), F.col("source_crs")).alias("content_hash")), "seq")


def delivered_packages(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence packages of the parcels with several records, all eight members and the manifest."""
    r = _proposed(spark, folder)
    several = r["proposed"].withColumn("failed", F.array_join("failed", "; "))
    text = lambda *cols: F.to_json(F.struct(*cols))
    lines = lambda c: F.array_join(F.array_sort(F.collect_list(c)), ",")
    # One parcel's records and conflicts, as few as the sources that describe it.
    m = _hashed(spark, folder, r["several"]).groupBy("parcel_id").agg(
        lines(text("record_id", "source_type", "dataset_id", "content_hash", "canonical")).alias("sources"),
        lines(F.to_json(F.struct(F.lit("Feature").alias("type"), F.try_parse_json("geometry").alias("geometry"), F.struct("record_id", "source_type").alias("properties")))).alias("features"),
    )
    c = _found(r).groupBy("parcel_id").agg(lines(text("conflict_type", "severity", "a_record_id", "b_record_id", "measure")).alias("conflicts_text"))
    p = several.join(m, "parcel_id").join(c, "parcel_id", "left")
    collection = lambda x: F.concat(F.lit('{"type":"FeatureCollection","features":['), x, F.lit("]}"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.try_parse_json("proposed_geometry").alias("geometry"), F.struct("parcel_id", "status").alias("properties")))
    members = F.create_map(
        F.lit("source_manifest.json"), F.concat(F.lit('{"sources":['), F.col("sources"), F.lit("]}")), F.lit("normalized_features.geojson"), collection(F.col("features")), F.lit("proposal.geojson"), collection(F.concat_ws(",", feature, "features")),
        F.lit("conflicts.json"), F.concat(F.lit('{"conflicts":['), F.coalesce("conflicts_text", F.lit("")), F.lit("]}")), F.lit("confidence.json"), text("confidence", "lineages", "records", "max_offset_m", "moved_m"),
        F.lit("validation.json"), text("critical", "unresolved", "failed"), F.lit("decision.json"), text("status"),
    )
    return sinks.packages(p.select("parcel_id", members.alias("members"))).drop("content")


QUERIES = {f.__name__: f for f in (
    delivered_rejects, schema_normalize, delivered_matches, delivered_parcels, delivered_conflicts, delivered_conflict_summary, delivered_proposals, delivered_attributes, delivered_geometries, delivered_review_queue,
    delivered_topology, delivered_changes, delivered_packages,
)}
ORACLE: dict[str, str] = {}
