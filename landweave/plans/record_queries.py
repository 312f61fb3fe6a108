"""Queries of ingest checks, quality, lineage, names, numbers, evidence and sequences over the delivered tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from landweave import config
from landweave.functions import planar, text
from landweave.operators import adapters, evidence, ingest, lineage, matching, ml, quality, reconcile, schema_drift, sequences, topology
from landweave.plans import views
from landweave.session import Stage
from landweave.sources import sinks
from landweave.tables import table

_CHECKED = tuple("_geometry" if n == "geometry" else n for n in (f.split()[0] for f in ingest.CHECKED.split(", ")))
#: Seed of the key that signs test envelopes; a deployment brings its own.
TEST_SEED = bytes(range(32))


def ingest_crs_gates(spark: SparkSession, folder: str) -> DataFrame:
    g = table(spark, folder, "gnss_observation")
    lon, lat = F.col("lon"), F.col("lat")
    gate = ingest.crs_gate(lon, lat, lon, lat)
    reject = ingest.range_reject(F.greatest(F.abs(lon), F.abs(lat)), F.abs(lat))
    return g.where("lon IS NOT NULL AND lat IS NOT NULL AND NOT isnan(lon) AND NOT isnan(lat)").select("ingest_seq", gate.alias("gate"), F.coalesce(reject, F.lit("")).alias("reject"))


def ingest_record_ids(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "ingested_record")
    n = F.row_number().over(Window.partitionBy("dataset_id").orderBy("ingest_seq")) - 1
    v = F.try_parse_json("attributes_raw")
    get = {k: F.try_variant_get(v, f"$.{k}", "string") for k in ("id", "record_id", "parcel_id", "property_id", "khasra_no")}
    return r.select("ingest_seq", ingest.record_id(get, F.col("dataset_id"), n).alias("derived_id"))


def ingest_capture_ts(spark: SparkSession, folder: str) -> DataFrame:
    m = F.col("attributes_canonical")
    return table(spark, folder, "ingested_record").select("ingest_seq", F.coalesce(*[F.nullif(F.element_at(m, k), F.lit("")) for k in ("capture_date", "survey_date", "date")]).alias("captured"))


def schema_alias_map(spark: SparkSession, folder: str) -> DataFrame:
    f = schema_drift.fields(table(spark, folder, "ingested_record"), "attributes_raw", "dataset_id")
    return f.groupBy("field").agg(F.count("*").alias("values"), F.count_distinct("dataset_id").alias("datasets")).withColumn("canonical", F.coalesce(ingest.canonical_field(F.col("field")), F.lit("")))


def schema_fuzzy_map(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.fuzzy_fields(schema_drift.fields(table(spark, folder, "ingested_record"), "attributes_raw"), "field")


def schema_area_units(spark: SparkSession, folder: str) -> DataFrame:
    v = F.try_parse_json("attributes")
    r = table(spark, folder, "source_record").select("ingest_seq", F.try_variant_get(v, "$.Area", "string").alias("a"), F.try_variant_get(v, "$.Unit", "string").alias("u"))
    return r.where("a IS NOT NULL").select("ingest_seq", F.round(ingest.area_sqm(F.col("a"), F.col("u")), 3).alias("sqm"))


def _checked(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries with what ``ingest.checked`` says; written once for a folder."""
    def make() -> DataFrame:
        r = table(spark, folder, "source_record")
        return r.select("*", F.inline(F.array(ingest.checked(F.col("geometry"), F.col("attributes"), F.col("source_crs")))).alias(*_CHECKED)).drop("geometry").withColumnRenamed("_geometry", "geometry")

    return Stage(spark).once("checked", f"{folder}/source_record.parquet", make)


def geometry_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Outcome of each delivered geometry: OK, REPAIRED, EMPTY, or why it can't be used."""
    return _checked(spark, folder).select("ingest_seq", "outcome", F.coalesce(ingest.reject_reason(), F.lit("")).alias("reject"))


def quality_profile(spark: SparkSession, folder: str) -> DataFrame:
    return quality.profile(_checked(spark, folder), "source_dataset_id", "record_id", "outcome", "capture_timestamp")


def quality_report(spark: SparkSession, folder: str) -> DataFrame:
    """Datasets, records and readable share by level."""
    p = quality_profile(spark, folder)
    return p.groupBy("level").agg(F.count("*").alias("datasets"), F.sum("total").alias("records"), F.round(100 * F.sum("valid_geometry") / F.sum("total"), 4).alias("valid_pct"))


def quality_area_outliers(spark: SparkSession, folder: str) -> DataFrame:
    return quality.outliers(table(spark, folder, "canonical_parcel"), "village_code", "area_sqm")


def quality_field_completeness(spark: SparkSession, folder: str) -> DataFrame:
    f = schema_drift.fields(table(spark, folder, "ingested_record"), "attributes_raw", "dataset_id")
    gone = (F.col("kind") == "null") | ((F.col("kind") == "string") & (F.try_variant_get("value", "$", "string") == ""))
    return f.groupBy("dataset_id", "field").agg(F.count("*").alias("rows"), F.count_if(gone).alias("missing"))


def dataset_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "source_record").groupBy("case_id", "source_type").agg(F.count("*").alias("records"), F.count_distinct("source_dataset_id").alias("datasets"))


def parcel_source_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Records of one case and of the source types that are matched into parcels; the filter reaches the scan."""
    s = table(spark, folder, "source_record").where((F.col("case_id") == "ward17_core") & F.col("source_type").isin(*config.PARCEL_TYPES))
    return s.select("ingest_seq", "record_id", "source_type")


def parcel_members(spark: SparkSession, folder: str) -> DataFrame:
    """Delivered records of each parcel by the ids it names."""
    c = table(spark, folder, "canonical_parcel").select("canonical_id", F.explode("source_record_ids").alias("record_id"))
    return c.join(table(spark, folder, "source_record").select("record_id", "source_type"), "record_id").groupBy("canonical_id").agg(
        F.count("*").alias("deliveries"), F.count_distinct("record_id").alias("records"), F.count_distinct("source_type").alias("source_types")
    )


def lineage_edges(spark: SparkSession, folder: str) -> DataFrame:
    return lineage.edges(table(spark, folder, "provenance_graph"))


def lineage_origins(spark: SparkSession, folder: str) -> DataFrame:
    return lineage.origins(table(spark, folder, "provenance_graph"))


def _lineage(spark: SparkSession, folder: str) -> DataFrame:
    return Stage(spark).once("origins", f"{folder}/provenance_graph.parquet", lambda: lineage.origin_pairs(table(spark, folder, "provenance_graph")))


def lineage_independence(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict for each parcel from the lineage of the records it names."""
    c = table(spark, folder, "canonical_parcel").select(F.col("canonical_id").alias("group_id"), F.explode("source_record_ids").alias("record_id"))
    s = table(spark, folder, "source_record").select("record_id", F.col("provenance_node_id").alias("node_id")).distinct()
    return lineage.independence(c.join(s, "record_id"), _lineage(spark, folder))


def conflicts_provenance(spark: SparkSession, folder: str) -> DataFrame:
    """A conflict for each parcel whose records' lineage is unknown or shared."""
    return reconcile.provenance_conflicts(lineage_independence(spark, folder)).select("parcel_id", "conflict_type", "severity", "auto_resolvable")


def lineage_hash_check(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes against the hash of their first row: a node with another row is CHANGED."""
    h = F.sha2(F.concat_ws("|", "node_id", F.coalesce("node_type", F.lit("")), F.array_join(F.coalesce("parent_ids", F.array().cast("array<string>")), ",", "")), 256)
    n = table(spark, folder, "provenance_graph").withColumn("content_hash", h)
    return lineage.verify(n, n.groupBy("node_id").agg(F.min("content_hash").alias("content_hash")))


def gnss_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    g = table(spark, folder, "gnss_observation").withColumn("m", ingest.gnss_method(F.col("method")))
    est = ingest.gnss_accuracy(F.col("m"), F.col("pdop"), F.col("baseline_length_km"))
    return g.select("ingest_seq", F.col("m").alias("method"), F.round(est, 5).alias("accuracy_m"), ingest.gnss_weight(F.col("m"), est).alias("weight"))


def gnss_quality(spark: SparkSession, folder: str) -> DataFrame:
    return gnss_accuracy(spark, folder).groupBy("method").agg(F.count("*").alias("marks"), F.round(F.avg("weight"), 6).alias("mean_weight"))


def gt_category(spark: SparkSession, folder: str) -> DataFrame:
    g = table(spark, folder, "gt_observation")
    return g.groupBy(ingest.gt_category(F.col("category")).alias("category")).agg(F.count("*").alias("observations"))


def elevation_height(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part").select("p_partkey", (F.lit(500.0) + F.col("p_size") / 2).alias("dsm"), (F.lit(500.0) + F.col("p_partkey") % 7).alias("dtm"))
    h = ingest.building_height(F.col("dsm"), F.col("dtm"))
    return p.select("p_partkey", h.alias("height_m"), (h > 1.5).alias("has_structure"), ingest.height_use(h).alias("likely_use"))


def imagery_type(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "part").select("p_partkey", F.element_at(F.array(*[F.lit(x) for x in ("Drone Co", "satellite one", "Aerial Ltd", "other")]), (F.col("p_partkey") % 4).cast("int") + 1).alias("provider"),
                                            (F.col("p_size") * 20).cast("double").alias("height"), F.col("p_size").cast("double").alias("gsd"))
    return s.groupBy(ingest.imagery_type(F.col("provider"), F.when(F.col("provider") == "other", F.col("height")), F.col("gsd")).alias("imagery")).agg(F.count("*").alias("images"))


def ulpin_validate(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "canonical_parcel").groupBy(text.ulpin_status(F.col("ulpin")).alias("status")).agg(F.count("*").alias("parcels"))


def ulpin_extract(spark: SparkSession, folder: str) -> DataFrame:
    """First valid national number among the attributes of a delivery, over the twelve names it goes by."""
    s = table(spark, folder, "source_record").select("ingest_seq", F.from_json("attributes", "map<string,string>").alias("m"))
    tries = [F.element_at("m", k) for k in config.ULPIN_KEYS]
    return s.select("ingest_seq", F.coalesce(*[F.when(text.ulpin_status(t) == "VALID", text.ulpin_normal(t)) for t in tries]).alias("found"))


def ulpin_demo_id(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "canonical_parcel").where("centroid_lon IS NOT NULL AND centroid_lat IS NOT NULL")
    return c.select("canonical_id", text.demo_identifier(F.col("centroid_lon"), F.col("centroid_lat")).alias("demo_id"))


def ulpin_link(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.ulpin_groups(table(spark, folder, "canonical_parcel"), "ulpin")


def name_normalize(spark: SparkSession, folder: str) -> DataFrame:
    """Normal form of every row's first name, null where there is none."""
    return table(spark, folder, "name_match_result").select("pair_id", text.normal_name_col(F.col("name_a")).alias("normal"))


def name_compare(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "name_match_result")
    return n.select("pair_id", F.inline(F.array(text.compare_names_col(F.col("name_a"), F.col("name_b")))))


def owner_similarity(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "name_match_result")
    return n.select("pair_id", F.round(text.token_set_ratio_col(F.col("name_a"), F.col("name_b")), 4).alias("ratio"))


def geom_general_iou(spark: SparkSession, folder: str) -> DataFrame:
    """Measures of the outlines that a parcel and the records it names have."""
    c = table(spark, folder, "canonical_parcel").select("canonical_id", F.col("geometry").alias("g1"), F.explode("source_record_ids").alias("record_id"))
    s = table(spark, folder, "source_record").select("record_id", F.col("geometry").alias("g2")).distinct()
    return c.join(s, "record_id").select("canonical_id", "record_id", F.inline(F.array(planar.measures_col(F.col("g1"), F.col("g2")))))


def content_hash(spark: SparkSession, folder: str) -> DataFrame:
    """SHA-256 of the canonical JSON of a delivery's geometry, attributes and declared system."""
    return _checked(spark, folder).select("ingest_seq", "content_hash")


def evidence_verify(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts of signed envelopes of all parcels, every fifth of them tampered with after signing."""
    c = table(spark, folder, "canonical_parcel")
    body = F.to_json(F.struct(F.lit("1").alias("schema_version"), F.col("canonical_id").alias("parcel_id"), F.sort_array("source_record_ids").alias("source_record_ids"), F.col("status").alias("decision")))
    signed = evidence.sign_rows(c.select("canonical_id", body.alias("payload")), "payload", TEST_SEED)
    changed = F.substring("canonical_id", -1, 1).isin("0", "5")
    signed = signed.withColumn("envelope", F.when(changed, F.regexp_replace("envelope", '"decision":"', '"decision":"X')).otherwise(F.col("envelope")))
    key = evidence.public_key(TEST_SEED)
    return evidence.verify_rows(signed, {evidence.key_id(key): key}).groupBy("verdict").agg(F.count("*").alias("envelopes"))


def audit_trail(spark: SparkSession, folder: str) -> DataFrame:
    """Events with the hash of their content and that of the event before in the user's trail."""
    e = table(spark, folder, "events").withColumn("event_hash", F.sha2(F.concat_ws("|", F.col("event_type"), F.col("props")), 256))
    return e.select("event_id", "event_hash", F.lag("event_hash").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("before"))


def latest_proposal(spark: SparkSession, folder: str) -> DataFrame:
    """The latest version of each key, by date and number."""
    o = table(spark, folder, "orders")
    return o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"), F.count("*").alias("versions"))


def feature_page(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.page(table(spark, folder, "canonical_parcel").select("canonical_id", "status"), "canonical_id", 100, 50)


def rate_limit_admission(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.admissions(table(spark, folder, "events"), "user_id", "ts", "event_id", 3, 3600)


def ml_rerank(spark: SparkSession, folder: str) -> DataFrame:
    """Learned and final score of every matched pair, with its four strongest features."""
    r = ml.rerank(matching.scored(views.records(spark, folder), matches_only=True), ml.ensured(spark))
    return r.withColumn("strongest", F.to_json("strongest"))


def export_geojson(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.geojson_features(table(spark, folder, "canonical_parcel"), "canonical_id", "geometry", ("village_code", "land_use", "status"))


def evidence_zip(spark: SparkSession, folder: str) -> DataFrame:
    """Name, size and manifest hash of a package for each parcel."""
    c = table(spark, folder, "canonical_parcel")
    made = F.create_map(F.lit("source_manifest.json"), F.to_json(F.struct("canonical_id", "source_record_ids", "village_code")), F.lit("proposal.geojson"), F.to_json(F.struct("*")))
    return sinks.packages(c.select("canonical_id", made.alias("members"))).drop("content")


def topology_gap_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbouring cadastral outlines, a quarter of them widened so that some gaps are small, and whether they can be joined."""
    r = views.records(spark, folder).where("source_type = 'CADASTRAL'").withColumn("maxx", F.when(F.col("k") % 4 == 0, F.col("minx") + 0.00799995 + (F.col("k") % 7) * 0.000001).otherwise(F.col("maxx")))
    p = matching.candidates(r)
    fixed = topology.corrected(F.lit("GAP"), views.box_text("a_"), views.box_text("b_"), F.lit(True))
    return p.select("a_record_id", "b_record_id", F.inline(F.array(fixed))).select("a_record_id", "b_record_id", "outcome", F.round("amount", 2).alias("gap_sqm"))


def ripple_line_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Metres of observed lines inside and on the outline of the parcels of their case."""
    lines = table(spark, folder, "gt_observation").select(F.col("ingest_seq").alias("key"), "case_id", F.col("geometry_geojson").alias("line"))
    parcels = table(spark, folder, "canonical_parcel").select(F.col("canonical_id").alias("area_key"), "case_id", F.col("geometry").alias("area"))
    m = topology.lines_on_areas(lines, parcels)
    return m.where("inside_m > 0.5 OR on_outline_m > 0.5").select(F.col("key").alias("ingest_seq"), F.col("area_key").alias("canonical_id"), F.round("inside_m", 6).alias("inside_m"), F.round("on_outline_m", 6).alias("on_outline_m"))


def gnss_features(spark: SparkSession, folder: str) -> DataFrame:
    return adapters.gnss(table(spark, folder, "gnss_observation"))


def gt_features(spark: SparkSession, folder: str) -> DataFrame:
    return adapters.ground_truth(table(spark, folder, "gt_observation"))


QUERIES = {f.__name__: f for f in (
    ingest_crs_gates, ingest_record_ids, ingest_capture_ts, schema_alias_map, schema_fuzzy_map, schema_area_units, geometry_outcomes, quality_profile, quality_report, quality_area_outliers, quality_field_completeness,
    dataset_counts, parcel_source_scan, parcel_members, lineage_edges, lineage_origins, lineage_independence, conflicts_provenance, lineage_hash_check, gnss_accuracy, gnss_quality, gt_category,
    elevation_height, imagery_type, ulpin_validate, ulpin_extract, ulpin_demo_id, ulpin_link, name_normalize, name_compare, owner_similarity, geom_general_iou, content_hash, evidence_verify,
    topology_gap_fill, ripple_line_checks, gnss_features, gt_features, audit_trail, latest_proposal, feature_page, rate_limit_admission, ml_rerank, export_geojson, evidence_zip,
)}

_case = lambda d, x: "CASE " + " ".join(f"WHEN {x.format(k)} THEN {v}" for k, v in d.items())
_METHOD = "CASE WHEN method IS NULL OR method = '' THEN 'unknown' " + " ".join(f"WHEN contains(replace(replace(lower(method), '-', '_'), ' ', '_'), '{m}') THEN '{m}'" for m in config.GNSS_QUALITY) + " ELSE 'unknown' END"
_GN = f"""WITH g AS (SELECT ingest_seq, pdop, baseline_length_km AS bl, {_METHOD} AS method FROM gnss_observation),
e AS (SELECT *, ({_case({m: str(v) for m, v in config.GNSS_ACCURACY_M.items()}, "method = '{}'")} END)::DOUBLE * CASE WHEN pdop > 0 THEN greatest(1.0, pdop / 1.5) ELSE 1.0 END
  + CASE WHEN bl <> 0 AND method IN ('rtk_cors', 'rtk_local') THEN bl * 0.001::DOUBLE ELSE 0.0 END AS a, ({_case({m: str(v) for m, v in config.GNSS_QUALITY.items()}, "method = '{}'")} END)::DOUBLE AS w FROM g),
f AS (SELECT ingest_seq, method, round(a, 5) AS accuracy_m, CASE WHEN a > 2 THEN least(w, 0.60) WHEN a > 0.5 THEN least(w, 0.85) ELSE w END AS weight FROM e)
"""
_PROFILE = """WITH j AS (SELECT *, CASE WHEN json_valid(geometry) THEN CASE WHEN lower(geometry->>'$.type') = 'feature' THEN geometry->'$.geometry' ELSE geometry::JSON END END AS g FROM source_record),
t AS (SELECT *, g->>'$.type' AS kind, g->'$.coordinates' AS c FROM j),
rings AS (SELECT *, CASE kind WHEN 'Polygon' THEN [TRY_CAST(c AS DOUBLE[][][])] WHEN 'MultiPolygon' THEN TRY_CAST(c AS DOUBLE[][][][]) END AS polys FROM t),
o AS (SELECT *, CASE WHEN kind IN ('Polygon', 'MultiPolygon') THEN CASE WHEN c::VARCHAR = '[]' THEN 'EMPTY' WHEN polys IS NULL OR polys[1] IS NULL THEN 'BAD'
    WHEN list_bool_and(list_transform(flatten(polys), lambda r: len(r) - (CASE WHEN r[1] = r[-1] THEN 1 ELSE 0 END) >= 3)) THEN 'OK' ELSE 'BAD' END
    WHEN kind = 'Point' THEN CASE WHEN c::VARCHAR = '[]' THEN 'EMPTY' WHEN len(TRY_CAST(c AS DOUBLE[])) >= 2 THEN 'OK' ELSE 'BAD' END ELSE 'BAD' END AS outcome FROM rings),
dup AS (SELECT source_dataset_id, count(*) AS n FROM (SELECT source_dataset_id, record_id FROM source_record WHERE record_id <> '' GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1),
g AS (SELECT source_dataset_id, count(*) AS total, count(*) FILTER (outcome = 'OK') AS valid_geometry, count(*) FILTER (outcome = 'EMPTY') AS empty, count(*) FILTER (capture_timestamp IS NULL OR capture_timestamp = '') AS no_time FROM o GROUP BY 1),
s AS (SELECT g.*, coalesce(dup.n, 0) AS duplicate_ids, 0.5 * (100.0 * valid_geometry / total) + 0.25 * (100.0 * (total - no_time) / total) + 0.25 * (100.0 * (total - coalesce(dup.n, 0)) / total) AS sc FROM g LEFT JOIN dup ON g.source_dataset_id IS NOT DISTINCT FROM dup.source_dataset_id),
p AS (SELECT source_dataset_id, total, valid_geometry, empty, total - valid_geometry - empty AS unfixable, no_time, duplicate_ids, round(sc, 1)::DOUBLE AS score, CASE WHEN sc >= 90 THEN 'HIGH' WHEN sc >= 70 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM s)
"""
_FIELDS = """WITH v AS (SELECT dataset_id, CASE WHEN json_valid(attributes_raw) THEN attributes_raw END AS j FROM ingested_record),
k AS (SELECT dataset_id, j, unnest(json_keys(j)) AS field FROM v WHERE json_type(j) = 'OBJECT'),
f AS (SELECT dataset_id, field, map_extract(json_transform(j, '"MAP(VARCHAR, JSON)"'), field)[1] AS val FROM k)
"""
_ULPIN = "CASE WHEN {0} IS NULL OR regexp_replace({0}, '[\\s-]', '', 'g') = '' THEN 'EMPTY' WHEN NOT regexp_full_match(regexp_replace({0}, '[\\s-]', '', 'g'), '[0-9]+') THEN 'NOT_DIGITS' WHEN length(regexp_replace({0}, '[\\s-]', '', 'g')) <> 14 THEN 'WRONG_LENGTH' WHEN NOT substr(regexp_replace({0}, '[\\s-]', '', 'g'), 1, 2) BETWEEN '01' AND '38' THEN 'UNKNOWN_STATE' ELSE 'VALID' END"
_LIN = """WITH RECURSIVE n AS MATERIALIZED (SELECT upper(trim(node_id)) AS node, max((lower(node_type) = 'origin')::INT) AS o FROM provenance_graph WHERE trim(node_id) <> '' GROUP BY 1),
e AS MATERIALIZED (SELECT DISTINCT x.node, x.parent FROM (SELECT upper(trim(node_id)) AS node, upper(trim(unnest(parent_ids))) AS parent FROM provenance_graph) x
  WHERE x.parent <> '' AND x.node NOT IN (SELECT node FROM n WHERE o = 1)),
a(node, up) AS (SELECT node, node FROM n UNION SELECT a.node, e.parent FROM a JOIN e ON a.up = e.node),
k(node, up) AS (SELECT node, parent FROM e UNION SELECT k.node, e.parent FROM k JOIN e ON k.up = e.node),
ends AS (SELECT a.node, a.up, coalesce(n.o, 0) AS o FROM a LEFT JOIN n ON a.up = n.node WHERE a.up NOT IN (SELECT node FROM e)),
bad AS (SELECT node FROM ends WHERE o = 0 UNION SELECT node FROM k WHERE node = up UNION SELECT node FROM k WHERE up IN (SELECT node FROM k WHERE node = up)),
lo AS MATERIALIZED (SELECT n.node AS node_id, CASE WHEN b.node IS NULL THEN (SELECT count(DISTINCT up) FROM ends WHERE ends.node = n.node) ELSE 0 END AS origins, CASE WHEN b.node IS NULL THEN 'ok' ELSE 'unknown' END AS status FROM n LEFT JOIN bad b ON n.node = b.node)
"""
_IND = """,
gr AS (SELECT canonical_id AS group_id, s.record_id, nullif(upper(trim(provenance_node_id)), '') AS node FROM (SELECT canonical_id, unnest(source_record_ids) AS record_id FROM canonical_parcel) c
  JOIN (SELECT DISTINCT record_id, provenance_node_id FROM source_record) s USING (record_id)),
gn AS (SELECT DISTINCT * FROM gr),
gc AS (SELECT group_id, count(DISTINCT record_id) AS records, count(node) AS named, max((node IS NOT NULL AND (node NOT IN (SELECT node FROM n) OR node IN (SELECT node FROM bad)))::INT) AS bad FROM gn GROUP BY 1),
go AS (SELECT group_id, count(DISTINCT ends.up) AS origins FROM gn JOIN ends USING (node) GROUP BY 1),
li AS (SELECT group_id, CASE WHEN named < 2 OR bad = 1 THEN 0 ELSE coalesce(origins, 0) END AS lineages,
  CASE WHEN named < 2 AND records < 2 THEN 'INCOMPLETE' WHEN named < 2 OR bad = 1 THEN 'UNKNOWN_LINEAGE' WHEN origins > 1 THEN 'INDEPENDENT' ELSE 'SHARED_ORIGIN' END AS verdict FROM gc LEFT JOIN go USING (group_id))
"""
_GT = "CASE WHEN category IS NULL OR category = '' THEN 'other' " + " ".join(f"WHEN starts_with(replace(replace(trim(lower(category)), ' ', '_'), '-', '_'), '{c[:6]}') THEN '{c}'" for c in config.GT_CATEGORIES) + " ELSE 'other' END"
_ALIAS = "CASE regexp_replace(lower(trim(field)), '[^a-z0-9_]', '_', 'g') " + " ".join(f"WHEN '{a}' THEN '{c}'" for a, c in config.ALIASES.items()) + " ELSE '' END"
_UNIT = "CASE lower(trim(u)) " + " ".join(f"WHEN '{u}' THEN {v}" for u, v in config.AREA_UNITS.items()) + " ELSE 1.0 END"
_DEVA = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in {**text._SIGNS, **text._LETTERS}.items()) + "}"
_HON = ", ".join(f"'{h}'" for h in config.HONORIFICS if h.isascii())
ORACLE = {
    "ingest_crs_gates": """SELECT ingest_seq, CASE WHEN abs(lat) > 90 OR abs(lon) > 180 THEN 'IMPOSSIBLE_EXTENT' WHEN lon BETWEEN 6 AND 38 AND lat BETWEEN 67 AND 98 THEN 'AXIS_ORDER'
  WHEN NOT (lon >= 57 AND lon <= 108 AND lat >= -4 AND lat <= 48) THEN 'PLAUSIBILITY' ELSE 'NONE' END AS gate, CASE WHEN greatest(abs(lon), abs(lat)) > 1000 THEN 'PROJECTED_METRES' WHEN abs(lat) > 90 THEN 'LATITUDE_OUTSIDE' ELSE '' END AS reject
  FROM gnss_observation WHERE lon IS NOT NULL AND lat IS NOT NULL AND NOT isnan(lon) AND NOT isnan(lat)""",
    "ingest_record_ids": """SELECT ingest_seq, dataset_id || '::' || coalesce(nullif(j->>'$.id', ''), nullif(j->>'$.record_id', ''), nullif(j->>'$.parcel_id', ''), nullif(j->>'$.property_id', ''), nullif(j->>'$.khasra_no', ''), 'rec-' || lpad(n::VARCHAR, 6, '0')) AS derived_id
  FROM (SELECT *, CASE WHEN json_valid(attributes_raw) THEN attributes_raw::JSON END AS j, row_number() OVER (PARTITION BY dataset_id ORDER BY ingest_seq) - 1 AS n FROM ingested_record)""",
    "ingest_capture_ts": "SELECT ingest_seq, coalesce(nullif(attributes_canonical['capture_date'], ''), nullif(attributes_canonical['survey_date'], ''), nullif(attributes_canonical['date'], '')) AS captured FROM ingested_record",
    "schema_alias_map": _FIELDS + f'SELECT field, count(*) AS "values", count(DISTINCT dataset_id) AS datasets, {_ALIAS} AS canonical FROM k GROUP BY field',
    "schema_area_units": f"SELECT ingest_seq, round(try_cast(replace(a, ',', '') AS DOUBLE) * {_UNIT}::DOUBLE, 3) AS sqm FROM (SELECT ingest_seq, attributes->>'$.Area' AS a, attributes->>'$.Unit' AS u FROM source_record WHERE json_valid(attributes)) WHERE a IS NOT NULL",
    "quality_profile": _PROFILE + "SELECT * FROM p",
    "quality_report": _PROFILE + "SELECT level, count(*) AS datasets, sum(total)::BIGINT AS records, round(100 * sum(valid_geometry) / sum(total), 4) AS valid_pct FROM p GROUP BY 1",
    "quality_area_outliers": """WITH l AS (SELECT village_code, list_sort(list(area_sqm)) AS v, count(*) AS n FROM canonical_parcel WHERE area_sqm IS NOT NULL GROUP BY 1 HAVING count(*) >= 4),
  q AS (SELECT *, v[n // 4 + 1] AS q1, v[3 * n // 4 + 1] AS q3 FROM l), b AS (SELECT *, q1 - 3 * (q3 - q1) AS lo, q3 + 3 * (q3 - q1) AS hi FROM q)
  SELECT village_code, n, round(lo, 3) AS low, round(hi, 3) AS high, len(list_filter(v, lambda x: x < lo OR x > hi)) AS outliers FROM b""",
    "quality_field_completeness": _FIELDS + "SELECT dataset_id, field, count(*) AS rows, count(*) FILTER (val IS NULL OR json_type(val) = 'NULL' OR val::VARCHAR = '\"\"') AS missing FROM f GROUP BY 1, 2",
    "dataset_counts": "SELECT case_id, source_type, count(*) AS records, count(DISTINCT source_dataset_id) AS datasets FROM source_record GROUP BY 1, 2",
    "parcel_source_scan": f"SELECT ingest_seq, record_id, source_type FROM source_record WHERE case_id = 'ward17_core' AND source_type IN ({', '.join(repr(t) for t in config.PARCEL_TYPES)})",
    "parcel_members": "SELECT canonical_id, count(*) AS deliveries, count(DISTINCT record_id) AS records, count(DISTINCT source_type) AS source_types FROM (SELECT canonical_id, unnest(source_record_ids) AS record_id FROM canonical_parcel) JOIN source_record USING (record_id) GROUP BY 1",
    "topology_gap_fill": "WITH " + views.SQL + f""", f AS (SELECT case_id, record_id, seq, minx, miny, CASE WHEN k % 4 = 0 THEN minx + 0.00799995 + (k % 7) * 0.000001 ELSE maxx END AS maxx, maxy FROM r WHERE source_type = 'CADASTRAL'),
  gp AS (SELECT a.record_id AS a_record_id, b.record_id AS b_record_id, sqrt(pow(greatest(0.0, b.minx - a.maxx, a.minx - b.maxx), 2) + pow(greatest(0.0, b.miny - a.maxy, a.miny - b.maxy), 2)) AS d, least(a.maxx - a.minx + a.maxy - a.miny, b.maxx - b.minx + b.maxy - b.miny) / 2 AS side,
    (111132.92 - 559.82 * cos(2 * radians((a.miny + a.maxy) / 2))) AS mlat, 111412.84 * cos(radians((a.miny + a.maxy) / 2)) AS mlon
    FROM f a JOIN f b ON a.case_id = b.case_id AND a.seq < b.seq AND a.minx - 0.01 <= b.maxx AND b.minx <= a.maxx + 0.01 AND a.miny - 0.01 <= b.maxy AND b.miny <= a.maxy + 0.01)
  SELECT a_record_id, b_record_id, CASE WHEN d <= 0 THEN 'NONE' WHEN d * side * mlat * mlon > 50 OR d * mlat > 20 THEN 'GAP_LARGE' ELSE 'GAP_FILL' END AS outcome, round(CASE WHEN d <= 0 THEN 0 ELSE d * side * mlat * mlon END, 2) AS gap_sqm FROM gp""",
    "lineage_edges": "SELECT DISTINCT node_id, parent_id FROM (SELECT node_id, unnest(parent_ids) AS parent_id FROM provenance_graph) WHERE parent_id IS NOT NULL",
    "lineage_origins": _LIN + "SELECT node_id, origins, status FROM lo",
    "lineage_hash_check": """SELECT node_id, CASE WHEN count(DISTINCT h) > 1 THEN 'CHANGED' ELSE 'OK' END AS state FROM (SELECT node_id, sha256(concat_ws('|', node_id, coalesce(node_type, ''), coalesce(array_to_string(list_transform(parent_ids, lambda x: coalesce(x, '')), ','), ''))) AS h FROM provenance_graph) GROUP BY 1""",
    "lineage_independence": _LIN + _IND + "SELECT group_id, lineages, verdict FROM li",
    "conflicts_provenance": _LIN + _IND + "SELECT group_id AS parcel_id, verdict AS conflict_type, CASE verdict WHEN 'SHARED_ORIGIN' THEN 'LOW' ELSE 'MEDIUM' END AS severity, verdict = 'SHARED_ORIGIN' AS auto_resolvable FROM li WHERE verdict IN ('SHARED_ORIGIN', 'UNKNOWN_LINEAGE')",
    "gnss_accuracy": _GN + "SELECT * FROM f",
    "gnss_quality": _GN + "SELECT method, count(*) AS marks, round(avg(weight), 6) AS mean_weight FROM f GROUP BY 1",
    "gt_category": f"SELECT {_GT} AS category, count(*) AS observations FROM gt_observation GROUP BY 1",
    "elevation_height": """SELECT p_partkey, h AS height_m, h > 1.5 AS has_structure, CASE WHEN h < 0.3 THEN 'open_land' WHEN h < 1.5 THEN 'low_vegetation_or_rubble' WHEN h < 6 THEN 'single_storey_building' WHEN h < 15 THEN 'multi_storey_building' ELSE 'high_rise' END AS likely_use
  FROM (SELECT p_partkey, round((500.0::DOUBLE + p_size / 2) - (500.0::DOUBLE + p_partkey % 7), 2) AS h FROM part)""",
    "imagery_type": """SELECT CASE WHEN i = 0 OR (i = 3 AND p_size * 20 < 500) THEN 'drone_ori' WHEN i = 1 AND p_size < 50 THEN 'satellite_high_res' WHEN i = 1 THEN 'satellite_medium_res' WHEN i = 2 THEN 'aerial_photo' ELSE 'unknown' END AS imagery, count(*) AS images
  FROM (SELECT p_partkey % 4 AS i, p_size FROM part) GROUP BY 1""",
    "ulpin_validate": f"SELECT {_ULPIN.format('ulpin')} AS status, count(*) AS parcels FROM canonical_parcel GROUP BY 1",
    "ulpin_extract": "SELECT ingest_seq, coalesce(" + ", ".join(f"CASE WHEN {_ULPIN.format(v)} = 'VALID' THEN regexp_replace({v}, '[\\s-]', '', 'g') END" for v in (f"(j->>'$.{k}')" for k in config.ULPIN_KEYS)) + ") AS found FROM (SELECT ingest_seq, CASE WHEN json_valid(attributes) THEN attributes::JSON END AS j FROM source_record)",
    "ulpin_demo_id": "SELECT canonical_id, '1542' || lpad((floor(abs(centroid_lat) * 10000)::BIGINT % 1000000)::VARCHAR, 6, '0') || lpad((floor(abs(centroid_lon) * 1000)::BIGINT % 10000)::VARCHAR, 4, '0') AS demo_id FROM canonical_parcel WHERE centroid_lon IS NOT NULL AND centroid_lat IS NOT NULL",
    "name_normalize": f"""WITH l AS (SELECT pair_id, CASE WHEN regexp_matches(name_a, '[\u0900-\u097F]') THEN array_to_string(list_transform(regexp_extract_all(name_a, '(?s).'), lambda c: coalesce({_DEVA}[c], c)), '') ELSE name_a END AS name FROM name_match_result),
  w AS (SELECT pair_id, array_to_string(list_filter(regexp_split_to_array(lower(strip_accents(name)), '[\\s\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{3000}}]+'), lambda x: regexp_replace(x, '\\.+$', '') NOT IN ({_HON})), ' ') AS w FROM l)
  SELECT pair_id, trim(regexp_replace(regexp_replace(regexp_split_to_array(w, '(?i)\\b(?:s/?o|d/?o|w/?o|son of|daughter of|wife of|wd of|putra|putri|patni|widow of|s\\.o|d\\.o|w\\.o)\\b')[1], '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS normal FROM w""",
    "audit_trail": "SELECT event_id, h AS event_hash, lag(h) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM (SELECT *, sha256(concat_ws('|', event_type, props)) AS h FROM events)",
    "latest_proposal": "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest, count(*) AS versions FROM orders GROUP BY 1",
    "feature_page": "SELECT canonical_id, status, (SELECT count(*) FROM canonical_parcel) AS number_matched FROM canonical_parcel ORDER BY canonical_id LIMIT 50 OFFSET 100",
}
