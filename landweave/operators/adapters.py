"""Observations of instruments and people as features: geometry, properties, time and the node of their lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landweave.operators import ingest


def _features(df: DataFrame, geometry: Column, properties: dict[str, Column], when: Column, node: Column) -> DataFrame:
    pairs = [x for k, v in properties.items() for x in (F.lit(k), v.cast("string"))]
    props = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
    return df.select("case_id", "dataset_id", "ingest_seq", geometry.alias("geometry"), props.alias("properties"), when.alias("capture_timestamp"), node.alias("provenance_node_id"))


def gnss(marks: DataFrame) -> DataFrame:
    """Point features of survey marks; marks without a position give none. The height is the third ordinate."""
    m = marks.where("lon IS NOT NULL AND lat IS NOT NULL").withColumn("_m", ingest.gnss_method(F.col("method")))
    m = m.withColumn("_a", F.coalesce("horizontal_accuracy_m", ingest.gnss_accuracy(F.col("_m"), F.col("pdop"), F.col("baseline_length_km"))))
    xyz = F.array_compact(F.array("lon", "lat", "height_m"))
    geometry = F.to_json(F.struct(F.lit("Point").alias("type"), xyz.alias("coordinates")))
    props = {"gnss_method": F.col("_m"), "horizontal_accuracy_m": F.col("_a"), "vertical_accuracy_m": F.col("vertical_accuracy_m"), "pdop": F.col("pdop"), "cors_station": F.col("station_id"),
             "baseline_length_km": F.col("baseline_length_km"), "mark_type": F.col("mark_type"), "quality_weight": ingest.gnss_weight(F.col("_m"), F.col("_a")), "parcel_reference": F.col("linked_parcel_hint")}
    return _features(m, geometry, props, F.col("observation_epoch"), F.concat(F.lit("DS-GNSS-"), "dataset_id"))


def ground_truth(observations: DataFrame) -> DataFrame:
    """Features of field observations; the confidence is kept within 0 and 1 and is 0.90 where none is given."""
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.90))))
    props = {"gt_category": ingest.gt_category(F.col("category")), "gt_confidence": c, "observed_value": F.col("observed_value"), "contradicts_source": F.col("contradicts_source"),
             "supports_source": F.col("supports_source"), "parcel_reference": F.col("linked_parcel_hint")}
    return _features(observations, F.col("geometry_geojson"), props, F.col("observation_date"), F.concat(F.lit("ORIG-GT-"), "dataset_id"))


def imagery(features: DataFrame, gsd_cm: float, metres_per_gsd: float = 2.0) -> DataFrame:
    """Adds ``accuracy_m`` to derived outlines: the given one, else the ground sample distance times a factor (2 for buildings, 1.5 for boundaries)."""
    return features.withColumn("accuracy_m", F.coalesce(F.element_at("properties", "accuracy_m").try_cast("double"), F.lit(gsd_cm / 100 * metres_per_gsd)))


def _first(props: Column, *names: str) -> Column:
    """Value of the first of ``names`` among the properties, letter case aside; empty texts are none."""
    low = F.transform_keys(props, lambda k, _: F.lower(k))
    return F.coalesce(*[F.nullif(F.element_at(low, n), F.lit("")) for n in names])


def gnss_files(features: DataFrame, dataset: str, case: str) -> DataFrame:
    """Marks as ``gnss`` takes them from features read from CSV, JSON or GeoJSON files; features other than points have no position."""
    g = F.from_json("geometry", "type string, coordinates array<double>")
    point = F.when(g["type"] == "Point", g["coordinates"])
    p = F.col("properties")
    number = lambda *n: _first(p, *n).try_cast("double")
    return features.select(
        F.lit(case).alias("case_id"), F.lit(dataset).alias("dataset_id"), F.col("feature_idx").cast("bigint").alias("ingest_seq"), F.coalesce(_first(p, "point_id", "id"), F.format_string("P%04d", "feature_idx")).alias("point_id"),
        F.get(point, F.lit(0)).alias("lon"), F.get(point, F.lit(1)).alias("lat"), F.coalesce(number("height_m", "height", "elevation"), F.get(point, F.lit(2))).alias("height_m"), _first(p, "method", "gnss_method").alias("method"),
        number("horizontal_accuracy_m", "accuracy_m").alias("horizontal_accuracy_m"), number("vertical_accuracy_m").alias("vertical_accuracy_m"), number("pdop").alias("pdop"), _first(p, "station_id", "cors_station").alias("station_id"),
        number("baseline_length_km", "baseline_km").alias("baseline_length_km"), _first(p, "mark_type").alias("mark_type"), _first(p, "linked_parcel_hint", "parcel").alias("linked_parcel_hint"),
        F.coalesce("capture_timestamp", _first(p, "observation_epoch", "epoch")).alias("observation_epoch"),
    )


def ground_truth_files(features: DataFrame, dataset: str, case: str) -> DataFrame:
    """Observations as ``ground_truth`` takes them from features read from CSV, JSON or GeoJSON files."""
    p = F.col("properties")
    return features.select(
        F.lit(case).alias("case_id"), F.lit(dataset).alias("dataset_id"), F.col("feature_idx").cast("bigint").alias("ingest_seq"), F.coalesce(_first(p, "obs_id", "id"), F.format_string("GT%04d", "feature_idx")).alias("obs_id"),
        F.col("geometry").alias("geometry_geojson"), _first(p, "category", "gt_category").alias("category"), _first(p, "observed_value", "value").alias("observed_value"), _first(p, "confidence").try_cast("double").alias("confidence"),
        _first(p, "operator").alias("operator"), F.coalesce("capture_timestamp", _first(p, "observation_date")).alias("observation_date"), _first(p, "linked_parcel_hint", "parcel").alias("linked_parcel_hint"),
        _first(p, "contradicts_source", "contradicts").alias("contradicts_source"), _first(p, "supports_source", "supports").alias("supports_source"),
    )


def lineage_nodes(dataset: str, kind: str, case: str, session: SparkSession) -> DataFrame:
    """The two nodes that an adapted dataset brings: its origin, and the dataset under it."""
    origin = f"ORIG-{kind}-{dataset}"
    return session.createDataFrame([(origin, "origin", [], f"{kind} survey", case), (dataset, "dataset", [origin], dataset, case)], "node_id string, node_type string, parent_ids array<string>, label string, case_id string")
