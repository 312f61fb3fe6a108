"""Queries of the general data-preparation operators of the core."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landweave.operators import hierarchy, schema_drift, spatial, timestamps
from landweave.session import Stage
from landweave.tables import table

#: Metres within which an observation is near a mark.
NEAR_M = 10.0

_TIMES = (
    ("source_record", "capture_timestamp", "source_dataset_id"),
    ("gnss_observation", "observation_epoch", "dataset_id"),
    ("gt_observation", "observation_date", "dataset_id"),
)


def _times(spark: SparkSession, folder: str) -> DataFrame:
    rows = [
        table(spark, folder, t).select(F.lit(t).alias("table_name"), "ingest_seq", F.col(v).alias("value"), F.col(d).alias("dataset_id"))
        for t, v, d in _TIMES
    ]
    return timestamps.with_office(reduce(DataFrame.unionByName, rows), "dataset_id", table(spark, folder, "dataset_profile"), table(spark, folder, "survey_office"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    out = timestamps.instants(_times(spark, folder), "value")
    # A generator, as a filter would be pushed down and evaluate the whole parse again.
    return out.select("table_name", "ingest_seq", F.explode(F.array_compact(F.array("instant_us"))).alias("instant_us"))


def p3_mixtures(spark: SparkSession, folder: str) -> DataFrame:
    """Learned weight of each reading of all-numeric dates, by source."""
    got = timestamps.mixtures(timestamps.readings(_times(spark, folder), "value"))
    return got.select("source", "n_values", *[F.col("weights")[i].alias(f"w_{o.lower()}") for i, o in enumerate(timestamps.ORDERS)])


def _deliveries(spark: SparkSession, folder: str) -> DataFrame:
    of = table(spark, folder, "dataset_profile").select("dataset_id", "feed_id", "delivery_no")
    return table(spark, folder, "ingested_record").select("dataset_id", "ingest_seq", "record_id", "attributes_raw").join(of, "dataset_id")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return schema_drift.changes(_deliveries(spark, folder))


def p5_records(spark: SparkSession, folder: str) -> DataFrame:
    """One consistent table of all deliveries."""
    return schema_drift.consistent(_deliveries(spark, folder))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.roots(table(spark, folder, "provenance_graph"))


def p6_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Path of each node from each of its roots, as JSON."""
    rows = table(spark, folder, "provenance_graph")
    p = hierarchy.paths(rows, hierarchy.roots(rows))
    return p.select("node_id", "root_id", "depth", F.to_json("path").alias("path"))


def p6_descendants(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "provenance_graph")
    return hierarchy.descendants(rows, hierarchy.roots(rows))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    g = table(spark, folder, "gnss_observation")
    lon, lat = spatial.right_way(F.col("lon"), F.col("lat"))
    marks = g.select(F.col("ingest_seq").alias("id"), lon.alias("lon"), lat.alias("lat")).where(F.col("lon").isNotNull())
    seen = Stage(spark).write(spatial.shapes(table(spark, folder, "gt_observation"), "ingest_seq", "geometry_geojson"))
    near = spatial.near(marks, seen.where(F.col("area").isNull()), NEAR_M)
    within = spatial.within(marks, seen)
    return near.select(F.lit("near").alias("relation"), F.col("id").alias("gnss_seq"), F.col("key").alias("gt_seq")).union(
        within.select(F.lit("within"), "id", "key")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p3_found": p3_found,
    "p3_mixtures": p3_mixtures,
    "p5_found": p5_found,
    "p5_records": p5_records,
    "p6_found": p6_found,
    "p6_paths": p6_paths,
    "p6_descendants": p6_descendants,
    "p7_found": p7_found,
}

_P6 = """
WITH RECURSIVE n AS MATERIALIZED (SELECT DISTINCT upper(trim(node_id)) AS node FROM provenance_graph WHERE trim(node_id) <> ''),
e AS MATERIALIZED (
  SELECT DISTINCT x.node, x.parent FROM (
    SELECT upper(trim(node_id)) AS node, upper(trim(unnest(parent_ids))) AS parent FROM provenance_graph) x
  WHERE x.parent IN (SELECT node FROM n) AND x.node <> ''),
-- nodes on or below a cycle are found first, so the walk over the others needs no limit of depth
k(node, up) AS (SELECT node, parent FROM e UNION SELECT k.node, e.parent FROM k JOIN e ON k.up = e.node),
bad AS MATERIALIZED (
  SELECT node FROM k WHERE node = up
  UNION SELECT k.node FROM k WHERE k.up IN (SELECT node FROM k WHERE node = up)),
d(node, root, depth) AS (
  SELECT node, node, 0 FROM n WHERE node NOT IN (SELECT node FROM e)
  UNION SELECT e.node, d.root, d.depth + 1 FROM d JOIN e ON e.parent = d.node WHERE e.node NOT IN (SELECT node FROM bad))
"""
_P6_SOUND = _P6 + """,
f AS MATERIALIZED (SELECT node, root, min(depth)::INT AS depth FROM d WHERE node NOT IN (SELECT node FROM bad) GROUP BY 1, 2)"""
ORACLE: dict[str, str] = {
    "p6_found": _P6_SOUND + """
SELECT node AS node_id, root AS root_id, depth FROM f
UNION ALL SELECT node, '', -1 FROM bad""",
    "p6_paths": _P6_SOUND + """,
via AS MATERIALIZED (SELECT x.node, x.root, x.depth, min(e.parent) AS parent FROM f x JOIN e USING (node) JOIN f y ON y.node = e.parent AND y.root = x.root AND y.depth = x.depth - 1 GROUP BY 1, 2, 3),
pt(node, root, depth, path) AS (SELECT node, root, depth, [node] FROM f WHERE depth = 0
  UNION ALL SELECT v.node, v.root, v.depth, list_append(pt.path, v.node) FROM pt JOIN via v ON v.parent = pt.node AND v.root = pt.root AND v.depth = pt.depth + 1)
SELECT node AS node_id, root AS root_id, depth, to_json(path)::VARCHAR AS path FROM pt UNION ALL SELECT node, '', -1, '[]' FROM bad""",
    "p6_descendants": _P6_SOUND + """,
s AS MATERIALIZED (SELECT e.node, e.parent FROM e WHERE e.node NOT IN (SELECT node FROM bad)),
c(node, up, steps) AS (SELECT node, parent, 1 FROM s UNION SELECT c.node, s.parent, c.steps + 1 FROM c JOIN s ON c.up = s.node)
SELECT up AS node_id, node AS descendant_id, min(steps)::INT AS steps FROM c GROUP BY 1, 2""",
}
