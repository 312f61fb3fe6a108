"""Origins of records through a graph of provenance, and whether a group's origins are independent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landweave.operators import hierarchy
from landweave.session import Stage


def edges(nodes: DataFrame) -> DataFrame:
    """(node_id, parent_id), distinct, as typed."""
    return nodes.select("node_id", F.explode("parent_ids").alias("parent_id")).where(F.col("parent_id").isNotNull()).distinct()


def origin_pairs(nodes: DataFrame) -> DataFrame:
    """(node_id, origin_id): each origin above a node; a node with a missing node, a cycle, or an end that is no origin above it has one row with a null origin.

    The walk stops at origins, so an origin has itself. Nodes that others name without a row of
    their own count as missing and have no row here. Written once, as callers read it several times.
    """
    k = hierarchy.key(F.col("node_id"))
    n = nodes.select(k.alias("node_id"), F.lower("node_type").alias("t"), "parent_ids", "case_id")
    is_origin = n.groupBy("node_id").agg(F.max((F.col("t") == "origin").cast("int")).alias("o"))
    cut = n.join(is_origin.where("o = 1").select("node_id"), "node_id", "left_anti").unionByName(
        n.join(is_origin.where("o = 1").select("node_id"), "node_id", "left_semi").withColumn("parent_ids", F.lit(None).cast("array<string>"))
    )
    named = cut.select(F.explode("parent_ids").alias("p")).select(hierarchy.key(F.col("p")).alias("node_id")).where("node_id <> ''").distinct()
    missing = named.join(is_origin, "node_id", "left_anti").select("node_id", F.lit(None).cast("array<string>").alias("parent_ids"), F.lit("").alias("case_id"))
    # Read for the nodes and for the edges, so written.
    rows = Stage(nodes.sparkSession).write(cut.select("node_id", "parent_ids", "case_id").unionByName(missing))
    found = hierarchy.roots(rows)
    told = found.join(is_origin.withColumnRenamed("node_id", "root_id"), "root_id", "left").join(is_origin.select("node_id"), "node_id", "left_semi")
    told = Stage(nodes.sparkSession).write(told.select("node_id", "root_id", F.coalesce("o", F.lit(0)).alias("o")))
    unsound = told.where("o = 0").select("node_id").distinct()
    sound = told.join(unsound, "node_id", "left_anti").select("node_id", F.col("root_id").alias("origin_id"))
    return sound.unionByName(unsound.select("node_id", F.lit(None).cast("string").alias("origin_id")))


def origins(nodes: DataFrame) -> DataFrame:
    """(node_id, origins, status): distinct origins above each node; 0 and unknown where they can't be told."""
    g = origin_pairs(nodes).groupBy("node_id").agg(F.count_distinct("origin_id").alias("origins"))
    return g.select("node_id", "origins", F.when(F.col("origins") > 0, "ok").otherwise("unknown").alias("status"))


def independence(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """(group_id, lineages, verdict) of groups (group_id, record_id, node_id), by the result of ``origin_pairs``.

    UNKNOWN_LINEAGE with 0 lineages where fewer than two records name a node, a node has no row or
    no sound ancestry; SHARED_ORIGIN for one origin; INDEPENDENT for several. A group of a single
    record without a verdict has INCOMPLETE, which is no conflict. Node ids are compared without
    regard to letter case and surrounding blanks; a record counts once for each node it names.
    """
    g = groups.select("group_id", "record_id", F.nullif(hierarchy.key(F.col("node_id")), F.lit("")).alias("node_id")).distinct()
    each = g.join(pairs, "node_id", "left").groupBy("group_id").agg(
        F.count_distinct("record_id").alias("records"), F.count_distinct(F.when(F.col("node_id").isNotNull(), F.struct("record_id", "node_id"))).alias("named"),
        F.count_distinct("origin_id").alias("lineages"), F.max((F.col("node_id").isNotNull() & F.col("origin_id").isNull()).cast("int")).alias("bad"),
    )
    few = F.col("named") < 2
    verdict = F.when(few & (F.col("records") < 2), "INCOMPLETE").when(few | (F.col("bad") == 1), "UNKNOWN_LINEAGE").when(F.col("lineages") > 1, "INDEPENDENT").otherwise("SHARED_ORIGIN")
    return each.select("group_id", F.when(few | (F.col("bad") == 1), 0).otherwise(F.col("lineages")).alias("lineages"), verdict.alias("verdict"))


def pair_independence(matched: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds ``independent`` and ``lineages`` to pairs with a_record_id, b_record_id, a_node and b_node; null and 0 where nothing can be told."""
    both = matched.where("a_node IS NOT NULL AND b_node IS NOT NULL").select(
        "a_record_id", "b_record_id", F.explode(F.array_distinct(F.array(hierarchy.key(F.col("a_node")), hierarchy.key(F.col("b_node"))))).alias("node_id")
    )
    told = both.join(pairs, "node_id", "left").groupBy("a_record_id", "b_record_id").agg(
        F.count_distinct("origin_id").cast("int").alias("_n"), F.bool_or(F.col("origin_id").isNull()).alias("_bad")
    )
    out = matched.join(told, ["a_record_id", "b_record_id"], "left")
    known = F.coalesce(~F.col("_bad"), F.lit(False))
    return out.withColumn("independent", F.when(known, F.col("_n") > 1)).withColumn("lineages", F.when(known, F.col("_n")).otherwise(0)).drop("_n", "_bad")


def verify(nodes: DataFrame, expected: DataFrame, node_hash: str = "content_hash") -> DataFrame:
    """(node_id, state) of expected hashes (node_id, content_hash): MISSING, CHANGED or OK."""
    got = nodes.groupBy("node_id").agg(F.min(node_hash).alias("_h"), F.count_distinct(node_hash).alias("_n"))
    e = expected.select("node_id", F.col("content_hash").alias("_want")).join(got, "node_id", "left")
    return e.select("node_id", F.when(F.col("_h").isNull(), "MISSING").when((F.col("_n") > 1) | (F.col("_h") != F.col("_want")), "CHANGED").otherwise("OK").alias("state"))
