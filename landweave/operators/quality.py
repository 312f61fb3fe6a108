"""Quality profiles of delivered datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landweave.functions.columns import step
from landweave.session import Stage


def profile(rows: DataFrame, dataset: str, record: str, outcome: str, captured: str) -> DataFrame:
    """One row a dataset: counts of geometries, missing times and repeated ids, score and level.

    ``outcome`` is that of ``ingest.checked``: OK and REPAIRED count as valid, EMPTY on its own, the
    rest, missing ones too, as unfixable. ``duplicate_ids`` are ids that several rows have. The score
    is half the share of valid geometry and a quarter each the shares of given times and of rows
    less repeated ids, in per cent; HIGH from 90, MEDIUM from 70. A null dataset is one of its own.
    """
    ids = rows.where(F.col(record).isNotNull() & (F.col(record) != "")).groupBy(dataset, record).agg(F.count("*").alias("_n")).where("_n > 1")
    ids = ids.groupBy(F.col(dataset).alias("_d")).agg(F.count("*").alias("duplicate_ids"))
    g = rows.groupBy(dataset).agg(
        F.count("*").alias("total"), F.count_if(F.col(outcome).isin("OK", "REPAIRED")).alias("valid_geometry"), F.count_if(F.col(outcome) == "EMPTY").alias("empty"),
        F.count_if(F.col(captured).isNull() | (F.col(captured) == "")).alias("no_time"),
    )
    g = g.join(ids, F.col(dataset).eqNullSafe(F.col("_d")), "left").drop("_d").na.fill(0, ["duplicate_ids"])
    pct = lambda c: 100 * c / F.col("total")
    g = step(g, _score=0.5 * pct(F.col("valid_geometry")) + 0.25 * pct(F.col("total") - F.col("no_time")) + 0.25 * pct(F.col("total") - F.col("duplicate_ids")))
    level = F.when(F.col("_score") >= 90, "HIGH").when(F.col("_score") >= 70, "MEDIUM").otherwise("LOW")
    return g.select(
        dataset, "total", "valid_geometry", "empty", (F.col("total") - F.col("valid_geometry") - F.col("empty")).alias("unfixable"), "no_time", "duplicate_ids", F.round("_score", 1).alias("score"), level.alias("level")
    )


def outliers(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, low, high, outliers) by three times the distance of the quarter values, taken by index; groups of four and more.

    The quarter values come from counts of distinct values laid out by range: a value's rank is its
    rank within its part and what the parts of its group before it hold, so a group of any size is
    ranked in many tasks.
    """
    from pyspark.sql.window import Window

    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("c"))
    # Written, so that a value keeps its part.
    laid = Stage(rows.sparkSession).write(counts.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "g", "v").withColumn("part", F.spark_partition_id()))
    parts = laid.groupBy("g", "part").agg(F.sum("c").alias("in_part"))
    w = Window.partitionBy("g")
    parts = parts.withColumn("before", F.coalesce(F.sum("in_part").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("in_part").over(w)).where("n >= 4")
    local = laid.withColumn("upto", F.sum("c").over(Window.partitionBy("g", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    c = local.join(parts.select(F.col("g").alias("g2"), F.col("part").alias("part2"), "before", "n"), F.col("g").eqNullSafe(F.col("g2")) & (F.col("part") == F.col("part2"))).withColumn("upto", F.col("upto") + F.col("before"))
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col("v")))
    q = c.groupBy("g").agg(F.first("n").alias("n"), at(F.floor(F.col("n") / 4)).alias("q1"), at(F.floor(3 * F.col("n") / 4)).alias("q3"))
    q = q.withColumn("low", F.col("q1") - 3 * (F.col("q3") - F.col("q1"))).withColumn("high", F.col("q3") + 3 * (F.col("q3") - F.col("q1")))
    bounds = q.select(F.col("g").alias("g2"), "low", "high")
    out = laid.join(bounds, F.col("g").eqNullSafe(F.col("g2"))).where((F.col("v") < F.col("low")) | (F.col("v") > F.col("high"))).groupBy("g").agg(F.sum("c").alias("outliers")).withColumnRenamed("g", "g2")
    return q.join(out, F.col("g").eqNullSafe(F.col("g2")), "left").select(F.col("g").alias(group), "n", F.round("low", 3).alias("low"), F.round("high", 3).alias("high"), F.coalesce("outliers", F.lit(0)).alias("outliers"))
