"""Queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landweave.llm import abuse, components, entities, names, packing, tokens
from landweave.session import Stage
from landweave.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return components.match_groups(table(spark, folder, "match_pair"))


def p1_group_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Number of groups and records by size of group."""
    sizes = p1_found(spark, folder).groupBy("group_id").agg(F.count("*").alias("records"))
    return sizes.groupBy("records").agg(F.count("*").alias("groups"))


def p2_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Parcel, rule and confidence of every record that describes a parcel, named by one already or not."""
    return entities.match(table(spark, folder, "source_record"), table(spark, folder, "canonical_parcel"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_matches(spark, folder).where(~F.col("is_labelled")).select("canonical_id", "record_id")


def _owner_names(spark: SparkSession, folder: str) -> DataFrame:
    results = table(spark, folder, "name_match_result")
    return (
        table(spark, folder, "canonical_parcel").select("village_code", F.col("owner_reference").alias("name"))
        .union(results.select("village_code", F.explode(F.array("name_a", "name_b")))).select(F.col("village_code").alias("village"), "name").distinct()
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    found = names.owner_pairs(names.owner_groups(_owner_names(spark, folder)))
    return found.withColumnRenamed("village", "village_code")


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Spellings of each owner of each village."""
    groups = names.owner_groups(_owner_names(spark, folder))
    return groups.groupBy("village", "group_id").agg(F.sort_array(F.collect_list("name")).alias("spellings"))


#: Tokens that a container of problem 9 holds.
CONTAINER_TOKENS = 2048


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_texts(table(spark, folder, "documents"))


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every part of every document with its container."""
    counts = Stage(spark).write(tokens.token_counts(table(spark, folder, "documents")))
    return packing.fill(counts, "doc_id", "n_tokens", CONTAINER_TOKENS)


def p9_unused(spark: SparkSession, folder: str) -> DataFrame:
    """Number of containers and the share of their space that is unused."""
    return packing.fill_of(p9_containers(spark, folder), CONTAINER_TOKENS)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_scores(spark, folder).where(F.col("score") >= abuse.THRESHOLD).select("doc_id")


def p10_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Score of every document."""
    return abuse.scores(table(spark, folder, "documents"))


def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Rate of each source."""
    return abuse.rates(p10_scores(spark, folder))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_group_sizes": p1_group_sizes,
    "p2_found": p2_found,
    "p2_matches": p2_matches,
    "p4_found": p4_found,
    "p4_groups": p4_groups,
    "p8_ids": p8_ids,
    "p9_containers": p9_containers,
    "p9_unused": p9_unused,
    "p10_found": p10_found,
    "p10_scores": p10_scores,
    "p10_rates": p10_rates,
}
