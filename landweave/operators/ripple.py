"""Ripple checks: what a proposed outline does to neighbours, buildings, utilities, administrative boundaries and roads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landweave.config import RIPPLE_LEAST

#: Severities that block an approval.
BLOCKING = ("CRITICAL", "HIGH")
_ISSUE = ("issue", "severity", "amount")


def _issue(when: Column, issue: str, severity: Column, amount: Column) -> Column:
    return F.when(when, F.struct(F.lit(issue).alias(_ISSUE[0]), severity.alias(_ISSUE[1]), amount.cast("double").alias(_ISSUE[2])))


def neighbor(increase_sqm: Column) -> Column:
    """Overlap with a neighbour that the proposed outline adds to the original's."""
    severity = F.when(increase_sqm > RIPPLE_LEAST["neighbor_critical_sqm"], "CRITICAL").otherwise("HIGH")
    return _issue(increase_sqm > RIPPLE_LEAST["neighbor_sqm"], "NEIGHBOR_OVERLAP", severity, increase_sqm)


def building(outside_sqm: Column) -> Column:
    """Area of a building outside the proposed outline."""
    return _issue(outside_sqm > RIPPLE_LEAST["building_sqm"], "BUILDING_OUTSIDE", F.lit("HIGH"), outside_sqm)


def utility(new_m: Column, old_m: Column) -> Column:
    """Metres of a utility line on the proposed outline where it did not run on the original; a mere crossing has none."""
    return _issue((new_m > RIPPLE_LEAST["line_m"]) & (old_m < RIPPLE_LEAST["line_m"]), "UTILITY_RUN", F.lit("MEDIUM"), new_m)


def boundary(inside_m: Column) -> Column:
    """Metres of an administrative boundary within the proposed outline."""
    return _issue(inside_m > RIPPLE_LEAST["line_m"], "ADMIN_BOUNDARY", F.lit("HIGH"), inside_m)


def road(overlap_sqm: Column) -> Column:
    """Area of a road's right of way within the proposed outline."""
    return _issue(overlap_sqm > RIPPLE_LEAST["road_sqm"], "ROAD_OVERLAP", F.lit("CRITICAL"), overlap_sqm)


def found(rows: DataFrame, parcel: str, feature: str, issue: Column) -> DataFrame:
    """(parcel_id, feature_id, issue, severity, amount) of the rows that have an issue."""
    return rows.select(F.col(parcel).alias("parcel_id"), F.col(feature).alias("feature_id"), F.inline(F.array_compact(F.array(issue))))


def by_parcel(issues: DataFrame) -> DataFrame:
    """(parcel_id, critical_ripple, other_ripple, blocking, gravest): counts of a parcel's issues and the gravest that blocks."""
    blocks = F.col("severity").isin(*BLOCKING)
    text = F.when(blocks, F.struct((F.col("severity") != "CRITICAL").alias("later"), F.concat_ws(" ", "severity", "issue", "feature_id").alias("text")))
    return issues.groupBy("parcel_id").agg(
        F.count_if(F.col("severity") == "CRITICAL").alias("critical_ripple"), F.count_if(F.col("severity") != "CRITICAL").alias("other_ripple"), F.count_if(blocks).alias("blocking"), F.min(text)["text"].alias("gravest")
    )


def summary(issues: DataFrame) -> DataFrame:
    """Issues by kind with the number that block approval."""
    return issues.groupBy("issue").agg(F.count("*").alias("issues"), F.count_if(F.col("severity").isin(*BLOCKING)).alias("blocking"))


def override(proposals: DataFrame, issues: DataFrame) -> DataFrame:
    """Proposals (parcel_id, status) with their issue counts; one that was approved by itself and has a blocking issue goes to review."""
    p = proposals.join(by_parcel(issues), "parcel_id", "left").na.fill(0, ["critical_ripple", "other_ripple", "blocking"])
    return p.withColumn("status", F.when((F.col("status") == "AUTO_APPROVED") & (F.col("blocking") > 0), "REVIEW_REQUIRED").otherwise(F.col("status")))
