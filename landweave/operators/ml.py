"""Re-ranking of matched pairs by gradient-boosted trees: features, training with calibration and metrics, storage, contributions and fallback."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landweave.operators.matching import source_weight

#: Names of the features, in order.
FEATURES = (
    "iou", "hausdorff_norm", "area_ratio_diff", "centroid_dist_norm", "identifier_score", "owner_similarity", "land_use_match", "ward_match", "temporal_gap_norm", "independent_lineages", "source_quality_diff",
)
#: Generated training pairs; a fixed number, independent of the data.
TRAINING_PAIRS = 4000
#: Share of the learned score in the final one.
LEARNED_SHARE = 0.6
_models: dict[tuple, "Model"] = {}


@dataclass
class Model:
    """Fitted trees, the calibration of their score, and what is known about both."""

    trees: Any
    platt: tuple[float, float]
    info: dict


def features(pairs: DataFrame) -> dict[str, Column]:
    """The eleven features of scored pairs, each within its range; what is missing has its default, and a similarity of 0 counts as missing."""
    c = F.col
    have = lambda n, default: F.coalesce(c(n).cast("double"), F.lit(default)) if n in pairs.columns else F.lit(default)
    clip = lambda x, top=1.0: F.greatest(F.lit(0.0), F.least(F.lit(top), x))
    owner = have("owner_similarity", 0.5)
    gap = F.coalesce(F.abs(F.datediff("a_capture_date", "b_capture_date")).cast("double"), F.lit(0.0))
    return {
        "iou": clip(have("iou", 0.0)), "hausdorff_norm": clip(have("hausdorff_m", 0.0) / 500), "area_ratio_diff": clip(have("area_diff", 0.0)), "centroid_dist_norm": clip(have("centroid_m", 0.0) / 500),
        "identifier_score": clip(have("score_identifier", 0.0)), "owner_similarity": clip(F.when(owner == 0, 0.5).otherwise(owner)), "land_use_match": have("land_use_match", 0.0), "ward_match": have("ward_match", 0.0),
        "temporal_gap_norm": clip(gap / 3650), "independent_lineages": clip(have("lineages", 0.0), 5.0), "source_quality_diff": clip(F.abs(source_weight(c("a_source_type")) - source_weight(c("b_source_type")))),
    }


def training(session: SparkSession, n: int = TRAINING_PAIRS, seed: int = 7) -> DataFrame:
    """Labelled feature rows: half of one parcel with small differences, half of two."""
    r = lambda k: F.rand(seed + k)
    d = session.range(n, numPartitions=1).withColumn("label", (F.col("id") % 2).cast("double"))
    same = F.col("label") == 1
    pick = lambda yes, no: F.when(same, yes).otherwise(no)
    often = lambda k, p, q: pick((r(k) < p).cast("double"), (r(k) < q).cast("double"))
    return d.select(
        "id", "label", pick(0.6 + 0.4 * r(1), 0.7 * r(1)).alias("iou"), pick(0.02 * r(2), 0.01 + 0.5 * r(2)).alias("hausdorff_norm"), pick(0.1 * r(3), 0.6 * r(3)).alias("area_ratio_diff"),
        pick(0.02 * r(4), 0.01 + 0.5 * r(4)).alias("centroid_dist_norm"), pick(F.when(r(5) < 0.7, 1.0).otherwise(0.6), F.when(r(5) < 0.85, 0.0).otherwise(0.6)).alias("identifier_score"),
        pick(0.6 + 0.4 * r(6), 0.8 * r(6)).alias("owner_similarity"), often(7, 0.8, 0.35).alias("land_use_match"), often(8, 0.95, 0.5).alias("ward_match"), (0.8 * r(9)).alias("temporal_gap_norm"),
        F.floor(4 * r(10)).cast("double").alias("independent_lineages"), (0.3 * r(11)).alias("source_quality_diff"),
    )


def train(session: SparkSession, seed: int = 7) -> Model:
    """Trees fitted on four fifths of the generated pairs, calibrated and measured on the rest.

    The figures hold for generated pairs only; adjudicated pairs should take their place.
    """
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(training(session, seed=seed)).cache()
    fit, held = data.where("id % 10 < 8"), data.where("id % 10 >= 8")
    trees = GBTClassifier(maxIter=12, maxDepth=4, stepSize=0.2, seed=seed).fit(fit)
    scored = trees.transform(held).withColumn("margin", vector_to_array("rawPrediction")[1]).cache()
    sloped = LogisticRegression(featuresCol="m", regParam=0.01).fit(VectorAssembler(inputCols=["margin"], outputCol="m").transform(scored.select("label", "margin")))
    n = {(r["label"], r["prediction"]): r["count"] for r in scored.groupBy("label", "prediction").count().collect()}  # four rows
    hit, false, miss = n.get((1.0, 1.0), 0), n.get((0.0, 1.0), 0), n.get((1.0, 0.0), 0)
    precision, recall = hit / max(1, hit + false), hit / max(1, hit + miss)
    info = {
        "feature_names": list(FEATURES), "feature_importances": {f: round(float(v), 6) for f, v in zip(FEATURES, trees.featureImportances.toArray())},
        "metrics": {"precision": round(precision, 4), "recall": round(recall, 4), "f1": round(2 * precision * recall / max(1e-9, precision + recall), 4), "n_train": fit.count(), "n_val": sum(n.values())},
        "training_note": "generated pairs only",
    }
    data.unpersist()
    scored.unpersist()
    return Model(trees, (float(sloped.coefficients[0]), float(sloped.intercept)), info)


def save(model: Model, session: SparkSession, path: str) -> None:
    model.trees.write().overwrite().save(f"{path}/trees")
    session.createDataFrame([(json.dumps({"platt": model.platt, **model.info}),)], "info string").coalesce(1).write.mode("overwrite").text(f"{path}/info")


def load(session: SparkSession, path: str) -> Model | None:
    """The model saved at ``path``, or null where there is none."""
    from pyspark.errors import PySparkException
    from pyspark.ml.classification import GBTClassificationModel

    try:
        info = json.loads(session.read.text(f"{path}/info").first()[0])
        return Model(GBTClassificationModel.load(f"{path}/trees"), tuple(info.pop("platt")), info)
    except (PySparkException, ValueError, KeyError, TypeError):
        return None


def ensured(session: SparkSession, path: str | None = None) -> Model:
    """The model of this session: loaded from ``path`` if it is there, else trained once and saved."""
    key = (session.sparkContext.applicationId, path)
    if key not in _models:
        found = load(session, path) if path else None
        _models[key] = found or train(session)
        if path and not found:
            save(_models[key], session, path)
    return _models[key]


def rerank(pairs: DataFrame, model: Model | None) -> DataFrame:
    """(a_record_id, b_record_id, deterministic, learned, calibrated, final, strongest): 0.6 of the learned and 0.4 of the deterministic score.

    ``learned`` is the trees' own score, ``calibrated`` that after calibration. ``strongest`` has the four
    features of most weight, each importance times value less a half. Without a model the
    deterministic score stands for all and nothing is strongest.
    """
    c = F.col
    if model is None:
        none = F.array().cast("array<struct<name:string,contribution:double>>")
        return pairs.select("a_record_id", "b_record_id", *[c("overall").alias(n) for n in ("deterministic", "learned", "calibrated", "final")], none.alias("strongest"))
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    f = features(pairs)
    p = pairs.select("a_record_id", "b_record_id", "overall", *[f[n].alias(n) for n in FEATURES])
    scored = model.trees.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(p))
    slope, cut = model.platt
    scored = scored.withColumn("learned", vector_to_array("probability")[1]).withColumn("calibrated", 1 / (1 + F.exp(-(slope * vector_to_array("rawPrediction")[1] + cut))))
    weight = model.info["feature_importances"]
    parts = F.array(*[F.struct(F.lit(n).alias("name"), F.round(weight.get(n, 0.0) * (c(n) - 0.5), 4).alias("contribution")) for n in FEATURES])
    order = lambda x, y: F.when(F.abs(x["contribution"]) > F.abs(y["contribution"]), -1).when(F.abs(x["contribution"]) < F.abs(y["contribution"]), 1).otherwise(0)
    return scored.select(
        "a_record_id", "b_record_id", c("overall").alias("deterministic"), F.round("learned", 6).alias("learned"), F.round("calibrated", 6).alias("calibrated"),
        F.round(LEARNED_SHARE * c("learned") + (1 - LEARNED_SHARE) * c("overall"), 6).alias("final"), F.slice(F.array_sort(parts, order), 1, 4).alias("strongest"),
    )
