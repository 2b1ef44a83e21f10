"""Training that leaves its artefacts behind, and scoring of new months from them."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators.models import Features, TreeConfig, fit, load, score
from panelcast.plans import features as plans
from panelcast.plans.training import TrainingResult
from panelcast.sources import sinks


def train_and_store(spark: SparkSession, panel: DataFrame, feats: Features, cfg: TreeConfig, registry: str, version: str,
                    features: plans.FeatureConfig = plans.FeatureConfig(), at: datetime | None = None) -> None:
    """Fit on the baseline features of ``panel``; store the model with its feature list and trend start, and promote it.

    ``at`` is the time of promotion, by default now.  The promotion fails if another version became champion
    while this one was trained.
    """
    over = sinks.champion_version(spark, registry)
    start = panel.agg(F.min(features.series.date)).first()[0]
    rows = plans.sentinel_fill(plans.monthly_features(panel, feats.label, features, F.lit(start)), keep=[feats.label])
    path = sinks.save_model_version(fit(rows, feats, cfg), registry, version)
    frozen = {"numeric": list(feats.numeric), "categorical": list(feats.categorical), "label": feats.label, "start": str(start)}
    spark.range(1).select(F.lit(json.dumps(frozen)).alias("value")).write.mode("overwrite").text(f"{path}_features")
    sinks.promote(spark, registry, version, over, (at or datetime.now(UTC)).strftime("%Y-%m-%d %H:%M:%S.%f"), path)


def score_new(spark: SparkSession, history: DataFrame, new: DataFrame, registry: str,
              features: plans.FeatureConfig = plans.FeatureConfig()) -> DataFrame:
    """Predictions of the current champion for the rows of ``new``.

    Lags and windows look back into ``history``, the months known when scoring; feature list, category
    index and the start of the trend are those of the training run.
    """
    champion = sinks.current_champion(spark, registry).first()
    frozen = json.loads(spark.read.text(f"{champion['path']}_features").first()[0])
    both = history.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
    rows = plans.monthly_features(both, frozen["label"], features, F.lit(frozen["start"]).cast("date"))
    rows = plans.sentinel_fill(rows.where("_new").drop("_new"), keep=[frozen["label"]])
    return score(load(spark, champion["path"]), rows).withColumn("version", F.lit(champion["version"]))


#: Tables a stored run leaves.
RUN_TABLES = ("predictions", "metrics", "baseline", "drift", "drift_summary", "alerts", "decision")


def store_run(result: TrainingResult, folder: str, version: str) -> None:
    """All tables of a training run, one folder a table, under the run's version."""
    tables = {
        "predictions": result.predictions, "metrics": result.metrics, "baseline": result.baseline, "drift": result.drift,
        "drift_summary": result.drift_summary, "alerts": result.alerts, "decision": result.decision,
    }
    sinks.save_model_version(result.model, folder, version)
    for name, df in tables.items():
        if df is not None:
            df.write.mode("overwrite").parquet(f"{folder}/{name}/version={version}")
