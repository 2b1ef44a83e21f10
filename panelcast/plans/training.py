"""The batch training and monitoring job: clean -> features -> split -> fit -> evaluate -> monitor -> decide."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators import evaluate, monitor
from panelcast.operators.models import Features, Model, TreeConfig, fit, score
from panelcast.operators.quality import feature_list, require_training_input
from panelcast.operators.ranking import keep_first
from panelcast.operators.splits import positional_split
from panelcast.session import cut_lineage


@dataclass(frozen=True)
class TrainingConfig:
    target: str
    date: str = "month_date"
    ids: tuple[str, ...] = ("state", "district")
    val_fraction: float = 0.2
    min_rows: int = 100
    min_months: int = 3
    components: tuple[str, ...] = ()
    lag: str | None = None
    drift_features: tuple[str, ...] = ()
    tree: TreeConfig = field(default_factory=TreeConfig)


@dataclass(frozen=True)
class TrainingData:
    split: DataFrame
    feats: Features


@dataclass(frozen=True)
class TrainingResult:
    model: Model
    feats: Features
    predictions: DataFrame
    metrics: DataFrame
    baseline: DataFrame | None
    drift: DataFrame
    drift_summary: DataFrame
    alerts: DataFrame
    decision: DataFrame


def training_data(df: DataFrame, cfg: TrainingConfig) -> TrainingData:
    """One row per (date, ids), checked input, explicit feature list, chronological split."""
    others = sorted(c for c in df.columns if c not in (cfg.date, *cfg.ids))
    unique = keep_first(df, [cfg.date, *cfg.ids], others)
    require_training_input(unique, cfg.target, cfg.date, cfg.min_months)
    numeric, categorical = feature_list(unique, cfg.target, cfg.date, cfg.ids, components=cfg.components)
    complete = unique.dropna(subset=numeric)
    split = positional_split(complete, [cfg.date, *cfg.ids], cfg.val_fraction, cfg.min_rows)
    return TrainingData(split, Features(tuple(numeric), cfg.target, tuple(categorical)))


def train(df: DataFrame, cfg: TrainingConfig, drift_features: Sequence[str] = ()) -> TrainingResult:
    """The whole run.  The split table is checkpointed once; every later step reads it."""
    data = training_data(df, cfg)
    split = cut_lineage(data.split)
    model = fit(split.where("split = 'train'"), data.feats, cfg.tree, split.where("split = 'val'"))
    scored = score(model, split, cfg.target)
    val = scored.where("split = 'val'").withColumn("y", F.col(cfg.target).cast("double"))
    metrics = evaluate.metrics_by(val, [], "y", "prediction")
    naive = evaluate.baseline_comparison(val, "y", "prediction", cfg.lag) if cfg.lag else None
    monitored = list(drift_features or cfg.drift_features or [cfg.target])
    report = monitor.drift_flags(monitor.drift_stats(split, cfg.date, monitored))
    summary = monitor.drift_summary(report)
    raised = monitor.alerts(val, [*cfg.ids, cfg.date], "y", "prediction", cfg.lag)
    before = evaluate.metrics_by(val, [], "y", cfg.lag) if cfg.lag else metrics
    decision = monitor.retrain_decision(metrics, before, summary)
    return TrainingResult(model, data.feats, scored, metrics, naive, report, summary, raised, decision)
