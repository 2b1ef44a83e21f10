"""Regressions on trees: fit, score, cross-validation, search and their variants.

Boosters of both families come from ``boosting``, which fits all models of a call together; random forests are
MLlib's.  Only split choices, metrics, importances and fold numbers reach the driver.
"""

from __future__ import annotations

import itertools
import json
import random
from collections.abc import Mapping, Sequence
from dataclasses import asdict, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions import metrics as m
from panelcast.functions.text import feature_family
from panelcast.operators.boosting import BoostedModel, Features, Job, TreeConfig, fit_all, median_pruner, scored
from panelcast.operators.evaluate import metrics_by
from panelcast.session import cut_lineage, shared_dir

__all__ = ["BoostedModel", "Features", "Model", "TreeConfig"]

Model = BoostedModel | PipelineModel

#: Default search space, the settings of the boosters.
SEARCH_SPACE: Mapping[str, Sequence[float]] = {
    "max_depth": (3, 4, 5, 6),
    "step_size": (0.03, 0.05, 0.07),
    "subsample": (0.7, 0.9, 1.0),
    "feature_share": (0.7, 0.9, 1.0),
    "min_child_weight": (1, 3, 5),
    "min_gain": (0.0, 0.3),
    "l1": (0.0, 0.1, 0.3),
    "l2": (0.5, 1.0, 1.5),
}


def _forest(train: DataFrame, feats: Features, cfg: TreeConfig) -> PipelineModel:
    shared_dir(train.sparkSession)
    stages = [StringIndexer(inputCol=c, outputCol=f"{c}_idx", handleInvalid="keep", stringOrderType="alphabetAsc")
              for c in feats.categorical]
    inputs = [*feats.numeric, *[f"{c}_idx" for c in feats.categorical]]
    learner = RandomForestRegressor(
        featuresCol="features", labelCol=feats.label, maxDepth=cfg.max_depth, maxBins=cfg.max_bins, seed=cfg.seed, subsamplingRate=cfg.subsample,
        featureSubsetStrategy=str(cfg.feature_share), numTrees=cfg.max_iter, bootstrap=cfg.bootstrap,
    )
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=inputs, outputCol="features"), learner]).fit(train)


def _rows(train: DataFrame, val: DataFrame | None) -> DataFrame:
    rows = train.drop("role").withColumn("role", F.lit("train"))
    return rows if val is None else rows.unionByName(val.drop("role").withColumn("role", F.lit("val")))


def _fitted(model: BoostedModel | None) -> BoostedModel:
    if model is None:
        raise ValueError("there are no training rows")
    return model


def fit(train: DataFrame, feats: Features, cfg: TreeConfig = TreeConfig(), val: DataFrame | None = None) -> Model:
    """One model; with ``val`` a booster stops after ``patience`` rounds without a better error and keeps its best round."""
    if cfg.kind == "forest":
        return _forest(train, feats, cfg)
    return _fitted(fit_all(_rows(train, val), [Job(cfg, feats)])[0])


def n_trees(model: Model) -> int:
    """Boosting rounds kept, or trees of a forest."""
    return len(model.trees) if isinstance(model, BoostedModel) else model.stages[-1].getNumTrees


def save(model: Model, spark: SparkSession, path: str) -> None:
    """Write a model of either kind; an existing one at ``path`` is replaced."""
    if isinstance(model, BoostedModel):
        model.save(spark, path)
    else:
        model.write().overwrite().save(path)


def load(spark: SparkSession, path: str) -> Model:
    """The model at ``path``, whichever kind its metadata name."""
    kind = json.loads(spark.read.text(f"{path}/metadata").first()[0])["class"]
    return BoostedModel.load(spark, path) if kind == "panelcast.boosted" else PipelineModel.load(path)


def score(model: Model, df: DataFrame, label: str | None = None) -> DataFrame:
    """Prediction and, with a label, residual, absolute and relative error."""
    keep = [*df.columns, "prediction"]
    out = model.transform(df).select(*keep)
    if label is None:
        return out
    residual = F.col(label) - F.col("prediction")
    return out.withColumns(
        {"residual": residual, "abs_error": F.abs(residual), "rel_error": F.try_divide(F.abs(residual), F.abs(F.col(label)))}
    )


def _fold_ids(folds: DataFrame) -> list[int]:
    return sorted(r["fold"] for r in folds.select("fold").distinct().collect())


def _out_of_fold(folds: DataFrame, candidates: Sequence[tuple[TreeConfig, Features]], keys: Sequence[str], watch: bool,
                 prune_from: int | None = None) -> DataFrame:
    """Predictions (fold, keys, y, model, prediction) for the validation rows of every fold by every candidate.

    All boosters of all folds are fitted in one run.  Without ``watch`` no fit sees a validation row.
    """
    ids = _fold_ids(folds)
    label = candidates[0][1].label
    columns = ["fold", *keys, F.col(f"`{label}`").alias("y")]
    val = folds.where("role = 'val'")
    boosted = [(i, cfg, feats) for i, (cfg, feats) in enumerate(candidates) if cfg.kind != "forest"]
    parts = []
    if boosted:
        rows = folds.withColumn("_group", F.col("fold").cast("int"))
        jobs = [Job(cfg, feats, f) for _, cfg, feats in boosted for f in ids]
        prune = median_pruner(len(ids), prune_from) if watch and prune_from else None
        models = fit_all(rows if watch else rows.where("role = 'train'"), jobs, prune)
        numbered = [(i, f) for i, _, _ in boosted for f in ids]
        parts.append(scored(val, [(i, f, x) for (i, f), x in zip(numbered, models, strict=True) if x], "fold", columns))
    for i, (cfg, feats) in enumerate(candidates):
        for f in ids if cfg.kind == "forest" else ():
            one = folds.where(F.col("fold") == f)
            model = _forest(one.where("role = 'train'"), feats, cfg)
            parts.append(score(model, one.where("role = 'val'")).select(*columns, F.lit(i).alias("model"), "prediction"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cross_validate(folds: DataFrame, feats: Features, cfg: TreeConfig = TreeConfig(), keys: Sequence[str] = (), stored: bool = False,
                   watch: bool = False) -> DataFrame:
    """Out-of-fold predictions (fold, keys, y, prediction) over a feature table carrying (fold, role).

    No fit sees a validation row, so all rounds are kept, unless ``watch`` lets it stop by those of its fold.  The
    table is written once unless ``stored`` says it is.
    """
    return _out_of_fold(folds if stored else cut_lineage(folds), [(cfg, feats)], keys, watch).drop("model")


def fold_metrics(oof: DataFrame) -> DataFrame:
    return metrics_by(oof, ["fold"], "y", "prediction")


def sample_candidates(n: int, space: Mapping[str, Sequence[float]] = SEARCH_SPACE, base: TreeConfig = TreeConfig(),
                      seed: int = 42) -> list[TreeConfig]:
    """n distinct random settings (or all of them), reproducible by seed."""
    names = list(space)
    grid = list(itertools.product(*space.values()))
    picked = random.Random(seed).sample(grid, min(n, len(grid)))
    return [replace(base, **dict(zip(names, values))) for values in picked]


def grid_candidates(space: Mapping[str, Sequence[float]] = SEARCH_SPACE, base: TreeConfig = TreeConfig()) -> list[TreeConfig]:
    """Every combination of the settings."""
    return [replace(base, **dict(zip(space, values))) for values in itertools.product(*space.values())]


def _trials(spark: SparkSession, settings: Sequence[dict]) -> DataFrame:
    """The settings as a table with their number in ``trial``."""
    columns = ", ".join(f"{k} {'string' if isinstance(v, str) else 'boolean' if isinstance(v, bool) else 'bigint' if all(isinstance(s[k], int) for s in settings) else 'double'}" for k, v in settings[0].items())
    whole = {k for k in settings[0] if all(isinstance(s[k], int | str) for s in settings)}
    rows = [(i, *(v if k in whole else float(v) for k, v in s.items())) for i, s in enumerate(settings)]
    return spark.createDataFrame(rows, f"trial bigint, {columns}")


def search(train: DataFrame, val: DataFrame, feats: Features, candidates: Sequence[TreeConfig]) -> DataFrame:
    """Trial table: settings, validation metrics and kept rounds, one row per candidate; all are fitted in one run."""
    rows = cut_lineage(_rows(train, val))
    spark = rows.sparkSession
    models = [_fitted(x) for x in fit_all(rows, [Job(cfg, feats) for cfg in candidates])]
    seen = rows.where("role = 'val'").withColumn("_one", F.lit(0))
    predictions = scored(seen, [(i, 0, x) for i, x in enumerate(models)], "_one", [F.col(f"`{feats.label}`").alias("y")])
    got = predictions.groupBy(F.col("model").cast("bigint").alias("trial")).agg(
        m.mae("y", "prediction").alias("val_mae"), m.rmse("y", "prediction").alias("val_rmse"), m.r2("y", "prediction").alias("val_r2")
    )
    table = _trials(spark, [{**asdict(cfg), "best_iteration": n_trees(x)} for cfg, x in zip(candidates, models, strict=True)])
    return table.join(got, "trial")


def search_folds(folds: DataFrame, feats: Features, candidates: Sequence[TreeConfig | tuple[TreeConfig, Features]], watch: bool = False,
                 prune_from: int | None = None) -> DataFrame:
    """Trial table over time-ordered folds: mean and deviation of the folds' validation metrics, one row per candidate.

    A candidate is a setting, or a setting with a feature list of its own.  All candidates and folds are fitted in
    one run; ``watch`` lets a fit stop early by the validation rows of its fold, and ``prune_from`` ends candidates
    that are, from that round on, worse than the median of all at the same round.
    """
    folds = cut_lineage(folds)
    pairs = [c if isinstance(c, tuple) else (c, feats) for c in candidates]
    oof = _out_of_fold(folds, pairs, (), watch, prune_from)
    got = metrics_by(oof, ["model", "fold"], "y", "prediction").groupBy(F.col("model").cast("bigint").alias("trial")).agg(
        F.avg("mae").alias("val_mae"), F.stddev_samp("mae").alias("val_mae_std"), F.avg("rmse").alias("val_rmse"),
        F.avg("r2").alias("val_r2"), F.count(F.lit(1)).alias("n_folds"),
    )
    return _trials(folds.sparkSession, [{**asdict(cfg), "features": ",".join([*own.numeric, *own.categorical])} for cfg, own in pairs]).join(got, "trial")


def refit(train: DataFrame, val: DataFrame, feats: Features, cfg: TreeConfig, best_iteration: int) -> Model:
    """Final fit on train and validation rows with a tenth more rounds than the search kept."""
    return fit(train.unionByName(val), feats, replace(cfg, max_iter=max(1, round(best_iteration * 1.1))))


def importance(model: Model, feats: Features, df: DataFrame, top_n: int = 15) -> DataFrame:
    """Largest feature importances (share of the total gain) with the family each feature belongs to."""
    names = [*feats.numeric, *feats.categorical]
    if isinstance(model, BoostedModel):
        gains = model.gains()
        rows = [(n, gains.get(n, 0.0)) for n in names]
    else:
        rows = list(zip(names, [float(v) for v in model.stages[-1].featureImportances.toArray()]))
    table = df.sparkSession.createDataFrame(rows, "feature string, importance double")
    return table.withColumn("family", feature_family("feature")).orderBy(F.desc("importance"), "feature").limit(top_n)


def importance_by_family(table: DataFrame) -> DataFrame:
    return table.groupBy("family").agg(F.sum("importance").alias("importance"), F.count(F.lit(1)).alias("n_features"))


def ablation(folds: DataFrame, feats: Features, families: Mapping[str, Sequence[str]], cfg: TreeConfig = TreeConfig(),
             min_gain: float = 2.0) -> DataFrame:
    """Drop one family at a time; a family is kept when leaving it out costs at least ``min_gain`` MAE.

    The full feature list and all reduced ones are fitted on all folds in one run.
    """
    sets = {"none": feats} | {name: feats.without(cols) for name, cols in families.items()}
    oof = _out_of_fold(cut_lineage(folds), [(cfg, own) for own in sets.values()], (), False)
    got = {r["model"]: r["mae"] for r in oof.groupBy("model").agg(m.mae("y", "prediction").alias("mae")).collect()}
    maes = {name: got[i] for i, name in enumerate(sets)}
    rows = [(n, v, v - maes["none"], bool(v - maes["none"] >= min_gain)) for n, v in maes.items() if n != "none"]
    return folds.sparkSession.createDataFrame(rows, "dropped_family string, mae double, mae_increase double, keep boolean")


def residual_booster(train: DataFrame, test: DataFrame, feats: Features, base: TreeConfig, booster: TreeConfig,
                     train_only: Column | None = None, val: DataFrame | None = None) -> DataFrame:
    """Second model on the residuals of the first; ``train_only`` limits the rows the second one learns from.

    ``val`` tells both when to stop.
    """
    first = fit(train, feats, base, val)
    learned, watched = (None if df is None else score(first, df, feats.label).withColumnRenamed("prediction", "base_pred") for df in (train, val))
    if train_only is not None:
        learned = learned.where(train_only)
    second_feats = Features((*feats.numeric, "base_pred"), "residual", feats.categorical)
    second = fit(learned, second_feats, booster, watched)
    found = score(first, test).withColumnRenamed("prediction", "base_pred")
    out = score(second, found).withColumnRenamed("prediction", "residual_pred")
    out = out.withColumn("boosted_pred", F.col("base_pred") + F.col("residual_pred"))
    y = F.col(feats.label)
    return out.withColumns({"ae_base": F.abs(y - F.col("base_pred")), "ae_boosted": F.abs(y - F.col("boosted_pred"))})


def routed(train: DataFrame, test: DataFrame, feats: Features, high: Column, special: TreeConfig, general: TreeConfig,
           val: DataFrame | None = None) -> DataFrame:
    """High-volume rows scored by a model trained on them alone, all others by the general model.

    Both models are fitted in one run: high-volume rows stand in two groups.  ``val`` tells them when to stop.
    """
    if "forest" in (special.kind, general.kind):
        models = [fit(train.where(high), feats, special), fit(train, feats, general)]
    else:
        groups = F.explode(F.when(high, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1))))
        rows = _rows(train, val).withColumn("_group", groups)
        models = [_fitted(x) for x in fit_all(rows, [Job(special, feats, 0), Job(general, feats, 1)])]
    a = score(models[0], test.where(high), feats.label).withColumn("route", F.lit("high_volume"))
    b = score(models[1], test.where(~high), feats.label).withColumn("route", F.lit("general"))
    return a.unionByName(b)
