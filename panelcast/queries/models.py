"""Model jobs on the segment panel.  Predictions depend on the learner, so these carry no SQL unless noted."""

from __future__ import annotations

import functools
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.text import feature_family
from panelcast.operators import attribution, splits
from panelcast.operators import models as mod
from panelcast.operators.blend import fold_summary, rank_trials
from panelcast.operators.panel import model_dataset
from panelcast.operators.quality import feature_list
from panelcast.plans import features as plans
from panelcast.plans import scoring, training
from panelcast.queries import tables as t
from panelcast.queries.features import CONFIG
from panelcast.queries.registry import cte, joined, query, rounded
from panelcast.session import cut_lineage, scratch_path
from panelcast.sources import sinks

Y = "total_enrolment"
K = ["state", "district", "month_date"]
TREE = mod.TreeConfig()
FOREST = mod.TreeConfig(kind="forest")
CHAMPION = mod.TreeConfig(max_depth=5, step_size=0.05, subsample=0.8, feature_share=0.8, l1=0.2, l2=1.5)
LEAFWISE = mod.TreeConfig(kind="leafwise", max_depth=-1, max_leaves=64, max_iter=700, step_size=0.04, subsample=0.9, feature_share=0.9, min_child_weight=20)
#: Settings a search tries, drawn from the 81 of SEARCH_SPACE.
CANDIDATES = 10


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return plans.sentinel_fill(plans.monthly_features(cut_lineage(t.enrol_panel(spark, sf, True)), Y, CONFIG), keep=[Y])


def _feats(df: DataFrame) -> mod.Features:
    numeric, _ = feature_list(df, Y, "month_date", ids=("state", "district", "fold"))
    return mod.Features(tuple(numeric), Y, ("state",))


def _split(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, mod.Features]:
    df = _features(spark, sf)
    feats = _feats(df)
    rows = cut_lineage(splits.last_months_split(df, n_months=12))
    return rows.where("split = 'train'").drop("split"), rows.where("split = 'val'").drop("split"), feats


def _folds(spark: SparkSession, sf: str, n: int = 3) -> tuple[DataFrame, mod.Features]:
    df = cut_lineage(t.enrol_panel(spark, sf, True))
    table = splits.expanding_folds(df, n_folds=n, gap_months=1, min_train_months=12, val_months=2)
    rows = plans.fold_features(splits.assign_folds(df, table), Y, CONFIG, "full")
    return rows, _feats(rows.drop("role"))


def _last_months(df: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """All but the last months, and the last ones, which tell a fit when to stop."""
    rows = cut_lineage(splits.last_months_split(df, n_months=n))
    return rows.where("split = 'train'").drop("split"), rows.where("split = 'val'").drop("split")


@query("booster_forecast", "M1 M3 C3")
def _booster(spark: SparkSession, sf: str) -> DataFrame:
    train, val, feats = _split(spark, sf)
    model = mod.fit(train, feats, TREE, val)
    return rounded(mod.score(model, val, Y).select(*K, Y, "prediction", "residual", "abs_error"))


@query("cross_validated_predictions", "M4 D4 C4 U2")
def _oof(spark: SparkSession, sf: str) -> DataFrame:
    rows, feats = _folds(spark, sf)
    return rounded(mod.cross_validate(rows, feats, TREE, K))


@query("forest_cross_validation", "M2 M4 E1")
def _forest(spark: SparkSession, sf: str) -> DataFrame:
    rows, feats = _folds(spark, sf)
    return rounded(fold_summary(mod.fold_metrics(mod.cross_validate(rows, feats, FOREST, K))))


@query("leafwise_cross_validation", "M2 M4 E1")
def _leafwise(spark: SparkSession, sf: str) -> DataFrame:
    """The second booster family on the folds, each fit watched by its validation months."""
    rows, feats = _folds(spark, sf)
    return rounded(fold_summary(mod.fold_metrics(mod.cross_validate(rows, feats, LEAFWISE, K, watch=True))))


@query("parameter_search", "M5 T6")
def _search(spark: SparkSession, sf: str) -> DataFrame:
    rows, feats = _folds(spark, sf)
    trials = mod.search_folds(rows, feats, mod.sample_candidates(CANDIDATES), watch=True, prune_from=20)
    return rounded(rank_trials(trials, k=3))


@query("search_refit_forecast", "M5 U2")
def _refit(spark: SparkSession, sf: str) -> DataFrame:
    df = _features(spark, sf)
    feats = _feats(df)
    tune, test = splits.holdout_months(cut_lineage(df), 2)
    train, val = (splits.last_months_split(tune, n_months=6).where(F.col("split") == s).drop("split") for s in ("train", "val"))
    candidates = mod.sample_candidates(CANDIDATES)
    best = rank_trials(mod.search(train, val, feats, candidates), k=1).first()
    model = mod.refit(train, val, feats, candidates[best["trial"]], best["best_iteration"])
    return rounded(mod.score(model, test, Y).select(*K, Y, "prediction", "abs_error"))


@query("feature_importance", "M7 F16")
def _importance(spark: SparkSession, sf: str) -> DataFrame:
    train, val, feats = _split(spark, sf)
    return rounded(mod.importance(mod.fit(train, feats, TREE, val), feats, train, 20))


@query("importance_by_family", "M7 F16")
def _family(spark: SparkSession, sf: str) -> DataFrame:
    train, val, feats = _split(spark, sf)
    table = mod.importance(mod.fit(train, feats, TREE, val), feats, train, len(feats.numeric) + 1)
    return rounded(mod.importance_by_family(table))


@query("attribution_by_family", "M7 F16")
def _attribution(spark: SparkSession, sf: str) -> DataFrame:
    """What each family of features adds to every forecast of the validation year."""
    train, val, feats = _split(spark, sf)
    model = mod.fit(train, feats, TREE, val)
    return rounded(attribution.by_family(attribution.contributions(model, val, K), K))


@query("family_ablation", "M8")
def _ablation(spark: SparkSession, sf: str) -> DataFrame:
    rows, feats = _folds(spark, sf)
    families = {"lag": [c for c in feats.numeric if "_lag_" in c], "rolling": [c for c in feats.numeric if "_rolling_" in c]}
    return rounded(mod.ablation(rows, feats, families, TREE, min_gain=0.01))


@query("residual_booster", "M9 W23")
def _residual(spark: SparkSession, sf: str) -> DataFrame:
    train, test, feats = _split(spark, sf)
    learn, watch = _last_months(train, 3)
    out = mod.residual_booster(learn, test, feats, TREE, TREE, F.col(Y) >= 2, watch)
    return rounded(out.select(*K, F.col(Y).alias("y_true"), "base_pred", "residual_pred", "boosted_pred", "ae_base", "ae_boosted"))


@query("segment_routing", "M10")
def _routing(spark: SparkSession, sf: str) -> DataFrame:
    train, test, feats = _split(spark, sf)
    learn, watch = _last_months(train, 3)
    high = F.col(f"{Y}_rolling_6_mean") >= learn.agg(F.avg(f"{Y}_rolling_6_mean")).first()[0]
    return rounded(mod.routed(learn, test, feats, high, TREE, TREE, watch).select(*K, Y, "prediction", "route"))


# Stumps: one round, depth one, no sampling, on features with fewer values than bins.  The split with the
# largest fall of the squared error and the two leaf means are plain SQL, so every prediction is checked.
STUMP = mod.TreeConfig(max_depth=1, max_iter=1, step_size=1.0, subsample=1.0, feature_share=1.0, l2=0.0, max_bins=1024)
_F = ("month", "year")


def _stump(name: str, rows: str, feats: tuple[str, ...] = _F, y: str = "y", by: str = "0") -> str:
    """CTEs that leave the best split of ``rows`` in ``name``: by group, feature f, threshold and the leaf means."""
    each = " UNION ALL ".join(f"SELECT {by} AS g, '{f}' AS f, {i} AS o, CAST({f} AS DOUBLE) AS v, CAST({y} AS DOUBLE) AS t FROM {rows}" for i, f in enumerate(feats))
    return f"""{name}_c AS (SELECT g, f, o, v, count(*) AS n, sum(t) AS s FROM ({each}) GROUP BY ALL),
{name}_p AS (SELECT g, f, o, v, lead(v) OVER w AS nv, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER (PARTITION BY g, f) AS n,
  sum(s) OVER (PARTITION BY g, f) AS s FROM {name}_c WINDOW w AS (PARTITION BY g, f ORDER BY v)),
{name} AS (SELECT g, f, (v + nv) / 2 AS thr, sl / nl AS lo, (s - sl) / (n - nl) AS hi FROM {name}_p WHERE nv IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY g ORDER BY round(sl * sl / nl + (s - sl) * (s - sl) / (n - nl), 6) DESC, o, v) = 1)"""


def _leaf(feats: tuple[str, ...] = _F, s: str = "s") -> str:
    """Prediction of a row from the split ``s``."""
    return f"CASE WHEN (CASE {s}.f " + " ".join(f"WHEN '{f}' THEN {f}" for f in feats) + f" END) <= {s}.thr THEN {s}.lo ELSE {s}.hi END"


cte("stump_rows", f"""SELECT state, district, p.month_date, {Y} AS y, month(p.month_date) AS month, year(p.month_date) AS year, i,
  i > (SELECT max(i) FROM month_rank) - 12 AS is_val FROM panel_s p JOIN month_rank m ON p.month_date = m.month_date""")
cte("stump_train", "SELECT * FROM stump_rows WHERE NOT is_val")
cte("stump_val", "SELECT * FROM stump_rows WHERE is_val")
cte("stump_folds", """SELECT r.*, 3 - f AS fold, CASE WHEN i >= n - 2 - f THEN 'val' ELSE 'train' END AS role
  FROM stump_rows r, (SELECT max(i) + 1 AS n FROM month_rank), (SELECT unnest([0, 1, 2]) AS f)
  WHERE i BETWEEN n - 2 - f AND n - 1 - f OR i < n - 3 - f""")


def _plain(spark: SparkSession, sf: str) -> DataFrame:
    return t.enrol_panel(spark, sf, True).withColumns({"month": F.month("month_date"), "year": F.year("month_date")})


def _stump_split(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, mod.Features]:
    rows = cut_lineage(splits.last_months_split(cut_lineage(_plain(spark, sf)), n_months=12))
    return rows.where("split = 'train'").drop("split"), rows.where("split = 'val'").drop("split"), mod.Features(_F, Y)


def _stump_folds(spark: SparkSession, sf: str) -> tuple[DataFrame, mod.Features]:
    df = cut_lineage(_plain(spark, sf))
    table = splits.expanding_folds(df, n_folds=3, gap_months=1, min_train_months=12, val_months=2)
    return cut_lineage(splits.assign_folds(df, table)), mod.Features(_F, Y)


@query("stump_forecast", "M1 M3", f"""WITH {_stump('s', 'stump_train')}
SELECT state, district, month_date, y AS {Y}, R[{_leaf()}] AS prediction, R[y - {_leaf()}] AS residual FROM stump_val, s""")
def _stump_forecast(spark: SparkSession, sf: str) -> DataFrame:
    train, val, feats = _stump_split(spark, sf)
    return rounded(mod.score(mod.fit(train, feats, STUMP), val, Y).select(*K, Y, "prediction", "residual"))


@query("stump_forest", "M2", f"""WITH {_stump('s', 'stump_train')}
SELECT state, district, month_date, R[{_leaf()}] AS prediction FROM stump_val, s""")
def _stump_forest(spark: SparkSession, sf: str) -> DataFrame:
    train, val, feats = _stump_split(spark, sf)
    tree = mod.TreeConfig(kind="forest", max_depth=1, max_iter=1, subsample=1.0, feature_share=1.0, bootstrap=False)
    return rounded(mod.score(mod.fit(train, feats, tree), val).select(*K, "prediction"))


@query("stump_cross_validation", "M4 D4", f"""WITH tr AS (SELECT * FROM stump_folds WHERE role = 'train'), {_stump('s', 'tr', by='fold')}
SELECT CAST(fold AS INTEGER) AS fold, state, district, month_date, CAST(y AS BIGINT) AS y, R[{_leaf()}] AS prediction
FROM stump_folds JOIN s ON g = fold WHERE role = 'val'""")
def _stump_oof(spark: SparkSession, sf: str) -> DataFrame:
    rows, feats = _stump_folds(spark, sf)
    return rounded(mod.cross_validate(rows, feats, STUMP, K, stored=True))


_TRIALS = {"month,year": _F, "month": ("month",), "year": ("year",)}
_TRIAL_SQL = " UNION ALL ".join(
    f"""SELECT CAST({i} AS BIGINT) AS trial, '{name}' AS features, fold, avg(abs(y - {_leaf(feats, f's{i}')})) AS mae
  FROM stump_folds JOIN s{i} ON g = fold WHERE role = 'val' GROUP BY fold""" for i, (name, feats) in enumerate(_TRIALS.items()))


@query("stump_search_over_folds", "M5 T6", "WITH tr AS (SELECT * FROM stump_folds WHERE role = 'train'), "
       + ", ".join(_stump(f"s{i}", "tr", f, by="fold") for i, f in enumerate(_TRIALS.values()))
       + f""" SELECT trial, features, R[avg(mae)] AS val_mae, R[stddev_samp(mae)] AS val_mae_std, count(*) AS n_folds FROM ({_TRIAL_SQL}) GROUP BY ALL""")
def _stump_search(spark: SparkSession, sf: str) -> DataFrame:
    rows, feats = _stump_folds(spark, sf)
    trials = mod.search_folds(rows, feats, [(STUMP, mod.Features(f, Y)) for f in _TRIALS.values()])
    return rounded(trials.select("trial", "features", "val_mae", "val_mae_std", "n_folds"))


@query("stump_importance", "M7 F16", f"""WITH {_stump('s', 'stump_train')}
SELECT n AS feature, 'calendar' AS family, CASE WHEN n = f THEN 1.0e0 ELSE 0.0e0 END AS importance FROM s, (SELECT unnest(['month', 'year']) AS n)""")
def _stump_importance(spark: SparkSession, sf: str) -> DataFrame:
    train, _, feats = _stump_split(spark, sf)
    return rounded(mod.importance(mod.fit(train, feats, STUMP), feats, train).select("feature", "family", "importance"))


@query("stump_ablation", "M8", "WITH tr AS (SELECT * FROM stump_folds WHERE role = 'train'), "
       + ", ".join(_stump(f"s{i}", "tr", f, by="fold") for i, f in enumerate(_TRIALS.values())) + ", "
       + ", ".join(f"e{i} AS (SELECT avg(abs(y - {_leaf(f, f's{i}')})) AS mae FROM stump_folds JOIN s{i} ON g = fold WHERE role = 'val')"
                   for i, f in enumerate(_TRIALS.values()))
       + """ SELECT 'year' AS dropped_family, R[e1.mae] AS mae, R[e1.mae - e0.mae] AS mae_increase, e1.mae - e0.mae >= 0.01 AS keep FROM e0, e1
  UNION ALL SELECT 'month', R[e2.mae], R[e2.mae - e0.mae], e2.mae - e0.mae >= 0.01 FROM e0, e2""")
def _stump_ablation(spark: SparkSession, sf: str) -> DataFrame:
    rows, feats = _stump_folds(spark, sf)
    return rounded(mod.ablation(rows, feats, {"month": ["month"], "year": ["year"]}, STUMP, min_gain=0.01))


_F2 = (*_F, "base_pred")


@query("stump_residual_booster", "M9", f"""WITH {_stump('s', 'stump_train')},
lt AS (SELECT stump_train.*, {_leaf()} AS base_pred, y - {_leaf()} AS e FROM stump_train, s), {_stump('u', 'lt', _F2, 'e')},
v AS (SELECT stump_val.*, {_leaf()} AS base_pred FROM stump_val, s)
SELECT state, district, month_date, R[base_pred] AS base_pred, R[{_leaf(_F2, 'u')}] AS residual_pred, R[base_pred + {_leaf(_F2, 'u')}] AS boosted_pred,
  R[abs(y - base_pred - {_leaf(_F2, 'u')})] AS ae_boosted FROM v, u""")
def _stump_residual(spark: SparkSession, sf: str) -> DataFrame:
    train, val, feats = _stump_split(spark, sf)
    return rounded(mod.residual_booster(train, val, feats, STUMP, STUMP).select(*K, "base_pred", "residual_pred", "boosted_pred", "ae_boosted"))


@query("stump_routing", "M10", f"""WITH hi AS (SELECT * FROM stump_train WHERE month >= 9), {_stump('s', 'stump_train')}, {_stump('u', 'hi')}
SELECT state, district, month_date, CASE WHEN month >= 9 THEN 'high_volume' ELSE 'general' END AS route,
  R[CASE WHEN month >= 9 THEN {_leaf(_F, 'u')} ELSE {_leaf()} END] AS prediction FROM stump_val, s, u""")
def _stump_routing(spark: SparkSession, sf: str) -> DataFrame:
    train, val, feats = _stump_split(spark, sf)
    return rounded(mod.routed(train, val, feats, F.col("month") >= 9, STUMP, STUMP).select(*K, "route", "prediction"))


@query("stump_champion_scores", "K6 M3", f"""WITH {_stump('s', 'stump_train', ('year',))}
SELECT state, district, month_date, 'v2' AS version, R[{_leaf(('year',))}] AS prediction FROM stump_val, s""")
def _stump_champion(spark: SparkSession, sf: str) -> DataFrame:
    registry = scratch_path(spark, "registry")
    train, val, _ = _stump_split(spark, sf)
    for version, feats in (("v1", ("month",)), ("v2", ("year",))):
        path = sinks.save_model_version(mod.fit(train, mod.Features(feats, Y), STUMP), registry, version)
        sinks.set_champion(spark, registry, version, f"2024-01-0{version[1]} 00:00:00", path)
    champion = sinks.current_champion(spark, registry).first()
    scored = mod.score(mod.load(spark, champion["path"]), val)
    return rounded(scored.select(F.lit(champion["version"]).alias("version"), *K, "prediction"))


_NEW = ("months_since_start", "month")


@query("new_month_scores", "M3 K6 C3", f"""WITH r AS (SELECT *, datediff('month', (SELECT min(month_date) FROM panel_s), month_date) AS months_since_start,
  i > (SELECT max(i) FROM month_rank) - 2 AS is_new FROM stump_rows), tr AS (SELECT * FROM r WHERE NOT is_new),
{_stump('s', 'tr', _NEW)}
SELECT state, district, month_date, 'v1' AS version, R[{_leaf(_NEW)}] AS prediction FROM r, s WHERE is_new""")
def _new_months(spark: SparkSession, sf: str) -> DataFrame:
    """Two new months scored by a stored model; their trend goes on from the training run's start."""
    registry = scratch_path(spark, "registry")
    df = splits.last_months_split(cut_lineage(t.enrol_panel(spark, sf, True)), n_months=2)
    known, new = (cut_lineage(df.where(F.col("split") == x).drop("split")) for x in ("train", "val"))
    scoring.train_and_store(spark, known, mod.Features(_NEW, Y), STUMP, registry, "v1", CONFIG)
    recent = known.where(F.col("month_date") >= F.add_months(known.agg(F.max("month_date")).scalar(), -12))
    return rounded(scoring.score_new(spark, recent, new, registry, CONFIG).select(*K, "version", "prediction"))


def _two_levels(name: str, rows: str, by: str) -> str:
    """CTEs for trees of depth two by group: root splits in ``name``, splits of their sides in ``name``2."""
    root = _stump(name, rows, by=by)
    sides = f"{name}_s AS (SELECT r.*, {by} * 2 + ({_side(name)}) AS part FROM {rows} r JOIN {name} ON {name}.g = {by})"
    means = f"{name}_m AS (SELECT part, avg(y) AS m FROM {name}_s GROUP BY part)"
    return f"{root}, {sides}, {means}, {_stump(name + '2', name + '_s', by='part')}"


def _side(s: str, feats: tuple[str, ...] = _F) -> str:
    return f"CASE WHEN (CASE {s}.f " + " ".join(f"WHEN '{f}' THEN {f}" for f in feats) + f" END) <= {s}.thr THEN 0 ELSE 1 END"


DEEP = replace(STUMP, max_depth=2)


@query("cross_validated_rows", "M4 D4 M1", f"""WITH tr AS (SELECT * FROM stump_folds WHERE role = 'train'), {_two_levels('s', 'tr', 'fold')},
v AS (SELECT x.*, fold * 2 + ({_side('s')}) AS part FROM stump_folds x JOIN s ON s.g = fold WHERE role = 'val')
SELECT CAST(fold AS INTEGER) AS fold, state, district, month_date, CAST(y AS BIGINT) AS y, R[CASE WHEN s2.g IS NULL THEN m ELSE {_leaf(_F, 's2')} END] AS prediction
FROM v JOIN s_m USING (part) LEFT JOIN s2 ON s2.g = part""")
def _oof_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Trees of depth two on all folds in one run."""
    rows, feats = _stump_folds(spark, sf)
    return rounded(mod.cross_validate(rows, feats, DEEP, K, stored=True))


HALF = replace(STUMP, max_iter=2, step_size=0.5)
_ROUND_1 = f"a.m + 0.5e0 * (({_leaf()}) - a.m)"


@query("two_round_forecast", "M1 M3", f"""WITH {_stump('s', 'stump_train')}, a AS (SELECT avg(y) AS m FROM stump_train),
e AS (SELECT stump_train.*, y - ({_ROUND_1}) AS e FROM stump_train, s, a), {_stump('u', 'e', y='e')}
SELECT state, district, month_date, R[{_ROUND_1} + 0.5e0 * ({_leaf(_F, 'u')})] AS prediction FROM stump_val, s, u, a""")
def _two_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Two rounds at half the step: the second tree learns what the first one left."""
    train, val, feats = _stump_split(spark, sf)
    return rounded(mod.score(mod.fit(train, feats, HALF), val).select(*K, "prediction"))


@query("stump_attribution", "M7", f"""WITH {_stump('s', 'stump_train')}, a AS (SELECT avg(y) AS m FROM stump_train),
e AS (SELECT stump_train.*, y - ({_ROUND_1}) AS e FROM stump_train, s, a), {_stump('u', 'e', y='e')}, b AS (SELECT avg(e) AS m FROM e),
c AS (SELECT state, district, month_date, s.f AS feature, 0.5e0 * (({_leaf()}) - a.m) AS x FROM stump_val, s, a
  UNION ALL SELECT state, district, month_date, u.f, 0.5e0 * (({_leaf(_F, 'u')}) - b.m) FROM stump_val, u, b)
SELECT state, district, month_date, feature, 'calendar' AS family, R[sum(x)] AS contribution FROM c GROUP BY ALL""")
def _stump_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """Contributions to a forecast of two rounds, by feature."""
    train, val, feats = _stump_split(spark, sf)
    table = attribution.contributions(mod.fit(train, feats, HALF), val, K)
    return rounded(table.select(*K, "feature", feature_family("feature").alias("family"), "contribution"))


SHRUNK = replace(STUMP, l1=25.0, l2=40.0)


@query("shrunk_leaf_forecast", "M1", f"""WITH a AS (SELECT avg(y) AS m FROM stump_train), r AS (SELECT t.*, m - y AS e FROM stump_train t, a),
c AS (SELECT f, o, v, count(*) AS n, sum(e) AS s FROM (SELECT 'month' AS f, 0 AS o, month AS v, e FROM r UNION ALL SELECT 'year', 1, year, e FROM r) GROUP BY ALL),
p AS (SELECT f, o, v, lead(v) OVER w AS nv, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER (PARTITION BY f) AS n, sum(s) OVER (PARTITION BY f) AS s
  FROM c WINDOW w AS (PARTITION BY f ORDER BY v)),
s AS (SELECT f, (v + nv) / 2 AS thr, -sign(sl) * greatest(abs(sl) - 25, 0) / (nl + 40) AS lo, -sign(s - sl) * greatest(abs(s - sl) - 25, 0) / (n - nl + 40) AS hi FROM p
  WHERE nv IS NOT NULL QUALIFY row_number() OVER (ORDER BY round(greatest(abs(sl) - 25, 0) ** 2 / (nl + 40) + greatest(abs(s - sl) - 25, 0) ** 2 / (n - nl + 40), 6) DESC, o, v) = 1)
SELECT state, district, month_date, R[m + ({_leaf()})] AS prediction FROM stump_val, s, a""")
def _shrunk(spark: SparkSession, sf: str) -> DataFrame:
    """Leaf values and gains under L1 and L2."""
    train, val, feats = _stump_split(spark, sf)
    return rounded(mod.score(mod.fit(train, feats, SHRUNK), val).select(*K, "prediction"))


@query("residual_booster_identity", "M9", f"""WITH {_stump('s', 'stump_train')},
lt AS (SELECT stump_train.*, {_leaf()} AS base_pred, y - {_leaf()} AS e FROM stump_train, s WHERE y >= 2), {_stump('u', 'lt', _F2, 'e')},
v AS (SELECT stump_val.*, {_leaf()} AS base_pred FROM stump_val, s)
SELECT state, district, month_date, y AS y_true, R[base_pred] AS base_pred, R[base_pred + {_leaf(_F2, 'u')}] AS boosted_pred FROM v, u""")
def _residual_identity(spark: SparkSession, sf: str) -> DataFrame:
    """The second model learns from some of the rows only."""
    train, val, feats = _stump_split(spark, sf)
    out = mod.residual_booster(train, val, feats, STUMP, STUMP, F.col(Y) >= 2)
    return rounded(out.select(*K, F.col(Y).alias("y_true"), "base_pred", "boosted_pred"))


@query("segment_routes", "M10", f"""WITH f AS (SELECT *, coalesce(avg({Y}) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING),
    avg({Y}) OVER (PARTITION BY state, district)) AS r FROM panel_s WINDOW w AS (PARTITION BY state, district ORDER BY month_date)),
q AS (SELECT f.*, {Y} AS y, month(f.month_date) AS month, year(f.month_date) AS year, i > (SELECT max(i) FROM month_rank) - 12 AS is_val
  FROM f JOIN month_rank m ON f.month_date = m.month_date),
lim AS (SELECT avg(r) AS m FROM q WHERE NOT is_val), tr AS (SELECT * FROM q WHERE NOT is_val), hi AS (SELECT tr.* FROM tr, lim WHERE r >= m),
{_stump('s', 'tr')}, {_stump('u', 'hi')}
SELECT state, district, month_date, {Y}, CASE WHEN r >= m THEN 'high_volume' ELSE 'general' END AS route,
  R[CASE WHEN r >= m THEN {_leaf(_F, 'u')} ELSE {_leaf()} END] AS prediction FROM q, s, u, lim WHERE is_val""")
def _routes(spark: SparkSession, sf: str) -> DataFrame:
    """Routes by the rolling volume of the baseline features, predictions of a stump for each route."""
    train, val, _ = _split(spark, sf)
    high = F.col(f"{Y}_rolling_6_mean") >= train.agg(F.avg(f"{Y}_rolling_6_mean")).first()[0]
    return rounded(mod.routed(train, val, mod.Features(_F, Y), high, STUMP, STUMP).select(*K, Y, "route", "prediction"))


@query("saved_model_scores", "K6 M3")
def _saved(spark: SparkSession, sf: str) -> DataFrame:
    registry = scratch_path(spark, "registry")
    train, val, feats = _split(spark, sf)
    for version, tree in (("v1", mod.TreeConfig(step_size=0.05)), ("v2", TREE)):
        path = sinks.save_model_version(mod.fit(train, feats, tree, val), registry, version)
        sinks.set_champion(spark, registry, version, f"2024-01-0{version[1]} 00:00:00", path)
    champion = sinks.current_champion(spark, registry).first()
    model = mod.load(spark, champion["path"])
    return rounded(mod.score(model, val).select(F.lit(champion["version"]).alias("version"), *K, "prediction"))


@query("training_run_decision", "C9 M1 M6 E7 D1 T2")
def _run(spark: SparkSession, sf: str) -> DataFrame:
    cfg = training.TrainingConfig("target_enrolment_next_month", lag="total_enrolment", tree=CHAMPION, drift_features=(Y,))
    return joined(rounded(training.train(model_dataset(t.panel(spark, sf)), cfg).decision))


@query("stored_training_run", "C9 K2 K3 K6", """
WITH d AS (SELECT *, row_number() OVER (ORDER BY month_date, state, district) - 1 AS pos, count(*) OVER () AS n FROM (
  SELECT *, lag(total_enrolment) OVER w AS prev FROM (SELECT *, lead(total_enrolment) OVER (PARTITION BY state, district ORDER BY month_date) AS y
    FROM panel) WHERE y IS NOT NULL WINDOW w AS (PARTITION BY state, district ORDER BY month_date)) WHERE prev IS NOT NULL),
b AS (SELECT avg(y) AS m FROM d WHERE pos < CAST(floor(n * 0.8e0) AS BIGINT)), v AS (SELECT * FROM d, b WHERE pos >= CAST(floor(n * 0.8e0) AS BIGINT)),
mo AS (SELECT count(DISTINCT month_date) AS k FROM d)
SELECT 'predictions' AS name, count(*) AS n_rows, R[sum(b.m)] AS checked FROM d, b UNION ALL SELECT 'metrics', 1, R[avg(abs(y - m))] FROM v
UNION ALL SELECT 'baseline', 1, R[avg(abs(y - total_enrolment))] FROM v UNION ALL SELECT 'drift', max(k), R[max(k)] FROM mo
UNION ALL SELECT 'drift_summary', 1, R[max(k)] FROM mo UNION ALL SELECT 'alerts', count(*), R[count(*)] FROM v UNION ALL SELECT 'decision', 1, R[1]""")
def _stored_run(spark: SparkSession, sf: str) -> DataFrame:
    """The job that writes: a run without rounds (its forecast is the training mean), stored, and its seven tables read back."""
    cfg = training.TrainingConfig("target_enrolment_next_month", lag="total_enrolment", tree=replace(STUMP, max_iter=0), drift_features=(Y,))
    folder = scratch_path(spark, "run")
    scoring.store_run(training.train(model_dataset(t.panel(spark, sf)), cfg), folder, "r1")
    value = {"predictions": F.sum("prediction"), "metrics": F.max("mae"), "baseline": F.max("naive_mae"), "drift_summary": F.max("n_periods"), "decision": F.lit(1.0)}
    parts = []
    for name in scoring.RUN_TABLES:
        table = spark.read.parquet(f"{folder}/{name}").where("version = 'r1'")
        parts.append(table.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n_rows"), value.get(name, F.count(F.lit(1))).cast("double").alias("checked")))
    return rounded(functools.reduce(DataFrame.unionByName, parts))


@query("training_split", "C9 D1 P9 P14 T2", """
WITH d AS (SELECT *, row_number() OVER (ORDER BY month_date, state, district) - 1 AS pos, count(*) OVER () AS n FROM (
  SELECT *, lag(total_enrolment) OVER w AS prev FROM (SELECT *, lead(total_enrolment) OVER (PARTITION BY state, district ORDER BY month_date) AS target
    FROM panel) WHERE target IS NOT NULL WINDOW w AS (PARTITION BY state, district ORDER BY month_date)) WHERE prev IS NOT NULL)
SELECT state, district, month_date, total_enrolment, target AS target_enrolment_next_month,
  CASE WHEN pos < CAST(floor(n * 0.8e0) AS BIGINT) THEN 'train' ELSE 'val' END AS split FROM d""")
def _training_split(spark: SparkSession, sf: str) -> DataFrame:
    data = training.training_data(model_dataset(t.panel(spark, sf)), training.TrainingConfig("target_enrolment_next_month"))
    return data.split.select(*K, Y, "target_enrolment_next_month", "split")
