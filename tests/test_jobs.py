"""Jobs that leave tables and models behind: a stored training run, and scores of months that came later."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from panelcast.operators.models import Features, TreeConfig, grid_candidates, load, sample_candidates, score, search_folds
from panelcast.plans import features as plans
from panelcast.plans import scoring, training
from panelcast.session import scratch_path
from panelcast.sources import sinks

Y = "total_enrolment"
TREE = TreeConfig(max_depth=2, max_iter=3, step_size=0.5, subsample=1.0, feature_share=1.0)


@pytest.fixture(scope="module")
def panel(spark):
    rows = [
        (f"S{s}", f"D{s}{d}", date(2020 + m // 12, m % 12 + 1, 1), float((m * 5 + d * 7) % 11 * 10 + s * 40 + m))
        for s in range(2) for d in range(3) for m in range(30)
    ]
    return spark.createDataFrame(rows, f"state string, district string, month_date date, {Y} double")


def test_new_months_get_the_scores_of_the_full_history(spark, panel):
    feats = Features(("months_since_start", f"{Y}_lag_1", f"{Y}_lag_3", f"{Y}_rolling_3_mean", "month"), Y, ("state",))
    registry, last = scratch_path(spark, "registry"), date(2022, 6, 1)
    known, new = panel.where(F.col("month_date") < last), panel.where(F.col("month_date") == last)
    scoring.train_and_store(spark, known, feats, TREE, registry, "v1")
    recent = known.where("month_date >= '2021-06-01'")  # scoring needs the last months only
    got = {r["district"]: r["prediction"] for r in scoring.score_new(spark, recent, new, registry).collect()}
    whole = plans.sentinel_fill(plans.monthly_features(panel, Y), keep=[Y]).where(F.col("month_date") == last)
    model = load(spark, sinks.current_champion(spark, registry).first()["path"])
    want = {r["district"]: r["prediction"] for r in score(model, whole).collect()}
    assert got == want and len(got) == 6 and len(set(got.values())) > 1


def test_a_training_run_leaves_its_tables(spark, panel):
    df = panel.withColumn("lagged", F.col(Y) - 1).withColumn("month", F.month("month_date")).withColumn("target_next", F.col(Y) * 2)
    cfg = training.TrainingConfig("target_next", lag="lagged", tree=TREE, drift_features=(Y,), min_rows=10)
    folder = scratch_path(spark, "run")
    for version in ("r1", "r2"):
        scoring.store_run(training.train(df, cfg), folder, version)
    for name in ("predictions", "metrics", "baseline", "drift", "drift_summary", "alerts", "decision"):
        table = spark.read.parquet(f"{folder}/{name}")
        assert {r["version"] for r in table.select("version").distinct().collect()} == {"r1", "r2"}, name
    assert spark.read.parquet(f"{folder}/predictions").count() == 2 * df.count()


def test_search_covers_folds_and_grids(spark, panel):
    rows = panel.withColumn("month", F.month("month_date")).withColumn("year", F.year("month_date"))
    folds = [rows.withColumns({"fold": F.lit(k), "role": F.when(F.col("month_date") < cut, "train").otherwise("val")}) for k, cut in ((1, "2021-09-01"), (2, "2022-03-01"))]
    trials = search_folds(folds[0].unionByName(folds[1]), Features(("month", "year"), Y), [TREE, (TREE, Features(("year",), Y))]).orderBy("trial").collect()
    assert [(t["trial"], t["n_folds"], t["features"]) for t in trials] == [(0, 2, "month,year"), (1, 2, "year")]
    assert all(t["val_mae"] > 0 and t["val_mae_std"] is not None for t in trials)
    assert len(grid_candidates()) == 5832 and len(set(sample_candidates(10))) == 10
