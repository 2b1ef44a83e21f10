"""Drift, alerts, gates, capacity and blends on hand-written rows."""

import math
from datetime import date

import numpy as np
import pytest

from panelcast.functions import metrics
from panelcast.operators import blend, capacity, evaluate, monitor


def test_drift_with_a_zero_reference(spark):
    rows = [("2024-01", "f", 0.0), ("2024-02", "f", 0.0), ("2024-03", "f", 2.0), ("2024-01", "g", -4.0), ("2024-02", "g", -6.0)]
    stats = spark.createDataFrame(rows, "period string, feature string, mean double")
    got = {(r["feature"], r["period"]): r for r in monitor.drift_flags(stats, 2, 30.0).collect()}
    assert got["f", "2024-02"]["rel_change_pct"] == 0 and not got["f", "2024-02"]["drift_flag"]
    assert math.isinf(got["f", "2024-03"]["rel_change_pct"]) and got["f", "2024-03"]["drift_flag"]
    assert got["g", "2024-02"]["rel_change_pct"] == pytest.approx(-20)


def test_week_labels_and_undefined_deviation(spark):
    df = spark.createDataFrame([(date(2025, 1, 8), 3.0)], "d date, v double")
    row = monitor.drift_stats(df, "d", ["v"], "W").first()
    assert row["period"] == "2025-01-06/2025-01-12" and row["std"] == 0 and row["count"] == 1
    with pytest.raises(ValueError):
        monitor.drift_stats(df, "d", [])


def test_r2_of_small_and_flat_groups(spark):
    df = spark.createDataFrame([("one", 1.0, 2.0), ("flat", 3.0, 1.0), ("flat", 3.0, 5.0)], "g string, y double, p double")
    got = {r["g"]: r["r2"] for r in evaluate.group_accuracy(df, ["g"], "y", "p", "g").collect()}
    assert got == {"one": 0.0, "flat": None}


def test_mape_skips_zero_rows(spark):
    df = spark.createDataFrame([(0.0, 5.0), (2.0, 1.0)], "y double, p double")
    assert evaluate.metrics_by(df, [], "y", "p").first()["mape"] == 50
    assert evaluate.metrics_by(df, [], "y", "p", "plus_one").first()["mape"] == pytest.approx((5 + 1 / 3) / 2 * 100)


def test_alert_types(spark):
    rows = [("S", f"d{i}", date(2024, 1, 1), float(i), float(i), float(i)) for i in range(1, 11)]
    rows.append(("S", "both", date(2024, 1, 1), 10.0, 40.0, 5.0))
    df = spark.createDataFrame(rows, "state string, district string, month_date date, y double, yhat double, yhat2 double")
    out = {r["district"]: r for r in monitor.alerts(df, ["district"]).collect()}
    assert out["both"]["alert_type"] == "both" and out["d10"]["alert_type"] == "none"
    no_truth = monitor.alerts(df, ["district"], y=None).collect()
    assert {r["alert_type"] for r in no_truth} == {"none", "high_load"}


def test_retrain_reasons(spark):
    def one(**kw):
        return spark.createDataFrame([tuple(kw.values())], list(kw))

    got = monitor.retrain_decision(one(mae=12.0, r2=0.4), one(mae=10.0), one(features_with_drift=3)).first()
    assert got["reasons"] == ["r2_below_minimum", "mae_increased", "features_drifting"] and got["retrain"]
    calm = monitor.retrain_decision(one(mae=10.5, r2=0.9), one(mae=10.0), one(features_with_drift=0)).first()
    assert calm["reasons"] == [] and not calm["retrain"]


def test_promotion_rules(spark):
    cols = "scope string, mae double, r2 double, mape double"
    champion = spark.createDataFrame([("overall", 100.0, 0.8, 20.0), ("weak", 100.0, 0.8, 20.0)], cols)
    challenger = spark.createDataFrame([("overall", 97.0, 0.795, 20.9), ("weak", 99.0, 0.7, 22.0)], cols)
    got = {r["scope"]: r for r in monitor.promotion_gate(champion, challenger).collect()}
    assert got["overall"]["promote"] and got["overall"]["failed"] == []
    assert got["weak"]["failed"] == ["mae_gain_too_small", "r2_drop", "mape_worse"]


def test_blend_equals_direct_evaluation(spark):
    rng = np.random.default_rng(0)
    y, a, b = rng.normal(10, 3, 200), rng.normal(10, 3, 200), rng.normal(10, 3, 200)
    df = spark.createDataFrame([tuple(map(float, t)) for t in zip(y, a, b)], "y double, a double, b double")
    rows = blend.blend_grid(df, "y", "a", "b").orderBy("weight_a").collect()
    assert len(rows) == 21
    for row in rows:
        e = y - (row["weight_a"] * a + row["weight_b"] * b)
        assert row["mae"] == pytest.approx(np.abs(e).mean())
        assert row["rmse"] == pytest.approx(np.sqrt((e**2).mean()))
        assert row["r2"] == pytest.approx(1 - (e**2).sum() / ((y - y.mean()) ** 2).sum())


FORECAST = "state string, district string, month_date date, y double, yhat double"


def test_capacity_grain_ties_and_default(spark):
    m = date(2024, 3, 1)
    rows = [("A", "a1", m, 0.0, 30.0), ("A", "a2", m, 0.0, 30.0), ("B", "b1", m, 0.0, 60.0), ("C", "c1", m, 0.0, 1.0)]
    df = spark.createDataFrame(rows, FORECAST)
    centres = spark.createDataFrame([("A", 2), ("B", 2)], "state string, centres int")
    row = capacity.over_capacity_states(df, centres, "2024-03", per_centre=10, default=1).collect()
    assert [(r["state"], r["gap"]) for r in row] == [("B", 40), ("A", 20)]
    once = capacity.over_capacity_states(df, centres, "2024-03", per_centre=10, default=1, grain="state").collect()
    assert [(r["state"], r["gap"], r["extra_centres"]) for r in once] == [("A", 40, 4), ("B", 40, 4)]
    latest = capacity.over_capacity_states(df, centres, "1999-01", per_centre=10)
    assert [r["state"] for r in latest.collect()] == ["B", "A"]
    assert capacity.over_capacity_districts(df, centres, "1999-01").count() == 0


def test_what_if_texts(spark):
    m = date(2024, 3, 1)
    df = spark.createDataFrame([("Asia.", "x", m, 0.0, 130.0)], FORECAST)
    centres = spark.createDataFrame([("Asia.", 10)], "state string, centres int")
    got = capacity.what_if(df, centres, [("asia.", 3, None), ("ASIA", 1, "2024-03"), ("a.ia", 1, None)], per_centre=10)
    assert [r["recommendation"] for r in got.orderBy("scenario").collect()] == [
        "Adding 3 centre(s) fully closes the gap. asia. would have surplus capacity.",
        "Gap remains at 18.2%. Consider adding 2 more centre(s) to fully close the gap.",
        "No data available for a.ia in 2024-03.",
    ]


def test_what_if_answers_each_scenario_by_itself(spark):
    """The same question twice, once with the latest month spelt out, must not add up."""
    m = date(2024, 3, 1)
    df = spark.createDataFrame([("A", "x", m, 0.0, 10.0)], FORECAST)
    centres = spark.createDataFrame([("A", 2)], "state string, centres int")
    got = capacity.what_if(df, centres, [("a", 0, None), ("a", 0, "2024-03"), ("a", 0, None), ("z", 5, "2030-01")], per_centre=1)
    assert [(r["scenario"], r["month"], r["gap_before"], r["gap_after"], r["gap_pct_before"]) for r in got.orderBy("scenario").collect()] == [
        (0, "2024-03", 8, 8, 400.0), (1, "2024-03", 8, 8, 400.0), (2, "2024-03", 8, 8, 400.0), (3, "2030-01", 0, 0, 0.0),
    ]


def test_metrics_count_only_scored_rows(spark):
    df = spark.createDataFrame([(1.0, 1.0), (5.0, 4.0), (100.0, None), (None, 3.0)], "y double, yhat double")
    row = evaluate.metrics_by(df, []).collect()[0]
    assert (row["n_samples"], row["r2"], row["mae"]) == (2, 0.875, 0.5)
    lone = spark.createDataFrame([(1.0, 2.0), (7.0, None)], "y double, yhat double")
    assert lone.agg(metrics.r2("y", "yhat", 0.0).alias("r")).collect()[0]["r"] == 0.0
