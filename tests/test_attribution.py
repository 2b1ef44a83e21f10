"""Contributions against all subsets of the features, and their sum against the predictions."""

import itertools
import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.functions.text import feature_family
from panelcast.operators import attribution
from panelcast.operators import models as mod
from panelcast.operators.boosting import Features, TreeConfig

from test_boosting import data

CFG = TreeConfig(max_depth=4, max_iter=6, step_size=0.4, subsample=0.8, feature_share=1.0, max_bins=16)
NAMES = ("a", "b", "d", "c")


def value(model, tree, bins, known, n=0):
    """A tree's value when only the features in ``known`` are known: others pass by the share of training rows."""
    f = tree.feature[n]
    if f < 0:
        return tree.value[n]
    kids = int(tree.left[n]), int(tree.right[n])
    name = model.binning.names[f]
    if name in known:
        left = bins[f] == tree.cut[n] if name in model.binning.categorical else bins[f] <= tree.cut[n]
        return value(model, tree, bins, known, kids[0 if left else 1])
    return sum(tree.cover[k] / tree.cover[n] * value(model, tree, bins, known, k) for k in kids)


def shapley(model, bins, name):
    rest = [n for n in NAMES if n != name]
    total = 0.0
    for k in range(len(rest) + 1):
        weight = math.factorial(k) * math.factorial(len(rest) - k) / math.factorial(len(NAMES))
        for s in itertools.combinations(rest, k):
            total += weight * sum(value(model, t, bins, {*s, name}) - value(model, t, bins, set(s)) for t in model.trees)
    return total


@pytest.fixture(scope="module")
def fitted(spark):
    rows = [(*r[:4], float(r[0] * 7 % 13) if r[0] % 9 else None, r[4] + r[0] * 7 % 13 / 3) for r in data(300)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c string, d double, y double")
    return df, mod.fit(df, Features(NAMES[:3], "y", ("c",)), CFG)


def test_contributions_equal_all_subsets_and_add_up(spark, fitted):
    df, model = fitted
    odd = spark.createDataFrame([(1000, None, float("nan"), "unseen", 1.0, None), (1001, 5.0, 5.0, None, None, None)], df.schema)
    df = df.where("id % 6 = 0").unionByName(odd)
    got = {}
    for r in attribution.contributions(model, df, ["id"]).collect():
        got.setdefault(r["id"], {})[r["feature"]] = r["contribution"]
    rows = model.transform(df).collect()
    bins = model.binning.bins(list(df.select(*model.binning.names).toArrow().combine_chunks().to_batches()[0].columns))
    for r, b in zip(rows, bins, strict=True):
        assert sum(got[r["id"]].values()) + attribution.expected(model) == pytest.approx(r["prediction"], abs=1e-9)
        for name in NAMES:
            assert got[r["id"]][name] == pytest.approx(shapley(model, b, name), abs=1e-9), (r, name)


def test_families_add_up(spark, fitted):
    df, model = fitted
    table = attribution.contributions(model, df, ["id"])
    sums = {r["id"]: r["s"] for r in attribution.by_family(table, ["id"]).groupBy("id").agg(F.sum("contribution").alias("s")).collect()}
    for r in model.transform(df).collect():
        assert sums[r["id"]] + attribution.expected(model) == pytest.approx(r["prediction"], abs=1e-9)


def test_a_model_without_splits_has_no_contributions(spark, fitted):
    df, _ = fitted
    flat = mod.fit(df.withColumn("y", F.lit(3.0)), Features(("a",), "y"), replace(CFG, subsample=1.0))
    assert attribution.contributions(flat, df, ["id"]).count() == 0 and attribution.expected(flat) == 3.0


def test_expected_value_is_the_mean_by_cover(fitted):
    _, model = fitted
    assert attribution.expected(model) == pytest.approx(model.base + sum(value(model, t, None, set()) for t in model.trees))
    assert all(np.isclose(t.cover[0], t.cover[t.feature < 0].sum()) for t in model.trees)


def test_a_name_of_every_family(spark):
    """The first family whose word a name holds wins."""
    names = {
        "y_lag_3": "lag", "sales_prev_month": "lag", "y_rolling_3_mean": "rolling", "roll_std": "rolling", "is_exam_month": "holiday", "days_to_festival": "holiday",
        "policy_phase_2": "policy", "fy_quarter": "policy", "age_0_5": "demographics", "Bio_total": "demographics", "total_enrolment": "demographics",
        "month": "calendar", "Month_Sin": "calendar", "months_since_start": "calendar", "state": "other", "district_count": "other",
    }
    rows = spark.createDataFrame(list(names.items()), "feature string, want string").withColumn("family", feature_family("feature")).collect()
    assert {r["feature"]: r["family"] for r in rows} == names
