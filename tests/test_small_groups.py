"""Models of small groups are fitted in one grouped map, with the trees of a fit by steps."""

import uuid
from dataclasses import replace

import numpy as np
import pytest
import test_boosting as tb
from pyspark.sql import functions as F

from panelcast.operators import boosting
from panelcast.operators import models as mod
from panelcast.operators.boosting import Job, TreeConfig, fit_all

DRAWN = replace(tb.PLAIN, max_iter=12, subsample=0.7, feature_share=0.7, patience=4, l1=0.1, l2=1.0)


def folds(spark, n=300):
    df = tb.frame(spark, tb.data(n))
    return df.crossJoin(spark.createDataFrame([(1,), (2,), (3,)], "fold int")).withColumn("role", F.when(F.col("id") % 5 == F.col("fold"), "val").otherwise("train"))


def jobs_of(spark, run):
    """The result of ``run`` and the number of Spark jobs it took."""
    name = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(name, "")
    out = run()
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def by_steps(monkeypatch, run):
    with monkeypatch.context() as m:
        m.setattr(boosting, "_SMALL", 0)
        return run()


def same(one, two):
    assert one.history == pytest.approx(two.history) and len(one.trees) == len(two.trees) > 1
    for a, b in zip(one.trees, two.trees, strict=True):
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and (a.left == b.left).all()
        assert np.allclose(a.value, b.value) and (a.cover == b.cover).all()


def test_leafwise_fits_of_folds(spark, monkeypatch):
    rows = folds(spark).withColumn("_group", F.col("fold"))
    leafwise = replace(DRAWN, kind="leafwise", max_depth=-1, max_leaves=9, min_child_weight=5)
    run = [Job(cfg, tb.FEATS, g) for cfg in (leafwise, DRAWN) for g in (1, 2, 3)]
    got, jobs = jobs_of(spark, lambda: fit_all(rows, run))
    for one, two in zip(got, by_steps(monkeypatch, lambda: fit_all(rows, run)), strict=True):
        same(one, two)
    assert jobs < 25  # a step of every tree was a job before


def test_ablation(spark, monkeypatch):
    cfg, rows = replace(DRAWN, max_iter=10), folds(spark)
    ask = lambda: sorted(map(tuple, mod.ablation(rows, tb.FEATS, {"a": ["a"], "b": ["b"]}, cfg).collect()))
    got, jobs = jobs_of(spark, ask)
    assert [r[0] for r in got] == ["a", "b"] and jobs < 25
    for a, b in zip(got, by_steps(monkeypatch, ask), strict=True):
        assert a[1:3] == pytest.approx(b[1:3]) and a[3] == b[3]


def test_routing_with_rows_in_two_groups(spark, monkeypatch):
    """Also with one group small and the other one fitted by steps."""
    df = tb.frame(spark, tb.data(300))
    train, val, test = (df.where(F.col("id") % 5 == k) if k else df.where(F.col("id") % 5 > 2) for k in (0, 1, 2))
    ask = lambda: {r["id"]: (r["route"], r["prediction"]) for r in mod.routed(train, test, tb.FEATS, F.col("a") > 7, DRAWN, DRAWN, val).collect()}
    got, jobs = jobs_of(spark, ask)
    assert jobs < 30 and {r for r, _ in got.values()} == {"high_volume", "general"}
    for limit in (0, 100):
        with monkeypatch.context() as m:
            m.setattr(boosting, "_SMALL", limit)
            other = ask()
        assert got.keys() == other.keys() and all(got[i] == (other[i][0], pytest.approx(other[i][1])) for i in got)


@pytest.mark.parametrize("name", [n for n in dir(tb) if n in (
    "test_carried_trees_and_written_margins_agree", "test_constant_and_empty_training_tables", "test_a_model_comes_back_from_its_tables")])
def test_fits_by_steps(spark, monkeypatch, name):
    """The checks of the booster where no group is small."""
    monkeypatch.setattr(boosting, "_SMALL", 0)
    test = getattr(tb, name)
    test(spark, monkeypatch) if "monkeypatch" in test.__code__.co_varnames[: test.__code__.co_argcount] else test(spark)


def test_a_group_above_the_limit_is_fitted_by_steps(spark, monkeypatch):
    called = []
    old = boosting._stepped
    monkeypatch.setattr(boosting, "_stepped", lambda *a: called.append(1) or old(*a))
    monkeypatch.setattr(boosting, "_SMALL", 299)
    rows = tb.frame(spark, tb.data(300)).withColumn("role", F.lit("train"))
    assert len(fit_all(rows, [Job(TreeConfig(max_iter=2), tb.FEATS)])[0].trees) == 2 and called
