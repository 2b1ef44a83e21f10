"""Registered model queries ask for the operators' own settings, and keep more than one round where that helps."""

from dataclasses import replace

import pytest

from panelcast.operators import models as mod
from panelcast.operators.boosting import TreeConfig, fit_all
from panelcast.queries import models as queries

DATA = "/root/testdata/sf0.001"
#: A training run asks for 100 rows in each part of its split.
RUN_DATA = "/root/testdata/sf0.01"
#: Models of each call, in order, and the rounds each may have.
JOBS = {
    "_booster": ([1], 500), "_oof": ([3], 500), "_leafwise": ([3], 700), "_search": ([30], 500), "_importance": ([1], 500), "_family": ([1], 500),
    "_attribution": ([1], 500), "_ablation": ([9], 500), "_residual": ([1, 1], 500), "_routing": ([2], 500), "_saved": ([1, 1], 500), "_run": ([1], 500),
}


@pytest.fixture
def asked(monkeypatch):
    seen = []

    def small(rows, jobs, prune=None):
        seen.append(jobs)
        return fit_all(rows, [replace(j, cfg=replace(j.cfg, max_iter=1)) for j in jobs], prune)

    monkeypatch.setattr(mod, "fit_all", small)
    return seen


@pytest.mark.parametrize("name", JOBS)
def test_rounds_of_registered_fits(spark, asked, name):
    getattr(queries, name)(spark, RUN_DATA if name == "_run" else DATA)
    sizes, rounds = JOBS[name]
    assert [len(jobs) for jobs in asked] == sizes
    assert {j.cfg.max_iter for jobs in asked for j in jobs} == {rounds}


def test_the_refit_follows_a_search_of_ten(spark, asked):
    queries._refit(spark, DATA)
    assert [len(jobs) for jobs in asked] == [10, 1]
    assert {j.cfg.max_iter for j in asked[0]} == {500} and asked[1][0].cfg.max_iter == 1


def test_a_registered_fit_keeps_more_than_one_round(spark):
    """The forecast of the last year, with a larger step to need fewer jobs: better than its first round."""
    train, val, feats = queries._split(spark, RUN_DATA)
    model = mod.fit(train, feats, replace(TreeConfig(), step_size=0.3, max_iter=12, patience=12), val)
    assert mod.n_trees(model) > 1 and min(model.history) < model.history[0]
