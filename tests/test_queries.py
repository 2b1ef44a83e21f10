"""Every registered query against its SQL, and the driver contract."""

from dataclasses import replace

import pytest
from compare import connect, difference

import __spark_entry__ as contract
from panelcast.operators.boosting import TreeConfig
from panelcast.queries import QUERIES, models

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module")
def planned():
    """Plans of the queries as ``test_query`` has run them."""
    return {}


@pytest.fixture
def small(monkeypatch):
    """Queries whose fits no SQL checks run with few rounds here; ``test_full_fits`` looks at their settings."""
    for cfg in ("TREE", "CHAMPION", "FOREST", "LEAFWISE"):
        monkeypatch.setattr(models, cfg, replace(getattr(models, cfg), max_iter=3))
    monkeypatch.setattr(models, "CANDIDATES", 3)
    sample = models.mod.sample_candidates
    monkeypatch.setattr(models.mod, "sample_candidates", lambda n: sample(n, base=TreeConfig(max_iter=3)))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, planned, small, name):
    frames = []
    assert difference(spark, con, QUERIES[name], SF, frames.append) is None
    planned[name] = frames[0]._jdf.queryExecution().executedPlan().toString()


def test_contract(spark):
    assert contract.queries().keys() >= contract.oracle_sql().keys()
    df = contract.entry(spark)
    assert df.columns == contract.entry(spark).columns
    assert df.count() > 0


# Jobs that fit models or run streams: their plans are made and run inside.
EAGER = {"header_check"}
#: Forecasts: rows are scored by numpy over the trees in Arrow batches.
SCORED = {name for name, q in QUERIES.items() if q.run.__module__ == models.__name__}


@pytest.mark.parametrize("name", list(QUERIES))
def test_plan_has_no_cross_join_and_no_python(planned, name):
    plan = planned[name]
    nodes = ["CartesianProduct", "ArrowEvalPython", "BatchEvalPython", "MapInArrow", "MapInPandas"]
    for node in nodes if name not in EAGER | SCORED else ["CartesianProduct", "BatchEvalPython"]:
        assert node not in plan, (name, node)
