"""Exact quantiles, global positions and their behaviour under skew and partitioning."""

from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from compare import connect, difference
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelcast.operators import ranking as r
from panelcast.operators.evaluate import histogram
from panelcast.operators.quantiles import exact_quantiles
from panelcast.queries import QUERIES, tables

PROBS = {"p0": 0.0, "p1": 0.01, "third": 1 / 3, "half": 0.5, "p90": 0.9, "p100": 1.0}


def check(df, values_by_key, keys, **how):
    got = {tuple(row[k] for k in keys): row for row in exact_quantiles(df, "v", PROBS, keys, **how).collect()}
    for key, values in values_by_key.items():
        for name, p in PROBS.items():
            scale = max(np.abs(values), default=0)
            assert got[key][name] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12 * max(1.0, scale)), (key, name)


@pytest.mark.parametrize("shape", ["uniform", "one_value_third", "heavy_tail", "few_values"])
def test_quantiles_of_large_groups(spark, shape):
    rng = np.random.default_rng(7)
    n = 20_000
    values = {
        "uniform": rng.random(n),
        "one_value_third": np.where(rng.random(n) < 0.34, 5.0, rng.normal(5, 2, n)),
        "heavy_tail": rng.pareto(0.6, n),
        "few_values": rng.integers(0, 4, n).astype(float),
    }[shape]
    key = np.where(rng.random(n) < 0.9, 0, 1)
    df = spark.createDataFrame([(int(k), float(v)) for k, v in zip(key, values)], "k int, v double").repartition(13)
    check(df, {(0,): values[key == 0], (1,): values[key == 1]}, ["k"])
    check(df, {(): values}, [])
    check(df, {(0,): values[key == 0], (1,): values[key == 1]}, ["k"], refine=2, few_keys=True)
    check(df, {(): values}, [], refine=1)


@pytest.mark.parametrize("tied", [False, True])
def test_quantiles_of_every_size_in_one_table(spark, tied):
    """One value, sizes around a former limit, and a large group, with and without heavy ties."""
    rng = np.random.default_rng(5)
    groups = {n: np.floor(rng.random(n) * 3) if tied else rng.normal(size=n) for n in (1, 2, 3, 7, 100, 1999, 4999, 5000, 100_000)}
    rows = spark.createDataFrame(
        pd.DataFrame({"k": np.concatenate([np.full(n, n) for n in groups]), "v": np.concatenate(list(groups.values()))})
    )
    for refine in (0, 1):
        check(rows.repartition(9), {(n,): v for n, v in groups.items()}, ["k"], refine=refine)


def test_quantiles_of_nothing(spark):
    none = spark.createDataFrame([(1, None)], "k int, v double")
    assert exact_quantiles(none, "v", PROBS, ["k"]).count() == 0
    row = exact_quantiles(none, "v", PROBS, [], refine=1).collect()
    assert all(v is None for r in row for v in r)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=40))
def test_quantiles_of_small_groups(spark, values):
    check(spark.createDataFrame([(v,) for v in values], "v double"), {(): values}, [])


def test_positions_match_a_plain_sort(spark):
    rng = np.random.default_rng(3)
    rows = [(int(a), int(b)) for a, b in zip(rng.integers(0, 5, 5000), rng.permutation(5000))]
    df = spark.createDataFrame(rows, "a int, b int").repartition(17)
    got = {(x["a"], x["b"]): x["position"] for x in r.global_position(df, [F.desc("a"), "b"]).collect()}
    for i, row in enumerate(sorted(rows, key=lambda t: (-t[0], t[1]))):
        assert got[row] == i


def test_positions_of_one_hot_first_key(spark):
    df = spark.range(20_000).select(F.lit("same").alias("k"), F.col("id"))
    ranked = r.global_position(df, ["k", "id"])
    assert ranked.where("position <> id").isEmpty()


def test_keep_first_and_ties(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 2, "b"), (2, 9, "z"), (1, 2, "a")], "k int, o int, v string")
    assert {(x["k"], x["v"]) for x in r.keep_first(df, ["k"], ["o", "v"]).collect()} == {(1, "a"), (2, "z")}
    top = r.top_k_per_group(df, ["k"], F.desc("o"), ["v"], 1)
    assert {(x["k"], x["v"]) for x in top.collect()} == {(1, "c"), (2, "z")}


def test_histogram_of_a_constant(spark):
    rows = histogram(spark.createDataFrame([(2.0,)] * 5, "v double"), "v", 10).collect()
    assert [(x["bin"], x["n"]) for x in rows] == [(5, 5)]
    assert np.histogram([2.0] * 5, bins=10)[0][5] == 5


@pytest.mark.parametrize("name", ["clean_series_default", "baseline_features", "alerts", "positional_split", "weak_segments"])
def test_result_does_not_depend_on_partitioning(spark, name):
    seen = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = QUERIES[name].run(spark, "/root/testdata/sf0.001")
            seen.append(sorted(map(str, df.collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] and seen[0]


def test_each_fact_moves_a_table_once(spark):
    """Exchanges of the fact plans when nothing is broadcast: one for each join side and one for the sums."""
    changed = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        plans = [f._jdf.queryExecution().executedPlan().toString() for f in tables.monthly(spark, "/root/testdata/sf0.001")]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [p.count("Exchange hashpartitioning") for p in plans] == [3, 5, 4]
    assert all(p.count("/lineitem.parquet") == n for p, n in zip(plans, (0, 1, 1)))


def test_panel_with_a_hot_customer_order_and_supplier(spark, tmp_path):
    for path in Path("/root/testdata/sf0.001").iterdir():
        (tmp_path / path.name).symlink_to(path)
    for name, column in (("orders", "o_custkey"), ("lineitem", "l_suppkey"), ("lineitem", "l_orderkey")):
        rows = pd.read_parquet(tmp_path / f"{name}.parquet")
        rows.loc[rows.index % 3 == 0, column] = rows[column].iloc[0]
        (tmp_path / f"{name}.parquet").unlink()
        rows.to_parquet(tmp_path / f"{name}.parquet", index=False)
    assert difference(spark, connect(str(tmp_path)), QUERIES["district_month_panel"], str(tmp_path)) is None
