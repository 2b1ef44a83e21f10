"""Segmented scans, prefix statistics of folds and running quantiles against windows over whole series."""

import random
import time
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import cleaning, long_series, running
from panelcast.operators.fold_stats import fold_stats, prefix_stats
from panelcast.operators.groups import group_stats
from panelcast.operators.series import Series
from panelcast.operators.splits import assign_folds, expanding_folds

S = Series(("k",), "d")


@pytest.fixture(scope="module")
def series(spark):
    """One long series, a short one, one without values, one that begins and one that ends with nulls."""
    rng, start, rows = random.Random(4), date(2000, 1, 1), []
    for k, n, p in (("long", 900, 0.5), ("short", 3, 0.2), ("empty", 40, 1.0), ("solid", 60, 0.0)):
        rows += [(k, start + timedelta(days=3 * i), None if rng.random() < p else round(rng.gauss(1e6, 5), 3)) for i in range(n)]
    rows += [("late", start + timedelta(days=i), None if i < 50 else float(i)) for i in range(70)]
    rows += [("early", start + timedelta(days=i), None if i > 4 else float(i)) for i in range(70)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, d date, y double")


def values(df, *cols):
    return {(r["k"], r["d"]): tuple(None if r[c] is None else round(r[c], 6) for c in cols) for r in df.collect()}


@pytest.mark.parametrize("parts", [1, 5, 60])
def test_gaps_equal_whole_windows(series, parts):
    got = long_series.fill_gaps(series, "y", S, 2, parts)
    assert got.columns == [*series.columns, "null_run", "locf", "linear"]
    runs = cleaning.null_run_position(series, "y", S, "null_run")
    assert values(got, "null_run") == values(runs, "null_run") == values(long_series.null_run_position(series, "y", S, parts=parts), "null_run")
    assert values(got, "locf") == values(cleaning.locf(series, "y", S, 2, "locf"), "locf")
    assert values(got, "linear") == values(cleaning.linear_by_time(series, "y", S, "linear"), "linear")


@pytest.mark.parametrize("parts, n", [(1, 4), (60, 4), (60, 40)])
def test_rolling_equals_whole_windows(series, parts, n):
    want = series.withColumns({f"rolling_{n}_mean": F.avg("y").over(S.prev(n)), f"rolling_{n}_std": F.stddev_samp("y").over(S.prev(n))})
    names = f"rolling_{n}_mean", f"rolling_{n}_std"
    got, want = values(long_series.rolling(series, "y", S, n, parts), *names), values(want, *names)
    assert got.keys() == want.keys()
    for k in got:
        assert got[k] == tuple(None if v is None else pytest.approx(v, abs=2e-6) for v in want[k]), k


def test_one_series_lies_in_many_partitions(series):
    parts = long_series.with_carry(series, "y", S, 3, 60).where("k = 'long'").select("_part").distinct().count()
    assert parts > 10


def test_timestamps_and_empty_tables(spark):
    start = datetime(2024, 1, 1)
    rows = [("a", start + timedelta(seconds=i * i), float(i) if i % 4 == 0 else None) for i in range(9)]
    df = spark.createDataFrame(rows, "k string, d timestamp, y double")
    got = [r["linear"] for r in long_series.fill_gaps(df, "y", S, 9, 4).orderBy("d").collect()]
    want = [i if i % 4 == 0 else 4 * (i // 4) + 4 * (i * i - 16 * (i // 4) ** 2) / (16 * (i // 4 + 1) ** 2 - 16 * (i // 4) ** 2) for i in range(9)]
    assert got == pytest.approx(want)
    assert long_series.fill_gaps(df.limit(0), "y", S).count() == long_series.rolling(df.limit(0), "y", S).count() == 0


def test_no_frame_is_added_up_again_for_every_row(series):
    """A frame that shrinks towards the end of a series is quadratic in its length."""
    for df in (long_series.fill_gaps(series, "y", S, 2, 5), cleaning.linear_by_time(series, "y", S, "linear")):
        plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "rowframe" in plan
        assert "currentrow$(), unboundedfollowing" not in plan and "currentrow$(), 2147483647" not in plan


@pytest.mark.parametrize("parts", [1, 4])
def test_rows_of_one_date_have_one_order(spark, parts):
    """The order of ``ties`` holds in all windows; neighbours of one date have no line between them."""
    rows = [("a", date(2024, 1, 1), i, float(i) if i % 3 != 1 else None) for i in range(9)] + [("a", date(2024, 1, 3), 9, None), ("a", date(2024, 1, 5), 10, 12.0)]
    df = spark.createDataFrame(rows, "k string, d date, i int, y double").orderBy(F.desc("i"))
    got = {r["i"]: (r["null_run"], r["locf"], r["linear"]) for r in long_series.fill_gaps(df, "y", S, 2, parts, ties=("i",)).collect()}
    for i in (1, 4, 7):
        assert got[i][:2] == (1, float(i - 1)) and np.isnan(got[i][2])
    assert got[9] == (1, 8.0, 10.0)


def test_fold_statistics_equal_those_of_copied_rows(spark):
    rng = random.Random(2)
    rows = [(f"s{k % 3}", f"d{k}", date(2020 + m // 12, m % 12 + 1, 5), None if rng.random() < 0.2 else 1e7 + rng.gauss(0, 3)) for k in range(9) for m in range(k, 30) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "state string, district string, month_date date, y double")
    folds = expanding_folds(df, n_folds=4, gap_months=1, min_train_months=3)
    train = assign_folds(df, folds).where("role = 'train'")
    for keys in (["state", "district"], ["state"], []):
        got = {tuple(r)[: len(keys) + 1]: (r["mean"], r["std"]) for r in fold_stats(df, folds, keys, "y").select("fold", *keys, "mean", "std").collect()}
        want = {tuple(r)[: len(keys) + 1]: (r["mean"], r["std"]) for r in group_stats(train, ["fold", *keys], "y", "mean", "std").collect()}
        assert got.keys() == want.keys() and len(got) > 3
        for k in got:
            assert got[k] == (pytest.approx(want[k][0], rel=1e-12) if want[k][0] is not None else None, pytest.approx(want[k][1], abs=1e-6) if want[k][1] is not None else None)
    plan = fold_stats(df, folds, ["state"], "y")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("+- Window")  # folds come in after the merge
    assert prefix_stats(df.limit(0), ["state"], "y").count() == 0


def test_running_quantiles_of_a_long_series(spark):
    """Equal to numpy on every tenth thousand row, and not quadratic in the length."""
    n = 100_000
    y = np.random.default_rng(1).normal(size=n).round(2)
    df = spark.createDataFrame([("a", i, None if i % 11 == 3 else float(v)) for i, v in enumerate(y)], "k string, d long, y double")
    begun = time.time()
    rows = running.running_quantiles(df, "y", Series(("k",), "d"), (0.1, 0.5)).collect()
    assert time.time() - begun < 60
    by = {r["d"]: r["q"] for r in rows}
    assert by[0] is None and len(rows) == n
    for at in (1, 2, 9_999, 50_000, 99_999):
        past = [v for i, v in enumerate(y[:at]) if i % 11 != 3]
        assert by[at] == pytest.approx(np.quantile(past, (0.1, 0.5)).tolist())


def test_running_flags_equal_the_window_version(series):
    want = series.withColumn("f", cleaning.iqr_outlier(S, "y"))
    assert values(running.past_iqr_outliers(series, "y", S, name="f"), "f") == values(want, "f")
