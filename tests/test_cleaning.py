"""Edge cases of outliers and gaps against independent pandas loops."""

import math
from datetime import date

import numpy as np
import pandas as pd
import pytest

from panelcast.operators import cleaning as c
from panelcast.operators.series import DISTRICT, Series, densify_months

NAN = float("nan")
SERIES = {
    "constant": [5.0] * 8,
    "single": [7.0],
    "leading": [None, None, 3, 4, None, 6, 7, 8],
    "interior": [1, None, None, None, None, 9, 2, 3],
    "trailing": [2, 4, 6, 8, None, None, None, None],
    "spike": [10, 11, 9, 10, 300, 10, 11, 12],
    "all_null": [None] * 4,
    "rise_after_flat": [4, 4, 4, 90, 4, 5, 6, 7],
}


def months(n):
    return [date(2024 + i // 12, i % 12 + 1, 1) for i in range(n)]


@pytest.fixture(scope="module")
def frame(spark):
    rows = [("S", k, m, None if v is None else float(v)) for k, vs in SERIES.items() for m, v in zip(months(len(vs)), vs)]
    return spark.createDataFrame(rows, "state string, district string, month_date date, y double").cache()


def by_series(df, col):
    pdf = df.toPandas().sort_values(["district", "month_date"])
    return {k: [None if v is None or v != v else float(v) for v in g[col]] for k, g in pdf.groupby("district")}


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        for x, z in zip(a[k], b[k], strict=True):
            assert (x is None and z is None) or math.isclose(x, z, rel_tol=1e-9), (k, a[k], b[k])


def as_none(xs):
    return [None if x is None or x != x else float(x) for x in xs]


def test_zscore(frame):
    got = by_series(frame.withColumn("f", c.zscore_outlier(DISTRICT, "y").cast("int")), "f")
    want = {}
    for k, vs in SERIES.items():
        s = pd.Series([NAN if v is None else v for v in vs], dtype=float)
        prev = s.shift(1).rolling(3, min_periods=1)
        mean, std = prev.mean(), prev.std()
        want[k] = [float(std[i] > 0 and abs((s[i] - mean[i]) / std[i]) > 3) for i in range(len(s))]
    same(got, want)
    assert sum(got["constant"]) == 0 and got["spike"][4] == 1 and sum(got["rise_after_flat"]) == 0


def test_iqr(frame):
    got = by_series(frame.withColumn("f", c.iqr_outlier(DISTRICT, "y").cast("int")), "f")
    for k, vs in SERIES.items():
        for i, v in enumerate(vs):
            past = [x for x in vs[:i] if x is not None]
            want = 0.0
            if i >= 4 and past and v is not None:
                q1, q3 = np.percentile(past, [25, 75])
                want = float(v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1))
            assert got[k][i] == want, (k, i)


def test_median_cap_keeps_value_without_history(spark):
    rows = [("S", "d", m, v, f) for m, v, f in zip(months(4), [50.0, 3.0, 4.0, 90.0], [True, False, False, True])]
    df = spark.createDataFrame(rows, "state string, district string, month_date date, y double, flag boolean")
    assert by_series(df.withColumn("o", c.median_cap(DISTRICT, "y", "flag")), "o")["d"] == [50.0, 3.0, 4.0, 3.5]


def test_clip_moves_unflagged_rows_too(frame):
    got = by_series(frame.withColumn("o", c.clip_all(DISTRICT, "y")), "o")
    assert got["constant"] == [5.0] * 8
    assert got["rise_after_flat"][3] == 4.0 and got["spike"][4] < 300
    assert got["leading"][:2] == [None, None]


@pytest.mark.parametrize("gap", [0, 1, 2, 3, 9])
def test_locf_fills_the_first_rows_of_a_gap(frame, gap):
    got = by_series(c.locf(frame, "y", DISTRICT, gap, "o"), "o")
    want = {}
    for k, vs in SERIES.items():
        out, last, run = [], None, 0
        for v in vs:
            run = run + 1 if v is None else 0
            last = v if v is not None else last
            out.append(v if v is not None else (last if run <= gap else None))
        want[k] = as_none(out)
    same(got, want)


def test_linear_equals_time_interpolation(frame):
    got = by_series(c.linear_by_time(frame, "y", DISTRICT, "o"), "o")
    want = {}
    for k, vs in SERIES.items():
        s = pd.Series([NAN if v is None else v for v in vs], index=pd.to_datetime(months(len(vs))), dtype=float)
        want[k] = as_none(s.interpolate(method="time"))
    same(got, want)


def test_state_mean_falls_back_to_whole_state(spark):
    rows = [("S", "a", date(2024, 1, 1), 2.0), ("S", "b", date(2024, 1, 1), None), ("S", "a", date(2024, 2, 1), None),
            ("S", "b", date(2024, 2, 1), None), ("S", "a", date(2024, 3, 1), 4.0), ("T", "z", date(2024, 1, 1), None)]
    df = spark.createDataFrame(rows, "state string, district string, month_date date, y double")
    got = by_series(c.peer_mean_fill(df, "y", "state", "month_date", "o"), "o")
    assert got == {"a": [2.0, 3.0, 4.0], "b": [2.0, 3.0], "z": [None]}


def test_missing_summary(frame):
    rows = {r["district"]: r for r in c.missing_summary(frame, "y").collect()}
    assert rows["interior"]["max_consecutive_gap"] == 4 and rows["interior"]["missing_count"] == 4
    assert rows["leading"]["max_consecutive_gap"] == 2 and rows["leading"]["first_missing_date"] == date(2024, 1, 1)
    assert rows["constant"]["missing_pct"] == 0 and rows["constant"]["first_missing_date"] is None


@pytest.mark.parametrize("method", ["locf", "state_mean", "linear", "none"])
@pytest.mark.parametrize("cap", ["median", "clip_all", "none"])
def test_audit_columns_are_consistent(frame, method, cap):
    out = c.clean_series(frame, "y", c.CleaningConfig(outlier_cap_method=cap, missing_method=method))
    assert out.where("y_was_imputed and y_after_cap is not null").isEmpty()
    assert out.where("not y_was_imputed and not (y <=> y_after_cap)").isEmpty()
    assert out.where("y_was_capped and is_outlier_event = 0").isEmpty()
    assert out.where("not (y_original <=> y_after_cap) and y_original is null").isEmpty()
    left = out.where("y is null").count()
    assert left == (out.where("y_original is null").count() if method == "none" else 0)


def test_densify(spark):
    rows = [("S", "a", date(2024, 1, 1), 1.0), ("S", "a", date(2024, 4, 1), 2.0), ("S", "b", date(2024, 2, 1), 3.0)]
    df = spark.createDataFrame(rows, "state string, district string, month_date date, y double")
    out = densify_months(df, ["state", "district"])
    assert out.count() == 8 and out.where("y is not null").count() == 3


def test_window_longer_than_series(frame):
    s = Series()
    assert by_series(frame.withColumn("f", c.zscore_outlier(s, "y", 50).cast("int")), "f")["single"] == [0.0]
