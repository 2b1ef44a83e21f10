"""Leakage, edge values and guards of features, splits and folds."""

from datetime import date

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelcast.functions import dates as d
from panelcast.functions import numbers as n
from panelcast.functions import text as x
from panelcast.operators import lags, splits
from panelcast.operators import quality as q
from panelcast.operators import series as ts
from panelcast.operators.calendars import add_calendar, holiday_calendar
from panelcast.operators.series import DISTRICT
from panelcast.plans import features as plans

COLS = "state string, district string, month_date date, y double"


def months(k):
    return [date(2020 + i // 12, i % 12 + 1, 1) for i in range(k)]


def panel(spark, k=24, names=("a", "b", "c")):
    rows = [("S" if i < 2 else "T", nm, m, float((j * 7 + i * 13) % 11)) for i, nm in enumerate(names) for j, m in enumerate(months(k))]
    return spark.createDataFrame(rows, COLS)


def test_past_features_ignore_the_future(spark):
    df = panel(spark)
    cut = date(2021, 1, 1)
    changed = df.withColumn("y", F.when(F.col("month_date") > F.lit(cut), F.col("y") * 1000 + 5).otherwise(F.col("y")))
    cols = {**ts.lag_cols(DISTRICT, "y", fill=False), **ts.rolling_cols(DISTRICT, "y", fill=False),
            **ts.full_rolling_cols(DISTRICT, "y", (3,)), **ts.stability_cols(DISTRICT, "y"), **ts.rolling_median_cols(DISTRICT, "y")}

    def upto(frame):
        return sorted(map(str, frame.withColumns(cols).where(F.col("month_date") <= F.lit(cut)).collect()))

    assert upto(df) == upto(changed)


def test_fold_statistics_come_from_training_rows_only(spark):
    df = panel(spark)
    folds = splits.expanding_folds(df, n_folds=3, gap_months=1, min_train_months=6)
    val_months = [r["month_date"] for r in folds.where("role = 'val' and fold = 3").collect()]
    changed = df.withColumn("y", F.when(F.col("month_date").isin(val_months), 1e6).otherwise(F.col("y")))
    cols = ["fold", "district", "month_date", "y_lag_1", "y_rolling_6_std", "y_rolling_3_mean"]

    def val_rows(frame):
        out = plans.fold_features(splits.assign_folds(frame, folds), "y", history="fold")
        return sorted(map(str, out.where("fold = 3 and role = 'val'").select(cols).collect()))

    assert val_rows(df) == val_rows(changed)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 4), st.integers(0, 3), st.integers(1, 6), st.integers(1, 3))
def test_folds_never_overlap(spark, n_folds, gap, min_train, val):
    df = panel(spark, 18, ("a",))
    folds = splits.expanding_folds(df, n_folds=n_folds, gap_months=gap, min_train_months=min_train, val_months=val)
    assigned = splits.assign_folds(df, folds)
    checks = splits.fold_checks(assigned, ["state", "district"])
    splits.require_valid_folds(checks)
    assert checks.count() == n_folds
    ranks = {m: i for i, m in enumerate(months(18))}
    for row in checks.collect():
        assert ranks[row["val_min"]] - ranks[row["train_max"]] == gap + 1


def test_too_few_months_and_rows_stop_the_job(spark):
    df = panel(spark, 6, ("a",))
    with pytest.raises(Exception, match="need at least"):
        splits.expanding_folds(df, n_folds=5, gap_months=1, min_train_months=6).collect()
    with pytest.raises(Exception, match="fewer than 100"):
        splits.positional_split(df, ["month_date", "state", "district"]).collect()
    with pytest.raises(ValueError, match="between 0 and 1"):
        splits.positional_split(df, ["month_date"], 1.5)
    with pytest.raises(ValueError, match="empty splits"):
        splits.require_splits(splits.date_split(df, "month_date", "2030-01-01", "2031-01-01"))


def test_invalid_lags_are_dropped_and_zero_base_is_not_infinite(spark):
    assert list(ts.lag_cols(DISTRICT, "y", (0, -1, 2))) == ["y_lag_2"]
    rows = [("S", "a", m, v) for m, v in zip(months(4), [0.0, 5.0, 5.0, 0.0])]
    out = spark.createDataFrame(rows, COLS).withColumns(ts.pct_change_cols(DISTRICT, "y")).orderBy("month_date")
    assert [r["y_pct_change_1"] for r in out.collect()] == [0.0, 0.0, 0.0, -1.0]


def test_full_window_and_single_row_deviation(spark):
    rows = [("S", "a", m, float(i)) for i, m in enumerate(months(4))]
    cols = ts.full_rolling_cols(DISTRICT, "y", (3,)) | ts.rolling_cols(DISTRICT, "y", (3,), fill=False)
    out = spark.createDataFrame(rows, COLS).withColumns(cols).orderBy("month_date").collect()
    assert [r["y_roll3_mean"] for r in out] == [None, None, None, 1.0]
    assert out[1]["y_rolling_3_std"] is None and out[1]["y_rolling_3_mean"] == 0.0


def test_calendar_covers_a_mid_month_first_date(spark):
    df = spark.createDataFrame([(date(2024, 1, 20),), (date(2024, 3, 2),)], "d date")
    got = {r["d"]: r for r in add_calendar(df, "d").collect()}
    assert got[date(2024, 1, 20)]["is_festival_peak"] == 1 and got[date(2024, 3, 2)]["is_fy_end"] == 1
    cal = holiday_calendar(spark, "2024-01-15", "2024-12-31")
    assert cal.count() == 12
    late = add_calendar(spark.createDataFrame([(date(2030, 8, 1),)], "d date"), "d", cal).first()
    assert late["is_festival_peak"] == 0


def test_strict_and_lenient_parsing(spark):
    df = spark.createDataFrame([("31-12-2024", "7"), ("2024-12-31", "x"), (None, "2.9")], "t string, c string")
    assert [r[0] for r in df.select(d.lenient_date("t")).collect()] == [date(2024, 12, 31), None, None]
    assert [r[0] for r in df.select(n.lenient_long("c")).collect()] == [7, 0, 2]
    with pytest.raises(Exception, match="(?i)parse"):
        df.select(d.strict_date("t")).collect()


def test_transform_guards(spark):
    df = spark.createDataFrame([(-2.0,), (3.0,)], "y double")
    with pytest.raises(Exception, match="not positive"):
        df.select(n.log_transform("y")).collect()
    with pytest.raises(Exception, match="negative"):
        df.select(n.sqrt_transform("y")).collect()
    with pytest.raises(ValueError):
        n.log_transform("y", -1)


def test_input_guards(spark):
    df = panel(spark, 2)
    with pytest.raises(ValueError, match="missing columns"):
        q.require_columns(df, ["nope"])
    with pytest.raises(ValueError, match="no rows"):
        q.require_rows(df.limit(0))
    with pytest.raises(ValueError, match="distinct months"):
        q.require_training_input(df, "y", "month_date", 3)
    with pytest.raises(ValueError, match="null targets"):
        q.require_training_input(df.withColumn("y", F.lit(None).cast("double")), "y", "month_date", 1)
    with pytest.raises(ValueError, match="numeric"):
        q.require_training_input(df.withColumn("y", F.lit("a")), "y", "month_date", 1)


def test_leaking_columns_are_not_features(spark):
    df = panel(spark).withColumns({c: F.lit(1.0) for c in ("y_diff_1", "y_pct_change_1", "target_y", "band_a", "fine")})
    numeric, categorical = q.feature_list(df, "y", "month_date", components=("band_a",))
    assert numeric == ["fine"] and categorical == []
    assert "y_diff_1" in q.feature_list(df, "y", "month_date", allow=("y_diff_1",))[0]


def test_feature_families(spark):
    names = ["y_lag_1", "y_rolling_3_mean", "is_exam_month", "is_phase_1", "age_0_5", "month_sin", "zzz"]
    rows = spark.createDataFrame([(v,) for v in names], "f string").select(x.feature_family("f")).collect()
    assert [r[0] for r in rows] == ["lag", "rolling", "holiday", "policy", "demographics", "calendar", "other"]


def test_triage_order(spark):
    texts = {
        "my id number is 5": "unsafe_personal", "call 1234567890": "unsafe_personal", "show all of the gap": "raw_export",
        "what if the gap grows": "over_capacity", "what if we add 3 camps": "simulate", "explain this": "explain_dashboard",
        "hello": "unsupported",
    }
    df = spark.createDataFrame([(k,) for k in texts], "m string")
    got = {r["m"]: r for r in x.triage(df, "m", ["Asia", "East Asia"]).collect()}
    assert {k: r["intent"] for k, r in got.items()} == texts
    assert got["what if we add 3 camps"]["asked_camps"] == 3 and got["hello"]["asked_camps"] == 1


def test_durbin_levinson_solves_yule_walker(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    ys = np.cumsum(rng.normal(size=60))
    rows = [("S", "a", m, float(v)) for m, v in zip(months(60), ys)] + [("S", "flat", m, 1.0) for m in months(30)]
    out = {r["district"]: r for r in lags.significant_lags(lags.pacf(lags.acf(spark.createDataFrame(rows, COLS), "y"))).collect()}
    c = ys - ys.mean()
    r = [float((c[k:] * c[: len(c) - k]).sum() / (c * c).sum()) for k in range(13)]
    assert out["a"]["acf"] == pytest.approx(r)
    for k in range(1, 13):
        toeplitz = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        assert out["a"]["pacf"][k] == pytest.approx(np.linalg.solve(toeplitz, r[1 : k + 1])[-1])
    assert out["flat"]["lags"] == [1]


def test_recommended_lags_without_long_series(spark):
    assert lags.recommended_lags(panel(spark, 5), "y").first()["lags"] == [1, 2, 3, 6]


def test_one_hot_ignores_unseen_values(spark):
    from pyspark.ml.functions import vector_to_array

    from panelcast.operators import groups

    train = spark.createDataFrame([("b",), ("a",)], "state string")
    model = groups.one_hot(train, ["state"]).fit(train)
    rows = model.transform(spark.createDataFrame([("a",), ("b",), ("zz",)], "state string"))
    got = {r[0]: r[1] for r in rows.select("state", vector_to_array("state_vec")).collect()}
    assert got == {"a": [1.0, 0.0], "b": [0.0, 1.0], "zz": [0.0, 0.0]}


def test_label_index_is_sorted_and_unseen_is_minus_one(spark):
    from panelcast.operators import groups

    train = spark.createDataFrame([("c",), ("a",), ("c",), (None,)], "k string")
    encoder = groups.fit_label_index(train, "k")
    out = groups.apply_label_index(spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "k string"), encoder, "k")
    assert {r["k"]: r["k_idx"] for r in out.collect()} == {"a": 0, "b": -1, "c": 1, None: -1}


def test_monthly_sums_with_a_hot_key(spark):
    from panelcast.operators.panel import monthly_sums

    hot = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("d"), (F.col("id") % 500).cast("string")))
    fact = spark.range(90_000).select(
        F.lit("S").alias("state"), hot.alias("district"), F.expr("date_add(date'2024-01-01', cast(id % 60 as int))").alias("date"),
        F.lit(1).cast("bigint").alias("n"))
    out = monthly_sums(fact, ["n"])
    assert out.agg(F.sum("n")).first()[0] == 90_000
    assert out.where("district = 'hot'").agg(F.sum("n")).first()[0] == 30_000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan
