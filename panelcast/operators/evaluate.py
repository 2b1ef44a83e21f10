"""Accuracy of predictions: overall, per segment, over time, and between models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions import metrics as m
from panelcast.functions.numbers import volume_bucket
from panelcast.operators.quantiles import exact_quantiles
from panelcast.operators.ranking import order_statistics, top_k_per_group


def metrics_by(df: DataFrame, by: Sequence[str], y: str = "y", p: str = "yhat",
               variant: m.MapeVariant = "nonzero") -> DataFrame:
    """MAE, RMSE, R2, MAPE and row count, overall (no keys) or per group."""
    return df.groupBy(*by).agg(*m.regression_metrics(y, p, variant))


def group_accuracy(df: DataFrame, by: Sequence[str], y: str = "y", p: str = "yhat", unit: str = "district") -> DataFrame:
    """MAE, R2 (0 under two rows), mean actual and number of distinct units per group."""
    return df.groupBy(*by).agg(
        m.mae(y, p).alias("mae"),
        m.r2(y, p, small=0.0).alias("r2"),
        F.avg(y).alias("mean_actual"),
        F.count_distinct(unit).alias("n_units"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def safety_report(df: DataFrame, by: Sequence[str], y: str = "y", p: str = "yhat", factor: float = 1.5,
                  mape_limit: float | None = None) -> DataFrame:
    """Per group MAE, MAPE, RMSE and whether it stays within ``factor`` x the overall MAE."""
    overall = df.agg(m.mae(y, p)).scalar()
    out = df.groupBy(*by).agg(m.mae(y, p).alias("mae"), m.mape(y, p).alias("mape"), m.rmse(y, p).alias("rmse"))
    ok = F.col("mae") <= factor * overall
    if mape_limit is not None:
        ok = ok & F.coalesce(F.col("mape") <= mape_limit, F.lit(False))
    return out.withColumn("pass_flag", ok)


def safety_summary(df: DataFrame, report: DataFrame, y: str = "y", p: str = "yhat") -> DataFrame:
    overall = df.agg(F.struct(m.mae(y, p).alias("mae"), m.mape(y, p).alias("mape"))).scalar()
    passing = F.count_if("pass_flag")
    n = F.count(F.lit(1))
    sums = report.agg(n.alias("n_groups"), passing.alias("n_passing"),
                      F.coalesce(F.try_divide(passing * 100.0, n), F.lit(0.0)).alias("safety_pct"))
    return sums.withColumns({"_g": overall}).select(
        F.col("_g.mae").alias("global_mae"), F.col("_g.mape").alias("global_mape"), "safety_pct", "n_groups", "n_passing"
    )


def residual_stats(df: DataFrame, by: Sequence[str], y: str = "y", p: str = "yhat") -> DataFrame:
    e = F.col(y) - F.col(p)
    return df.groupBy(*by).agg(
        F.avg(e).alias("mean_residual"), F.stddev_samp(e).alias("std_residual"), F.max(F.abs(e)).alias("max_abs_residual")
    )


def histogram(df: DataFrame, value: str, bins: int = 30, by: Sequence[str] = (), few_keys: bool = False) -> DataFrame:
    """Equal-width bins from minimum to maximum, the last one closed; a single value gets a unit-wide range.

    ``few_keys`` states that the groups are an enumeration, so their end points may be broadcast
    and the rows are not shuffled by a handful of hot keys.
    """
    src = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    ends = src.groupBy(*by).agg(F.struct(F.min("_v").alias("lo"), F.max("_v").alias("hi")).alias("_e"))
    if by:
        src = src.join(F.broadcast(ends) if few_keys else ends, list(by))
    else:
        src = src.withColumn("_e", ends.select("_e").scalar())
    flat = F.col("_e.lo") == F.col("_e.hi")
    src = src.withColumns(
        {
            "_lo": F.when(flat, F.col("_e.lo") - 0.5).otherwise(F.col("_e.lo")),
            "_hi": F.when(flat, F.col("_e.hi") + 0.5).otherwise(F.col("_e.hi")),
        }
    )
    at = F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)
    src = src.withColumn("bin", F.least(at, F.lit(bins - 1)).cast("int"))
    out = src.groupBy(*by, "bin", "_lo", "_hi").agg(F.count(F.lit(1)).alias("n"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    return out.select(*by, "bin", (F.col("_lo") + F.col("bin") * width).alias("bin_start"), "n")


def box_stats(df: DataFrame, value: str, by: Sequence[str], few_keys: bool = False) -> DataFrame:
    """Exact quartiles, 1.5 IQR whiskers and number of points outside them, per group."""
    q = exact_quantiles(df, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, by, few_keys=few_keys)
    spread = 1.5 * (F.col("q3") - F.col("q1"))
    joined = df.join(F.broadcast(q) if few_keys else q, list(by)).withColumns({"_lo": F.col("q1") - spread, "_hi": F.col("q3") + spread})
    inside = F.col(value).between(F.col("_lo"), F.col("_hi"))
    return joined.groupBy(*by, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
    )


def error_tables(df: DataFrame, y: str = "y", p: str = "yhat", state: str = "state", date: str = "month_date") -> DataFrame:
    """Errors by state, by month and by volume bucket from one grouping-sets job."""
    src = df.select(
        F.col(state).alias("_state"), F.date_format(date, "yyyy-MM").alias("_month"), volume_bucket(y).alias("_bucket"), y, p
    )
    sets = src.groupingSets([["_state"], ["_month"], ["_bucket"]], "_state", "_month", "_bucket").agg(
        F.grouping_id().alias("_g"),
        m.mae(y, p).alias("mae"),
        m.mape(y, p).alias("mape"),
        F.count(F.lit(1)).alias("n"),
        F.avg(y).alias("mean_actual"),
        F.avg(p).alias("mean_predicted"),
        F.avg(F.col(p) - F.col(y)).alias("bias"),
    )
    kind = F.when(F.col("_g") == 3, "state").when(F.col("_g") == 5, "month").otherwise("bucket")
    segment = F.coalesce("_state", "_month", "_bucket")
    return sets.select(kind.alias("kind"), segment.alias("segment"), "mae", "mape", "n", "mean_actual", "mean_predicted", "bias")


def weak_segments(df: DataFrame, errors: DataFrame, top_n: int = 3, y: str = "y", p: str = "yhat",
                  date: str = "month_date") -> DataFrame:
    """Worst states by MAE and by MAPE (union without duplicates), under-predicted months, biased buckets."""
    worst = errors.where("kind = 'state'")
    by_mae = top_k_per_group(worst, ["kind"], F.desc("mae"), ["segment"], top_n)
    by_mape = top_k_per_group(worst, ["kind"], F.desc("mape"), ["segment"], top_n)
    states = by_mae.select("kind", "segment").union(by_mape.select("kind", "segment")).distinct()
    rel = df.where(F.col(y) != 0).select(
        F.date_format(date, "yyyy-MM").alias("segment"), ((F.col(p) - F.col(y)) / F.col(y)).alias("_rel")
    )
    median = exact_quantiles(rel, "_rel", {"value": 0.5}, ["segment"], few_keys=True).where("value < 0")
    bucket = errors.where("kind = 'bucket'")
    return (
        states.select("kind", "segment", F.lit("high_error").alias("reason"), F.lit(None).cast("double").alias("value"))
        .unionByName(median.select(F.lit("month").alias("kind"), "segment", F.lit("under_predicted").alias("reason"), "value"))
        .unionByName(bucket.select("kind", "segment", F.lit("bias").alias("reason"), F.col("bias").alias("value")))
    )


def rows_in_segments(df: DataFrame, segments: DataFrame, state: str = "state", date: str = "month_date") -> DataFrame:
    """Rows of a listed state or month.  States and calendar months are few, hence broadcast."""

    def listed(kind: str, name: str) -> DataFrame:
        return F.broadcast(segments.where(F.col("kind") == kind).select(F.col("segment").alias(name)).distinct())

    marked = df.join(listed("state", "_s"), F.col(state) == F.col("_s"), "left")
    marked = marked.join(listed("month", "_m"), F.date_format(date, "yyyy-MM") == F.col("_m"), "left")
    return marked.where("_s IS NOT NULL OR _m IS NOT NULL").drop("_s", "_m")


def residual_trend(df: DataFrame, y: str = "y", p: str = "yhat", by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line of the residual on the prediction."""
    e = F.col(y) - F.col(p)
    return df.groupBy(*by).agg(F.regr_slope(e, F.col(p)).alias("slope"), F.regr_intercept(e, F.col(p)).alias("intercept"))


def compare_models(df: DataFrame, keys: Sequence[str], y: str, a: str, b: str) -> DataFrame:
    """Row-level errors of two models side by side and which of them is closer."""
    ea, eb = F.abs(F.col(y) - F.col(a)), F.abs(F.col(y) - F.col(b))
    return df.select(*keys, y, a, b, (F.col(y) - F.col(a)).alias("error_a"), (F.col(y) - F.col(b)).alias("error_b"),
                     F.when(ea < eb, "a").when(eb < ea, "b").otherwise("tie").alias("closer"))


def with_predictions(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join two prediction tables on their row keys."""
    return left.join(right, list(keys), "inner")


def baseline_comparison(df: DataFrame, y: str = "y", model: str = "yhat", naive: str = "yhat2") -> DataFrame:
    """Model against the naive last value: both MAEs, improvement in percent and the winner."""
    both = df.where(F.col(naive).isNotNull())
    out = both.agg(m.mae(y, model).alias("model_mae"), m.mae(y, naive).alias("naive_mae"), F.count(F.lit(1)).alias("n"))
    gain = F.try_divide((F.col("naive_mae") - F.col("model_mae")) * 100, F.col("naive_mae"))
    return out.withColumns({"improvement_pct": gain, "model_wins": F.col("model_mae") < F.col("naive_mae")})


def rank_picks(df: DataFrame, by: Sequence[str], value: str, fractions: Sequence[float] = (0.0, 1 / 3, 2 / 3, 1.0),
               min_rows: int = 6) -> DataFrame:
    """Series at fixed ranks of the mean value among those with enough rows."""
    means = df.groupBy(*by).agg(F.avg(value).alias("mean_value"), F.count(value).alias("n")).where(F.col("n") >= min_rows)
    return order_statistics(means, "mean_value", list(by), fractions)


def mean_quantile_buckets(df: DataFrame, by: Sequence[str], value: str, labels: Sequence[str] = ("low", "medium", "high"),
                          picks: int = 2, min_rows: int = 6) -> DataFrame:
    """Groups cut into equal-count buckets of their mean, with a stable pick of a few per bucket."""
    means = df.groupBy(*by).agg(F.avg(value).alias("mean_value"), F.count(value).alias("n")).where(F.col("n") >= min_rows)
    k = len(labels)
    edges = exact_quantiles(means, "mean_value", {f"e{i}": i / k for i in range(1, k)})
    e = edges.select(F.struct(*edges.columns)).scalar()
    out = means.withColumn("_e", e)
    bucket = F.when(F.col("mean_value") <= F.col("_e.e1"), labels[0])
    for i in range(2, k):
        bucket = bucket.when(F.col("mean_value") <= F.col(f"_e.e{i}"), labels[i - 1])
    out = out.withColumn("bucket", bucket.otherwise(labels[-1])).drop("_e")
    return top_k_per_group(out, ["bucket"], F.md5(F.concat_ws("|", *by)).asc(), list(by), picks)


def mape_grid(df: DataFrame, months: Sequence[int], y: str = "y", p: str = "yhat", state: str = "state",
              date: str = "month_date") -> DataFrame:
    """State x calendar-month MAPE grid; the column list is given, so no extra pass finds it."""
    pct = F.when(F.col(y) != 0, F.abs(F.col(y) - F.col(p)) / F.abs(F.col(y))) * 100
    grid = df.select(state, F.month(date).alias("_m"), pct.alias("_pct"))
    out = grid.groupBy(state).pivot("_m", list(months)).agg(F.avg("_pct"))
    return out.withColumnsRenamed({str(k): f"m{k:02d}" for k in months})


def to_long(df: DataFrame, keys: Sequence[str], labels: dict[str, str], name: str = "type", value: str = "value") -> DataFrame:
    """Actual / forecast columns to one labelled long table."""
    renamed = df.select(*keys, *[F.col(c).cast("double").alias(label) for c, label in labels.items()])
    return renamed.unpivot(list(keys), list(labels.values()), name, value)


def top_share(df: DataFrame, by: str, value: str, n: int) -> DataFrame:
    """Share of the overall total per group, largest first."""
    total = df.agg(F.sum(value)).scalar()
    out = df.groupBy(by).agg(F.sum(value).alias("total"))
    return out.withColumn("coverage_pct", F.col("total") / total * 100).orderBy(F.desc("total"), by).limit(n)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows and percentage per value; the total is one number, so any number of values will do."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).withColumn("pct", F.col("n") * 100.0 / total)


def largest_groups(df: DataFrame, group: str, unit: str, k: int) -> DataFrame:
    """Rows of the k groups that have most distinct units."""
    top = df.groupBy(group).agg(F.count_distinct(unit).alias("n_units")).orderBy(F.desc("n_units"), group).limit(k)
    return df.join(F.broadcast(top), group, "left_semi")


