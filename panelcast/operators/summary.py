"""Exploratory aggregates of the panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.quantiles import exact_quantiles


def sum_and_mean(df: DataFrame, by: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Sum and mean of every measure and the row count, per group."""
    aggs = [a for m in measures for a in (F.sum(m).alias(f"{m}_sum"), F.avg(m).alias(f"{m}_mean"))]
    return df.groupBy(*by).agg(*aggs, F.count(F.lit(1)).alias("n_rows"))


def sums_by_levels(df: DataFrame, region: str, month: str, measure: str) -> DataFrame:
    """Region x month, region and grand total in one pass."""
    return df.rollup(region, month).agg(F.sum(measure).alias("total"), F.avg(measure).alias("mean"), F.count(F.lit(1)).alias("n"))


def describe(df: DataFrame, cols: Sequence[str], refine: int = 1) -> DataFrame:
    """count, mean, std, min, quartiles and max per column, quartiles exact at any size.

    ``refine`` narrows the quantile brackets by that many more passes, whatever the number of rows.
    """
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols
    ])).alias("_s")).select("_s.*")
    base = long.groupBy("column").agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"),
    )
    return base.join(exact_quantiles(long, "v", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, ["column"], few_keys=True, refine=refine), "column")


def null_audit(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Nulls and null share per column: one aggregate over all columns, reshaped to long."""
    cols = list(cols or df.columns)
    wide = df.agg(
        F.count(F.lit(1)).alias("_n"),
        F.array(*[F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("nulls")) for c in cols]).alias("_a"),
    )
    out = wide.select("_n", F.explode("_a").alias("s"))
    return out.select("s.column", "s.nulls", F.try_divide(F.col("s.nulls") * 100.0, F.col("_n")).alias("null_pct"))


def key_coverage(df: DataFrame, state: str = "state", district: str = "district", date: str = "month_date") -> DataFrame:
    month = F.trunc(date, "MM")
    return df.agg(
        F.count_distinct(state).alias("n_states"),
        F.count_distinct(district).alias("n_districts"),
        F.count_distinct(state, district).alias("n_pairs"),
        F.count_distinct(month).alias("n_months"),
        F.min(month).alias("first_month"),
        F.max(month).alias("last_month"),
    )


def groups_with_at_least(df: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """Groups of at least n rows, with their size."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") >= n)


def transposed(df: DataFrame, row: str, values: Sequence[str], columns: Sequence[str], col: str) -> DataFrame:
    """Values as rows and the given groups as columns."""
    long = df.unpivot([col], list(values), row, "_v")
    return long.groupBy(row).pivot(col, list(columns)).agg(F.first("_v"))
