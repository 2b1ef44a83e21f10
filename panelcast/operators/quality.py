"""Input checks as one data-quality aggregate, and the guards that act on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require_columns(df: DataFrame, cols: Sequence[str], context: str = "input") -> DataFrame:
    """Names only, no job: raise when a column is missing."""
    if missing := [c for c in cols if c not in df.columns]:
        raise ValueError(f"{context}: missing columns {missing}")
    return df


def require_rows(df: DataFrame, context: str = "input") -> DataFrame:
    """Raise on an empty table; reads at most one row."""
    if df.isEmpty():
        raise ValueError(f"{context}: no rows")
    return df


def quality_report(df: DataFrame, target: str, date: str, cols: Sequence[str] = ()) -> DataFrame:
    """One row: size, months, null and negative targets, null features."""
    cols = list(cols) or [c for c in df.columns if c not in (target, date)]
    numeric = isinstance(df.schema[target].dataType, T.NumericType)
    any_null = F.lit(False)
    for c in cols:
        any_null = any_null | F.col(c).isNull()
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(F.trunc(date, "MM")).alias("n_months"),
        F.count_if(F.col(target).isNull()).alias("null_targets"),
        F.count_if(F.col(target) < 0 if numeric else F.lit(False)).alias("negative_targets"),
        F.count_if(any_null).alias("rows_with_null_features"),
    ).withColumn("target_is_numeric", F.lit(numeric))


def require_training_input(df: DataFrame, target: str, date: str, min_months: int = 3, cols: Sequence[str] = ()) -> DataFrame:
    """Raise when the report of one pass shows the table cannot be trained on."""
    r = quality_report(require_columns(df, [target, date]), target, date, cols).first()
    problems = []
    if r["n_rows"] == 0:
        problems.append("no rows")
    if r["n_months"] < min_months:
        problems.append(f"{r['n_months']} distinct months, need {min_months}")
    if r["null_targets"]:
        problems.append(f"{r['null_targets']} null targets")
    if not r["target_is_numeric"]:
        problems.append("target is not numeric")
    if problems:
        raise ValueError("; ".join(problems))
    return df


# Name fragments that mark columns revealing the target.
LEAKAGE_PATTERNS = ("target_", "_next_month", "_diff_", "_pct_change_")


def feature_list(df: DataFrame, target: str, date: str, ids: Sequence[str] = ("state", "district"),
                 leak_patterns: Sequence[str] = LEAKAGE_PATTERNS, components: Sequence[str] = (),
                 allow: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """Numeric and categorical feature names: everything but keys, dates, the target, its components and leaks.

    Computed once from the schema; apply the same lists to every split.
    """
    dropped = {target, date, "year_month", *ids, *components}
    numeric, categorical = [], []
    for f in df.schema.fields:
        leaks = any(p in f.name for p in leak_patterns) and f.name not in allow
        if f.name in dropped or leaks:
            continue
        if isinstance(f.dataType, (T.NumericType, T.BooleanType)):
            numeric.append(f.name)
        elif isinstance(f.dataType, T.StringType):
            categorical.append(f.name)
    if not numeric and not categorical:
        raise ValueError("no features left after the exclusions")
    return numeric, categorical
