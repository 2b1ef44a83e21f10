"""Time-ordered splits and cross-validation folds as tables.

Fold definitions live in small tables keyed by month (calendar x folds rows), so they are
broadcast; facts are never collected or ranked in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.operators.ranking import global_position, month_index


def _require(ok: Column, value: Column, message: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)))


def positional_split(
    df: DataFrame, order: list[str], val_fraction: float = 0.2, min_rows: int = 100
) -> DataFrame:
    """Label the first ``int(n * (1 - f))`` rows of the order train, the rest val."""
    if not 0 < val_fraction < 1:
        raise ValueError("val_fraction must lie between 0 and 1")
    ranked = global_position(df, order)
    n = ranked.agg(F.count(F.lit(1))).scalar()
    cut = F.floor(n * F.lit(1 - val_fraction))
    enough = (cut >= min_rows) & (n - cut >= min_rows)
    cut = _require(enough, cut, f"a split has fewer than {min_rows} rows")
    return ranked.withColumn("split", F.when(F.col("position") < cut, "train").otherwise("val"))


def date_split(df: DataFrame, date: str, train_end: str, val_end: str, test_end: str | None = None) -> DataFrame:
    """train / val / test by date bounds; rows past ``test_end`` are left out."""
    d = F.col(date)
    test = d > F.lit(val_end).cast("date")
    if test_end is not None:
        test = test & (d <= F.lit(test_end).cast("date"))
    split = (
        F.when(d <= F.lit(train_end).cast("date"), "train")
        .when(d <= F.lit(val_end).cast("date"), "val")
        .when(test, "test")
    )
    return df.withColumn("split", split).where("split is not null")


def split_sizes(df: DataFrame, date: str, by: tuple[str, ...] = ("split",)) -> DataFrame:
    """Rows, first and last date and distinct months of every split."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
        F.count_distinct(F.trunc(date, "MM")).alias("n_months"),
    )


def require_splits(df: DataFrame, names: tuple[str, ...] = ("train", "val", "test")) -> None:
    """Raise when one of the splits is empty."""
    held = df.agg(*[F.count_if(F.col("split") == n).alias(n) for n in names]).first()
    if missing := [n for n in names if not held[n]]:
        raise ValueError(f"empty splits: {sorted(missing)}")


def last_months_split(df: DataFrame, date: str = "month_date", n_months: int = 1) -> DataFrame:
    """The last n distinct months become val, everything before is train."""
    months = month_index(df, date)
    last = months.agg(F.max("month_idx")).scalar()
    val = months.where(F.col("month_idx") > last - n_months).select(F.col(date).alias("_m"), F.lit("val").alias("_s"))
    joined = df.join(F.broadcast(val), F.trunc(date, "MM") == F.col("_m"), "left")
    return joined.withColumn("split", F.coalesce("_s", F.lit("train"))).drop("_m", "_s")


def cutoff_date(df: DataFrame, date: str = "month_date", n_months: int = 1) -> DataFrame:
    """Last training month when the final n months are held out."""
    months = month_index(df, date)
    last = months.agg(F.max("month_idx")).scalar()
    return months.where(F.col("month_idx") == last - n_months).select(F.col(date).alias("cutoff"))


def holdout_months(df: DataFrame, n_months: int, date: str = "month_date") -> tuple[DataFrame, DataFrame]:
    """Tuning and test rows: the test months by semi join, the rest by anti join."""
    months = month_index(df, date)
    last = months.agg(F.max("month_idx")).scalar()
    held = F.broadcast(months.where(F.col("month_idx") > last - n_months).select(F.col(date).alias("_m")))
    on = F.trunc(date, "MM") == F.col("_m")
    return df.join(held, on, "left_anti"), df.join(held, on, "left_semi")


def expanding_folds(
    df: DataFrame,
    date: str = "month_date",
    n_folds: int = 5,
    gap_months: int = 1,
    min_train_months: int = 6,
    val_months: int = 1,
) -> DataFrame:
    """Fold table (fold, role, month): expanding train, gap, then validation, anchored at the latest month.

    Folds are numbered chronologically; too few months stop the job.
    """
    months = df.agg(F.array_sort(F.collect_set(F.trunc(date, "MM"))).alias("_ms"))
    n = F.size("_ms")
    need = min_train_months + gap_months + val_months + n_folds - 1
    back = F.sequence(F.lit(0), _require(n >= need, F.lit(n_folds - 1), f"need at least {need} months"))
    bounds = months.select("_ms", F.explode(back).alias("_f")).withColumn("_ve", n - 1 - F.col("_f"))
    bounds = bounds.withColumn("_vs", F.col("_ve") - (val_months - 1)).withColumn("_te", F.col("_vs") - gap_months - 1)
    bounds = bounds.where(F.col("_te") + 1 >= min_train_months)
    rows = bounds.select((n_folds - F.col("_f")).alias("fold"), "_te", "_vs", "_ve", F.posexplode("_ms").alias("_i", date))
    role = F.when(F.col("_i") <= F.col("_te"), "train").when(F.col("_i").between(F.col("_vs"), F.col("_ve")), "val")
    return rows.select("fold", role.alias("role"), date).where("role is not null")


def assign_folds(df: DataFrame, folds: DataFrame, date: str = "month_date") -> DataFrame:
    """Every row once per fold it takes part in, with its role there."""
    f = F.broadcast(folds.withColumnRenamed(date, "_fm"))
    return df.join(f, F.trunc(date, "MM") == F.col("_fm")).drop("_fm")


def row_folds(
    df: DataFrame,
    order: list[str],
    n_splits: int = 5,
    gap: int = 0,
    test_size: int | None = None,
    max_train_size: int | None = None,
) -> DataFrame:
    """Row-count folds over the total order: equal validation blocks, growing (or capped) train."""
    ranked = global_position(df, order)
    n = ranked.agg(F.count(F.lit(1))).scalar()
    size = F.lit(test_size).cast("bigint") if test_size else F.floor(n / (n_splits + 1))
    out = ranked.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(n_splits))))
    start = n - (F.lit(n_splits + 1) - F.col("fold")) * size
    end = start - gap
    first = F.greatest(F.lit(0), end - max_train_size) if max_train_size else F.lit(0)
    pos = F.col("position")
    role = F.when((pos >= first) & (pos < end), "train").when((pos >= start) & (pos < start + size), "val")
    return out.withColumn("role", role).where("role is not null")


def fold_checks(assigned: DataFrame, keys: list[str], date: str = "month_date") -> DataFrame:
    """Per fold: rows that are both train and val, and whether all training precedes validation."""
    both = assigned.groupBy("fold", *keys, date).agg(F.count_distinct("role").alias("_r"))
    overlap = both.groupBy("fold").agg(F.count_if(F.col("_r") > 1).alias("overlap_rows"))
    ends = assigned.groupBy("fold").agg(
        F.max(F.when(F.col("role") == "train", F.col(date))).alias("train_max"),
        F.min(F.when(F.col("role") == "val", F.col(date))).alias("val_min"),
    )
    return ends.join(overlap, "fold").withColumn("in_order", F.col("train_max") < F.col("val_min"))


def require_valid_folds(checks: DataFrame) -> None:
    """Raise when a fold overlaps or trains on its future."""
    if not checks.where((F.col("overlap_rows") > 0) | ~F.col("in_order")).isEmpty():
        raise ValueError("a fold overlaps or trains on months at or after its validation")
