"""Weighted blends of two predictions, ranking of trials and summaries over folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Blend weights 0, 0.05 .. 1.
BLEND_WEIGHTS = tuple(i * 5 / 100 for i in range(21))
# Levels of the verdict on mean and deviation of R2 over folds.
EXCELLENT_R2, GOOD_R2, STABLE_STD = 0.9, 0.8, 0.05


def blend_grid(df: DataFrame, y: str, a: str, b: str, weights: Sequence[float] = BLEND_WEIGHTS) -> DataFrame:
    """R2, MAE and RMSE for every weight of ``a``, from a single pass.

    The squared error of any blend follows from five shared sums; only the absolute error needs
    one sum per weight.  No row is replicated per weight.
    """
    ea, eb = F.col(y) - F.col(a), F.col(y) - F.col(b)
    sums = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(ea * ea).alias("aa"),
        F.sum(ea * eb).alias("ab"),
        F.sum(eb * eb).alias("bb"),
        F.var_pop(y).alias("v"),
        F.array(*[F.avg(F.abs(F.col(y) - (w * F.col(a) + (1 - w) * F.col(b)))) for w in weights]).alias("mae"),
    )
    grid = F.arrays_zip(F.array(*[F.lit(float(w)) for w in weights]).alias("w"), F.col("mae").alias("m"))
    rows = sums.select("n", "aa", "ab", "bb", "v", F.explode(grid).alias("g"))
    w, u = F.col("g.w"), 1 - F.col("g.w")
    sse = w * w * F.col("aa") + 2 * w * u * F.col("ab") + u * u * F.col("bb")
    return rows.select(
        w.alias("weight_a"),
        u.alias("weight_b"),
        (1 - F.try_divide(sse, F.col("v") * F.col("n"))).alias("r2"),
        F.col("g.m").alias("mae"),
        F.sqrt(sse / F.col("n")).alias("rmse"),
    )


def best_blends(grid: DataFrame) -> DataFrame:
    """Best row by MAE, RMSE and R2, with the MAE gain over either model alone."""
    row = F.struct("weight_a", "weight_b", "r2", "mae", "rmse")
    best = grid.agg(
        F.array(
            F.struct(F.lit("mae").alias("metric"), F.min_by(row, "mae").alias("r")),
            F.struct(F.lit("rmse").alias("metric"), F.min_by(row, "rmse").alias("r")),
            F.struct(F.lit("r2").alias("metric"), F.max_by(row, "r2").alias("r")),
        ).alias("_b"),
        F.max(F.when(F.col("weight_a") == 1, F.col("mae"))).alias("_a1"),
        F.max(F.when(F.col("weight_a") == 0, F.col("mae"))).alias("_b1"),
    )
    out = best.select(F.explode("_b").alias("s"), "_a1", "_b1").select("s.metric", "s.r.*", "_a1", "_b1")
    return out.withColumns(
        {
            "gain_over_a_pct": F.try_divide((F.col("_a1") - F.col("mae")) * 100, F.col("_a1")),
            "gain_over_b_pct": F.try_divide((F.col("_b1") - F.col("mae")) * 100, F.col("_b1")),
        }
    ).drop("_a1", "_b1")


def rank_trials(trials: DataFrame, error: str = "val_mae", fit: str = "val_r2", k: int = 10) -> DataFrame:
    """Trials by error ascending, then fit descending."""
    return trials.orderBy(F.asc(error), F.desc(fit)).limit(k)


def fold_summary(folds: DataFrame) -> DataFrame:
    """Mean and population deviation of the fold metrics and a verdict on level and stability."""
    aggs = [F.count(F.lit(1)).alias("n_folds")]
    for c in ("mae", "rmse", "r2"):
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    level = F.when(F.col("r2_mean") >= EXCELLENT_R2, "excellent").when(F.col("r2_mean") >= GOOD_R2, "good")
    return folds.agg(*aggs).withColumns(
        {
            "level": level.otherwise("needs_work"),
            "stability": F.when(F.col("r2_std") < STABLE_STD, "stable").otherwise("variable"),
        }
    )
