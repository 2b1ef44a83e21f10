"""Train-only statistics of expanding folds from monthly partials, without a copy of the panel for each fold.

A month of a key leaves count, mean and squared deviations.  Merged along the months they are the statistics of
every prefix; a fold's training rows are one of these prefixes, the last that begins at or before its end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.series import DISTRICT, Series


def prefix_stats(panel: DataFrame, keys: Sequence[str], y: str, date: str = "month_date") -> DataFrame:
    """(keys, month, until, n, mean, std) of all rows of a key up to each of its months; ``until`` is its next month.

    Squared deviations are merged about the key's first mean, so that large values do not cancel.
    """
    x = F.col(y).cast("double")
    month = panel.groupBy(*keys, F.trunc(date, "MM").alias("month")).agg(F.count(x).alias("_n"), F.avg(x).alias("_m"), (F.var_pop(x) * F.count(x)).alias("_s"))
    w = Window.partitionBy(*keys).orderBy("month")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    shifted = month.withColumn("_o", F.first("_m", ignorenulls=True).over(upto)).withColumn("_o", F.first("_o", ignorenulls=True).over(upto))
    d = F.coalesce(F.col("_m") - F.col("_o"), F.lit(0.0))
    sums = shifted.withColumns({"_d": d}).select(
        *keys, "month", "_o", F.lead("month").over(w).alias("until"), F.sum("_n").over(upto).alias("n"),
        F.sum(F.col("_n") * F.col("_d")).over(upto).alias("_a"), F.sum(F.coalesce("_s", F.lit(0.0)) + F.col("_n") * F.col("_d") * F.col("_d")).over(upto).alias("_b"),
    )
    n = F.col("n")
    mean = F.when(n > 0, F.col("_o") + F.col("_a") / n).alias("mean")
    std = F.when(n > 1, F.sqrt(F.greatest(F.col("_b") - F.col("_a") * F.col("_a") / n, F.lit(0.0)) / (n - 1))).alias("std")
    return sums.select(*keys, "month", "until", "n", mean, std)


def _ends(folds: DataFrame, date: str) -> Column:
    """(fold, end) of all folds as one small array."""
    last = folds.where("role = 'train'").groupBy("fold").agg(F.max(date).alias("end"))
    return last.agg(F.collect_list(F.struct("fold", "end"))).scalar()


def fold_stats(panel: DataFrame, folds: DataFrame, keys: Sequence[str], y: str, mean: str = "mean", std: str = "std", date: str = "month_date") -> DataFrame:
    """(fold, keys, mean, std) of the training rows of every fold; ``folds`` is an expanding fold table (fold, role, month).

    A key without training rows in a fold has no row.  Each key and fold takes one prefix; the panel is read once.
    """
    prefixes = prefix_stats(panel, keys, y, date).withColumn("_ends", _ends(folds, date))
    inside = F.filter("_ends", lambda e: (e["end"] >= F.col("month")) & (F.col("until").isNull() | (e["end"] < F.col("until"))))
    found = prefixes.select(*keys, F.explode(inside).alias("_e"), F.col("mean").alias(mean), F.col("std").alias(std))
    return found.select(F.col("_e.fold").alias("fold"), *keys, mean, std)


def fold_group_features(panel: DataFrame, folds: DataFrame, y: str, s: Series = DISTRICT, state: str = "state") -> DataFrame:
    """Rows of all folds with train-only group statistics, past rolling means inside their role and ratio to the state.

    Rolling means of training rows do not depend on the fold and are taken once on the panel; only validation
    months are rolled for each fold.
    """
    w, vw = s, Series(("fold", *s.keys), s.date)
    trained = panel.withColumns({f"rolling_{n}_mean": F.avg(y).over(w.prev(n)) for n in (3, 6)}).withColumn("_ends", _ends(folds, s.date))
    before = F.transform(F.filter("_ends", lambda e: e["end"] >= F.trunc(s.date, "MM")), lambda e: e["fold"])
    train = trained.withColumn("fold", F.explode(before)).withColumn("role", F.lit("train")).drop("_ends")
    months = F.broadcast(folds.where("role = 'val'").select("fold", "role", F.col(s.date).alias("_m")))  # folds x months rows
    val = panel.join(months, F.trunc(s.date, "MM") == F.col("_m")).drop("_m")
    val = val.withColumns({f"rolling_{n}_mean": F.avg(y).over(vw.prev(n)) for n in (3, 6)})
    out = train.unionByName(val.select(*train.columns))
    out = out.join(fold_stats(panel, folds, s.keys, y, "group_long_term_mean", "group_long_term_std", s.date), ["fold", *s.keys], "left")
    out = out.join(fold_stats(panel, folds, [state], y, "_sm", "_ss", s.date), ["fold", state], "left")
    out = out.join(F.broadcast(fold_stats(panel, folds, [], y, "_am", "_as", s.date)), ["fold"], "left")  # one row a fold
    mean, peer = F.coalesce("group_long_term_mean", "_am"), F.coalesce("_sm", "_am")
    return out.withColumns(
        {
            "group_long_term_mean": mean,
            "group_long_term_std": F.coalesce("group_long_term_std", "_as"),
            "rolling_3_mean": F.coalesce("rolling_3_mean", mean),
            "rolling_6_mean": F.coalesce("rolling_6_mean", mean),
            "ratio_to_state_mean": F.when(peer > 0, F.col(y) / peer).otherwise(F.lit(1.0)),
        }
    ).drop("_sm", "_ss", "_am", "_as")
