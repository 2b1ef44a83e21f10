"""Group statistics, peer ratios, lookups with default and category encodings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.numbers import safe_ratio
from panelcast.operators.ranking import distinct_index


def group_stats(df: DataFrame, keys: Sequence[str], y: str, mean: str = "group_long_term_mean",
                std: str = "group_long_term_std") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(y).alias(mean), F.stddev_samp(y).alias(std))


def add_group_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of fitted statistics; the join side is chosen from its measured size at run time."""
    return df.join(stats, list(keys), "left")


def lookup(df: DataFrame, dim: DataFrame, keys: Sequence[str], value: str, default: float | int) -> DataFrame:
    """Left join of one value with a default for missing keys."""
    joined = df.join(dim.select(*keys, value), list(keys), "left")
    return joined.withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def add_peer_mean(df: DataFrame, by: Sequence[str], y: str, name: str) -> DataFrame:
    """Mean of the peers (e.g. state at the same month) on every row.

    An aggregate joined back, not a window: partial means are combined before the shuffle, so a
    large state does not have to be sorted in one task.
    """
    return df.join(df.groupBy(*by).agg(F.avg(y).alias(name)), list(by), "left")


def add_distinct_count(df: DataFrame, by: Sequence[str], of: str, name: str) -> DataFrame:
    """Distinct ``of`` per ``by`` on every row: two-level aggregate, joined back."""
    n = df.select(*by, of).distinct().groupBy(*by).agg(F.count(of).alias(name))
    return df.join(n, list(by), "left")


def ratio_to_peers(df: DataFrame, y: str, by: Sequence[str] = ("state", "month_date"),
                   name: str = "ratio_to_state_mean") -> DataFrame:
    """Value over the peer mean; 1 where that mean is not positive."""
    peers = add_peer_mean(df, by, y, "_peer")
    return peers.withColumn(name, safe_ratio(F.col(y), F.col("_peer"), 1.0)).drop("_peer")


def fit_label_index(train: DataFrame, col: str) -> DataFrame:
    """Encoder table: sorted distinct training values with their position."""
    return distinct_index(train, col, f"{col}_idx")


def apply_label_index(df: DataFrame, encoder: DataFrame, col: str) -> DataFrame:
    """Position of the value in the encoder; -1 for values it has not seen."""
    return lookup(df, encoder, [col], f"{col}_idx", -1)


def one_hot(df: DataFrame, cols: Sequence[str]) -> Pipeline:
    """Index + one-hot stages; unseen values map to the all-zero vector."""
    stages = []
    for c in cols:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}_sidx", handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCol=f"{c}_sidx", outputCol=f"{c}_vec"))
    return Pipeline(stages=stages)
