"""Writers: panels, predictions, metrics, protected tables, logs and the model registry."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_panel(df: DataFrame, path: str, month: str = "year_month", fmt: str = "parquet") -> None:
    """Panel laid out by month so that a month filter reads one folder.

    Rebalancing groups the rows by month for few files, and splits a month that is too large for one task.
    """
    df.hint("rebalance", month).write.mode("overwrite").partitionBy(month).format(fmt).save(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_predictions(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_metrics(metrics: DataFrame, folds: DataFrame, safety: DataFrame, path: str) -> None:
    """Metric documents as JSON, fold and safety tables as CSV."""
    metrics.write.mode("overwrite").json(f"{path}/metrics")
    write_csv(folds, f"{path}/folds")
    write_csv(safety, f"{path}/safety")


def write_once(df: DataFrame, path: str) -> None:
    """Frozen output: an existing one is never overwritten."""
    df.write.mode("errorifexists").parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """Experiment log: rows are only ever added."""
    df.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)


def register_views(frames: Mapping[str, DataFrame]) -> None:
    """Named lazily evaluated views for SQL users."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


def save_model_version(model: Any, registry: str, version: str) -> str:
    """``model`` is an MLlib one or has ``save(spark, path)``."""
    path = f"{registry}/models/{version}"
    if isinstance(model, MLWritable):
        model.write().overwrite().save(path)
    else:
        model.save(SparkSession.active(), path)
    return path


def set_champion(spark: SparkSession, registry: str, version: str, updated_at: str, path: str | None = None) -> None:
    """Promotion is one appended row; nothing is rewritten."""
    row = spark.range(1).select(
        F.lit(version).alias("version"), F.lit(path).cast("string").alias("path"), F.lit(updated_at).cast("timestamp").alias("updated_at")
    )
    row.write.mode("append").parquet(f"{registry}/champions")


def _promotions(spark: SparkSession, registry: str) -> tuple[str | None, int]:
    """Current version and number of promotions so far."""
    log = spark._jvm.org.apache.hadoop.fs.Path(f"{registry}/champions")
    if not log.getFileSystem(spark._jsc.hadoopConfiguration()).exists(log):
        return None, 0
    return current_champion(spark, registry).first()["version"], spark.read.parquet(log.toString()).count()


def champion_version(spark: SparkSession, registry: str) -> str | None:
    """The current version, None before the first promotion."""
    return _promotions(spark, registry)[0]


def promote(spark: SparkSession, registry: str, version: str, over: str | None, updated_at: str, path: str | None = None) -> None:
    """Promotion on condition that ``over`` (None: no version) is still the champion; of two writers one wins.

    The place in the log is claimed by a file that is made only if it does not exist, with the version in it, so
    a writer that died between claim and log can go on.
    """
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(registry).getFileSystem(spark._jsc.hadoopConfiguration())
    current, place = _promotions(spark, registry)
    if current != over:
        raise ValueError(f"the champion is {current}, not {over}")
    claim = fs_path(f"{registry}/claims/{place}")
    if fs.createNewFile(claim):
        out = fs.create(claim, True)
        out.write(bytearray(version.encode()))
        out.close()
    elif spark.read.text(claim.toString()).first()[0] != version:
        raise ValueError(f"another version than {version} has claimed promotion {place}")
    set_champion(spark, registry, version, updated_at, path)


def champions(log: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Current and previous champion out of the promotion log (per key, if given)."""
    w = Window.partitionBy(*keys).orderBy(F.desc("updated_at"), F.desc("version"))
    ranked = log.withColumn("_r", F.row_number().over(w)).where("_r <= 2")
    return ranked.withColumn("slot", F.when(F.col("_r") == 1, "current").otherwise("previous")).drop("_r")


def current_champion(spark: SparkSession, registry: str) -> DataFrame:
    """The latest promotion, found by aggregation only."""
    log = spark.read.parquet(f"{registry}/champions")
    return log.agg(F.max_by(F.struct("version", "path", "updated_at"), F.struct("updated_at", "version")).alias("c")).select("c.*")
