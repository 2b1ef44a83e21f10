"""Incremental panel, drift and alert tables from newly arrived files."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from panelcast.operators.monitor import alerts, drift_flags, drift_stats
from panelcast.operators.series import DISTRICT, Series
from panelcast.session import scratch_path


def monthly_stream(stream: DataFrame, keys: Sequence[str], date: str, sums: Sequence[str]) -> DataFrame:
    """Running monthly sums per key.  State is one row per key and month, i.e. the panel itself."""
    month = F.date_trunc("month", F.col(date).cast("timestamp")).cast("date").alias("month_date")
    return stream.groupBy(*keys, month).agg(*[F.sum(c).alias(c) for c in sums])


def tumbling_stream(stream: DataFrame, ts: str, keys: Sequence[str], aggs: Sequence[Column], width: str = "1 day",
                    lateness: str = "2 days") -> DataFrame:
    """Tumbling windows under a watermark; ``lateness`` must cover the disorder between files."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    out = timed.groupBy(*keys, F.window(ts, width).alias("_w")).agg(*aggs)
    return out.withColumn("window_start", F.col("_w.start")).drop("_w")


def changed_rows_writer(path: str, then: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: each batch's changed keys go to their own folder.

    A retried batch replaces its folder, so the table stays exact after a failure.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        if then is not None:
            then(batch_id)

    return write


def latest_rows(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Newest version of every key: one map-side-combined aggregate over the batches."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_r"))
    return newest.select(*keys, "_r.*")


def compact(spark: SparkSession, path: str, keys: Sequence[str], out: str) -> None:
    """Newest versions only, written to a fresh table."""
    latest_rows(spark, path, keys).write.mode("errorifexists").parquet(out)


def fold_batches(spark: SparkSession, path: str, keys: Sequence[str], batch_id: int) -> None:
    """Replace the batches up to ``batch_id`` by their newest rows, kept as that batch.

    The folded rows are complete before anything is taken away: they are written beside the table, then
    overwrite the last batch, and only then the earlier folders are emptied.  Interrupted in between, the
    table holds some rows twice with equal values, and the next fold clears them.
    """
    aside = scratch_path(spark, "folded")
    latest_rows(spark, path, keys).write.parquet(aside)
    folded = spark.read.parquet(aside)
    earlier = [r["batch_id"] for r in spark.read.parquet(path).where(F.col("batch_id") < batch_id).select("batch_id").distinct().collect()]
    folded.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    for b in earlier:
        folded.limit(0).write.mode("overwrite").parquet(f"{path}/batch_id={b}")


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process everything that has arrived, then stop; the checkpoint remembers what was read."""
    query = (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(sink)
        .start()
    )
    query.awaitTermination()
    return query


def rows_dropped_as_late(query: StreamingQuery) -> int:
    """Rows the watermark has discarded over the recorded progress of the query."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def require_no_late_rows(query: StreamingQuery) -> None:
    """Fail a run that lost rows to the watermark, so that nobody takes its table for complete."""
    if late := rows_dropped_as_late(query):
        raise ValueError(f"{late} rows came later than the watermark allows and are missing; rerun with a larger lateness")


def refresh_monitoring(panel: DataFrame, y: str, out: str, version: int, s: Series = DISTRICT) -> None:
    """Drift report and alerts of the current panel, written as one version.

    The forecast behind the alerts is the mean of the past three rows.
    """
    drift_flags(drift_stats(panel, s.date, [y])).write.mode("overwrite").parquet(f"{out}/drift/version={version}")
    forecast = panel.select(
        *s.keys, s.date, F.col(y).cast("double").alias("y"), F.avg(y).over(s.prev(3)).alias("yhat"),
        F.lag(y, 1).over(s.w).cast("double").alias("yhat2"),
    ).where("yhat is not null")
    alerts(forecast, [*s.keys, s.date]).write.mode("overwrite").parquet(f"{out}/alerts/version={version}")


def incremental_refresh(spark: SparkSession, stream: DataFrame, keys: Sequence[str], date: str, y: str, out: str,
                        checkpoint: str, compact_every: int = 16) -> StreamingQuery:
    """Monthly panel kept current by the stream; after every increment drift and alerts are rebuilt from it.

    Every ``compact_every`` batches the earlier ones are folded into one, so a refresh reads at most
    that many versions of the panel.
    """
    panel_path = f"{out}/panel"
    s = Series(tuple(keys), "month_date")

    def rebuild(batch_id: int) -> None:
        if batch_id and batch_id % compact_every == 0:
            fold_batches(spark, panel_path, [*keys, "month_date"], batch_id)
        refresh_monitoring(latest_rows(spark, panel_path, [*keys, "month_date"]), y, out, batch_id, s)

    return run_available(monthly_stream(stream, keys, date, [y]), changed_rows_writer(panel_path, rebuild), checkpoint)
