"""Session settings and the shared folder that cut lineage and intermediate tables go to."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "panelcast", shuffle_partitions: int | None = None, checkpoints: str | None = None) -> SparkSession:
    """A single-JVM session for tests and the benchmark; a cluster brings its own settings.

    ``checkpoints`` is the folder for intermediate tables; the caller owns it and what is left there.
    """
    builder = SparkSession.builder
    if checkpoints:
        builder = builder.config("spark.checkpoint.dir", checkpoints)
    spark = (
        builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only where driver and executors are one process (``local[...]``) may it be a temporary folder;
    on a cluster, also a simulated one, a missing setting is an error.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not configured:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="panelcast-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def _scratch_root(spark: SparkSession) -> str:
    """The application's own folder below the shared one; Hadoop removes it when the driver's JVM ends."""
    sc = spark.sparkContext
    root = f"{shared_dir(spark)}/panelcast-{sc.applicationId}"
    if getattr(sc, "_panelcast_scratch", None) != root:
        path = sc._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        sc._panelcast_scratch = root
    return root


def drop_scratch(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application now; call it when a job's results are stored."""
    sc = spark.sparkContext
    if root := getattr(sc, "_panelcast_scratch", None):
        path = sc._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        sc._panelcast_scratch = None


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table, below the application's folder in the shared one."""
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to a table in the shared folder and read them back.

    Later passes start from the files: they survive executor loss, are pruned by column, and their
    known size lets Spark choose joins.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once a context; needed where executors have not installed it."""
    sc = spark.sparkContext
    if getattr(sc, "_panelcast_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="panelcast-"), "panelcast.zip")  # read by the driver alone, which serves it
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)
    sc._panelcast_shipped = True
