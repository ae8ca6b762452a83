"""SparkSession factory with the settings every plan here assumes."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "epistola", master: str | None = None, **conf: str) -> SparkSession:
    """Build or fetch a session: UTC, AQE with skew handling, Arrow, ANSI mode."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.ansi.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Rows and bytes of an Arrow batch at most: what a Python worker holds at once does not grow with the table.
BATCH_ROWS, BATCH_BYTES = 2_000, 16 << 20


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def share_package(spark: SparkSession) -> None:
    """Let Python workers of a local session find this package wherever the driver found it."""
    root, known = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(p for p in (root, known) if p)


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name on the storage that driver and executors share (spark.checkpoint.dir), removed when the JVM ends.

    A single-process local session without that setting gets a temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file://{tempfile.gettempdir()}"
    folder = f"{path.rstrip('/')}/epistola-{label}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return folder


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written once to shared storage and read again: what is used several times is computed once, and a lost executor costs a reread."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
