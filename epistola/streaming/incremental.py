"""Streaming variants: typing of new files, duplicates against history, windowed issue counts, index appends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from epistola.operators.documents import document_type


def new_files(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """A stream of text files: file_name, text; the rate is bounded by files per trigger."""
    raw = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", per_trigger).load(folder)
    return raw.select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))


def typed(stream: DataFrame) -> DataFrame:
    return document_type(stream, "text", file_name=F.col("file_name"))


def issue_counts(events: DataFrame, time: str = "ts", issue: str = "event_type", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts per issue and time window; rows later than `late` are dropped by the watermark."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width), issue).agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", issue, "n")


def against_history(stream: DataFrame, history: DataFrame, block: str = "project") -> DataFrame:
    """New letters joined with stored ones of the same block and letter id (stream-static join)."""
    old = history.select(block, F.trim("letter_id").alias("__k"), F.col("id").alias("original_id"))
    new = stream.withColumn("__k", F.trim("letter_id"))
    return new.join(old, [block, "__k"]).where("id != original_id").drop("__k")


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch through `each`, as for an index append; takes what is there and ends."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_to(path: str) -> Callable[[DataFrame, int], None]:
    """A batch writer that puts each batch under its own number, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
