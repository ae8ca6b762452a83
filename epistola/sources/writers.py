"""Sinks: report sheets, results, mappings, reports. Each sheet is a table of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epistola.functions.text import report_evidence, shorten
from epistola.sources import readers

FORMS = ("parquet", "json", "csv")


def write(df: DataFrame, path: str, form: str = "parquet") -> None:
    if form not in FORMS:
        raise ValueError(f"form is one of {FORMS}")
    flat = df.withColumns({c: F.to_json(c) for c, t in df.dtypes if form == "csv" and t.startswith(("array", "struct", "map"))})
    writer = flat.write.mode("overwrite")
    writer.option("header", True).csv(path) if form == "csv" else getattr(writer, form)(path)


def batch_report(results: DataFrame, windows: DataFrame, stats: DataFrame, path: str, form: str = "parquet") -> None:
    """The sheets results, details, windows and stats, by file (and window), ties by all columns."""
    summary = results.withColumn("body", shorten(F.col("body"), 500, 500)) if "body" in results.columns else results
    details = results.withColumn("evidence", report_evidence(F.col("evidence"))) if "evidence" in results.columns else results
    for name, sheet in (("results", summary), ("details", details), ("windows", windows), ("stats", stats)):
        order = [c for c, t in sheet.dtypes if not t.startswith(("map", "variant"))]
        keys = [c for c in ("file_name", "doc_id", "window_id") if c in order]
        write(sheet.orderBy(*keys, *[c for c in order if c not in keys]), f"{path}/{name}", form)


def text_parts(rows: DataFrame, path: str, by: str, text: str = "text", most: int | None = None) -> None:
    """The texts as files under `by`=.../part=..., about a quarter of `most` bytes each (of the largest file that readers.files takes), however many rows a value of `by` has."""
    room = max((most or readers.MAX_BYTES) // 4, 1)
    parts = rows.groupBy(F.col(by).alias("__by")).agg(F.ceil(F.sum(F.octet_length(text) + F.lit(1).cast("long")) / room).cast("int").alias("__n"))
    given = rows.join(F.broadcast(parts), F.col(by).eqNullSafe(F.col("__by")))
    dealt = given.select(by, F.pmod(F.xxhash64(*rows.columns), F.greatest("__n", F.lit(1))).cast("int").alias("part"), text)
    dealt.repartition(by, "part").write.partitionBy(by, "part").text(path)


def result_json(df: DataFrame) -> DataFrame:
    """One JSON text per row."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def database_rows(matches: DataFrame) -> DataFrame:
    """Duplicate matches with ISO times as text."""
    times = {c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") for c, t in matches.dtypes if t in ("timestamp", "date")}
    return matches.withColumns(times) if times else matches
