"""Mappings and training data under review: differences by file, gaps by category, allowlists, added samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epistola.operators.labels import grouped_categories


def mapping_differences(truth: DataFrame, mapper: DataFrame) -> DataFrame:
    """issue_type, files, file_names, truth_categories, mapper_categories, missing, extra.

    From truth(file_name, issue_type, category) and mapper(issue_type, category): issues that
    both know and whose categories differ in some file; the truth's categories are those of
    the differing files together.
    """
    known = grouped_categories(mapper).withColumnRenamed("categories", "mapper_categories")
    per_file = truth.dropna(subset=["issue_type", "category"]).groupBy("file_name", "issue_type").agg(F.sort_array(F.collect_set("category")).alias("said"))
    differing = per_file.join(known, "issue_type").where("said != mapper_categories")
    found = differing.groupBy("issue_type", "mapper_categories").agg(
        F.count_distinct("file_name").alias("files"), F.sort_array(F.collect_set("file_name")).alias("file_names"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("said")))).alias("truth_categories")
    )
    missing, extra = F.array_except("truth_categories", "mapper_categories"), F.array_except("mapper_categories", "truth_categories")
    return found.withColumns({"missing": missing, "extra": extra})


def missing_by_category(truth: DataFrame, mapper: DataFrame) -> DataFrame:
    """category, missing, issue_types: issues of truth(issue_type, category) that the mapper lacks, under each of their categories."""
    gone = truth.dropna(subset=["issue_type", "category"]).join(mapper.select("issue_type").distinct(), "issue_type", "left_anti")
    return gone.groupBy("category").agg(F.count_distinct("issue_type").alias("missing"), F.sort_array(F.collect_set("issue_type")).alias("issue_types"))


def missing_rows(truth: DataFrame, mapper: DataFrame) -> DataFrame:
    """file_name, issue_type, categories (joined): each issue of a file that the mapper lacks, with its categories in that file."""
    gone = truth.join(mapper.select("issue_type").distinct(), "issue_type", "left_anti")
    return gone.groupBy("file_name", "issue_type").agg(F.array_join(F.sort_array(F.collect_set("category")), ", ").alias("categories"))


def allowlists(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The issues and the categories that a mapping allows, as issue_type and category."""
    return edges.select("issue_type").distinct(), edges.select("category").distinct()


def combine(real: DataFrame, made: DataFrame, source: str = "source") -> DataFrame:
    """Rows of both tables with all columns of either, and where they come from."""
    return real.withColumn(source, F.lit("real")).unionByName(made.withColumn(source, F.lit("synthetic")), allowMissingColumns=True)


def training_file(spark: SparkSession, patterns: Sequence[str]) -> str | None:
    """The newest file of the first pattern that has any; only the listing is read."""
    for pattern in patterns:
        try:
            files = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")
        except Exception as e:  # an absent path is no candidate
            if "PATH_NOT_FOUND" in str(e):
                continue
            raise
        newest = files.orderBy(F.desc("modificationTime"), F.desc("path")).head()
        if newest is not None:
            return newest["path"]
    return None


def file_facts(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, file_name, file_size, modified of a folder's files; contents are not read, files without any are not listed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"))


def context_examples(training: DataFrame, most: int = 3) -> DataFrame:
    """issue_type, place, body: up to `most` training texts per issue, the longest first, as examples for a generator."""
    place = F.row_number().over(Window.partitionBy("issue_type").orderBy(F.desc(F.length("body")), "body"))
    return training.dropna(subset=["body"]).select("issue_type", "body", place.alias("place")).where(F.col("place") <= most)


def generated_samples(answers: DataFrame, per_issue: int) -> DataFrame:
    """issue_type, sample, subject, body: up to per_issue samples from recorded answers(issue_type, answer) of a generator."""
    parsed = F.from_json("answer", "samples array<struct<subject:string,body:string>>")["samples"]
    each = answers.select("issue_type", F.posexplode(parsed).alias("at", "s")).where("s.body != ''")
    sample = F.row_number().over(Window.partitionBy("issue_type").orderBy("at", "s.body"))
    return each.select("issue_type", sample.alias("sample"), "s.subject", "s.body").where(F.col("sample") <= per_issue)


#: Words that augmentation exchanges (fixed values of this library).
SYNONYMS = (("delay", "postponement"), ("payment", "remittance"), ("contract", "agreement"), ("work", "activity"), ("request", "ask for"))


def augmented(c: Column, seed: Column) -> Column:
    """c with each known word exchanged where the md5 of seed and word says so."""
    for word, other in SYNONYMS:
        chosen = F.conv(F.substring(F.md5(F.concat_ws("|", seed.cast("string"), F.lit(word)).cast("binary")), 1, 1), 16, 10).cast("int") < 8
        c = F.when(chosen, F.regexp_replace(c, rf"\b{word}\b", other)).otherwise(c)
    return c
