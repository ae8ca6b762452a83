"""The likeness of texts in the JVM: Alike.java, compiled once a session by Spark's own compiler and sent to the executors as a jar."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAME = "epistola_alike"


def share_alike(spark: SparkSession) -> None:
    """Register the function with a session."""
    if spark.catalog.functionExists(NAME):
        return
    compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
    compiler.cook(Path(__file__).with_name("Alike.java").read_text())
    handle, jar = tempfile.mkstemp(prefix="epistola-alike-", suffix=".jar")
    with os.fdopen(handle, "wb") as file, zipfile.ZipFile(file, "w") as made:
        for name, code in compiler.getBytecodes().items():
            made.writestr(name.replace(".", "/") + ".class", bytes(code))
    spark._jvm.java.io.File(jar).deleteOnExit()
    spark.sql(f"ADD JAR '{jar}'")
    made = compiler.getClassLoader().loadClass("epistola.Alike").getDeclaredConstructor(None).newInstance(None)
    spark._jsparkSession.udf().register(NAME, made, spark._jvm.org.apache.spark.sql.types.DataType.fromJson(T.DoubleType().json()))


def words_of(words: Column) -> Column:
    """An array of words without blanks as alike() takes it."""
    return F.array_join(F.transform(words, lambda w: F.concat(F.lit(" "), w)), "")


def alike(a: Column, b: Column, a_words: Column, b_words: Column, least: Column) -> Column:
    """The larger of the sequence ratio of two strings (1 for equal ones) and the Jaccard of their words (words_of), null below `least`.

    The session needs share_alike().
    """
    raw = lambda c: c.cast("binary")
    return F.call_function(NAME, raw(a), raw(b), raw(a_words), raw(b_words), least)
