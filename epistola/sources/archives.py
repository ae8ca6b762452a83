"""A source that lists and streams the members of archives: splits of members instead of one row per archive.

The directory at an archive's end gives names and sizes without reading the rest, so listing costs the same for any
size. Contents come in pieces of PIECE bytes, and a split holds members of about SPLIT bytes, so neither a large archive nor a large
member is ever held whole. Nested archives are unpacked to a temporary file of the task that reads them, as their directory
is at their end too. Files are opened by path on the executors: a mounted store, not one that only Spark's own readers reach.
"""

from __future__ import annotations

import glob
import os
import tempfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from epistola.session import share_package

#: Bytes of a piece of content and of the members of one split.
PIECE, SPLIT = 4 << 20, 64 << 20
#: Nested archives are opened down to this depth.
DEPTH = 3
SCHEMA = "path string, member string, size long, modified string, piece int, content binary, error string"
_BROKEN = (zipfile.BadZipFile, RuntimeError, OSError, NotImplementedError)


@dataclass
class Members(InputPartition):
    path: str
    members: list[str]
    error: str | None = None


def wanted(info: zipfile.ZipInfo) -> bool:
    """Not a folder, a hidden file or a system's own."""
    return not (info.is_dir() or info.filename.rsplit("/", 1)[-1].startswith(".") or "__MACOSX" in info.filename)


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.pattern, self.listing = options["path"].removeprefix("file://"), options.get("content", "true").lower() == "false"

    def partitions(self) -> list[Members]:
        """Members of about SPLIT bytes of one archive each; a broken archive is a split with its error."""
        splits = []
        for path in sorted(glob.glob(self.pattern, recursive=True)):
            if os.path.isdir(path):
                continue
            try:
                with zipfile.ZipFile(path) as z:
                    room, names = SPLIT, []
                    for info in filter(wanted, z.infolist()):
                        if names and info.file_size > room and not self.listing:
                            splits.append(Members(path, names))
                            room, names = SPLIT, []
                        names.append(info.filename)
                        room -= info.file_size
                    splits.append(Members(path, names))
            except _BROKEN as e:
                splits.append(Members(path, [], str(e)))
        return splits

    def read(self, partition: Members | None) -> Iterator[tuple]:
        if partition is None:  # no archive at all
            return
        if partition.error is not None:
            yield partition.path, None, None, None, None, None, partition.error
            return
        with zipfile.ZipFile(partition.path) as z:
            for name in partition.members:
                yield from self._member(partition.path, z, z.getinfo(name), "", DEPTH)

    def _member(self, path: str, z: zipfile.ZipFile, info: zipfile.ZipInfo, prefix: str, depth: int) -> Iterator[tuple]:
        facts = (path, prefix + info.filename, info.file_size, "{:04d}-{:02d}-{:02d}T{:02d}:{:02d}:{:02d}".format(*info.date_time))
        try:
            if info.filename.lower().endswith(".zip") and depth > 1:
                yield from self._nested(path, z, info, prefix, depth)
            elif self.listing:
                yield *facts, 0, None, None
            else:
                with z.open(info) as member:
                    piece = 0
                    while (content := member.read(PIECE)) or not piece:
                        yield *facts, piece, content, None
                        piece += 1
        except _BROKEN as e:
            yield *facts, None, None, str(e)

    def _nested(self, path: str, z: zipfile.ZipFile, info: zipfile.ZipInfo, prefix: str, depth: int) -> Iterator[tuple]:
        with tempfile.TemporaryFile() as held:
            with z.open(info) as member:
                while content := member.read(PIECE):
                    held.write(content)
            held.seek(0)
            with zipfile.ZipFile(held) as inner:
                for each in filter(wanted, inner.infolist()):
                    yield from self._member(path, inner, each, f"{prefix}{info.filename}/", depth - 1)


class ArchiveSource(DataSource):
    """spark.read.format("archives").load(pattern): one row per member and piece; option content=false lists only."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)


def members(spark: SparkSession, pattern: str, content: bool = True) -> DataFrame:
    """path, member, size, modified, piece, content, error of the archives that match a path pattern (** for any depth of folders).

    An empty member has one empty piece; a broken archive or member has a row with its error.
    """
    share_package(spark)
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archives").option("content", str(content).lower()).load(pattern)


#: Members that hold an office document's properties, and their fields (fixed values).
PROPERTY_FILES = ("docProps/core.xml", "docProps/app.xml")
PROPERTIES = {"title": "title", "creator": "author", "subject": "subject", "Pages": "page_count", "Words": "words", "created": "created", "modified": "modified"}


def document_properties(spark: SparkSession, pattern: str) -> DataFrame:
    """path, file_size, title, author, subject, page_count, words, created, modified, error of office documents: null where not said."""
    found = members(spark, pattern)
    kinds = ", ".join(f"{p} string" for p in PROPERTIES.values())

    @F.pandas_udf(f"struct<{kinds.replace(' string', ': string')}>")
    def parsed(contents: pd.Series) -> pd.DataFrame:
        rows = []
        for content in contents:
            row = dict.fromkeys(PROPERTIES.values())
            try:
                for node in ElementTree.fromstring(content).iter():
                    name = PROPERTIES.get(node.tag.rsplit("}", 1)[-1])
                    if name and node.text:
                        row[name] = node.text
            except ElementTree.ParseError:
                pass  # a property file that cannot be read says nothing
            rows.append(row)
        return pd.DataFrame(rows, columns=list(PROPERTIES.values()))

    said = found.where(F.col("member").isin(*PROPERTY_FILES) & (F.col("piece") == 0)).select("path", parsed("content").alias("p"))
    facts = said.groupBy("path").agg(*[F.max(f"p.{c}").alias(c) for c in PROPERTIES.values()])
    whole = members(spark, pattern, content=False).groupBy("path").agg(F.sum("size").alias("file_size"), F.max("error").alias("error"))
    numbers = {c: F.col(c).cast("long") for c in ("page_count", "words")}
    return whole.join(facts, "path", "left").withColumns(numbers).select("path", "file_size", *PROPERTIES.values(), "error")
