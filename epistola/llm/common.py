"""Helpers shared by the training-data operators: tables, shared storage, Arrow mapping."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epistola.session import share_package

#: Rows and bytes of one Arrow batch, so that a run of very long texts stays small in a Python worker.
BATCH_ROWS, BATCH_BYTES = 2_000, 16 << 20

#: Marks of rows that are broadcast at most (about 100 bytes each).
BROADCAST_MARKS = 500_000

_local_dir: list[str] = []
#: Where the tables lie that this process has written.
_written: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Bound Arrow batches for this session and make the package known to its workers."""
    share_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    A single-process local session (tests) gets a temporary folder when the setting
    is missing; a cluster session without it is an error, never a machine-local folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _local_dir:
        _local_dir.append(tempfile.mkdtemp(prefix="epistola-"))
        atexit.register(shutil.rmtree, _local_dir[0], ignore_errors=True)
    return f"file://{_local_dir[0]}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage is cut, the work is done once,
    and a lost executor costs only a reread. What is not discarded goes when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[out] = path
    place, files = _storage(spark, path)
    files.deleteOnExit(place)
    return out


def discard(*frames: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for frame in frames:
        place, files = _storage(frame.sparkSession, _written.pop(frame))
        files.delete(place, True)


def _storage(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def row_mark(key: str, text: str) -> Column:
    """16 bytes that tell (key, text) of a row from any other."""
    name, body = F.col(f"`{key}`").cast("string"), F.col(f"`{text}`")
    told = F.coalesce(F.concat(F.lit("k"), F.length(name), F.lit(":"), name), F.lit("n"))
    return F.unhex(F.md5(F.concat(told, F.coalesce(F.concat(F.lit("t"), body), F.lit("n"))).cast("binary")))


def keep_marked(docs: DataFrame, decided: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of docs that stay, by decided(mark, kept): one row for each row of docs, whatever their order.

    Rows of equal key and text stay all, or not, or one of them (the least by its other
    columns). Only the marks that lose rows are looked up: broadcast up to BROADCAST_MARKS,
    else by a shuffle of the rows.
    """
    stay = F.sum(F.col("kept").cast("long")).alias("stay")
    lost = materialize(decided.groupBy("mark").agg(F.count(F.lit(1)).alias("n"), stay).where("stay < n").select("mark", "stay"), "lost")
    mark, left = fresh("mark", docs.columns), fresh("stay", docs.columns)
    named = lost.select(F.col("mark").alias(mark), F.col("stay").alias(left))
    if lost.count() <= BROADCAST_MARKS:
        named = F.broadcast(named)
    rows = docs.withColumn(mark, row_mark(key, text)).join(named, mark, "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    whole = rows.where(F.col(left).isNull()).select(*columns)
    if lost.where("stay > 0").isEmpty():
        return whole
    ordered = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    some = rows.where(F.col(left) > 0).groupBy(mark).agg(F.min_by(F.struct(*columns), F.struct(mark, *ordered)).alias("row"))
    return whole.unionByName(some.select("row.*"))


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def fresh(name: str, taken: Sequence[str]) -> str:
    """A column name that begins with `name` and is none of `taken` (whatever their case)."""
    used = {t.lower() for t in taken}
    return next(n for n in (name + "_" * i for i in range(len(used) + 1)) if n.lower() not in used)


def map_rows(
    df: DataFrame,
    inputs: Sequence[str | Column],
    new: Sequence[tuple[str, T.DataType]],
    make: Callable[[], Callable[..., Sequence[Sequence]]],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Append columns computed from whole Arrow columns.

    make() runs once per task and gives a function from the inputs (names or expressions, as
    Python lists) to the new columns (lists). keep names the columns of df that stay, all by
    default; a kept column with the name of a new one gives way to the new one.
    """
    tune(df.sparkSession)
    names = [n for n, _ in new]
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    values = [F.col(f"`{c}`") if isinstance(c, str) else c for c in inputs]
    source = df.select(*[F.col(f"`{c}`") for c in kept], *[v.alias(fresh(f"__in{i}", kept)) for i, v in enumerate(values)])
    schema = T.StructType([*source.schema.fields[: len(kept)], *[T.StructField(n, t) for n, t in new]])
    from pyspark.sql.pandas.types import to_arrow_type

    arrow, n = [to_arrow_type(t) for _, t in new], len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            made = work(*[c.to_pylist() for c in batch.columns[n:]])
            columns = batch.columns[:n] + [pa.array(values, type=t) for values, t in zip(made, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=kept + names)

    return source.mapInArrow(run, schema)
