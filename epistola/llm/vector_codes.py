"""Vector code compression: a codebook per part of the vector, trained by Lloyd rounds with Hamerly's bounds.

Every vector keeps, for each of its parts, the entry it has, an upper bound of the distance to it and one lower
bound of the distance to the second-nearest entry. After a round the bounds move by how far entries have
moved; a part whose upper bound is strictly below its lower bound keeps its entry unseen, and all others
are compared with the whole codebook in integers, lowest index first among equals. Bounds are rounded outwards,
so they never decide what the integers would not. The codebooks (entries x dimensions integers) are all that the driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epistola.llm.common import BROADCAST_MARKS, discard, materialize, tune

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integers beyond this count as this: squared distances of parts of up to 64 components stay in 64 bits.
LARGEST = 1 << 27


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component."""
    bound = float(LARGEST)
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(bound)), F.lit(-bound))).cast("int"))


def usable(vector: Column) -> Column:
    """True for vectors without null or non-finite components."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def _up(x: np.ndarray) -> np.ndarray:
    """float32 values that are not less than x."""
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def _root_up(squared: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(squared.astype(np.float64)), np.inf)


def _root_down(squared: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(squared.astype(np.float64)), -np.inf)


def scan(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (the lowest of equals), its squared distance and that of the second-nearest, exact in integers."""
    d = (points * points).sum(1)[:, None] - 2 * (points @ entries.T) + (entries * entries).sum(1)
    code = d.argmin(1)
    rows = np.arange(len(points))
    least = d[rows, code]
    d[rows, code] = np.iinfo(np.int64).max
    return code, least, d.min(1)


def drift(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far at most each entry (parts x entries) has moved, and how far at most any other entry of its part."""
    moved = _root_up(((new - old) ** 2).sum(2))
    others = np.zeros_like(moved)
    if moved.shape[1] > 1:
        ranked = np.sort(moved, axis=1)
        most = moved.argmax(1)
        others[:] = ranked[:, -1:]
        others[np.arange(len(moved)), most] = ranked[:, -2]
    return moved, others


def reassign(points: np.ndarray, codes: np.ndarray, upper: np.ndarray, lower: np.ndarray, old: np.ndarray, new: np.ndarray) -> int:
    """Move codes and bounds (rows x parts, in place) from the old to the new codebooks; the number of full scans.

    points: rows x parts x components of a part.
    """
    moved, others = drift(old, new)
    scans = 0
    for p in range(points.shape[1]):
        a = codes[:, p]
        upper[:, p] = _up(np.nextafter(upper[:, p].astype(np.float64) + moved[p][a], np.inf))
        lower[:, p] = _down(np.nextafter(lower[:, p].astype(np.float64) - others[p][a], -np.inf))
        open_ = np.flatnonzero(~(upper[:, p] < lower[:, p]))
        if len(open_):
            x = points[open_, p]
            upper[open_, p] = _up(_root_up(((x - new[p][codes[open_, p]]) ** 2).sum(1)))
            open_ = open_[~(upper[open_, p] < lower[open_, p])]
        if len(open_):
            codes[open_, p], least, second = scan(points[open_, p], new[p])
            upper[open_, p], lower[open_, p] = _up(_root_up(least)), _down(_root_down(second))
            scans += len(open_)
    return scans


def _points(column: pa.Array, width: int, parts: int) -> np.ndarray:
    """rows x parts x components; vectors that are too short are filled with zeros."""
    sizes, flat = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < np.asarray(sizes)[:, None]] = flat
    return out.reshape(len(column), parts, -1)


def _bytes(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


def _rows(column: pa.Array, kind: type, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, parts).copy()


_STATE = [("codes", pa.binary()), ("upper", pa.binary()), ("lower", pa.binary())]


def _first_state(rows: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    """rows with codes and bounds of every part, each by a full scan."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _points(batch.column("ints"), width, parts)
            found = [scan(points[:, p], books[p]) for p in range(parts)]
            codes, least, second = (np.stack([f[i] for f in found], 1) for i in range(3))
            made = [_bytes(codes.astype(np.uint8)), _bytes(_up(_root_up(least))), _bytes(_down(_root_down(second)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *[n for n, _ in _STATE]])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *[T.StructField(n, T.BinaryType()) for n, _ in _STATE]]))


def _next_state(state: DataFrame, old: np.ndarray, new: np.ndarray, width: int) -> DataFrame:
    parts = len(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _points(batch.column("ints"), width, parts)
            codes, upper, lower = (_rows(batch.column(n), kind, parts) for n, kind in (("codes", np.uint8), ("upper", np.float32), ("lower", np.float32)))
            reassign(points, codes, upper, lower, old, new)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], _bytes(codes), _bytes(upper), _bytes(lower)], names=batch.schema.names)

    return state.mapInArrow(run, state.schema)


def _moved(state: DataFrame, books: np.ndarray, width: int) -> np.ndarray:
    """The codebooks with every used entry at floor(sum / count): each task sums its own rows, Spark adds the sums."""
    parts, entries, size = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, size), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            points, codes = _points(batch.column("ints"), width, parts), _rows(batch.column("codes"), np.uint8, parts)
            for p in range(parts):
                np.add.at(sums[p], codes[:, p], points[:, p])
                counts[p] += np.bincount(codes[:, p], minlength=entries)
        used = np.argwhere(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used[:, 0], pa.int32()), pa.array(used[:, 1], pa.int32()), pa.array(counts[*used.T], pa.int64()), pa.array(list(sums[*used.T]), pa.list_(pa.int64()))],
            names=["part", "entry", "n", "sums"],
        )

    told = state.select("ints", "codes").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    added = told.select("part", "entry", "n", F.posexplode("sums").alias("i", "x")).groupBy("part", "entry", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    out = books.copy()
    for r in added.collect():  # parts x entries x components rows at most
        out[r["part"], r["entry"], r["i"]] = r["x"] // r["n"]
    return out


def encode(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray]:
    """(rows, codebooks): key, label, codes (one byte per part) and error of every usable vector; codebooks as parts x entries x components.

    Vectors that are null or hold a null or non-finite component are left out. The codebooks begin with the
    vectors of the `entries` smallest keys (nulls last; of equal keys the smaller vector first), fewer if
    there are fewer vectors, and move in `rounds` rounds. The width is that of the longest vector, filled up to a
    multiple of `parts`; shorter vectors are filled with zeros. Integers beyond LARGEST count as LARGEST.
    An empty table gives no rows and codebooks without entries. At most 256 entries.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    tune(df.sparkSession)
    named = F.col(f"`{label}`") if label else F.lit(None).cast("int")
    rows = df.where(usable(F.col(f"`{vector}`"))).select(F.col(f"`{key}`").alias("key"), named.alias("label"), integers(F.col(f"`{vector}`"), scale).alias("ints"))
    first = [r["ints"] for r in rows.orderBy(F.col("key").asc_nulls_last(), "ints").limit(entries).collect()]
    width = -(-(rows.agg(F.max(F.size("ints"))).first()[0] or 0) // parts) * parts
    books = np.zeros((len(first), width), np.int64)
    for i, x in enumerate(first):
        books[i, : len(x)] = x
    books = np.ascontiguousarray(books.reshape(len(first), parts, width // parts).transpose(1, 0, 2))
    if not first:
        return rows.select("key", "label", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("long").alias("error")).limit(0), books
    state = materialize(_first_state(rows, books, width), "codes")
    for _ in range(rounds):
        old, books = books, _moved(state, books, width)
        last, state = state, materialize(_next_state(state, old, books, width), "codes")
        discard(last)
    return _with_errors(state, books, width), books


def _with_errors(state: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, codes = _points(batch.column("ints"), width, parts), _rows(batch.column("codes"), np.uint8, parts)
            error = sum(((points[:, p] - books[p][codes[:, p]]) ** 2).sum(1) for p in range(parts))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), batch.column("codes"), pa.array(error, pa.int64())], names=["key", "label", "codes", "error"])

    kept = state.select("key", "label", "ints", "codes")
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields[:2], kept.schema["codes"], T.StructField("error", T.LongType())]))


def with_label_errors(rows: DataFrame) -> DataFrame:
    """rows with label_error, the errors of equal labels added up (nulls together): sums are broadcast while they are few."""
    rows = materialize(rows, "errors")
    sums = materialize(rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "named"), "label-errors")
    if sums.count() <= BROADCAST_MARKS:
        sums = F.broadcast(sums)
    return rows.join(sums, F.col("label").eqNullSafe(F.col("named"))).drop("named")


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
