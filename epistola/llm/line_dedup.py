"""Line deduplication: hashes by range with a secondary sort, first occurrences streamed, keep bitmaps returned.

Lines leave their documents as (digest, document, position). Digests are dealt by range and each range is
sorted by digest, document (largest first) and position, so one pass sees the document that keeps a line first
and the others after it. What comes back are the positions that go, as one compressed bitmap per document.
Digests on more than 1/256 of the lines would be too much for one range: a Misra-Gries pass finds
them, their exact figures are aggregated and broadcast, and their lines are judged where they lie.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epistola.llm.common import BROADCAST_MARKS, discard, fresh, map_rows, materialize, row_mark, tune
from epistola.llm.exact_dedup import heavy_hitters

#: Characters that are stripped from both ends of a line (fixed values).
BLANKS = b" \t\n\x0b\x0c\r"
#: Least code points of a line that can be dropped, and documents that must hold it.
LEAST_CHARACTERS, LEAST_DOCUMENTS = 40, 5
#: Bytes of bitmaps that are broadcast at most.
BROADCAST_BYTES = 64 << 20
#: Lines of one Arrow batch that leaves a task.
_FLUSH = 50_000
_INSIDE = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that begin no code point
_LINE = [("digest", pa.binary()), ("mark", pa.binary()), ("position", pa.int32()), ("n_lines", pa.int32())]


def line_key(line: bytes, least: int = LEAST_CHARACTERS) -> bytes | None:
    """The line stripped and with A-Z in lower case; None if it has too few code points."""
    key = line.strip(BLANKS).lower()
    if len(key) < least or (len(key) < 4 * least and len(key.translate(None, _INSIDE)) < least):
        return None
    return key


def _lines(docs: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """A row per line that may be dropped: doc, digest, mark (of the row's key and text), position, n_lines."""
    tune(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").alias("doc"), row_mark(key, text).alias("mark"), F.col(f"`{text}`").cast("binary").alias("body"))
    schema = T.StructType([rows.schema["doc"], *T._parse_datatype_string("digest binary, mark binary, position int, n_lines int").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source: list[int] = []
            found: list[list] = [[], [], [], []]

            def flush(batch=batch) -> pa.RecordBatch:
                arrays = [pa.array(values, kind) for values, (_, kind) in zip(found, _LINE, strict=True)]
                out = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source, pa.int64())), *arrays], names=["doc", *[n for n, _ in _LINE]])
                source.clear()
                for values in found:
                    values.clear()
                return out

            marks = batch.column(1).to_pylist()
            for i in range(batch.num_rows):
                parts = (batch.column(2)[i].as_py() or b"").split(b"\n")
                for position, line in enumerate(parts):
                    if name := line_key(line, least):
                        source.append(i)
                        for values, value in zip(found, (hashlib.md5(name, usedforsecurity=False).digest(), marks[i], position, len(parts)), strict=True):
                            values.append(value)
                if len(source) >= _FLUSH:
                    yield flush()
            if source:
                yield flush()

    return rows.mapInArrow(run, schema)


def _words(digests: pa.Array) -> np.ndarray:
    fixed = digests.cast(pa.binary(16))
    return np.frombuffer(fixed.buffers()[1], "<u8", 2 * len(fixed), 16 * fixed.offset).reshape(-1, 2)


def _later_occurrences(batches: Iterator[pa.RecordBatch], documents: int) -> Iterator[pa.RecordBatch]:
    """Rows of sorted (digest, doc, ...) that do not belong to the first doc of a digest with enough docs.

    Held between batches: the rows of an unfinished digest while it has fewer than `documents`
    documents; afterwards only its name, for all rows that follow go.
    """
    held, gone = None, None
    for batch in batches:
        if gone is not None:
            same = pc.equal(batch.column("digest"), gone)
            n = pc.sum(same).as_py() or 0  # sorted: they lead
            if n:
                yield batch.slice(0, n)
            if n == batch.num_rows:
                continue
            batch, gone = batch.slice(n), None
        if held is not None:
            batch = pa.concat_batches([held, batch])
            held = None
        if not batch.num_rows:
            continue
        digest, doc = _words(batch.column("digest")), batch.column("doc").dictionary_encode("encode").indices.to_numpy()
        new_digest = np.append(True, (digest[1:] != digest[:-1]).any(axis=1))
        new_doc = new_digest | np.append(True, doc[1:] != doc[:-1])
        group, seen, start = np.cumsum(new_digest) - 1, np.cumsum(new_doc), np.flatnonzero(new_digest)
        rank = seen - seen[start][group]
        total = rank[np.append(start[1:], len(rank)) - 1] + 1
        later = (rank > 0) & (total >= documents)[group]
        if total[-1] >= documents:
            gone = batch.column("digest")[-1]
        else:
            held = batch.slice(int(start[-1]))
        if later.any():
            yield batch.filter(pa.array(later))


def _lost_lines(lines: DataFrame, documents: int) -> DataFrame:
    """The lines that go."""
    # at most COUNTERS digests, and so at most as many winners
    heavy = materialize(heavy_hitters(lines, "digest"), "frequent-lines")
    figures = lines.join(F.broadcast(heavy), "digest").groupBy("digest").agg((F.count_distinct("doc") + F.max(F.col("doc").isNull().cast("int"))).alias("documents"), F.max("doc").alias("keeper"))
    winners = materialize(figures.where(F.col("documents") >= documents).select("digest", "keeper"), "line-winners")
    near = lines.join(F.broadcast(winners), "digest").where(~F.col("doc").eqNullSafe(F.col("keeper"))).select(lines.columns)
    light = lines.join(F.broadcast(heavy), "digest", "left_anti").select(lines.columns)
    dealt = light.repartitionByRange("digest").sortWithinPartitions("digest", F.col("doc").desc_nulls_last(), "mark", "position")
    far = dealt.mapInArrow(lambda batches: _later_occurrences(batches, documents), lines.schema)
    return near.unionByName(far)


def bitmaps(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_CHARACTERS, documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """One row per document that loses lines: key, mark (of key and text), n_lines, n_dropped, keep.

    keep has one bit per line, the first in the lowest bit, 1 for lines that stay, compressed by zlib.
    A line's key is the line without blanks at both ends, A-Z in lower case. A key of `least` code points or
    more that `documents` different keys of documents hold loses all its lines but those of the largest key. A null key
    is one document, less than any other; rows of equal key count as one document. Other columns are ignored.
    An empty table gives an empty table.
    """
    lines = materialize(_lines(docs, key, text, least), "lines")
    lost = _lost_lines(lines, documents)
    by_doc = lost.groupBy("mark", "n_lines").agg(F.first("doc").alias("doc"), F.collect_set("position").alias("positions"))

    def make():
        def pack(sizes, positions):
            keep = []
            for n, gone in zip(sizes, positions, strict=True):
                bits = np.ones(n, np.uint8)
                bits[gone] = 0
                keep.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes()))
            return [len(gone) for gone in positions], keep

        return pack

    packed = map_rows(by_doc, ["n_lines", "positions"], [("n_dropped", T.LongType()), ("keep", T.BinaryType())], make, keep=["doc", "mark", "n_lines"])
    out = materialize(packed.select(F.col("doc").alias(key), "mark", F.col("n_lines").cast("long").alias("n_lines"), "n_dropped", "keep"), "bitmaps")
    discard(lines)
    return out


def kept_lines(text: bytes, keep: bytes) -> tuple[bytes, int]:
    """The text without the lines that go, and how many go."""
    lines = text.split(b"\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines), bitorder="little")
    return b"\n".join(line for line, stays in zip(lines, bits, strict=True) if stays), len(lines) - int(bits.sum())


def apply(docs: DataFrame, kept: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with n_lines (before dropping), n_dropped and kept_text, by bitmaps() of the same table.

    Null and empty texts have one empty line. Bitmaps are broadcast while they are few and
    small (BROADCAST_MARKS, BROADCAST_BYTES), else rows and bitmaps are shuffled by mark.
    A column of docs with the name of a new one gives way to it.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("n_lines", "n_dropped", "kept_text")]
    mark, bits, body = fresh("mark", docs.columns), fresh("keep", docs.columns), fresh("body", docs.columns)
    named = kept.select(F.col("mark").alias(mark), F.col("keep").alias(bits))
    size = kept.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("keep")), F.lit(0)).alias("bytes")).first()
    if size["n"] <= BROADCAST_MARKS and size["bytes"] <= BROADCAST_BYTES:
        named = F.broadcast(named)
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("binary").alias(body), row_mark(key, text).alias(mark)).join(named, mark, "left")

    def make():
        def unpack(texts, bitmaps):
            made = [kept_lines(t or b"", b) if b is not None else (t or b"", 0) for t, b in zip(texts, bitmaps, strict=True)]
            return [(t or b"").count(b"\n") + 1 for t in texts], [n for _, n in made], [left for left, _ in made]

        return unpack

    new = [("n_lines", T.LongType()), ("n_dropped", T.LongType()), ("kept_text", T.BinaryType())]
    made = map_rows(rows, [body, bits], new, make, keep=names)
    return made.withColumn("kept_text", F.col("kept_text").cast("string"))
