"""Exact deduplication with a heavy-hitter split: Misra-Gries candidates, broadcast winners, ordinary shuffle."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epistola.llm.common import keep_marked, materialize, row_mark, text_of, tune

#: Counters of a Misra-Gries summary; any digest on more than 1 / (COUNTERS + 1) of the rows is among them.
COUNTERS = 255
#: Characters that do not count for equality (fixed values).
BLANKS = " \t\n\x0b\x0c\r"


def normalized(text: str) -> Column:
    return F.translate(text_of(text), BLANKS, "")


def shrink(counts: Counter, k: int) -> Counter:
    """Misra-Gries reduction: subtract the (k+1)-th largest count, so at most k stay positive."""
    if len(counts) <= k:
        return counts
    cut = sorted(counts.values(), reverse=True)[k]
    return Counter({d: c - cut for d, c in counts.items() if c > cut})


def heavy_hitters(rows: DataFrame, digest: str, k: int = COUNTERS) -> DataFrame:
    """At most k digests, among them each one on more than 1/(k+1) of the rows.

    Every task keeps one summary of k counters; summaries add up per digest and the k
    largest sums remain, which is the merge of Misra-Gries summaries.
    """

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            counts.update(batch.column(0).to_pylist())
            counts = shrink(counts, k)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["digest", "n"])

    tune(rows.sparkSession)
    parts = rows.select(digest).mapInArrow(summarize, "digest binary, n long")
    return parts.groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(k).select("digest")


def _decided(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """One row per input row: key, mark, uid, digest, best (struct of the row that stays), group_size."""
    rows = docs.select(
        F.col(f"`{key}`").alias("key"),
        row_mark(key, text).alias("mark"),
        F.length(text_of(text)).alias("n_cp"),
        F.unhex(F.sha2(normalized(text).cast("binary"), 256)).alias("digest"),
        F.monotonically_increasing_id().alias("uid"),
    )
    rows = materialize(rows, "digests")
    best = F.min(F.struct((-F.col("n_cp")).alias("n"), F.col("key").isNull().alias("none"), "key", "mark", "uid")).alias("best")
    size = F.count(F.lit(1)).alias("group_size")
    # at most k digests and so at most k winners
    heavy = materialize(rows.join(F.broadcast(heavy_hitters(rows, "digest", k)), "digest").groupBy("digest").agg(best, size), "winners")
    removed = rows.join(F.broadcast(heavy), "digest")
    light = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    shuffled = light.join(light.groupBy("digest").agg(best, size), "digest")
    return removed.unionByName(shuffled)


def duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = COUNTERS) -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; of equal normalised texts the row with most code points,
    then smallest key (nulls last), then smallest digest of key and text stays. Wholly repeated
    rows: exactly one of them is kept. An empty table gives an empty table; other columns are ignored.
    """
    return _decided(docs, key, text, k).select(
        F.col("key").alias(key),
        F.col("best.key").alias("keep_id"),
        "group_size",
        (F.col("uid") == F.col("best.uid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = COUNTERS) -> DataFrame:
    """The rows that duplicates() keeps, with all their columns; of wholly repeated rows the one that is least in its other columns."""
    decided = _decided(docs, key, text, k).select("mark", (F.col("uid") == F.col("best.uid")).alias("kept"))
    return keep_marked(docs, decided, key, text)
