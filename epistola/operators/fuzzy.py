"""Pairs of similar strings without comparing all of them, and without losing one."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epistola.functions.similarity import ratio_from
from epistola.session import share_package

#: Subsequences of a string at most, for the look-up of short strings by them.
MOST_SUBSEQUENCES = 500


def _tokens(names: DataFrame, block: Sequence[str], column: str) -> DataFrame:
    """block, column, size, token: every character with the number of its occurrence, so that a string is a set."""
    chars = names.select(*block, column, F.length(column).alias("size"), F.posexplode(F.split(F.col(column), "")).alias("at", "c")).where("c != ''")
    times = F.row_number().over(Window.partitionBy(*block, column, "c").orderBy("at"))
    return chars.select(*block, column, "size", F.concat("c", times.cast("string")).alias("token"))


def _by_rarest(left: DataFrame, right: DataFrame, cutoff: float, block: Sequence[str] = ()) -> DataFrame:
    """(*block, a, b) of the pairs that may have a sequence ratio from `cutoff` on.

    A ratio of c needs n = c (|a| + |b|) / 2 characters in common. With the characters of both sorted rarest
    first, the first that they share must have n - 1 others behind it on either side, so
    of each string only the first |s| - c / (2 - c) |s| + 1 are looked up, and a pair that meets too late in either goes.
    """
    one, other = _tokens(left, block, "a"), _tokens(right, block, "b")
    both = one.select(*block, "token").unionByName(other.select(*block, "token"))
    known = both.groupBy(*block, "token").agg(F.count(F.lit(1)).alias("n"))

    def rarest(tokens: DataFrame, column: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*block, column).orderBy("n", "token"))
        need = F.ceil(F.col("size") * (cutoff / (2 - cutoff)) - 1e-9)
        kept = tokens.join(known, [*block, "token"]).withColumn("place", place).where(F.col("place") <= F.col("size") - need + 1)
        return kept.select(*block, column, F.col("size").alias(f"size_{column}"), (F.col("size") - F.col("place") + 1).alias(f"left_{column}"), "token")

    enough = f"2 * least(left_a, left_b) >= {cutoff - 1e-9!r} * (size_a + size_b)"
    return rarest(one, "a").join(rarest(other, "b"), [*block, "token"]).where(enough).select(*block, "a", "b").distinct()


def _common(n: int, m: int, cutoff: float) -> int:
    """Characters that strings of n and m characters have in common, in order, for a ratio of `cutoff`."""
    return max(math.ceil(cutoff * (n + m) / 2 - 1e-9), 1)


def _lengths(n: int, longest: int, cutoff: float) -> list[int]:
    """Lengths of the subsequences that a string of n characters shares with those of up to `longest`."""
    return sorted({k for m in range(1, longest + 1) if (k := _common(n, m, cutoff)) <= min(n, m)})


def short_size(cutoff: float) -> int:
    """The largest size up to which every string has few subsequences to look up."""
    few = lambda s: all(sum(math.comb(n, k) for k in _lengths(n, s, cutoff)) <= MOST_SUBSEQUENCES for n in range(1, s + 1))
    return max((s for s in range(0, 33) if few(s)), default=0)


def _subsequences(names: DataFrame, column: str, longest: int, cutoff: float) -> DataFrame:
    """Every column of names, size, k and part: the hash of each subsequence of k characters that a partner of up to `longest` must share."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names.schema.fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                b = whole.slice(start, 1024)
                texts = b.column(b.schema.get_field_index(column)).to_pylist()
                sizes = np.array([len(t) for t in texts])
                for n in np.unique(sizes):
                    rows = np.flatnonzero(sizes == n)
                    codes = np.frombuffer("".join(texts[i] for i in rows).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(rows), n).astype(np.uint64)
                    for k in _lengths(int(n), longest, cutoff):
                        part = np.zeros((len(rows), math.comb(int(n), k)), np.uint64)
                        for places in np.array(list(combinations(range(n), k))).T:
                            part = (part ^ codes[:, places]) * np.uint64(0x9E3779B97F4A7C15)
                            part ^= part >> np.uint64(29)
                        took, at = np.repeat(rows, part.shape[1]), part.ravel().astype(np.int64)
                        keys = np.unique(np.stack([took, at], 1), axis=0)
                        mine = b.take(pa.array(keys[:, 0]))
                        fill = lambda v: pa.array(np.full(len(keys), v, np.int32))
                        yield pa.RecordBatch.from_arrays([*mine.columns, fill(n), fill(k), pa.array(keys[:, 1])], names=[*mine.schema.names, "size", "k", "part"])

    return names.mapInArrow(cut, f"{kinds}, size int, k int, part long")


def _by_subsequence(left: DataFrame, right: DataFrame, cutoff: float, block: Sequence[str], longest: int) -> DataFrame:
    """candidates() of strings of up to `longest` characters: those that share a subsequence as long as the ratio needs, and by chance of the hash a few more."""
    share_package(left.sparkSession)
    one = _subsequences(left.select(*block, "a"), "a", longest, cutoff).withColumnRenamed("size", "size_a")
    other = _subsequences(right.select(*block, "b"), "b", longest, cutoff).withColumnRenamed("size", "size_b")
    need = F.greatest(F.ceil((F.col("size_a") + F.col("size_b")) * (cutoff / 2) - 1e-9), F.lit(1))
    return one.join(other, [*block, "k", "part"]).where(F.col("k") == need).select(*block, "a", "b").distinct()


def candidates(left: DataFrame, right: DataFrame, cutoff: float, block: Sequence[str] = ()) -> DataFrame:
    """(*block, a, b) of the pairs that may have a sequence ratio from `cutoff` on.

    Matching blocks are a common subsequence. Of two short strings (short_size) all subsequences of the length
    that the ratio needs are looked up, so only pairs that have one in common meet, however many strings
    there are; pairs with a longer string meet by their rarest characters (_by_rarest).
    """
    longest = short_size(cutoff)
    is_short = lambda c: F.length(c) <= longest
    some, others = left.where(is_short("a")), right.where(is_short("b"))
    found = _by_rarest(left.where(~is_short("a")), right, cutoff, block).unionByName(_by_rarest(some, right.where(~is_short("b")), cutoff, block))
    return _by_subsequence(some, others, cutoff, block, longest).unionByName(found) if longest else found


def close_pairs(left: DataFrame, right: DataFrame, cutoff: float, block: Sequence[str] = ()) -> DataFrame:
    """(*block, a, b, ratio) of left(*block, a) and right(*block, b), both distinct and not null, with a sequence ratio from `cutoff` on.

    candidates() finds the pairs, the longest common subsequence rules out most of them (many
    pairs at once), and what is left is compared. `cutoff` is above 0; of two
    empty strings nothing is returned. Strings of 64 or more characters skip the second step.
    """
    found = candidates(left, right, cutoff, block)
    return found.withColumn("ratio", ratio_from(cutoff)(F.col("a"), F.col("b"))).where("ratio is not null")
