"""Similarities of strings, sets and vectors. Only the sequence ratio needs Python, in Arrow batches."""

from __future__ import annotations

import difflib
from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epistola.functions.text import key_words


class Matcher(difflib.SequenceMatcher):
    """SequenceMatcher with the same blocks: of the first text only the places whose sign is indexed are walked, of the second only those in reach."""

    def set_seq1(self, a: str) -> None:
        super().set_seq1(a)
        self.places = [i for i, c in enumerate(a) if c in self.b2j]

    def find_longest_match(self, alo: int = 0, ahi: int | None = None, blo: int = 0, bhi: int | None = None) -> difflib.Match:
        a, b, b2j = self.a, self.b, self.b2j
        ahi, bhi = len(a) if ahi is None else ahi, len(b) if bhi is None else bhi
        besti, bestj, bestsize, last, runs = alo, blo, 0, alo - 2, {}
        for i in self.places[bisect_left(self.places, alo) : bisect_left(self.places, ahi)]:
            new, old = {}, runs if i == last + 1 else {}
            found = b2j[a[i]]
            for j in found[bisect_left(found, blo) : bisect_left(found, bhi)]:
                k = new[j] = old.get(j - 1, 0) + 1
                if k > bestsize:
                    besti, bestj, bestsize = i - k + 1, j - k + 1, k
            last, runs = i, new
        while besti > alo and bestj > blo and a[besti - 1] == b[bestj - 1]:
            besti, bestj, bestsize = besti - 1, bestj - 1, bestsize + 1
        while besti + bestsize < ahi and bestj + bestsize < bhi and a[besti + bestsize] == b[bestj + bestsize]:
            bestsize += 1
        return difflib.Match(besti, bestj, bestsize)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 M / T over matching blocks, b being the text that is indexed (long b has frequent signs left out); null if either is null."""
    out, matcher, last = [], Matcher(), None
    for x, y in zip(a, b, strict=True):
        if x is None or y is None:
            out.append(None)
            continue
        if x == y:
            out.append(1.0)
            continue
        if y != last:
            matcher.set_seq2(y)
            last = y
        matcher.set_seq1(x)
        out.append(matcher.ratio())
    return pd.Series(out, dtype="float64")


def common_subsequence(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of every pair, all pairs at once, a bit per character of a; -1 where a has over 63.

    The characters in matching blocks are such a subsequence, so this bounds the sequence ratio from above.
    """
    out = np.full(len(a), -1, np.int64)
    rows = np.flatnonzero([len(x) < 64 for x in a])
    if not len(rows):
        return out
    one, other = [a[i] for i in rows], [b[i] for i in rows]
    points = np.unique(np.frombuffer("".join([*one, *other]).encode("utf-32-le", "surrogatepass"), np.uint32))

    def codes(texts: list[str]) -> np.ndarray:
        n = np.array([len(t) for t in texts])
        flat = np.searchsorted(points, np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32))
        wide = np.full((len(texts), max(int(n.max()), 1)), len(points))
        wide[np.arange(wide.shape[1]) < n[:, None]] = flat
        return wide.T

    mine, theirs, every = codes(one), codes(other), np.arange(len(one))
    where = np.zeros((len(one), len(points) + 1), np.uint64)
    for i, c in enumerate(mine):
        where[every, c] |= np.uint64(1 << i)
    where[:, -1] = 0
    free = np.full(len(one), ~np.uint64(0))
    for c in theirs:
        hit = free & where[every, c]
        free = (free + hit) | (free - hit)
    sizes = np.array([len(t) for t in one])
    mask = np.array([(1 << n) - 1 for n in range(64)], np.uint64)[sizes]
    out[rows] = np.bitwise_count(~free & mask)
    return out


def ratio_from(cutoff: float):
    """The sequence ratio of two columns, null below `cutoff`: pairs whose longest common subsequence is too short are not compared."""

    @F.pandas_udf(T.DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        out, matcher, last = [None] * len(a), difflib.SequenceMatcher(), None
        one, other = a.tolist(), b.tolist()
        for start in range(0, len(one), 4096):
            x, y = one[start : start + 4096], other[start : start + 4096]
            common = common_subsequence(x, y)
            total = np.array([len(s) + len(t) for s, t in zip(x, y, strict=True)])
            for i in np.flatnonzero((common < 0) | (2.0 * common >= (cutoff - 1e-9) * total)):
                if y[i] != last:
                    matcher.set_seq2(y[i])
                    last = y[i]
                matcher.set_seq1(x[i])
                if (r := matcher.ratio()) >= cutoff:
                    out[start + i] = r
        return pd.Series(out, dtype="float64")

    return ratio


def closest(values: Column, vocabulary: Sequence[str], cutoff: float) -> Column:
    """struct<match, ratio>: the best entry of a small vocabulary from `cutoff` on; ties go to the larger string."""
    entries = sorted(set(vocabulary))

    @F.pandas_udf("struct<match:string,ratio:double>")
    def best(words: pd.Series) -> pd.DataFrame:
        rows = []
        for w in words:
            found = difflib.get_close_matches(w, entries, 1, cutoff) if w is not None else []
            rows.append((found[0], difflib.SequenceMatcher(None, w, found[0]).ratio()) if found else (None, None))
        return pd.DataFrame(rows, columns=["match", "ratio"])

    return best(values)


def percent_ratio(a: Column, b: Column) -> Column:
    """The ratio as a whole percentage after lower-casing and blanking signs."""
    bare = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", " "))
    return F.bround(sequence_ratio(bare(a), bare(b)) * 100).cast("int")


def text_similarity(a: Column, b: Column) -> Column:
    """0 with an empty side, 1 when equal but for case and outer space, else the sequence ratio."""
    x, y = F.trim(F.lower(a)), F.trim(F.lower(b))
    return F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), 0.0).when(x == y, 1.0).otherwise(sequence_ratio(x, y))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Jaccard of two arrays; `empty` when neither has an element."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, empty).otherwise(F.size(F.array_intersect(a, b)) / union)


def word_overlap(a: Column, b: Column) -> Column:
    x, y = key_words(a), key_words(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(jaccard(x, y))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def squared_distance(a: Column, b: Column) -> Column:
    step = lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    return F.aggregate(F.zip_with(a, b, step), F.lit(0.0), lambda s, v: s + v)


def distance_similarity(distance: Column) -> Column:
    return 1 / (1 + distance)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
