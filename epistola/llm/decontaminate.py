"""Benchmark decontamination by Wu-Manber multi-pattern search over words."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epistola.llm.common import discard, fresh, map_rows, materialize, text_of

WINDOW = 13
#: Bytes of benchmark text searched for in one pass (about 140 bytes of tables each); a larger benchmark takes several passes.
PASS_BYTES = 2 << 20
#: Passes that one table of hits comes from, and documents with hits of later passes that are broadcast at most.
PASSES_PER_WRITE, BROADCAST_HITS = 16, 50_000
#: Words after A-Z are lower-cased: runs of digits, a-z and characters from U+0080 on (fixed values).
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower())


class WuManber:
    """Search for word sequences of one length.

    The block is the last words of the window. shift says how far the window may move
    when it ends in that block; blocks that end some pattern shift by 0 and lead to a
    bucket of patterns by the hash of the whole suffix, each compared word by word.
    """

    def __init__(self, patterns: Iterable[tuple[bytes, ...]]) -> None:
        patterns = list(patterns)
        self.length = m = len(patterns[0])
        self.block = b = min(2, m)
        self.default = m - b + 1
        self.shift: dict = {}
        self.buckets: dict = defaultdict(dict)
        for p in patterns:
            for end in range(b, m + 1):
                block = p[end - b : end]
                block = block if b > 1 else block[0]
                self.shift[block] = min(self.shift.get(block, self.default), m - end)
            self.buckets[hash(p[-4:])].setdefault(p, None)

    def ends(self, text: list[bytes]) -> list[tuple[int, tuple[bytes, ...]]]:
        """(end, pattern) of each occurrence, in order."""
        found, m, shift, default, n = [], self.length, self.shift.get, self.default, len(text)
        i = m
        tail = min(4, m)
        if self.block == 1:
            while i <= n:
                step = shift(text[i - 1], default)
                if step == 0:
                    if (p := tuple(text[i - m : i])) in self.buckets.get(hash(p[-4:]), ()):
                        found.append((i, p))
                    step = 1
                i += step
            return found
        while i <= n:
            step = shift((text[i - 2], text[i - 1]), default)
            if step == 0:
                bucket = self.buckets.get(hash(tuple(text[i - tail : i])))
                if bucket and (p := tuple(text[i - m : i])) in bucket:
                    found.append((i, p))
                step = 1
            i += step
        return found


class Matcher:
    """All windows of some benchmark items, one Wu-Manber table per window length."""

    def __init__(self, items: Iterable[tuple[str, str]], window: int = WINDOW) -> None:
        owners: dict = defaultdict(set)
        for item, text in items:
            w = words(text)
            for i in range(max(1, len(w) - window + 1) if w else 0):
                owners[tuple(w[i : i + window])].add(item)
        self.owners = dict(owners)
        by_length = defaultdict(list)
        for p in self.owners:
            by_length[len(p)].append(p)
        self.tables = [WuManber(ps) for _, ps in sorted(by_length.items())]

    def match(self, text: str) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Words of text, disjoint [start, end) runs of hit words, items."""
        w = words(text)
        runs, items = [], set()
        for t in self.tables:
            for end, p in t.ends(w):
                runs.append((end - t.length, end))
                items |= self.owners[p]
        return len(w), merge(runs), items


def merge(runs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_RUNS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_matchers: dict = {}


def _matcher(items: tuple) -> Matcher:
    """One matcher per Python worker and set of items."""
    if items not in _matchers:
        _matchers.clear()
        _matchers[items] = Matcher(items)
    return _matchers[items]


def _passes(benchmark: DataFrame, item: str, text: str, pass_bytes: int) -> Iterator[tuple[tuple[str, str], ...]]:
    """The items in passes of at most pass_bytes (or one item); the driver holds one at a time."""
    made: list[tuple[str, str]] = []
    room = pass_bytes
    for row in benchmark.select(F.col(item).cast("string"), text_of(text)).toLocalIterator():
        size = len(row[1].encode()) + 64
        if made and size > room:
            yield tuple(made)
            made, room = [], pass_bytes
        made.append((row[0], row[1]))
        room -= size
    yield tuple(made)


_FOUND = [("n_words", T.LongType()), ("hit_runs", _RUNS), ("hit_items", T.ArrayType(T.StringType()))]


def _one_pass(docs: DataFrame, text: str, items: tuple, keep: list[str]) -> DataFrame:
    """docs with n_words, hit_runs and hit_items of one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def make():
        matcher = _matcher(shared.value)

        def work(texts):
            found = [matcher.match(t) for t in texts]
            return (
                [n for n, _, _ in found],
                [[{"start": a, "end": b} for a, b in runs] for _, runs, _ in found],
                [sorted(i for i in items if i is not None) for _, _, items in found],
            )

        return work

    return map_rows(docs, [text_of(text)], _FOUND, make, keep)


def _joined(runs, items, more_runs, more_items) -> tuple[list, list]:
    """Runs and items of a first pass and of the others together."""
    all_runs = [[{"start": a, "end": b} for a, b in merge((r["start"], r["end"]) for r in [*x, *(y or ())])] for x, y in zip(runs, more_runs, strict=True)]
    return all_runs, [sorted({*x, *(y or ())}) for x, y in zip(items, more_items, strict=True)]


def find(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", keep: list[str] | None = None, pass_bytes: int = PASS_BYTES
) -> DataFrame:
    """Append n_words, hit_runs, hit_items, n_hit, n_items, contaminated to docs.

    A window is 13 consecutive item words (an item of fewer is one window); a document word
    inside an occurrence is hit; contaminated when n_hit > 0 and 20 * n_hit >= n_words.
    Null and empty texts have no words; empty items never match; an item without id hits
    words but is not among the items. A benchmark above pass_bytes is searched in several
    passes; each is a set of tasks of its own, so that no worker holds more than one pass, and
    what the later ones hit is joined to the documents. Columns of docs with the names of new
    ones are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in {n for n, _ in _FOUND} | {"n_hit", "n_items", "contaminated"}]
    mark = fresh("mark", docs.columns)
    passes = _passes(benchmark, item, item_text, pass_bytes)
    first = next(passes)
    bodies = docs.select(F.md5(text_of(text).cast("binary")).alias("mark"), text_of(text).alias("text"))
    hits, waiting = [], []
    for items in passes:
        waiting.append(_one_pass(bodies, "text", items, ["mark"]).drop("n_words").where("size(hit_runs) > 0").distinct())
        if len(waiting) == PASSES_PER_WRITE:
            hits.append(materialize(reduce(DataFrame.unionByName, waiting), "hits"))
            waiting = []
    if waiting:
        hits.append(materialize(reduce(DataFrame.unionByName, waiting), "hits"))
    if hits:
        runs, names = F.flatten(F.collect_list("hit_runs")).alias("runs"), F.flatten(F.collect_list("hit_items")).alias("names")
        more = materialize(reduce(DataFrame.unionByName, hits).groupBy("mark").agg(runs, names), "hits")
        discard(*hits)
        columns = [fresh(c, [*docs.columns, mark]) for c in ("runs", "names")]
        more = more.select(F.col("mark").alias(mark), *[F.col(c).alias(n) for c, n in zip(("runs", "names"), columns, strict=True)])
        base = _one_pass(docs.withColumn(mark, F.md5(text_of(text).cast("binary"))), text, first, [*keep, mark])
        joined = base.join(F.broadcast(more) if more.count() <= BROADCAST_HITS else more, mark, "left")
        out = map_rows(joined, ["hit_runs", "hit_items", *columns], _FOUND[1:], lambda: _joined, [*keep, "n_words"])
    else:
        out = _one_pass(docs, text, first, keep)
    n_hit = F.aggregate("hit_runs", F.lit(0).cast("long"), lambda a, r: a + (r["end"] - r["start"]).cast("long"))
    return out.withColumn("n_hit", n_hit).withColumns(
        {"n_items": F.size("hit_items").cast("long"), "contaminated": (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))}
    )
