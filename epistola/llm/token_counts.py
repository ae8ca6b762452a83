"""Edit-aware token counts: a segment tree of pre-tokens per document.

Text is cut into pre-tokens by the tokenizer's pattern and each has its own token count, so
a document's count is a sum. The tree keeps the pre-tokens in leaves and sums of characters
and tokens above them. An edit cuts again only from the first pre-token whose match could
have looked at the edited place to the first cut after the edit that the old text also has:
a cut depends only on what follows it, so everything behind such a place stays as it was.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epistola.llm.common import fresh, map_rows, text_of

#: Pre-tokens of a leaf when a tree is built.
LEAF = 64
#: How far past its end a match of the pattern may have looked (the longest contraction).
LOOK = 3
CACHE_TOKENS = 100_000


class Tokenizer:
    """Pre-tokens and their counts under a byte-level BPE of public ranks."""

    def __init__(self, ranks: bytes, pattern: str) -> None:
        merges = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.pattern = regex.compile(pattern)
        self.bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        self.cache: dict[str, int] = {}

    def cut(self, text: str) -> list[str]:
        """All of text in pre-tokens."""
        return self.pattern.findall(text)

    def count(self, token: str) -> int:
        n = self.cache.get(token)
        if n is None:
            if len(self.cache) >= CACHE_TOKENS:
                self.cache.clear()
            n = len(self.bpe.encode_ordinary(token))
            if len(token) < 64:
                self.cache[token] = n
        return n


class TokenTree:
    """A document's pre-tokens in leaves under sums of (characters, tokens)."""

    def __init__(self, text: str, tokenizer: Tokenizer, leaf: int = LEAF) -> None:
        self.tokenizer = tokenizer
        parts = tokenizer.cut(text)
        counts = list(map(tokenizer.count, parts))
        self.leaves = [(parts[i : i + leaf], counts[i : i + leaf]) for i in range(0, len(parts), leaf)] or [([], [])]
        self.base = 1 << (len(self.leaves) - 1).bit_length()
        self.sums = np.zeros((2 * self.base, 2), np.int64)
        for i, (p, c) in enumerate(self.leaves):
            self.sums[self.base + i] = sum(map(len, p)), sum(c)
        level = self.base
        while level > 1:
            half = level // 2
            self.sums[half:level] = self.sums[level : 2 * level].reshape(half, 2, 2).sum(axis=1)
            level = half
        self.recut = 0  # characters cut again by edits

    def __len__(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def text(self) -> str:
        return "".join(t for p, _ in self.leaves for t in p)

    def _leaf_of(self, position: int) -> tuple[int, int]:
        """Leaf that holds the character at position, and the position of the leaf's first."""
        node, start = 1, 0
        while node < self.base:
            node *= 2
            left = int(self.sums[node, 0])
            if position >= start + left and self.sums[node + 1, 0]:
                start += left
                node += 1
        return node - self.base, start

    def _update(self, leaf: int) -> None:
        p, c = self.leaves[leaf]
        node = self.base + leaf
        self.sums[node] = sum(map(len, p)), sum(c)
        while node > 1:
            node //= 2
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    def _tokens_from(self, leaf: int, start: int):
        """(leaf, index, start, token) from a leaf on."""
        for k in range(leaf, len(self.leaves)):
            for i, t in enumerate(self.leaves[k][0]):
                yield k, i, start, t
                start += len(t)

    def edit(self, position: int, deleted: int, inserted: str) -> None:
        """Replace deleted characters at position; both are clipped to the text."""
        size = len(self)
        position = min(max(position, 0), size)
        stop = min(position + max(deleted, 0), size)
        leaf, start = self._leaf_of(max(position - LOOK - 1, 0))
        # the first pre-token whose match may have looked at the edited place
        begin = None
        for k, i, at, t in self._tokens_from(leaf, start):
            if at + len(t) + LOOK > position or at >= position:
                begin = (k, i, at)
                break
        if begin is None:
            begin = (leaf, len(self.leaves[leaf][0]), size)
        old: list[tuple[int, int, int, str]] = []
        source = self._tokens_from(begin[0], begin[2] - sum(map(len, self.leaves[begin[0]][0][: begin[1]])))
        for item in source:
            if (item[0], item[1]) >= begin[:2]:
                old.append(item)
                break
        head = min(begin[2], position)
        need = 2 * LOOK + 64
        while True:
            # old text up to `need` characters past the edit
            while old and old[-1][2] + len(old[-1][3]) < stop + need:
                if (item := next(source, None)) is None:
                    break
                old.append(item)
            body = "".join(t for *_, t in old)
            reach = head + len(body)
            text = body[: position - head] + inserted + body[stop - head :]
            shift = len(inserted) - (stop - position)
            cuts = self.tokenizer.cut(text)
            final = reach >= size
            ends, at = {}, head
            for n, (_, _, s, _) in enumerate(old):
                ends[s + shift] = n
            keep, met = [], len(old)
            for t in cuts:
                if at >= stop + shift and at >= position + len(inserted) and at in ends and at > head - 1 and (at - shift) >= stop:
                    met = ends[at]
                    break
                # a match that ends near the end of the piece may have been cut short by it
                if not final and at + len(t) + LOOK > head + len(text):
                    met = -1
                    break
                keep.append(t)
                at += len(t)
            if met >= 0 and (met < len(old) or final):
                break
            need *= 4
        self.recut += sum(map(len, keep))
        self._replace(begin, old[:met], keep)

    def _replace(self, begin: tuple[int, int, int], gone: Sequence[tuple], new: list[str]) -> None:
        """Put new pre-tokens into the first leaf in place of those that are gone."""
        first, index, _ = begin
        counts = list(map(self.tokenizer.count, new))
        per_leaf: dict[int, list[int]] = {}
        for k, i, *_ in gone:
            per_leaf.setdefault(k, []).append(i)
        for k, places in per_leaf.items():
            p, c = self.leaves[k]
            low, high = places[0], places[-1] + 1
            del p[low:high], c[low:high]
        p, c = self.leaves[first]
        p[index:index] = new
        c[index:index] = counts
        for k in {first, *per_leaf}:
            self._update(k)


@lru_cache(maxsize=2)
def _tokenizer(ranks: bytes, pattern: str) -> Tokenizer:
    return Tokenizer(ranks, pattern)


EDIT = T.StructType([T.StructField("position", T.LongType()), T.StructField("deleted", T.LongType()), T.StructField("inserted", T.StringType())])


def with_edits(docs: DataFrame, edits: DataFrame, key: str = "doc_id", order: str = "seq") -> DataFrame:
    """docs with an `edits` array from edits(key, seq, position, deleted, inserted), in order of seq; a column of that name gives way to it."""
    one = F.struct(order, "position", "deleted", "inserted")
    name, found = fresh("key", docs.columns), fresh("found", docs.columns)
    lists = edits.groupBy(F.col(key).alias(name)).agg(F.array_sort(F.collect_list(one)).alias(found))
    chosen = F.transform(found, lambda e: F.struct(e["position"].alias("position"), e["deleted"].alias("deleted"), e["inserted"].alias("inserted")))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "edits"]
    return docs.join(lists, F.col(f"`{key}`") == F.col(name), "left").select(*kept, chosen.alias("edits"))


def count_edited(docs: DataFrame, ranks_file: str, pattern: str, text: str = "text", edits: str = "edits", texts: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Append n_pretokens, n_tokens, n_edits, n_tokens_after, n_chars_after, n_recut to docs, with texts also text_after.

    edits is an array of struct<position, deleted, inserted> in characters, each applied to
    the text that the ones before it left; positions beyond the text are clipped, null fields
    count as 0 or empty, a null array as no edit, a null text as empty. n_recut is the number
    of characters cut again, whatever the document's length. An empty table gives an empty
    table; columns with the names of new ones are replaced.
    """
    with open(ranks_file, "rb") as f:  # a bounded file, read by the driver
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), pattern))
    names = ["n_pretokens", "n_tokens", "n_edits", "n_tokens_after", "n_chars_after", "n_recut"]
    new = [(n, T.LongType()) for n in names] + [("text_after", T.StringType())] * texts

    def make() -> Callable:
        tokenizer = _tokenizer(*shared.value)

        def work(bodies, changes):
            rows = []
            for body, list_ in zip(bodies, changes, strict=True):
                tree = TokenTree(body, tokenizer)
                row = [sum(len(p) for p, _ in tree.leaves), tree.tokens, len(list_ or ())]
                for e in list_ or ():
                    tree.edit(e["position"] or 0, e["deleted"] or 0, e["inserted"] or "")
                rows.append([*row, tree.tokens, len(tree), tree.recut] + [tree.text()] * texts)
            return list(zip(*rows, strict=True)) if rows else [[]] * len(new)

        return work

    return map_rows(docs, [text_of(text), F.col(f"`{edits}`")], new, make, keep)
