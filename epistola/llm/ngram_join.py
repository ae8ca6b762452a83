"""N-gram Jaccard self-join by PartEnum signatures, with components of the links.

For two sets of sizes a and b the condition percent / 100 <= Jaccard is the same as
|symmetric difference| <= (a + b) * (100 - percent) / (100 + percent). Sizes are cut into
bands so that similar sets lie in the same band or in neighbours; a set signs for its own
band and, if a partner could be in the next one, for that too. For a band whose largest
size allows k differences the hash domain is cut into k / 2 + m ranges, of which at least m
have at most one difference; each range is cut into three parts, and the three subsets of two
parts are signed, one of which has no difference. So similar sets share at least m signatures
of a band. A set therefore needs no bucket if it shares fewer than m with any others, and can
leave its m - 1 largest buckets: two sets that share m signatures still meet in the smallest
bucket that they share. This empties the buckets of passages that many documents have.

Pairs are not expanded: copies collapse into one set; in each signature's bucket the most
connected set is compared with the others and then leaves the bucket (its links are all
known), and sets already in one component need no comparison. After ROUNDS such turns the
sets of different components that still share a bucket are compared with each other. Sets
that are nearly similar share many buckets; so that they do not meet in each of them, a row
has the set's BEFORE preceding signatures, and two sets with one of these in common are left
to an earlier bucket. In the first that they share they always meet. Before
any comparison of whole sets parity sketches decide: each element flips one bit, so the
number of differing bits never exceeds the symmetric difference, and a pair with too many
cannot be similar. A fold of 512 bits is tested first, then one of two bits for each element.
"""

from __future__ import annotations

import struct
from bisect import bisect_left

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epistola.llm.common import discard, keep_marked, map_rows, materialize, row_mark, text_of
from epistola.llm.graph import components

N, PERCENT = 3, 90
PARTS = 3
ROUNDS = 2
#: One spare range for so many needed ones.
NEEDED_PER_SPARE = 10
SKETCH_WORDS = 8
#: Preceding signatures of its set that a row of the last comparison has.
BEFORE = 8
#: Ids and marks of candidate documents are broadcast up to this many (24 to 100 bytes each); beyond it they are joined by a shuffle.
BROADCAST_KEYS = 500_000
CACHE_WORDS = 100_000

_U = np.uint64
_ONE, _TWO = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_words = _Words()


def shingles(text: str, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles (A-Z lower-cased, words cut at ASCII white space)."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, _U)
    if len(_words) > CACHE_WORDS:
        _words.clear()
    ids = np.fromiter(map(_words.__getitem__, words), _U, len(words))
    width = min(n, len(words))
    with np.errstate(over="ignore"):
        h = np.full(len(ids) - width + 1, _U(width), _U)
        for i in range(width):
            h = _mix(h * _ONE + ids[i : i + len(h)])
    return np.unique(h)


class PartEnum:
    """Bands and signatures for one threshold."""

    def __init__(self, percent: int = PERCENT) -> None:
        self.percent = percent
        self.tops = [1]

    def band(self, size: int) -> int:
        while self.tops[-1] < size:
            low = self.tops[-1] + 1
            self.tops.append(max(low * 5 // 4, low * 100 // self.percent))
        return bisect_left(self.tops, size)

    def sign(self, h: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """48-bit signatures of a set of hashes, the last bit being that of the band, and how many similar sets share at least in bands of either bit."""
        size, out, shared = len(h), [], [0, 0]
        if not size:
            return np.empty(0, np.int64), shared
        largest = size * 100 // self.percent
        own, last = self.band(size), self.band(largest)
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, _U), np.cumsum(_mix(h ^ _TWO), dtype=_U)])
            place = h >> _U(32)
            for tag in {own, last}:  # neighbours, so of different bits
                k = 2 * self.tops[tag] * (100 - self.percent) // (100 + self.percent)
                if k < 1:
                    continue  # only equal sets are similar, and those are one set already
                shared[tag & 1] = 1 + -(-(k // 2) // NEEDED_PER_SPARE)
                ranges = k // 2 + shared[tag & 1]
                cells = ranges * PARTS
                cut = np.searchsorted((place * _U(cells)) >> _U(32), np.arange(cells + 1, dtype=_U))
                part = (total[cut[1:]] - total[cut[:-1]]).reshape(ranges, PARTS)
                subset = part.sum(axis=1, dtype=_U)[:, None] - part
                name = _mix(np.arange(cells, dtype=_U).reshape(ranges, PARTS) + _U(tag + 1) * _ONE)
                out.append((_mix(subset + name).ravel() >> _U(17) << _U(1)) | _U(tag & 1))
        return (np.concatenate(out) if out else np.empty(0, _U)).view(np.int64), shared


def digest(h: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        return struct.pack("<QQ", int(_mix(h + _ONE).sum(dtype=_U)), int(_mix(h ^ _TWO).sum(dtype=_U)))


def sketch(h: np.ndarray) -> np.ndarray:
    """Parity bits, a power of two of them and at least 512 and two for each element, as longs; every 512 are one fold."""
    bits = 64 * SKETCH_WORDS
    while bits < 2 * len(h):
        bits *= 2
    flipped = np.bincount((h & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flipped.astype(np.uint8)).view(np.int64)


def fold(bits: np.ndarray, words: int = SKETCH_WORDS) -> np.ndarray:
    """The sketch of the same set with fewer bits."""
    return np.bitwise_xor.reduce(bits.reshape(-1, words), axis=0)


_SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]


def profiles(docs: DataFrame, key: str, text: str, n: int, percent: int) -> DataFrame:
    """key, mark, size, digest, sigs, shared, wide sketch, its fold s0..s7, uid: one row per document, written once."""

    def make():
        signer = PartEnum(percent)

        def work(texts):
            sets = [shingles(t, n) for t in texts]
            wide = [sketch(h) for h in sets]
            signed = [signer.sign(h) for h in sets]
            return [len(h) for h in sets], [digest(h) if len(h) else None for h in sets], [s for s, _ in signed], [m for _, m in signed], wide, [fold(w) for w in wide]

        return work

    rows = docs.select(F.col(f"`{key}`").alias("key"), row_mark(key, text).alias("mark"), text_of(text).alias("text"))
    new = [("size", T.LongType()), ("digest", T.BinaryType()), ("sigs", T.ArrayType(T.LongType())), ("shared", T.ArrayType(T.IntegerType())), ("wide", T.ArrayType(T.LongType())), ("sketch", T.ArrayType(T.LongType()))]
    made = map_rows(rows, ["text"], new, make, ["key", "mark"])
    words = {f"s{i}": F.col("sketch")[i] for i in range(SKETCH_WORDS)}
    return materialize(made.withColumns(words).drop("sketch").withColumn("uid", F.monotonically_increasing_id()), "profiles")


def _possible(percent: int) -> str:
    """SQL over (size, s0..) and (size_a, a_s0..): the sizes and sketches allow similarity."""
    flips = " + ".join(f"bit_count({c} ^ a_{c})" for c in _SKETCH)
    return f"100 * least(size, size_a) >= {percent} * greatest(size, size_a) and {100 + percent} * ({flips}) <= {100 - percent} * (size + size_a)"


def _as_b(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("uid").alias("b"), "size", *_SKETCH)


def _as_a(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("uid").alias("a"), F.col("size").alias("size_a"), *[F.col(c).alias(f"a_{c}") for c in _SKETCH])


def _with_preceding(live: DataFrame) -> DataFrame:
    """sig, uid, label, before: up to BEFORE signatures that precede sig among those of the same set in live."""
    preceding = Window.partitionBy("uid").orderBy("sig").rowsBetween(-BEFORE, -1)
    return live.select("sig", "uid", "label", F.collect_list("sig").over(preceding).alias("before"))


def _meeting(live: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b) of sets of different labels that share a signature and may be similar: from the first that they share, and from another only if BEFORE tells of none shared before it."""
    rest = live.select("sig", F.col("label").alias("label_b"), F.col("uid").alias("b"), F.col("before").alias("before_b")).join(_as_b(nodes), "b")
    other = live.select("sig", F.col("label").alias("label_a"), F.col("uid").alias("a"), F.col("before").alias("before_a")).join(_as_a(nodes), "a")
    return rest.join(other, "sig").where(f"a < b and label_a != label_b and not arrays_overlap(before_a, before_b) and {_possible(percent)}").select("a", "b")


def _small(df: DataFrame) -> DataFrame:
    """df, broadcast if it has at most BROADCAST_KEYS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


class _Join:
    """One run: the documents, how they are read, and the threshold."""

    def __init__(self, docs: DataFrame, key: str, text: str, n: int, percent: int) -> None:
        self.docs, self.key, self.text, self.n, self.percent = docs, key, text, n, percent

    def texts(self, ids: DataFrame, nodes: DataFrame) -> DataFrame:
        """uid, text of the sets with those ids; only the texts in question are read again, and one row of repeated ones."""
        needed = materialize(nodes.join(ids, "uid", "left_semi").select("uid", "mark"), "needed")
        rows = self.docs.select(row_mark(self.key, self.text).alias("mark"), text_of(self.text).alias("text"))
        return rows.join(_small(needed), "mark").groupBy("uid").agg(F.first("text").alias("text"))

    def likely(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """The pairs(a, b) that folds and then wide sketches leave."""
        percent = self.percent
        some = materialize(pairs.join(_as_b(nodes), "b").join(_as_a(nodes), "a").where(_possible(percent)).select("a", "b"), "pairs")
        left, right = (nodes.select(F.col("uid").alias(c), F.col("size").alias(f"size_{c}"), F.col("wide").alias(f"wide_{c}")) for c in "ab")

        def make():
            def work(a, b, one, other):
                out = []
                for m, n, x, y in zip(a, b, one, other, strict=True):
                    x, y = np.array(x, np.int64).view(_U), np.array(y, np.int64).view(_U)
                    words = min(len(x), len(y))
                    flips = int(np.bitwise_count(fold(x, words) ^ fold(y, words)).sum())
                    out.append((100 + percent) * flips <= (100 - percent) * (m + n))
                return [out]

            return work

        judged = map_rows(some.join(left, "a").join(right, "b"), ["size_a", "size_b", "wide_a", "wide_b"], [("likely", T.BooleanType())], make, ["a", "b"])
        made = materialize(judged.where("likely").select("a", "b"), "pairs")
        discard(some)
        return made

    def verified(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """The pairs(a, b) whose sets are similar enough; pairs travel with texts, which are smaller than sets."""
        n, percent = self.n, self.percent
        pairs = self.likely(pairs, nodes)
        texts = self.texts(pairs.select(F.col("a").alias("uid")).union(pairs.select("b")).distinct(), nodes)
        left = texts.select(F.col("uid").alias("b"), F.col("text").alias("text_b"))
        right = texts.select(F.col("uid").alias("a"), F.col("text").alias("text_a"))

        def make():
            def work(ones, others):
                out, last, x = [], None, None
                for one, other in zip(ones, others, strict=True):
                    if one != last:
                        last, x = one, shingles(one, n)
                    y = shingles(other, n)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    out.append(100 * both >= percent * (len(x) + len(y) - both))
                return [out]

            return work

        judged = map_rows(pairs.join(left, "b").join(right, "a"), ["text_a", "text_b"], [("similar", T.BooleanType())], make, ["a", "b"])
        found = materialize(judged.where("similar").select("a", "b"), "links")
        discard(pairs)
        return found

    def buckets(self, prof: DataFrame, copies: DataFrame, slim: DataFrame) -> DataFrame:
        """uid, sig, n of the buckets with more than one set, without the largest buckets of each set and band, as far as the others suffice."""
        signed = prof.where("size > 0").select("uid", "sigs").join(_small(copies), "uid", "left_anti").select("uid", F.explode("sigs").alias("sig"))
        together = F.count(F.lit(1)).over(Window.partitionBy("sig")).alias("n")
        every = materialize(signed.select("uid", "sig", together).where("n > 1"), "buckets")
        discard(prof)
        rows = every.join(slim.select("uid", F.col("shared")[0].alias("m0"), F.col("shared")[1].alias("m1")), "uid").withColumn("bit", F.col("sig").bitwiseAND(1))
        place = F.row_number().over(Window.partitionBy("uid", "bit").orderBy(F.desc("n"), "sig"))
        made = materialize(rows.withColumn("place", place).where("place >= if(bit = 1, m1, m0)").select("uid", "sig", "n"), "buckets")
        discard(every)
        return made

    def links(self, prof: DataFrame, copies: DataFrame, slim: DataFrame) -> DataFrame:
        """(node, label) over the uids of the distinct sets that share a signature with another."""
        bucket = self.buckets(prof, copies, slim)
        popular = bucket.groupBy("uid").agg(F.sum("n").alias("pop"))
        nodes = materialize(slim.join(popular, "uid").select("uid", "mark", "size", "pop", "wide", *_SKETCH), "nodes")
        discard(slim)
        labels = nodes.select(F.col("uid").alias("node"), F.col("uid").alias("label"))
        found = None

        def learn(pairs: DataFrame) -> None:
            nonlocal found, labels
            new = self.verified(pairs, nodes)
            if new.isEmpty():
                return
            found = new if found is None else found.unionByName(new)
            labels = nodes.select(F.col("uid").alias("node")).join(components(found), "node", "left")
            labels = materialize(labels.select("node", F.coalesce("label", "node").alias("label")), "labels")

        def living(bucket: DataFrame) -> DataFrame:
            """Rows of buckets with sets of different components, and each bucket's most connected set `a`."""
            live = bucket.select("sig", "uid").join(nodes.select("uid", "pop").join(labels.withColumnRenamed("node", "uid"), "uid"), "uid")
            pivot = F.max(F.struct("pop", (-F.col("uid")).alias("first"), F.col("label").alias("label_a"))).alias("pivot")
            mixed = live.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), pivot).where("lo < hi")
            return materialize(live.join(mixed.select("sig", (-F.col("pivot.first")).alias("a"), "pivot.label_a"), "sig"), "live")

        for _ in range(ROUNDS):
            live = living(bucket)
            discard(bucket)
            learn(live.where("label != label_a").select("a", F.col("uid").alias("b")).distinct())
            bucket = materialize(live.where("uid != a").select("sig", "uid"), "buckets")
            discard(live)
        live = living(bucket)
        discard(bucket)
        learn(_meeting(_with_preceding(live), nodes, self.percent).distinct())
        discard(live)
        return labels

    def classes(self) -> tuple[DataFrame, DataFrame]:
        """key, mark, uid, size, digest of each row, and digest, label of each distinct set; equal labels are linked."""
        prof = profiles(self.docs, self.key, self.text, self.n, self.percent)  # discarded by links(), as slim is
        slim = materialize(prof.drop("sigs"), "sets")
        rows = materialize(slim.select("key", "mark", "uid", "size", "digest"), "rows")
        first = rows.where("size > 0").groupBy("digest").agg(F.min("uid").alias("node"))
        copies = materialize(rows.where("size > 0").join(first, "digest").where("uid != node").select("uid"), "copies")
        labels = self.links(prof, copies, slim)
        return rows, materialize(first.join(labels, "node", "left").select("digest", F.coalesce("label", "node").alias("label")), "classes")


def join_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """key, n_shingles, component_id: the smallest key reachable by links, itself included.

    Equal sets are linked through their one set. Documents without words (null, empty or
    blank texts) have no shingles and are their own component; fewer than n words make one
    shingle; a null key never is the smallest unless its whole component has none; repeated
    rows each get their row; an empty table gives an empty table; other columns are ignored.
    """
    rows, classes = _Join(docs, key, text, n, percent).classes()
    named = rows.where("size > 0").join(classes, "digest")
    least = named.groupBy("label").agg(F.min("key").alias("component_id"))
    names = classes.join(least, "label").select("digest", "component_id")
    return rows.join(names, "digest", "left").select(
        F.col("key").alias(key), F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id")
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with all columns: the smallest key (nulls last), of equal keys the smallest digest of key and text.

    Documents without words all stay; of wholly repeated rows the one that is least in its other columns.
    """
    rows, classes = _Join(docs, key, text, n, percent).classes()
    order: Column = F.struct(F.col("key").isNull().alias("none"), "key", "mark", "uid")
    named = rows.where("size > 0").join(classes, "digest")
    best = named.groupBy("label").agg(F.min(order).alias("best")).select(F.col("best.uid").alias("uid"), F.lit(True).alias("first"))
    decided = rows.join(best, "uid", "left").select("mark", ((F.col("size") == 0) | F.coalesce("first", F.lit(False))).alias("kept"))
    return keep_marked(docs, decided, key, text)
