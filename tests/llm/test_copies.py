from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from epistola.llm import decontaminate, exact_dedup, graph, ngram_join, sharding
from epistola.llm.queries import QUERIES

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def words(text, pattern):
    return re.findall(pattern, (text or "").translate(LOWER))


def brute_components(rows, n=3, percent=90):
    sets = []
    for _, text in rows:
        w = words(text, r"[^\x20\x09-\x0D]+")
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return [(key, len(sets[i]), least.get(find(i)) if sets[i] else key) for i, (key, _) in enumerate(rows)]


def near_copies(seed=1, groups=12, size=25):
    """Texts with chains of small edits, exact copies, odd rows."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, key = [], 0
    for g in range(groups):
        base = [r.choice(vocabulary) for _ in range(r.choice([2, 5, 30, 90, 200, 400]))]
        current = base
        for i in range(size):
            edited = list(current if i % 3 else base)
            for _ in range(r.choice([0, 1, 1, 2, 5])):
                edited[r.randrange(len(edited))] = r.choice(vocabulary)
            current = edited
            rows.append((key, r.choice([" ", "\n"]).join(w.upper() if r.random() < 0.3 else w for w in edited)))
            key += 1
    return rows + [(key, ""), (key + 1, None), (key + 2, " \t"), (key + 3, "one"), (key + 4, "ONE"), (key + 5, "one two"), (key + 5, "one two")]


def test_join_equals_brute_force(spark):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text as digest", "1 as size").repartition(5)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join_components(docs).collect())
    assert got == sorted(brute_components(rows))


def test_join_on_the_test_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in QUERIES["op9_ngram_jaccard"](spark, sf).collect())
    assert got == sorted(brute_components(rows))


@pytest.mark.parametrize("percent", [80, 90])
def test_similar_sets_share_signatures(percent):
    r = np.random.default_rng(2)
    signer = ngram_join.PartEnum(percent)
    seen = 0
    for _ in range(600):
        size = int(r.integers(4, 600))
        a = np.unique(r.integers(0, 2**64, size, dtype=np.uint64))
        gone = int(r.integers(0, max(1, size * (100 - percent) // 190) + 1))
        more = int(r.integers(0, gone + 1))
        b = np.unique(np.concatenate([a[r.permutation(len(a))[gone:]], r.integers(0, 2**64, more, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= percent * (len(a) + len(b) - both) and both < max(len(a), len(b)):
            (x, m), (y, k) = signer.sign(a), signer.sign(b)
            same = np.intersect1d(x, y)
            # in some band that both sign for, as many as either set counts on
            assert any(m[bit] and m[bit] == k[bit] <= (same & 1 == bit).sum() for bit in (0, 1))
            wide = ngram_join.sketch(a), ngram_join.sketch(b)
            for words in (8, min(map(len, wide))):
                flips = sum(int(v).bit_count() for v in (ngram_join.fold(wide[0], words) ^ ngram_join.fold(wide[1], words)).view(np.uint64))
                assert flips <= len(a) + len(b) - 2 * both
            seen += 1
    assert seen > 100


def test_many_documents_that_share_a_passage(spark):
    """Buckets of a common passage, families that are alike but not enough, and chains, at five words and 80 percent."""
    r = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(16))
    rows, key = [], 0
    for family in range(4):
        base = [f"f{family}w{r.randrange(300)}" for _ in range(r.choice([40, 150]))]
        for i in range(30):
            own = list(base)
            for _ in range(r.choice([1, 2, 6, 12])):
                own[r.randrange(len(own))] = f"x{key}"
            rows.append((key, " ".join(own) + " " + passage))
            key += 1
    rows += [(key + i, passage + " " + " ".join(f"u{i}n{j}" for j in range(r.choice([1, 8, 60])))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in ngram_join.join_components(docs, n=5, percent=80).collect())
    assert got == sorted(brute_components(rows, 5, 80))


ODD = "doc_id long, text string, mark string, stay long, n long, kept string, __text string, uid long"


def odd_rows():
    """Null and repeated keys, clashing names, texts that are equal but for white space, wholly repeated rows."""
    rows = [(None, "alpha beta gamma delta"), (None, "one two three four five"), (5, "red green blue black white"), (5, "sun moon star sky night day")]
    rows += [(6, "a b"), (6, "a\tb"), (7, "same text here"), (7, "same text here"), (8, None), (8, ""), (9, "   "), (10, "same text  here")]
    return [(*x, f"m{i}", i, -i, "k", f"t{i}", i % 3) for i, x in enumerate(rows)]


def test_pairs_that_share_many_signatures_meet_about_once(spark):
    """Every pair that shares a live signature is made, hardly more than once for sets that share most of theirs, and not at all within a component."""
    r = random.Random(5)
    held = {uid: r.sample(range(1000, 1100), 75) for uid in range(12)} | {20: [7], 21: [7, 8], 22: [8]}
    zeros = [(uid, 2000, *[0] * ngram_join.SKETCH_WORDS) for uid in held]
    nodes = spark.createDataFrame(zeros, "uid long, size long, " + ", ".join(f"{c} long" for c in ngram_join._SKETCH))
    live = spark.createDataFrame([(s, uid, 0 if uid in (0, 1) else uid) for uid, sigs in held.items() for s in sigs], "sig long, uid long, label long")
    got = [(x.a, x.b) for x in ngram_join._meeting(ngram_join._with_preceding(live), nodes, 80).collect()]
    want = {(a, b) for a in held for b in held if a < b and set(held[a]) & set(held[b])} - {(0, 1)}
    assert set(got) == want
    assert len(got) <= 2 * len(want)  # 56 rows or so of a pair if each shared signature made one


def test_stages_keep_exact_rows(spark):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, ODD).repartition(3)
    near = [tuple(r) for r in ngram_join.keep_one(docs, n=5, percent=80).collect()]
    # every component keeps its smallest key; documents without words all stay
    texts = Counter(r[:2] for r in near)
    assert texts == Counter([r[:2] for r in rows[:4]] + [min(rows[4][:2], rows[5][:2], key=lambda x: hashlib.md5(f"k1:6t{x[1]}".encode()).digest())] + [(7, "same text here")] + [r[:2] for r in rows[8:11]])
    assert [r for r in near if r[0] == 7] == [rows[6]] and set(near) <= set(rows)
    exact = [tuple(r) for r in exact_dedup.deduplicate(docs).collect()]
    assert len(exact) == 7 and set(exact) <= set(rows)
    assert {r[:2] for r in exact} >= {r[:2] for r in rows[:4]} | {(9, "   "), (10, "same text  here")}
    for made in (ngram_join.keep_one(docs.limit(0)), exact_dedup.deduplicate(docs.limit(0))):
        assert made.columns == docs.columns and made.count() == 0


def test_repeated_rows_keep_one(spark, monkeypatch):
    rows = [(1, "a b c d e f")] * 5 + [(2, "g h i j k l")] * 3 + [(3, "g h i j k l")]
    for bound in (0, 500_000):
        monkeypatch.setattr("epistola.llm.common.BROADCAST_MARKS", bound)
        monkeypatch.setattr("epistola.llm.ngram_join.BROADCAST_KEYS", bound)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        for made in (ngram_join.keep_one(docs), exact_dedup.deduplicate(docs)):
            assert sorted(map(tuple, made.collect())) == [(1, "a b c d e f"), (2, "g h i j k l")]


def test_empty_and_keep_one(spark):
    docs = spark.createDataFrame(near_copies(3, 4, 9), "doc_id long, text string")
    assert ngram_join.join_components(docs.limit(0)).count() == 0
    kept = ngram_join.keep_one(docs)
    expected = {c for _, _, c in brute_components([(r.doc_id, r.text) for r in docs.collect()])}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(expected) and kept.columns == docs.columns


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    labels = {r.node: r.label for r in graph.components(edges).collect()}
    assert {labels[i] for i in range(61)} == {0} and labels[101] == labels[100] == 100


# ---- exact copies


def brute_exact(rows):
    groups = {}
    for i, (key, text) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), key is None, key if key is not None else 0, i))
    out = []
    for bare, members in groups.items():
        best = min(members)
        out += [(rows[i][0], rows[best[3]][0], len(members), hashlib.sha256(bare.encode()).hexdigest()) for *_, i in members]
    return sorted(out, key=str)


@pytest.mark.parametrize("counters", [1, 3, 255])
def test_exact_equals_brute_force(spark, counters):
    r = random.Random(4)
    rows = [(i, "".join(r.choice(["a", "b", " ", "\n", "\t"]) for _ in range(r.randrange(6)))) for i in range(300)]
    rows += [(i, "hot text") for i in range(300, 450)] + [(450, None), (None, "null key"), (7, "x\u00a0y"), (7, "x\u00a0y"), (451, "z" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text as digest", "doc_id as kept").repartition(7)
    got = exact_dedup.duplicates(docs, k=counters).collect()
    assert sorted(((g.doc_id, g.keep_id, g.group_size, g.text_sha256) for g in got), key=str) == brute_exact(rows)
    assert Counter(g.text_sha256 for g in got if g.kept) == Counter({s: 1 for *_, s in brute_exact(rows)})
    kept = exact_dedup.deduplicate(docs, k=counters)
    assert kept.columns == docs.columns and kept.count() == len({s for *_, s in brute_exact(rows)})
    assert exact_dedup.duplicates(docs.limit(0)).count() == 0


def test_summary_keeps_every_heavy_digest(spark):
    r = random.Random(6)
    digests = [b"hot"] * 400 + [b"warm"] * 300 + [str(i).encode() for i in range(500)]
    r.shuffle(digests)
    rows = spark.createDataFrame([(d,) for d in digests], "digest binary").repartition(6)
    found = {bytes(x.digest) for x in exact_dedup.heavy_hitters(rows, "digest", 5).collect()}
    assert {b"hot", b"warm"} <= found and len(found) <= 5


# ---- benchmark passages


def brute_passages(docs, items, window=13):
    pattern = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    owners = {}
    for item, text in items:
        w = words(text, pattern)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            owners.setdefault(tuple(w[i : i + window]), set()).add(item)
    out = []
    for key, text in docs:
        w, hit, names = words(text, pattern), set(), set()
        for p, who in owners.items():
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit |= set(range(i, i + len(p)))
                    names |= who
        out.append((key, len(w), len(hit), len(names), tuple(sorted(map(str, names))), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("pass_bytes", [1, 8 << 20])
def test_passages_equal_brute_force(spark, pass_bytes):
    r = random.Random(8)
    vocabulary = ["a", "B", "c", "é", "9", "dd"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 2, 4, 12, 13, 14, 30])))) for i in range(12)] + [(12, ""), (13, None), (14, "...")]
    docs = []
    for i in range(120):
        w = [r.choice(vocabulary) for _ in range(r.choice([0, 1, 5, 60]))]
        if r.random() < 0.6:
            passage = (r.choice(items)[1] or "").split()
            cut = r.randrange(len(passage) + 1)
            w[len(w) // 2 : len(w) // 2] = passage[cut:] if r.random() < 0.3 else passage
        docs.append((i, r.choice([" ", "\n", "-", "_"]).join(w)))
    docs += [(500, None), (501, ""), (3, docs[3][1])]
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n_hit", "'x' as hit_items").repartition(3)
    got = decontaminate.find(table, spark.createDataFrame(items, "item_id long, text string"), pass_bytes=pass_bytes).collect()
    assert sorted(((g.doc_id, g.n_words, g.n_hit, g.n_items, tuple(g.hit_items), g.contaminated) for g in got), key=str) == brute_passages(docs, items)


def test_no_benchmark_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert not decontaminate.find(docs, none).first().contaminated
    assert decontaminate.find(docs.limit(0), docs.selectExpr("doc_id as item_id", "text")).count() == 0


# ---- shards


def test_shards(spark):
    rows = [(i, "x" * (i % 50)) for i in range(3000)] + [(None, "a"), (None, None), (5, "x" * 5), (7, "é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as shard", "2 as key")
    got = sharding.shard(docs).collect()
    assert len(got) == len(rows) and sharding.shard(docs.limit(0)).count() == 0
    by_shard = {}
    for g in got:
        assert g.grown_shard in (g.shard, 16)
        by_shard.setdefault(g.shard, []).append(g.slot)
    assert set(by_shard) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    moved = sum(g.grown_shard == 16 for g in got) / len(got)
    assert 0.03 < moved < 0.1
    assert len({g.shard for g in got if g.doc_id is None}) == 1
    assert {g.size for g in got if g.doc_id == 7} == {8, 3}


def test_weights_give_shares(spark):
    docs = spark.range(8000).selectExpr("id as doc_id", "'' as text")
    shares = Counter(g.shard for g in sharding.shard(docs, weights=(1.0, 3.0, 0.0)).collect())
    assert 2 not in shares and 0.7 < shares[1] / 8000 < 0.8
