"""Whole results on tables that are larger, or more alike, than the given ones."""

from __future__ import annotations

import datetime as dt
import difflib
import random

import numpy as np
from pyspark.sql import functions as F

from epistola import catalog
from epistola.functions import alike, domains
from epistola.functions.similarity import Matcher
from epistola.operators import duplicates, fuzzy, vectors
from epistola.sources import readers


def _with(spark, tmp_path, **tables):
    for name, rows in tables.items():
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_file_scan_takes_languages_beyond_the_largest_file(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "MAX_BYTES", 200_000)
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "text", "if(doc_id % 7 = 0, null, 'en') as lang")
    got = {r.lang: (r.length, r.reason) for r in catalog.QUERIES["file_scan"](spark, _with(spark, tmp_path, documents=docs)).collect()}
    want = docs.where("text is not null").selectExpr("lang", "octet_length(text) + 1 as n").groupBy("lang").sum("n").collect()
    assert got == {r[0]: (r[1], None) for r in want} and got["en"][0] > 200_000


def _shuffled(spark, run):
    """What run() gives, and the bytes that it shuffled."""
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    total = lambda: sum(s.apply(i).shuffleWriteBytes() for s in [stages()] for i in range(s.size()))
    before = total()
    return run(), total() - before


def test_exact_near_duplicates_do_not_shuffle_vectors_to_every_block(spark):
    r = np.random.default_rng(4)
    m = r.normal(size=(1500, 64))
    m = np.concatenate([m, m[:300] + r.normal(scale=0.2, size=(300, 64))])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>").cache()
    got, moved = _shuffled(spark, lambda: {(x.a, x.b) for x in vectors.near_duplicates_exact(table, 0.95, block=64).collect()})
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(np.round(u @ u.T, 6) >= 0.95, 1))
    assert got == set(zip(a.tolist(), b.tolist(), strict=True)) and len(got) > 200
    assert moved < 16 * m.nbytes


def test_search_does_not_shuffle_vectors_to_every_block(spark, monkeypatch):
    for name, rows in {"QUERY_ROWS": 64, "TABLE_ROWS": 64, "PACKED_QUERIES": 64, "PACKED_ROWS": 128, "HELD_ROWS": 1024}.items():
        monkeypatch.setattr(vectors, name, rows, raising=False)
    m = np.random.default_rng(5).normal(size=(2000, 64))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>").cache()
    assert table.count() == 2000
    found, moved = _shuffled(spark, lambda: vectors.top_k(table, table, 5, same=False).collect())
    assert moved < 8 * m.nbytes
    got = {}
    for x in sorted(found):
        got.setdefault(x.query_id, []).append(x.id)
    d = ((m[:, None, :8] - m[None, :100, :8]) ** 2).sum(2) + ((m[:, None, 8:] - m[None, :100, 8:]) ** 2).sum(2)
    assert len(found) == 10_000 and all(got[q] == [i for i in np.argsort(d[:, q]) if i != q][:5] for q in range(100))


def test_letter_classes_lose_no_pair_and_expand_no_copies(spark):
    r = random.Random(3)
    ids = ["REF/1", "REF/2", "ref/1", "REF/12", "X-9999", "X-9998"]
    rows = [(i, "p", r.choice(ids), dt.date(2024, 1, 1 + r.randrange(2)), "Delay in payment", r.choice(["It is late again.", "It was late again!", None, ""])) for i in range(90)]
    rows += [(i, "p", "COPY-1" if i % 2 else "COPY-2", dt.date(2024, 1, 1), "One", "And the same") for i in range(100, 300)]
    letters = spark.createDataFrame(rows, "id long, project string, letter_id string, date_sent date, subject string, body string")
    pairs = duplicates.duplicate_letters(letters, ["project"]).collect()
    found = duplicates.duplicate_classes(letters, ["project"]).collect()
    what = {x[0]: (x[2], x[3], x[4], x[5] or "") for x in rows}
    smallest: dict = {}
    for i in sorted(what):
        smallest.setdefault(what[i], i)
    name = {i: smallest[w] for i, w in what.items()}
    want = {(x.original_id, x.new_id, x.score, x.detection_method) if x.detection_method == "letter_id_match" else (name[x.original_id], name[x.new_id], x.score, x.detection_method) for x in pairs}
    assert {tuple(x)[:4] for x in found} == want and len(found) == len(want)
    assert all(x.class_id == name[x.new_id] for x in found)
    assert len(found) < 500 < 10_000 < len(pairs)


def test_letters_of_like_ids_are_not_shuffled_by_pair(spark):
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzäß") for _ in range(r.randrange(2, 9))) for _ in range(300)]
    rows = [(i, "p", f"REF/2024/{i % 4}", dt.date(2024, 1, 1 + i % 20), "Delay", " ".join(r.choice(words) for _ in range(r.choice([20, 300, 500])))) for i in range(300)]
    rows += [(300 + i, *x[1:2], f"REF/2024/{4 + i % 4}", *x[3:5], x[5][: 200 + 9 * i] + x[5][300:]) for i, x in enumerate(rows[:60])]
    letters = spark.createDataFrame(rows, "id long, project string, letter_id string, date_sent date, subject string, body string").cache()
    assert letters.count() == 360
    found, moved = _shuffled(spark, lambda: duplicates.duplicate_classes(letters, ["project"]).collect())
    assert moved < 8 * sum(len(x[5]) for x in rows)
    got = {(x.original_id, x.new_id): x.score for x in found if x.detection_method != "letter_id_match"}
    bag = lambda t: {w for w in t.split(" ") if len(w) >= 4 and w not in domains.KEYWORD_STOPS}
    near = difflib.SequenceMatcher(None, "ref/2024/1", "ref/2024/0").ratio() * 40
    wanted = 0
    for old, new in r.sample([(x, y) for x in rows for y in rows if x[0] < y[0] and x[2] != y[2]], 1500):
        days, x, y = abs((old[3] - new[3]).days), bag(new[5]), bag(old[5])
        body = max(difflib.SequenceMatcher(None, new[5], old[5]).ratio(), len(x & y) / len(x | y))
        score = near + (20 if days == 0 else (1 - days / 7) * 20 if days <= 3 else 0) + 25 + body * 15
        assert (old[0], new[0]) in got if score > 75.001 else score > 74.999 or (old[0], new[0]) not in got
        if score > 75.001:
            wanted += 1
            assert abs(got[old[0], new[0]] - score) < 2e-4
    assert wanted > 100


def test_likeness_is_the_standard_ratio_or_the_jaccard(spark):
    r, rows = random.Random(2), []
    for n in range(900):
        signs = r.choice(["ab", "abcdefghijklmnop ", "".join(map(chr, range(97, 300))), "😀ab€é ", "".join(map(chr, range(0x4E00, 0x4F90))) + "😀"])
        a, b = ("".join(r.choice(signs) for _ in range(r.randrange(r.choice([5, 30, 400, 1500])))) for _ in range(2))
        rows.append((n, a, r.choice([b, a[: len(a) // 2] + b + a[len(a) // 2 :], b[:5] + a[3:], a[:7] + b])))
    alike.share_alike(spark)
    a, b, none = F.col("a"), F.col("b"), F.lit("")
    x, y = (alike.words_of(F.array(*map(F.lit, w))) for w in (["", "ä", "z"], ["ä", "z", "w"]))
    table = spark.createDataFrame(rows, "id long, a string, b string")
    made = table.select("id", alike.alike(a, b, none, none, F.lit(0.0)).alias("r"), alike.alike(a, b, none, none, F.lit(0.6)).alias("high"), alike.alike(a, b, x, y, F.lit(0.1)).alias("words"))
    got = {row.id: tuple(row)[1:] for row in made.collect()}
    for n, p, q in rows:
        want = difflib.SequenceMatcher(None, p, q).ratio()
        assert got[n] == (want, want if want >= 0.6 else None, max(want, 0.5))
    assert spark.sql("select 1").select(alike.alike(F.lit(None).cast("string"), none, none, none, F.lit(0.0))).first()[0] is None


def test_short_strings_meet_only_with_a_common_subsequence(spark):
    r = random.Random(6)
    names = ["".join(r.choice("0123456789abcdef") for _ in range(10)) for _ in range(600)]
    table = spark.createDataFrame([(n,) for n in sorted({*names, *(n[:4] + n[5:] for n in names[:50])})], "a string")
    found = fuzzy.candidates(table, table.withColumnRenamed("a", "b"), 0.8).where("a < b").count()
    assert 50 <= found < 500


def test_matcher_has_the_blocks_of_the_standard_one():
    r = random.Random(1)
    for _ in range(400):
        signs = r.choice(["ab", "abcdefghijklmnop ", "".join(map(chr, range(97, 300)))])
        a, b = ("".join(r.choice(signs) for _ in range(r.randrange(r.choice([5, 30, 400])))) for _ in range(2))
        b = r.choice([b, a[: len(a) // 2] + b + a[len(a) // 2 :]])
        mine = Matcher()
        mine.set_seq2(b)
        mine.set_seq1(a)
        assert mine.get_matching_blocks() == difflib.SequenceMatcher(None, a, b).get_matching_blocks()


def test_queries_bound_their_arrow_batches(spark, sf):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    catalog.QUERIES["docx_texts"](spark, sf)
    rows = spark.range(6000, numPartitions=1).mapInPandas(lambda frames: (f.assign(id=len(f)).head(1) for f in frames), "id long")
    assert max(r.id for r in rows.collect()) <= 2000


def test_mapped_issues_are_shuffled_before_they_multiply(spark):
    from epistola.operators import labels

    issues = spark.range(20_000).selectExpr("id div 4 as doc_id", "concat('i', id % 25) as issue_type", "0.5D as confidence", "md5(cast(id as string)) as evidence").cache()
    edges = spark.range(250).selectExpr("concat('i', id % 25) as issue_type", "concat('c', id div 25) as category").cache()
    counts, of = edges.groupBy("issue_type").agg({"*": "count"}).toDF("issue_type", "issue_n").cache(), edges.groupBy("category").agg({"*": "count"}).toDF("category", "category_n").cache()
    assert issues.count() and counts.count() == 25 and of.count() == 10
    got, moved = _shuffled(spark, lambda: labels.map_issues(issues, edges, counts, of).selectExpr("sum(n_sources)").first()[0])
    assert got == 200_000 and moved < 3_000_000


def test_merged_categories_are_not_shuffled_by_issue(spark, sf):
    plan = catalog.QUERIES["category_merge"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and "arrays_overlap" in plan


def test_salvaged_pairs_are_counted_without_a_row_for_each(spark, sf):
    made = catalog.QUERIES["salvaged_pairs"](spark, sf)
    assert "explode(" not in made._jdf.queryExecution().optimizedPlan().toString() and made.count() > 50
