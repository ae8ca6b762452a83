from __future__ import annotations

import difflib
import re

import pytest
from pyspark.sql import functions as F

from epistola.functions import similarity, values
from epistola.operators import duplicates, evaluation, labels, search

COS, PAY, EOT, OWN = "Change of Scope", "Payments", "EoT", "Contractor's Obligations"


@pytest.mark.parametrize(
    ("given", "name", "status", "sure"),
    [
        ("EoT", "EoT", "exact", 1), ("  EoT  ", "EoT", "exact", 1), ("PAYMENTS", "Payments", "normalized", 0.95), ("cos", COS, "normalized", 0.95),
        ("payment delay", "Others", "issue_type", 0.7), ("Extention of Time", "EoT", "fuzzy", 0.9412), ("qqqq", "Others", "normalized", 0.5), ("", None, "rejected", 0), (None, None, "rejected", 0),
    ],
)
def test_category(spark, given, name, status, sure):
    row = labels.normalize_category(spark.createDataFrame([(given,)], "category string")).first()
    assert (row.category_norm, row.status, round(row.match_confidence, 4)) == (name, status, sure)


def test_strict_category_lists_and_overlay(spark):
    assert labels.normalize_category(spark.createDataFrame([("qqqq",)], "category string"), strict=True).first().status == "rejected"
    lists = spark.createDataFrame([(1, "Change of Scope, contractors obligation, cos")], "k long, category string")
    assert labels.normalize_category_list(lists, ["k"]).first().categories == [COS, OWN]
    own = spark.createDataFrame([("cos", "Others")], "variant string, category string")
    assert labels.normalize_category(spark.createDataFrame([("cos",)], "category string"), overlay=own).first().category_norm == "Others"


@pytest.mark.parametrize(
    ("given", "name", "sure"),
    [("Utility Shifting", "Utility shifting", 0.95), ("Extension of time proposal", "Extension of Time Proposals", 0.95), ("a  b", "a b", 0.9), ("Trial patch", "Trial patch", 1), (" Trial patch", "Trial patch", 0.95), ("", None, 0)],
)
def test_issue(spark, given, name, sure):
    row = labels.normalize_issue(spark.createDataFrame([(given,)], "issue_type string")).first()
    assert (row.issue_norm, row.issue_confidence) == (name, sure)


@pytest.mark.parametrize(
    ("truth", "said", "tp", "fp", "fn", "p", "r", "exact", "jaccard"),
    [
        ([COS, PAY], [COS, PAY], 2, 0, 0, 1, 1, 1, 1), ([COS, PAY, EOT], [COS, OWN], 1, 1, 2, 0.5, 0.3333, 0, 0.25), ([COS, PAY], [], 0, 0, 2, 0, 0, 0, 0),
        ([], [COS, PAY], 0, 2, 0, 0, 0, 0, 0), ([], [], 0, 0, 0, 0, 0, 1, 1), ([COS, PAY, EOT], [COS, PAY, OWN], 2, 1, 1, 0.6667, 0.6667, 0, 0.5),
    ],
)
def test_metrics(spark, truth, said, tp, fp, fn, p, r, exact, jaccard):
    df = spark.createDataFrame([(truth, said)], "truth array<string>, predicted array<string>")
    m = evaluation.document_metrics(df).first()
    assert (m.tp, m.fp, m.fn, m.precision, m.recall, m.exact_match, m.jaccard_similarity) == (tp, fp, fn, p, r, exact, jaccard)
    assert m.tp + m.fn == len(truth)


def test_category_metrics(spark):
    df = spark.createDataFrame([([COS, PAY], [COS]), ([COS, EOT], [COS, PAY]), ([PAY], [EOT])], "truth array<string>, predicted array<string>")
    got = {r.category: (r.tp, r.fp, r.fn) for r in evaluation.category_metrics(df).collect()}
    assert got == {COS: (2, 0, 0), PAY: (0, 1, 2), EOT: (0, 1, 1)}


def test_sequence_ratio_is_difflib_s(spark):
    pairs = [("abcd", "bcde"), ("", ""), ("x" * 300 + "abc", "abc" + "x" * 250), ("Extention of Time", "extension of time"), (None, "a")]
    got = spark.createDataFrame(pairs, "a string, b string").select(similarity.sequence_ratio("a", "b").alias("r")).collect()
    assert [g.r for g in got] == [None if None in p else difflib.SequenceMatcher(None, *p).ratio() for p in pairs]


def test_validation(spark):
    allowed = spark.createDataFrame([("Payment delay",), ("Utility shifting",), ("Borrow area",)], "issue_type string")
    said = spark.createDataFrame([(1, "Payment delay"), (1, "payment DELAY"), (2, "Utility shiftng"), (3, "zzz"), (3, None)], "doc_id long, issue_type string")
    made = labels.validate(said, allowed, "issue_type")
    got = {r.issue_type: (r.valid, r.validity) for r in made.collect()}
    assert got["Payment delay"] == ("Payment delay", "valid") and got["payment DELAY"] == ("Payment delay", "case")
    assert got["Utility shiftng"] == ("Utility shifting", "corrected") and got["zzz"] == (None, "rejected")
    report = {r.doc_id: r.validation_status for r in labels.validation_report(made).collect()}
    assert report == {1: "clean", 2: "corrected", 3: "rejected_items"}
    mapping = spark.createDataFrame([("Payment delay", PAY)], "issue_type string, category string")
    looked = {r.issue_type: (r.category, round(r.lookup_confidence, 2)) for r in labels.look_up_service(said.dropna(), mapping).collect()}
    assert looked["payment DELAY"] == (PAY, 1.0) and looked["zzz"] == ("Others", 0.1)


@pytest.mark.parametrize(("n", "level", "m"), [(4, "critical", 0.5), (5, "warning", 0.7), (10, "good", 0.85), (20, "very_good", 0.95), (50, "excellent", 1.0)])
def test_levels(spark, n, level, m):
    row = labels.sufficiency(spark.createDataFrame([(n,)], "n long")).first()
    assert (row.level, row.multiplier) == (level, m)


def test_mapping_and_look_up_by_second_key(spark):
    training = spark.createDataFrame([("Utility Shifting", "EoT, Payments"), ("utility shifting", "EoT"), (None, "EoT")], "issue_type string, category string")
    edges = labels.training_edges(training)
    assert {(r.issue_type, r.category, r.n) for r in edges.collect()} == {("Utility shifting", "EoT", 2), ("Utility shifting", "Payments", 1)}
    assert labels.training_edges(training, null_policy="literal").where("issue_type = 'nan'").count() == 1
    issues = spark.createDataFrame([(1, "UTILITY SHIFTING", 0.5, "e")], "doc_id long, issue_type string, confidence double, evidence string")
    counts = spark.createDataFrame([("UTILITY SHIFTING", 3)], "issue_type string, issue_n long")
    made = labels.map_issues(issues, edges, counts, spark.createDataFrame([("EoT", 2)], "category string, category_n long"), use_unified=True)
    assert {r.category: round(r.confidence, 4) for r in made.collect()} == {"EoT": 0.465, "Payments": 0.465}


def test_merge_diff_add_remove(spark):
    old = spark.createDataFrame([("a", "x"), ("b", "y")], "issue_type string, category string")
    new = spark.createDataFrame([("a", "x"), ("a", "z"), ("c", "y")], "issue_type string, category string")
    assert {r.issue_type: r.state for r in labels.mapping_diff(old, new).collect()} == {"a": "DIFFERENT", "b": "ONLY_IN_CURRENT", "c": "NEW"}
    assert {r.issue_type: r.categories for r in labels.mapping_merge(old, new).collect()} == {"a": ["x", "z"], "b": ["y"], "c": ["y"]}
    assert labels.remove_mapping(labels.add_mapping(old, new), old).count() == 1


@pytest.mark.parametrize(
    ("start", "span", "end"),
    [
        ("2020-01-31", "1 month", None), ("2020-01-15", "18 months", "2021-07-15"), ("31/12/2020", "2 Years", "2022-12-31"), ("01-02-2020", "30 days", "2020-03-02"),
        ("2020-02-29", "1 year", None), ("bad", "1 month", None), ("2020-01-01", "soon", None), ("2020-01-01", "2 years 6 months", "2020-03-01"),
    ],
)
def test_planned_end(spark, start, span, end):
    row = spark.createDataFrame([(start, span)], "s string, d string").select(values.planned_end(F.col("s"), F.col("d")).alias("e")).first()
    assert (row.e.isoformat() if row.e else None) == end


@pytest.mark.parametrize(
    "answer", ['{"k": "v"}', '```json\n{"k": "v"}\n```', '```\n{"k": "v"}\n```', 'so:\n```json\n{"k": "v",}\n``` end', "{'k': \"v\"}"]
)
def test_json_answers(spark, answer):
    row = spark.createDataFrame([(answer,)], "a string").select(values.record(F.col("a"), ["k", "z"]).alias("r")).first().r
    assert (row.k, row.z) == ("v", None)


def test_json_repair():
    import json

    assert json.loads(values.repaired('{"a": "he said "no" to it", "b": 1,}')) == {"a": 'he said "no" to it', "b": 1}
    assert json.loads(values.repaired('{"a": "two\nlines"}')) == {"a": "two\nlines"}
    assert json.loads(values.repaired('text {"a": "b"} more')) == {"a": "b"} and values.repaired(None) is None


def test_options_and_samples(spark):
    rows = [('{"category": "payments", "confidence": 0.9}',), ("It is about Payments, surely",), ('{"category": "zzz"}',)]
    got = spark.createDataFrame(rows, "a string").select(values.option(F.col("a"), ["Payments", "EoT"]).alias("o")).collect()
    assert [(g.o.category, g.o.confidence) for g in got] == [("Payments", 0.9), ("Payments", 0.7), (None, None)]
    text = '[{"subject": "A subject that is long enough", "body": "%s"}, {"subject": "short", "body": "x"}' % ("b" * 60)
    assert len(spark.createDataFrame([(text,)], "a string").select(values.sample_pairs(F.col("a")).alias("p")).first().p) == 1


def test_ranking_divergence_priority(spark):
    rows = [(1, f"i{k:02d}", 0.9 - 0.05 * k, 1, "", "semantic_search" if k else "llm_validation") for k in range(10)]
    issues = spark.createDataFrame(rows, "doc_id long, issue_type string, confidence double, search_count long, evidence string, source string")
    ranked = search.rank_issues(issues, most=5).orderBy("rank").collect()
    assert [r.rank for r in ranked] == [0, 1, 2, 3, 4] and ranked[2].confidence == pytest.approx(0.8 * 0.94)
    assert search.divergence_filter(issues, share=0.4).count() == 4 and search.divergence_filter(issues, least=0.9).count() == 10
    assert search.source_priority(issues.withColumn("confidence", 1 - F.col("confidence"))).where("place = 1").first().issue_type == "i00"


def test_refine(spark):
    issues = spark.createDataFrame([(1, "a", 0.8, "ea", "semantic_search"), (1, "b", 0.2, "eb", "semantic_search"), (1, "c", 0.9, "ec", "semantic_search")], "doc_id long, issue_type string, confidence double, evidence string, source string")
    answers = spark.createDataFrame(
        [(1, [("a", 0.5, True), ("b", 1.0, True), ("c", 1.0, False), ("n", 0.3, True)], [("m", 0.5, "r"), ("q", 0.1, "r")]), (2, None, [("Late payment", 0.9, None)]), (3, None, None)],
        "doc_id long, validated array<struct<issue_type:string,confidence:double,is_accurate:boolean>>, missing array<struct<issue_type:string,confidence:double,reason:string>>",
    )
    got = [(r.issue_type, round(r.confidence, 3), r.evidence, r.replaced_issue) for r in search.refine(issues, answers).where("doc_id = 1").orderBy("place").collect()]
    assert got == [("a", 0.4, "ea", None), ("m", 0.5, "eb", "b"), ("n", 0.3, "Document supports n but no specific sentence found", None)]
    docs = spark.createDataFrame([(2, "Dear Sir. The payment for May came late. Yours")], "doc_id long, text string")
    got = [tuple(r)[1:] for r in search.refine(issues.withColumn("reference_evidence", F.lit("ref")), answers, docs).where("doc_id > 1").collect()]
    assert got == [("Late payment", 0.9, "The payment for May came late", search.UNREFERENCED, "llm_validation", None, 1)]


def brute_refined(issues, answers, texts, least=0.01):
    def evidence(text, name):
        words = [w for w in name.lower().split(" ") if len(w) > 2]
        parts = [x for x in (re.sub(r"^\s+|\s+$", "", y) for y in text.split(".")) if x]
        strong = [x for x in parts if sum(w in x.lower() for w in words) >= 2] or [x for x in parts if len(x) > 20 and any(w in x.lower() for w in words[:3])]
        said = strong[0] if strong else ""
        said = said[:197] + "..." if len(said) > 200 else said
        return said or f"Document supports {name} but no specific sentence found"

    out = []
    for key, validated, missing in answers:
        known = {i[0]: i for k, *i in issues if k == key}
        kept = []
        for name, sure, accurate in validated or ():
            if accurate is False:
                continue
            if name in known:
                kept.append([name, known[name][1] * (1.0 if sure is None else sure), known[name][2], known[name][4], known[name][3], None])
            elif (sure or 0.0) >= least:
                kept.append([name, sure, evidence(texts[key], name), search.UNREFERENCED, "llm_validation", None])
        for name, sure, _ in missing or ():
            if (sure or 0.0) < least:
                continue
            for row in kept:
                if sure > row[1] * 1.5:
                    row[:] = [name, sure, row[2], row[3], "llm_validation", row[0]]
                    break
            else:
                if sure >= 0.5:
                    kept.append([name, sure, evidence(texts[key], name), search.UNREFERENCED, "llm_validation", None])
        out += [(key, row[0], round(row[1], 9), *row[2:], place) for place, row in enumerate(kept, 1)]
    return out


def test_refined_query_equals_brute_force(spark, sf):
    from epistola import catalog, catalog_jobs

    found, answers, docs = catalog_jobs.refiner(lambda name: spark.read.parquet(f"{sf}/{name}.parquet"))
    issues = [(r.doc_id, r.issue_type, r.confidence, r.evidence, r.source, r.reference_evidence) for r in found.collect()]
    told = [(r.doc_id, r.validated, r.missing) for r in answers.collect()]
    want = brute_refined(issues, told, {r.doc_id: r.text for r in docs.collect()})
    got = [(r[0], r[1], round(r[2], 9), *r[3:]) for r in catalog.QUERIES["refined"](spark, sf).select("doc_id", "issue_type", "confidence", "evidence", "reference_evidence", "source", "replaced_issue", "place").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(r[6] for r in got) and any("supports" not in r[3] and r[5] == "llm_validation" and not r[6] for r in got)


def test_duplicate_letters(spark):
    import datetime as dt

    d = dt.date(2024, 1, 1)
    rows = [
        (1, "p", "REF/2024/001", d, "Delay in payment schedule", "The payment was late again"), (2, "p", "REF/2024/001", d, "Delay in payment schedule", "The payment was late again"),
        (3, "p", "REF/2024/002", d, "Delay in payment schedule", "The payment was late again"), (4, "q", "REF/2024/001", d, "Other", "Body"), (5, "p", None, d, "x", "y"),
    ]
    letters = spark.createDataFrame(rows, "id long, project string, letter_id string, date_sent date, subject string, body string")
    got = {(r.original_id, r.new_id): (r.score, r.detection_method) for r in duplicates.duplicate_letters(letters, ["project"]).collect()}
    assert got[(1, 2)] == (100.0, "letter_id_match") and got[(1, 3)][1] in ("similarity_algorithm", "high_similarity_match") and (1, 4) not in got
    assert set(got) == {(1, 2), (1, 3), (2, 3)}


def _words(letters, most):
    import itertools

    return ["".join(w) for n in range(1, most + 1) for w in itertools.product(letters, repeat=n)]


@pytest.mark.parametrize("cutoff", [0.6, 0.7, 0.92])
def test_close_pairs_lose_none(spark, cutoff):
    import difflib
    import random

    from epistola.operators import fuzzy

    r = random.Random(5)
    names = _words("ab", 5) + ["aXbXc", "abc", "1/23", "1/423", "Utility shifting works", "tility shifting works", "x" * 210 + "y", "x" * 205 + "yz"]
    names = sorted({*names, *("".join(r.choice("abcd ") for _ in range(r.randrange(1, 14))) for _ in range(120))})
    left = spark.createDataFrame([(n,) for n in names], "a string")
    got = {(x.a, x.b): x.ratio for x in fuzzy.close_pairs(left, left.withColumnRenamed("a", "b"), cutoff).collect()}
    want = {(a, b): q for a in names for b in names if (q := difflib.SequenceMatcher(None, a, b).ratio()) >= cutoff}
    assert got == want


def test_common_subsequences_equal_the_table(spark):
    import random

    from epistola.functions.similarity import common_subsequence

    def table(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    r = random.Random(8)
    pairs = [("", ""), ("", "a"), ("a", ""), ("é😀", "😀é"), ("x" * 63, "x" * 70), ("ab" * 31 + "c", "ba" * 90), ("y" * 64, "y")]
    pairs += [("".join(r.choice("abcé😀") for _ in range(r.randrange(64))), "".join(r.choice("abcé😀") for _ in range(r.randrange(90)))) for _ in range(300)]
    got = common_subsequence([a for a, _ in pairs], [b for _, b in pairs]).tolist()
    assert got == [table(a, b) if len(a) < 64 else -1 for a, b in pairs]


@pytest.mark.parametrize("cutoff", [0.7, 0.92, 0.8])
def test_few_pairs_are_compared_in_full(spark, cutoff):
    """Names with endings at 0.7 and 0.92, ids of 9 to 11 hexadecimal digits at 0.8: the pairs that the bounds leave."""
    from epistola.functions.similarity import common_subsequence
    from epistola.operators import fuzzy

    if cutoff == 0.8:
        docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
        rows = docs.where("text is not null").selectExpr("left(md5(text), 9 + cast(doc_id % 3 as int)) as a").distinct().limit(1500)
    else:
        ends = F.array(*[F.lit(e) for e in (" works", " of the site", " delayed", ", part two", " (revised)", " claim")])
        part = spark.read.parquet("/root/testdata/sf0.1/part.parquet")
        rows = part.select(F.concat("p_name", F.get(ends, F.pmod("p_partkey", F.lit(6)).cast("int"))).alias("a")).distinct()
    n = rows.count()
    other = rows.withColumnRenamed("a", "b")
    found = fuzzy.candidates(rows, other, cutoff).where("a < b").toPandas()
    common = common_subsequence(found["a"].tolist(), found["b"].tolist())
    left = (2 * common >= cutoff * (found["a"].str.len() + found["b"].str.len())).sum()
    close = fuzzy.close_pairs(rows, other, cutoff).where("a < b").count()
    pairs = n * (n - 1) / 2
    print(f"cutoff {cutoff}: {n} strings, candidates {len(found) / pairs:.3f}, compared in full {left / pairs:.4f}, close {close / pairs:.4f} of the pairs")
    assert n > 300 and left - close < 0.01 * pairs and (left < 0.05 * pairs or cutoff == 0.7)


def test_validation_equals_difflib(spark):
    import difflib

    allowed = [w for w in _words("abc", 4) if sum(map(ord, w)) % 3 == 0]
    said = [w for w in _words("abcx", 4) if w not in allowed]
    got = labels.validate(spark.createDataFrame([(w,) for w in said], "issue string"), spark.createDataFrame([(w,) for w in allowed], "issue string"), "issue").collect()
    for r in got:
        best = max(((difflib.SequenceMatcher(None, r.issue, w).ratio(), w) for w in allowed))
        assert (r.valid, r.match_confidence) == ((best[1], best[0]) if best[0] >= 0.7 else (None, 0.0))


def test_issue_variations_equal_brute_force(spark):
    import difflib

    names = ["Delay of the works order", "xDelay of the works order", "delay of the works order", "Delay, of the works order.", " Delay of the works order", "tility shifting works", "Utility shifting works", "Other", "A.B", "AB", "ab ", None]
    want, known = set(), [n for n in names if n]
    for a in known:
        for b in known:
            if a < b:
                plain = [x.replace(".", "").replace(",", "").strip().lower() for x in (a, b)]
                if a.lower().strip() == b.lower().strip():
                    want.add((a, b, "case"))
                elif plain[0] == plain[1]:
                    want.add((a, b, "punctuation"))
                elif difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio() > 0.92:
                    want.add((a, b, "similar"))
    got = labels.issue_variations(spark.createDataFrame([(n,) for n in names], "issue_type string")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 8


def test_duplicate_letters_equal_brute_force(spark):
    import datetime as dt
    import difflib
    import random

    r = random.Random(3)
    rows = []
    for i in range(60):
        key = "".join(r.choice("12/") for _ in range(r.choice([3, 4, 5, 6])))
        rows.append((i, "pq"[i % 2], r.choice([key, key.upper(), "1/23", "1/423", "AbC1", "abc1"]), dt.date(2024, 1, 1 + r.randrange(3)), r.choice(["Delay in payment", "Delay in payments", "Site access"]), r.choice(["The payment was late", "The payment is late", "No road"])))

    def ratio(a, b):
        a, b = a.strip().lower(), b.strip().lower()
        return 1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio()

    def words(s):
        return set(spark_words[s])

    from epistola.functions.text import key_words

    texts = sorted({x for row in rows for x in row[4:]})
    spark_words = {x.t: x.w for x in spark.createDataFrame([(x,) for x in texts], "t string").select("t", key_words(F.col("t")).alias("w")).collect()}

    def alike(a, b):
        x, y = words(a), words(b)
        return max(ratio(a, b), len(x & y) / len(x | y) if x and y else 0.0)

    want = {}
    for new in rows:
        for old in rows:
            if old[0] < new[0] and old[1] == new[1]:
                near = 1.0 if new[2] == old[2] else ratio(new[2], old[2])
                days = abs((new[3] - old[3]).days)
                score = (near * 40 if near > 0.8 else 0) + (20 if days == 0 else (1 - days / 7) * 20) + alike(new[4], old[4]) * 25 + alike(new[5], old[5]) * 15
                if new[2] == old[2]:
                    if old[0] == min(x[0] for x in rows if x[1:3] == new[1:3]):
                        want[old[0], new[0]] = score
                elif near > 0.8 and round(score, 4) >= 75:
                    want[old[0], new[0]] = score
    letters = spark.createDataFrame(rows, "id long, project string, letter_id string, date_sent date, subject string, body string")
    got = {(x.original_id, x.new_id): x.score for x in duplicates.duplicate_letters(letters, ["project"]).collect()}
    assert got.keys() == want.keys() and len(want) > 40 and all(abs(got[k] - want[k]) < 1e-3 for k in want)
