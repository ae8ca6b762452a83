from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from epistola.functions import domains
from epistola.functions import text as tx
from epistola.operators import documents
from epistola.plans import classify

LETTER = """LETTERHEAD OF THE COMPANY
Ref: ABC/12
Subject: Provision of Toll Plaza at km 12
Ref: earlier letter
Dear Sir,
We are writing to submit the proposal for the toll plaza, which the engineer has seen twice.
More text stands here so that the body is long enough.
Yours faithfully,
Someone
"""


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("given", "clean"),
    [("a  b\n c", "a b c"), ("x @ y!!", "x   y!"), ("one , two ..", "one, two."), ("Naïve café_1", "Naïve café_1"), ("", ""), ("it's \"so\"", "it's \"so\"")],
)
def test_clean_text(spark, given, clean):
    assert one(spark, tx.clean_text(F.col("t")), t=given) == clean


def test_ocr_and_document(spark):
    assert one(spark, tx.fix_ocr(F.col("t")), t="l am O k.. aB") == "I am 0 k... a B"
    assert one(spark, tx.normalize_document(F.col("t")), t="1.2. On 3-4-2020") == "On 3/4/2020"


@pytest.mark.parametrize(("n", "spans"), [(0, []), (1, [(0, 0)]), (3, [(0, 2)]), (4, [(0, 2), (2, 3)]), (5, [(0, 2), (2, 4)]), (7, [(0, 2), (2, 4), (4, 6)])])
def test_windows_reach_the_end_once(spark, n, spans):
    docs = spark.createDataFrame([(1, " ".join(f"S{i} is here." for i in range(n)))], "doc_id long, text string")
    rows = documents.sentence_windows(docs).orderBy("window_id").collect()
    assert [(r.start, r.end) for r in rows] == spans
    assert all(r.text.count("here.") == r.end - r.start + 1 for r in rows)


def test_search_windows_of_a_short_text(spark):
    docs = spark.createDataFrame([(1, "One. Two. Three. Four. Five."), (2, "Long sentence number. " * 40)], "doc_id long, text string")
    rows = documents.search_windows(docs).collect()
    assert [(r.window_id, r.start, r.end, r.position_unit) for r in rows if r.doc_id == 1] == [(1, 0, 28, "characters")]
    assert {r.position_unit for r in rows if r.doc_id == 2} == {"sentences"}


def test_quality_failures(spark):
    good = "The contractor submitted seven drawings for approval because the engineer requested changes to them yesterday."
    rows = [(1, good), (2, "short"), (3, good + " Scanned by CamScanner"), (4, "word " * 40), (5, "same line of text here\n" * 5 + "x"), (6, None), (7, "12345")]
    got = {r.doc_id: r for r in documents.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].is_quality and got[1].quality_score == 1
    assert got[2].too_short and not got[2].is_quality
    assert got[3].has_artifacts and got[3].quality_score == pytest.approx(0.2)
    assert got[4].repetitive and got[4].not_meaningful and got[5].has_artifacts
    assert got[6].text_length == 0 and got[6].quality_score == pytest.approx(0.03) and got[7].not_meaningful
    status = {r.doc_id: r.status for r in documents.gate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert status[1] == "pending" and status[2] == "skipped"
    said = documents.quality_reasons(documents.quality(spark.createDataFrame(rows[1:2], "doc_id long, text string"))).first()
    assert said.skip and said.reason == "too short, not meaningful"


def test_repeated_lines(spark):
    text = "\n".join(["a repeated line"] * 4 + ["short"] * 5 + ["another line here"] * 3)
    out = documents.trim_repeated_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text
    assert out.count("a repeated line") == 2 and out.count("short") == 5 and out.count("another line here") == 3


def test_letter(spark):
    rows = [(1, LETTER), (2, "Too short"), (3, "No salutation or topic stands in this rather plain piece of text, only words and more words."), (4, None)]
    got = {r.doc_id: r for r in documents.letters(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "Provision of Toll Plaza" in got[1].subject and got[1].extraction_method == "structured_extraction"
    assert got[1].body.startswith("We are writing to submit") and "faithfully" not in got[1].body
    assert got[2].extraction_method == got[4].extraction_method == "insufficient_content" and got[2].subject == ""
    assert got[3].body
    focus = documents.letters(spark.createDataFrame(rows[:1], "doc_id long, text string")).select(documents.focused().alias("x")).first().x
    assert focus.startswith("Subject: ") and "\n\nContent: We are" in focus


def test_document_type(spark):
    rows = [
        ("minutes", "Minutes of the meeting. Agenda item 1. Present: all. Attended by: some. Action items: none. Venue: here. " * 20),
        ("court", "In the High Court of Justice, writ petition, judgment dated 1/2/2020, interim order, before the Hon'ble judge."),
        ("none", "zzz"),
    ]
    got = {r.id: r for r in documents.document_type(spark.createDataFrame(rows, "id string, text string")).collect()}
    assert got["minutes"].doc_type == "meeting_minutes" and got["minutes"].confidence == 0.95
    assert got["court"].doc_type == "court_orders" and got["none"].doc_type == "unknown"
    named = documents.document_type(spark.createDataFrame(rows[2:], "id string, text string"), file_name=F.lit("mom_agenda_minutes_meeting.pdf")).first()
    assert named.doc_type == "meeting_minutes"
    assert documents.type_accuracy(documents.document_type(spark.createDataFrame(rows, "id string, text string")).withColumn("expected", F.lit("court_orders"))).first().correct == 1


def test_important_pages(spark):
    pages = spark.createDataFrame([(1, i, "SCHEDULE J" if i == 7 else "text") for i in range(1, 12)], "doc_id long, page int, text string")
    assert sorted(r.page for r in documents.important_pages(pages, "contract_agreements").collect()) == [1, 2, 7, 8]
    assert documents.important_pages(pages, "meeting_minutes").count() == 5


def test_key_sentences_and_evidence(spark):
    parts = F.split(F.lit("Nothing here|The delay and payment claim 7|A notice|x"), r"\|")
    row = spark.range(1).select(tx.key_sentences(parts).alias("k"), tx.key_sentences(F.split(F.lit("a|b|c|d"), r"\|")).alias("none")).first()
    assert row.k == ["The delay and payment claim 7", "A notice"] and row.none == ["a", "b", "c"]
    keys = F.array(*[F.lit(w) for w in tx.evidence_words("Extension of time")])
    text = "First part. The schedule shows a delay in time. End"
    assert one(spark, tx.evidence(F.col("t"), keys), t=text) == "The schedule shows a delay in time"
    assert one(spark, tx.evidence(F.col("t"), keys), t="none") == ""
    assert tx.evidence_words("Trial patch") == ["trial", "patch"]


def test_chunks_pack_greedily(spark):
    parts = F.array(*[F.lit("x" * n) for n in (5, 4, 3, 20, 2)])
    assert spark.range(1).select(tx.chunks(parts, 10).alias("c")).first().c == ["xxxxx xxxx", "xxx", "x" * 20, "xx"]


def test_domains():
    assert len(domains.CATEGORIES) == 8 and len(domains.SCAN_PATTERNS) == 16 and len(domains.FILLER_WORDS) == 46
    assert sum(map(len, domains.CATEGORY_VARIANTS.values())) == 47 and len(domains.KEYWORD_STOPS) == 24
    assert {k for k in domains.DOCUMENT_TYPES} == set(domains.DOCUMENT_PATTERNS)


def test_evidence_sentence_equals_a_loop(spark):
    """The first sentence with two key words, else the first longer one with one of the first three, stripped as a whole."""
    keys = ["ab", "cd", " e", "fg"]
    texts = ["", ".", "ab", "ab cd", "no. ab\u00a0. x ab y and much more behind it. cd ab \n. ab cd ef", "fg and nothing else that would count here", " e is what this sentence begins with. so it goes", "x  e is within this one, which is long. AB.CD", "\u2003ab in a long sentence with blanks \u2003.", "ab 456789 12345678 0.ab 456789 12345678 01"]

    def loop(text):
        parts = [p for p in (x.strip() for x in text.split(".")) if p]
        held = lambda p, ks: sum(k in p.lower() for k in ks)
        strong = [p for p in parts if held(p, keys) >= 2]
        weak = [p for p in parts if len(p) > 20 and held(p, keys[:3])]
        return [*strong, *weak, ""][0]

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = docs.select("i", tx.evidence_sentence(F.col("t"), F.array(*[F.lit(k) for k in keys])).alias("e")).orderBy("i").collect()
    assert [r.e for r in got] == [loop(t) for t in texts]


def test_windows_multiply_only_by_issues_that_they_may_speak_for(spark):
    issues = [("one", ["aa", "bb"]), ("two", ["cc", "dd"]), ("three", ["ee", "ff"])]
    docs = spark.createDataFrame([(1, "It has AA and bb here. Nothing."), (2, "cc alone."), (3, None)], "doc_id long, text string")
    found = classify.rule_issues(docs, issues)
    assert [(r.doc_id, r.issue_type, r.confidence, r.evidence) for r in found.collect()] == [(1, "one", 1.0, "It has AA and bb here")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(filter(transform(" in plan
