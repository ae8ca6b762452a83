from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from epistola.operators import governance
from epistola.plans import jobs


def test_batches_are_bounded(spark):
    assert jobs.check_batch(spark.range(50)).count() == 50
    with pytest.raises(ValueError, match="50"):
        jobs.check_batch(spark.range(51))


def test_services_run_in_their_order(spark):
    services = {"a": lambda d: d.withColumn("x", F.lit(1)), "b": lambda d: d.withColumn("y", F.lit(2)), "c": lambda d: d.withColumn("z", F.col("x") + 1 if "x" in d.columns else F.lit(0))}
    docs = spark.range(2)
    whole, part = jobs.orchestrate(docs, services), jobs.orchestrate(docs, services, ["c", "b"])
    assert whole.first().services_used == ["a", "b", "c"] and whole.first().z == 2
    assert part.first().services_used == ["b", "c"] and part.first().z == 0 and "x" not in part.columns
    with pytest.raises(ValueError, match="no service q"):
        jobs.orchestrate(docs, services, ["q"])


def test_issue_fields(spark):
    rows = [(1, "a", None, "do it"), (2, "", "p", ""), (3, None, None, None)]
    made = jobs.issue_fields(spark.createDataFrame(rows, "doc_id long, main_issue string, problem string, action_required string"))
    assert sorted(map(tuple, made.collect())) == [(1, 0, "a"), (1, 1, "Action Required: do it"), (2, 0, "p")]


def test_overall_confidence(spark):
    got = spark.createDataFrame([([0.5, 0.0, 1.0],), ([0.0, -1.0],), ([],)], "s array<double>").select(jobs.overall_confidence(F.col("s")).alias("c")).collect()
    assert [r.c for r in got] == [0.75, 0.0, 0.0]


def test_prompt_only_corrects_and_refuses(spark):
    said = [
        (1, '{"issues": [{"issue_type": "Delay of the work", "confidence": 0.8}, {"issue_type": "qqq zzz", "confidence": 0.9}]}'),
        (2, '```json\n{"issues": [{"issue_type": "PAYMENT", "confidence": 0.6, "evidence": "unpaid"},]}\n```'), (3, "no answer"), (4, None),
    ]
    edges = spark.createDataFrame([("Delay of the works", "EoT"), ("Payment", "Payments")], "issue_type string, category string")
    counts = spark.createDataFrame([("Delay of the works", 20), ("Payment", 4)], "issue_type string, issue_n int")
    issues, categories, report = jobs.prompt_only(spark.createDataFrame(said, "doc_id long, answer string"), edges, counts)
    assert sorted((r.doc_id, r.issue_type) for r in issues.collect()) == [(1, "Delay of the works"), (2, "Payment")]
    assert {r.category for r in categories.collect()} == {"EoT", "Payments"}
    state = {r.doc_id: (r.corrections, r.rejections, r.validation_status) for r in report.collect()}
    assert state == {1: (1, 1, "rejected_items"), 2: (0, 0, "clean")}


def test_training_file_and_facts(spark, tmp_path):
    for i, name in enumerate(("made_1.csv", "made_2.csv", "raw.csv")):
        (tmp_path / name).write_text("x" * (i + 1))
        os.utime(tmp_path / name, (1_700_000_000 + i, 1_700_000_000 + i))
    found = governance.training_file(spark, [f"{tmp_path}/none_*.csv", f"{tmp_path}/made_*.csv", f"{tmp_path}/raw.csv"])
    assert found.endswith("made_2.csv") and governance.training_file(spark, [f"{tmp_path}/none.csv"]) is None
    facts = {r.file_name: r.file_size for r in governance.file_facts(spark, str(tmp_path), "made_*").collect()}
    assert facts == {"made_1.csv": 1, "made_2.csv": 2}


def test_samples_of_a_generator(spark):
    answer = '{"samples": [{"subject": "s1", "body": "b1"}, {"subject": "s2", "body": ""}, {"subject": "s3", "body": "b3"}, {"subject": "s4", "body": "b4"}]}'
    made = governance.generated_samples(spark.createDataFrame([("x", answer), ("y", "{}"), ("z", None)], "issue_type string, answer string"), 2)
    assert sorted(map(tuple, made.collect())) == [("x", 1, "s1", "b1"), ("x", 2, "s3", "b3")]


def test_augmented_texts_exchange_whole_words(spark):
    got = spark.range(200).select(governance.augmented(F.lit("delay, delayed payment"), F.col("id")).alias("t")).distinct().collect()
    assert {r.t for r in got} == {"delay, delayed payment", "postponement, delayed payment", "delay, delayed remittance", "postponement, delayed remittance"}


def test_batch_job(spark):
    results = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.7), (3, "a", 0.4)], "doc_id long, category string, confidence double")
    truth = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, category string")
    report, figures = jobs.batch_job(results, truth, spark.createDataFrame([(i,) for i in (1, 2, 3)], "doc_id long"))
    rows = {r.doc_id: (r.status, r.confidence, r.predicted, r.tp, r.fp, r.fn) for r in report.collect()}
    assert rows == {1: ("success", 0.7, "a; b", 1, 1, 0), 2: ("failed", 0.0, "", 0, 0, 1), 3: ("success", 0.4, "a", None, None, None)}
    assert figures.first().files == 2 and figures.first().tp == 1


def test_a_document_s_type_chooses_its_pages(spark):
    contract = [(1, i, "This Agreement is entered into. terms and conditions scope of work contract agreement clause" if i == 1 else "\nARTICLE 19\n" if i in (6, 9) else f"page {i}") for i in range(1, 12)]
    minutes = [(2, i, "Minutes of the meeting. Agenda. Attendees" if i == 1 else f"page {i}") for i in range(1, 9)]
    letter = [(3, 1, "Subject: Delay of the payment of bills\nDear Sir,\nThe works were with the crew for a while and the payment is late.\nYours faithfully"), (3, 2, None)]
    pages = spark.createDataFrame(contract + minutes + letter, "doc_id long, page long, text string")
    edges = spark.createDataFrame([("Late payment", "Payments")], "issue_type string, category string")
    got = {r.doc_id: r for r in jobs.process_pages(pages, [("Late payment", ("payment", "late"))], edges).collect()}
    assert got[1].doc_type == "contract_agreements" and got[1].used_pages == 6 and "Page 10:" in got[1].text and "Page 3:" not in got[1].text and got[1].total_pages == 11
    assert got[2].used_pages == 5 and got[2].compression_ratio == 0.625 and got[2].categories == []
    assert got[3].categories == ["Payments"] and got[3].subject.startswith("Delay of the payment") and got[3].services_used == ["type", "pages", "text", "fields", "categories"]
    assert got[3].overall_confidence > 0 and jobs.process_pages(pages.limit(0)).count() == 0


def test_quotas_are_exact_and_nothing_is_reused_too_early(spark):
    from epistola.operators import samples

    rows = [("a", "x")] * 3 + [("a", "y")] * 3 + [("a", "x, y")] + [("b", "x")] * 12 + [("c", None)]
    made = samples.quotas(spark.createDataFrame(rows, "issue_type string, category string"), 12)
    assert {(r.issue_type, r.category): r.quota for r in made.collect()} == {("a", "x"): 2, ("a", "y"): 2, ("a", "x, y"): 1, ("b", "x"): 0, ("c", None): 11}
    assert {r.quota for r in samples.quotas(spark.createDataFrame(rows, "issue_type string, category string"), 12, least=2).collect()} == {2, 11}
    texts = samples.variations(made.fillna({"category": "none"}), ["{issue} {a}", "x {a} y"], {"a": ["1", "2", "3"]}).collect()
    mine = [r.body for r in sorted(texts, key=lambda r: r.sample) if r.issue_type == "c"]
    assert len(mine) == 11 and len(set(mine[:6])) == 6 and all({m.split()[0] for m in mine[i : i + 2]} == {"c", "x"} for i in range(0, 10, 2))
    assert samples.quotas(spark.createDataFrame([], "issue_type string, category string"), 5).count() == 0
