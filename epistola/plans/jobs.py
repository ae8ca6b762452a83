"""Whole jobs: classification by recorded answers, orchestrated services, folder batches."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epistola.functions import values
from epistola.operators import documents, evaluation, labels
from epistola.plans import classify
from epistola.plans.classify import Config

ANSWER = "issues array<struct<issue_type:string,confidence:double,evidence:string>>"


def check_batch(texts: DataFrame, most: int = 50) -> DataFrame:
    """texts, or an error if there are more than `most`."""
    if texts.limit(most + 1).count() > most:
        raise ValueError(f"at most {most} texts a batch")
    return texts


def batch_states(texts: DataFrame, batch: str, most: int = 50) -> DataFrame:
    """batch, texts, state: rejected with more than `most` texts, else accepted."""
    counted = texts.groupBy(batch).agg(F.count(F.lit(1)).alias("texts"))
    return counted.withColumn("state", F.when(F.col("texts") > most, "rejected").otherwise("accepted"))


#: Fields of a record that name an issue, in order (fixed values).
ISSUE_FIELDS = ("main_issue", "issue_type", "problem", "concern", "dispute")


def issue_fields(records: DataFrame, key: str = "doc_id", action: str = "action_required") -> DataFrame:
    """key, place, issue_type: the non-empty issue fields of each record in order, then the action with its prefix."""
    filled = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    found = [filled(c) for c in ISSUE_FIELDS if c in records.columns]
    if action in records.columns:
        found.append(F.concat(F.lit("Action Required: "), filled(action)))
    return records.select(key, F.posexplode(F.array_compact(F.array(*found))).alias("place", "issue_type"))


def overall_confidence(scores: Column) -> Column:
    """Mean of the positive scores of an array, 0 without any."""
    positive = F.filter(scores, lambda x: x > 0)
    return F.when(F.size(positive) > 0, F.aggregate(positive, F.lit(0.0), lambda a, x: a + x) / F.size(positive)).otherwise(0.0)


def result_confidence(categories: DataFrame, issues: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, confidence: the largest of a document's category and issue confidences, 0 if all are missing."""
    both = categories.select(key, "confidence").unionByName(issues.select(key, "confidence"))
    return both.groupBy(key).agg(F.greatest(F.coalesce(F.max("confidence"), F.lit(0.0)), F.lit(0.0)).alias("confidence"))


def best_and_worst(measured: DataFrame, key: str, most: int = 5, score: str = "f1_score") -> DataFrame:
    """side (top or bottom), place, key, score: the `most` best and worst rows, ties by key."""
    from pyspark.sql import Window

    sides = []
    for side, order in (("top", F.desc(score)), ("bottom", F.asc(score))):
        rows = measured.select(key, score).orderBy(order, key).limit(most)
        # at most `most` rows
        sides.append(rows.select(F.lit(side).alias("side"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order, key)).alias("place"), key, score))
    return sides[0].unionByName(sides[1])


def answered_issues(answers: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, issue_type, confidence (0.5 if not said), evidence from recorded answers(key, answer)."""
    parsed = F.from_json(values.sanitize_json(values.fenced_json(F.col("answer"))), ANSWER)["issues"]
    each = answers.select(key, F.explode(parsed).alias("i")).where("i.issue_type != ''")
    return each.select(key, "i.issue_type", F.coalesce("i.confidence", F.lit(0.5)).alias("confidence"), F.coalesce("i.evidence", F.lit("")).alias("evidence"))


def prompt_only(answers: DataFrame, edges: DataFrame, counts: DataFrame, cfg: Config = Config(), key: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Issues, categories and validation report from recorded answers(key, answer).

    Issues are validated against those of edges(issue_type, category), corrected or refused,
    mapped, and scaled by the training counts(issue_type, issue_n).
    """
    said = answered_issues(answers, key)
    checked = labels.validate(said, edges.select("issue_type"), "issue_type")
    report = labels.validation_report(checked, key)
    issues = checked.where("valid is not null").groupBy(key, F.col("valid").alias("issue_type")).agg(F.max("confidence").alias("confidence"), F.min("evidence").alias("evidence"))
    pairs = edges.select("issue_type", "category").distinct()
    category_n = pairs.groupBy("category").agg(F.count_distinct("issue_type").alias("category_n"))
    mapped = labels.map_issues(issues, pairs, counts, category_n, key, use_unified=True)
    samples = pairs.join(counts, "issue_type").groupBy("category").agg(F.sum("issue_n").alias("n"))
    adjusted = labels.adjust(mapped, samples, "category").where(F.col("confidence") >= cfg.category_threshold)
    return issues, adjusted.select(key, "category", F.bround("confidence", 6).alias("confidence"), "n_sources", "data_sufficiency"), report


Service = Callable[[DataFrame], DataFrame]


def orchestrate(docs: DataFrame, services: Mapping[str, Service], only: Sequence[str] | None = None) -> DataFrame:
    """docs through the named services in their order, or through the chosen ones, with services_used."""
    chosen = list(services) if only is None else [n for n in services if n in set(only)]
    if only is not None and (unknown := set(only) - set(services)):
        raise ValueError(f"no service {', '.join(sorted(unknown))}")
    for name in chosen:
        docs = docs.transform(services[name])
    return docs.withColumn("services_used", F.array(*[F.lit(n) for n in chosen]).cast("array<string>"))


def process_pages(
    pages: DataFrame, issues: Sequence[tuple[str, Sequence[str]]] = (), edges: DataFrame | None = None, key: str = "doc_id", page: str = "page", text: str = "text", fields: bool = True, classified: bool = True
) -> DataFrame:
    """One record per document from its pages(key, page from 1, text): type, pages, text, fields, categories, in that order.

    The type of the whole document chooses the pages, and only those make the text that fields and categories
    come from. key, doc_type, type_confidence, total_pages, used_pages, compression_ratio, text (pages numbered),
    with fields subject, body, extraction_method, with classified categories and classification_confidence, then
    overall_confidence (mean of the positive scores) and services_used. A document's pages meet in one row.
    """
    joined = lambda d, body: d.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(page, body.alias("b")))).alias("l"))
    together = lambda sep: F.array_join(F.transform("l", lambda x: x["b"]), sep)
    plain = F.coalesce(F.col(text), F.lit(""))
    whole = joined(pages, plain).select(key, together("\n\n").alias("__whole"), F.size("l").cast("long").alias("total_pages"))
    typed = documents.document_type(whole, "__whole", pages=F.col("total_pages")).select(key, "total_pages", "doc_type", F.col("confidence").alias("type_confidence"))
    chosen = documents.chosen_pages(pages.join(typed.select(key, "doc_type"), key), "doc_type", key, page, text)
    numbered = F.concat(F.lit("Page "), F.col(page).cast("string"), F.lit(":\n"), plain)
    read = joined(chosen, numbered).select(key, together("\n\n").alias("text"), F.size("l").cast("long").alias("used_pages"))
    out = typed.join(read, key).withColumn("compression_ratio", F.bround(F.col("used_pages") / F.col("total_pages"), 4))
    scores, services = [F.col("type_confidence")], ["type", "pages", "text"]
    if fields:
        out = documents.letters(out).drop("full_text")
        scores.append(F.when(F.col("subject") != "", 0.8).otherwise(0.4))
        services.append("fields")
    if classified and edges is not None:
        found = classify.rule_issues(out.select(key, "text"), issues, key)
        mapped = found.join(edges.select("issue_type", "category").distinct(), "issue_type").groupBy(key).agg(F.sort_array(F.collect_set("category")).alias("categories"), F.bround(F.max("confidence"), 6).alias("classification_confidence"))
        out = out.join(mapped, key, "left").withColumns({"categories": F.coalesce("categories", F.array().cast("array<string>")), "classification_confidence": F.coalesce("classification_confidence", F.lit(0.0))})
        scores.append(F.col("classification_confidence"))
        services.append("categories")
    return out.withColumns({"overall_confidence": F.bround(overall_confidence(F.array(*scores)), 6), "services_used": F.array(*[F.lit(n) for n in services])})


def batch_job(results: DataFrame, truth: DataFrame, files: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """A folder's report, one row per file, and its overall figures.

    results(key, category, confidence) of a classification, truth(key, category), files(key).
    A file without result failed; figures cover files with truth.
    """
    said = results.groupBy(key).agg(F.sort_array(F.collect_set("category")).alias("predicted"), F.max("confidence").alias("confidence"))
    known = truth.groupBy(key).agg(F.sort_array(F.collect_set("category")).alias("truth"))
    rows = files.select(key).distinct().join(said, key, "left").join(known, key, "left")
    status = F.when(F.col("predicted").isNull(), "failed").otherwise("success")
    report = evaluation.document_metrics(rows.withColumn("status", status))
    shown = report.select(
        key, "status", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.array_join(F.coalesce("predicted", F.array().cast("array<string>")), "; ").alias("predicted"),
        F.array_join(F.coalesce("truth", F.array().cast("array<string>")), "; ").alias("truth"), *[F.when(F.col("truth").isNotNull(), F.col(c)).alias(c) for c in ("tp", "fp", "fn", "precision", "recall", "f1_score")],
    )
    return shown, evaluation.batch_metrics(report.where("truth is not null"))
