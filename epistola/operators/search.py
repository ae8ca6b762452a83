"""From search hits to ranked issues and categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epistola.functions import text as tx
from epistola.functions import values


def hits_to_issues(hits: DataFrame, key: str = "doc_id", window: str = "window_id") -> DataFrame:
    """key, issue_type, confidence (boosted over 3 hits), search_count, evidence, reference_evidence, source.

    From hits(key, window, rank, issue_type, similarity, evidence, reference): the largest
    similarity, the hits, the first three distinct sentences and the first two references in
    the order of window and rank.
    """
    ordered = lambda c: F.sort_array(F.collect_list(F.when(F.coalesce(c, F.lit("")) != "", F.struct(window, "rank", F.col(c).alias("s")))))
    grouped = hits.where("issue_type != ''").groupBy(key, "issue_type").agg(
        F.max("similarity").alias("top"), F.count(F.lit(1)).alias("search_count"), ordered("evidence").alias("e"), ordered("reference").alias("r")
    )
    text = lambda c: F.transform(c, lambda x: x["s"])
    return grouped.select(
        key,
        "issue_type",
        values.boosted(F.col("top"), F.col("search_count")).alias("confidence"),
        "search_count",
        F.array_join(F.slice(F.array_distinct(text("e")), 1, 3), "; ").alias("evidence"),
        F.array_join(F.slice(text("r"), 1, 2), "; ").alias("reference_evidence"),
        F.lit("semantic_search").alias("source"),
    )


def rank_issues(issues: DataFrame, key: str = "doc_id", decay: float = 0.03, threshold: float = 0.2, most: int = 5, length: Column | None = None) -> DataFrame:
    """Append rank (from 0, before filtering); decay, penalise generic evidence, drop weak issues, keep as many as the length allows."""
    order = Window.partitionBy(key).orderBy(F.desc("confidence"), "issue_type")
    step = issues.withColumn("rank", F.row_number().over(order) - 1)
    generic = tx.generic_count(F.coalesce("evidence", F.lit("")))
    c = values.decayed(F.col("confidence"), F.col("rank"), decay)
    c = F.when(generic > 3, c * 0.8).otherwise(c)
    c = F.when((F.col("issue_type") == "Authority Engineer") & (F.col("search_count") > 30) & (generic > 2), c * 0.7).otherwise(c)
    kept = step.withColumn("confidence", c).where(F.col("confidence") >= threshold * 0.3)
    limit = F.lit(most) if length is None else F.when(length < 1000, max(2, most - 2)).when(length < 2000, max(3, most - 1)).otherwise(most)
    return kept.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("rank"))).where(F.col("__n") <= limit).drop("__n")


def divergence_filter(issues: DataFrame, key: str = "doc_id", least: float = 0.15, share: float = 0.2) -> DataFrame:
    """Where the mean of the top fifth is at least `least` above that of the bottom fifth, keep the top share (at least one row)."""
    by = Window.partitionBy(key)
    step = issues.withColumns({"__n": F.count(F.lit(1)).over(by), "__r": F.row_number().over(by.orderBy(F.desc("confidence"), "issue_type"))})
    fifth = F.greatest(F.lit(1), F.floor(F.col("__n") * 0.2))
    step = step.withColumn("__f", fifth)
    top = F.avg(F.when(F.col("__r") <= F.col("__f"), F.col("confidence"))).over(by)
    low = F.avg(F.when(F.col("__r") > F.col("__n") - F.col("__f"), F.col("confidence"))).over(by)
    step = step.withColumns({"divergence": F.bround(top - low, 6)})
    keep = F.greatest(F.lit(1), F.floor(F.col("__n") * share))
    return step.where((F.col("__n") <= 1) | (F.col("divergence") < least) | (F.col("__r") <= keep)).drop("__n", "__r", "__f")


def source_priority(issues: DataFrame, key: str = "doc_id") -> DataFrame:
    """Append place (from 1): answers of the refiner first, then search, then others, each by confidence."""
    source = F.when(F.col("source") == "llm_validation", 0).when(F.col("source") == "semantic_search", 1).otherwise(2)
    return issues.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(source, F.desc("confidence"), "issue_type")))


def merge_categories(final: DataFrame, semantic: DataFrame, validated: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, category, confidence, origin: final categories, raised or joined by search categories that have a validated source issue.

    semantic(key, category, confidence, source_issues array) and validated(key, issue_type).
    """
    known = validated.groupBy(key).agg(F.collect_set("issue_type").alias("__known"))
    backed = semantic.join(known, key).where(F.arrays_overlap("source_issues", "__known"))
    backed = backed.groupBy(key, "category").agg(F.max("confidence").alias("found"))
    both = final.select(key, "category", F.col("confidence").alias("given")).join(backed, [key, "category"], "full")
    origin = F.when(F.col("given").isNull(), "search").when(F.col("found") > F.col("given"), "raised").otherwise("final")
    return both.select(key, "category", F.greatest("given", "found").alias("confidence"), origin.alias("origin"))


def window_report(hits: DataFrame, key: str = "doc_id", window: str = "window_id") -> DataFrame:
    """key, window, results, unique_issues, issues, top_similarities, avg_similarity."""
    best = F.slice(F.sort_array(F.collect_list("similarity"), False), 1, 3)
    return hits.groupBy(key, window).agg(
        F.count(F.lit(1)).alias("results"), F.count_distinct("issue_type").alias("unique_issues"), F.array_join(F.sort_array(F.collect_set("issue_type")), "; ").alias("issues"),
        best.alias("top_similarities"), F.bround(F.avg("similarity"), 6).alias("avg_similarity"),
    )


def best_window(report: DataFrame, key: str = "doc_id", window: str = "window_id") -> DataFrame:
    """The window of each document with the largest avg_similarity * (1 + unique_issues / 10), the first of equals."""
    score = F.col("avg_similarity") * (1 + F.col("unique_issues") / 10)
    by = Window.partitionBy(key).orderBy(F.desc("score"), window)
    return report.withColumn("score", F.bround(score, 6)).withColumn("__r", F.row_number().over(by)).where("__r = 1").drop("__r")


def vote(hits: DataFrame, label: str = "label", most: int = 5) -> DataFrame:
    """query_id, label, confidence, votes, place from search hits with a label: boosted over 3 votes and decayed by place."""
    counted = hits.groupBy("query_id", label).agg(F.max("similarity").alias("top"), F.count(F.lit(1)).alias("votes"))
    boosted = counted.withColumn("c", values.boosted(F.col("top"), F.col("votes")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("c"), label))
    ranked = boosted.withColumn("place", place).where(F.col("place") <= most)
    return ranked.select("query_id", label, F.bround(values.decayed(F.col("c"), F.col("place") - 1), 6).alias("confidence"), "votes", "place")


def threshold(results: DataFrame, least: float, most: int | None = None, key: str = "doc_id", label: str = "category") -> DataFrame:
    """Rows of at least that confidence, at most `most` per document."""
    kept = results.where(F.col("confidence") >= least)
    if most is None:
        return kept
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("confidence"), label))
    return kept.withColumn("__r", place).where(F.col("__r") <= most).drop("__r")


def expand(issues: DataFrame, edges: DataFrame, key: str = "doc_id", drop_others: bool = True) -> DataFrame:
    """key, categories: all mapped categories of the detected issues, whatever their confidence."""
    seen = issues.select(key, "issue_type").distinct().join(edges.select("issue_type", "category").distinct(), "issue_type")
    seen = seen.where("lower(category) != 'others'") if drop_others else seen
    return seen.groupBy(key).agg(F.sort_array(F.collect_set("category")).alias("categories"))


def to_issue_centric(categories: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, issue_type, confidence, evidence, categories from category rows with source_issues."""
    each = categories.select(key, "category", F.explode("source_issues").alias("s"))
    top = F.max(F.struct(F.col("s.confidence"), F.length("s.evidence"), F.col("s.evidence"))).alias("m")
    out = each.groupBy(key, F.col("s.issue_type").alias("issue_type")).agg(top, F.sort_array(F.collect_set("category")).alias("categories"))
    return out.select(key, "issue_type", F.col("m.confidence").alias("confidence"), F.col("m.evidence").alias("evidence"), "categories")


def ensemble(results: DataFrame, weights: dict[str, float], key: str = "doc_id", label: str = "category") -> DataFrame:
    """key, label, confidence: confidences of the approaches summed by weight."""
    weight = F.lit(0.0)
    for name, w in weights.items():
        weight = F.when(F.col("approach") == name, w).otherwise(weight)
    return results.groupBy(key, label).agg(F.sum(F.col("confidence") * weight).alias("confidence"))


def reweight(categories: DataFrame, answers: DataFrame, key: str = "doc_id") -> DataFrame:
    """Scale confidence by an answer's accuracy(key, category, accuracy) where it names the category."""
    joined = categories.join(answers.select(key, "category", "accuracy"), [key, "category"], "left")
    return joined.withColumn("confidence", F.col("confidence") * F.coalesce("accuracy", F.lit(1.0)))


#: What stands for evidence of an issue that only the refiner names (fixed values).
UNSUPPORTED, UNREFERENCED = "Document supports {} but no specific sentence found", "LLM validation only - no vector search match"
_ISSUE = "array<struct<issue_type:string,confidence:double,evidence:string,reference_evidence:string,source:string,replaced_issue:string>>"


def refine(issues: DataFrame, answers: DataFrame, docs: DataFrame | None = None, key: str = "doc_id", text: str = "text", least: float = 0.01) -> DataFrame:
    """key, issue_type, confidence, evidence, reference_evidence, source, replaced_issue, place: each document's issues edited by a refiner's recorded answers.

    answers(key, validated array<struct<issue_type, confidence, is_accurate>>, missing
    array<struct<issue_type, confidence, reason>>), one row per key. A confirmed issue is scaled and keeps its evidence, a
    refused or unmentioned one goes, an unknown one is added from `least` on; a suggestion replaces the
    first kept issue of which it is over 1.5 times as sure and takes its evidence over, else joins from 0.5 on. An added
    issue has its evidence from docs(key, text), or says that there is none. The order decides, so it is a fold over each
    document's own answers. issues(key, issue_type, confidence, evidence, source) may have reference_evidence.
    """
    reference = F.col("reference_evidence") if "reference_evidence" in issues.columns else F.lit(None).cast("string")
    known = issues.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("issue_type", "confidence", "evidence", reference.alias("reference_evidence"), "source"))).alias("__known"))
    rows = answers.select(key, "validated", "missing").join(known, key, "left")
    rows = rows.join(docs.select(key, F.col(text).alias("__body")), key, "left") if docs is not None else rows.withColumn("__body", F.lit(None).cast("string"))

    def issue(name: Column, confidence: Column, evidence: Column, reference: Column, source: Column, replaced: Column) -> Column:
        fields = (name, confidence.cast("double"), evidence, reference, source, replaced)
        return F.struct(*[c.alias(n) for c, n in zip(fields, ("issue_type", "confidence", "evidence", "reference_evidence", "source", "replaced_issue"), strict=True)])

    def added(a: Column) -> Column:
        words = F.filter(F.split(F.lower(a["issue_type"]), " "), lambda w: F.length(w) > 2)
        said = tx.evidence(F.coalesce(F.col("__body"), F.lit("")), words)
        told = F.when(said != "", said).otherwise(F.concat(F.lit(UNSUPPORTED.split("{}")[0]), a["issue_type"], F.lit(UNSUPPORTED.split("{}")[1])))
        return issue(a["issue_type"], a["confidence"], told, F.lit(UNREFERENCED), F.lit("llm_validation"), F.lit(None).cast("string"))

    def confirmed(a: Column) -> Column:
        mine = F.filter(F.coalesce("__known", F.array().cast(_ISSUE.replace(",replaced_issue:string", ""))), lambda k: k["issue_type"] == a["issue_type"])
        k = F.get(mine, F.lit(0))
        scaled = issue(k["issue_type"], k["confidence"] * F.coalesce(a["confidence"], F.lit(1.0)), k["evidence"], k["reference_evidence"], k["source"], F.lit(None).cast("string"))
        kept = F.when(F.size(mine) > 0, scaled).when(F.coalesce(a["confidence"], F.lit(0.0)) >= least, added(a))
        return F.when(F.coalesce(a["is_accurate"], F.lit(True)), kept)

    def suggest(made: Column, a: Column) -> Column:
        sure = F.coalesce(a["confidence"], F.lit(0.0))
        place = F.array_position(F.transform(made, lambda r: sure > r["confidence"] * 1.5), F.lit(True))
        swap = F.transform(made, lambda r, i: F.when(i + 1 == place, issue(a["issue_type"], sure, r["evidence"], r["reference_evidence"], F.lit("llm_validation"), r["issue_type"])).otherwise(r))
        out = F.when(sure < least, made).when(place > 0, swap).when(sure >= 0.5, F.concat(made, F.array(added(a)))).otherwise(made)
        return out.cast(_ISSUE)

    first = F.filter(F.transform(F.coalesce("validated", F.array()), confirmed), lambda r: r.isNotNull()).cast(_ISSUE)
    made = F.aggregate(F.coalesce("missing", F.array()), first, suggest)
    return rows.select(key, F.posexplode(made).alias("__i", "__m")).select(key, "__m.*", (F.col("__i") + 1).alias("place"))
