"""The classification plans: documents to categories, by rules or by search, then evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epistola.functions import values
from epistola.functions import text as tx
from epistola.functions.columns import once
from epistola.operators import documents, labels, search, vectors


@dataclass(frozen=True)
class Config:
    """Settings of a run; checked when made."""

    top_k: int = 12
    window_size: int = 3
    overlap: int = 1
    similarity_threshold: float = 0.2
    confidence_decay: float = 0.03
    max_issues: int = 5
    category_threshold: float = 0.2
    divergence: float | None = None
    approaches: tuple[str, ...] = ("hybrid",)

    def __post_init__(self) -> None:
        if not self.approaches:
            raise ValueError("at least one approach is needed")
        if self.window_size < 1 or self.top_k < 1:
            raise ValueError("window_size and top_k are positive")

    def get(self, path: str, default=None):
        """A setting by dotted path."""
        here = self
        for name in path.split("."):
            here = getattr(here, name, default) if not isinstance(here, dict) else here.get(name, default)
        return here


def rule_issues(docs: DataFrame, issues: Sequence[tuple[str, Sequence[str]]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, issue_type, confidence, search_count, evidence: issues whose key words stand in windows, without any model.

    A window with a sentence for the issue is a hit; its similarity is the share of the key
    words that the window has.
    """
    windows = documents.sentence_windows(docs.where(F.col(text).isNotNull()), key, text)
    table = F.array(*[F.struct(F.lit(n).alias("issue_type"), F.array(*[F.lit(w) for w in ws]).alias("words")) for n, ws in issues])
    # a window is put in lower case once and multiplies only by the issues that it may speak for
    each = once(windows, {"__low": F.lower("text")})
    counted = F.transform(table, lambda i: F.struct(i["issue_type"].alias("issue_type"), i["words"].alias("words"), F.size(F.filter(i["words"], lambda w: F.contains(F.col("__low"), w))).alias("n")))
    found = each.select(key, "window_id", "text", F.explode(F.filter(counted, lambda i: i["n"] >= 2)).alias("i"))
    said = once(found, {"__e": tx.evidence_sentence(F.col("text"), F.col("i.words"))}).where("__e != ''")
    hits = said.select(
        key, "window_id", F.lit(1).alias("rank"), F.col("i.issue_type").alias("issue_type"), F.bround(F.col("i.n") / F.size("i.words"), 6).alias("similarity"),
        tx.shorten(F.col("__e"), 200, 197).alias("evidence"), F.lit("").alias("reference"),
    )
    return search.hits_to_issues(hits, key)


def by_rules(docs: DataFrame, issues: Sequence[tuple[str, Sequence[str]]], edges: DataFrame, counts: DataFrame, cfg: Config = Config(), key: str = "doc_id") -> DataFrame:
    """key, category, confidence, n_sources: the model-free flagship.

    Quality gate, windows, rule issues, ranking, mapping to categories and adjustment by
    the training counts(issue_type, issue_n).
    """
    good = documents.quality(docs).where("is_quality").select(key, "text")
    ranked = search.rank_issues(rule_issues(good, issues, key), key, cfg.confidence_decay, cfg.similarity_threshold, cfg.max_issues)
    category_n = edges.groupBy("category").agg(F.count_distinct("issue_type").alias("category_n"))
    mapped = labels.map_issues(ranked.select(key, "issue_type", "confidence", "evidence"), edges, counts, category_n, key, use_unified=True)
    samples = edges.join(counts, "issue_type").groupBy("category").agg(F.sum("issue_n").alias("n"))
    adjusted = labels.adjust(mapped, samples, "category")
    return adjusted.where(F.col("confidence") >= cfg.category_threshold).select(key, "category", F.bround("confidence", 6).alias("confidence"), "n_sources", "data_sufficiency")


def search_hits(windows: DataFrame, index: DataFrame, cfg: Config = Config(), key: str = "doc_id", own: str | None = None) -> DataFrame:
    """Hits of windows(key, window_id, vec_id, text, embedding) in index(vec_id, embedding, issue_type, reference), with evidence from the window.

    own names a column of the index with the document that a row comes from: a document has no hits of its own
    row (one at most). Exact, in blocks; nothing passes through the driver.
    """
    k = cfg.top_k + (own is not None)
    found = vectors.top_k(index, windows.select("vec_id", "embedding"), k, threshold=cfg.similarity_threshold)
    rows = index.select(F.col("vec_id").alias("id"), "issue_type", "reference", *([F.col(own).alias("__own")] if own else []))
    named = found.join(rows, "id").join(windows.select(F.col("vec_id").alias("query_id"), key, "window_id", "text"), "query_id")
    if own:
        others = named.where(~F.col("__own").eqNullSafe(F.col(key))).drop("__own")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
        named = others.withColumn("rank", place).where(F.col("rank") <= cfg.top_k)
    words = F.filter(F.split(F.lower("issue_type"), " "), lambda w: F.length(w) > 2)
    said = once(named, {"__said": tx.evidence_sentence(F.col("text"), words)}).drop("text")
    return once(said, {"evidence": tx.shorten(F.col("__said"), 200, 197)}).drop("__said")


def by_search(
    windows: DataFrame, index: DataFrame, edges: DataFrame, counts: DataFrame, cfg: Config = Config(), key: str = "doc_id", own: str | None = None, answers: DataFrame | None = None, docs: DataFrame | None = None
) -> DataFrame:
    """key, category, confidence, n_sources, evidence, data_sufficiency from embedded windows and an index (search_hits).

    Hits become ranked issues, a refiner's recorded answers (search.refine) edit them where given, the
    issues that are left are mapped to categories, and the training counts(issue_type, issue_n) adjust those.
    """
    ranked = search.rank_issues(search.hits_to_issues(search_hits(windows, index, cfg, key, own), key), key, cfg.confidence_decay, cfg.similarity_threshold, cfg.max_issues)
    if cfg.divergence is not None:
        ranked = search.divergence_filter(ranked, key, cfg.divergence)
    if answers is not None:
        told = answers.join(ranked.select(key).distinct(), key, "left_semi")
        unasked = ranked.join(answers.select(key), key, "left_anti")
        columns = [key, "issue_type", "confidence", "evidence"]
        ranked = search.refine(ranked, told, docs, key).select(columns).unionByName(unasked.select(columns))
    category_n = edges.groupBy("category").agg(F.count_distinct("issue_type").alias("category_n"))
    mapped = labels.map_issues(ranked.select(key, "issue_type", "confidence", "evidence"), edges, counts, category_n, key, use_unified=True)
    samples = edges.join(counts, "issue_type").groupBy("category").agg(F.sum("issue_n").alias("n"))
    return labels.adjust(mapped, samples, "category").where(F.col("confidence") >= cfg.category_threshold)


#: Conditions for an approach, tried in order (fixed values).
ROUTES = (("page_count > 20", "pure_llm"), ("is_scanned", "google_docai"), ("criticality = 'high'", "ensemble"), ("budget = 'low'", "open_source"))


def route(docs: DataFrame, rules: Sequence[tuple[str, str]] = ROUTES, default: str = "hybrid") -> DataFrame:
    """Append approach by the first rule (an SQL condition over the columns) that holds."""
    out: Column = F.lit(default)
    for condition, approach in reversed(rules):
        out = F.when(F.expr(condition), approach).otherwise(out)
    return docs.withColumn("approach", out)


def extract_fields(answers: DataFrame, fields: Sequence[str], answer: str = "answer") -> DataFrame:
    """Append the fields of each answer's JSON, planned_end_date and completeness."""
    made = answers.withColumn("__r", values.record(F.col(answer), fields)).withColumn("completeness", F.bround(values.completeness(F.col("__r"), fields), 4))
    out = made.select(*answers.columns, "__r.*", "completeness")
    if {"start_date", "project_duration"} <= set(fields):
        out = out.withColumn("planned_end_date", values.planned_end(F.col("start_date"), F.col("project_duration")))
    return out


def prompt(docs: DataFrame, allowed: DataFrame, column: str, text: str = "text", context: int | None = 2500) -> DataFrame:
    """Append prompt: the text's first `context` characters (None: all of it) and the allowed labels, which come as one joined list (a dictionary, not data)."""
    names = allowed.agg(F.array_join(F.sort_array(F.collect_set(column)), "\n- ").alias("__names"))
    said = F.concat(F.lit("Use only these labels:\n- "), "__names", F.lit("\n\nDocument:\n"), F.left(text, F.lit(context)) if context is not None else F.col(text))
    return docs.join(F.broadcast(names)).withColumn("prompt", said).drop("__names")
