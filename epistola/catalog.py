"""The registered queries of the library: each applies operators to whole tables. Their SQL is in epistola.oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epistola.functions import text as tx
from epistola.functions import values
from epistola.functions.columns import once
from epistola.operators import documents, duplicates, evaluation, labels, search, sentences, vectors
from epistola.oracles import ISSUES, LABELS, ORACLES, RAW_LABELS
from epistola.plans import classify
from epistola.session import bound_batches, share_package, stored
from epistola.sources import readers

FLAGSHIP = "flagship_classify"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]


def query(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Register f(spark, t), where t(name) reads a table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        share_package(spark)
        bound_batches(spark)
        return f(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

    QUERIES[f.__name__] = run
    return f


# ---- documents


@query
def clean_text(spark, t):
    return t("documents").select("doc_id", tx.clean_text(F.col("text")).alias("cleaned"))


@query
def normalize_document(spark, t):
    return t("documents").select("doc_id", tx.normalize_document(F.col("text")).alias("normalized"))


@query
def sentence_windows(spark, t):
    return documents.sentence_windows(t("documents"))


@query
def sentence_model(spark, t):
    return sentences.learn(t("documents")).withColumn("score", F.round("score", 4))


@query
def learned_sentences(spark, t):
    """Sentences by a model of the documents themselves."""
    learned = stored(sentences.learn(t("documents")), "sentence-model")
    made = sentences.split(t("documents").select("doc_id", "text"), learned).select("doc_id", F.posexplode("sentences").alias("i", "sentence"))
    return made.select("doc_id", (F.col("i") + 1).alias("place"), "sentence")


@query
def greedy_chunks(spark, t):
    made = once(t("documents").select("doc_id", "text"), {"s": tx.sentences(F.col("text"))}).select("doc_id", tx.chunks(F.col("s")).alias("c"))
    return made.select("doc_id", F.posexplode("c").alias("chunk", "text"))


@query
def doc_quality(spark, t):
    made = documents.quality(t("documents")).drop("text", "lang", "source", "n_chars")
    rounded = {c: F.bround(c, 6) for c in ("word_diversity", "filler_ratio", "repetition_ratio", "phrase_ratio", "quality_score")}
    return made.withColumns(rounded)


@query
def quality_gate(spark, t):
    return documents.gate(t("documents")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query
def word_repetition(spark, t):
    made = documents.repetition(t("documents").select("doc_id", "text"))
    return made.select("doc_id", "total", "value", "n", F.bround("ratio", 6).alias("ratio"))


@query
def trigram_repetition(spark, t):
    made = documents.repetition(t("documents").select("doc_id", "text"), n=3)
    return made.select("doc_id", "total", "value", "n", F.bround("ratio", 6).alias("ratio"))


@query
def repeated_line_trim(spark, t):
    return documents.trim_repeated_lines(t("documents"))


@query
def boilerplate_reduce(spark, t):
    return documents.reduce(t("documents"))


@query
def key_sentences(spark, t):
    parts = once(t("documents").select("doc_id", "text"), {"s": tx.sentences(F.col("text"))})
    made = parts.select("doc_id", tx.key_sentences(F.col("s"), 10, ("the", "with", "que", "der", "thion")).alias("s"))
    return made.select("doc_id", F.posexplode("s").alias("place", "sentence"))


@query
def evidence_sentence(spark, t):
    return documents.evidence(t("documents"), ISSUES)


@query
def doctype_scores(spark, t):
    return documents.document_type(t("documents")).drop("text", "lang", "source", "n_chars")


@query
def page_types(spark, t):
    pages = t("pages").select("page_id", "url", F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    made = documents.document_type(pages, file_name=F.element_at(F.split("url", "/"), -1))
    return made.groupBy("doc_type").agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg("confidence"), 4).alias("confidence"))


@query
def subject_body(spark, t):
    made = documents.letters(t("conversations"))
    return made.select("conv_id", "turn", "subject", "body", "extraction_method")


@query
def text_facts(spark, t):
    body = F.col("text")
    return t("documents").select(
        "doc_id", tx.length_bucket(body).alias("bucket"), tx.content_hash(body.cast("binary")).alias("hash"), tx.is_scanned(body).alias("scanned"),
        tx.generic_count(body).alias("generic"), F.size(tx.key_words(body)).alias("key_words"), tx.report_evidence(body).alias("shown"),
    )


# ---- labels


def _raw_labels(t):
    case = "CASE o_orderkey % {n} {whens} END".format(n=len(RAW_LABELS), whens=" ".join("WHEN {} THEN '{}'".format(i, v.replace("'", "\\'")) for i, v in enumerate(RAW_LABELS)))
    return t("orders").select("o_orderkey", F.expr(case).alias("category"))


@query
def category_normalize(spark, t):
    return labels.normalize_category(_raw_labels(t), fuzzy=False)


@query
def category_fuzzy(spark, t):
    return labels.normalize_category(_raw_labels(t), strict=True)


@query
def category_lists(spark, t):
    pairs = _raw_labels(t).groupBy(F.expr("o_orderkey div 3").alias("k")).agg(F.array_join(F.sort_array(F.collect_list("category")), ", ").alias("category"))
    return labels.normalize_category_list(pairs, ["k"], fuzzy=False).select("k", "categories")


@query
def category_report(spark, t):
    return labels.category_report(labels.normalize_category(_raw_labels(t), fuzzy=False))


@query
def issue_normalize(spark, t):
    case = "CASE p_partkey % 5 WHEN 0 THEN 'Utility Shifting' WHEN 1 THEN ' Trial patch' WHEN 2 THEN 'a  b' WHEN 3 THEN 'Extension of time proposal' ELSE p_name END"
    return labels.normalize_issue(t("part").select("p_partkey", F.expr(case).alias("issue_type")))


@query
def issue_variants(spark, t):
    named = t("part").select(F.expr("CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN concat(p_name, '.') WHEN 2 THEN concat(p_name, 's') ELSE p_name END").alias("issue_type"))
    return labels.issue_variations(named)


@query
def validate_fuzzy(spark, t):
    typed = t("part").select("p_partkey", F.expr("CASE WHEN p_partkey % 3 = 0 THEN concat(p_name, 'x') ELSE replace(p_name, 'e', '') END").alias("issue_type"))
    return labels.validate(typed, t("part").select(F.col("p_name").alias("issue_type")), "issue_type")


def _training(t):
    return t("part").select(F.col("p_brand").alias("issue_type"), F.expr("CASE WHEN p_size % 5 = 0 THEN concat(p_type, ', Promo') ELSE p_type END").alias("category"))


def _edges(t):
    return labels.training_edges(_training(t))


@query
def issue_category_edges(spark, t):
    return _edges(t)


@query
def mapping_stats(spark, t):
    return labels.mapping_stats(_edges(t))


@query
def unified_mapping_override(spark, t):
    explicit = t("part").where("p_size = 1").select(F.col("p_brand").alias("issue_type"), F.lit("Standard, Extra").alias("categories")).distinct()
    return labels.unified(_edges(t), explicit)


def _issues(t):
    sold = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return sold.groupBy(F.col("l_orderkey").alias("doc_id"), F.col("p_brand").alias("issue_type")).agg(F.max(1 - F.col("l_discount")).alias("confidence"), F.min("p_name").alias("evidence"))


@query
def map_issues(spark, t):
    edges = _edges(t)
    category_n = edges.groupBy("category").agg(F.sum("n").alias("category_n"))
    made = labels.map_issues(_issues(t), edges, labels.frequencies(_training(t)), category_n)
    return made.withColumn("confidence", F.bround("confidence", 6))


@query
def reverse_mapping(spark, t):
    return labels.reverse_map(_edges(t))


@query
def pair_strength(spark, t):
    return labels.pair_strength(_edges(t))


@query
def export_confidence(spark, t):
    return labels.export_confidence(_edges(t))


@query
def category_distribution(spark, t):
    return labels.distribution(_edges(t))


@query
def issue_category_ids(spark, t):
    return labels.positional_ids(_edges(t))


def _counts(t):
    return labels.frequencies(_training(t)).withColumnRenamed("issue_n", "n")


@query
def sufficiency_levels(spark, t):
    made = t("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return labels.sufficiency(made).groupBy("level", "multiplier").agg(F.count(F.lit(1)).alias("orders"))


@query
def sufficiency_report(spark, t):
    return labels.sufficiency_report(_counts(t))


@query
def priority_items(spark, t):
    return labels.priority_items(_counts(t), "issue_type", goal=100)


@query
def sufficiency_adjust(spark, t):
    results = t("customer").select("c_custkey", F.col("c_nationkey").alias("label"), (F.col("c_acctbal") / 10000).alias("confidence"))
    counts = t("supplier").groupBy(F.col("s_nationkey").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return labels.adjust(results, counts, "label")


@query
def mode_category(spark, t):
    return labels.mode_category(_training(t))


@query
def stratified_split(spark, t):
    return labels.stratified_split(t("part").select("p_partkey", "p_brand"), "p_brand", ["p_partkey"])


@query
def validate_labels(spark, t):
    said = t("orders").select("o_orderkey", F.expr("CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority WHEN 1 THEN lower(o_orderpriority) ELSE concat(o_orderpriority, '?') END").alias("label"))
    return labels.validate(said, t("orders").select(F.col("o_orderpriority").alias("label")), "label", fuzzy=False)


def _two_mappings(t):
    old = t("part").where("p_size <= 25").select(F.col("p_name").alias("issue_type"), F.col("p_type").alias("category"))
    new = t("part").where("p_size >= 20").select(F.col("p_name").alias("issue_type"), F.col("p_type").alias("category"))
    return old, new


@query
def mapping_diff(spark, t):
    made = labels.mapping_diff(*_two_mappings(t))
    return made.withColumns({"added": F.array_join("added", ","), "removed": F.array_join("removed", ",")})


@query
def mapping_merge(spark, t):
    return labels.mapping_merge(*_two_mappings(t)).withColumn("categories", F.array_join("categories", ","))


@query
def usage_compare(spark, t):
    return labels.usage_compare(*_two_mappings(t))


@query
def coverage_report(spark, t):
    sold = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    truth = sold.select(F.col("l_suppkey").alias("file_name"), F.concat_ws("/", "p_brand", "p_type").alias("issue_type"))
    mapped = t("part").where("p_size > 10 and p_retailprice < 950").select(F.concat_ws("/", "p_brand", "p_type").alias("issue_type"))
    return labels.coverage(truth, mapped)


@query
def missing_issues(spark, t):
    truth = t("events").select(F.col("event_type").alias("issue_type"), F.col("user_id").alias("file_name"))
    made = labels.missing_issues(truth, t("events").where("value > 350").select(F.col("event_type").alias("issue_type")))
    return made.withColumn("file_names", F.array_join(F.transform("file_names", lambda x: x.cast("string")), ","))


@query
def unpivot_truth(spark, t):
    return readers.truth_by_columns(t("labels"), "doc_id")


# ---- evaluation


def _judged(t):
    truth = F.array_compact(F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("quality") == 0, "junk")))
    low = F.lower("text")
    said = F.array_compact(
        F.array(
            F.when(F.length("text") >= 600, "quality"),
            F.when(F.contains(low, F.lit("idiot")) | F.contains(low, F.lit("clown")), "toxic"),
            F.when(F.contains(low, F.lit("!!")) | F.contains(low, F.lit(" | ")), "junk"),
        )
    )
    return t("documents").select("doc_id", "lang", said.alias("predicted"), "text").join(t("labels").select("doc_id", truth.alias("truth")), "doc_id").drop("text")


@query
def doc_metrics(spark, t):
    made = evaluation.document_metrics(_judged(t))
    return made.select("doc_id", "tp", "fp", "fn", "precision", "recall", "f1_score", "exact_match", "jaccard_similarity", F.array_join("missed", ",").alias("missed"), F.array_join("extra", ",").alias("extra"))


@query
def batch_metrics(spark, t):
    return evaluation.batch_metrics(evaluation.document_metrics(_judged(t)))


@query
def category_metrics(spark, t):
    return evaluation.category_metrics(_judged(t))


@query
def approach_compare(spark, t):
    base = _judged(t)
    other = base.withColumn("predicted", F.array(F.lit("quality")))
    return evaluation.compare_approaches(base.withColumn("approach", F.lit("rules")).unionByName(other.withColumn("approach", F.lit("always"))))


@query
def confusion_accuracy(spark, t):
    return evaluation.accuracy_metrics(_judged(t))


@query
def provider_share(spark, t):
    return evaluation.share(t("events"), "event_type")


@query
def best_of_approaches(spark, t):
    rows = t("events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("category"), F.col("value").alias("confidence"), F.expr("CASE event_id % 3 WHEN 0 THEN 'hybrid' WHEN 1 THEN 'pure' ELSE 'rules' END").alias("approach"))
    return evaluation.best_of(rows)


@query
def keyword_baseline(spark, t):
    issues = spark.createDataFrame([(n, c) for n, c in LABELS], "issue_type string, category string")
    return evaluation.keyword_baseline(t("documents"), issues)


# ---- vectors and search


def _queries(t):
    return t("embeddings").where("vec_id % 20 = 0")


@query
def knn_topk(spark, t):
    return vectors.top_k(t("embeddings"), _queries(t), 12, same=False)


@query
def knn_threshold(spark, t):
    return vectors.top_k(t("embeddings"), _queries(t), 12, threshold=0.45, same=False)


@query
def ivf_topk(spark, t):
    """knn_topk through an inverted file: few cells first, then all that the hits so far don't rule out."""
    table = t("embeddings")
    centres = vectors.train_cells(table, vectors.cells_for(table.count()))
    placed = vectors.assign_cells(table, centres)
    return vectors.search_cells(placed, centres, _queries(t), 12, probes=3, same=False)


def _bent(t):
    """The table and a copy of each vector that is bent a little, axis by axis."""
    base = t("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    bent = base.select((F.col("vec_id") + 1000000000).alias("vec_id"), F.transform("embedding", lambda x, i: x * (1 + (i % 7 - 3) * 0.05)).alias("embedding"))
    return base.unionByName(bent)


@query
def near_duplicate_vectors(spark, t):
    return vectors.near_duplicates(_bent(t), 0.95)


@query
def near_duplicate_vectors_exact(spark, t):
    return vectors.near_duplicates_exact(_bent(t), 0.95)


def _voted(t):
    hits = vectors.top_k(t("embeddings"), _queries(t), 12, same=False)
    return hits.join(t("embeddings").select(F.col("vec_id").alias("id"), "label"), "id")


@query
def knn_label_vote(spark, t):
    return search.vote(_voted(t))


@query
def divergence_filter(spark, t):
    votes = search.vote(_voted(t), most=10).select(F.col("query_id").alias("doc_id"), F.col("label").cast("string").alias("issue_type"), "confidence")
    return search.divergence_filter(votes, least=0.1, share=0.4)


@query
def kmeans_silhouette(spark, t):
    return vectors.clusters(t("embeddings"))


def _sourced(t):
    return _issues(t).withColumn("source", F.expr("CASE length(issue_type) % 3 WHEN 0 THEN 'llm_validation' WHEN 1 THEN 'semantic_search' ELSE 'other' END"))


@query
def source_priority(spark, t):
    return search.source_priority(_sourced(t)).select("doc_id", "issue_type", "confidence", "source", "place")


@query
def rank_issues(spark, t):
    counted = _issues(t).withColumn("search_count", F.lit(1))
    return search.rank_issues(counted, length=F.col("doc_id") % 3000).select("doc_id", "issue_type", "rank", F.bround("confidence", 6).alias("confidence"))


@query
def category_merge(spark, t):
    issues = _issues(t)
    semantic = issues.repartition("doc_id").join(labels.small(_edges(t).select("issue_type", "category")), "issue_type").groupBy("doc_id", "category").agg(F.max("confidence").alias("confidence"), F.collect_set("issue_type").alias("source_issues"))
    final = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("doc_id"), F.col("p_type").alias("category")).agg(F.bround(F.min(1 - F.col("l_discount")), 4).alias("confidence"))
    return search.merge_categories(final, semantic, issues.where("confidence >= 0.97"))


@query
def expand_categories(spark, t):
    return search.expand(_issues(t), _edges(t)).withColumn("categories", F.array_join("categories", ","))


# ---- duplicates, fields


def _letters(t):
    first = F.substring_index("text", "\n", 1)
    return t("documents").select(
        F.col("doc_id").alias("id"), "lang", F.concat_ws("/", "source", F.expr("n_chars div 10")).alias("letter_id"),
        F.expr("date_add(date'2024-01-01', cast(doc_id % 30 as int))").alias("date_sent"), first.alias("subject"), F.col("text").alias("body"),
    )


@query
def duplicate_letters(spark, t):
    return duplicates.duplicate_letters(_letters(t), ["lang"], sequence=False)


@query
def duplicate_letters_sequence(spark, t):
    """Ids that differ in a character or two, compared by their sequence ratio too; copies are one class."""
    letters = _letters(t).withColumn("letter_id", F.expr("regexp_replace(left(md5(subject), 9 + cast(id % 3 as int)), if(id % 5 = 0, '[ab]', 'z'), '')"))
    return duplicates.duplicate_classes(letters, ["lang"])


@query
def planned_end_date(spark, t):
    day = "CASE o_orderkey % 4 WHEN 0 THEN 'yyyy-MM-dd' WHEN 1 THEN 'dd/MM/yyyy' WHEN 2 THEN 'dd-MM-yyyy' ELSE 'MMM yy' END"
    span = "CASE o_orderkey % 5 WHEN 0 THEN concat(o_custkey % 40, ' months') WHEN 1 THEN '2 Years' WHEN 2 THEN concat(o_custkey % 90, ' days') WHEN 3 THEN 'soon' ELSE '2 years 6 months' END"
    rows = t("orders").select(
        "o_orderkey",
        F.expr(f"CASE {day} WHEN 'yyyy-MM-dd' THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 'dd/MM/yyyy' THEN date_format(o_orderdate, 'dd/MM/yyyy') WHEN 'dd-MM-yyyy' THEN date_format(o_orderdate, 'dd-MM-yyyy') ELSE 'unknown' END").alias("start"),
        F.expr(span).alias("duration"),
    )
    return rows.select("o_orderkey", values.planned_end(F.col("start"), F.col("duration")).alias("planned_end"))


@query
def json_fields(spark, t):
    said = F.expr("CASE event_id % 4 WHEN 0 THEN concat('Answer: ```json', chr(10), props, chr(10), '```') WHEN 1 THEN concat('so ', props, ' it is') WHEN 2 THEN replace(props, '}', ',}') ELSE 'none' END")
    made = classify.extract_fields(t("events").select("event_id", said.alias("answer")), ["k", "z"])
    return made.drop("answer")


@query
def synonyms(spark, t):
    return t("orders").select("o_orderkey", values.synonym(F.lower(F.regexp_replace("o_orderpriority", "^[0-9]-", "")), values.URGENCY, "normal").alias("urgency"))


# ---- the flagship


@query
def flagship_classify(spark, t):
    edges = spark.createDataFrame([(i, c) for i, c in LABELS], "issue_type string, category string").withColumn("n", F.lit(1))
    counts = spark.createDataFrame([(n, 4 * k + 3) for k, (n, _) in enumerate(ISSUES)], "issue_type string, issue_n int")
    return classify.by_rules(t("documents"), ISSUES, edges, counts)


# ---- whole jobs and reports, with their SQL beside them

from epistola import catalog_files, catalog_jobs  # noqa: E402, F401

QUERIES |= catalog_jobs.QUERIES
ORACLES |= catalog_jobs.ORACLES
