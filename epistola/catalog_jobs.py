"""More registered queries, each beside its SQL: whole jobs, governance and evaluation reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epistola.functions import domains, stems
from epistola.functions import text as tx
from epistola.operators import documents, evaluation, governance, labels, search, vectors
from epistola.oracles import EDGES, ISSUE_ROWS, ISSUES, JUDGED, LABELS, WINDOWS, WORD, any_of, batch, case, cut, evidence, measured, q
from epistola.oracles import ORACLES as KNOWN
from epistola.oracles import level as level_sql
from epistola.oracles import multiplier as multiplier_sql
from epistola.plans import classify, jobs
from epistola.session import bound_batches, share_package, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register f(spark, t), where t(name) reads a table, and its SQL."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            share_package(spark)
            bound_batches(spark)
            return f(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# ---- governance


def _truth(t):
    return t("part").select(F.concat(F.lit("lot"), (F.col("p_partkey") % 7).cast("string")).alias("file_name"), F.col("p_brand").alias("issue_type"), F.col("p_type").alias("category"))


def _mapper(t):
    return t("part").where("p_size <= 30 and p_brand != 'Brand#13'").select(F.col("p_brand").alias("issue_type"), F.col("p_type").alias("category"))


TRUTH = "(SELECT 'lot' || (p_partkey % 7) AS file_name, p_brand AS issue_type, p_type AS category FROM part)"
MAPPER = "(SELECT DISTINCT p_brand AS issue_type, p_type AS category FROM part WHERE p_size <= 30 AND p_brand <> 'Brand#13')"
_joined = lambda c: F.array_join(c, ",").alias(c)


@query(f"""
WITH m AS (SELECT issue_type, list(category ORDER BY category) AS mc FROM {MAPPER} GROUP BY ALL),
f AS (SELECT file_name, issue_type, list(DISTINCT category ORDER BY category) AS said FROM {TRUTH} GROUP BY ALL),
d AS (SELECT * FROM f JOIN m USING (issue_type) WHERE said <> mc),
g AS (SELECT issue_type, mc, count(DISTINCT file_name) AS files, string_agg(DISTINCT file_name, ',' ORDER BY file_name) AS file_names, list_sort(list_distinct(flatten(list(said)))) AS tc FROM d GROUP BY ALL)
SELECT issue_type, files, file_names, array_to_string(tc, ',') AS truth_categories, array_to_string(mc, ',') AS mapper_categories,
  array_to_string(list_filter(tc, lambda x: NOT list_contains(mc, x)), ',') AS missing, array_to_string(list_filter(mc, lambda x: NOT list_contains(tc, x)), ',') AS extra FROM g
""")
def mapping_differences(spark, t):
    made = governance.mapping_differences(_truth(t), _mapper(t))
    return made.select("issue_type", "files", *[_joined(c) for c in ("file_names", "truth_categories", "mapper_categories", "missing", "extra")])


@query(f"""
SELECT category, count(DISTINCT issue_type) AS missing, string_agg(DISTINCT issue_type, ',' ORDER BY issue_type) AS issue_types
FROM {TRUTH} WHERE issue_type NOT IN (SELECT issue_type FROM {MAPPER}) GROUP BY category
""")
def missing_by_category(spark, t):
    made = governance.missing_by_category(_truth(t), _mapper(t))
    return made.select("category", "missing", _joined("issue_types"))


@query(f"""
SELECT file_name, issue_type, string_agg(DISTINCT category, ', ' ORDER BY category) AS categories
FROM {TRUTH} WHERE issue_type NOT IN (SELECT issue_type FROM {MAPPER}) GROUP BY ALL
""")
def missing_rows(spark, t):
    return governance.missing_rows(_truth(t), _mapper(t))


@query(f"SELECT 'issue' AS kind, issue_type AS name FROM (SELECT DISTINCT issue_type FROM {MAPPER}) UNION ALL SELECT 'category', category FROM (SELECT DISTINCT category FROM {MAPPER})")
def allowlists(spark, t):
    issues, categories = governance.allowlists(_mapper(t))
    return issues.select(F.lit("issue").alias("kind"), F.col("issue_type").alias("name")).union(categories.select(F.lit("category"), "category"))


@query("""
SELECT p_brand AS issue_type, p_name AS body, 0::BIGINT AS sample, 'real' AS source FROM part
UNION ALL SELECT DISTINCT p_brand, 'About ' || p_brand || ', no. ' || s, s, 'synthetic' FROM part, (VALUES (1), (2)) AS n(s)
""")
def combine_training(spark, t):
    made = t("part").select(F.col("p_brand").alias("issue_type")).distinct().withColumn("sample", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))))
    made = made.withColumn("body", F.concat(F.lit("About "), "issue_type", F.lit(", no. "), F.col("sample").cast("string")))
    return governance.combine(t("part").select(F.col("p_brand").alias("issue_type"), F.col("p_name").alias("body")), made).fillna({"sample": 0})


@query("SELECT issue_type, place, body FROM (SELECT p_brand AS issue_type, p_name AS body, row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name) DESC, p_name)::INT AS place FROM (SELECT DISTINCT p_brand, p_name FROM part)) WHERE place <= 3")
def context_examples(spark, t):
    return governance.context_examples(t("part").select(F.col("p_brand").alias("issue_type"), F.col("p_name").alias("body")).distinct())


@query("SELECT issue_type, sample, subject, body FROM (SELECT p_brand AS issue_type, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)::INT AS sample, p_type AS subject, p_name AS body FROM part) WHERE sample <= 2")
def generated_samples(spark, t):
    one = F.struct("p_partkey", F.col("p_type").alias("subject"), F.col("p_name").alias("body"))
    listed = t("part").groupBy(F.col("p_brand").alias("issue_type")).agg(F.sort_array(F.collect_list(one)).alias("l"))
    said = listed.select("issue_type", F.to_json(F.struct(F.transform("l", lambda x: F.struct(x["subject"].alias("subject"), x["body"].alias("body"))).alias("samples"))).alias("answer"))
    return governance.generated_samples(said, 2)


_AUGMENTED = "c_text"
for _word, _other in governance.SYNONYMS:
    _AUGMENTED = f"CASE WHEN substr(md5(concat_ws('|', c_custkey::VARCHAR, '{_word}')), 1, 1) < '8' THEN regexp_replace({_AUGMENTED}, '\\b{_word}\\b', '{_other}', 'g') ELSE {_AUGMENTED} END"


@query(f"SELECT c_custkey, {_AUGMENTED} AS body FROM (SELECT c_custkey, 'We request payment for the work under contract ' || c_custkey || '; the delay is not ours, nor is the workload.' AS c_text FROM customer)")
def augmented(spark, t):
    said = F.concat(F.lit("We request payment for the work under contract "), F.col("c_custkey").cast("string"), F.lit("; the delay is not ours, nor is the workload."))
    return t("customer").select("c_custkey", governance.augmented(said, F.col("c_custkey")).alias("body"))


# ---- jobs


@query("SELECT l_suppkey, count(*) AS texts, CASE WHEN count(*) > 50 THEN 'rejected' ELSE 'accepted' END AS state FROM lineitem GROUP BY ALL")
def batch_states(spark, t):
    return jobs.batch_states(t("lineitem"), "l_suppkey")


@query("""
WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END AS a, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS b, CASE WHEN o_orderkey % 5 = 0 THEN 'reply to ' || o_custkey END AS c FROM orders),
l AS (SELECT o_orderkey, list_filter([nullif(a, ''), b, 'Action Required: ' || c], lambda x: x IS NOT NULL) AS l FROM r)
SELECT o_orderkey, (unnest(generate_series(1, len(l))) - 1)::INT AS place, unnest(l) AS issue_type FROM l
""")
def issue_field_picker(spark, t):
    key = F.col("o_orderkey")
    records = t("orders").select(
        "o_orderkey", F.when(key % 2 == 0, F.col("o_orderpriority")).otherwise("").alias("main_issue"), F.when(key % 3 == 0, F.col("o_orderstatus")).alias("problem"),
        F.when(key % 5 == 0, F.concat(F.lit("reply to "), F.col("o_custkey").cast("string"))).alias("action_required"),
    )
    return jobs.issue_fields(records, "o_orderkey")


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN len(p) > 0 THEN round_even(list_sum(p) / len(p), 6) ELSE 0.0 END AS confidence
FROM (SELECT *, list_filter([l_discount::DOUBLE, l_tax::DOUBLE, (l_quantity - 25)::DOUBLE / 25], lambda x: x > 0) AS p FROM lineitem)
""")
def overall_confidence(spark, t):
    scores = F.array(F.col("l_discount").cast("double"), F.col("l_tax").cast("double"), (F.col("l_quantity") - 25).cast("double") / 25)
    return t("lineitem").select("l_orderkey", "l_linenumber", F.bround(jobs.overall_confidence(scores), 6).alias("confidence"))


@query("""
SELECT doc_id, greatest(coalesce(max(c), 0.0), 0.0) AS confidence FROM (
  SELECT l_orderkey AS doc_id, l_discount::DOUBLE AS c FROM lineitem UNION ALL SELECT o_orderkey, (o_totalprice::DOUBLE - 150000) / 1000000 FROM orders) GROUP BY ALL
""")
def result_confidence(spark, t):
    categories = t("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_discount").cast("double").alias("confidence"))
    issues = t("orders").select(F.col("o_orderkey").alias("doc_id"), ((F.col("o_totalprice").cast("double") - 150000) / 1000000).alias("confidence"))
    return jobs.result_confidence(categories, issues)


def _judged(t):
    from epistola.catalog import _judged as judged

    return judged(t)


@query(f"""
WITH m AS (SELECT doc_id, f1_score FROM ({measured(JUDGED)}))
(SELECT 'top' AS side, row_number() OVER (ORDER BY f1_score DESC, doc_id)::INT AS place, doc_id, f1_score FROM m ORDER BY place LIMIT 5)
UNION ALL (SELECT 'bottom', row_number() OVER (ORDER BY f1_score, doc_id)::INT AS place, doc_id, f1_score FROM m ORDER BY place LIMIT 5)
""")
def best_and_worst(spark, t):
    return jobs.best_and_worst(evaluation.document_metrics(_judged(t)), "doc_id")


#: Recorded answers of a model that has read the whole text: the issues of which it has the first two key words, in lower
#: case where the length is a multiple of three, and an issue that nobody knows where it has a digit.
_NAMES = [n for n, _ in ISSUES]
_FOUND = "len(list_filter(words, lambda w: contains(lower(text), w)))::DOUBLE / len(words)"
_SAID = f"""(SELECT doc_id, CASE WHEN length(text) % 3 = 0 THEN lower(issue_type) ELSE issue_type END AS i, {_FOUND} AS c FROM documents, {ISSUE_ROWS} WHERE contains(lower(text), words[1]) AND contains(lower(text), words[2])
  UNION ALL SELECT doc_id, 'Zzyx 77', 0.5 FROM documents WHERE regexp_matches(text, '[0-9]'))"""
_LABELS = "(VALUES " + ", ".join(f"({q(i)}, {q(c)})" for i, c in LABELS) + ") AS l(issue_type, category)"
_N = "(VALUES " + ", ".join(f"({q(n)}, {4 * k + 3})" for k, n in enumerate(_NAMES)) + ") AS counts(issue_type, issue_n)"
_PROMPTED = f"""
WITH v AS (SELECT s.doc_id, counts.issue_type, s.c FROM {_SAID} AS s LEFT JOIN {_N} ON lower(s.i) = lower(counts.issue_type)),
u AS (SELECT doc_id, issue_type, max(c) AS c FROM v WHERE issue_type IS NOT NULL GROUP BY ALL),
m AS (SELECT doc_id, category, max(c * least(1.0::DOUBLE, 0.9::DOUBLE + least(0.1::DOUBLE, issue_n::DOUBLE / 100))) AS confidence, count(*) AS n_sources FROM u JOIN {_LABELS} USING (issue_type) JOIN {_N} USING (issue_type) GROUP BY ALL),
z AS (SELECT category, sum(issue_n)::BIGINT AS n FROM {_LABELS} JOIN {_N} USING (issue_type) GROUP BY ALL)
"""


def _answers(t):
    low, kinds = F.lower("text"), "struct<issue_type:string,confidence:double>"
    has = lambda w: F.contains(low, F.lit(w))
    issue = lambda name, c: F.struct(name.alias("issue_type"), c.alias("confidence")).cast(kinds)
    made = []
    for name, words in ISSUES:
        called = F.when(F.length("text") % 3 == 0, name.lower()).otherwise(name)
        share = sum((has(w).cast("double") for w in words), F.lit(0.0)) / len(words)
        made.append(F.when(has(words[0]) & has(words[1]), issue(called, share)))
    made.append(F.when(F.col("text").rlike("[0-9]"), issue(F.lit("Zzyx 77"), F.lit(0.5))))
    answer = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array_compact(F.array(*made)).alias("issues"))), F.lit("\n```"))
    return t("documents").select("doc_id", F.when(F.col("text").isNotNull(), answer).alias("answer"))


def _small(spark):
    edges = spark.createDataFrame([(i, c) for i, c in LABELS], "issue_type string, category string")
    return edges, spark.createDataFrame([(n, 4 * k + 3) for k, n in enumerate(_NAMES)], "issue_type string, issue_n int")


@query(f"{_PROMPTED} SELECT doc_id, category, round_even(confidence * {multiplier_sql('n')}, 6) AS confidence, n_sources, {level_sql('n')} AS data_sufficiency FROM m JOIN z USING (category) WHERE confidence * {multiplier_sql('n')} >= 0.2::DOUBLE")
def prompt_only(spark, t):
    return jobs.prompt_only(_answers(t), *_small(spark))[1]


@query(f"{_PROMPTED} SELECT doc_id, count(*) FILTER (issue_type IS NULL) AS rejections, 0::BIGINT AS corrections, count(*) FILTER (issue_type IS NULL) > 0 AS hallucinations, CASE WHEN count(*) FILTER (issue_type IS NULL) > 0 THEN 'rejected_items' ELSE 'clean' END AS validation_status FROM v GROUP BY doc_id")
def prompt_only_report(spark, t):
    return jobs.prompt_only(_answers(t), *_small(spark))[2]


_RESULTS = f"({_PROMPTED} SELECT doc_id, category, round_even(confidence * {multiplier_sql('n')}, 6) AS confidence FROM m JOIN z USING (category) WHERE confidence * {multiplier_sql('n')} >= 0.2::DOUBLE)"
_TRUE = "(SELECT doc_id, CASE WHEN quality = 1 THEN 'EoT' ELSE 'Others' END AS category FROM labels UNION ALL SELECT doc_id, 'Payments' FROM labels WHERE toxic = 1)"
_BATCH = f"""(SELECT doc_id, coalesce(t, []) AS t, coalesce(p, []) AS p, t IS NOT NULL AS known, p IS NOT NULL AS done, confidence FROM (SELECT doc_id FROM documents)
  LEFT JOIN (SELECT doc_id, list(DISTINCT category ORDER BY category) AS p, max(confidence) AS confidence FROM {_RESULTS} GROUP BY ALL) USING (doc_id)
  LEFT JOIN (SELECT doc_id, list(DISTINCT category ORDER BY category) AS t FROM {_TRUE} GROUP BY ALL) USING (doc_id))"""


def _batch(spark, t):
    results = jobs.prompt_only(_answers(t), *_small(spark))[1]  # texts without a known issue have none: those failed
    quality = t("labels").select("doc_id", F.when(F.col("quality") == 1, "EoT").otherwise("Others").alias("category"))
    truth = quality.unionByName(t("labels").where("toxic = 1").select("doc_id", F.lit("Payments").alias("category")))
    return jobs.batch_job(results, truth, t("documents"))


@query(f"""
SELECT doc_id, CASE WHEN done THEN 'success' ELSE 'failed' END AS status, coalesce(confidence, 0.0) AS confidence, coalesce(array_to_string(p, '; '), '') AS predicted, coalesce(array_to_string(t, '; '), '') AS truth,
  CASE WHEN known THEN tp ELSE -1 END AS tp, CASE WHEN known THEN fp ELSE -1 END AS fp, CASE WHEN known THEN fn ELSE -1 END AS fn, CASE WHEN known THEN precision ELSE -1 END AS precision, CASE WHEN known THEN recall ELSE -1 END AS recall, CASE WHEN known THEN f1_score ELSE -1 END AS f1_score
FROM ({measured(_BATCH)})
""")
def batch_job_report(spark, t):
    return _batch(spark, t)[0].fillna(-1, ["tp", "fp", "fn", "precision", "recall", "f1_score"])


@query(batch(f"(SELECT * FROM {_BATCH} WHERE known)"))
def batch_job_figures(spark, t):
    return _batch(spark, t)[1]


_KIND = "CASE WHEN contains(lower(text), 'idiot') THEN 'rude' ELSE 'plain' END"


@query(f"SELECT doc_id, {_KIND} AS kind, length(text)::INT AS size, 'type,size' AS services_used FROM documents")
def orchestrated(spark, t):
    services = {
        "type": lambda d: d.withColumn("kind", F.when(F.contains(F.lower("text"), F.lit("idiot")), "rude").otherwise("plain")),
        "language": lambda d: d.withColumn("language", F.upper("lang")),
        "size": lambda d: d.withColumn("size", F.length("text")),
    }
    made = jobs.orchestrate(t("documents").select("doc_id", "text", "lang"), services, ["size", "type"])
    return made.select("doc_id", "kind", "size", F.array_join("services_used", ",").alias("services_used"))


_EXAMPLES = f"""
spoken AS (SELECT doc_id, lang, regexp_extract_all(lower(coalesce(text, '')), {q(WORD)}) AS w FROM documents),
said AS (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, word) AS r FROM (SELECT doc_id, unnest(w) AS word FROM spoken) WHERE length(word) >= 4 GROUP BY doc_id, word),
examples AS (SELECT doc_id, lang, coalesce((SELECT string_agg(word, ' ' ORDER BY r) FROM said WHERE said.doc_id = spoken.doc_id AND r <= 2), '') AS issue_type, w FROM spoken)
"""


def _embedded(source: str) -> str:
    """SQL of (columns of source, v): the unit vector of the words w."""
    return f"""(SELECT * EXCLUDE (m), list_transform(range(64), lambda i: CASE WHEN len(w) = 0 THEN 0.0 ELSE coalesce(m[i], 0)::DOUBLE / sqrt(list_sum(list_transform(map_values(m), lambda n: n * n))) END) AS v
  FROM (SELECT *, list_histogram(list_transform(w, lambda x: ('0x' || left(md5(x), 8))::BIGINT % 64)) AS m FROM {source}))"""


_SEARCHED = f"""{WINDOWS}, {_EXAMPLES},
asked AS (SELECT doc_id, window_id, text, v FROM {_embedded(f"(SELECT *, regexp_extract_all(lower(text), {q(WORD)}) AS w FROM windows WHERE doc_id % 20 = 0)")}),
kept AS (SELECT * FROM {_embedded("examples")}),
near AS (SELECT a.doc_id, window_id, text, k.doc_id AS id, issue_type, round(list_distance(a.v, k.v) * list_distance(a.v, k.v), 6) AS d FROM asked a JOIN kept k ON a.doc_id <> k.doc_id),
h AS (SELECT *, {evidence("text", "list_filter(string_split(lower(issue_type), ' '), lambda x: length(x) > 2)")} AS e FROM (
  SELECT *, round_even(1 / (1 + d), 6) AS s, row_number() OVER (PARTITION BY doc_id, window_id ORDER BY d, id) AS r FROM near) WHERE r <= 12 AND s >= 0.2 AND issue_type <> ''),
f AS (SELECT doc_id, issue_type, f, row_number() OVER (PARTITION BY doc_id, issue_type ORDER BY min(window_id * 100 + r)) AS n FROM (SELECT *, {cut("e")} AS f FROM h WHERE e <> '') GROUP BY doc_id, issue_type, f),
i AS (SELECT *, coalesce(said, '') AS e FROM (SELECT doc_id, issue_type, CASE WHEN count(*) > 3 THEN least(1.0, max(s) * 1.2::DOUBLE) ELSE max(s) END AS c FROM h GROUP BY ALL)
  LEFT JOIN (SELECT doc_id, issue_type, string_agg(f, '; ' ORDER BY n) AS said FROM f WHERE n <= 3 GROUP BY ALL) USING (doc_id, issue_type)),
p AS (SELECT doc_id, issue_type, e, CASE WHEN {any_of("lower(e)", domains.GENERIC_PHRASES)} > 3 THEN 0.8::DOUBLE ELSE 1 END * (c * (1 - r * 0.03::DOUBLE)) AS c, r FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, issue_type) - 1 AS r FROM i)),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY r) AS place FROM p WHERE c >= 0.2::DOUBLE * 0.3::DOUBLE) WHERE place <= 5),
g AS (SELECT issue_type, lang AS category, count(*) AS n FROM examples WHERE issue_type <> '' GROUP BY ALL),
n AS (SELECT issue_type, sum(n) AS n FROM g GROUP BY ALL),
t AS (SELECT category, sum(n.n) AS n FROM g JOIN n USING (issue_type) GROUP BY ALL),
m AS (SELECT doc_id, category, max(c * least(1.0::DOUBLE, 0.9::DOUBLE + least(0.1::DOUBLE, n.n::DOUBLE / 100))) AS c, count(*) AS n_sources,
  list(e ORDER BY c DESC, issue_type) AS e FROM k JOIN g USING (issue_type) JOIN n USING (issue_type) GROUP BY ALL),
a AS (SELECT m.*, {level_sql("t.n")} AS data_sufficiency, {multiplier_sql("t.n")} AS x FROM m JOIN t USING (category))
SELECT doc_id, category, round_even(c * x, 6) AS confidence, n_sources, array_to_string(list_transform(list_filter(list_transform(range(1, len(e) + 1), lambda i: {{'i': i, 'x': e[i]}}), lambda y: y.x <> '' AND list_position(e, y.x) = y.i), lambda y: y.x), '; ') AS evidence, data_sufficiency
FROM a WHERE c * x >= 0.2::DOUBLE
"""


def _examples(t):
    """Each document as an example: its vector, the issue that its two most frequent longer words name, its language as category."""
    docs = t("documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    words = docs.select("doc_id", F.explode(tx.words(F.col("text"))).alias("word")).where(F.length("word") >= 4).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "word"))
    top = words.withColumn("r", place).where("r <= 2").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda x: x["word"]), " ").alias("issue_type"))
    return vectors.hashed_embedding(docs).drop("text").join(top, "doc_id", "left").fillna({"issue_type": ""}).withColumn("reference", F.lit(""))


@query(_SEARCHED)
def search_classify(spark, t):
    """The windows of every twentieth document against all other documents, to issues with evidence, to adjusted categories."""
    index = stored(_examples(t).withColumn("vec_id", F.col("doc_id")), "examples")
    windows = vectors.hashed_embedding(documents.sentence_windows(t("documents").where("doc_id % 20 = 0")))
    windows = stored(windows.withColumn("vec_id", F.col("doc_id") * 1000000 + F.col("window_id")), "windows")
    known = index.where("issue_type != ''").groupBy("issue_type", F.col("lang").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    counts = known.groupBy("issue_type").agg(F.sum("n").alias("issue_n"))
    made = classify.by_search(windows, index, known.select("issue_type", "category"), counts, own="doc_id")
    return made.select("doc_id", "category", F.bround("confidence", 6).alias("confidence"), "n_sources", "evidence", "data_sufficiency")


def refiner(t):
    """Issues of the documents by their key words, and a refiner's recorded answers, as a reading of the whole text gives them."""
    docs = t("documents").select("doc_id", "text")
    low, n = F.lower("text"), F.length("text")
    kinds = "array<struct<issue_type:string,confidence:double,is_accurate:boolean>>"
    told = [
        F.when(F.contains(low, F.lit(words[0])), F.struct(F.lit(name).alias("issue_type"), ((n + i) % 10 / 10).alias("confidence"), (n % 5 != i).alias("is_accurate")))
        for i, (name, words) in enumerate(ISSUES)
    ]
    more = [F.struct(F.lit(name).alias("issue_type"), (n % (7 + i) / 8).alias("confidence"), F.lit("said so").alias("reason")) for i, (name, _) in enumerate(reversed(ISSUES))]
    missing = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(words[1])), m) for (_, words), m in zip(reversed(ISSUES), more, strict=True)]))
    answers = docs.where("text is not null").select("doc_id", F.array_compact(F.array(*told)).cast(kinds).alias("validated"), missing.alias("missing"))
    found = classify.rule_issues(docs, ISSUES).withColumn("evidence", tx.shorten(F.col("evidence"), 200, 197))
    return found, answers, docs


@query()
def refined(spark, t):
    return search.refine(*refiner(t))


# ---- evaluation and reports


@query("""
SELECT user_id, event_type, results, unique_labels, labels, avg_similarity FROM (
  SELECT user_id, event_type, count(*) AS results, count(DISTINCT event_id % 4) AS unique_labels, string_agg(DISTINCT 'k' || (event_id % 4), '; ' ORDER BY 'k' || (event_id % 4)) AS labels, round_even(avg(value), 6) AS avg_similarity FROM events GROUP BY ALL)
""")
def window_report(spark, t):
    hits = t("events").select("user_id", "event_type", F.concat(F.lit("k"), (F.col("event_id") % 4).cast("string")).alias("issue_type"), F.col("value").cast("double").alias("similarity"))
    made = search.window_report(hits, "user_id", "event_type")
    return made.select("user_id", "event_type", "results", F.col("unique_issues").alias("unique_labels"), F.col("issues").alias("labels"), "avg_similarity")


@query("""
SELECT user_id, event_type, round_even(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, event_type) AS r FROM (
  SELECT user_id, event_type, round_even(avg(value), 6) * (1 + count(DISTINCT event_id % 4)::DOUBLE / 10) AS s FROM events GROUP BY ALL)) WHERE r = 1
""")
def best_window(spark, t):
    hits = t("events").select("user_id", "event_type", F.concat(F.lit("k"), (F.col("event_id") % 4).cast("string")).alias("issue_type"), F.col("value").cast("double").alias("similarity"))
    return search.best_window(search.window_report(hits, "user_id", "event_type"), "user_id", "event_type").select("user_id", "event_type", "score")


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS success, count(*) FILTER (o_orderstatus <> 'F') AS failed, round_even(avg(o_totalprice::DOUBLE), 4) AS avg_seconds, round_even(count(*) FILTER (o_orderstatus = 'F')::DOUBLE / count(*), 6) AS success_rate, 'PARTIAL' AS state FROM orders")
def run_envelope(spark, t):
    runs = t("orders").select(F.when(F.col("o_orderstatus") == "F", "success").otherwise("failed").alias("status"), F.col("o_totalprice").cast("double").alias("seconds"))
    return evaluation.envelope(runs).withColumns({"avg_seconds": F.bround("avg_seconds", 4), "success_rate": F.bround("success_rate", 6)})


@query("SELECT count(*) AS runs, round_even(avg(o_totalprice::DOUBLE), 4) AS avg_seconds, min(o_totalprice::DOUBLE) AS min_seconds, max(o_totalprice::DOUBLE) AS max_seconds, round_even(avg(o_custkey % 10), 6) AS avg_issues, round_even(100.0 * count(*) FILTER (o_custkey % 10 > 0) / count(*), 6) AS with_any_percent FROM orders")
def run_metrics(spark, t):
    runs = t("orders").select(F.col("o_totalprice").cast("double").alias("seconds"), F.lit(0.5).alias("confidence"), (F.col("o_custkey") % 10).alias("n_issues"))
    made = evaluation.run_metrics(runs)
    return made.select("runs", F.bround("avg_seconds", 4).alias("avg_seconds"), "min_seconds", "max_seconds", F.bround("avg_issues", 6).alias("avg_issues"), F.bround("with_any_percent", 6).alias("with_any_percent"))


@query("""
SELECT f AS file_name, string_agg(c || '(' || n || ')', ', ' ORDER BY r) AS categories FROM (
  SELECT *, row_number() OVER (PARTITION BY f ORDER BY n DESC, c) AS r FROM (SELECT l_suppkey AS f, l_returnflag AS c, count(*) AS n FROM lineitem GROUP BY ALL)) WHERE r <= 5 GROUP BY f
""")
def top_categories(spark, t):
    return labels.top_categories(t("lineitem").select(F.col("l_suppkey").alias("file_name"), F.col("l_returnflag").alias("category")))


@query("""
SELECT doc_id, category, confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, category) AS r FROM (
  SELECT l_orderkey AS doc_id, l_returnflag AS category, max(l_discount::DOUBLE) AS confidence FROM lineitem GROUP BY ALL) WHERE confidence >= 0.03) WHERE r <= 2
""")
def threshold_top(spark, t):
    results = t("lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("category")).agg(F.max(F.col("l_discount").cast("double")).alias("confidence"))
    return search.threshold(results, 0.03, 2)


@query("SELECT l_orderkey AS doc_id, l_returnflag AS category, round_even(sum(l_discount::DOUBLE * CASE l_linestatus WHEN 'F' THEN 0.6::DOUBLE WHEN 'O' THEN 0.4::DOUBLE ELSE 0 END), 6) AS confidence FROM lineitem GROUP BY ALL")
def ensemble(spark, t):
    rows = t("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("category"), F.col("l_linestatus").alias("approach"), F.col("l_discount").cast("double").alias("confidence"))
    return search.ensemble(rows, {"F": 0.6, "O": 0.4}).withColumn("confidence", F.bround("confidence", 6))


@query("""
SELECT o_orderkey AS doc_id, o_orderpriority AS category, o_totalprice::DOUBLE / 1000000 * CASE WHEN o_orderkey % 3 = 0 THEN 0.5::DOUBLE ELSE 1.0 END AS confidence FROM orders
""")
def reweight(spark, t):
    rows = t("orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("category"), (F.col("o_totalprice").cast("double") / 1000000).alias("confidence"))
    said = t("orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("category"), F.lit(0.5).alias("accuracy"))
    return search.reweight(rows, said).select("doc_id", "category", "confidence")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 30 > 20 THEN 'pure_llm' WHEN o_orderstatus = 'P' THEN 'google_docai' WHEN o_orderpriority = '1-URGENT' THEN 'ensemble' WHEN o_custkey % 2 = 1 THEN 'open_source' ELSE 'hybrid' END AS approach FROM orders")
def routed(spark, t):
    facts = t("orders").select(
        "o_orderkey", (F.col("o_custkey") % 30).alias("page_count"), (F.col("o_orderstatus") == "P").alias("is_scanned"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "high").otherwise("low").alias("criticality"), F.when(F.col("o_custkey") % 2 == 1, "low").otherwise("high").alias("budget"),
    )
    return classify.route(facts).select("o_orderkey", "approach")


@query("""
SELECT lower(trim(f)) AS file_name, string_agg(DISTINCT tc, ',' ORDER BY tc) AS truth, any_value(p) AS predicted FROM (SELECT ' Doc' || l_orderkey AS f, l_returnflag AS tc FROM lineitem)
JOIN (SELECT 'doc' || o_orderkey AS g, string_agg(DISTINCT o_orderpriority, ',') AS p FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL) ON lower(trim(f)) = g GROUP BY ALL
""")
def against_truth(spark, t):
    truth = t("lineitem").select(F.concat(F.lit(" Doc"), F.col("l_orderkey").cast("string")).alias("file_name"), F.col("l_returnflag").alias("category"))
    said = t("orders").where("o_orderkey % 2 = 0").select(F.concat(F.lit("doc"), F.col("o_orderkey").cast("string")).alias("file_name"), F.col("o_orderpriority").alias("category"))
    return evaluation.against_truth(said, truth, loose=True).select("file_name", _joined("truth"), _joined("predicted"))


_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_HEAD = f"^(?:{_C}{_V}|[aeiou]+)"  # a y in front is a consonant
_M0, _M1, _ONE = f"{_HEAD}[^aeiou]", f"{_HEAD}{_C}{_V}[^aeiou]", f"{_HEAD}{_C}({_V})?$"
_SHUT = f"(regexp_matches({{0}}, '^{_C}[aeiouy][^aeiouwxy]$') OR regexp_matches({{0}}, '^[aeiou][^aeiou]$'))"


def _rules(w: str, rules, test: str) -> str:
    """SQL of the first rule whose suffix w has; test states what must hold of the stem {0}."""
    whens = []
    for suffix, instead in rules:
        left = f"left({w}, length({w}) - {len(suffix)})"
        whens.append(f"WHEN ends_with({w}, '{suffix}') THEN CASE WHEN {test.replace('{0}', left).replace('{w}', w)} THEN {left} || '{instead}' ELSE {w} END")
    return f"CASE {' '.join(whens)} ELSE {w} END"


_STEMS = f"""
t AS (SELECT doc_id, regexp_extract_all(lower(text), '([\\p{{L}}\\p{{N}}_]+|[.,;:])') AS l FROM documents),
s0 AS (SELECT DISTINCT unnest(l) AS word FROM t),
s1 AS (SELECT word, CASE WHEN ends_with(word, 'ies') THEN left(word, length(word) - CASE WHEN length(word) = 4 THEN 1 ELSE 2 END) WHEN ends_with(word, 'sses') THEN left(word, length(word) - 2)
  WHEN ends_with(word, 's') AND NOT ends_with(word, 'ss') THEN left(word, length(word) - 1) ELSE word END AS w FROM s0),
s2 AS (SELECT word, w, CASE WHEN ends_with(w, 'ied') OR ends_with(w, 'eed') THEN NULL WHEN ends_with(w, 'ed') THEN left(w, length(w) - 2) WHEN ends_with(w, 'ing') THEN left(w, length(w) - 3) END AS cut FROM s1),
s3 AS (SELECT word, CASE WHEN ends_with(w, 'ied') THEN left(w, length(w) - CASE WHEN length(w) = 4 THEN 1 ELSE 2 END)
  WHEN ends_with(w, 'eed') THEN CASE WHEN regexp_matches(left(w, length(w) - 3), '{_M0}') THEN left(w, length(w) - 1) ELSE w END
  WHEN cut IS NULL OR NOT regexp_matches(cut, '{_HEAD}') THEN w WHEN regexp_matches(cut, '(at|bl|iz)$') THEN cut || 'e'
  WHEN length(cut) > 1 AND right(cut, 1) = left(right(cut, 2), 1) AND NOT regexp_matches(cut, '[aeiouy]$') THEN CASE WHEN regexp_matches(cut, '[lsz]$') THEN cut ELSE left(cut, length(cut) - 1) END
  WHEN regexp_matches(cut, '{_ONE}') AND {_SHUT.format('cut')} THEN cut || 'e' ELSE cut END AS w FROM s2),
s4 AS (SELECT word, CASE WHEN length(w) > 2 AND ends_with(w, 'y') AND regexp_matches(left(w, length(w) - 1), '([^aeiouy]|^y|[aeiou]y)$') THEN left(w, length(w) - 1) || 'i' ELSE w END AS w FROM s3),
s5 AS (SELECT word, CASE WHEN ends_with(w, 'alli') AND regexp_matches(left(w, length(w) - 4), '{_M0}') THEN left(w, length(w) - 2) END AS again, w FROM s4),
s6 AS (SELECT word, CASE WHEN ends_with(w, 'alli') THEN {_rules("coalesce(again, w)", [r for r in stems.SECOND if r[0].endswith("al")], f"regexp_matches({{0}}, '{_M0}')")}
  WHEN ends_with(w, 'logi') THEN CASE WHEN regexp_matches(left(w, length(w) - 3), '{_M0}') THEN left(w, length(w) - 1) ELSE w END
  ELSE {_rules("w", stems.SECOND, f"regexp_matches({{0}}, '{_M0}')")} END AS w FROM s5),
s7 AS (SELECT word, {_rules("w", stems.THIRD, f"regexp_matches({{0}}, '{_M0}')")} AS w FROM s6),
s8 AS (SELECT word, {_rules("w", [(x, "") for x in stems.FOURTH], f"regexp_matches({{0}}, '{_M1}') AND (NOT ends_with({{w}}, 'ion') OR regexp_matches({{0}}, '[st]$'))")} AS w FROM s7),
s9 AS (SELECT word, CASE WHEN ends_with(w, 'e') AND (regexp_matches(left(w, length(w) - 1), '{_M1}') OR (regexp_matches(left(w, length(w) - 1), '{_ONE}') AND NOT {_SHUT.format('left(w, length(w) - 1)')})) THEN left(w, length(w) - 1) ELSE w END AS w FROM s8),
stemmed AS (SELECT word, {case([(f"word = {q(a)}", q(b)) for a, b in stems.IRREGULAR.items()], f"CASE WHEN length(word) <= 2 THEN word WHEN ends_with(w, 'll') AND regexp_matches(left(w, length(w) - 1), '{_M1}') THEN left(w, length(w) - 1) ELSE w END")} AS stem FROM s9)
"""


@query(f"""WITH {_STEMS}
SELECT t.doc_id, coalesce(s.stems, '') AS stems FROM t LEFT JOIN (SELECT doc_id, string_agg(stem, ' ' ORDER BY i) AS stems FROM (SELECT doc_id, unnest(l) AS word, unnest(range(len(l))) AS i FROM t) JOIN stemmed USING (word) GROUP BY doc_id) s USING (doc_id) WHERE l IS NOT NULL
""")
def stemmed_tokens(spark, t):
    made = t("documents").where("text is not null").select("doc_id", stems.stems(tx.tokens(F.col("text"), keep=())).alias("s"))
    return made.select("doc_id", F.array_join("s", " ").alias("stems"))


@query(f"SELECT doc_id, array_to_string(list_filter(regexp_extract_all(lower(text), '([\\p{{L}}\\p{{N}}_]+|[.,;:])'), lambda w: w NOT IN ('de', 'la', 'a', 'of')), ' ') AS tokens FROM documents")
def token_pipeline(spark, t):
    return t("documents").select("doc_id", F.array_join(tx.tokens(F.col("text"), ("de", "la", "a", "of", "the"), ()), " ").alias("tokens"))


@query("SELECT p_partkey, CASE WHEN contains(lower(p_name), 'a') THEN 'high' WHEN contains(lower(p_name), 'e') THEN 'medium' ELSE 'low' END AS priority FROM part")
def missing_priority(spark, t):
    return t("part").select("p_partkey", tx.missing_priority(F.col("p_name"), ("a",), ("e",)).alias("priority"))


@query("SELECT doc_id, 'Subject: ' || source || chr(10) || chr(10) || 'Content: ' || text AS as_file, source || ' ' || text AS as_index FROM documents")
def assembled(spark, t):
    return t("documents").select("doc_id", tx.assemble(F.col("source"), F.col("text")).alias("as_file"), tx.assemble(F.col("source"), F.col("text"), "index").alias("as_index"))


_QUALITY = KNOWN["doc_quality"]


@query(f"""
SELECT doc_id, NOT is_quality AS skip, array_to_string(list_filter([CASE WHEN too_short THEN 'too short' END, CASE WHEN has_artifacts THEN 'scanner traces' END, CASE WHEN not_meaningful THEN 'not meaningful' END, CASE WHEN repetitive THEN 'repetitive' END], lambda x: x IS NOT NULL)[1:2], ', ') AS reason FROM ({_QUALITY})
""")
def quality_reasons(spark, t):
    made = documents.quality_reasons(documents.quality(t("documents")))
    return made.select("doc_id", "skip", "reason")


@query(f"SELECT issue_type, category FROM {EDGES} WHERE category <> 'Promo' UNION SELECT 'New issue', 'New category'")
def edited_mapping(spark, t):
    """Rows added to a mapping, and an issue's rows taken out."""
    from epistola.catalog import _edges

    edges = labels.add_mapping(_edges(t).where("category != 'Promo'"), spark.createDataFrame([("New issue", "New category"), ("Gone", "x")], "issue_type string, category string"))
    return labels.remove_mapping(edges, spark.createDataFrame([("Gone",)], "issue_type string"))
