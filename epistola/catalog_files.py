"""Registered queries around files: what sinks write and sources read again, pages, archives, lookups; each beside its SQL."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from epistola.catalog_jobs import query
from epistola.functions import domains, values
from epistola.functions import text as tx
from epistola.functions.columns import once
from epistola.operators import documents, duplicates, evaluation, labels, samples
from epistola.oracles import EDGES, ISSUES, LABELS, NEAR, TRAINING, named_categories, q, typed
from epistola.plans import classify, jobs
from epistola.session import scratch
from epistola.sources import readers, writers
from epistola.sources.index import VectorIndex

# ---- sinks, read again


def _edges(t):
    given = t("part").select(F.col("p_brand").alias("issue_type"), F.expr("CASE WHEN p_size % 5 = 0 THEN concat(p_type, ', Promo') ELSE p_type END").alias("category"))
    return labels.training_edges(given)


@query("""
SELECT 'results' AS sheet, doc_id, CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END AS shown FROM documents
UNION ALL SELECT 'details', doc_id, CASE WHEN length(text) > 150 THEN string_split(text, '. ')[1] || '...' ELSE text END FROM documents
UNION ALL SELECT 'windows', doc_id, lang FROM documents UNION ALL SELECT 'stats', n, lang FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
""")
def report_sheets(spark, t):
    """The sheets of a batch report, written and read again."""
    folder = scratch(spark, "report")
    docs = t("documents").select("doc_id", F.col("text").alias("body"), F.col("text").alias("evidence"), "lang")
    stats = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("doc_id"))
    writers.batch_report(docs, docs.select("doc_id", "lang"), stats, folder)
    shown = {"results": "body", "details": "evidence", "windows": "lang", "stats": "lang"}
    sheets = [spark.read.parquet(f"{folder}/{name}").select(F.lit(name).alias("sheet"), "doc_id", F.col(c).alias("shown")) for name, c in shown.items()]
    out = sheets[0]
    for sheet in sheets[1:]:
        out = out.unionByName(sheet)
    return out


@query("SELECT doc_id, lang, n_chars, text FROM documents")
def result_json(spark, t):
    """Whole results as JSON lines, written and parsed again."""
    folder, docs = scratch(spark, "results"), t("documents").select("doc_id", "lang", "n_chars", "text")
    writers.result_json(docs).write.text(folder)
    return spark.read.text(folder).select(F.from_json("value", docs.schema).alias("r")).select("r.*")


@query(f"SELECT issue_type, string_agg(category, ',' ORDER BY category) AS categories FROM {EDGES} GROUP BY ALL")
def mapping_saved(spark, t):
    folder = scratch(spark, "mapping")
    writers.write(labels.training_edges(_edges(t).select("issue_type", "category")).groupBy("issue_type").agg(F.sort_array(F.collect_set("category")).alias("categories")), folder, "json")
    return spark.read.json(folder).select("issue_type", F.array_join("categories", ",").alias("categories"))


@query("SELECT DISTINCT 'issue' AS kind, p_brand AS name FROM part UNION ALL SELECT DISTINCT 'category', p_type FROM part")
def allowlist_saved(spark, t):
    folder, part = scratch(spark, "allowed"), t("part")
    names = part.select(F.lit("issue").alias("kind"), F.col("p_brand").alias("name")).union(part.select(F.lit("category"), "p_type")).distinct()
    writers.write(names, folder, "json")
    return spark.read.json(folder).select("kind", "name")


@query(f"SELECT issue_type, category FROM {EDGES}")
def mapping_csv_saved(spark, t):
    """A mapping as CSV, read by a header in some spelling."""
    folder = scratch(spark, "mapping")
    writers.write(_edges(t).select(F.col("issue_type").alias("Issue Type"), F.col("category").alias("Mapped_Category")), folder, "csv")
    return readers.mapping(spark, folder, sep=",")


@query("SELECT 'Default' AS issue_type, 'Others' AS category FROM region LIMIT 1")
def mapping_without_columns(spark, t):
    """A file without the columns of a mapping gives the defaults."""
    folder = scratch(spark, "mapping")
    writers.write(t("region"), folder, "csv")
    return readers.mapping(spark, folder, sep=",", defaults=[("Default", "Others")])


@query(f"SELECT DISTINCT trim(unnest(string_split(category, ','))) AS category FROM {TRAINING}")
def category_domain(spark, t):
    return readers.category_domain(t("part").select(F.expr("CASE WHEN p_size % 5 = 0 THEN concat(p_type, ', Promo') ELSE p_type END").alias("category")))


@query("SELECT p_brand AS issue_type, p_type AS category, p_name AS subject, p_name || chr(10) || '\"x\", y' AS body, CASE WHEN p_size > 9 THEN p_name END AS reference_sentence, 'f' || p_size AS source_file FROM part")
def training_csv(spark, t):
    """The training sheet as CSV with line ends and quotes in its cells, read again."""
    folder = scratch(spark, "training")
    rows = t("part").selectExpr("p_brand as issue_type", "p_type as category", "p_name as subject", "concat(p_name, '\n', '\"x\", y') as body", "if(p_size > 9, p_name, null) as reference_sentence", "concat('f', p_size) as source_file")
    rows.write.option("header", True).option("escape", '"').csv(folder)
    return readers.training(spark, folder, "csv")


@query("SELECT count(*) AS labels, round_even(avg(n), 4) AS mean, min(n) AS least, max(n) AS most FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY ALL)")
def sufficiency_saved(spark, t):
    folder = scratch(spark, "report")
    writers.write(labels.sufficiency_report(t("part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))), folder, "json")
    return spark.read.json(folder).select("labels", "mean", "least", "most")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, strftime(ts::DATE, '%Y-%m-%dT%H:%M:%S.%f') AS day, abs(datediff('day', DATE '2024-02-01', ts::DATE))::INT AS days FROM events")
def database_rows(spark, t):
    """Times as ISO text, and whole days between dates."""
    rows = t("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.to_date("ts").alias("day"))
    return writers.database_rows(rows.withColumn("days", F.abs(F.datediff("day", F.lit("2024-02-01").cast("date")))))


@query(f"SELECT query_id, rank, id, distance, similarity FROM {NEAR} WHERE rank <= 5")
def index_saved(spark, t):
    """An index built from part of the table, extended twice by the same batch, loaded and searched."""
    path, rows = scratch(spark, "index"), t("embeddings").select("vec_id", "embedding")
    index = VectorIndex(spark, path)
    index.build(rows.where("vec_id % 3 > 0"), "m")
    for _ in range(2):
        index.extend(rows.where("vec_id % 3 = 0"), "rest")
    return VectorIndex(spark, path).search(rows.where("vec_id % 20 = 0"), 5, probes=2, same=False)


# ---- files, pages, archives


@query("SELECT lang, sum(strlen(text) + 1)::BIGINT AS length, CAST(NULL AS VARCHAR) AS reason FROM documents WHERE text IS NOT NULL GROUP BY lang")
def file_scan(spark, t):
    folder = scratch(spark, "files")
    writers.text_parts(t("documents").where("text is not null").select("doc_id", "lang", "text"), folder, "lang")
    found = readers.files(spark, folder, ["*.txt"]).withColumn("lang", F.nullif(F.regexp_extract("path", "lang=([^/]*)", 1), F.lit("__HIVE_DEFAULT_PARTITION__")))
    return found.groupBy("lang").agg(F.sum("length").alias("length"), F.max("reason").alias("reason"))


@query("SELECT sum(length(text) + 1)::BIGINT AS characters, sum(len(string_split(text, chr(10))))::BIGINT AS lines FROM documents WHERE text IS NOT NULL")
def text_scan(spark, t):
    folder = scratch(spark, "files")
    t("documents").where("text is not null").select("text").write.text(folder)
    found = readers.text_files(spark, folder)
    return found.agg(F.sum(F.length("text")).alias("characters"), F.sum(F.size(F.split("text", "\n")) - 1).alias("lines"))


def _pages(t):
    """Turns as pages: those of the user have a text layer, others come from a scan."""
    said = t("conversations")
    return said.select(F.col("conv_id").cast("string").alias("path"), (F.col("turn") + 1).alias("page"), F.expr("if(role = 'user', 'text', 'ocr')").alias("method"), F.expr("if(turn % 3 = 2, left(text, 40), text)").alias("text"))


@query("""
WITH p AS (SELECT conv_id::VARCHAR AS path, turn + 1 AS page, role = 'user' AS layer, CASE WHEN turn % 3 = 2 THEN left(text, 40) ELSE text END AS text FROM conversations),
u AS (SELECT path, page, NOT (layer AND length(trim(text)) > 50) AND NOT layer AND length(trim(text)) > 20 AS by_ocr,
  CASE WHEN layer THEN text WHEN length(trim(text)) > 20 THEN text ELSE '' END AS used FROM p)
SELECT path, coalesce(string_agg('Page ' || page || ':' || chr(10) || used, chr(10) || chr(10) ORDER BY page) FILTER (trim(used) <> ''), '') AS text,
  CASE WHEN count(*) FILTER (by_ocr) = 0 THEN 'text_only' WHEN count(*) FILTER (by_ocr) = count(*) THEN 'ocr_only' ELSE 'hybrid_text+ocr(' || count(*) FILTER (by_ocr) || 'pages)' END AS method FROM u GROUP BY path
""")
def hybrid_pages(spark, t):
    return readers.hybrid_text(_pages(t))


@query("SELECT conv_id::VARCHAR AS path, turn + 1 AS page FROM conversations WHERE turn + 1 IN (1, 3)")
def selected_pages(spark, t):
    return readers.select_pages(_pages(t), [1, 3]).select("path", "page")


def _cannot(content: bytes) -> list[str]:
    raise ValueError("no reader")


@query("""
SELECT CASE WHEN doc_id % 5 = 0 THEN doc_id || '.bad' ELSE doc_id || '.txt' END AS path, (CASE WHEN doc_id % 5 > 0 THEN 1 ELSE 0 END)::BIGINT AS page, 'text' AS method,
  CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END AS text, CASE WHEN doc_id % 5 = 0 THEN 'error: no reader' END AS error FROM documents WHERE text IS NOT NULL
""")
def pages_with_errors(spark, t):
    """A reader that fails gives a row with its error."""
    found = t("documents").where("text is not null").select(F.expr("concat(doc_id, if(doc_id % 5 = 0, '.bad', '.txt'))").alias("path"), F.col("text").cast("binary").alias("content"))
    return readers.page_texts(found, {"bad": [("text", _cannot)]}).fillna({"page": 0})


@query("""
SELECT doc_id AS path, CASE WHEN length(trim(a)) >= 50 THEN a WHEN length(trim(b)) >= 50 THEN b WHEN length(trim(c)) >= 50 THEN c END AS text,
  CASE WHEN length(trim(a)) >= 50 THEN 'docai' WHEN length(trim(b)) >= 50 THEN 'pypdf' WHEN length(trim(c)) >= 50 THEN 'tesseract' END AS method,
  CASE WHEN length(trim(a)) >= 50 THEN 0.9 WHEN length(trim(b)) >= 50 THEN 0.7 WHEN length(trim(c)) >= 50 THEN 0.6 END::DOUBLE AS confidence,
  CASE WHEN coalesce(length(trim(a)), 0) < 50 AND coalesce(length(trim(b)), 0) < 50 AND coalesce(length(trim(c)), 0) < 50 THEN 'no readable text' END AS error
FROM (SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN text END AS a, left(text, 60) AS b, lang || text AS c FROM documents)
""")
def usable_texts(spark, t):
    docs = t("documents").selectExpr("doc_id as path", "if(n_chars % 2 = 0, text, null) as docai", "left(text, 60) as pypdf", "concat(lang, text) as tesseract")
    return readers.first_usable(docs)


_SPACE = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_CONTROLS = "[\\x00-\\x08\\x0B-\\x1F\\x{FFFE}\\x{FFFF}]"


def _docx(text: str) -> bytes:
    from xml.sax.saxutils import escape

    body = "".join(f"<w:p><w:r><w:t>{escape(line)}</w:t></w:r></w:p>" for line in text.split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{_SPACE}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


@query(f"SELECT doc_id || '.docx' AS path, array_to_string(list_filter(string_split(regexp_replace(text, '{_CONTROLS}', '', 'g'), chr(10)), lambda x: x <> ''), chr(10)) AS text FROM documents WHERE text IS NOT NULL")
def docx_texts(spark, t):
    """Each document as a DOCX file, read again."""

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(_docx)

    plain = F.regexp_replace("text", _CONTROLS.replace("\\x{FFFE}\\x{FFFF}", "￾￿"), "")
    found = t("documents").where("text is not null").select(F.expr("concat(doc_id, '.docx')").alias("path"), packed(plain).alias("content"))
    return readers.page_texts(found).select("path", "text")


def _zip(text: str) -> bytes:
    inner, out = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.txt", text[:100])
        z.writestr("__MACOSX/deep.txt", "no")
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("folder/", "")
        z.writestr("folder/one.txt", text)
        z.writestr(".hidden.txt", "no")
        z.writestr("tool.exe", "no")
        z.writestr("in.zip", inner.getvalue())
    return out.getvalue()


@query("""
SELECT doc_id AS path, m AS member, CASE m WHEN 'folder/one.txt' THEN text ELSE left(text, 100) END AS text, false AS broken FROM documents, (VALUES ('folder/one.txt'), ('in.zip/deep.txt')) v(m) WHERE text IS NOT NULL AND doc_id % 7 > 0
UNION ALL SELECT doc_id, NULL, NULL, true FROM documents WHERE text IS NOT NULL AND doc_id % 7 = 0
""")
def archive_members(spark, t):
    """Each document in an archive with a nested one and members to leave out; every seventh archive is cut off."""

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(_zip)

    archives = t("documents").where("text is not null").select(F.col("doc_id").alias("path"), packed("text").alias("content"))
    cut = archives.withColumn("content", F.expr("if(path % 7 = 0, substring(content, 1, 30), content)")).withColumn("path", F.col("path").cast("string"))
    found = readers.archive_members(cut)
    return found.select(F.col("path").cast("long").alias("path"), "member", F.col("content").cast("string").alias("text"), F.col("error").isNotNull().alias("broken"))


# ---- ground truth, lookups, small functions


@query("""
SELECT DISTINCT CASE WHEN ends_with(lower(f), '.pdf') THEN f ELSE f || '.pdf' END AS file_name, trim(unnest(string_split(c, ','))) AS category
FROM (SELECT 'doc' || (o_orderkey % 50) || CASE WHEN o_orderkey % 3 = 0 THEN '.PDF' ELSE '' END AS f, o_orderpriority || ', ' || o_orderstatus AS c FROM orders)
""")
def truth_by_position(spark, t):
    """The sheet with a serial number: two rows of headings, then the file in the third column and a list in the sixth."""
    rows = t("orders").selectExpr("o_orderkey + 2 as row", "cast(o_orderkey as string) as a", "'' as b", "concat('doc', o_orderkey % 50, if(o_orderkey % 3 = 0, '.PDF', '')) as c", "'' as d", "'' as e", "concat(o_orderpriority, ', ', o_orderstatus) as f")
    heads = t("orders").where("o_orderkey < 2").selectExpr("o_orderkey as row", "if(o_orderkey = 0, 'Sr. No', '') as a", "'' as b", "'File' as c", "'' as d", "'' as e", "'Category' as f")
    sheet = heads.unionByName(rows)
    return readers.truth_by_position(sheet) if readers.is_positional(sheet) else readers.truth_by_columns(sheet.drop("row"), "c")


@query("SELECT coalesce(a.p_brand, b.brand) AS issue_type, coalesce(b.v, a.v) AS category FROM (SELECT p_brand, min(p_type) AS v FROM part GROUP BY ALL) a FULL JOIN (SELECT 'new ' || p_size AS brand, max(p_type) AS v FROM part GROUP BY ALL UNION ALL SELECT p_brand, max(p_type) FROM part WHERE p_size < 20 GROUP BY ALL) b ON a.p_brand = b.brand")
def overlaid(spark, t):
    """A custom mapping, saved as JSON, over the standard one."""
    folder, part = scratch(spark, "overlay"), t("part")
    custom = part.groupBy(F.expr("concat('new ', p_size)").alias("issue_type")).agg(F.max("p_type").alias("category"))
    custom = custom.unionByName(part.where("p_size < 20").groupBy(F.col("p_brand").alias("issue_type")).agg(F.max("p_type").alias("category")))
    writers.write(custom, folder, "json")
    base = part.groupBy(F.col("p_brand").alias("issue_type")).agg(F.min("p_type").alias("category"))
    return readers.overlay(base, spark.read.json(folder), "issue_type", "category")


@query("SELECT k, string_agg(c, ',' ORDER BY c) AS categories FROM (SELECT DISTINCT l_orderkey AS k, CASE WHEN l_returnflag = 'N' THEN 'OTHERS' ELSE l_returnflag END AS c FROM lineitem) WHERE c <> 'OTHERS' GROUP BY k")
def labelled_files(spark, t):
    """Label lists without the catch-all; files without any label go."""
    lists = t("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_set(F.expr("if(l_returnflag = 'N', 'OTHERS', l_returnflag)"))).alias("c"))
    left = lists.withColumn("c", evaluation.without_others("c")).where(F.size("c") > 0)
    return left.select("k", F.array_join("c", ",").alias("categories"))


@query("SELECT p_brand AS issue_type, CASE WHEN count(*) < 5 THEN 'Critical' WHEN count(*) < 10 THEN 'Warning' ELSE 'Good' END AS level FROM part GROUP BY ALL")
def three_levels(spark, t):
    counts = t("part").groupBy(F.col("p_brand").alias("issue_type")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("issue_type", values.three_levels(F.col("n")).alias("level"))


@query("""
WITH m AS (SELECT p_brand AS issue_type, min(p_type) AS category FROM part GROUP BY ALL), s AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN upper(p_brand) ELSE 'zzzzzzzzz 0' END AS issue_type FROM part)
SELECT p_partkey, s.issue_type, coalesce(m.category, 'Others') AS category, (CASE WHEN m.category IS NULL THEN 0.1 ELSE 1 END)::DOUBLE AS lookup_confidence FROM s LEFT JOIN m ON lower(s.issue_type) = lower(m.issue_type)
""")
def service_lookup(spark, t):
    mapping = t("part").groupBy(F.col("p_brand").alias("issue_type")).agg(F.min("p_type").alias("category"))
    asked = t("part").selectExpr("p_partkey", "case p_partkey % 3 when 0 then p_brand when 1 then upper(p_brand) else 'zzzzzzzzz 0' end as issue_type")
    return labels.look_up_service(asked, mapping)


@query("SELECT lower(p_name) AS issue_norm, count(*) AS rows FROM part GROUP BY ALL HAVING count(*) > 0 AND false")
def no_duplicate_spellings(spark, t):
    """Names that are written in one way only."""
    return labels.duplicate_spellings(t("part").select(F.col("p_brand").alias("issue_type"))).select("issue_norm", "rows")


@query("""
SELECT trim(i) AS issue_norm, string_agg(DISTINCT i, '|' ORDER BY i) AS spellings, count(*) AS rows, count(DISTINCT i) AS n_spellings
FROM (SELECT CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN ' ' || p_name ELSE p_name || ' ' END AS i FROM part) GROUP BY 1 HAVING count(DISTINCT i) > 1
""")
def duplicate_spellings(spark, t):
    named = t("part").select(F.expr("case p_partkey % 3 when 0 then p_name when 1 then concat(' ', p_name) else concat(p_name, ' ') end").alias("issue_type"))
    return labels.duplicate_spellings(named).withColumn("spellings", F.array_join("spellings", "|"))


_HEAD = " OR ".join(f"regexp_matches(coalesce(text, ''), {q('(?i)' + p)})" for p in domains.DOCUMENT_PATTERNS["contract_agreements"][:4])


@query(f"""
WITH p AS (SELECT conv_id AS doc_id, turn AS page, {_HEAD} OR turn % 4 = 3 AS hit FROM conversations)
SELECT doc_id, page FROM (SELECT *, coalesce(lag(hit) OVER (PARTITION BY doc_id ORDER BY page), false) AS before FROM p) WHERE page <= 2 OR hit OR before
""")
def important_pages(spark, t):
    """Pages with a section header, those behind them, and the first two; every fourth page gets a header."""
    pages = t("conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.expr("if(turn % 4 = 3, 'Intro\n  ARTICLE 19 \nText', text)").alias("text"))
    return documents.important_pages(pages, "contract_agreements")


@query("SELECT k, list_sort(list_distinct(a)) <> list_sort(list_distinct(b)) AS changed FROM (SELECT l_orderkey AS k, list(l_returnflag) AS a, list(l_linestatus) AS b FROM lineitem GROUP BY ALL)")
def changed_sets(spark, t):
    lists = t("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list("l_returnflag").alias("a"), F.collect_list("l_linestatus").alias("b"))
    return lists.select("k", labels.changed(F.col("a"), F.col("b")).alias("changed"))


@query("SELECT doc_id, coalesce(array_to_string(list_filter(string_split(text, chr(10)), lambda s: length(s) > 0 AND length(regexp_replace(s, '[^\\p{L}\\p{N}\\s]', '', 'g'))::DOUBLE / length(s) > 0.5), chr(10)), NULL) AS text FROM documents")
def ocr_lines(spark, t):
    return t("documents").select("doc_id", tx.ocr_lines(F.col("text")).alias("text"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview FROM documents")
def previews(spark, t):
    return t("documents").select("doc_id", tx.shorten(F.col("text"), 200, 200).alias("preview"))


@query("SELECT event_id, CASE WHEN event_id % 3 > 0 THEN props END AS props FROM events")
def fenced_answers(spark, t):
    """Answers between fences, parsed; unreadable ones are null."""
    fenced = t("events").select("event_id", F.expr("case event_id % 3 when 0 then 'no json' when 1 then concat('```json\n', props, '\n```') else concat('```', props, '```') end").alias("a"), "props")
    kind = "map<string,string>"
    read = F.from_json(values.strip_fence(F.col("a")), kind)
    same = F.from_json("props", kind)
    return fenced.select("event_id", F.when(F.map_entries(read) == F.map_entries(same), F.col("props")).alias("props"))


_OPTIONS = ("3-MEDIUM", "1-URGENT", "5-LOW", "2-HIGH", "4-NOT SPECIFIED")


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE o_orderpriority END AS category, (CASE o_orderkey % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 0.8 WHEN 2 THEN 0.7 END)::DOUBLE AS confidence FROM orders
""")
def options(spark, t):
    """Answers that name an option: with a confidence, without, in plain words, or not at all."""
    said = t("orders").select("o_orderkey", F.expr("""case o_orderkey % 4 when 0 then concat('{"category": "', o_orderpriority, '", "confidence": 0.9}') when 1 then concat('{"category": "', lower(o_orderpriority), '"}')
        when 2 then concat('I would say ', lower(o_orderpriority), '.') else 'nothing fits' end""").alias("answer"))
    return said.select("o_orderkey", F.inline(F.array(values.option(F.col("answer"), _OPTIONS))))


@query("""
SELECT p_partkey, count(*) AS pairs, min(b) AS body FROM (SELECT p_partkey, p_name || ' is the subject here' AS s, repeat(p_name || ' ', 8) AS b, unnest(range(p_size % 11)) AS i FROM part) WHERE length(s) > 20 AND length(b) > 50 AND i < 8 GROUP BY p_partkey
""")
def salvaged_pairs(spark, t):
    """Subject and body pairs out of answers that break off."""
    one = "concat('{\"subject\": \"', p_name, ' is the subject here\", \"body\": \"', repeat(concat(p_name, ' '), 8), '\"}, ')"
    said = t("part").select("p_partkey", F.expr(f"concat('Sure: [', repeat({one}, p_size % 11), '{{\"subject\": \"cut')").alias("answer"))
    found = once(said, {"x": values.sample_pairs(F.col("answer"))}).select("p_partkey", F.size("x").alias("n"), F.array_min(F.transform("x", lambda x: x["body"])).alias("body"))
    return found.where("n > 0").groupBy("p_partkey").agg(F.sum(F.col("n").cast("long")).alias("pairs"), F.min("body").alias("body"))


@query(f"""SELECT count(*) FILTER (doc_type = e) AS correct, count(*) FILTER (doc_type <> e AND doc_type <> 'unknown') AS incorrect, count(*) FILTER (doc_type = 'unknown') AS unknown, count(*) FILTER (doc_type = e)::DOUBLE / count(*) AS accuracy
FROM (SELECT o_orderpriority AS e, CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' WHEN o_orderkey % 3 = 0 THEN 'x' ELSE o_orderpriority END AS doc_type FROM orders)""")
def type_accuracy(spark, t):
    typed = t("orders").selectExpr("o_orderpriority as expected", "case when o_orderkey % 5 = 0 then 'unknown' when o_orderkey % 3 = 0 then 'x' else o_orderpriority end as doc_type")
    return documents.type_accuracy(typed)


_SHEET = "(SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'PAYMENTS' WHEN 1 THEN 'cos' WHEN 2 THEN ' EoT ' ELSE 'Disputes' END AS category FROM orders)"


@query(f"SELECT k, category AS \"Sub_Category_Original\", category_norm AS \"Sub_Category\" FROM ({named_categories(_SHEET)})")
def normalized_sheet(spark, t):
    """Every column with category in its name, normalised, the given values kept beside it."""
    sheet = t("orders").selectExpr("o_orderkey as k", "case o_orderkey % 4 when 0 then 'PAYMENTS' when 1 then 'cos' when 2 then ' EoT ' else 'Disputes' end as Sub_Category")
    return labels.normalize_columns(sheet, fuzzy=False).select("k", "Sub_Category_Original", "Sub_Category")


@query("""
SELECT o_orderkey, 'Use only these labels:' || chr(10) || '- ' || (SELECT string_agg(p, chr(10) || '- ' ORDER BY p) FROM (SELECT DISTINCT o_orderpriority AS p FROM orders)) || chr(10) || chr(10) || 'Document:' || chr(10) || o_orderstatus AS prompt FROM orders
""")
def prompts(spark, t):
    asked = classify.prompt(t("orders").select("o_orderkey", F.col("o_orderstatus").alias("text")), t("orders").select(F.col("o_orderpriority").alias("category")), "category")
    return asked.select("o_orderkey", "prompt")


def _sent(t):
    """Letters of one reference every few days: the customer is the block, the day the time."""
    return t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project"), F.col("o_orderpriority").alias("letter_id"), F.to_date("o_orderdate").alias("date_sent"), F.lit("s").alias("subject"), F.lit("b").alias("body"), F.col("o_orderdate").cast("timestamp").alias("ts"))


@query("""
WITH g AS (SELECT o_orderkey AS id, o_custkey AS c, o_orderpriority AS k, o_orderdate::TIMESTAMP AS ts, lag(o_orderdate::TIMESTAMP) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS p FROM orders),
r AS (SELECT *, sum(CASE WHEN p IS NULL OR ts > p + INTERVAL 90 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY c, k ORDER BY ts, id) AS run FROM g)
SELECT id AS new_id, first_id AS original_id FROM (SELECT *, first_value(id) OVER (PARTITION BY c, k, run ORDER BY ts, id) AS first_id FROM r) WHERE id <> first_id
""")
def letters_after_first(spark, t):
    """Each letter with the first of its reference, as the stream of letters gives it; a reference begins anew after 90 days."""
    found = duplicates.letters_after_first(_sent(t), ["project"])
    return found.select(F.col("n_id").alias("new_id"), F.col("o_id").alias("original_id"))


#: What some documents begin with, so that they are of a type.
_OPENINGS = {0: "This Agreement is entered into by the parties. The terms and conditions, the scope of work and contract value: rs. 5 follow. Work order # 7a", 1: "Minutes of the meeting. Agenda item 1. Attendees: all present"}
_PAGED = f"""(SELECT conv_id AS doc_id, turn + 1 AS page, CASE WHEN turn = 0 AND conv_id % 4 = 0 THEN {q(_OPENINGS[0])} || chr(10) || text WHEN turn = 0 AND conv_id % 4 = 1 THEN {q(_OPENINGS[1])} || chr(10) || text
  WHEN turn % 5 = 3 THEN 'Intro' || chr(10) || '  ARTICLE 19 ' || chr(10) || text ELSE text END AS text FROM conversations)"""
_CONTRACT = " OR ".join(f"regexp_matches(text, {q('(?i)' + p)})" for p in domains.DOCUMENT_PATTERNS["contract_agreements"][:4])


@query(f"""
WITH p AS (SELECT doc_id, page, coalesce(text, '') AS text FROM {_PAGED}),
t AS ({typed("(SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page) AS text, count(*) AS total_pages FROM p GROUP BY doc_id)", False)}),
h AS (SELECT doc_id, page, text, lag(hit, 1, false) OVER (PARTITION BY doc_id ORDER BY page) AS before, hit FROM (SELECT *, {_CONTRACT} AS hit FROM p)),
c AS (SELECT h.doc_id, h.page, h.text FROM h JOIN t USING (doc_id) WHERE CASE WHEN doc_type = 'contract_agreements' THEN page <= 2 OR hit OR before ELSE page <= 5 END),
r AS (SELECT doc_id, string_agg('Page ' || page || ':' || chr(10) || text, chr(10) || chr(10) ORDER BY page) AS text, count(*) AS used_pages FROM c GROUP BY doc_id)
SELECT doc_id, doc_type, confidence AS type_confidence, total_pages, used_pages, round_even(used_pages::DOUBLE / total_pages, 4) AS compression_ratio, r.text AS text, confidence AS overall_confidence, 'type,pages,text' AS services FROM t JOIN r USING (doc_id)
""")
def processed_pages(spark, t):
    """Conversations as documents of pages, some of which begin like a contract or minutes: type, then pages, then text."""
    said = t("conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page"), "text")
    first, kind = F.col("page") == 1, F.col("doc_id") % 4
    begun = F.when(first & (kind == 0), F.concat(F.lit(_OPENINGS[0] + "\n"), "text")).when(first & (kind == 1), F.concat(F.lit(_OPENINGS[1] + "\n"), "text"))
    pages = said.withColumn("text", begun.when(F.col("page") % 5 == 4, F.concat(F.lit("Intro\n  ARTICLE 19 \n"), "text")).otherwise(F.col("text")))
    made = jobs.process_pages(pages, fields=False, classified=False)
    return made.withColumn("services", F.array_join("services_used", ",")).drop("services_used")


@query()
def processed_letters(spark, t):
    """The same with fields and categories."""
    pages = t("conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page"), "text")
    edges = spark.createDataFrame([(i, c) for i, c in LABELS], "issue_type string, category string")
    return jobs.process_pages(pages, ISSUES, edges)


# ---- synthetic samples

_TEMPLATES = ("The {part} of the works is late: {issue}.", "We refer to {issue} at the {place}.", "{issue}: the {part} at the {place} is not in line with the contract.")
_VALUES = {"part": ("bridge", "flyover", "culvert", "road"), "place": ("north section", "junction", "toll plaza")}
_QUOTAS = """(SELECT issue_type, category, n, whole + CASE WHEN row_number() OVER (PARTITION BY issue_type ORDER BY rest DESC, category) <= lacks - sum(whole) OVER (PARTITION BY issue_type) THEN 1 ELSE 0 END AS quota FROM (
  SELECT *, n * lacks // everything AS whole, n * lacks % everything AS rest FROM (
    SELECT p_brand AS issue_type, p_type AS category, count(*) AS n, sum(count(*)) OVER (PARTITION BY p_brand)::BIGINT AS everything, greatest(100 - sum(count(*)) OVER (PARTITION BY p_brand), 0)::BIGINT AS lacks FROM part GROUP BY p_brand, p_type)))"""


def _lacking(t):
    return samples.quotas(t("part").select(F.col("p_brand").alias("issue_type"), F.col("p_type").alias("category")), 100)


@query(f"SELECT issue_type, category, n, quota::BIGINT AS quota FROM {_QUOTAS}")
def sample_quotas(spark, t):
    return _lacking(t)


def _dealt(options, slot: str) -> str:
    return f"list_transform(list_sort(list_transform([{', '.join(map(q, options))}], lambda v: {{'k': md5(issue_type || '|' || category || '|{slot}|42|' || v), 'v': v}})), lambda x: x.v)[(sample - 1) % {len(options)} + 1]"


_FILLED = _dealt(_TEMPLATES, "template")
for _slot, _options in _VALUES.items():
    _FILLED = f"replace({_FILLED}, '{{{_slot}}}', {_dealt(_options, _slot)})"


@query(f"SELECT issue_type, category, sample, replace({_FILLED}, '{{issue}}', issue_type) AS body FROM (SELECT *, unnest(range(1, quota + 1))::INT AS sample FROM {_QUOTAS})")
def sample_variations(spark, t):
    return samples.variations(_lacking(t), _TEMPLATES, _VALUES)
