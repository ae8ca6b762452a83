"""Sources: label sheets, ground truth, files, archives, text of documents by pluggable extractors."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epistola.functions.text import comma_list

TRAINING = "issue_type string, category string, subject string, body string, reference_sentence string, source_file string"
MAPPING = "issue_type string, category string"
#: Largest file taken, and the file types (fixed values).
MAX_BYTES = 200 << 20
SUFFIXES = ("pdf", "docx", "zip", "txt", "text", "png", "jpg", "jpeg", "tif", "tiff")


def training(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """The training sheet, once for all its users."""
    if form == "csv":
        return spark.read.schema(TRAINING).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return spark.read.schema(TRAINING).parquet(path)


def resolve_columns(names: Sequence[str], wanted: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """Which of the names means each wanted column: lower case, without blanks and underscores, one of its spellings."""
    bare = {n.lower().replace("_", "").replace(" ", ""): n for n in reversed(names)}
    return {w: bare[s] for w, spellings in wanted.items() for s in reversed(spellings) if s in bare}


def mapping(spark: SparkSession, path: str, sep: str = "|", encoding: str = "UTF-8", defaults: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """issue_type, category from a delimited file with some spelling of those headers; the defaults if it lacks one."""
    raw = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).csv(path)
    found = resolve_columns(raw.columns, {"issue_type": ("issuetype", "issuetypes"), "category": ("mappedcategory", "category", "categories")})
    if len(found) < 2:
        return spark.createDataFrame(list(defaults), MAPPING)
    return raw.select(F.trim(f"`{found['issue_type']}`").alias("issue_type"), F.trim(f"`{found['category']}`").alias("category")).dropna()


def category_domain(mapped: DataFrame) -> DataFrame:
    """The categories of all lists of a mapping."""
    return mapped.select(F.explode(comma_list(F.col("category"))).alias("category")).distinct()


def overlay(base: DataFrame, custom: DataFrame, key: str, value: str) -> DataFrame:
    """base with custom's values over it, whole rows for new keys."""
    own = custom.select(F.col(key), F.col(value).alias("__own"))
    return base.join(own, key, "full").select(key, F.coalesce("__own", value).alias(value))


def truth_by_position(sheet: DataFrame, header_rows: int = 2, file_column: int = 2, category_column: int = 5, row: str = "row") -> DataFrame:
    """file_name, category of the sheet with a serial number: `header_rows` rows skipped by `row` (from 0), file in one column, comma list in another."""
    columns = [c for c in sheet.columns if c != row]
    name = F.trim(F.col(columns[file_column]))
    name = F.when(F.lower(name).endswith(".pdf"), name).otherwise(F.concat(name, F.lit(".pdf")))
    each = sheet.where(F.col(row) >= header_rows).where(F.coalesce(name, F.lit("")) != "").select(name.alias("file_name"), F.explode(comma_list(F.col(columns[category_column]))).alias("category"))
    return each.distinct()


def truth_by_columns(sheet: DataFrame, file_column: str) -> DataFrame:
    """file_name, category of the sheet whose other columns each hold a category or nothing: an unpivot; values are not split."""
    others = [c for c in sheet.columns if c != file_column]
    texts = sheet.select(file_column, *[F.col(c).cast("string").alias(c) for c in others])
    long = texts.unpivot([file_column], others, "__column", "category")
    return long.select(F.col(file_column).cast("string").alias("file_name"), F.trim("category").alias("category")).where("category != ''").distinct()


def is_positional(sheet: DataFrame, row: str = "row") -> bool:
    """Whether data row 1 begins with 'Sr. No' (one row is read)."""
    first = next(c for c in sheet.columns if c != row)
    head = sheet.where(F.col(row) == 0).select(first).head()
    return head is not None and str(head[0]).strip().lower().startswith("sr. no")


def header_row(rows: Sequence[Sequence[str]], wanted: Mapping[str, Sequence[str]], tries: Sequence[int] = (3, 1)) -> int | None:
    """The first of the tried rows (from 0) that has every wanted column; rows are the sheet's first few."""
    return next((t for t in tries if t < len(rows) and len(resolve_columns([str(c) for c in rows[t]], wanted)) == len(wanted)), None)


def preferred(paths: Sequence[str], words: Sequence[str] = ("edms", "lot", "ground", "truth", "label")) -> str | None:
    """The path whose name has one of the words, else the first by name."""
    return min(paths, key=lambda p: (not any(w in p.lower() for w in words), p), default=None)


def files(spark: SparkSession, folder: str, patterns: Sequence[str] = ("*.pdf",), most: int | None = None) -> DataFrame:
    """path, file_name, length, modificationTime, content, reason (why not taken, or null); `most` keeps the first by path."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    regex = "|".join("^" + p.replace(".", r"\.").replace("*", ".*").replace("?", ".") + "$" for p in patterns)
    named = raw.withColumn("file_name", F.element_at(F.split("path", "/"), -1)).where(F.rlike("file_name", F.lit(f"(?i){regex}")))
    suffix = F.lower(F.regexp_extract("file_name", r"\.([^.]+)$", 1))
    out = named.withColumn("reason", F.when(F.col("length") > MAX_BYTES, "too large").when(~suffix.isin(*SUFFIXES), "type"))
    return out.orderBy("path").limit(most) if most else out


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """file_name, text of the .txt and .text files under a folder."""
    return spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{txt,text}").select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))


def is_zip(content: Column) -> Column:
    return F.substring(F.hex(F.substring(content, 1, 4)), 1, 8).isin("504B0304", "504B0506", "504B0708")


def archive_members(found: DataFrame, suffixes: Sequence[str] = SUFFIXES, depth: int = 3) -> DataFrame:
    """path, member, content, error: one row per usable member, nested archives opened down to `depth`.

    Folders, hidden and system members are left out; a broken archive gives one row with its error.
    """

    def opened(content: bytes, prefix: str, level: int) -> Iterator[tuple[str, bytes]]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for item in z.infolist():
                base = item.filename.rsplit("/", 1)[-1]
                if item.is_dir() or base.startswith(".") or "__MACOSX" in item.filename or base.rsplit(".", 1)[-1].lower() not in suffixes:
                    continue
                data = z.read(item)
                if base.lower().endswith(".zip") and level > 1:
                    yield from opened(data, f"{prefix}{item.filename}/", level - 1)
                else:
                    yield prefix + item.filename, data

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows += [(path, name, data, None) for name, data in opened(bytes(content), "", depth)]
                except (zipfile.BadZipFile, RuntimeError, OSError) as e:
                    rows.append((path, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "member", "content", "error"])

    return found.where(is_zip(F.col("content"))).select("path", "content").mapInPandas(run, "path string, member string, content binary, error string")


def docx_text(content: bytes) -> list[str]:
    """Paragraphs of a DOCX, those in table cells included, in one 'page'."""
    import xml.etree.ElementTree as ET

    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    return ["\n".join(t for p in root.iter(f"{space}p") if (t := "".join(x.text or "" for x in p.iter(f"{space}t"))))]


#: Takes the bytes of a file and gives the text of each page. PDF and OCR readers of a user's choice plug in here.
Extractor = Callable[[bytes], list[str]]
PLAIN: dict[str, Extractor] = {"txt": lambda b: [b.decode("utf-8", "replace")], "text": lambda b: [b.decode("utf-8", "replace")], "docx": docx_text}


def page_texts(found: DataFrame, extractors: Mapping[str, Sequence[tuple[str, Extractor]]] | None = None) -> DataFrame:
    """path, page (from 1), method, text, error: every extractor's text of every page.

    extractors maps a suffix to (method, function) pairs; a failing one gives a row with its error.
    """
    table = {s: [("text", f)] for s, f in PLAIN.items()} | dict(extractors or {})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                for method, read in table.get(path.rsplit(".", 1)[-1].lower(), ()):
                    try:
                        rows += [(path, i, method, t, None) for i, t in enumerate(read(bytes(content)), 1)]
                    except Exception as e:  # a reader's failure is data
                        rows.append((path, None, method, "", f"error: {e}"))
            yield pd.DataFrame(rows, columns=["path", "page", "method", "text", "error"]).astype({"page": "Int64"})

    return found.select("path", "content").mapInPandas(run, "path string, page long, method string, text string, error string")


def hybrid_text(pages: DataFrame, most_pages: int | None = None) -> DataFrame:
    """path, text, method: per page the text layer if over 50 characters, else OCR if over 20; pages numbered and joined by blank lines."""
    rows = pages.where("page is not null")
    rows = rows.where(F.col("page") <= most_pages) if most_pages else rows
    each = rows.groupBy("path", "page").agg(F.max(F.when(F.col("method") == "text", F.col("text"))).alias("t"), F.max(F.when(F.col("method") == "ocr", F.col("text"))).alias("o"))
    layer = F.length(F.trim(F.coalesce("t", F.lit("")))) > 50
    ocr = ~layer & (F.length(F.trim(F.coalesce("o", F.lit("")))) > 20)
    each = each.withColumns({"use": F.when(layer, F.col("t")).when(ocr, F.col("o")).otherwise(F.coalesce("t", F.lit(""))), "by_ocr": ocr})
    body = F.concat(F.lit("Page "), F.col("page"), F.lit(":\n"), F.col("use"))
    out = each.groupBy("path").agg(
        F.sort_array(F.collect_list(F.when(F.trim("use") != "", F.struct("page", body.alias("b"))))).alias("l"), F.count(F.lit(1)).alias("n"), F.count_if("by_ocr").alias("k")
    )
    method = F.when(F.col("k") == 0, "text_only").when(F.col("k") == F.col("n"), "ocr_only").otherwise(F.concat(F.lit("hybrid_text+ocr("), F.col("k"), F.lit("pages)")))
    return out.select("path", F.array_join(F.transform("l", lambda x: x["b"]), "\n\n").alias("text"), method.alias("method"))


#: Readers in order of preference and how far each is trusted (fixed values).
OCR_ORDER = (("docai", 0.9), ("pypdf", 0.7), ("tesseract", 0.6))


def first_usable(texts: DataFrame, order: Sequence[tuple[str, float]] = OCR_ORDER, least: int = 50) -> DataFrame:
    """path, text, method, confidence, error from columns named like the methods: the first text of at least 50 characters."""
    out = F.lit(None).cast("struct<text:string,method:string,confidence:double>")
    for method, sure in reversed(order):
        if method in texts.columns:
            out = F.when(F.length(F.trim(method)) >= least, F.struct(F.col(method).alias("text"), F.lit(method).alias("method"), F.lit(sure).alias("confidence"))).otherwise(out)
    return texts.withColumn("__o", out).select("path", "__o.*", F.when(F.col("__o").isNull(), "no readable text").alias("error"))


def select_pages(pages: DataFrame, wanted: Sequence[int]) -> DataFrame:
    return pages.where(F.col("page").isin(*wanted))


def stale(index_time: float, training_time: float) -> bool:
    """Whether the index is missing (0) or older than the training data."""
    return index_time == 0 or training_time > index_time
