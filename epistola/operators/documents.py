"""Per-document operators: quality, repetition, windows, evidence, document types, letters."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epistola.functions import domains
from epistola.functions import text as tx
from epistola.functions.columns import once


def most_frequent(parts: Column) -> Column:
    """struct<value, n> of an array's most frequent element (the smallest of equals), in one pass over it sorted."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(None).cast("string").alias("value"), F.lit(0).alias("n"))

    def step(s: Column, w: Column) -> Column:
        run = F.when(s["last"].eqNullSafe(w), s["run"] + 1).otherwise(1)
        more = run > s["n"]
        return F.struct(w.alias("last"), run.alias("run"), F.when(more, w).otherwise(s["value"]).alias("value"), F.when(more, run).otherwise(s["n"]).alias("n"))

    return F.aggregate(F.sort_array(parts), start, step, lambda s: F.struct(s["value"].alias("value"), s["n"].alias("n")))


def repetition(docs: DataFrame, text: str = "text", n: int = 1) -> DataFrame:
    """Append total, value, n and ratio of the most frequent word (n=1) or word n-gram."""
    step = once(docs, {"__p": tx.words(F.coalesce(F.col(text), F.lit("")))})
    if n > 1:
        step = once(step.withColumnRenamed("__p", "__w"), {"__p": tx.shingles(F.col("__w"), n)})
    step = once(step, {"total": F.size("__p"), "__m": most_frequent(F.col("__p"))})
    share = F.coalesce(F.try_divide("__m.n", F.col("total")), F.lit(0.0))
    return step.select(*docs.columns, "total", F.col("__m.value").alias("value"), F.col("__m.n").alias("n"), share.alias("ratio"))


_WORDS, _FILLERS = re.compile(r"\w+"), frozenset(domains.FILLER_WORDS)
_COUNTS = ("total_words", "unique_words", "meaningful_words", "__word_n", "__n_phrases", "__phrase_n")


@F.pandas_udf(T.StructType([T.StructField(n, T.IntegerType()) for n in _COUNTS]))
def _word_counts(texts: pd.Series) -> pd.DataFrame:
    """Counts of lower-case texts: words, distinct ones, meaningful ones, the most frequent one, three-word phrases, the most frequent one."""
    rows = []
    for text in texts:
        words = _WORDS.findall(text)
        seen, phrases = Counter(words), Counter(zip(words, words[1:], words[2:], strict=False))
        meaningful = sum(n for w, n in seen.items() if len(w) > 2 and w not in _FILLERS)
        rows.append((len(words), len(seen), meaningful, max(seen.values(), default=0), max(len(words) - 2, 0), max(phrases.values(), default=0)))
    return pd.DataFrame(rows, columns=_COUNTS)


def quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """Append the quality columns: counts and ratios, the four failures, score and is_quality.

    The score is the product of 0.1 (short), 0.2 (scanner traces or one line over and over),
    0.3 (not meaningful) and 0.4 (repetition) for the failures that apply.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    stripped = F.regexp_replace(body, r"(?U)^\s+|\s+$", "")
    first = once(
        docs,
        {
            "__c": _word_counts(F.lower(body)),
            "__lines": F.filter(F.transform(F.split(body, "\n"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != ""),
            "text_length": F.length(stripped),
            "artifacts": tx.patterns_found(F.lower(body), domains.SCAN_PATTERNS, "", low=F.lower(body)),
            "__odd": stripped.rlike(r"^[^\p{L}\p{N}_]*$") | stripped.rlike(r"^\d+$") | stripped.rlike(r"^[a-z\s]*$") | stripped.rlike(r"^[A-Z\s]*$"),
        },
    )
    second = once(
        first,
        {
            **{n: F.col("__c")[n] for n in _COUNTS},
            "__line": most_frequent(F.col("__lines")),
            "__n_lines": F.size("__lines"),
        },
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    fourth = second.withColumns(
        {
            "word_diversity": share("unique_words", "total_words"),
            "filler_ratio": F.when(F.col("total_words") == 0, 1.0).otherwise((F.col("total_words") - F.col("meaningful_words")) / F.col("total_words")),
            "repetition_ratio": share("__word_n", "total_words"),
            "phrase_ratio": share("__phrase_n", "__n_phrases"),
            "too_short": F.col("text_length") < domains.MIN_CHARS,
            "has_artifacts": (F.col("artifacts") > 0) | ((F.col("__line.n") > 3) & (F.col("__line.n") / F.col("__n_lines") > 0.6)),
        }
    )
    fifth = fourth.withColumns(
        {
            "not_meaningful": (F.col("total_words") < domains.MIN_WORDS) | (F.col("unique_words") < domains.MIN_UNIQUE) | (F.col("meaningful_words") < 3) | F.col("__odd"),
            "repetitive": (F.col("repetition_ratio") > domains.MAX_REPETITION) | (F.col("phrase_ratio") > 0.5),
        }
    )
    factor = lambda c, f: F.when(F.col(c), f).otherwise(1.0)
    done = fifth.withColumns(
        {
            "quality_score": factor("too_short", 0.1) * factor("has_artifacts", 0.2) * factor("not_meaningful", 0.3) * factor("repetitive", 0.4),
            "is_quality": ~(F.col("too_short") | F.col("has_artifacts") | F.col("not_meaningful") | F.col("repetitive")),
        }
    )
    return done.select(*[c for c in done.columns if not c.startswith("__")])


def quality_reasons(checked: DataFrame, most: int = 2) -> DataFrame:
    """Append skip and the first `most` reasons joined."""
    names = (("too_short", "too short"), ("has_artifacts", "scanner traces"), ("not_meaningful", "not meaningful"), ("repetitive", "repetitive"))
    reasons = F.array_compact(F.array(*[F.when(F.col(c), F.lit(n)) for c, n in names]))
    return checked.withColumns({"skip": ~F.col("is_quality"), "reason": F.array_join(F.slice(reasons, 1, most), ", ")})


def gate(docs: DataFrame, text: str = "text") -> DataFrame:
    """Append status: the check runs on texts under 200 characters or with scanner marks; failing ones are skipped."""
    checked = quality(docs, text)
    asked = (F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) < 200) | F.contains(F.lower(F.col(text)), F.lit("scanned by"))
    return checked.withColumn("status", F.when(asked & ~F.col("is_quality"), "skipped").otherwise("pending")).select(*docs.columns, "status")


def sentence_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, overlap: int = 1) -> DataFrame:
    """key, window_id (from 1), text, start, end: one row per window."""
    parts = once(docs.select(key, F.col(text).alias("__t")), {"__s": tx.sentences(F.col("__t"))})
    each = parts.select(key, F.posexplode(tx.windows(F.col("__s"), size, overlap)).alias("i", "w"))
    return each.select(key, (F.col("i") + 1).alias("window_id"), F.col("w.text").alias("text"), F.col("w.start").alias("start"), F.col("w.end").alias("end"))


def search_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, overlap: int = 1) -> DataFrame:
    """Windows for search: a text of at most 100 characters a sentence of the size is one window, in character positions."""
    docs = once(docs.select(key, text), {"__s": tx.sentences(F.col(text))})
    small = F.length(text) <= size * 100
    whole = F.struct(F.col(text).alias("text"), F.lit(0).alias("start"), F.length(text).alias("end"))
    many = tx.windows(F.col("__s"), size, overlap)
    chosen = F.when(small | (F.size(many) == 0), F.array(whole)).otherwise(many)
    unit = F.when(small | (F.size(many) == 0), "characters").otherwise("sentences")
    each = docs.select(key, unit.alias("position_unit"), F.posexplode(chosen).alias("i", "w"))
    return each.select(key, (F.col("i") + 1).alias("window_id"), "w.*", "position_unit")


def evidence(docs: DataFrame, issues: Sequence[tuple[str, Sequence[str]]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, issue_type, evidence for each issue (name, key words) with a sentence that speaks for it."""
    table = F.array(*[F.struct(F.lit(n).alias("issue_type"), F.array(*[F.lit(w) for w in ws]).alias("words")) for n, ws in issues])
    each = docs.select(key, F.col(text).alias("__t"), F.explode(table).alias("i"))
    said = once(each, {"__e": tx.evidence_sentence(F.col("__t"), F.col("i.words"))})
    return said.where("__e != ''").select(key, "i.issue_type", tx.shorten(F.col("__e"), 200, 197).alias("evidence"))


# ---- document types


def _length_bonus(kind: str, n: Column, pages: Column) -> Column:
    if kind == "contract_agreements":
        return F.when(pages > 200, 3.0).when(pages > 100, 1.0).when(n > 50000, 1.5).when(n > 20000, 0.5).otherwise(-1.0)
    if kind == "correspondence":
        return F.when(n.between(500, 8000), 1.0).when(n > 15000, -0.3).otherwise(0.2)
    if kind == "meeting_minutes":
        return F.when(n.between(2000, 15000), 0.8).when(n < 1000, -0.5).otherwise(0.0)
    if kind == "technical_drawings":
        return F.when(n < 2000, 0.5).otherwise(0.0)
    if kind == "progress_reports":
        return F.when(n.between(3000, 12000), 0.6).otherwise(0.0)
    return F.lit(0.0)


def document_type(docs: DataFrame, text: str = "text", pages: Column | None = None, file_name: Column | None = None, threshold: float = 0.6) -> DataFrame:
    """Append doc_type, confidence and the nine scores.

    A score is keywords + 3 patterns + 2 file-name words + a bonus for the length; equal
    scores go to the higher priority; without any score the type is others at 0.4; below the
    threshold it is unknown.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    pages = F.lit(0) if pages is None else pages
    stem = F.lower(F.lit("") if file_name is None else F.regexp_replace(file_name, r"\.[^.]*$", ""))
    base = once(docs, {"__low": F.lower(body), "__n": F.length(body), "__pages": pages, "__stem": stem})
    score = {}
    for kind, (_, keywords, names) in domains.DOCUMENT_TYPES.items():
        total = tx.hits(F.col("__low"), keywords) + 3 * tx.patterns_found(body, domains.DOCUMENT_PATTERNS[kind], low=F.col("__low"))
        if file_name is not None:
            total = total + 2 * tx.hits(F.col("__stem"), names)
        score[kind] = total + _length_bonus(kind, F.col("__n"), F.col("__pages"))
    scored = once(base, {f"score_{k}": F.bround(c.cast("double"), 4) for k, c in score.items()})
    ranked = F.array(*[F.struct(F.col(f"score_{k}").alias("score"), F.lit(p).alias("priority"), F.lit(k).alias("kind")) for k, (p, *_) in domains.DOCUMENT_TYPES.items()])
    order = scored.withColumn("__r", F.reverse(F.sort_array(ranked)))
    top, second = F.col("__r")[0]["score"], F.col("__r")[1]["score"]
    gap = F.when(top > second, F.least(F.lit(0.2), (top - second) * 0.05)).otherwise(0.0)
    confidence = F.when(top <= 0, 0.4).otherwise(F.least(F.lit(0.95), F.least(F.lit(0.9), 0.4 + top * 0.1) + gap))
    done = order.withColumn("confidence", F.bround(confidence, 6))
    kind = F.when(F.col("confidence") < threshold, "unknown").when(top <= 0, "others").otherwise(F.col("__r")[0]["kind"])
    return done.withColumn("doc_type", kind).select(*docs.columns, "doc_type", "confidence", *[f"score_{k}" for k in score])


def type_accuracy(typed: DataFrame, expected: str = "expected") -> DataFrame:
    """One row: correct, incorrect, unknown, accuracy of doc_type against an expected column."""
    right = F.count_if(F.col("doc_type") == F.col(expected))
    unknown = F.count_if(F.col("doc_type") == "unknown")
    n = F.count(F.lit(1))
    return typed.agg(right.alias("correct"), (n - right - unknown).alias("incorrect"), unknown.alias("unknown"), F.coalesce(F.try_divide(right, n), F.lit(0.0)).alias("accuracy"))


def important_pages(pages: DataFrame, kind: str, key: str = "doc_id", page: str = "page", text: str = "text", first: int = 5) -> DataFrame:
    """key, page of the pages worth reading: for contracts the first two, pages with a section header and the one after each; else the first five."""
    if kind != "contract_agreements":
        return pages.where(F.col(page) <= first).select(key, page)
    patterns = domains.DOCUMENT_PATTERNS["contract_agreements"][:4]
    hit = tx.patterns_found(F.col(text), patterns) > 0
    before = F.lag(F.coalesce(hit, F.lit(False)), 1, False).over(Window.partitionBy(key).orderBy(page))
    return pages.withColumns({"__hit": F.coalesce(hit, F.lit(False)), "__before": before}).where((F.col(page) <= 2) | F.col("__hit") | F.col("__before")).select(key, page)


def chosen_pages(pages: DataFrame, kind: str = "doc_type", key: str = "doc_id", page: str = "page", text: str = "text", first: int = 5) -> DataFrame:
    """The pages worth reading by each document's own type in column `kind`, whole rows: pages are numbered from 1.

    Contracts: the first two, pages with a section header and the one behind each; any other type: the first five.
    """
    hit = F.coalesce(tx.patterns_found(F.col(text), domains.DOCUMENT_PATTERNS["contract_agreements"][:4]) > 0, F.lit(False))
    before = F.lag(hit, 1, False).over(Window.partitionBy(key).orderBy(page))
    contract = F.col(kind) == "contract_agreements"
    wanted = F.when(contract, (F.col(page) <= 2) | hit | before).otherwise(F.col(page) <= first)
    return pages.withColumn("__wanted", wanted).where("__wanted").drop("__wanted")


# ---- letters


def trim_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", over: int = 3, keep: int = 2, longer: int = 10) -> DataFrame:
    """key, text where of a line (stripped, over `longer` characters) found more than `over` times in a document the first `keep` stay."""
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("i", "line"))
    lines = lines.withColumn("bare", F.regexp_replace("line", r"(?U)^\s+|\s+$", ""))
    same = Window.partitionBy(key, "bare")
    seen = lines.withColumns({"n": F.count(F.lit(1)).over(same), "at": F.row_number().over(same.orderBy("i"))})
    kept = seen.where((F.length("bare") <= longer) | (F.col("n") <= over) | (F.col("at") <= keep))
    ordered = kept.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "line"))).alias("l"))
    return ordered.select(key, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def reduce(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text without boilerplate, excess white space and repeated lines, and with short formulas."""
    plain = docs.select(key, tx.reduce_boilerplate(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    return trim_repeated_lines(plain, key).withColumn("text", tx.shorten_phrases(F.col("text")))


def _letter_lines(c: Column) -> Column:
    bare = F.transform(F.split(c, "\n"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    noise = "|".join(f"(?:{p})" for p in domains.LETTER_NOISE)
    kept = F.filter(bare, lambda s: (s != "") & ~s.rlike(noise) & ((F.length(s) >= 5) | F.startswith(s, F.lit("Page"))))
    stripped = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.when((F.size(kept) <= 3) & (F.length(stripped) > 200), stripped).otherwise(F.array_join(kept, "\n"))


def _first_match(c: Column, patterns: Sequence[str], group: int, flags: str) -> Column:
    """Group of the first pattern that occurs, null without."""
    out = F.lit(None).cast("string")
    for p in reversed(patterns):
        out = F.when(c.rlike(flags + p), F.regexp_extract(c, flags + p, group)).otherwise(out)
    return out


def _from_match(c: Column, patterns: Sequence[str], flags: str, after: bool = False) -> Column:
    """Text from (or after) the first place of the first pattern that occurs, null without."""
    out = F.lit(None).cast("string")
    for p in reversed(patterns):
        at = F.regexp_instr(c, F.lit(flags + p))
        skip = F.length(F.regexp_substr(c, F.lit(flags + p))) if after else F.lit(0)
        out = F.when(c.rlike(flags + p), F.substring(c, at + skip, F.length(c))).otherwise(out)
    return out


def letters(docs: DataFrame, text: str = "text") -> DataFrame:
    """Append subject, body, full_text, extraction_method.

    Under 50 characters there is no subject and the whole text is the body. The subject is
    the first pattern's that occurs, without its tails and cut at 200 characters, else the
    first of ten lines with a subject word. The body runs from the subject past the salutation
    (or from a usual opening) to a closing; a body under 50 characters gives way to the text.
    """
    trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    body = F.coalesce(F.col(text), F.lit(""))
    step = once(docs, {"__raw": body, "__clean": _letter_lines(body)})
    found = _first_match(F.col("__clean"), domains.SUBJECT_PATTERNS, 1, "(?ims)")
    subject = tx.squeeze(found)
    for p in domains.SUBJECT_TAILS:
        subject = F.regexp_replace(subject, f"(?i){p}", "")
    lines = F.slice(F.transform(F.split("__clean", "\n"), trim), 1, 10)
    fallback = F.filter(lines, lambda s: F.length(s).between(11, 199) & (tx.hits(F.lower(s), domains.SUBJECT_WORDS) > 0))
    subject = F.coalesce(trim(tx.shorten(subject, 200, 200)), F.try_element_at(fallback, F.lit(1)), F.lit(""))
    step = once(step, {"__subject": subject, "__onward": F.coalesce(_from_match(F.col("__clean"), domains.SUBJECT_PATTERNS[:4], "(?ims)"), F.col("__clean"))})
    start = F.coalesce(
        _from_match(F.col("__onward"), domains.BODY_STARTS, "(?ims)", after=True), _from_match(F.col("__onward"), domains.CONTENT_STARTS, "(?ims)"), F.col("__onward")
    )
    step = once(step, {"__start": trim(start)})
    end = F.lit(None).cast("int")
    for p in reversed(domains.BODY_ENDS):
        end = F.when(F.col("__start").rlike(f"(?im){p}"), F.regexp_instr("__start", F.lit(f"(?im){p}")) - 1).otherwise(end)
    step = once(step, {"__end": end})
    step = once(step, {"__body": trim(F.when(F.col("__end").isNotNull(), F.left("__start", F.col("__end"))).otherwise(F.col("__start")))})
    short, weak = F.length(trim(F.col("__raw"))) < 50, F.length("__body") < 50
    return step.select(
        *docs.columns,
        F.when(short, "").otherwise(F.col("__subject")).alias("subject"),
        F.when(short, trim(F.col("__raw"))).when(weak, F.col("__clean")).otherwise(F.col("__body")).alias("body"),
        F.when(short, F.col("__raw")).otherwise(F.col("__clean")).alias("full_text"),
        F.when(short, "insufficient_content").when(weak, "full_text_fallback").otherwise("structured_extraction").alias("extraction_method"),
    )


def focused() -> Column:
    """Subject and body of letters() as one text; either alone; else the whole."""
    s, b = F.col("subject"), F.col("body")
    return F.when((s != "") & (b != ""), tx.assemble(s, b)).when(s != "", F.concat(F.lit("Subject: "), s)).when(b != "", b).otherwise(F.col("full_text"))
