"""Text expressions: cleaning, sentences, windows, key sentences, evidence. All stay in the JVM."""

from __future__ import annotations

import re
import re._constants as _constants
import re._parser as _parser
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from epistola.functions import domains

#: Stands between sentences until they are split; never part of cleaned text.
MARK = "\x1e"
WORD = r"[\p{L}\p{N}_]+"


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_text(c: Column) -> Column:
    """Squeeze white space, blank out signs, collapse repeated punctuation, close up the space before it."""
    c = F.regexp_replace(squeeze(c), r"""(?U)[^\p{L}\p{N}_\s.,;:!?\-'"]""", " ")
    c = F.regexp_replace(c, r"([.,:;!?])\1+", "$1")
    return F.trim(F.regexp_replace(c, r"\s+([.,:;!?])", "$1"))


def fix_ocr(c: Column) -> Column:
    """Misread l and O, runs of dots, white space, words run together; in this order."""
    c = F.regexp_replace(c, r"(?U)\bl\b", "I")
    c = F.regexp_replace(c, r"(?U)\bO\b", "0")
    c = F.regexp_replace(c, r"\.{2,}", "...")
    c = F.regexp_replace(c, r"(?U)\s+", " ")
    return F.regexp_replace(c, r"([a-z])([A-Z])", "$1 $2")


def normalize_document(c: Column) -> Column:
    """Clean, repair, drop leading section numbers, write dates with slashes, drop currency signs."""
    c = F.regexp_replace(fix_ocr(clean_text(c)), r"(?m)^(\d+\.)+\s*", "")
    c = F.regexp_replace(c, r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})\b", "$1/$2/$3")
    return F.regexp_replace(c, "[$£€¥]\\s*", "")


def sentences(c: Column) -> Column:
    """Cleaned text cut after . ! ? and white space (a stated stand-in for a trained splitter)."""
    marked = F.regexp_replace(clean_text(c), r"([.!?])\s+", f"$1{MARK}")
    return F.filter(F.transform(F.split(marked, MARK), lambda s: F.trim(s)), lambda s: s != "")


def windows(parts: Column, size: int = 3, overlap: int = 1) -> Column:
    """array<struct<text, start, end>> of sliding runs of sentences, to the first that reaches the end."""
    stride = max(1, size - overlap)
    n = F.size(parts)
    count = F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / F.lit(stride)).cast("int") + 1)
    starts = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: i * stride)).otherwise(F.array().cast("array<int>"))

    def window(start: Column) -> Column:
        end = F.least(start + size, n)
        return F.struct(F.array_join(F.slice(parts, start + 1, end - start), " ").alias("text"), start.alias("start"), (end - 1).alias("end"))

    return F.transform(starts, window)


def chunks(parts: Column, limit: int = 3000) -> Column:
    """Sentences packed greedily into texts of at most `limit` characters (a longer sentence stands alone).

    The size kept is that of the sentences plus one per sentence added to a chunk already begun.
    """
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("text"), F.lit(0).alias("size"), F.lit(False).alias("begun"))

    def step(state: Column, sentence: Column) -> Column:
        full = state["begun"] & (state["size"] + F.length(sentence) > limit)
        return F.struct(
            F.when(full, F.concat(state["done"], F.array(state["text"]))).otherwise(state["done"]).alias("done"),
            F.when(full | ~state["begun"], sentence).otherwise(F.concat(state["text"], F.lit(" "), sentence)).alias("text"),
            F.when(full, F.length(sentence)).otherwise(state["size"] + F.length(sentence) + 1).alias("size"),
            F.lit(True).alias("begun"),
        )

    return F.aggregate(parts, empty, step, lambda s: F.when(s["begun"], F.concat(s["done"], F.array(s["text"]))).otherwise(s["done"]))


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), F.lit(1))


def shingles(parts: Column, n: int = 3) -> Column:
    last = F.size(parts) - n
    runs = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(parts, i + 1, n), " "))
    return F.when(last >= 0, runs).otherwise(F.array().cast("array<string>"))


def hits(c: Column, phrases: Sequence[str]) -> Column:
    """How many of the phrases occur in c."""
    total = F.lit(0)
    for p in phrases:
        total = total + F.contains(c, F.lit(p)).cast("int")
    return total


def required_literal(pattern: str) -> str:
    """The longest run of plain characters that every match of a pattern holds, in lower case; '' if there is none of three or more."""
    best, run = "", ""
    try:
        parts = _parser.parse(pattern)
    except re.error:  # a pattern that only Java knows
        return ""
    for op, value in parts:
        plain = op is _constants.LITERAL and value < 128
        run = run + chr(value).lower() if plain else ""
        best = max(best, run, key=len)
    return best if len(best) > 2 else ""


def patterns_found(c: Column, patterns: Sequence[str], flags: str = "(?i)", low: Column | None = None) -> Column:
    """How many of the patterns occur in c. With low, c in lower case, a pattern is tried only where the characters that it needs stand."""
    total = F.lit(0)
    for p in patterns:
        found, needed = F.rlike(c, F.lit(flags + p)), required_literal(p) if low is not None else ""
        total = total + (F.when(F.contains(low, F.lit(needed)), found).otherwise(F.lit(False)) if needed else found).cast("int")
    return total


def key_score(sentence: Column, words_: Sequence[str] = domains.KEY_WORDS) -> Column:
    """Key words in the sentence, half as much again for more than one, and 0.5 for a digit."""
    n = hits(F.lower(sentence), words_).cast("double")
    return F.when(n > 1, n * 1.5).otherwise(n) + F.when(sentence.rlike(r"\p{Nd}"), 0.5).otherwise(0.0)


def key_sentences(parts: Column, top: int = 10, words_: Sequence[str] = domains.KEY_WORDS) -> Column:
    """Sentences of positive score by score, then place, at most `top`; without any, the first three."""
    scored = F.transform(parts, lambda s, i: F.struct((-key_score(s, words_)).alias("score"), i.alias("i"), s.alias("s")))
    best = F.transform(F.slice(F.array_sort(F.filter(scored, lambda x: x["score"] < 0)), 1, top), lambda x: x["s"])
    return F.when(F.size(best) > 0, best).otherwise(F.slice(parts, 1, 3))


def evidence_words(issue: str) -> list[str]:
    """The words that speak for an issue: those of the groups it falls in, else its own longer words."""
    name = issue.lower()
    out = [w for group, ws in domains.EVIDENCE_GROUPS if any(part in name for part in group.split()) for w in ws]
    return out or [w.lower() for w in issue.split() if len(w) > 2]


def evidence(c: Column, keywords: Column) -> Column:
    return shorten(evidence_sentence(c, keywords), 200, 197)


def evidence_sentence(c: Column, keywords: Column) -> Column:
    """The first sentence (cut at full stops) with two key words, else one over 20 characters with one of the first three; '' without.

    A fold that judges each sentence once, as it stands; only one that may serve is stripped, and behind the first with two key words no other is judged.
    """
    bare = lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")
    found = lambda low, ks: F.size(F.filter(ks, lambda k: F.contains(low, k)))
    first = F.slice(keywords, 1, 3)
    state = lambda strong, weak: F.struct(strong.alias("strong"), weak.alias("weak"))
    none = F.lit(None).cast("string")

    def step(best: Column, p: Column) -> Column:
        s, low = p["s"], p["low"]
        strong = (found(low, keywords) >= 2) & (found(F.lower(bare(s)), keywords) >= 2) & (bare(s) != "")
        weak = best["weak"].isNull() & (F.length(s) > 20) & (found(low, first) >= 1) & (F.length(bare(s)) > 20) & (found(F.lower(bare(s)), first) >= 1)
        return F.when(best["strong"].isNotNull(), best).when(strong, state(bare(s), best["weak"])).when(weak, state(none, bare(s))).otherwise(best)

    parts = F.transform(F.split(c, r"\."), lambda s: F.struct(s.alias("s"), F.lower(s).alias("low")))
    return F.coalesce(F.aggregate(parts, state(none, none), step, lambda best: F.coalesce(best["strong"], best["weak"])), F.lit(""))


def shorten(c: Column, limit: int, keep: int) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(keep)), F.lit("..."))).otherwise(c)


def generic_count(c: Column) -> Column:
    return hits(F.lower(c), domains.GENERIC_PHRASES)


def key_words(c: Column, least: int = 4) -> Column:
    """Distinct words of `least` or more characters that are no stop words, then stripped of signs."""
    kept = F.filter(F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+", " ")), " "), lambda w: (F.length(w) >= least) & ~w.isin(*domains.KEYWORD_STOPS))
    return F.array_distinct(F.transform(kept, lambda w: F.regexp_replace(w, r"""^[.,!?;:"()\[\]{}]+|[.,!?;:"()\[\]{}]+$""", "")))


def tokens(c: Column, stop_words: Sequence[str] = (), keep: Sequence[str] = domains.CONTRACT_TERMS) -> Column:
    """Lower-case words and . , ; : ; a stop word of one or two letters goes unless it is kept (longer ones stay)."""
    stops = [w for w in stop_words if w not in keep and len(w) <= 2]
    parts = F.regexp_extract_all(F.lower(c), F.lit(f"({WORD}|[.,;:])"), F.lit(1))
    return F.filter(parts, lambda w: ~w.isin(*stops)) if stops else parts


def content_hash(content: Column) -> Column:
    return F.substring(F.md5(content), 1, 16)


def comma_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda s: F.trim(s)), lambda s: s != "")


def length_bucket(c: Column) -> Column:
    n = F.length(c)
    return F.when(n < 1000, "short").when(n < 3000, "medium").when(n < 8000, "long").otherwise("very_long")


def is_scanned(c: Column, threshold: int = 100) -> Column:
    return (F.length(c) < threshold) | (F.length(F.regexp_replace(c, r"[ \n\t]", "")) < 50)


def ocr_lines(c: Column) -> Column:
    """Lines whose letters, digits and spaces are over half of them."""
    share = lambda s: F.length(F.regexp_replace(s, r"[^\p{L}\p{N}\s]", "")) / F.length(s)
    return F.array_join(F.filter(F.split(c, "\n"), lambda s: (F.length(s) > 0) & (share(s) > 0.5)), "\n")


def reduce_boilerplate(c: Column) -> Column:
    """White space rules and boilerplate sentences; repeated lines are operators.letters.trim_repeated_lines."""
    c = F.regexp_replace(c, r"\n\s*\n\s*\n+", "\n\n")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r"\n[ \t]+", "\n")
    for p in domains.BOILERPLATE:
        c = F.regexp_replace(c, f"(?i){p}", "")
    return c


def shorten_phrases(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?i)WHEREAS,?\s+", "WHEREAS ")
    c = F.regexp_replace(c, r"(?i)NOW,?\s+THEREFORE,?\s+", "NOW THEREFORE ")
    c = F.regexp_replace(c, r"(?i)IN\s+WITNESS\s+WHEREOF[^.]*\.?", "IN WITNESS WHEREOF...")
    return F.regexp_replace(F.regexp_replace(c, r"\n\s*\n\s*\n+", "\n\n"), r"^\s+|\s+$", "")


def assemble(subject: Column, body: Column, form: str = "file") -> Column:
    """Subject and body as one text: for the index, a file or a request."""
    if form == "index":
        return F.concat(subject, F.lit(" "), body)
    return F.concat(F.lit("Subject: "), subject, F.lit("\n\nContent: " if form == "file" else "\n\nBody: "), body)


def report_evidence(c: Column) -> Column:
    """Over 150 characters: the first sentence and '...'."""
    return F.when(F.length(c) > 150, F.concat(F.substring_index(c, ". ", 1), F.lit("..."))).otherwise(c)


def missing_priority(issue: Column, high: Sequence[str], medium: Sequence[str]) -> Column:
    name = F.lower(issue)
    return F.when(hits(name, high) > 0, "high").when(hits(name, medium) > 0, "medium").otherwise("low")
