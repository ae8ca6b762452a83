"""Numbers, dates, JSON answers and label arithmetic."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epistola.functions import domains


def level(count: Column) -> Column:
    """Sufficiency level of a sample count."""
    out = F.lit(domains.SUFFICIENCY[0][0])
    for name, least, _ in domains.SUFFICIENCY[1:]:
        out = F.when(count >= least, name).otherwise(out)
    return out


def level_multiplier(count: Column) -> Column:
    out = F.lit(domains.SUFFICIENCY[0][2])
    for _, least, factor in domains.SUFFICIENCY[1:]:
        out = F.when(count >= least, factor).otherwise(out)
    return out


def three_levels(count: Column) -> Column:
    return F.when(count < 5, "Critical").when(count < 10, "Warning").otherwise("Good")


def mapping_confidence(issue_n: Column, category_n: Column, unified: bool = False) -> Column:
    """Confidence that an issue's category is meant, from how often the issue occurs."""
    if unified:
        return F.least(F.lit(1.0), 0.9 + F.least(F.lit(0.1), F.coalesce(issue_n, F.lit(1)) / 100))
    seen = (F.coalesce(issue_n, F.lit(0)) > 0) & (F.coalesce(category_n, F.lit(0)) > 0)
    return F.when(seen, F.least(F.lit(1.0), 0.7 + F.least(F.lit(0.3), issue_n / 100))).otherwise(0.0)


def boosted(confidence: Column, count: Column) -> Column:
    return F.when(count > 3, F.least(F.lit(1.0), confidence * 1.2)).otherwise(confidence)


def decayed(confidence: Column, rank: Column, decay: float = 0.03) -> Column:
    """By the place before filtering, from 0; from place 34 on it is not positive."""
    return confidence * (1.0 - rank * decay)


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def parse_date(c: Column) -> Column:
    """yyyy-MM-dd, dd/MM/yyyy or dd-MM-yyyy, the first that parses."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("date") for f in ("yyyy-M-d", "d/M/yyyy", "d-M-yyyy")])


def planned_end(start: Column, duration: Column) -> Column:
    """start plus the first number of the duration, in months, years or days (tested in that order).

    A day that the target month lacks gives null instead of its last day; a duration without
    number or unit, or a start that does not parse, gives null.
    """
    text = F.lower(duration)
    n = F.regexp_extract(text, r"(\d+)", 1).try_cast("int")
    date = parse_date(start)
    months = F.when(F.contains(text, F.lit("month")), n).when(F.contains(text, F.lit("year")), n * 12)
    first = F.add_months(F.trunc(date, "month"), months)
    same_day = F.when(F.dayofmonth(date) <= F.dayofmonth(F.last_day(first)), F.date_add(first, F.dayofmonth(date) - 1))
    return F.when(months.isNotNull(), same_day).when(F.contains(text, F.lit("day")), F.date_add(date, n))


def fenced_json(c: Column) -> Column:
    """The JSON part of an answer: a json fence, any fence that begins like JSON, else the first { to the last }."""
    tagged = F.regexp_extract(c, r"(?s)```json\s*(.*?)\s*```", 1)
    any_fence = F.regexp_extract(c, r"(?s)```\s*(.*?)\s*```", 1)
    braces = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    usable = F.when(any_fence.rlike(r"^[{\[]"), any_fence).otherwise("")
    return F.when(c.rlike(r"(?s)```json\s*.*?\s*```"), tagged).when(c.rlike(r"(?s)```\s*.*?\s*```"), usable).otherwise(braces)


def sanitize_json(c: Column) -> Column:
    """Join "a" and "b", drop trailing commas, put keys in single quotes into double ones."""
    c = F.regexp_replace(c, r'"([^"]*?)" and "([^"]*?)"', '"$1 and $2"')
    c = F.regexp_replace(c, r",(\s*[}\]])", "$1")
    return F.regexp_replace(c, r"'([^']*?)':", '"$1":')


def strip_fence(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```(json)?\s*", ""), r"\s*```$", ""))


def without_placeholders(c: Column) -> Column:
    return F.when(~c.isin(*domains.PLACEHOLDERS), c)


def record(answer: Column, fields: Sequence[str]) -> Column:
    """struct of the fields as text from an answer's JSON; absent, unreadable and placeholder values are null."""
    parsed = F.from_json(sanitize_json(fenced_json(answer)), ", ".join(f"`{f}` string" for f in fields))
    return F.struct(*[without_placeholders(parsed[f]).alias(f) for f in fields])


def completeness(row: Column, fields: Sequence[str]) -> Column:
    filled = F.lit(0)
    for f in fields:
        filled = filled + row[f].isNotNull().cast("int")
    return filled / F.lit(len(fields))


def option(answer: Column, options: Sequence[str]) -> Column:
    """struct<category, confidence>: the answer's category if allowed, else an option inside it or it inside an option; without JSON the first option named, at 0.7."""
    parsed = F.from_json(sanitize_json(fenced_json(answer)), "category string, confidence double")
    allowed = F.array(*[F.lit(o) for o in options])
    said = parsed["category"]
    near = F.filter(allowed, lambda o: F.contains(F.lower(o), F.lower(said)) | F.contains(F.lower(said), F.lower(o)))
    named = F.filter(allowed, lambda o: F.contains(F.lower(answer), F.lower(o)))
    category = F.when(said.isNotNull(), F.coalesce(F.when(F.array_contains(allowed, said), said), F.try_element_at(near, F.lit(1)))).otherwise(F.try_element_at(named, F.lit(1)))
    confidence = F.when(said.isNotNull(), F.coalesce(parsed["confidence"], F.lit(0.8))).otherwise(F.lit(0.7))
    return F.struct(category.alias("category"), F.when(category.isNotNull(), confidence).alias("confidence"))


_PAIR = re.compile(r'"([^"]+)"\s*:\s*"([^"]*)"')


def _readable(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def _inside_strings(text: str) -> str:
    """Quotes that neither follow nor precede structure are escaped; line ends inside strings become \\n, other controls go."""
    out, inside, i = [], False, 0
    while i < len(text):
        c = text[i]
        if inside and c == "\\" and i + 1 < len(text):
            out.append(text[i : i + 2])
            i += 2
            continue
        if c == '"':
            if not inside:
                inside = True
            elif text[i + 1 :].lstrip()[:1] in (",", "}", "]", ":", ""):
                inside = False
            else:
                c = '\\"'
        elif inside and c == "\n":
            c = "\\n"
        elif ord(c) < 0x20 and inside or 0x7F <= ord(c) <= 0x9F:
            c = ""
        out.append(c)
        i += 1
    return "".join(out)


def repaired(text: str | None) -> str | None:
    """A readable JSON text from a damaged one: fences, trailing commas, stray quotes and line ends, the outer braces, at last the readable pairs."""
    if text is None:
        return None
    body = re.sub(r"```\s*$", "", re.sub(r"```json\s*", "", text)).strip()
    tries = [body, comma := re.sub(r",(\s*[}\]])", r"\1", body), fixed := re.sub(r",(\s*[}\]])", r"\1", _inside_strings(comma))]
    if 0 <= fixed.find("{") < fixed.rfind("}"):
        tries.append(fixed[fixed.find("{") : fixed.rfind("}") + 1])
    for t in tries:
        if _readable(t):
            return t
    pairs = _PAIR.findall(text)
    return json.dumps(dict(pairs), ensure_ascii=False) if pairs else fixed


@F.pandas_udf(T.StringType())
def repair_json(texts: pd.Series) -> pd.Series:
    return texts.map(repaired, na_action="ignore")


def sample_pairs(answer: Column, most: int = 8) -> Column:
    """Subject and body pairs from an answer that is no JSON: bodies over 50, subjects over 20 characters, at most `most`."""
    pattern = r'"subject"\s*:\s*"([^"]+)"[^}]*?"body"\s*:\s*"([^"]+)"'
    subjects, bodies = (F.regexp_extract_all(answer, F.lit(pattern), F.lit(i)) for i in (1, 2))
    pairs = F.transform(F.arrays_zip(subjects.alias("subject"), bodies.alias("body")), lambda p: F.struct(p["subject"].alias("subject"), p["body"].alias("body")))
    return F.slice(F.filter(pairs, lambda p: (F.length(p["subject"]) > 20) & (F.length(p["body"]) > 50)), 1, most)


def synonym(c: Column, table: Mapping[str, Sequence[str]], default: str) -> Column:
    """The key whose list holds c (trimmed, lower case), else the default."""
    name, out = F.lower(F.trim(c)), F.lit(default)
    for key, names in table.items():
        out = F.when(name.isin(key, *names), key).otherwise(out)
    return F.when(c.isNull(), default).otherwise(out)


# Names for the urgency and the kind of a letter.
URGENCY = {
    "urgent": ("high", "critical", "priority", "immediate", "asap"),
    "normal": ("medium", "standard", "regular", "moderate"),
    "routine": ("low", "minor", "non-urgent", "informational"),
}
LETTER_KINDS = {
    "complaint": ("objection", "grievance", "issue"),
    "request": ("query", "inquiry", "application", "proposal"),
    "notice": ("notification", "alert", "announcement"),
    "response": ("reply", "answer", "feedback"),
    "claim": ("demand", "billing"),
    "other": (),
}
