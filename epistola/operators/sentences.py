"""Sentence splitting learned from the texts themselves: abbreviations, sentence starters and collocations by log-likelihood.

The counts (tokens of a type with and without full stop, types after a break, pairs around a full stop) are sums that
Spark adds up from all texts; what passes the thresholds is the model, a table of any size.
A token is what stands between white space in cleaned text; its type is lower-case, without quotes,
commas and one final full stop; numbers are one type.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epistola.functions import text as tx
from epistola.functions.columns import once
from epistola.session import stored

#: Scores from which a type is an abbreviation, a sentence starter, a pair a collocation (fixed values).
ABBREVIATION, STARTER, COLLOCATION = 0.3, 30.0, 7.88
#: Rows and bytes of a model that every task holds as sets; texts meet a larger one by joins.
HELD_ROWS, HELD_BYTES = 150_000, 16 << 20
NUMBER = "##number##"
_EDGE, _DIGITS, _INITIAL, _LETTER = r"""^["'-]+|["',;:-]+$""", r"^-?[0-9][0-9.,]*$", r"^[\p{L}]\.$", r"[\p{L}\p{N}_]"
_UPPER = r"""^["'-]*\p{Lu}"""


@dataclass(frozen=True)
class Model:
    abbreviations: frozenset[str]
    starters: frozenset[str]
    collocations: frozenset[tuple[str, str]]


def _tokens(text: str) -> Column:
    return F.array_remove(F.split(tx.clean_text(F.col(text)), " "), "")


def _body(token: Column) -> Column:
    return F.regexp_replace(token, _EDGE, "")


def _type(body: Column) -> Column:
    bare = F.when(body.endswith("."), F.left(body, F.length(body) - 1)).otherwise(body)
    return F.when(body.rlike(_DIGITS), NUMBER).otherwise(F.lower(bare))


def token_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """type, initial, stop, next, k: tokens counted by their type, whether they are an initial and end in a full stop, and, of those that do, by the type behind.

    next is null at the end of a text. Tokens are counted as they stand first, and bodies and types are made of distinct ones only.
    """
    rows = once(docs.select(F.col(text)), {"t": _tokens(text)}).select(F.inline(F.arrays_zip("t", F.slice("t", F.lit(2), F.size("t")).alias("n"))))
    said = rows.select(F.col("t"), F.when(F.contains("t", F.lit(".")), F.col("n")).alias("n")).groupBy("t", "n").agg(F.count(F.lit(1)).alias("k"))
    bodies = once(said, {"body": _body(F.col("t")), "behind": _body(F.col("n"))})
    stop = F.col("body").endswith(".")
    typed = bodies.select(_type(F.col("body")).alias("type"), F.col("body").rlike(_INITIAL).alias("initial"), stop.alias("stop"), F.when(stop, _type(F.col("behind"))).alias("next"), "k")
    return typed.groupBy("type", "initial", "stop", "next").agg(F.sum("k").alias("k"))


def dunning(total: Column, with_stop: Column, stops: Column, n: Column) -> Column:
    """Log-likelihood ratio that a type stands with a full stop (0.99) rather than as often as any."""
    p = stops / n
    chance = with_stop * F.ln(p) + (total - with_stop) * F.ln(1 - p)
    tied = with_stop * F.ln(F.lit(0.99)) + (total - with_stop) * F.ln(F.lit(0.01))
    return -2 * (chance - tied)


def together(a: Column, b: Column, ab: Column, n: Column) -> Column:
    """Log-likelihood ratio that b follows a more often than it follows anything."""
    log = lambda k, x: F.when(k == 0, 0.0).otherwise(k * F.ln(x))
    p, p1, p2 = b / n, ab / a, F.try_divide(b - ab, n - a)
    apart = log(ab, p) + log(a - ab, 1 - p) + log(b - ab, p) + log(n - a - b + ab, 1 - p)
    near = F.when(a == ab, 0.0).otherwise(log(ab, p1) + log(a - ab, 1 - p1))
    far = F.when(b == ab, 0.0).otherwise(log(b - ab, p2) + log(n - a - b + ab, 1 - p2))
    return -2 * (apart - near - far)


def learn(docs: DataFrame, text: str = "text") -> DataFrame:
    """kind (abbreviation, starter, collocation), type, next (of collocations, else ''), score: all that pass the thresholds.

    An abbreviation's score falls with its length and with its tokens without full stop, and grows with the full stops inside.
    Starters follow a full stop that ends no abbreviation; collocations join an abbreviation,
    an initial or a number with what follows it, unless that is a starter. Null texts have no tokens.
    Abbreviations and starters are written once, so joins with them are broadcast or shuffled by their size.
    """
    pairs = stored(token_counts(docs, text), "tokens")
    counts = pairs.groupBy("type").agg(F.sum("k").alias("total"), F.sum(F.when(F.col("stop"), F.col("k")).otherwise(0)).alias("with_stop"))
    sums = counts.agg(F.sum("total").alias("n"), F.sum("with_stop").alias("stops"))
    scored = counts.crossJoin(F.broadcast(sums))  # one row
    inner = F.length("type") - F.length(F.replace("type", F.lit("."), F.lit("")))
    letters = F.length("type") - inner
    weight = F.exp(-letters.cast("double")) * (inner + 1) * F.pow(letters.cast("double"), -(F.col("total") - F.col("with_stop")).cast("double"))
    score = dunning(F.col("total"), F.col("with_stop"), F.col("stops"), F.col("n")) * weight
    named = scored.where((F.col("with_stop") > 0) & (F.col("type") != NUMBER) & F.col("type").rlike(_LETTER) & (F.col("stops") < F.col("n")))
    short = stored(named.select(F.lit("abbreviation").alias("kind"), "type", F.lit("").alias("next"), score.alias("score")).where(F.col("score") >= ABBREVIATION), "abbreviations")
    known = short.select("type", F.lit(True).alias("short"))
    marked = pairs.where("stop and next is not null").join(known, "type", "left").withColumn("short", F.coalesce("short", F.lit(False)))
    ends = pairs.where("stop").join(known, "type", "left_anti").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("breaks"))
    first = marked.where(~F.col("short")).groupBy("next").agg(F.sum("k").alias("ab"))
    first = first.join(counts.select(F.col("type").alias("next"), F.col("total").alias("b")), "next").crossJoin(F.broadcast(ends)).crossJoin(F.broadcast(sums))
    first = first.where(F.col("next").rlike(_LETTER) & (F.col("next") != NUMBER)).withColumn("score", together(F.col("breaks"), F.col("b"), F.col("ab"), F.col("n")))
    starts = first.where((F.col("score") >= STARTER) & (F.col("n") / F.col("breaks") > F.col("b") / F.col("ab")))
    starts = stored(starts.select(F.lit("starter").alias("kind"), F.col("next").alias("type"), F.lit("").alias("next"), "score"), "starters")
    tied = marked.where(F.col("short") | F.col("initial") | (F.col("type") == NUMBER)).groupBy("type", "next").agg(F.sum("k").alias("ab")).where("ab > 1")
    tied = tied.join(counts.select("type", F.col("total").alias("a")), "type").join(counts.select(F.col("type").alias("next"), F.col("total").alias("b")), "next").crossJoin(F.broadcast(sums))
    tied = tied.join(starts.select(F.col("type").alias("next")), "next", "left_anti").withColumn("score", together(F.col("a"), F.col("b"), F.col("ab"), F.col("n")))
    joined = tied.where(F.col("next").rlike(_LETTER) & (F.col("score") >= COLLOCATION) & (F.col("n") / F.col("a") > F.col("b") / F.col("ab")))
    joined = joined.select(F.lit("collocation").alias("kind"), "type", "next", "score")
    return short.unionByName(starts).unionByName(joined)


def model(learned: DataFrame) -> Model:
    """The model as sets; all its rows come to the driver."""
    rows = learned.select("kind", "type", "next").collect()
    of = lambda kind: frozenset(r["type"] for r in rows if r["kind"] == kind)
    return Model(of("abbreviation"), of("starter"), frozenset((r["type"], r["next"]) for r in rows if r["kind"] == "collocation"))


_edge, _digits = re.compile(_EDGE), re.compile(_DIGITS)


def _python_type(token: str) -> tuple[str, str]:
    body = _edge.sub("", token)
    if _digits.match(body):
        return body, NUMBER
    return body, (body[:-1] if body.endswith(".") else body).lower()


def ends(token: str, following: str, known: Model) -> bool:
    """Whether a sentence ends with token: at ! and ?, and at a full stop unless the model speaks against it."""
    body, kind = _python_type(token)
    if body.endswith(("!", "?")):
        return True
    if not body.endswith("."):
        return False
    first = following.lstrip("\"'-")[:1]
    behind, upper = _python_type(following)[1], first != "" and unicodedata.category(first) == "Lu"
    if (kind, behind) in known.collocations:
        return False
    if kind in known.abbreviations or (len(body) == 2 and body[0].isalpha()):
        return upper and behind in known.starters
    return upper or kind != NUMBER


def splitter(known: Model) -> Callable[[Column], Column]:
    """A function from text to its sentences (of cleaned text) under the model."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            tokens = [] if text is None else [t for t in text.split(" ") if t]
            made, start = [], 0
            for i, token in enumerate(tokens[:-1]):
                if token[-1] in ".!?\"',;:-" and ends(token, tokens[i + 1], known):
                    made.append(" ".join(tokens[start : i + 1]))
                    start = i + 1
            if tokens:
                made.append(" ".join(tokens[start:]))
            out.append(made)
        return pd.Series(out, dtype="object")

    return lambda c: split(tx.clean_text(c))


def _places(rows: DataFrame, learned: DataFrame, text: str) -> DataFrame:
    """__row, places: the tokens, counted from 1, that end sentences within a text; what ends() says of each, by joins.

    The model is asked once about each pair of types around a full stop.
    """
    said = once(rows.select("__row", text), {"t": _tokens(text)}).select("__row", F.posexplode(F.arrays_zip("t", F.slice("t", F.lit(2), F.size("t")).alias("n"))).alias("i", "x"))
    said = said.select("__row", (F.col("i") + 1).alias("place"), "x.t", "x.n").where(F.col("n").isNotNull() & F.col("t").rlike("[.!?]"))
    bodies = once(said, {"body": _body(F.col("t")), "behind": _body(F.col("n"))}).where(F.col("body").rlike("[.!?]$"))
    stop, upper = F.col("body").endswith("."), F.col("n").rlike(_UPPER)
    types = [F.when(stop, c).alias(name) for name, c in (("type", _type(F.col("body"))), ("next", _type(F.col("behind"))), ("initial", F.col("body").rlike(_INITIAL)), ("upper", upper))]
    signs = stored(bodies.select("__row", "place", *types), "signs")
    stops = signs.where(F.col("type").isNotNull())
    of = lambda kind, *columns: learned.where(F.col("kind") == kind).select(*columns, F.lit(True).alias(kind))
    pairs = stops.select("type", "next", "initial").distinct().join(of("collocation", "type", "next"), ["type", "next"], "left_anti")
    pairs = pairs.join(of("abbreviation", "type"), "type", "left").join(of("starter", F.col("type").alias("next")), "next", "left")
    short = F.coalesce("abbreviation", F.lit(False)) | F.col("initial")
    ending = pairs.where(~short | F.col("starter").isNotNull()).select("type", "next", "initial", (~short & (F.col("type") != NUMBER)).alias("always"))
    ended = stops.join(stored(ending, "endings"), ["type", "next", "initial"]).where(F.col("always") | F.col("upper"))
    found = ended.select("__row", "place").unionByName(signs.where(F.col("type").isNull()).select("__row", "place"))
    return found.groupBy("__row").agg(F.sort_array(F.collect_list("place")).alias("places"))


def split(docs: DataFrame, learned: DataFrame, text: str = "text", to: str = "sentences") -> DataFrame:
    """docs with the sentences of (cleaned) text under a model of any size, as learn() gives it; best written before, as it is read several times.

    A model of at most HELD_ROWS rows and HELD_BYTES is held by every task. A larger one passes neither the driver nor a task:
    signs that may end a sentence meet it by joins, and their places come back to the texts, which are shuffled once.
    """
    size = learned.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("type") + F.octet_length("next")), F.lit(0)).alias("b")).first()
    if size["n"] <= HELD_ROWS and size["b"] <= HELD_BYTES:
        return once(docs, {to: splitter(model(learned))(F.col(text))})
    rows = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "texts")
    placed = once(rows.join(_places(rows, learned, text), "__row", "left"), {"__t": F.coalesce(_tokens(text), F.array().cast("array<string>")), "__p": F.coalesce("places", F.array().cast("array<int>"))})
    starts, stops = F.concat(F.array(F.lit(0)), "__p"), F.concat("__p", F.array(F.size("__t")))
    parts = F.zip_with(starts, stops, lambda a, b: F.array_join(F.slice("__t", a + 1, b - a), " "))
    return once(placed, {to: F.when(F.size("__t") > 0, parts).otherwise(F.array().cast("array<string>"))}).select(*docs.columns, to)
