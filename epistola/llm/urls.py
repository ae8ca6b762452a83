"""URL filters: rules by host and path, and trust that spreads over the link graph of hosts (DataFrame functions only)."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epistola.llm.common import discard, materialize

#: (verdict, host and path) of the query's rules (fixed values).
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Where a link begins, and its address in what follows up to the next one, so that the time grows with the text; the page's own base.
_ANCHOR = r"(?i)<a\s"
_HREF = r"""(?i)^(?:[^>]*?\s)?href\s*=\s*["']?\s*([^"'\s>]+)"""
_BASE = r"""(?i)<base\s(?:[^>]*?\s)?href\s*=\s*["']?\s*([^"'\s>]+)"""
_AUTHORITY, _SCHEME = r"(?i)^(?:https?:)?//([^/?#]+)", r"(?i)^[a-z][a-z0-9+.-]*:"
#: Character references by name that may stand in an address (fixed values).
NAMED = {"&colon;": ":", "&sol;": "/", "&period;": ".", "&commat;": "@", "&num;": "#", "&quest;": "?", "&equals;": "=", "&amp;": "&"}
#: Share of a score that each link step passes on, the change at which the steps end and their most, and the distrust or leaning from which a host is blocked.
DAMPING, TOLERANCE, STEPS, LIMIT = 0.85, 1e-5, 200, 0.5
STEPS_PER_WRITE = 5


def host_of(url: str) -> Column:
    """After the first ://, up to / ? # or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null."""
    choice = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + rest))
        choice = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(choice)
    return choice


def decoded(address: Column) -> Column:
    """An address with its character references (numbers below 128, and NAMED) replaced."""
    def put(text: Column, reference: Column) -> Column:
        digits = F.regexp_extract(reference, "([0-9a-fA-F]+)$", 1)
        code = F.when(F.lower(reference).contains("x"), F.conv(digits, 16, 10)).otherwise(digits).cast("int")
        return F.when(code.between(33, 126), F.replace(text, F.concat(reference, F.lit(";")), F.char(code))).otherwise(text)

    references = F.array_distinct(F.regexp_extract_all(address, F.lit("(?i)(&#(?:x0{0,4}[0-9a-f]{1,2}|0{0,4}[0-9]{1,3}));"), F.lit(1)))
    out = F.aggregate(references, address, put)
    for name, sign in NAMED.items():
        out = F.replace(out, F.lit(name), F.lit(sign))
    return F.when(F.contains(address, F.lit("&")), out).otherwise(address)


def _authority(address: Column) -> Column:
    return F.translate(F.regexp_replace(F.regexp_extract(address, _AUTHORITY, 1), "^[^@]*@", ""), UPPER, LOWER)


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """from, to, n: links between different hosts, counted: absolute and protocol-relative ones, and relative ones of pages with a base on another host."""
    body = F.coalesce(F.col(html), F.lit(""))
    pieces = F.split(body, _ANCHOR)
    # one row per page first, so that no page is carried along with each of its links
    each = pages.where(body.rlike(_ANCHOR)).select(
        host_of(url).alias("from"), _authority(decoded(F.regexp_extract(body, _BASE, 1))).alias("base"), F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))).alias("pieces")
    )
    rows = each.select("from", "base", F.explode("pieces").alias("piece"))
    found = rows.select("from", "base", decoded(F.regexp_extract("piece", _HREF, 1)).alias("to")).where("`to` != ''")
    absolute = _authority(F.col("to"))
    relative = (F.col("base") != "") & ~F.col("to").rlike(_SCHEME) & ~F.startswith("to", F.lit("//"))
    named = found.select("from", F.when(relative, F.col("base")).otherwise(absolute).alias("to"))
    return named.where("`from` != '' and `to` != '' and `from` != `to`").groupBy("from", "to").agg(F.count(F.lit(1)).alias("n"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, steps: int = STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust, distrust, leaning of personalised PageRank: until no score changes by `tolerance` between two writes, or after `steps`.

    Trust starts at seeds(host, allowed) and follows links, a host's share split over its
    outgoing links; distrust starts at seeds(host, blocked) and goes against them, split over
    incoming links. Leaning starts there too and goes against links, but a host takes it by the
    share of its own outgoing links, so it does not shrink with the number of hosts that link
    to the same one. A score is its seed plus the damped sum that arrives.
    """
    out = edges.groupBy(F.col("from").alias("f")).agg(F.sum("n").alias("total"))
    into = edges.groupBy(F.col("to").alias("t")).agg(F.sum("n").alias("total"))
    both = edges.join(out, F.col("from") == F.col("f")).select("from", "to", "n", (F.col("n") / F.col("total")).alias("part"))
    both = both.join(into, F.col("to") == F.col("t")).select("from", "to", "part", (F.col("n") / F.col("total")).alias("doubt"))
    none = F.lit(0.0)
    forward = both.select(F.col("from").alias("source"), F.col("to").alias("host"), F.col("part").alias("trusts"), none.alias("doubts"), none.alias("leans"))
    backward = both.select(F.col("to").alias("source"), F.col("from").alias("host"), none.alias("trusts"), F.col("doubt").alias("doubts"), F.col("part").alias("leans"))
    moves = forward.unionByName(backward).groupBy("source", "host").agg(*[F.sum(c).alias(c) for c in ("trusts", "doubts", "leans")])
    moves = materialize(moves, "moves")
    start = seeds.select("host", F.col("allowed").alias("trust"), F.col("blocked").alias("distrust"), F.col("blocked").alias("leaning"))
    if moves.isEmpty():
        return start
    kinds = ("trust", "distrust", "leaning")
    scores = before = start
    for step in range(1, steps + 1):
        sent = moves.join(scores.withColumnRenamed("host", "source"), "source").select(
            "host", *[(F.col(w) * F.col(c) * damping).alias(c) for w, c in (("trusts", "trust"), ("doubts", "distrust"), ("leans", "leaning"))]
        )
        scores = start.unionByName(sent).groupBy("host").agg(*[F.sum(c).alias(c) for c in kinds])
        if step % STEPS_PER_WRITE == 0:
            scores = materialize(scores, "scores")
            old = before.select("host", *[F.col(c).alias(f"old_{c}") for c in kinds])
            change = F.greatest(*[F.abs(F.col(c) - F.coalesce(f"old_{c}", F.lit(0.0))) for c in kinds])
            moved = scores.join(old, "host", "left").agg(F.max(change)).head()[0]
            if before is not start:
                discard(before)
            before = scores
            if moved is None or moved < tolerance:
                break
    else:
        # what is left changes by less than damping ** steps
        warnings.warn(f"scores still move by {tolerance} after {steps} steps", RuntimeWarning, stacklevel=2)
    return scores


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, key: str = "page_id", url: str = "url", html: str = "html", limit: float = LIMIT) -> DataFrame:
    """key, host, path, rule, verdict, trust, distrust per page.

    The longest rule that fits decides. Otherwise the host does: seeds are the shares of a
    host's pages that rules allow and block, spread over the links; a host is blocked when the
    greater of its distrust (it gives much of what blocked hosts are linked by) and its leaning
    (much of its links lead to them) is at least `limit` and above its trust. Null urls and urls without :// have
    empty host and path and no score of a host, so they are allowed; null html has no links;
    repeated rows each get their row; an empty table gives an empty table.
    """
    host, path = host_of(url), path_of(url)
    rows = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    rows = materialize(rows.withColumn("match", matched_rule(F.col("host"), F.col("path"), rules)).select("key", "host", "path", "match.rule", "match.verdict"), "urls")
    share = lambda verdict: F.avg(F.when(F.col("verdict") == verdict, 1.0).otherwise(0.0))
    seeds = rows.where("host != ''").groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked"))
    scores = spread(links(pages, url, html), seeds)
    doubt = F.coalesce(F.greatest("distrust", "leaning"), F.lit(0.0))
    blocked = (doubt >= limit) & (doubt > F.coalesce("trust", F.lit(0.0)))
    return rows.join(scores, "host", "left").select(
        F.col("key").alias(key), "host", "path", "rule", F.coalesce("verdict", F.when(blocked, "block").otherwise("allow")).alias("verdict"), "trust", "distrust"
    )
