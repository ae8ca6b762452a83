"""Main text of pages by site style trees.

Pages of a host are merged into a tree of styles: a node is the path of block elements with
their classes. A leaf's content importance falls as its texts repeat over the host's pages
(one minus the mean entropy of its texts); a node's presentation importance is the entropy
of its child lists. Branches whose composite importance is low are cut from each page.
Elements that mean navigation, notices and the like are noise in every tree. Blocks inside
an article or main element are leaves of the tree too; as their element speaks for them, a
prior and a lower limit hold for their styles, and they all stay on a page that would else be empty.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epistola.llm.common import fresh, map_rows, materialize, text_of
from epistola.llm.urls import host_of

#: Weight of a leaf's content against its parent's presentation, and the importance below which a branch goes.
CONTENT_WEIGHT, LOW = 0.9, 0.35
#: The same limit inside article and main, and the pages without repetition that are counted there beforehand.
ARTICLE_LOW, ARTICLE_PRIOR = 0.2, 10
#: Low styles are broadcast up to this many; beyond it each page's own are looked up by a join.
BROADCAST_STYLES = 200_000

#: Elements by role (fixed values).
RAW = frozenset("script style title textarea noscript template iframe noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE = frozenset("head nav header footer aside form script style title noscript template iframe textarea option dialog menu fieldset".split())
#: Elements whose content is no text and that stand inside a block without ending it.
INLINE_NOISE = frozenset("button select svg canvas object label".split())
#: Blocks of running text: inside article and main, their class, id or role is no verdict.
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th caption figcaption".split())
BLOCKS = frozenset(
    "html body p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption article section main blockquote pre figure figcaption address details summary hr center".split()
) | NOISE
CONTENT = frozenset(["article", "main"])
#: Elements that no class, id or role makes noise, and those that leave an open head open.
NEVER_NOISE = CONTENT | frozenset(["html", "body"])
IN_HEAD = frozenset("html head title meta base basefont bgsound link script style noscript noframes template".split())
CLOSES_P = BLOCKS - frozenset(["html", "body", "head", "li", "td", "th", "tr", "option", "label"])
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset(["table", "ul", "ol", "dl", "select", "article", "section", "div", "body", "main"])
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead "
    "comment comments reply replies respond disqus notice cookie cookies consent gdpr popup modal overlay share sharing social related recommended newsletter subscribe signup login "
    "pagination pager toolbar widget skip copyright".split()
)

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>"']++|"[^"]*+"|'[^']*+')*+))>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""",
    re.DOTALL,
)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class _Node:
    __slots__ = ("tag", "path", "noise", "content", "children")

    def __init__(self, tag: str, path: int, noise: bool, content: bool) -> None:
        self.tag, self.path, self.noise, self.content = tag, path, noise, content
        self.children: list[str] = []


def _noise_token(token: str) -> bool:
    """Whether a class, id or role is made of noise words alone, as cookie-notice is and no-sidebar is not."""
    words = _WORDS.findall(token)
    return bool(words) and all(w.lower() in NOISE_WORDS for w in words)


def _style(tag: str, attributes: str, in_content: bool = False) -> tuple[str, bool]:
    """Style name of an element (digits do not count) and whether its names mean noise.

    A paragraph, heading, item or cell of an article may be called anything (related, reply, social): there the
    tree decides, by what repeats over the site's pages.
    """
    if not attributes or attributes.isspace():
        return tag, tag in NOISE
    name, noise = tag, tag in NOISE
    for m in _NAMES.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        if key == "hidden" or (key == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE)):
            noise = True
        elif key != "style":
            named = tag not in NEVER_NOISE and not (in_content and tag in TEXT_BLOCKS)
            noise = noise or (named and any(map(_noise_token, value.split())))
            name += ("#" if key == "id" else ".") + re.sub(r"\d+", "0", value)
    return name, noise


def blocks(html: str) -> tuple[list[tuple[int, int, bool, str]], list[tuple[int, str]]]:
    """A page's blocks (style path, parent's path, inside content, text), and (path, child list) of its nodes.

    A path is a 64-bit code of the parent's path and the style name, so deep pages stay small.

    Noise elements leave no block. Character references are decoded; white space inside a
    block is one space. End tags may be missing.
    """
    out: list[tuple[int, int, bool, str]] = []
    nodes: dict[int, _Node] = {}
    stack = [_Node("", 0, False, False)]
    text: list[str] = []
    quiet = 0  # open noise elements
    opened: Counter[str] = Counter()  # open elements by tag, so that what is not open is not looked for
    unclosed: dict[str, int] = {}  # where inline noise elements without an end tag have been given up

    def flush() -> None:
        if text:
            if not quiet:
                body = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
                if body:
                    top = stack[-1]
                    parent = stack[-2].path if len(stack) > 1 else 0
                    out.append((top.path, parent, top.content, body))
            text.clear()

    def pop_to(depth: int) -> None:
        nonlocal quiet
        flush()
        while len(stack) > depth:
            gone = stack.pop()
            quiet -= gone.noise
            opened[gone.tag] -= 1

    def leave_head() -> None:
        while stack[-1].tag == "head":
            pop_to(len(stack) - 1)

    def add(piece: str) -> None:
        if stack[-1].tag == "head" and piece.strip(" \t\n\f\r"):
            leave_head()
        text.append(piece)

    at, size = 0, len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        if m is None:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if not closing and tag not in IN_HEAD:
            leave_head()
        if tag in INLINE_NOISE and not closing and not attributes.endswith("/") and unclosed.get(tag, at) <= at:
            end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(html, at)
            if end:
                at = end.end()
                text.append(" ")
            else:
                unclosed[tag] = size  # none further on either
            continue
        if tag not in BLOCKS and tag not in RAW:
            if tag in VOID:
                text.append(" ")
            continue
        if closing:
            if not opened[tag]:
                flush()
                continue
            pop_to(next(depth for depth in range(len(stack) - 1, 0, -1) if stack[depth].tag == tag))
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(html, at)
            at = end.end() if end else size
            continue
        if tag in CLOSES_P and opened["p"]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    pop_to(depth)
                    break
                if stack[depth].tag in SCOPES:
                    break
        if tag in ENDS and any(opened[t] for t in ENDS[tag]):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in ENDS[tag]:
                    pop_to(depth)
                    if tag != "tr":
                        break
                elif stack[depth].tag in SCOPES:
                    break
        flush()
        if tag in VOID:
            continue
        parent = stack[-1]
        name, noise = _style(tag, attributes, parent.content)
        parent.children.append(name)
        node = _Node(tag, _code(f"{parent.path}>{name}"), noise, (parent.content or tag in CONTENT) and not noise)
        stack.append(node)
        opened[tag] += 1
        nodes[node.path] = node
        quiet += noise
        if attributes.endswith("/"):
            pop_to(len(stack) - 1)
    pop_to(1)
    flush()
    return out, [(p, ",".join(n.children)) for p, n in nodes.items() if n.children and not n.noise]


def _code(text: str) -> int:
    data = text.encode("utf-8", "surrogatepass")
    return (zlib.crc32(data) << 31) ^ zlib.crc32(data[::-1])


_FEATURES = T.ArrayType(
    T.StructType([T.StructField("path", T.LongType()), T.StructField("parent", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("feature", T.LongType())])
)


def style_importance(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, path, article, importance of the leaf styles of each host's tree (paths as 64-bit codes).

    Pages of a host with the same blocks are copies and count as one page.
    """

    def make():
        def work(bodies):
            rows, copies = [], []
            for body in bodies:
                found, nodes = blocks(body)
                leaves = {(path, parent, "article" if content else "content", _code(text)) for path, parent, content, text in found}
                shapes = {(path, 0, "shape", _code(children)) for path, children in nodes}
                rows.append([dict(zip(("path", "parent", "kind", "feature"), f, strict=True)) for f in sorted(leaves | shapes)])
                copies.append(_code("\n".join(f"{path} {text}" for path, _, _, text in found)))
            return [rows, copies]

        return work

    source = pages.select(host_of(url).alias("host"), text_of(html).alias("body"))
    each = map_rows(source, ["body"], [("features", _FEATURES), ("copy", T.LongType())], make, ["host"]).select("host", "copy", F.inline("features"))
    counted = each.distinct().groupBy("host", "path", "kind", "feature").agg(F.count(F.lit(1)).alias("n"), F.max("parent").alias("parent"))
    counted = materialize(counted, "styles")
    total = F.sum("n").cast("double")
    shape = counted.where("kind = 'shape'").groupBy("host", F.col("path").alias("parent")).agg(
        total.alias("m"), F.sum(F.col("n") * F.ln("n")).alias("nlogn")
    )
    shape = shape.select("host", "parent", F.when(F.col("m") > 1, (F.ln("m") - F.col("nlogn") / F.col("m")) / F.ln("m")).otherwise(1.0).alias("presentation"))
    article = (F.col("kind") == "article").alias("article")
    leaf = counted.where("kind != 'shape'").groupBy("host", "path", "parent", article).agg(total.alias("m"), F.avg(F.ln("n")).alias("logn"))
    leaf = leaf.withColumn("m", F.col("m") + F.when(F.col("article"), F.lit(float(ARTICLE_PRIOR))).otherwise(0.0))
    content = F.when(F.col("m") > 1, 1 - F.col("logn") / F.ln("m")).otherwise(1.0)
    joined = leaf.withColumn("content", content).join(shape, ["host", "parent"], "left")
    composite = (1 - CONTENT_WEIGHT) * F.coalesce("presentation", F.lit(0.0)) + CONTENT_WEIGHT * F.col("content")
    return joined.select("host", "path", "article", composite.alias("importance"))


def extract(pages: DataFrame, url: str = "url", html: str = "html", low: float = LOW, keep: list[str] | None = None) -> DataFrame:
    """Append main text and n_chars (code points) to pages.

    Kept are blocks of styles whose importance is at least `low`, or ARTICLE_LOW inside article
    or main elements, whose blocks all stay where nothing else would; blocks are joined in page order by line feeds. A text seen on one page of
    a host, or on copies of one page, has full importance, so a host with one page loses only noise elements. Null html
    counts as empty and gives an empty text; null urls share the host with the empty name;
    an empty table gives an empty table; columns with the names of new ones are replaced.
    """
    least = F.when(F.col("article"), min(ARTICLE_LOW, low)).otherwise(low)
    styles = materialize(style_importance(pages, url, html).where(F.col("importance") < least).select("host", "path").distinct(), "low-styles")
    taken = [*pages.columns, "text", "n_chars"]
    host, gone = fresh("host", taken), fresh("gone", taken)
    source = pages.withColumns({host: host_of(url)})
    shared = None
    if styles.count() <= BROADCAST_STYLES:
        by_host: dict[str, list[int]] = {}
        for r in styles.toLocalIterator():
            by_host.setdefault(r["host"], []).append(r["path"])
        shared = pages.sparkSession.sparkContext.broadcast({h: frozenset(paths) for h, paths in by_host.items()})
        source = source.withColumn(gone, F.lit(None).cast("array<bigint>"))
    else:
        source = _with_low(source, styles, html, host, gone, taken)

    def make():
        known = shared.value if shared else {}

        def work(bodies, hosts, lows):
            texts = []
            for body, name, low_paths in zip(bodies, hosts, lows, strict=True):
                cut = known.get(name, frozenset()) if shared else frozenset(low_paths or ())
                found = blocks(body)[0]
                kept = [t for path, _, _, t in found if path not in cut] or [t for _, _, content, t in found if content]
                texts.append("\n".join(kept))
            return [texts, [len(t) for t in texts]]

        return work

    new = [("text", T.StringType()), ("n_chars", T.LongType())]
    keep = [c for c in (pages.columns if keep is None else keep) if c not in ("text", "n_chars")]
    return map_rows(source, [text_of(f"`{html}`"), host, gone], new, make, keep)


def _with_low(source: DataFrame, styles: DataFrame, html: str, host: str, gone: str, taken: list[str]) -> DataFrame:
    """source with the low styles among each page's own: paths of pages and low styles are rows that meet by host and path."""

    def make():
        def work(bodies):
            return [[sorted({path for path, *_ in blocks(body)[0]}) for body in bodies]]

        return work

    mark, place = fresh("mark", [*taken, host, gone]), F.struct(F.col(host), F.md5(text_of(f"`{html}`").cast("binary")))
    rows = source.select(F.col(host).alias("host"), place.alias("mark"), text_of(f"`{html}`").alias("body")).dropDuplicates(["mark"])
    paths = map_rows(rows, ["body"], [("paths", T.ArrayType(T.LongType()))], make, ["host", "mark"]).select("host", "mark", F.explode("paths").alias("path"))
    found = paths.join(styles, ["host", "path"]).groupBy("mark").agg(F.collect_list("path").alias("paths"))
    return source.withColumn(mark, place).join(found.select(F.col("mark").alias(mark), F.col("paths").alias(gone)), mark, "left").drop(mark)
