"""Main text of web pages by consensus host paths.

Every page's containers are scored by the text they hold. Pages vote, in Spark, on their host's generalised tag-class paths with
their scores' shares; digits in class names are generalised, so that numbered templates vote together. Each page is then read again
with its host's winning paths in order: the first that stands in the page and holds text gives the article. A page in which none of
them does falls back on its own best container. Single pages that look odd are so overruled by the pages they share a template with.
The path that won names a place in the article, not its limits: it is widened to the article or main element around it, or else to
the largest element below the body whose further blocks are not links for the most part, and to elements beside that one in the body
that hold a PART of its text and more. A path is kept as a hash of its parent's and its own label, so a page's memory is in proportion
to its elements however deep they are nested.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import arrow_map, bounded, clashing, written

#: Paths a page votes for, and paths a host's pages are read with.
VOTES = 3
PATHS = 3
#: Share of the winning element's text from which an element beside it is a part of the article.
PART = 0.25

BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article body center div main section td".split())
#: Their content is text that no parser looks into for tags.
RAW = frozenset("script style noscript template textarea title iframe svg select noembed xmp".split())
NEVER = frozenset("nav header footer aside form menu dialog button".split())
VOID = frozenset(("hr", "br", "img", "input", "meta", "link", "wbr", "source", "col", "base", "area", "embed", "track"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class and id names that mark what is not the article, headings aside; those that mark it only outside an article element.
ASIDE = frozenset(
    "ad ads advert adverts advertisement advertising advertorial banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus gdpr login menu menus modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promos promotion recommended related reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
OUTSIDE = frozenset("disclaimer footer header masthead".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert form toolbar".split())

#: A tag; within it a quote opens a value only right after "=".
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:"[^"]*"|'[^']*')|[^>])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PIECES = re.compile(r"[A-Za-z]+")


class Node:
    """An element: its label path as a hash, the elements above it, the nearest container and article or main at or above it."""

    __slots__ = ("above", "article", "box", "kept", "path", "tag")

    def __init__(self, tag: str, path: str, above: int, kept: bool, box: int, article: int):
        self.tag, self.path, self.above, self.kept, self.box, self.article = tag, path, above, kept, box, article


def _marks(tag: str, attributes: str, inside: bool) -> tuple[str, bool]:
    """Generalised name of an element, and whether its attributes say that it is not the article (`inside` an article or main)."""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return tag, False
    found = {}
    for name, a, b, c in NAMED.findall(attributes):
        found.setdefault(name.lower(), a or b or c)
    classes = sorted(set(re.sub(r"\d+", "#", found.get("class", "")).split()))
    name = ".".join([tag, *classes])
    said = {w.lower() for w in PIECES.findall(f"{found.get('class', '')} {found.get('id', '')}")}
    marks = frozenset() if tag in HEADINGS else ASIDE if inside else ASIDE | OUTSIDE
    odd = bool(said & marks) and not said & {"with", "has", "no", "without"}
    odd |= found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    return name, odd and tag not in ("html", "body", "main", "article")


def parse(html: str) -> tuple[list[Node], list[tuple[int, str, float]]]:
    """Elements with blocks of text, and the blocks in page order: (element, text, share of it outside links)."""
    nodes = [Node("", "", -1, True, 0, 0)]
    stack = [0]
    opened: dict[str, int] = {}  # open elements by tag: an end tag of none needs no search
    blocks: list[tuple[int, str, float]] = []
    text: list[str] = []
    linked, in_link, at, end = 0, False, 0, len(html)

    def cut(k: int) -> None:
        for x in stack[k:]:
            opened[nodes[x].tag] -= 1
        del stack[k:]

    def close() -> None:
        nonlocal linked
        if text:
            joined = " ".join(unescape("".join(text)).split())
            if joined and nodes[stack[-1]].kept:
                blocks.append((stack[-1], joined, max(0.0, 1 - linked / len(joined))))
            text.clear()
        linked = 0

    while at < end:
        m = TAG.search(html, at)
        if m is None:
            text.append(html[at:])
            break
        start = m.start()
        if start > at:
            text.append(html[at:start])
            if in_link:
                linked += start - at
        at = m.end()
        slash, name, attributes = m[1], m[2], m[3]
        if name is None:
            if html.startswith("<![CDATA[", start):
                text.append(html[start + 9 : at - 3 if html.endswith("]]>", 0, at) else at].replace("&", "&amp;"))
            continue
        tag = name.lower()
        if tag == "a":
            in_link = not slash
        elif tag == "br":
            text.append(" ")
        elif tag in RAW:
            if not slash and not attributes.endswith("/"):
                stop = re.compile(f"</{tag}\\s*>", re.I).search(html, at)
                at = stop.end() if stop else end
            text.append(" ")
        elif tag in BLOCKS or tag == "button":
            close()
            in_link = False
            if slash:
                if not opened.get(tag) or (tag == "p" and nodes[stack[-1]].tag != "p"):
                    continue
                for k in range(len(stack) - 1, 0, -1):
                    if nodes[stack[k]].tag == tag:
                        cut(k)
                        break
                    if nodes[stack[k]].tag in ("article", "main", "body") and tag not in ("article", "main", "body", "html"):
                        break  # a stray end tag does not leave the article
                continue
            if tag in VOID:
                continue
            top = nodes[stack[-1]].tag
            if top == "p" or (top == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option")):
                cut(len(stack) - 1)
            if tag in ("article", "main", "footer") and any(map(opened.get, ("nav", "header", "ul", "menu"))):  # what a menu or header left open ends here
                for k in range(1, len(stack)):
                    if nodes[stack[k]].tag in ("nav", "header", "ul", "menu"):
                        cut(k)
                        break
            above, new = nodes[stack[-1]], len(nodes)
            label, odd = _marks(tag, attributes, above.article > 0)
            path = xxhash.xxh64_hexdigest(f"{above.path}>{label}")
            nodes.append(Node(tag, path, stack[-1], above.kept and tag not in NEVER and not odd, new if tag in CONTAINERS else above.box, new if tag in ("article", "main") else above.article))
            stack.append(new)
            opened[tag] = opened.get(tag, 0) + 1
    close()
    return nodes, blocks


def scored(nodes: list[Node], blocks: list[tuple[int, str, float]]) -> dict[str, float]:
    """path -> score of the page's containers: a block counts fully for the nearest one and less for each of the next ones above."""
    found: dict[str, float] = {}
    for at, text, free in blocks:
        weight, k = len(text) * free * free, nodes[at].box
        for _ in range(8):
            if k == 0 or weight == 0:
                break
            node = nodes[k]
            found[node.path] = found.get(node.path, 0.0) + weight * (1.5 if node.tag in ("article", "main") else 1.0)
            weight *= 0.4
            k = nodes[node.above].box
    return found


def best(found: dict[str, float], n: int = VOTES) -> list[tuple[str, float]]:
    return sorted(found.items(), key=lambda x: (-x[1], x[0]))[:n]


def widened(nodes: list[Node], blocks: list[tuple[int, str, float]], path: str) -> set[int]:
    """Elements that hold the whole article of which the elements of this path are parts."""
    links, chars = [0] * len(nodes), [0] * len(nodes)  # in an element: blocks that are links for the most part, characters of others
    for at, text, free in blocks:
        links[at] += free < 0.5
        chars[at] += len(text) if free >= 0.5 else 0
    for k in range(len(nodes) - 1, 0, -1):
        links[nodes[k].above] += links[k]
        chars[nodes[k].above] += chars[k]
    page = ("", "body", "html")
    top = list(range(len(nodes)))  # the largest element around each whose further blocks are no links
    for k in range(1, len(nodes)):
        above = nodes[k].above
        if nodes[above].tag not in page and links[above] == links[k]:
            top[k] = top[above]
    tops = {nodes[k].article or top[k] for k in range(1, len(nodes)) if nodes[k].path == path}
    if not any(nodes[k].article for k in tops):
        least = PART * sum(chars[k] for k in tops)
        beside = {nodes[k].above for k in tops if nodes[nodes[k].above].tag in page}
        tops |= {k for k in range(1, len(nodes)) if nodes[k].above in beside and nodes[k].tag in CONTAINERS and nodes[k].tag not in page and links[k] == 0 and chars[k] >= least}
    return tops


def _inside(nodes: list[Node], tops: set[int]) -> list[bool]:
    inside = [k in tops for k in range(len(nodes))]
    for k in range(1, len(nodes)):  # elements stand after those above them
        inside[k] = inside[k] or inside[nodes[k].above]
    return inside


def article(html: str, paths: list[str]) -> str:
    nodes, blocks = parse(html)
    own = [p for p, _ in best(scored(nodes, blocks), 1)]
    for path in [*paths, *own]:
        inside = _inside(nodes, {k for k in range(1, len(nodes)) if nodes[k].path == path})
        if any(inside[at] for at, _, _ in blocks):
            inside = _inside(nodes, widened(nodes, blocks, path))
            return "\n".join(text for at, text, _ in blocks if inside[at])
    return "\n".join(text for _, text, _ in blocks)


def host(url: str = "url"):
    return F.coalesce(F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))


def paths(pages: DataFrame, n: int = PATHS) -> DataFrame:
    """(host, paths array<string>): each host's winning paths, best first."""

    def votes(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for name, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            top = best(scored(*parse(html.as_py() or "")))
            total = sum(s for _, s in top)
            rows += [(name, p, s / total) for p, s in top if total]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.string(), pa.string(), pa.float64()), strict=True)], names=["host", "path", "share"])

    cast = arrow_map(pages.select(host().alias("host"), "html"), votes, "host string, path string, share double")
    summed = cast.groupBy("host", "path").agg(F.round(F.sum("share"), 6).alias("votes"))
    ranked = summed.withColumn("place", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path"))).where(F.col("place") <= n)
    return ranked.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]).alias("paths"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text): the article of every page.

    Null and empty html gives an empty text; a null or odd url belongs to the host ""; repeated rows are read each; of paths with equal
    votes the one with the smaller hash comes first; an empty table gives no rows; further columns are ignored. The host table is written first, so that its size is known: Spark sends it to all tasks
    if it is under its broadcast threshold and joins by host otherwise.
    """
    pages = clashing(pages, "page_id", "url", "html")
    won = written(paths(pages), "host-paths").select(F.col("host").alias("__host"), F.col("paths").alias("__paths"))

    bounded(pages.sparkSession)

    @F.arrow_udf("string")
    def read(htmls: pa.Array, tried: pa.Array) -> pa.Array:
        return pa.array([article(h.as_py() or "", t.as_py() or []) for h, t in zip(htmls, tried, strict=True)], pa.string())

    both = pages.withColumn("__at", host()).join(won, F.col("__at") == F.col("__host"), "left")
    return both.select("page_id", "url", read("html", "__paths").alias("text"))


def op1_extract(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.char_length("text").cast("long"))
