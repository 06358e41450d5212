"""Main text of web pages by tag-path ratios.

A page is read into its text nodes, each with the path of tags from the root to it. Per page:

1. for every path, characters and punctuation marks are aggregated over its nodes and divided
   by their number: two ratios per path;
2. along the page, each ratio is smoothed over neighbouring nodes, so that a short paragraph
   inside the article is carried by its neighbours and a long line among links is not;
3. the two are fused by their product, averaged per path, and paths above a share of the
   page's spread are content;
4. the blocks below the smallest element that holds most of the content's text are the
   article, as far as their path names no menu, header, footer, sidebar, notice, advert, form,
   script, style or comment part; ``article`` and ``main`` are preferred as that element.

Character references are decoded, white space in a block becomes one space, blocks are joined
in page order by one space. A null or empty page gives an empty text. Malformed markup never
fails: unclosed paragraphs and list items end where HTML lets them end, stray end tags are
ignored, and text after the end of the page counts like any other.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMOOTH = (0.25, 0.5, 0.25)
THRESHOLD = 0.3

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th "
                   "thead tr ul".split())
ENDS_PARAGRAPH = BLOCKS - frozenset("body caption html option tbody td tfoot th thead tr".split())
ENDS_SAME = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"),
             "th": ("td", "th"), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
SCOPES = frozenset("ul ol dl table select article section div aside nav body html main menu".split())

# Elements and names of parts that are not the article.
OUTSIDE_TAGS = frozenset("nav header footer aside form button select textarea script style head title noscript template iframe svg canvas menu "
                         "dialog label input object audio video noembed noframes xmp".split())
OUTSIDE_NAMES = frozenset("ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments commentlist cookie "
                          "cookies consent disqus disclaimer footer form gdpr header login masthead menu modal nav navbar navigation newsletter "
                          "notice notices notification pagination pager popup promo promoted recommended related replies reply respond search share "
                          "sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
WHOLE_TAGS = ("article", "main")

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                  r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PARTS = re.compile(r"[a-z]+")
_MARKS = re.compile(r"[.,;:!?…。、，；：！？¿¡]")


def _outside(tag: str, attributes: str) -> bool:
    """Whether an element is one of the parts that are not the article."""
    if tag in OUTSIDE_TAGS:
        return True
    for name, *values in _NAMED.findall(attributes) if attributes else ():
        name, value = name.lower(), "".join(values).lower()
        if name == "role" and value.strip() in OUTSIDE_ROLES:
            return True
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return True
        if name in ("class", "id") and tag not in ("html", "body", *WHOLE_TAGS) and any(
                w in OUTSIDE_NAMES for w in _PARTS.findall(value)):
            return True
    return False


class _Node:
    """An open element: its tag, its place in the path and whether it, or an element around it, is outside."""

    __slots__ = ("tag", "path", "number", "outside")

    def __init__(self, tag, path, number, outside):
        self.tag, self.path, self.number, self.outside = tag, path, number, outside


def text_nodes(page: str):
    """``(path, ancestors' numbers, outside, block number, text)`` of the text nodes, and element tags by number.

    Text of one block is to be joined without a space; a line break is white space."""
    stack = [_Node("", "", 0, False)]
    tags = {0: ""}
    nodes, block, number, at = [], 0, 0, 0

    def add(text):
        if text:
            nodes.append((stack[-1].path, tuple(n.number for n in stack), stack[-1].outside, block, entities.unescape(text)))

    def close(names, scopes=SCOPES):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                del stack[i:]
                return True
            if stack[i].tag in scopes:
                return False
        return False

    size = len(page)
    while at < size:
        found = _TAG.search(page, at)
        if found is None:
            add(page[at:])
            break
        add(page[at:found.start()])
        at = found.end()
        tag = found.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCKS:
            block += 1
        if found.group(1):
            close((tag,), frozenset() if tag in BLOCKS else SCOPES)
            continue
        if tag == "br":
            add(" ")
        if tag in VOID:
            continue
        if tag in ENDS_PARAGRAPH:
            close(("p",), frozenset("table td th button".split()))
        if tag in ENDS_SAME:
            while close(ENDS_SAME[tag], SCOPES - {"div"} if tag == "li" else SCOPES):
                pass
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and stack[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            stack.pop()
        attributes = found.group(3)
        outside = stack[-1].outside or _outside(tag, attributes)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if attributes.rstrip().endswith("/") and tag not in BLOCKS:
            continue
        number += 1
        tags[number] = tag
        stack.append(_Node(tag, f"{stack[-1].path}/{tag}", number, outside))
    return nodes, tags


def _smoothed(values):
    if len(values) < 3:
        return values
    padded = np.concatenate([values[:1], values, values[-1:]])
    return SMOOTH[0] * padded[:-2] + SMOOTH[1] * padded[1:-1] + SMOOTH[2] * padded[2:]


def content_paths(nodes) -> set[str]:
    """The tag paths whose fused ratio passes the threshold."""
    paths = sorted({n[0] for n in nodes})
    index = {p: i for i, p in enumerate(paths)}
    of = np.array([index[n[0]] for n in nodes])
    length = np.array([len(n[4].strip()) for n in nodes], float)
    marks = np.array([len(_MARKS.findall(n[4])) for n in nodes], float)
    count = np.bincount(of)
    fused = np.ones(len(nodes))
    for values in (length, marks + 0.5):
        ratio = np.bincount(of, values) / count
        fused *= _smoothed(ratio[of])
    share = np.sqrt(np.bincount(of, fused) / count)
    return {p for p, s in zip(paths, share) if s >= THRESHOLD * share.max()}


def main_text(page: str | None) -> str:
    if not page:
        return ""
    nodes, tags = text_nodes(page)
    inside = [n for n in nodes if not n[2]]
    filled = [n for n in inside if n[4].strip()]
    if not filled:
        return ""
    chosen = content_paths(filled)
    core = [n for n in filled if n[0] in chosen]
    weight: dict = {}
    for _, above, _, _, text in core:
        for element in above:
            weight[element] = weight.get(element, 0) + len(text)
    total = sum(len(n[4]) for n in core)
    whole = [e for e in weight if tags[e] in WHOLE_TAGS and 2 * weight[e] >= total]
    if not whole:
        whole = [e for e in weight if 10 * weight[e] >= 9 * total]
    root = max(whole)  # elements are numbered in page order: the innermost
    if tags[root] not in WHOLE_TAGS and tags[root] in ("p", "b", "i", "em", "strong", "span", "a", "li", "td", "pre"):
        siblings = [n[1] for n in core]
        depth = next(a.index(root) for a in siblings if root in a)
        root = next(a for a in siblings if root in a)[max(depth - 1, 0)]
    out, last, held = [], None, []
    for _, above, _, block, text in inside:
        if root not in above:
            continue
        if block != last:
            out.append("".join(held))
            held, last = [], block
        held.append(text)
    out.append("".join(held))
    return " ".join(" ".join(out).split())


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page; other columns are ignored."""

    @F.pandas_udf("string")
    def text_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([main_text(p) for p in part], dtype=object)

    found = pages.select("page_id", "url", text_of(F.col("html").cast("string")).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
