"""Main text of web pages by tag-path ratios.

A page is cut into blocks, each with the path of block elements from the root to it. For each path the length of text, the
punctuation and the text of links are summed over its blocks; their ratios to the number of blocks are smoothed over paths
that lie close together (the distance of two paths is that of their ends in the tree of paths), and fused into one score.
Paths from a share of the best score up are content, and so is what lies with them in the innermost element that holds
them, so that short headings and lists of an article stay. What elements say of themselves counts before that: menus, page
headers, footers, sidebars, notices, adverts, forms and comments, by tag, role and class, have no part in any ratio, and an
article or main element bounds the search.

Each page is judged by itself, in one pass without a shuffle.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from subgrade.llm.common import blocks as runs, map_batches, table

#: Width of the smoothing in steps between paths; share of the best score from which a path is content; share of links from
#: which a block within the content's element is none.
WIDTH, SHARE, LINKED = 1.0, 0.25, 0.6
PUNCTUATION = re.compile(r"[.,;:!?…、。，；：！？]")

# HTML's elements by kind, and words by which pages name what is not their article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table
    tbody td tfoot th thead title tr ul""".split()
)
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
NEVER = frozenset("head script style title noscript template iframe object svg canvas audio video nav aside footer form button select textarea dialog menu datalist map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist status".split())
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond discussion reactions feedback".split())
OTHER = frozenset(
    """nav navbar navigation menu submenu breadcrumb breadcrumbs header masthead topbar banner footer bottombar sidebar aside rail
    widget widgets ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion cookie
    cookies consent gdpr notice notices alert newsletter subscribe subscription signup popup modal overlay paywall related
    recommended recommendations teaser share sharing social follow pagination pager login search form copyright legal""".split()
)
LIFTS = frozenset("has no with without".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "optgroup": {"option", "optgroup"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
#: Elements that an implied end tag does not reach beyond.
SCOPES = frozenset("table ul ol dl menu select td th body article section aside nav footer header main div blockquote form".split())
#: Elements that an end tag does not reach beyond.
CELLS = frozenset("table td th caption".split())
# End of the fixed values.

_MARKUP = re.compile(
    r"""<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|/?[a-zA-Z][^>]*\Z)"""
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Block(NamedTuple):
    """A run of text in one block element. links: characters of it within links; scope: 2 in an article, 1 in a main
    element; out: it says of itself that it is not the article's."""

    path: tuple[str, ...]
    text: str
    links: int
    scope: int
    out: bool


class _Element:
    __slots__ = ("comment", "name", "out", "scope", "soft", "step")

    def __init__(self, name: str, step: str, out: bool, soft: bool, comment: bool, scope: int):
        self.name, self.step, self.out, self.soft, self.comment, self.scope = name, step, out, soft, comment, scope


def _words(names: str) -> tuple[set[str], bool]:
    """Words of classes and ids; words after has-, no- and the like don't count."""
    found: set[str] = set()
    for name in names.split():
        parts = [w.lower() for w in _WORD.findall(name)]
        found.update(w for i, w in enumerate(parts) if not (i and parts[i - 1] in LIFTS))
    return found, bool(found & COMMENTS)


def _element(name: str, attributes: str, up: _Element) -> _Element:
    values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes.strip(" /") else {}
    names = f"{values.get('id', '')} {values.get('class', '')}"
    words, comment = _words(names) if names.strip() else (set(), False)
    role = values.get("role", "").lower()
    step = name + ("." + ".".join(sorted(words)) if words else "")
    main = name in ("article", "main") or role in ("main", "article")
    out = up.out or name in NEVER or role in ROLES or "hidden" in values or values.get("aria-hidden") == "true" or bool(_HIDDEN.search(values.get("style", "")))
    comment = up.comment or (comment and name not in ("html", "body"))
    if main:
        # an article within something that merely sounds like a sidebar lifts that, but is itself no comment
        soft, scope = False, max(up.scope, 1 if name == "main" or role == "main" else 2)
    else:
        soft = up.soft or (name not in ("html", "body") and (bool(words & OTHER) or name == "header"))
        scope = up.scope
    return _Element(name, step, out, soft, comment, scope)


def page_blocks(source: str) -> list[Block]:
    """The blocks of a page in order. Character references are decoded, white space is one space. Malformed markup is read
    as browsers do where it matters: implied ends, unmatched ends, unclosed inline elements, cut pages."""
    out: list[Block] = []
    stack = [_Element("", "", False, False, False, 0)]
    texts: list[str] = []
    links = 0
    in_link = 0

    def flush() -> None:
        nonlocal links
        if texts:
            text = " ".join(html.unescape("".join(texts)).split())
            if text:
                top = _block(stack)
                heading = top.name in ("h1", "h2", "h3") and _in_article_header(stack)
                gone = top.out or top.comment or (top.soft and not heading)
                out.append(Block(tuple(e.step for e in stack[1:] if e.name in BLOCK), text, min(links, len(text)), top.scope, gone))
            texts.clear()
        links = 0

    def say(text: str) -> None:
        nonlocal links
        if text:
            top, block = stack[-1], _block(stack)
            # what is out within a block is an inline advert, a button and the like
            if (top.out, top.comment, top.soft) == (block.out, block.comment, block.soft):
                texts.append(text)
                if in_link:
                    links += len(text)

    def close(k: int) -> None:
        nonlocal in_link
        if any(e.name in BLOCK for e in stack[k:]):
            flush()
        in_link = max(0, in_link - sum(e.name == "a" for e in stack[k:]))
        del stack[k:]

    at, n = 0, len(source)
    while at < n:
        m = _MARKUP.search(source, at)
        if not m:
            say(source[at:])
            break
        say(source[at : m.start()])
        at = m.end()
        if m[1]:
            end = source.find("-->", m.end() - 2)
            at = n if end < 0 else end + 3
            continue
        if m[2]:
            end = source.find(">", at)
            at = n if end < 0 else end + 1
            continue
        ends, name, attributes = (m[3], m[4], m[5]) if m[4] else (m[6], m[7], m[8])
        if not name:
            break  # a tag that the page's end cuts
        name = name.lower()
        if ends:
            for k in range(len(stack) - 1, 0, -1):
                e = stack[k].name
                if e == name:
                    close(k)
                    break
                if e in CELLS or (e in BLOCK and name not in BLOCK):
                    break
            continue
        if name == "br":
            say(" ")
            continue
        if name in BLOCK:
            flush()
            if name != "hr":
                goes = CLOSES.get(name, ())
                for k in range(len(stack) - 1, 0, -1):
                    e = stack[k].name
                    if e in goes:
                        lowest = k
                        while lowest > 1 and stack[lowest - 1].name in goes:
                            lowest -= 1
                        close(lowest)
                        break
                    if e == "p":
                        close(k)
                        break
                    if e in SCOPES:
                        break
        if name in VOID:
            continue
        if name == "a" and in_link and stack[-1].name == "a":
            close(len(stack) - 1)
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(source, at)
            at = end.end() if end else n
            continue
        if attributes.rstrip().endswith("/") and name not in BLOCK:
            continue
        stack.append(_element(name, attributes, stack[-1]))
        in_link += name == "a"
    flush()
    return out


def _block(stack: list[_Element]) -> _Element:
    return next((e for e in reversed(stack) if e.name in BLOCK), stack[0])


def _in_article_header(stack: list[_Element]) -> bool:
    """Whether what sounds like no article begins within one, as its own header, whose headings are the article's."""
    inside = False
    for e in stack[1:]:
        inside = inside or e.scope == 2
        if e.soft:
            return inside and (e.name == "header" or "header" in e.step)
    return False


def _distance(a: tuple[str, ...], b: tuple[str, ...]) -> int:
    common = 0
    for x, y in zip(a, b):
        if x != y:
            break
        common += 1
    return len(a) + len(b) - 2 * common


def path_scores(found: list[Block]) -> dict[tuple[str, ...], float]:
    """The fused score of each path: smoothed text length a block, raised by smoothed punctuation a block, less its links."""
    sums: dict[tuple[str, ...], list[float]] = {}
    for b in found:
        s = sums.setdefault(b.path, [0, 0, 0, 0])
        s[0] += 1
        s[1] += len(b.text)
        s[2] += len(PUNCTUATION.findall(b.text))
        s[3] += b.links
    weight = [math.exp(-(d * d) / (2 * WIDTH * WIDTH)) for d in range(8)]
    scores = {}
    for p, own in sums.items():
        blocks, length, points = 0.0, 0.0, 0.0
        for q, s in sums.items():
            d = _distance(p, q)
            if d < len(weight):
                w = weight[d]
                free = 1 - s[3] / s[1]
                blocks, length, points = blocks + w * s[0], length + w * s[1] * free, points + w * s[2] * free
        scores[p] = length / blocks * math.log1p(1 + points / blocks) * (1 - own[3] / own[1])
    return scores


def content_blocks(found: list[Block]) -> list[Block]:
    """Those of a page's blocks that are its main text."""
    inside = [b for b in found if not b.out]
    best_scope = max((b.scope for b in inside), default=0)
    inside = [b for b in inside if b.scope == best_scope]
    if not inside:
        return []
    scores = path_scores(inside)
    most = max(scores.values())
    if most <= 0:
        return []
    chosen = {p for p, s in scores.items() if s >= SHARE * most}
    # the innermost element that holds all content; what is in it stays, if it isn't the whole page
    holder = min(chosen, key=len)
    for p in chosen:
        k = 0
        while k < min(len(p), len(holder)) and p[k] == holder[k]:
            k += 1
        holder = holder[:k]
    if len(chosen) == 1 and len(holder) > 1:
        holder = holder[:-1]
    whole = best_scope == 0 and all(re.match(r"(html|body)\b", step) for step in holder)
    return [b for b in inside if b.path in chosen or not whole and b.path[: len(holder)] == holder and b.links < LINKED * len(b.text)]


def main_text(source: str | None) -> str:
    return "\n".join(b.text for b in content_blocks(page_blocks(source or "")))


RESULT = "page_id long, url string, text string, n_chars long"


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, the main text of html, and its code points, one row for each row of pages; other columns are not read.

    Blocks are in page order, joined by one line feed. Null and empty pages, and pages of links only, have an empty text;
    pages of any length are read whole; repeated rows, null ids and null urls stay as they are; paths of one score are both
    chosen or both not; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sources in runs(batch, 2):
                texts = [main_text(s) for s in sources]
                columns = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return map_batches(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")), run, RESULT)


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_main_text(table(spark, sf_dir, "pages"))
