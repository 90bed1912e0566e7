"""Main text of web pages by site style trees.

The trees of all pages of a host are merged: elements on the same path with the same tags,
classes and ids are one style node. For a node that m different pages of the host share,

* presentation importance is the entropy, to base m, of the child sequences seen under it;
* content importance is one minus the mean entropy of the text blocks in its branch, where
  a block found on c pages has entropy log c / log m. Text on every page counts 0, text on one 1.

A branch whose larger importance is under ``THRESHOLD`` is layout and is cut from every page of
the host. Exact copies of a page count as one page, so a copied article isn't taken for layout,
and on no page is a branch cut that holds most of its text. Paragraphs, headings and list items
without class or id inside an article are the author's text and are never cut.

Importance can't tell rotating adverts, menus or link lists from content, because their
wording differs from page to page. Elements whose tag, role, class or id declares such a part
are therefore left out as well, and where a page marks its article, the text is taken from it.
A form or a container of that name that holds most of the page's own text, links aside, is a
wrapper and stays; an article that is left out itself or stands in such a part isn't the page's.

Pages are read twice, once for the statistics and once for the text. Statistics are 64-bit
hashes, counted with map-side combine; the table that meets the pages again has one row per host
and holds node hashes only. It is joined with the pages on the left: Spark broadcasts it when it is
small, and otherwise splits hosts that hold many pages.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from gradeloom.llm.common import Scratch, hidden_id, shown_id

THRESHOLD = 0.2
MIN_PAGES = 5

# Element and class names with their usual meaning in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed "
                "noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr "
    "html legend li listing main menu nav ol optgroup option p plaintext pre search section "
    "select summary table tbody td tfoot th thead title tr ul".split())
NO_TEXT = frozenset("head script style textarea title noscript template iframe svg math xmp "
                    "noembed noframes object audio video canvas".split())
NOT_MAIN = frozenset("nav aside footer form fieldset button select option optgroup datalist "
                     "dialog menu search label input".split())
NOT_MAIN_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment "
    "comments consent cookie cookies disqus footer gdpr menu modal nav navbar navigation "
    "newsletter notice notices overlay pager pagination popup promo promos promotion related reply "
    "replies share sharing sidebar sidebars signup skip social sponsor sponsored subscribe "
    "subscription toolbar widget widgets".split())
# Tags that are never a wrapper of the page, and parts that may be longer than the story.
PARTS = frozenset("nav aside footer header button select option optgroup datalist dialog menu "
                  "search label input".split())
TALK_WORDS = frozenset("comment comments disqus reply replies related".split())
# Names that say how a wrapper looks, or which parts it goes with, declare nothing.
STATE = re.compile(r"(?:has|with|without|no)-\S*|\S*-(?:open|closed|enabled|disabled)", re.I)
HEADER_WORDS = frozenset("header masthead topbar".split())
NOT_MAIN_ROLES = frozenset("navigation banner complementary contentinfo search form dialog "
                           "alertdialog alert menu menubar toolbar status".split())
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd pre blockquote table tbody thead tfoot tr "
                  "td th figure figcaption hr br".split())
# An open element on the left ends where one on the right starts.
CLOSES = {**dict.fromkeys(BLOCK - {"body", "html", "head", "option", "optgroup"}, {"p"}),
          "li": {"p", "li"}, "dt": {"p", "dt", "dd"}, "dd": {"p", "dt", "dd"},
          "tr": {"p", "tr", "td", "th"}, "td": {"p", "td", "th"}, "th": {"p", "td", "th"},
          "tbody": {"p", "thead", "tbody", "tfoot", "tr", "td", "th"}, "option": {"option"},
          "body": {"head"}}
KEEPS_OPEN = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"},
              "td": {"table"}, "th": {"table"}, "tbody": {"table"}}

TAG = re.compile(
    r"<(?:!--(?:.*?)(?:-->|\Z)"
    r"|(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*|[^>]*)>"
    r"|[!?/][^>]*>)", re.S)
ATTRIBUTE = re.compile(
    r"(class|id|role|itemprop|hidden|aria-hidden|style)(?![-\w])(?:\s*=\s*"
    r"(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
DIGITS = re.compile(r"\d{3,}")


class Node:
    """One element. ``style`` is the hash of its path in the host's style tree."""

    __slots__ = ("tag", "parent", "children", "style", "attributed", "cut", "main", "wraps")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.children = tag, parent, []
        found = {}
        if attributes and attributes.strip("/ \n\t"):
            for name, a, b, c in ATTRIBUTE.findall(attributes):
                found.setdefault(name.lower(), html.unescape(a or b or c))
        names = f"{found.get('class', '')} {found.get('id', '')}"
        self.attributed = bool(names.strip())
        # Long numbers in names belong to a page, not to the style.
        look = f"{tag} {DIGITS.sub('#', ' '.join(sorted(names.split())))}"
        self.style = xxhash.xxh64_intdigest(look, parent.style if parent else 0)
        inside = parent is not None and parent.main
        role = found.get("role", "").lower()
        self.main = inside or tag in ("article", "main") or role in (
            "main", "article") or "articleBody" in found.get("itemprop", "")
        telling = " ".join(x for x in names.split() if not STATE.fullmatch(x))
        words = {w.lower() for w in NAME_WORDS.findall(telling)}
        if words and "comments" not in words and "no" in words:
            words = set()
        self.cut = tag in NO_TEXT or "hidden" in found or found.get("aria-hidden") == "true" or bool(
            HIDDEN_STYLE.search(found.get("style", "")))
        if tag not in ("html", "body", "main"):
            layout = tag in NOT_MAIN or role in NOT_MAIN_ROLES or bool(words & NOT_MAIN_WORDS)
            if not inside:
                layout = layout or tag == "header" or bool(words & HEADER_WORDS)
            # 2: left out by what it declares to be, unless the article turns out to be in it.
            self.cut = 1 if self.cut else 2 if layout else 0
        # What a cut element may be instead: 1 a wrapper of the page, 2 only if nothing else is left.
        self.wraps = 0
        if self.cut == 2 and tag not in PARTS and (role == "form" or role not in NOT_MAIN_ROLES):
            self.wraps = 2 if words & TALK_WORDS else 1


def parse(page: str) -> Node:
    """The element tree of a page; anything unclosed ends where HTML ends it."""
    top = at = Node("#", None)
    place, low = 0, None
    while True:
        m = TAG.search(page, place)
        text = page[place:m.start()] if m else page[place:]
        if text:
            at.children.append(text)
        if not m:
            return top
        place = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            node, crossed = at, False
            while node is not None and node.tag != tag:
                crossed = crossed or node.tag in BLOCK
                node = node.parent
            if node is not None and node.parent is not None and (tag in BLOCK or not crossed):
                at = node.parent
            continue
        closed = CLOSES.get(tag)
        if closed:
            stop = KEEPS_OPEN.get(tag, ())
            node, last = at, None
            while node.parent is not None and node.tag not in stop:
                if node.tag in closed:
                    last = node
                elif node.tag in BLOCK and node.tag not in closed:
                    break
                node = node.parent
            if last is not None:
                at = last.parent
        child = Node(tag, at, m.group(3))
        at.children.append(child)
        if tag in VOID:
            continue
        if tag in RAW and not m.group(3).rstrip().endswith("/"):
            if low is None:
                low = page.lower()
            # Lower-casing may change the length of a page; then search the page itself.
            if len(low) == len(page):
                end = low.find(f"</{tag}", place)
            else:
                hit = re.compile(f"</{tag}", re.I).search(page, place)
                end = hit.start() if hit else -1
            if end < 0:
                return top
            place = page.find(">", end) + 1 or len(page)
            continue
        at = child


def blocks(top: Node) -> list[tuple[Node, str]]:
    """Text blocks in page order with the element that each stands in."""
    out: list[tuple[Node, str]] = []
    buffer: list[str] = []
    owner = top

    def flush() -> None:
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text:
                out.append((owner, text))
            buffer.clear()

    todo: list = [(top, 0)]
    while todo:
        node, i = todo.pop()
        if i == 0 and node.tag in BLOCK:
            flush()
        while i < len(node.children):
            child = node.children[i]
            i += 1
            if isinstance(child, str):
                if not buffer:
                    owner = node
                buffer.append(child)
                continue
            if child.tag == "br":
                buffer.append(" ")
            if child.cut != 1:
                todo.append((node, i))
                todo.append((child, 0))
                break
            if child.tag in BLOCK:
                flush()
        else:
            if node.tag in BLOCK:
                flush()
    flush()
    return out


def _styled(node: Node) -> Node:
    """The nearest element at or above ``node`` that is a block: inline marks aren't layout."""
    while node.parent is not None and node.tag not in BLOCK and not node.attributed:
        node = node.parent
    return node


def _above(node: Node) -> Iterator[Node]:
    while node is not None and node.parent is not None:
        yield node
        node = node.parent


def _spared(found: list[tuple[Node, str]]) -> set[int]:
    """Ids of declared elements that wrap the page: they hold most of what is left to it."""
    # Text by the innermost cut element around it; links are menus more often than text.
    held: Counter[int] = Counter()
    above: dict[int, list[int]] = {0: []}
    nodes: dict[int, Node] = {}
    for node, text in found:
        up = list(_above(node))
        cuts = [n for n in up if n.cut]
        for i, n in enumerate(cuts):
            if id(n) not in nodes:
                nodes[id(n)] = n
                above[id(n)] = [id(x) for x in cuts[i + 1:]] + [0]
        if not any(n.tag == "a" for n in up):
            held[id(cuts[0]) if cuts else 0] += len(text)
    depth = {k: len(x) for k, x in above.items()}
    spared: set[int] = set()
    for last in (1, 2):
        for k in sorted(nodes, key=lambda k: (-depth[k], -held[k])):
            if nodes[k].wraps != last:
                continue
            # The rest of the page is what no cut takes that does not take this element as well.
            rest = sum(held[x] for x in above[k])
            if held[k] > rest if last == 1 else held[k] and not rest:
                spared.add(k)
                held[next(x for x in above[k] if x not in spared)] += held.pop(k)
    return spared


def _declared(found: list[tuple[Node, str]]) -> list[tuple[Node, str]]:
    """Blocks that no element above declares to be something else than main text."""
    outer = {id(n): n for node, _ in found if node.main for n in _above(node)
             if n.main and not n.parent.main}
    spared = _spared(found) if any(n.wraps for node, _ in found for n in _above(node)) else set()
    # Articles that are comments or teasers are not the page's.
    clear = [n for n in outer.values()
             if not any(up.cut and id(up) not in spared for up in _above(n))]
    holders = {id(up) for n in clear for up in _above(n)}
    in_main = bool(holders)
    out = []
    for node, text in found:
        if in_main and not any(n.main and id(n) in holders for n in _above(node)):
            continue
        if any(n.cut and id(n) not in holders and id(n) not in spared for n in _above(node)):
            continue
        out.append((node, text))
    return out


def main_text(page: str | None, low: frozenset[int] = frozenset()) -> str:
    """Text of one page; ``low`` are the host's style nodes of low importance."""
    if not page:
        return ""
    found = _declared(blocks(parse(page)))
    if low:
        whole = sum(len(text) for _, text in found)
        held: Counter[int] = Counter()
        for node, text in found:
            for n in _above(node):
                if n.style in low:
                    held[n.style] += len(text)
        cut = {style for style, size in held.items() if 2 * size <= whole}
        found = [(node, text) for node, text in found if not any(
            n.style in cut and not (n.main and n.tag in PLAIN and not n.attributed)
            for n in _above(node))]
    return "\n".join(text for _, text in found)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _observations(page: str | None) -> set[tuple[int, int, int]]:
    """(node, kind, value): kind 0 the page has the node, 1 child sequence, 2 text block."""
    if not page:
        return set()
    top = parse(page)
    seen: set[tuple[int, int, int]] = set()
    todo = [top]
    while todo:
        node = todo.pop()
        below = [c for c in node.children if not isinstance(c, str) and c.cut != 1]
        todo.extend(below)
        if node.parent is not None and (node.tag in BLOCK or node.attributed):
            seen.add((node.style, 0, 0))
            runs = [c.style for i, c in enumerate(below)
                    if not i or below[i - 1].style != c.style]
            seen.add((node.style, 1, xxhash.xxh64_intdigest(np.array(runs, np.uint64).tobytes())))
    for node, text in blocks(top):
        value = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
        # A branch is judged by all text in it, up to where the page's own frame begins.
        for n in _above(_styled(node)):
            if n.tag in ("html", "body", "article", "main"):
                break
            if n.tag in BLOCK or n.attributed:
                seen.add((n.style, 2, value))
    return {(_signed(n), k, _signed(v)) for n, k, v in seen}


def low_nodes(pages: DataFrame, threshold: float = THRESHOLD,
              min_pages: int = MIN_PAGES) -> DataFrame:
    """site (hash of the host), low (its style nodes of low importance)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(site, page, n, k, v) for site, page, text in zip(b["site"], b["copy"], b["html"])
                    for n, k, v in _observations(text)]
            yield pd.DataFrame(rows, columns=["site", "copy", "node", "kind", "value"])

    seen = pages.select("site", F.xxhash64("html").alias("copy"), "html").mapInPandas(
        run, "site bigint, copy bigint, node bigint, kind int, value bigint")
    # Distinct first: copies of a page, wherever they are, count as one page.
    counts = seen.groupBy("site", "node", "kind", "value", "copy").agg(F.lit(1).alias("one")) \
        .groupBy("site", "node", "kind", "value").agg(F.count(F.lit(1)).alias("c"))
    is_ = {k: F.col("kind") == k for k in range(3)}
    c = F.col("c").cast("double")
    nodes = counts.groupBy("site", "node").agg(
        F.max(F.when(is_[0], c)).alias("m"),
        F.sum(F.when(is_[1], c)).alias("n"),
        F.sum(F.when(is_[1], c * F.ln(c))).alias("nlog"),
        F.count(F.when(is_[2], 1)).alias("texts"),
        F.sum(F.when(is_[2], F.ln(c))).alias("log"))
    base = F.ln("m")
    presentation = (F.ln("n") - F.col("nlog") / F.col("n")) / base
    content = F.lit(1.0) - F.col("log") / F.col("texts") / base
    return nodes.where(f"m >= {min_pages} and texts > 0").where(
        F.greatest(presentation, content) < threshold
    ).groupBy("site").agg(F.collect_set("node").alias("low"))


def extract_text(pages: DataFrame, threshold: float = THRESHOLD,
                 min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points).

    Null and empty pages, and pages without main text, give an empty text. Ids and urls may be
    null or repeat; pages without a host share one style tree. A host with fewer than
    ``min_pages`` different pages has no style evidence, so nothing is cut by importance. Other
    columns are ignored; an empty table gives an empty table.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^/]*//([^/?#]*)", 1))
    rows = pages.select("page_id", "url", "html", F.xxhash64(host).alias("site"))
    low = Scratch(pages.sparkSession, "styles").write(low_nodes(rows, threshold, min_pages), "low")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [main_text(page, frozenset(int(n) & (2**64 - 1) for n in nodes)
                               if nodes is not None else frozenset())
                     for page, nodes in zip(b["html"], b["low"])]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts,
                                "n_chars": [len(t) for t in texts]})

    return rows.join(low, "site", "left").select(
        shown_id("page_id"), "url", "html", "low").mapInPandas(
        run, "page_id bigint, url string, text string, n_chars bigint"
    ).withColumn("page_id", hidden_id("page_id"))
