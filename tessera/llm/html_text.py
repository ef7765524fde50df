"""Main text of web pages by tree scoring.

The html is read into a tree of containers and blocks of text. Menus, headers, footers, forms and the like are left out, and so is what
its class or id names as such. Each paragraph has points for its length and its commas; they pass to its parent in
full and, halved at each step, to further ancestors, and a container's points are discounted by the share of its
text that stands in links. The best container is kept with its siblings that have enough points of their own; an article around it
is preferred to a part of it. Where nothing is marked as the article, parts beside the container and beside those around it are kept by their own
text: long text with few links, whole sentences, headings of what follows, and what stands between kept parts. The text is that of the blocks in page order.

Pages are judged row by row: there is no shuffle and nothing to skew. Letters, links and points are summed up once, from the leaves up, so a page takes time
in proportion to its length, however deep or broken it is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, small_batches, text_or_empty

_START = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_END = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Kinds of elements, after the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
LEFT_OUT = frozenset("head nav header footer aside form button select option label fieldset dialog menu svg canvas object applet audio video map math".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th caption figcaption address summary div section article main body html ul ol dl table tbody thead tfoot tr figure details center hgroup search".split())
#: Elements that a start tag of the key closes, up to a border.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Start tags that end an open paragraph.
ENDS_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"} | {"hr", "form", "nav", "header", "footer", "aside", "fieldset", "menu"}
#: Words in a class or id, between marks, that name what is no part of an article.
NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promotion promoted menu nav navbar navigation breadcrumb breadcrumbs pagination pager "
    "header masthead footer sidebar sidebars aside widget widgets comment comments commentlist disqus respond replies reply discussion cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations trending popular toolbar tags copyright legal disclaimer paywall skip "
    "hidden outbrain taboola".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
#: A class or id with one of these words is kept whatever other words it has.
KEPT = frozenset("article content main body post entry story text".split())
LEAST_SIBLING = 0.2
#: Beside the best container, text of so many letters is part of the article if a smaller share than this stands in links.
LONG_TEXT = 80
LEAST_LINKS = 0.25
#: A list or container of so many links with so large a share of its text in them is a menu.
MENU_TAGS = frozenset("ul ol dl table div section p".split())
MENU_LINKS = 3
MENU_SHARE = 0.9


class Node:
    __slots__ = ("tag", "parent", "main", "out", "parts", "children", "link", "points", "letters", "linked", "links")

    def __init__(self, tag: str, parent: Node | None, out: bool, main: bool, link: bool):
        self.tag, self.parent, self.out, self.main, self.link = tag, parent, out, main, link
        self.parts: list = []  # text and child elements in page order
        self.children: list[Node] = []
        self.points = 0.0
        self.letters = self.linked = self.links = 0  # letters of text below it, those in links, and links


def _left_out(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is left out, and whether it names itself the main part."""
    if tag in LEFT_OUT:
        return True, False
    if not attributes.strip():
        return False, tag in ("article", "main")
    values = {}
    for m in _ATTRIBUTE.finditer(attributes):
        values.setdefault(m[1].lower(), unescape(m[2] or "").strip("\"'"))
    role = values.get("role", "").lower()
    if role in ROLES or "hidden" in values or values.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", values.get("style", ""), re.I):
        return True, False
    if tag not in ("body", "html", "main") and ("class" in values or "id" in values):
        words = set(re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{values.get('class', '')} {values.get('id', '')}").lower()))
        if tag == "article":
            names = f"{values.get('class', '')} {values.get('id', '')}".lower().split()
            words = {w for name in names if (w := re.match(r"[a-z]*", name)[0]) in ("comment", "comments", "reply", "ad", "ads", "advert", "promo", "related")}
        if words & NAMED and not (words & KEPT and not words & {"comment", "comments", "ad", "ads", "advert", "sidebar", "footer", "header", "related", "nav", "menu", "share", "social", "promo", "newsletter", "notice", "banner", "cookie"}):
            return True, False
    return False, tag in ("article", "main") or role in ("main", "article") or values.get("itemprop", "").lower() == "articlebody"


def _tag_end(html: str, at: int) -> int:
    """The place of the ``>`` that ends a tag, outside of quotes that are closed; -1 if there is none."""
    while m := _END.search(html, at):
        if m[0] == ">":
            return m.start()
        close = html.find(m[0], m.end())
        at = m.end() if close < 0 else close + 1
    return -1


def parse(html: str) -> Node:
    """The tree of a page. Whatever is not closed is closed at the end; unknown end tags are skipped; a tag without an end is text, with all that follows."""
    root = here = Node("#root", None, False, False, False)
    open_tags: Counter[str] = Counter()
    raw_ends: dict[str, re.Pattern] = {}
    at, size = 0, len(html)

    def leave(node: Node) -> Node:
        """The parent of ``node``, which is left with all that is open in it."""
        inner = here
        while inner is not node.parent:
            open_tags[inner.tag] -= 1
            inner = inner.parent
        return inner

    while at < size:
        m = _START.search(html, at)
        if m is None:
            here.parts.append(html[at:])
            break
        if m.start() > at:
            here.parts.append(html[at : m.start()])
        if m[2] is None:
            comment = m[0] == "<!--"
            end = html.find("-->" if comment else ">", m.end())
            at = size if end < 0 else end + (3 if comment else 1)
            continue
        end = _tag_end(html, m.end())
        if end < 0:
            here.parts.append(html[m.start() :])
            break
        tag, attributes, at = m[2].lower(), html[m.end() : end], end + 1
        if m[1]:
            if tag == "br":
                here.parts.append(" ")
            node = here if open_tags[tag] else None
            while node is not None and node.tag != tag:
                # The end of an inline element doesn't close a block around it.
                node = None if tag not in BLOCKS and tag not in LEFT_OUT and node.tag in BLOCKS else node.parent
            if node is not None and node.parent is not None:
                here = leave(node)
            continue
        if tag in RAW:
            if tag not in raw_ends:
                raw_ends[tag] = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I)
            close = raw_ends[tag].search(html, at)
            end = html.find(">", close.end()) if close else -1
            at = size if end < 0 else end + 1
            continue
        if tag in ENDS_P and open_tags["p"]:
            node = here
            while node is not None and node.tag != "p" and (node.tag not in BLOCKS):
                node = node.parent
            if node is not None and node.tag == "p":
                here = leave(node)
        if tag in CLOSES and any(open_tags[t] for t in CLOSES[tag][0]):
            same, border = CLOSES[tag]
            node = here
            while node.parent is not None and node.tag not in border and node.tag not in same:
                node = node.parent
            if node.tag in same and node.parent is not None:
                here = leave(node)
                if tag == "tr" and here.tag == "tr":
                    here = leave(here)
        if tag in VOID:
            here.parts.append(" ")
            continue
        out, main = _left_out(tag, attributes)
        child = Node(tag, here, out or here.out, main, tag == "a" or here.link)
        here.parts.append(child)
        here.children.append(child)
        if not attributes.rstrip().endswith("/") or tag in BLOCKS or tag in LEFT_OUT:
            here = child
            open_tags[tag] += 1
    return root


def _measure(root: Node) -> list[Node]:
    """Counts letters and links of each node that isn't left out, from the leaves up; the nodes in page order."""
    nodes = list(_walk(root))
    for node in reversed(nodes):
        own = sum(len(part.strip()) for part in node.parts if isinstance(part, str))
        inner = [c for c in node.children if not c.out]
        node.letters = own + sum(c.letters for c in inner)
        node.linked = own * node.link + sum(c.linked for c in inner)
        node.links = (node.tag == "a") + sum(c.links for c in inner)
    return nodes


def _text(node: Node) -> tuple[int, int]:
    """Letters of text below a node: all, and those in links."""
    return node.letters, node.linked


def _is_menu(node: Node) -> bool:
    return node.links >= MENU_LINKS and node.linked >= MENU_SHARE * node.letters


def _walk(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        stack.extend(c for c in reversed(x.children) if not c.out)


def _own_text(node: Node) -> str:
    """Text of a block with that of its inline elements, without blocks in it."""
    found: list[str] = []
    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            found.append(x)
        elif x is node or not (x.out or x.tag in BLOCKS):
            stack.extend(reversed(x.parts))
    return " ".join("".join(found).split())


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below a node in page order, white space turned into one blank, empty ones left out."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join(unescape("".join(run)).split())
        run.clear()
        if text:
            out.append(text)

    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            run.append(x)
        elif x is None:
            flush()
        elif not x.out:
            if x.tag in BLOCKS or x.tag == "#root":
                flush()
                stack.append(None)
            stack.extend(reversed(x.parts))
    flush()
    return out


def _main_nodes(root: Node) -> list[Node]:
    """The nodes whose text is the page's: the best container and siblings with points, in page order."""
    for node in _measure(root):
        if node.tag in MENU_TAGS and _is_menu(node):
            node.out = True  # a menu by its links, whatever its name
    nodes = _measure(root)
    holders = [x for x in nodes if x.tag in BLOCKS or x.tag == "#root"]
    for node in holders:
        text = _own_text(node)
        if not text:
            continue
        # A bare piece of text in a container counts for the container itself, a paragraph for its parent.
        points = (1.0 if len(text) >= 25 else 0.2) + text.count(",") + min(len(text) / 100, 3.0)
        target = node.parent if node.parent is not None and node.tag in ("p", "pre", "li", "td", "blockquote", "dd") or node.tag[:1] == "h" and node.tag[1:].isdigit() else node
        target.points += points
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.points += node.points / 2
    best, most = None, 0.0
    for node in holders:
        total, linked = _text(node)
        if total:
            node.points *= 1 - linked / total
            if node.points > most or best is None:
                best, most = node, node.points
    if best is None:
        return []
    around = best
    top = None
    while around is not None:
        if around.main:
            top = around
        around = around.parent
    if top is not None:
        best = top
    while best.parent is not None and best.tag in ("p", "li", "ul", "ol", "tr", "tbody", "td", "table", "h1", "h2", "h3"):
        best = best.parent
    if best.parent is None:
        return [best]
    if top is not None:
        return [s for s in best.parent.children if s is best or not s.out and (s.tag in BLOCKS and s.points >= max(LEAST_SIBLING * most, 3.0) or s.main)]
    # Without a mark of the article, its parts may lie beside the best container on each level above it.
    chosen, node = [best], best
    while node.parent is not None:
        parent = node.parent
        total, linked = _bare(parent)
        if total >= LONG_TEXT and linked < LEAST_LINKS * total:
            chosen = [parent]  # its own text is part of the article
        else:
            beside = parent.children
            kept = [s is node or not s.out and s.tag in BLOCKS and (s.points >= max(LEAST_SIBLING * most, 3.0) or _is_prose(s)) for s in beside]
            last = max(i for i, k in enumerate(kept) if k)
            first = kept.index(True)
            for i in range(last - 1, -1, -1):
                # A heading belongs to what follows, and short text to what it stands between.
                s = beside[i]
                if not kept[i] and not s.out and s.tag in BLOCKS and (_is_heading(s) or i > first):
                    total, linked = _text(s)
                    kept[i] = bool(total) and linked < LEAST_LINKS * total
            at = beside.index(node)
            chosen = [s for s, k in zip(beside[:at], kept) if k] + chosen + [s for s, k in zip(beside[at + 1 :], kept[at + 1 :]) if k]
        node = parent
    return chosen


def _is_heading(node: Node) -> bool:
    return node.tag in ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup")


def _is_prose(node: Node) -> bool:
    """Whether a part beside the best container is text of the article: long text with few links, or a whole sentence without one."""
    total, linked = _text(node)
    if total >= LONG_TEXT:
        return linked < LEAST_LINKS * total
    return not linked and not _is_heading(node) and "\n".join(blocks(node)).rstrip("\"'”’»)").endswith((".", "!", "?", "…", ":", "。", "！", "？"))


def _bare(node: Node) -> tuple[int, int]:
    """Letters of text in a container outside of the blocks in it: all, and those in links."""
    total = linked = 0
    stack = [node]
    while stack:
        x = stack.pop()
        for part in x.parts:
            if isinstance(part, str):
                n = len(part.strip())
                total += n
                linked += n * x.link
            elif not part.out and part.tag not in BLOCKS:
                stack.append(part)
    return total, linked


def extract(html: str | None) -> str:
    """The main text; empty if there is none."""
    out: list[str] = []
    for node in _main_nodes(parse(html or "")):
        out += blocks(node)
    return "\n".join(out)


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of ``pages``: key, url, text (empty if none), n_chars (code points).

    Null html counts as empty; an empty table gives an empty result, and pages are read whole, however long. Keys and urls may be null or repeat. Other columns are not read.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), text_or_empty(html).alias("h"))

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([extract(h) for h in batch], dtype=object)

    return rows.select(F.col("k").alias(key), F.col("u").alias(url), of("h").alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(load(spark, sf_dir, "pages"))
