"""Main text of web pages by composite text density."""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg object select".split())
#: Those that hold all of the page's rest when they are never closed, and those that "/>" closes.
TO_END = frozenset("script style title textarea".split())
FOREIGN = frozenset(["svg"])
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr math mfrac mi mn mo mroot mrow msqrt msub msubsup msup mtext".split()
)
#: Elements that hold articles, by their names.
ARTICLE = ("article", "main")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that never hold an article's text, and the roles of those that do neither.
CHROME = frozenset("nav header footer aside form button dialog menu head".split()) | RAW
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form menu dialog alert".split())
#: Classes and ids, as whole words between blanks, that mark an element unless the article stands in it.
CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies copyright disqus footer header login masthead menu modal nav navbar navigation newsletter notice notices "
    "pagination paywall popup promo promoted promotion related reply replies respond search share sharing sidebar "
    "signup social sponsor sponsored subscribe tags teaser toolbar widget".split()
)
#: What a start tag closes when it is open: paragraphs before blocks, items before items.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"},
    "tfoot": {"tbody", "tr", "td", "th"},
}
#: Elements beyond which nothing is closed implicitly.
SCOPE = frozenset("html body article main section div table ul ol dl blockquote td th".split())

#: How much a density sum weighs where names speak against it.
_DOUBT = 0.3

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)"
    # quotes open a value directly after "=" only
    r"|<(/?)([A-Za-z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|=\s*[^\s\"'>][^\s>]*|=|[^>=]++)*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")


@dataclass
class Node:
    """An element that breaks lines; inline elements only count as tags of it."""

    tag: str
    parent: Node | None
    chrome: bool = False
    hint: bool = False
    marked: bool = False
    parts: list = field(default_factory=list)
    tags: int = 1
    chars: int = 0
    link_chars: int = 0
    link_tags: int = 0
    density: float = 0.0
    density_sum: float = 0.0
    own: tuple | None = None

    def nodes(self):
        return (x for x in self.parts if isinstance(x, Node))


def _is_chrome(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether the element is chrome for certain, and whether its class or id says so."""
    if tag in CHROME:
        return True, False
    hint = False
    if not attributes or tag in ("html", "body", "article", "main"):
        return False, False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "role" and value in CHROME_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True, False
        if name in ("class", "id") and not CHROME_WORDS.isdisjoint(value.split()):
            hint = True
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True, False
    return False, hint


def _chain(node: Node):
    """The open elements, chrome or marked as such, that stand inside one another."""
    while node is not None and node.marked:
        yield node
        node = node.parent


def parse(source: str) -> Node:
    """The tree of block elements below a root, with texts, and counts of tags and links; what is chrome for certain has no texts."""
    root = node = Node("#root", None)
    link = 0
    i, n = 0, len(source)

    def add(text: str) -> None:
        if text and not node.chrome:
            text = html.unescape(text)
            node.parts.append(text)
            size = sum(map(len, text.split()))
            node.chars += size
            if link:
                node.link_chars += size

    while i < n:
        m = _TOKEN.search(source, i)
        if m is None:
            add(source[i:])
            break
        add(source[i : m.start()])
        i = max(m.end(), m.start() + 1)
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in INLINE and not (any(_is_chrome(tag, m[3])) if not closing else any(x.tag == tag for x in _chain(node))):
            if tag == "a":
                link = 0 if closing else 1
                node.link_tags += not closing
            node.tags += not closing
            continue
        link = 0
        if closing:
            at = node
            while at.parent is not None and at.tag != tag:
                at = at.parent
            if at.parent is not None:
                node = at.parent
            elif tag in ("p", "br") and not node.chrome:
                node.parts.append(" ")
            continue
        if tag == "br" or tag in VOID:
            node.tags += 1
            if not node.chrome:
                node.parts.append(" " if tag in ("br", "hr") else "")
            continue
        if tag in RAW:
            if tag in FOREIGN and m[3].endswith("/"):
                continue
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, i)
            # without an end tag, what follows is the page's
            i = end.end() if end else n if tag in TO_END else i
            continue
        closes = CLOSES.get(tag, set() if tag in INLINE else {"p"})
        at = node
        while at.parent is not None and at.tag not in SCOPE - closes:
            if at.tag in closes or closes and at.tag == "p":
                node = at.parent
            at = at.parent
        chrome, hint = _is_chrome(tag, m[3])
        # an article's own header holds its title
        chrome = chrome and not (tag == "header" and _within(node, ARTICLE))
        child = Node(tag, node, node.chrome or chrome, hint, node.marked or chrome or hint)
        node.parts.append(child)
        node = child
    return root


def _postorder(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += node.nodes()
    return out[::-1]


def measure(root: Node) -> None:
    """Composite text density of every node: characters per tag, lowered where they or the tags are links'.

    density = C / T * log(C / LC * T / LT) to the base ln(C / nLC * LC + LCb / Cb * C + e), with C characters,
    T tags, LC and LT those of links, nLC the other characters, and LCb, Cb the whole page's.
    """
    order = _postorder(root)
    for node in order:
        if node.own is None:
            node.own = node.chars, node.tags, node.link_chars, node.link_tags
        node.chars, node.tags, node.link_chars, node.link_tags = node.own
        node.density = node.density_sum = 0.0
        for child in node.nodes():
            if not child.chrome:
                node.chars += child.chars
                node.tags += child.tags
                node.link_chars += child.link_chars
                node.link_tags += child.link_tags
    page = root.link_chars / max(root.chars, 1)
    for node in order:
        c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        if not c or node.chrome:
            continue
        base = math.log(c / max(c - node.link_chars, 1) * node.link_chars + page * c + math.e)
        node.density = c / t * max(math.log(max(c / lc * t / lt, 1)), 0.0) / base if base > 0 else 0.0
        # a node whose texts stand in it directly counts for itself
        node.density_sum = sum(x.density for x in node.nodes())
        if any(isinstance(x, str) and x.strip() for x in node.parts):
            node.density_sum += node.density


def _within(node: Node | None, tags: tuple[str, ...]) -> bool:
    while node is not None:
        if node.tag in tags:
            return True
        node = node.parent
    return False


def _best(root: Node) -> Node:
    """The node of the largest density sum; sums outside the page's article elements, if it has some, and of marked nodes weigh less."""
    order = _postorder(root)[::-1]
    some = any(x.tag in ARTICLE and x.chars and not x.chrome for x in order)

    def weighed(x: Node) -> float:
        weight = _DOUBT if x.marked and not x.chrome else 1.0
        return x.density_sum * weight * (_DOUBT if some and not _within(x, ARTICLE) else 1.0)

    return max(order, key=weighed)


def _content(root: Node) -> list[Node]:
    """The subtrees of the article: the one of the largest density sum, and beside the path from it to the body what is as dense as the path.

    In an article element the subtree is all of it, and outside it only other articles count that come near its
    density sum. Headings beside the subtree are the article's, however short.
    """
    best = _best(root)
    weight = best.density_sum
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(x.density for x in path if x.density > 0) if weight > 0 else 0.0
    around = next((i for i, x in enumerate(path) if x.tag == "article"), 0)
    path = path[around:]
    chosen = [path[0]]
    on_path = {id(x) for x in path}
    beyond = path[0].tag in ARTICLE
    for depth, node in enumerate(path[1:]):
        for child in node.nodes():
            if id(child) in on_path or child.chrome or not weight:
                continue
            if beyond:
                near = child.tag in ARTICLE and child.density_sum >= weight / 4
            else:
                near = child.density >= threshold or depth == 0 and child.tag in HEADINGS
            if near:
                chosen.append(child)
        beyond = beyond or node.tag in ARTICLE
    return chosen


def _articles(root: Node) -> list[Node]:
    return [x for x in _postorder(root)[::-1] if x.tag in ARTICLE and not x.chrome]


def _top(articles: list[Node]) -> Node | None:
    return max(articles, key=lambda x: x.density_sum + x.chars * 1e-9, default=None)


def settle(root: Node) -> None:
    """Makes hinted elements chrome, except those that hold the page's article; root is measured before and after.

    The article is the article or main element of the largest density sum, or without any the page; the hinted
    elements around it stay, and those in it that hold its largest density sum.
    """
    measure(root)
    if not any(x.hint for x in _postorder(root)):
        return
    top = _top(_articles(root))
    at = _best(top if top is not None and top.chars else root)
    while at is not None:
        at.hint = False
        at = at.parent
    for node in _postorder(root)[::-1]:
        node.chrome = node.chrome or node.hint or node.parent is not None and node.parent.chrome
    measure(root)


def main_text(source: str | None) -> str:
    """The article's text: its blocks in page order, each with single blanks, joined by one blank."""
    if not source:
        return ""
    root = parse(source)
    settle(root)
    return _text(_content(root))


def _text(chosen: list[Node]) -> str:
    wanted = {id(x) for x in chosen}
    top = chosen[0]
    while top.parent is not None:
        top = top.parent
    out: list[str] = []
    todo: list[tuple[object, bool]] = [(top, False)]
    while todo:
        x, inside = todo.pop()
        if isinstance(x, str):
            if inside:
                out.append(x)
            continue
        if x.chrome:
            continue
        inside = inside or id(x) in wanted
        if inside:
            out.append(" ")
        todo.append((" ", inside))
        todo += [(y, inside) for y in reversed(x.parts)]
    return " ".join("".join(out).split())


def extract_text(
    df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    The page becomes a tree of block elements, built from start and end tags
    with HTML's rules for omitted and misnested ones (inline elements only count
    as tags). Elements that by kind or role are menus, headers,
    footers, sidebars, notices, adverts, forms, comments or code are left out (not the header of an
    article element), and so are those that a whole class or id names as such, unless the densest subtree is in them.
    Every node has its composite text density, and the sum of its children's
    densities; the largest sum marks the article, whatever it is called: names
    only weigh. The least density on the path
    from there to the body is the threshold that further subtrees beside the
    path must reach.

    Null, empty and textless pages have an empty text. Unclosed elements end with the page. Null
    ids and urls are passed on; repeated rows are each returned; extra columns
    are ignored; an empty table gives no rows.
    """
    rows = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    @F.pandas_udf("string")
    def main(pages: pd.Series) -> pd.Series:
        return pages.map(main_text, na_action=None)

    return rows.select("page_id", "url", main("html").alias("text")).select(
        "*", F.length("text").cast("long").alias("n_chars")
    )
