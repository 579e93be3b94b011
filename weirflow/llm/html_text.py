"""Main text of HTML pages by composite text density."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements of HTML by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img br".split())
NOT_TEXT = frozenset("script style noscript template head title svg math canvas iframe object audio video form button select option textarea input nav aside footer dialog menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar toolbar form".split())
#: Words in class or id that hint at what is no article; the density of the element decides.
NOT_ARTICLE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay paywall"
    " newsletter subscribe signup sidebar side rail menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar comment comments commentlist reply replies"
    " respond disqus related recommended share sharing social widget pagination pager skip login search".split()
)
COMMENT = frozenset("comment comments commentlist reply replies respond disqus".split())
ROOTS = frozenset(("html", "body", "main"))
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
SPACE = re.compile(r"\s+")
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("html body table ul ol dl article section div main aside blockquote".split())


class Node:
    __slots__ = ("tag", "parent", "children", "skip", "chars", "tags", "link_chars", "link_tags", "density", "total", "hint", "off", "headed")

    def __init__(self, tag: str, parent: Node | None, skip: bool):
        self.tag, self.parent, self.skip = tag, parent, skip
        self.hint: frozenset[str] = frozenset()
        self.children: list[Node | str] = []


def not_article(tag: str, attrs: list[tuple[str, str | None]], parent: Node) -> bool:
    if tag in NOT_TEXT:
        return True
    if tag == "header":
        return not inside_article(parent)
    a = dict(attrs)
    if "hidden" in a or a.get("aria-hidden") == "true" or HIDDEN.search(a.get("style") or "") or (a.get("role") or "").lower() in ROLES:
        return True
    return False


def name_hint(tag: str, attrs: list[tuple[str, str | None]]) -> frozenset[str]:
    """Words in class or id that hint at boilerplate; headings and roots get none, an article element only as a comment."""
    if tag in ROOTS or tag in HEADINGS:
        return frozenset()
    a = dict(attrs)
    names = NOT_ARTICLE.intersection(WORD.findall(CAMEL.sub(" ", f"{a.get('class') or ''} {a.get('id') or ''}").lower()))
    return names & {"comment", "comments", "reply"} if tag == "article" else names


def inside_article(node: Node | None) -> bool:
    while node is not None:
        if node.tag in ("article", "main"):
            return True
        node = node.parent
    return False


class Tree(HTMLParser):
    """Builds the nodes; subtrees that are no text by their element or role are dropped as they are read."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", None, False)
        self.feed(html)
        self.close()

    def up_to(self, tags: tuple[str, ...]) -> None:
        """Close the nearest open element of these tags within its scope."""
        node = self.at
        while node.parent is not None and node.tag not in tags:
            if node.tag in SCOPES:
                return
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in CLOSES_P:
            self.up_to(("p",))
        if tag in CLOSES:
            self.up_to(CLOSES[tag])
        if tag in ("body", "article", "main") and self.at.tag in ("head", "title"):
            self.at = self.root  # an unclosed head ends here
        if tag in VOID:
            if not self.at.skip:
                self.at.children.append(Node(tag, self.at, tag == "input"))
            return
        node = Node(tag, self.at, self.at.skip or not_article(tag, attrs, self.at))
        if not node.skip:
            node.hint = name_hint(tag, attrs)
            self.at.children.append(node)
        self.at = node

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            if tag in INLINE and node.tag not in INLINE:
                return  # a stray end tag doesn't close a block
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        if not self.at.skip:
            if self.at.children and isinstance(self.at.children[-1], str):
                self.at.children[-1] += data
            else:
                self.at.children.append(data)


def in_order(root: Node) -> list[Node]:
    """Nodes, parents before children, without recursion: pages may nest deeply."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in node.children if not isinstance(c, str))
    return out


def measure(root: Node) -> list[Node]:
    """Composite text density of every node and the sum of its children's densities.

    Elements with a name hint are off unless they hold most of the page's text and a heading, if it has any: they and
    what they hold are no candidates for the article and add nothing to their parent's sum.
    """
    nodes = in_order(root)
    for n in reversed(nodes):
        n.chars = sum(len(SPACE.sub(" ", c).strip()) for c in n.children if isinstance(c, str))
        kids = [c for c in n.children if not isinstance(c, str)]
        n.chars += sum(k.chars for k in kids)
        n.tags = len(kids) + sum(k.tags for k in kids)
        link = n.tag == "a"
        n.link_chars = n.chars if link else sum(k.link_chars for k in kids)
        n.link_tags = sum(k.link_tags + (k.tag == "a") for k in kids)
        n.headed = n.tag in HEADINGS or any(k.headed for k in kids)
    for n in nodes:
        n.off = (n.parent is not None and n.parent.off) or (bool(n.hint) and not (2 * n.chars > root.chars and (n.headed or not root.headed)))
    body_links, body_chars = root.link_chars, max(1, root.chars)
    for n in reversed(nodes):
        c, t, lc, lt = n.chars, max(1, n.tags), max(1, n.link_chars), max(1, n.link_tags)
        base = math.log(c / max(1, c - n.link_chars) * lc + body_links / body_chars * c + math.e)  # over 1, as lc is 1 at least
        n.density = c / t * math.log(max(1.0, c / lc * t / lt), base) if c else 0.0
        n.total = sum(k.density for k in n.children if not isinstance(k, str) and k.tag not in INLINE and (n.off or not k.off)) or n.density
    return nodes


def main_node(root: Node) -> Node:
    """The subtree of the greatest density sum among the nodes that pass the threshold of the body path.

    The threshold is the least density on the path from the densest node to the body. Ancestors of the subtree that are
    at least as dense as the body take it in, so that a heading beside the text is kept. Ties go to the longer text, then
    to the first in page order.
    """
    nodes = measure(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    open_nodes = [n for n in nodes if n.chars and not n.off and n.tag not in INLINE and n.tag not in ("html", "body", "#root")]
    if not open_nodes:
        return body
    densest = max(open_nodes, key=lambda n: (n.density, n.chars))
    threshold = min(n.density for n in body_path(densest, body))
    best = max((n for n in open_nodes if n.density >= threshold), key=lambda n: (n.total, n.chars))
    wide = [n for n in body_path(best, body) if n.density >= body.density and n.tag not in ("html", "body", "#root")]
    return wide[-1] if wide else best


def body_path(node: Node, body: Node) -> list[Node]:
    """The node and its ancestors up to the body, or to the root for a node outside it."""
    path = [node]
    while path[-1] is not body and path[-1].parent is not None:
        path.append(path[-1].parent)
    return path


def boilerplate(n: Node, top: Node) -> bool:
    """Whether an element with a name hint inside the article ``top`` is no text of it: by its links or its density.

    A section with a heading of its own is text, unless it is named as comments.
    """
    if not n.hint:
        return False
    if 2 * n.chars > top.chars:
        return n.off and not n.headed and top.headed  # most of the text, yet the page's headings are elsewhere
    if 2 * n.link_chars > n.chars:
        return True
    return n.density < top.density and not (n.headed and not n.hint & COMMENT)


def blocks(node: Node, whole: bool = False) -> list[str]:
    """Text of the blocks under a node in page order, white space inside a block made one space; ``whole`` keeps boilerplate."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if t := SPACE.sub(" ", "".join(run)).strip():
            out.append(t)
        run.clear()

    stack: list[tuple[Node | str | None, bool]] = [(node, False)]
    while stack:
        x, kept_only = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            if not kept_only:
                run.append(x)
        elif x.tag in ("br", "hr"):
            run.append(" ")
        elif not whole and x is not node and boilerplate(x, node):
            run.append(" ")
        else:
            if x.tag == "header":
                kept_only = True  # of an article's own header only the headings belong to the text
            elif x.tag in HEADINGS:
                kept_only = False
            if x.tag not in INLINE:
                flush()
                stack.append((None, False))
            stack.extend((c, kept_only) for c in reversed(x.children))
    flush()
    return out


def main_text(html: str | None) -> str:
    """The article's blocks joined by newlines; empty for null, empty or text-free pages."""
    if not html:
        return ""
    node = main_node(Tree(html).root)
    return "\n".join(blocks(node) or blocks(node, whole=True))


def extract_main_text(pages: DataFrame, page_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_col``, ``url_col``, text, n_chars for every page, from the whole html; one pass, no shuffle.

    Composite text density chooses the article; elements that are no text whatever their density (scripts, navigation,
    forms, asides, footers) are left out as the page is read, names in class and id are hints that density overrules.
    Null or empty html, and pages without text, give an empty text with 0 characters. Repeated rows are kept.
    A page is parsed alone, so memory is bounded by the longest page. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                text = [main_text(h) for h in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text, pa.string())], names=["row", "text"])

    own = pages.select(F.struct(F.col(page_col).alias("p"), F.col(url_col).alias("u")).alias("row"), F.col(html_col).alias("html"))
    kind = own.schema["row"].dataType.simpleString()
    out = own.mapInArrow(run, f"row {kind}, text string")
    return out.select(F.col("row.p").alias(page_col), F.col("row.u").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
