"""Main text of web pages by composite text density."""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right

from pyspark.sql import DataFrame

from tidemark.llm.shared import columns_of, map_rows

# Elements by how they nest and show.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody "
    "td tfoot th thead tr ul caption".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
SELF_CLOSING = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"},
}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}}
#: Elements that never belong to an article.
ASIDE_TAGS = set(
    "nav aside footer head script style noscript template iframe svg canvas object button select input "
    "textarea dialog menu audio video map".split()
)
ASIDE_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
#: Parts of class and id names that say what an element is.
ASIDE_NAMES = set(
    "ad ads adv advert adverts advertisement advertising adbox sponsor sponsored promo promotion sidebar side "
    "menu nav navbar navigation breadcrumb breadcrumbs footer header masthead banner cookie cookies consent gdpr "
    "notice popup modal overlay newsletter subscribe signup login comment comments commentlist respond reply "
    "replies disqus share sharing social related recommended widget toolbar pagination pager skip".split()
)
#: Names that hold for all of an element, however much text it has.
READER_NAMES = set("comment comments commentlist respond reply replies disqus".split())
ARTICLE_NAMES = set("article main content post entry story body text".split())
#: A name with one of these parts says what a page has, not what the element is.
MODIFIERS = set("has no not with without layout template theme free enabled disabled".split())
ARTICLES = ("article", "main")

ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
NAME_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
TAG_MARK = re.compile("[>\"']")
NEVER, UNLESS_WRAPPER, ALWAYS = 0, 1, 2


class Node:
    """An element: its ``parts`` (texts and nodes) in page order, and the figures of its subtree."""

    __slots__ = (
        "tag", "parent", "parts", "left_out", "names", "aside", "article", "chars", "tags", "link_chars", "link_tags",
        "shown", "paragraphs", "articles", "density", "total", "deep",
    )

    def __init__(self, tag: str, parent: Node | None, attributes: str = "") -> None:
        self.tag, self.parent, self.parts, self.aside, self.names = tag, parent, [], False, ()
        within = parent is not None and (parent.article or parent.tag == "article")
        self.article, self.left_out = tag in ARTICLES or within, NEVER
        if tag in ASIDE_TAGS:
            self.left_out = ALWAYS
        elif tag == "form" or tag == "header" and not within:
            self.left_out = UNLESS_WRAPPER
        if attributes:
            self.read(attributes)

    def read(self, attributes: str) -> None:
        fields = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
        role = fields.get("role", "").lower()
        self.article = self.article or role in ARTICLES
        style = fields.get("style", "").replace(" ", "").lower()
        if role in ASIDE_ROLES or "hidden" in attributes.lower().split() or fields.get("aria-hidden", "").lower() == "true" or "display:none" in style:
            self.left_out = ALWAYS
        if self.tag in ("html", "body", *ARTICLES):
            return
        names = set()
        for token in f"{fields.get('class', '')} {fields.get('id', '')}".split():
            parts = {x.lower() for x in NAME_PARTS.findall(token)}
            if not parts & MODIFIERS:
                names |= parts
        self.names = names & ASIDE_NAMES
        if self.names and not (names & ARTICLE_NAMES and not names & {"comment", "comments", "sidebar", "related"}):
            self.left_out = max(self.left_out, UNLESS_WRAPPER)


class OpenElements:
    """The elements that are open, outermost first, with the places of each tag among them, so that
    an end tag or an implied end is found without a walk."""

    def __init__(self, root: Node) -> None:
        self.stack, self.places, self.blocks = [root], {}, []

    def push(self, node: Node) -> None:
        at = len(self.stack)
        self.stack.append(node)
        self.places.setdefault(node.tag, []).append(at)
        if node.tag in BLOCKS and node.tag != "p":
            self.blocks.append(at)

    def cut(self, size: int) -> None:
        """Close all but the outermost ``size`` elements."""
        while len(self.stack) > size:
            node = self.stack.pop()
            self.places[node.tag].pop()
            if self.blocks and self.blocks[-1] == len(self.stack):
                self.blocks.pop()

    def last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, tag: str) -> None:
        """An end tag; one that nothing opened is ignored."""
        if self.places.get(tag):
            self.cut(self.places[tag][-1])

    def make_place(self, tag: str) -> None:
        """Close what a new ``tag`` ends: an open paragraph, or earlier items up to their list."""
        if tag in BLOCKS:
            paragraph = self.last(("p",))
            if paragraph > (self.blocks[-1] if self.blocks else 0):
                self.cut(paragraph)
        if tag in SELF_CLOSING:
            scope = self.last(SCOPES.get(tag, ()))
            for ended in SELF_CLOSING[tag]:
                places = self.places.get(ended, ())
                at = bisect_right(places, scope)
                if at < len(places):
                    self.cut(places[at])


def tag_end(page: str, at: int) -> int:
    """Place of the bracket that ends the tag whose name ends at ``at``, or -1. Brackets in quotes do
    not count; a quote that is never closed is a mark like any other."""
    while True:
        mark = TAG_MARK.search(page, at)
        if not mark:
            return -1
        if mark.group() == ">":
            return mark.start()
        closing = page.find(mark.group(), mark.end())
        if closing < 0:
            return page.find(">", mark.end())
        at = closing + 1


def parsed(page: str) -> Node:
    """The element tree of a page: text and child nodes in page order, as browsers would nest
    them where end tags are missing. Comments, scripts and styles leave nothing. Every part of
    the page is looked at a bounded number of times, however it is nested or broken."""
    root = Node("#root", None)
    elements = OpenElements(root)
    stack = elements.stack
    at, size = 0, len(page)

    def text(raw: str) -> None:
        if raw:
            stack[-1].parts.append(html.unescape(raw) if "&" in raw else raw)

    while at < size:
        opened = page.find("<", at)
        if opened < 0:
            text(page[at:])
            break
        text(page[at:opened])
        if page.startswith("<!--", opened):
            end = page.find("-->", opened + 4)
            at = size if end < 0 else end + 3
            continue
        following = page[opened + 1 : opened + 2]
        if following in ("!", "?"):
            end = page.find(">", opened)
            at = size if end < 0 else end + 1
            continue
        closing = following == "/"
        name = TAG_NAME.match(page, opened + 1 + closing)
        if not name:
            # A lone angle bracket is text.
            stack[-1].parts.append("<")
            at = opened + 1
            continue
        end = tag_end(page, name.end())
        if end < 0:
            break
        tag, attributes, at = name.group().lower(), page[name.end() : end], end + 1
        if closing:
            elements.close(tag)
            continue
        elements.make_place(tag)
        child = Node(tag, stack[-1], attributes)
        stack[-1].parts.append(child)
        if tag in RAW:
            ending = re.compile(f"</{re.escape(tag)}", re.I).search(page, at)
            stop = page.find(">", ending.start()) if ending else -1
            at = size if stop < 0 else stop + 1
        elif tag not in VOID and not attributes.endswith("/"):
            elements.push(child)
    return root


def in_order(root: Node) -> list[Node]:
    """All nodes, parents before children; no recursion, however deep a page is nested."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(p for p in reversed(node.parts) if isinstance(p, Node))
    return out


def weigh(root: Node) -> list[Node]:
    """Set the figures of every node: ``density``, ``aside`` (left out), ``total`` (the sum of the
    densities of its children) and ``deep`` (that of all nodes below it), without what is left out.
    """
    nodes = in_order(root)
    for node in nodes:
        own = 0
        for part in node.parts:
            if isinstance(part, str):
                own += len(" ".join(part.split()))
        node.chars = node.shown = own
        node.tags = node.link_chars = node.link_tags = node.paragraphs = node.articles = 0
        node.total = node.deep = 0.0
    # Children come after their parents, so each is complete when it is added to its parent.
    for node in reversed(nodes):
        if node.tag == "a":
            node.link_chars = node.chars
            node.link_tags += 1
        # Of what an element shows, nothing counts that is left out for certain.
        if node.left_out == ALWAYS:
            node.shown = node.paragraphs = node.articles = 0
        elif node.shown:
            node.paragraphs = node.paragraphs or int(node.tag in BLOCKS)
            node.articles += node.tag in ARTICLES
        up = node.parent
        if up is not None:
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
            up.shown += node.shown
            up.paragraphs += node.paragraphs
            up.articles += node.articles
    linked = root.link_chars / root.chars if root.chars else 0.0
    for node in reversed(nodes):
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, linked) if node.chars else 0.0
        node.aside = node.left_out == ALWAYS or node.left_out == UNLESS_WRAPPER and not wraps(node, root)
        node.deep += node.total
        if node.parent is not None and not node.aside:
            node.parent.total += node.density
            node.parent.deep += node.deep
    return nodes


def wraps(node: Node, root: Node) -> bool:
    """Whether an element that is named like surroundings wraps the page instead: it shows most of
    the page's text, in several blocks, and no article stands outside it."""
    several = node.shown * 2 > root.shown and node.paragraphs >= 2 and node.articles == root.articles
    return several and READER_NAMES.isdisjoint(node.names)


def density(chars: int, tags: int, link_chars: int, link_tags: int, linked: float) -> float:
    """Characters per tag, less for text in links; ``linked`` is the share of it in the page. The
    base of the logarithm, which grows with the text in links, is at least 2: nearer to 1 it
    would make a few words as dense as an article."""
    if not chars:
        return 0.0
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + linked * chars + math.e)
    ratio = chars / max(link_chars, 1) * max(tags, 1) / max(link_tags, 1)
    return chars / max(tags, 1) * math.log(ratio) / math.log(max(base, 2.0))


def path_up(node: Node) -> list[Node]:
    out = []
    while node is not None:
        out.append(node)
        node = node.parent
    return out


def weight(node: Node) -> float:
    """What a subtree is chosen by: the sum of its child densities, and for an article element, which
    says that all of it is content, the sum over all nodes in it."""
    return node.deep if node.tag in ARTICLES else node.total


def content(root: Node) -> tuple[Node, set[int], float]:
    """The subtree of the largest weight, the ids of its ancestors, and the threshold: the least
    density on the way to it from the body.

    Of article elements in each other, the inner one is taken if it has half of the weight.
    """
    nodes = weigh(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    best, within = body, {id(body)}
    for node in nodes:
        if not node.aside and node.parent is not None and id(node.parent) in within:
            within.add(id(node))
            if node.chars and weight(node) > weight(best):
                best = node
    if best.tag in ARTICLES:
        for node in in_order(best)[1:]:
            if node.tag in ARTICLES and id(node) in within and node.deep * 2 >= best.deep:
                best = node
    way = path_up(best)
    threshold = min((n.density for n in way[: way.index(body) + 1]), default=0.0) if body in way else 0.0
    return best, {id(n) for n in way[1:]}, threshold


def blocks(root: Node) -> list[str]:
    """Texts of the blocks of the main content, in page order.

    Besides the chosen subtree, the parts beside the way to it count if they are as dense as the
    threshold and not mostly links, and headings beside the way count too, unless an article
    element was chosen; in it, blocks that are mostly links and below the threshold do not count.
    Menus, headers, footers, sidebars, notices, adverts, forms and reader comments are left out.
    """
    best, way, threshold = content(root)
    out, held = [], []

    def flush() -> None:
        line = " ".join("".join(held).split())
        held.clear()
        if line:
            out.append(line)

    whole = best.tag in ARTICLES
    todo: list[tuple] = [(root, False)]
    while todo:
        part, inside = todo.pop()
        if part is None:
            flush()
        elif isinstance(part, str):
            if inside:
                held.append(part)
        elif part.tag == "br":
            held.append(" ")
        elif not part.aside:
            linked = part.link_chars * 2 >= part.chars > 0
            if part is best:
                inside = True
            elif inside and not whole and linked and part.tag in BLOCKS and part.density < threshold:
                continue
            elif not inside and id(part) not in way:
                dense = part.density >= threshold and not linked
                if whole and part.tag not in ARTICLES or not (dense or part.tag in HEADINGS):
                    continue
                inside = True
            if part.tag in BLOCKS:
                flush()
                todo.append((None, False))
            todo.extend((p, inside) for p in reversed(part.parts))
    flush()
    return out


def main_text(page: str | None) -> str:
    return "\n\n".join(blocks(parsed(page))) if page else ""


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``id``, ``url`` and ``text`` of every page, from the whole html.

    Blocks are joined by an empty line; white space within one is a single space. A page that is
    null, empty or without an article gives an empty text. Repeated rows each give a row; other
    columns are ignored.
    """

    def rows(tuples):
        for key, url, page in tuples:
            yield key, url, main_text(page)

    kind = dict(pages.dtypes)[id_col]
    return map_rows(
        columns_of(pages, id=id_col, url=url_col, html=html_col), rows, f"id {kind}, url string, text string"
    )
