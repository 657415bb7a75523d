"""Main text of web pages by composite text density (operator 8).

The page becomes a tree of its block elements; inline tags count as tags, and text inside links
as link text. Every node gets its composite density: characters per tag, adjusted by how much of
them is link text. The node whose children's densities sum highest holds the main text. The
least density on the path from it up to the body is the threshold: while an ancestor has another
child at or above it (a title beside the body of an article), the ancestor is taken instead.
Elements that are boilerplate by tag or role never count; nor do those named so by a whole word of
class or by the id, unless they hold most of the page's text outside links.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm._common import arrow_map, table

#: Fixed values of HTML: elements without content, raw text, and blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp".split())
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption address hgroup details summary fieldset center header footer nav aside form dialog "
    "menu search".split())
#: Boilerplate by element, by role and by the words of class and id.
DROPPED = frozenset("script style noscript template textarea title iframe head nav header footer aside form button select "
                    "option svg object dialog menu canvas input label fieldset search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
NAMES = re.compile(
    r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|sidebar\w*|side|footer|header|masthead|cookies?|"
    r"consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|comments?|commentlist|"
    r"disqus|respond|replies|reply|share|sharing|social|related|recommend\w*|breadcrumbs?|pagination|pager|toolbar|widget|"
    r"copyright|legal|disclaimer|skip", re.IGNORECASE)
#: Words that may stand beside a name in one class or id without changing what it says.
BESIDE = re.compile(r"left|right|top|bottom|site|global|primary|secondary|wrapper|container|box|area|block|list|items?|bar|links|"
                    r"posts|articles|stories|\d+", re.IGNORECASE)
#: Implied ends: an item ends the one before it.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Names of what readers write, and words that stand beside these only (an ``entry-header`` is a title).
READERS = re.compile(r"comments?|commentlist|respond|replies|reply", re.IGNORECASE)
BESIDE_READERS = re.compile(r"post|entry|article|user|reader|visitor|section|thread|form|title", re.IGNORECASE)
GONE, NAMED = 1, 2
NAME = re.compile(r"/?[A-Za-z][^\s/>]*")
#: Up to the end of a tag, or to the equals sign before a value and its quote, if it has one.
ATTRIBUTES = re.compile(r"""[^>=]*(?:>|=\s*(["']?))""")
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)


class Node:
    __slots__ = ("chars", "density", "drop", "items", "links", "link_tags", "name", "tags", "up")

    def __init__(self, name: str, up: Node | None, drop: int = 0):
        self.name, self.up, self.items, self.drop = name, up, [], drop
        self.chars = self.links = self.tags = self.link_tags = 0
        self.density = 0.0


def _named(value: str) -> bool:
    """Whether a word of a class or an id consists of boilerplate names and words beside them."""
    parts = [p for p in re.split(r"[_-]+", value) if p]
    told = [bool(NAMES.fullmatch(p)) for p in parts]
    readers = any(map(READERS.fullmatch, parts))
    return any(told) and all(t or BESIDE.fullmatch(p) or readers and BESIDE_READERS.fullmatch(p)
                             for t, p in zip(told, parts, strict=True))


def _boilerplate(name: str, attributes: str) -> int:
    """GONE by tag, role or hidden, NAMED by class or id, else 0."""
    if name in DROPPED:
        return GONE
    if not attributes or name in ("html", "body", "main", "article"):
        return 0
    found = 0
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return GONE
        if key == "class" and any(map(_named, value.split())) or key == "id" and name not in HEADINGS and _named(value.strip()):
            found = NAMED
    return found


def tokens(page: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, name, attributes) of the tags of a page; comments and declarations have the name
    '', a CDATA section '![', and an end tag a leading '/'.

    A quote opens a value only after an equals sign. Every character is passed once: a tag whose
    quotes leave no end ends at its first '>', and from there on quotes are not heeded.
    """
    at, quoted = page.find("<"), True
    last = {c: page.rfind(c) for c in "\"'>"}
    while 0 <= at:
        end, name, attributes = 0, "", ""
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4) + 3
            end = end if end > 2 else len(page)
        elif page.startswith("<![CDATA[", at):
            end, name = page.find("]]>", at + 9) + 3, "!["
            end = end if end > 2 else len(page)
        elif at > last[">"]:
            return
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at) + 1
        elif m := NAME.match(page, at + 1):
            name, start = m[0].lower(), m.end()
            to = start
            while quoted and (step := ATTRIBUTES.match(page, to)):
                to = step.end()
                if page[to - 1] == ">" and not step[1]:
                    end = to
                    break
                if step[1] and last[step[1]] >= to:
                    to = page.find(step[1], to) + 1
            if not end:
                quoted, end = False, page.find(">", start) + 1
            attributes = page[start:end - 1]
        if end:
            yield at, end, name, attributes
        at = page.find("<", end or at + 1)


def parse(page: str) -> Node:
    """Tree of the block elements of a page, with text runs in order; boilerplate is left out.

    Time grows with the page alone: of the open elements only the latest of a name, and the
    blocks, are ever looked at.
    """
    root = node = Node("body", None)
    open_tags: list[tuple[str, Node]] = []  # every open element with the node to go back to
    places: dict[str, list[int]] = {}  # places in open_tags by name
    blocks: list[int] = []  # places of blocks
    boundary: list[int] = []  # places in open_tags of the elements that are to be dropped
    link = at = 0

    def close(k: int) -> None:
        nonlocal node, link
        node = open_tags[k][1]
        for name, _ in reversed(open_tags[k:]):
            places[name].pop()
            link -= name == "a"
        del open_tags[k:]
        for stack in (boundary, blocks):
            while stack and stack[-1] >= k:
                stack.pop()

    for start, end, name, attributes in tokens(page):
        if start < at:
            continue
        if start > at:
            _text(node, page[at:start], link)
        at = end
        if not name:
            continue
        if name == "![":
            _text(node, page[start + 9:at].removesuffix("]]>"), link)
            continue
        if name[0] == "/":
            name = name[1:]
            k = places[name][-1] if places.get(name) else -1
            if name in ("html", "body"):
                if boundary:
                    close(boundary[0])
            elif k >= 0:
                # The end of an inline element from outside does not end a dropped block.
                if name in BLOCKS or not boundary or k >= boundary[-1] or open_tags[boundary[-1]][0] not in BLOCKS:
                    close(k)
            elif name == "br":
                node.items.append(" ")
            continue
        closed = attributes.rstrip().endswith("/")
        if name in RAW and not closed:
            stop = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, at)
            at = stop.end() if stop else len(page)
            continue
        empty = name in VOID or closed and name not in BLOCKS
        if name in BLOCKS and name not in ("html", "body"):
            # A block ends an open paragraph; a heading one right around it; an item the one before it.
            if name in HEADINGS and blocks and open_tags[blocks[-1]][0] in HEADINGS:
                close(blocks[-1])
            for k in reversed(blocks):
                tag = open_tags[k][0]
                if tag == "p" or tag in ENDS.get(name, ()):
                    close(k)
                    if tag != "p":
                        break
                elif tag not in HEADINGS:
                    break
        drop = _boilerplate(name, attributes)
        if name == "header" and drop and places.get("article") and not boundary:
            drop = 0  # the head of an article holds its title
        if name in ("html", "body") or drop and empty:
            continue
        if empty:
            node.tags += 1
            if name in ("br", "hr"):
                node.items.append(" ")
            continue
        if drop:
            boundary.append(len(open_tags))
        if name in BLOCKS:
            blocks.append(len(open_tags))
        places.setdefault(name, []).append(len(open_tags))
        open_tags.append((name, node))
        if drop or name in BLOCKS:
            child = Node(name, node, drop)
            node.items.append(child)
            node = child
        else:
            node.tags += 1
        if name == "a":
            link += 1
            node.link_tags += 1
    if at < len(page):
        _text(node, page[at:], link)
    _prune(root)
    return root


def _prune(root: Node) -> None:
    """Takes dropped elements out; a named one stays if it holds most of the text outside links."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        node.items = [x for x in node.items if isinstance(x, str) or x.drop != GONE]
        order.append(node)
        stack.extend(x for x in node.items if isinstance(x, Node))
    if not any(node.drop for node in order):
        return
    plain: dict[Node, int] = {}
    for node in reversed(order):
        plain[node] = node.chars - node.links + sum(plain[x] for x in node.items if isinstance(x, Node))
    for node in order:
        node.items = [x for x in node.items if isinstance(x, str) or not x.drop or 2 * plain[x] > plain[root]]


def _text(node: Node, run: str, link: int) -> None:
    run = html.unescape(run) if "&" in run else run
    node.items.append(run)
    n = len(run.strip())
    node.chars += n
    if link > 0:
        node.links += n


def walk(root: Node) -> list[Node]:
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(x for x in reversed(node.items) if isinstance(x, Node))
    return order


def densities(root: Node) -> list[Node]:
    """Nodes in page order, each with the counts of its subtree and its composite density."""
    order = walk(root)
    for node in reversed(order):
        for x in node.items:
            if isinstance(x, Node):
                node.chars += x.chars
                node.links += x.links
                node.tags += x.tags + 1
                node.link_tags += x.link_tags
    whole = root.links / root.chars if root.chars else 0.0
    for node in order:
        if node.chars:
            c, lc, t, lt = node.chars, max(node.links, 1), max(node.tags, 1), max(node.link_tags, 1)
            base = math.log(c / max(c - node.links, 1) * node.links + whole * c + math.e)
            node.density = c / t * math.log(max(c / lc * t / lt, 1.0) + 1e-9) / math.log(max(base, 1.0) + 1.0)
            node.density = max(node.density, 0.0)
    return order


def main_node(root: Node) -> Node:
    order = densities(root)
    best, most = root, -1.0
    for node in order:
        inner = sum(x.density for x in node.items if isinstance(x, Node))
        own = sum(len(x.strip()) for x in node.items if isinstance(x, str))
        if own:
            inner = max(inner, node.density) if node.up is None or inner else node.density
        if inner > most:
            best, most = node, inner
    path = [best]
    while path[-1].up is not None:
        path.append(path[-1].up)
    threshold = min(n.density for n in path)
    title: dict[Node, int] = {}  # characters inside h1
    for node in reversed(order):
        title[node] = node.chars if node.name == "h1" else sum(title[x] for x in node.items if isinstance(x, Node))
    titled = title[best] > 0
    top = best
    for node in path[1:]:
        for x in node.items:
            if isinstance(x, str):
                more = bool(x.strip())
            elif x is top or x.chars <= 2 * x.links:
                more = False
            else:  # a title is short, so its density says nothing
                more = x.density >= threshold or 2 * title[x] > x.chars and not titled
            if more:
                best = node
                titled = titled or title[node] > 0
                break
        top = node
    return best


def main_text(page: str | None) -> str:
    """Main text of a page: its blocks in order, joined by one space; empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    out: list[str] = []
    main = main_node(root)
    stack: list = [main]
    within = main
    while within is not None and within.name != "article":
        within = within.up
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            # Inside the main part, a container that is mostly links is a menu, but not in an article
            # element: there it is a list of sources, or a part of the text.
            if within is None and x.name in ("ul", "ol", "div", "section", "table", "dl") and x.links * 2 > x.chars and x.link_tags > 1:
                continue
            out.append(" ")
            stack.append(" ")
            stack.extend(reversed(x.items))
    return " ".join("".join(out).split())


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = [main_text(h) for h in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                                         names=[*batch.schema.names[:-1], "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): one row per row of ``pages(page_id, url, html, ...)``.

    Null, empty and markup-only pages give an empty text; broken markup (unclosed, crossed or
    stray tags, open comments) is read leniently and to its end, also inside dropped elements. Null ids and urls, and repeated
    rows pass through one by one; extra columns are not read; nothing is cut off.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return arrow_map(pages.select("page_id", "url", "html"), _extract,
                     f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8 over all pages, as its contract states."""
    return extract_text(table(spark, sf_dir, "pages"))
