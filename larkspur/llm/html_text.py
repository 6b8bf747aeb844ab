"""Main text of web pages by tag-path ratios.

A page is cut into text leaves; a leaf's path is its block-level tags from the root with their classes. For each path
the characters, the punctuation and the linked characters of its leaves are added up; ratio = characters and
punctuation per leaf. Ratios are smoothed over neighbouring leaves and fused (their product, less the linked share);
leaves whose ratio reaches a threshold, from the mean, are content. The content node is the deepest container that has
nearly all characters of these leaves; it grows to its parent as long as that adds headings or content leaves only, and to
the article element that it lies in. Its text is kept whole, short paragraphs and headings included, but for leaves of low
ratio that are mostly links.

Before that, tags, roles and class words exclude, but choose nothing: leaves inside navigation, footers, asides, forms, dialogs,
hidden nodes and headers outside an article; and inside a node one of whose class or id names has no other words than
those of such parts (advert, menu, sidebar, cookie, ...) and words of layout (box, list, top, ...). Names of comments and
headers do not count on text blocks, a header's not where it holds the page's h1, and no mark counts where its node holds
most of the text that the ratios of all leaves choose, unless an article stands outside all marks. A head ends where its body
begins, closed or not. Scripts, styles, comments and markup are dropped; character references are decoded; white space inside a
block becomes one space; blocks are joined by a space.

Scale: one scan, no shuffle, memory of one batch of pages; time is linear in the page, however deep it is (the patterns
don't backtrack, sums go up and marks go down the nodes once, paths are numbers). Defined results: a null page or one
without text gives an empty text; repeated rows are extracted each; an empty table gives none; further columns are kept,
but for text and n_chars.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# Fixed values of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style noscript template textarea title select option svg math iframe object canvas audio video datalist xmp noframes".split()
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES = {  # a start tag ends an open element of these, up to the nearest of the borders
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
}
P_ENDS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote ul ol li dl dt dd figure figcaption table tr td th caption hgroup address".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
# What is not content, by tag, by role, and by words of class or id
OTHER_TAGS = frozenset("nav header footer aside form dialog button fieldset menu".split())
OTHER_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form status toolbar tablist".split()
)
HEADER_WORDS = frozenset("header masthead topbar".split())
COMMENT_WORDS = frozenset("comment comments reply replies respond disqus discussion".split())
OTHER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promotion promoted "
    "nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager toc skip "
    "footer bottombar copyright colophon "
    "sidebar aside widget widgets related recommended recommendations teaser teasers trending popular "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay dialog disclaimer "
    "form search login signup subscribe subscription newsletter share sharing social follow tags hidden".split()
)
LAYOUT_WORDS = frozenset(
    "site page main global primary secondary box list block wrapper wrap container section area bar slot top bottom left right "
    "item items inner outer group row column col panel unit post article content links buttons policy thread user reader".split()
)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({'|'.join(RAW)})(?=[\s/>])(?:[^>\"']++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+>(?:(?<=/>)|.*?(?:</\1\s*>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)>"
    r"|<[!?/][^<>]*>?"
    r"|[^<]+|<",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPLIT = re.compile(r"[^a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？¿¡]")


#: What may stand in a page's head; anything else begins its body.
HEAD_TAGS = frozenset("head meta link base".split())
#: Start tags that close an open element share these groups.
GROUPS = ("li", "dt", "tr", "td")
GROUP_OF = {"li": 0, "dt": 1, "dd": 1, "tr": 2, "td": 3, "th": 3}
EDGES = [frozenset((*CLOSES[g][0], *CLOSES[g][1])) for g in GROUPS]


class Node:
    """hard: its own tag, role or style says that it is not content; soft: its class or id does (talk: as that of
    readers' comments); header: that of a header does; stops: for each of GROUPS, how deep in the stack the nearest element stands that ends the search."""

    __slots__ = ("tag", "parent", "hard", "soft", "talk", "header", "main", "path", "stops", "chars", "weight", "weak", "h1", "flag")

    def __init__(self, tag: str, parent: Node | None, paths: dict, depth: int = 0, attributes: str = ""):
        self.tag, self.parent = tag, parent
        self.chars = self.weight = self.weak = 0
        self.h1 = self.flag = False
        main = bool(parent and parent.main)
        self.main = main or tag in ("article", "main")
        self.hard = tag in OTHER_TAGS and not (tag == "header" and main)
        self.soft = self.header = self.talk = False
        self.stops = parent.stops if parent else (-1, -1, -1, -1)
        if any(tag in e for e in EDGES):
            self.stops = tuple(depth if tag in e else old for e, old in zip(EDGES, self.stops, strict=True))
        mark = ""
        if attributes:
            for name, *values in ATTRIBUTE.findall(attributes):
                name, value = name.lower(), next((v for v in values if v), "")
                low = value.lower()
                if name in ("class", "id"):
                    mark += "." + low.strip()
                    if tag not in ("html", "body"):
                        self._named(value)
                elif name == "role":
                    self.hard = self.hard or low in OTHER_ROLES and tag not in ("html", "body")
                    self.main = self.main or low in ("main", "article")
                elif name == "itemprop":
                    self.main = self.main or low == "articlebody"
                    self.hard = self.hard or low == "comment"
                elif name == "style":
                    self.hard = self.hard or "display:none" in low.replace(" ", "")
                elif name == "hidden" or name == "aria-hidden" and low == "true":
                    self.hard = True
        key = (parent.path if parent else -1, tag + mark)
        self.path = paths.setdefault(key, len(paths))

    def _named(self, value: str) -> None:
        block = self.tag in TEXT_BLOCKS
        for token in value.split():
            found = {w for w in SPLIT.split(CAMEL.sub(" ", token).lower()) if w}
            rest = found - LAYOUT_WORDS
            if not rest:
                continue
            if rest <= OTHER_WORDS or not block and rest <= OTHER_WORDS | COMMENT_WORDS:
                self.soft, self.talk = True, self.talk or bool(rest & COMMENT_WORDS)
            elif not block and rest <= OTHER_WORDS | COMMENT_WORDS | HEADER_WORDS:
                self.header = True


def leaves(page: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """All block nodes, parents first; (block node, text with white space made single, linked characters) of every text
    leaf, in page order."""
    paths: dict = {}
    root = Node("", None, paths)
    nodes: list[Node] = [root]
    stack: list[Node] = [root]
    open_tags: Counter = Counter()
    found: list[tuple[Node, str, int]] = []
    parts: list[str] = []
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append((stack[-1], text, linked))
            parts.clear()
        linked = 0

    def close(at: int) -> None:
        for node in stack[at:]:
            open_tags[node.tag] -= 1
        del stack[at:]

    def close_nearest(tag: str) -> None:
        at = len(stack) - 1
        while stack[at].tag != tag:
            at -= 1
        close(at)

    for m in TOKEN.finditer(page):
        tag = m.group(3)
        if tag is None:
            piece = m.group(0)
            if piece[0] != "<" or len(piece) == 1:
                if open_tags["head"] and not piece.isspace():
                    close_nearest("head")
                piece = html.unescape(piece) if "&" in piece else piece
                parts.append(piece)
                if links:
                    linked += len(piece.strip())
            elif m.group(1) and m.group(1).lower() not in ("script", "style", "title", "head"):
                parts.append(" ")
            continue
        tag = tag.lower()
        if m.group(2):
            if tag in INLINE:
                links -= tag == "a" and links > 0
                continue
            flush()
            if open_tags[tag]:
                close_nearest(tag)
            continue
        if open_tags["head"] and tag not in HEAD_TAGS:
            close_nearest("head")
        empty = m.group(4).rstrip().endswith("/")
        if tag in INLINE and tag not in VOID:
            links += tag == "a" and not empty
            continue
        if tag == "wbr":
            continue
        flush()
        if tag in VOID or tag in ("html", "body") and open_tags[tag]:
            continue
        if tag in P_ENDS and stack[-1].tag == "p":
            close(len(stack) - 1)
        if tag in GROUP_OF:
            at = stack[-1].stops[GROUP_OF[tag]]
            if at > 0 and stack[at].tag in CLOSES[tag][0]:
                close(at)
        if empty:
            continue
        if tag in ("p", "li", "article", "section", "div"):
            links = 0
        node = Node(tag, stack[-1], paths, len(stack), m.group(4))
        nodes.append(node)
        stack.append(node)
        open_tags[tag] += 1
    flush()
    return nodes, found


def fused_ratios(found: list[tuple[Node, str, int]]) -> list[float]:
    """The fused, smoothed tag-path ratio of each leaf."""
    sums: dict[int, list[int]] = {}
    for node, text, linked in found:
        s = sums.setdefault(node.path, [0, 0, 0, 0])
        s[0] += len(text)
        s[1] += len(PUNCTUATION.findall(text))
        s[2] += min(linked, len(text))
        s[3] += 1
    per = [sums[node.path] for node, _, _ in found]
    chars = [s[0] / s[3] for s in per]
    stops = [s[1] / s[3] for s in per]

    def smooth(x: list[float]) -> list[float]:
        n = len(x)
        return [(2 * x[i] + x[max(0, i - 1)] + x[min(n - 1, i + 1)]) / 4 for i in range(n)]

    return [
        c * (1 + p) * (1 - s[2] / max(1, s[0])) for c, p, s in zip(smooth(chars), smooth(stops), per, strict=True)
    ]


def content_leaves(nodes: list[Node], found: list[tuple[Node, str, int]]) -> list[tuple[Node, str, int]]:
    """Leaves that nothing marks as something else. What a mark says does not count where its node holds most of the text that
    the ratios choose and there is no article outside all marks: a form round the whole page, a class that names the layout
    ("sidebar-right"); within an article, where hardly any of it stands outside: its text in a box called "popular"."""
    if not found:
        return []
    ratios = fused_ratios(found)
    threshold = 0.5 * sum(ratios) / len(ratios)
    hidden = {id(nodes[0]): False}
    for n in nodes[1:]:
        hidden[id(n)] = hidden[id(n.parent)] or n.hard
    for (node, text, _), r in zip(found, ratios, strict=True):
        node.chars += len(text) * (r >= threshold)
        node.h1 = node.h1 or node.tag == "h1" and not hidden[id(node)]
    for n in reversed(nodes):
        n.soft = n.soft or n.header and not n.h1
        if n.parent:
            n.parent.chars += n.chars
            n.parent.h1 = n.parent.h1 or n.h1
    most, plain = 0.6 * nodes[0].chars, 0
    if any((n.hard or n.soft) and n.chars > most for n in nodes):
        clean = {id(nodes[0]): True}
        for n in nodes[1:]:
            clean[id(n)] = clean[id(n.parent)] and not n.hard and not n.soft
        plain = sum(len(text) for node, text, _ in found if node.main and clean[id(node)])

    def void(n: Node) -> bool:
        return n.chars > most and (plain < 0.05 * nodes[0].chars and not n.talk if n.main else not plain)

    for n in nodes:
        n.flag = bool(n.parent and n.parent.flag) or (n.hard or n.soft) and not void(n)
    return [x for x in found if not x[0].flag]


def content_node(nodes: list[Node], found: list[tuple[Node, str, int]], content: list[bool]) -> Node:
    """The node that the content leaves point to."""
    for (node, text, _), chosen in zip(found, content, strict=True):
        node.weight += len(text) * chosen
        node.weak += not chosen and node.tag not in HEADINGS
    for n in reversed(nodes):
        if n.parent:
            n.parent.weight += n.weight
            n.parent.weak += n.weak
    best = nodes[0]
    for n in nodes:
        if n.parent is best and n.weight >= 0.9 * nodes[0].weight:
            best = n
    while best.parent and best.tag in TEXT_BLOCKS:
        best = best.parent
    while best.parent and best.parent.weak == best.weak:
        best = best.parent
    above = best
    while above and above.tag != "article":
        above = above.parent
    return above or best


def main_text(page: str | None) -> str:
    """The main text of a page."""
    nodes, found = leaves(page or "")
    found = content_leaves(nodes, found)
    if not found:
        return ""
    ratios = fused_ratios(found)
    threshold = 0.5 * sum(ratios) / len(ratios)
    best = content_node(nodes, found, [r >= threshold for r in ratios])
    for n in nodes:
        n.flag = n is best or bool(n.parent and n.parent.flag)
    return " ".join(
        text
        for (node, text, linked), r in zip(found, ratios, strict=True)
        if node.flag and (r >= 0.1 * threshold or linked * 2 < len(text))
    )


def extract(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """The rows of ``pages`` without the html, with text and n_chars (columns of those names are replaced)."""
    from pyspark.sql import types as T

    kept = [c for c in pages.columns if c not in (html_column, "text", "n_chars")]
    frame = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(html_column).alias("__html"))
    schema = T.StructType([*pages.select(*[F.col(f"`{c}`") for c in kept]).schema.fields])
    schema.add("text", T.StringType()).add("n_chars", T.LongType())

    def run(batches):
        for batch in slices(batches):
            texts = [main_text(h) for h in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*kept, "text", "n_chars"],
            )

    return frame.mapInArrow(run, schema)
