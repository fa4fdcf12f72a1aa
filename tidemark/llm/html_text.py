"""Main text of web pages by scoring the tree.

A page is read into a tree (unclosed and misnested tags included). Furniture is cut off:
scripts, styles, forms, menus, page headers and footers, sidebars, notices, adverts and reader
comments, by tag, role or the names in class and id. A name counts by its words: ``cookie-notice``
is a notice and ``ad-box`` an advert, but ``share-price`` is a price and ``commentary`` no comment.

Every paragraph then passes points for its length and its commas to its ancestors, halved at
each step up, and each container's sum is discounted by the share of its text inside links. The
container with the best score is kept, together with its siblings. The way up from there ends
at the ``article`` or ``main`` element that holds it; inside of that everything is kept but the
furniture. Without such an element, the nearest level with other text keeps whatever is not
mostly links, and levels above keep headings and what has scored paragraphs of its own.

All blocks of what is kept come out in page order, white space inside a block as one space,
character references decoded, joined by line ends.

Defined results: null and empty pages and pages without text give an empty text; repeated rows
give repeated rows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import slices

_TAG = re.compile(r"""<!--(?:.*?--!?>|.*)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAMES = frozenset({"class", "id", "role", "hidden", "aria-hidden", "style"})

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Content that is not markup; it ends at the closing tag only.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
PARAGRAPHS = frozenset("p pre td blockquote dd li".split())
#: What an opening tag closes, up to the elements that bound the search.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
CLOSES = {tag: (frozenset(a.split()), frozenset(b.split())) for tag, (a, b) in CLOSES.items()}
DROPPED = frozenset("script style noscript template head nav footer aside form button select textarea iframe object svg canvas menu dialog title".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
#: Words that make a class or id furniture when its name ends in one of them.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion promotions banner banners cookie cookies consent gdpr notice notices popup modal "
    "overlay newsletter subscribe subscription sidebar sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments commentlist disqus replies respond "
    "share sharing social pagination pager toolbar paywall signup login related recommended recommendations".split()
)
#: Words behind which the name of the thing stands: an ad box is an ad, a comment list comments.
SHELLS = frozenset(
    "area bar block body box button buttons container content form group holder icons inner item items links list module outer panel region row section slot text thread top unit wrap wrapper zone left right bottom".split()
)
#: What follows related, recommended and the like in the name of a list of other pages.
OTHERS = frozenset("articles content links news pages posts reads stories story".split())
OTHER_NAMES = frozenset("related recommended popular trending suggested".split())
#: Names that tell what an element has or lacks, and headers that belong to the article.
STATES = frozenset("has have with without no not is hide show".split())
OWN_HEADERS = frozenset("article post entry story content section".split())
#: The furniture that an ``article`` element may be itself.
IN_ARTICLES = frozenset("ad ads advert adverts advertisement comment comments reply replies sponsored promo related recommended".split())
_NAME_WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+").findall
#: A sibling of the best container, or what stands above it, stays when less than this part of its text is inside links.
LINKED = 0.4
#: Outside of articles, blocks of these tags are menus when at least this part of their text is inside links.
MENUS, MENU = frozenset("ul ol dl div section table".split()), 0.8
#: Points that a level above needs: a paragraph of forty characters has as many.
POINTS = 1.4


def names_furniture(name: str, words: frozenset[str] = FURNITURE) -> bool:
    """Whether a class or id names furniture, by the last word that is more than a shell."""
    parts = [word.lower() for word in _NAME_WORDS(name)]
    if not parts or parts[0] in STATES:
        return False
    if len(parts) > 1 and parts[-2] in OTHER_NAMES and parts[-1] in OTHERS:
        return bool(words & OTHER_NAMES)
    while len(parts) > 1 and parts[-1] in SHELLS:
        parts.pop()
    if parts[-1] == "header" and len(parts) > 1 and parts[-2] in OWN_HEADERS:
        return False
    return parts[-1] in words or (len(parts) > 1 and parts[0] in ("comment", "comments") and parts[-1] in ("author", "meta", "date", "reply"))


class Node:
    __slots__ = ("tag", "parent", "parts", "score", "chars", "linked", "dropped")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.parts: list[Node | str] = []
        self.score = 0.0
        self.chars = self.linked = 0


def _is_dropped(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is furniture; ``inside``: an article or main element is open."""
    if tag in DROPPED or (tag == "header" and not inside):
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    found = {}
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        if (name := name.lower()) in _NAMES:
            found.setdefault(name, unescape(a or b or c))
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or found.get("role", "").lower() in DROPPED_ROLES or re.search(r"display\s*:\s*none", found.get("style", "").lower()):
        return True
    words = IN_ARTICLES if tag == "article" else FURNITURE
    return any(names_furniture(name, words) for name in f"{found.get('class', '')} {found.get('id', '')}".split())


def parse(html: str) -> Node:
    """The tree of a page.

    Elements that are open are counted by tag, so that a closing tag without an open one costs nothing.
    """
    root = node = Node("#page", None)
    at = 0
    search = _TAG.search
    opened: dict[str, int] = {}
    missed: tuple[Node, str] | None = None  # the last closing tag that found nothing to close

    def leave(upper: Node) -> Node:
        """Close all that is open below ``upper``."""
        up = node
        while up is not upper:
            opened[up.tag] -= 1
            up = up.parent
        return upper

    while True:
        found = search(html, at)
        if found is None:
            if at < len(html):
                node.parts.append(html[at:])
            return root
        if found.start() > at:
            node.parts.append(html[at : found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            if opened.get(tag) and missed != (node, tag):
                up = node
                block = tag in BLOCKS
                while up is not None and up.tag != tag:
                    up = up.parent if block or up.tag not in BLOCKS else None
                if up is not None:
                    node = leave(up.parent)
                else:
                    missed = (node, tag)
            elif tag == "br":
                node.parts.append(" ")
            continue
        if tag in BLOCKS and opened.get("p"):
            up = node
            while up.tag not in BLOCKS and up.parent is not None:
                up = up.parent
            if up.tag == "p":  # a paragraph ends where the next block begins
                node = leave(up.parent)
        if tag in CLOSES:
            ends, bounds = CLOSES[tag]
            if left := sum(opened.get(end, 0) for end in ends):
                up, upper = node, node
                while left and up is not None and up.tag not in bounds:
                    if up.tag in ends:
                        upper = up.parent
                        left -= 1
                    up = up.parent
                node = leave(upper)
        if tag in VOID:
            node.parts.append(" " if tag == "br" else Node(tag, node))
            continue
        child = Node(tag, node, _is_dropped(tag, found[3], bool(opened.get("article") or opened.get("main"))))
        node.parts.append(child)
        if tag in RAW:
            end = re.compile(f"</{tag}[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
        elif not found[3].endswith("/") or tag not in ("svg", "path"):
            node = child
            opened[tag] = opened.get(tag, 0) + 1


def _measure(root: Node) -> list[Node]:
    """Set characters, linked characters and scores; the elements that are not furniture, in page order."""
    stack: list[tuple[Node, bool]] = [(root, False)]
    order: list[Node] = []
    while stack:
        node, seen = stack.pop()
        if node.dropped:
            continue
        if not seen:
            order.append(node)
            stack.append((node, True))
            stack.extend((part, False) for part in reversed(node.parts) if isinstance(part, Node))
            continue
        commas = inline = 0
        for part in node.parts:
            if isinstance(part, str):
                text = len(part.strip())
                node.chars += text
                inline += text
                commas += part.count(",")
            elif not part.dropped:
                node.chars += part.chars
                node.linked += part.linked
                inline += part.chars - part.linked if part.tag not in BLOCKS else 0
        if node.tag == "a":
            node.linked = node.chars
        told = node.chars - node.linked
        points = 1 + commas + told / 100 if told else 0.0
        if node.tag in PARAGRAPHS:
            if node.parent is not None:
                node.parent.score += points
        elif node.tag in BLOCKS and inline and not re.fullmatch("h[1-6]", node.tag):
            node.score += 1 + commas + inline / 100
        # children come before their parents here, so what they have passed up is complete
        if node.parent is not None:
            node.parent.score += node.score / 2
    return order


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _blocks(nodes: list[Node | str]) -> Iterator[str]:
    """The texts of all blocks in page order."""
    held: list[str] = []
    for top in nodes:
        stack: list[Node | str | None] = [top]
        while stack:
            part = stack.pop()
            if isinstance(part, str):
                held.append(part)
                continue
            if part is None or part.tag in BLOCKS:
                if held:
                    yield "".join(held)
                    held = []
                if part is None:
                    continue
            if part.dropped:
                continue
            if part.tag in BLOCKS:
                stack.append(None)
            stack.extend(reversed(part.parts))
    if held:
        yield "".join(held)


def _has_text(part: Node | str) -> bool:
    return bool(part.strip()) if isinstance(part, str) else not part.dropped and part.chars > 0


def _drop_menus(top: Node) -> None:
    """Take out the blocks that are links and next to nothing else."""
    stack = [top]
    while stack:
        for part in stack.pop().parts:
            if isinstance(part, Node) and not part.dropped:
                part.dropped = part.tag in MENUS and _density(part) >= MENU
                stack.append(part)


def _with_siblings(best: Node) -> list[Node | str]:
    """What is kept: the best container, and on the way up what stands beside it."""
    bound = best
    while bound is not None and bound.tag not in ("article", "main"):
        bound = bound.parent
    if bound is not None:
        return [bound]
    kept: list[Node | str] = [best]
    up, nearest = best, True
    while up.parent is not None and up.tag not in ("html", "body"):
        beside = [part for part in up.parent.parts if part is not up and _has_text(part)]

        def stays(part: Node | str) -> bool:
            if isinstance(part, str) or part.tag not in BLOCKS:
                return nearest or up.parent.tag not in ("html", "body", "#page")
            if _density(part) >= LINKED:
                return False
            return nearest or bool(re.fullmatch("h[1-6]", part.tag)) or part.score * (1 - _density(part)) >= POINTS

        places = {id(part): i for i, part in enumerate(up.parent.parts)}
        own = places[id(up)]
        staying = [part for part in beside if stays(part)]
        kept = [p for p in staying if places[id(p)] < own] + kept + [p for p in staying if places[id(p)] > own]
        nearest = nearest and not beside
        up = up.parent
    for part in kept:
        if isinstance(part, Node):
            _drop_menus(part)
    return kept


def extract(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    root = parse(html)
    best, most = root, 0.0
    for node in _measure(root):
        if node.tag in BLOCKS and node.chars and node.tag not in ("html", "body"):
            score = node.score * (1 - _density(node))
            if score and score >= most:  # of equals the inner one
                best, most = node, score
    texts = (" ".join(unescape(block).split()) for block in _blocks(_with_siblings(best)))
    return "\n".join(text for text in texts if text)


def main_text(df: DataFrame, html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    read = df.select("page_id", "url", F.col(html).alias("html"))
    schema = T.StructType([read.schema["page_id"], read.schema["url"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [extract(value.as_py()) for value in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return read.mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))
