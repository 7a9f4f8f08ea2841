r"""Main text of web pages by composite text density.

The page becomes a small DOM (unclosed p, li, td and the like are closed as browsers do); only what is never shown as
text (scripts, styles, the head, hidden elements, form fields) is left out of it. For every node, with C characters,
T tags, LC characters and LT tags in links (LCb and Cb: those of the body),

    density = C/T * log_{ln(C LC / (C - LC) + LCb C / Cb + e)}(C/LC * T/LT)     (zero denominators count as 1)

and its density sum is that of its children. The node of the greatest density sum is the text's root; the
least density on the path from it to the body is the threshold. From the body down, each node that reaches
the threshold gives the node of the greatest density sum below it: siblings of a divided article are found that way.
What stands between two parts of the text belongs to it unless most of it is links. If an article (else main) element
is around the root, it is completed to that element, and nothing outside is taken.

Menus, headers, footers, sidebars, notices, adverts, forms and reader comments (by tag, role, or a word of class or id)
are measured like the rest, but can't be the text's root, add nothing to a density sum, and are cut out of the chosen
parts. A form, or a part named by class or id alone, counts as text if it holds the page's text (``_give_back``). Words that
also name what an article says (LOOSE_WORDS) make a passage, or a part of an article, something else only if half of it is links or
it has a form's fields; labels and buttons are left out in forms only.

Text: character references decoded; white space inside a block becomes one space; blocks in page order,
joined by one \n. A heading inside the article's own header belongs to the article. Null, empty and text-free
pages give an empty text; markup that is never closed ends with the page. Every step is linear in the page's size.
"""

from __future__ import annotations

import html as references
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
#: What HTML says of these elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Which open elements a start tag ends, up to which element.
CLOSES = {
    "li": ("li", "ul ol menu dir"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "option": ("option", "select"),
    "tr": ("tr td th", "table"),
    "td": ("td th", "table tr"),
    "th": ("td th", "table tr"),
    "tbody": ("thead tbody tr td th", "table"),
    "tfoot": ("thead tbody tr td th", "table"),
}
#: Elements whose content is never shown as text, or is a form's field.
HIDDEN = frozenset("script style noscript iframe noembed noframes textarea title head template svg canvas object select datalist input".split())
#: Elements, roles and words of class or id that name a part as something beside the text.
SKIP = frozenset("nav aside footer menu dialog".split())
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
SKIP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification"
    " alert popup modal overlay sidebar sidebars aside nav navbar navigation menu menus breadcrumb breadcrumbs comment comments commentlist disqus reply"
    " replies respond share sharing social related recommended recommendations newsletter subscribe subscription signup footer masthead pagination"
    " pager widget widgets toolbar login search".split()
)
#: Of them, those of reader comments, which alone can be longer than what they are about.
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: Of them, those that also name what an article says; in one they make a part something else only with links or a form's fields.
LOOSE_WORDS = frozenset(
    "share sharing social related recommended recommendations newsletter subscribe subscription signup widget widgets login search reply replies"
    " respond promo promotion banner sponsor sponsored alert menu menus pager pagination toolbar".split()
)
#: Elements that hold a passage, not a part of a page.
PASSAGES = frozenset("p li dt dd td th h1 h2 h3 h4 h5 h6 blockquote pre figcaption caption span em strong b i a q cite code mark small time".split())
#: Fields of a form; in one, they and their labels are no text.
FIELDS = frozenset("input select textarea button label".split())
#: In one class name with such a word they say what the page has ("has-sidebar", "comments-open"), not what the part is.
STATE_WORDS = frozenset("has have with without no not enabled disabled open opened closed".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_WHOLE = frozenset("article main".split())


class Node:
    """firm: a part by its tag or role; name: the word of class or id (or "form") that makes it one; skip: out of the text."""

    __slots__ = (
        "tag", "parent", "children", "skip", "firm", "name", "out", "running", "own",
        "chars", "tags", "link_chars", "link_tags", "density", "total", "most", "best", "loose", "fields",
    )

    def __init__(self, tag: str, parent: "Node | None", firm: bool = False, name: str | None = None, loose: bool = False):
        self.tag, self.parent, self.firm, self.name, self.children = tag, parent, firm, name, []
        self.loose, self.fields = loose and name in LOOSE_WORDS, 0
        self.skip = firm or name is not None and tag not in _WHOLE


def _named(tag: str, attributes: str, in_article: bool, in_form: bool) -> tuple[bool, bool, str | None]:
    """Whether the element is hidden, whether it is a part beside the text for sure, and the name that may make it one."""
    if tag in HIDDEN:
        return True, False, None
    firm = tag in SKIP or tag == "header" and not in_article or in_form and tag in ("button", "label")
    found = "form" if tag == "form" else None
    for name, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'")
        if tag in ("html", "body"):
            firm |= name == "role" and value.lower() in SKIP_ROLES
            continue
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" and tag not in _WHOLE:
            return True, False, None
        if name == "role":
            firm |= value.lower() in SKIP_ROLES
            found = found or ("form" if value.lower() == "form" else None)
        if name in ("class", "id"):
            for part in value.split():
                words = [w.lower() for w in _WORD.findall(part)]
                if not STATE_WORDS.intersection(words):
                    found = found or next((w for w in words if w in SKIP_WORDS), None)
    return False, firm, found


class _Tags:
    """Where tags end: at the first > outside a quoted value. A page that runs out inside one is read without quotes from there on."""

    def __init__(self, page: str):
        self.page, self.quotes, self.gone, self.none_after = page, True, set(), len(page)

    def end(self, begin: int) -> int:
        """The place of the > of the tag whose name ends at ``begin``, or -1."""
        page = self.page
        if self.quotes:
            here = floor = begin
            while stop := _STOP.search(page, here):
                here = stop.end()
                if stop[0] == ">":
                    return stop.start()
                if page[max(floor, stop.start() - 40) : stop.start()].rstrip().endswith("="):
                    close = page.find(stop[0], here) if stop[0] not in self.gone else -1
                    if close < 0:
                        self.gone.add(stop[0])
                    else:
                        here = floor = close + 1
            self.quotes = False
        if begin >= self.none_after:
            return -1
        found = page.find(">", begin)
        if found < 0:
            self.none_after = begin
        return found


class _Open:
    """The open elements from the page's root down, and where each tag and each block is among them."""

    def __init__(self, root: Node):
        self.nodes, self.at, self.blocks = [root], {}, [0]

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, size: int) -> None:
        """Closes all but the first ``size`` elements."""
        while len(self.nodes) > size:
            node = self.nodes.pop()
            self.at[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()

    def last(self, tag: str) -> int:
        places = self.at.get(tag)
        return places[-1] if places else -1

    def end(self, tag: str) -> None:
        """An end tag; that of an inline element never closes blocks around it."""
        place = self.last(tag)
        if place > 0 and (tag in BLOCK or self.blocks[-1] < place):
            self.cut(place)

    def make_room(self, tag: str) -> None:
        """Closes what the start tag ends: an open p before a block, an open li before a li, and so on."""
        if tag in ("body", "head"):
            self.cut(1 + max(0, self.last("html")))
        elif tag in BLOCK and tag != "html" and self.last("head") > 0:
            self.cut(self.last("head"))
        elif tag in BLOCK and tag != "html" and self.nodes[self.blocks[-1]].tag == "p":
            self.cut(self.blocks[-1])
        if tag in CLOSES:
            closed, until = (x.split() for x in CLOSES[tag])
            floor = max(self.last(u) for u in until)
            first = [places[i] for c in closed if (places := self.at.get(c)) and (i := bisect_right(places, floor)) < len(places)]
            if first:
                self.cut(min(first))


def parse(page: str) -> Node:
    """The page's DOM; text is a str among a node's children."""
    root = Node("#page", None)
    opened, tags, position, size = _Open(root), _Tags(page), 0, len(page)

    def text(piece: str) -> None:
        if piece:
            opened.nodes[-1].children.append(piece)

    while position < size:
        start = page.find("<", position)
        if start < 0:
            text(page[position:])
            break
        text(page[position:start])
        position = start + 1
        if page.startswith("!--", position):
            end = page.find("-->", position + 1)
            position = end + 3 if end >= 0 else size
            continue
        if page.startswith("![CDATA[", position):
            end = page.find("]]>", position)
            text(page[position + 8 : end if end >= 0 else size])
            position = end + 3 if end >= 0 else size
            continue
        match = _NAME.match(page, position)
        if not match:
            if position < size and page[position] in "!?/":
                end = page.find(">", position)
                position = end + 1 if end >= 0 else size
            else:
                text("<")
            continue
        end = tags.end(match.end())
        if end < 0:
            text("<")
            continue
        attributes, position, tag = page[match.end() : end], end + 1, match[2].lower()
        if match[1]:
            if tag not in ("html", "body"):  # what follows them still is the body's
                opened.end(tag)
        elif not (tag in ("html", "body") and opened.last(tag) > 0):
            opened.make_room(tag)
            in_article = opened.last("article") > 0 or opened.last("main") > 0
            hidden, firm, name = _named(tag, attributes, in_article, opened.last("form") > 0)
            node = Node(tag, opened.nodes[-1], firm, name, in_article or tag in PASSAGES)
            node.parent.fields += tag in FIELDS
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, position)
                if not hidden:
                    node.children.append(page[position : close.start() if close else size])
                position = (page.find(">", close.end()) + 1 or size) if close else size
            elif tag not in VOID and not attributes.endswith("/"):
                opened.push(node)
            if not hidden:
                node.parent.children.append(node)
    return root


def _walk(root: Node) -> list[Node]:
    """All nodes, each before its children; ``out`` tells those in (or that are) a part beside the text."""
    found, open_nodes = [], [root]
    while open_nodes:
        node = open_nodes.pop()
        node.out = node.skip or node.parent is not None and node.parent.out
        found.append(node)
        open_nodes.extend(c for c in reversed(node.children) if not isinstance(c, str))
    return found


def _keep_loose(root: Node) -> None:
    """Lets parts with a loose name count as text unless half of their characters are in links, or they hold a form's fields."""
    nodes, open_nodes = [], [root]
    while open_nodes:
        node = open_nodes.pop()
        nodes.append(node)
        open_nodes.extend(c for c in node.children if not isinstance(c, str))
    for node in reversed(nodes):
        own = [c for c in node.children if not isinstance(c, str)]
        node.chars = sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str)) + sum(c.chars for c in own)
        node.link_chars = node.chars if node.tag == "a" else sum(c.link_chars for c in own)
        node.fields += sum(c.fields for c in own)
        if node.loose and not node.firm and node.tag != "form" and not node.fields and 2 * node.link_chars < node.chars:
            node.skip = False


def _give_back(root: Node) -> None:
    """Lets named parts count as text that hold the page's text.

    A part, or all parts of one name together, is text if it holds more than half of the characters outside links
    and reader comments, unless an article or main element beside named parts has a quarter as many and it has none.
    Reader comments are text if nothing else is.
    """
    nodes, open_nodes = [], [root]
    while open_nodes:
        node = open_nodes.pop()
        nodes.append(node)
        open_nodes.extend(c for c in reversed(node.children) if not isinstance(c, str) and not c.firm)
    named = [n for n in nodes if n.skip]
    if not named:
        return
    whole = [n for n in nodes if n.tag in _WHOLE]
    holds: set[int] = set()
    for node in whole:
        while node is not None and id(node) not in holds and (node.tag not in _WHOLE or node.name not in COMMENT_WORDS):
            holds.add(id(node))
            node = node.parent
    comments = {id(n) for n in named if n.name in COMMENT_WORDS and id(n) not in holds}
    for node in reversed(nodes):
        node.running = 0
        if node.tag != "a":
            texts = sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str))
            node.running = texts + sum(c.running for c in node.children if not isinstance(c, str) and not c.firm and id(c) not in comments)
    if not root.running:
        for node in named:
            node.skip = node.skip and id(node) not in comments
        return
    within = _within(nodes)
    beside = max((w.running for w in whole if id(w) not in within), default=0)

    def text(parts: list[Node]) -> bool:
        running = sum(n.running for n in parts)
        return 2 * running > root.running and (4 * beside < running or any(id(n) in holds for n in parts))

    groups: dict[str, list[Node]] = {}
    for node in named:
        if id(node) not in comments and text([node]):
            node.skip = False
    within = _within(nodes)
    for node in named:
        if node.skip and id(node) not in comments and id(node.parent) not in within:
            groups.setdefault(node.name, []).append(node)
    for parts in groups.values():
        if text(parts):
            for node in parts:
                node.skip = False


def _within(nodes: list[Node]) -> set[int]:
    """Of nodes in page order, those in a part beside the text, with the part itself."""
    out: set[int] = set()
    for node in nodes:
        if node.skip or id(node.parent) in out:
            out.add(id(node))
    return out


def _measure(nodes: list[Node], body: Node) -> None:
    """Densities of all nodes, their sums, and for each the node of the greatest sum at or below it (``best``, ``most``)."""
    for node in reversed(nodes):
        node.own = [c for c in node.children if not isinstance(c, str)]
        chars = sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str))
        tags = link_chars = link_tags = 0
        for c in node.own:
            chars += c.chars
            tags += c.tags + 1
            link_chars += c.link_chars
            link_tags += c.link_tags
        if node.tag == "a":
            link_chars, link_tags = chars, tags + 1
        node.chars, node.tags, node.link_chars, node.link_tags = chars, tags, link_chars, link_tags
    share = body.link_chars / max(body.chars, 1)
    for node in reversed(nodes):
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, share)
        own = [c for c in node.own if not c.out]
        node.total = sum(c.density for c in own)
        node.best, node.most = node, node.total
        for c in own:
            if c.most > node.most:
                node.best, node.most = c.best, c.most


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """The composite text density; ``share`` is the body's share of characters in links."""
    if not chars:
        return 0.0
    tags = max(tags, 1)
    base = math.log(math.log(chars * link_chars / max(chars - link_chars, 1) + share * chars + math.e))
    value = math.log(chars / max(link_chars, 1) * tags / max(link_tags, 1))
    return chars / tags * (value / base if base > 1e-12 else value)


def _choose(body: Node) -> set[int]:
    """The parts that hold the text."""
    best = body.best
    if not body.most > 0:  # text in one element only: no node has a child of positive density
        return {id(body)}
    threshold, node, article, main = best.density, best, None, None
    while node is not None and node is not body.parent:
        threshold = min(threshold, node.density)
        article = node if node.tag == "article" else article
        main = node if node.tag == "main" else main
        node = node.parent
    if article or main:
        return {id(article or main)}
    chosen, holds, open_nodes, order = {id(best)}, set(), [body], []
    while open_nodes:
        node = open_nodes.pop()
        order.append(node)
        if node.density >= threshold and node.chars:
            chosen.add(id(node.best if node.most > 0 else node))
        open_nodes.extend(c for c in node.own if not c.out)
    for node in reversed(order):
        at = [i for i, c in enumerate(node.own) if id(c) in chosen or id(c) in holds]
        if at:
            holds.add(id(node))
            # what stands between two parts of the text
            chosen.update(id(c) for c in node.own[at[0] : at[-1]] if id(c) not in holds and not c.out and 2 * c.link_chars <= c.chars)
    return chosen


def _blocks(body: Node, chosen: set[int]) -> list[str]:
    """The text of the chosen parts without what is beside it; of an article's header, its headings only."""
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join(references.unescape("".join(run)).split())
        run.clear()
        if text:
            blocks.append(text)

    open_nodes: list[tuple[object, bool, bool, bool]] = [(body, False, False, False)]
    while open_nodes:
        item, inside, header, heading = open_nodes.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            if inside and (not header or heading):
                run.append(item)
        else:
            if item.tag in BLOCK:
                flush()
                open_nodes.append((None, False, False, False))
            if item.tag == "br":
                run.append(" ")
            inside, header, heading = inside or id(item) in chosen, header or item.tag == "header", heading or item.tag in _HEADINGS
            open_nodes.extend((c, inside, header, heading) for c in reversed(item.children) if isinstance(c, str) or not c.skip)
    flush()
    return blocks


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    _keep_loose(root)
    _give_back(root)
    nodes = _walk(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    _measure(nodes, body)
    return "\n".join(_blocks(body, _choose(body))) if body.chars and not body.out else ""


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page.as_py()) for page in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each row; n_chars counts code points."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_run, "page_id long, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))
