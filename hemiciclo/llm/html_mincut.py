"""Main text of web pages by a minimum cut between content and boilerplate blocks."""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+|\d+")
#: Elements whose content is no text of the page.
_DROPPED = frozenset("script style noscript template svg math iframe object canvas audio video title textarea select datalist".split())
#: Of these, those that hold characters only: without an end tag they last to the end of the page. An unclosed one of the others is passed over.
_RAW = frozenset("script style iframe title textarea".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that stay within a block; all others begin and end one.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em embed font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: What an open element of the same kind is closed by.
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_WALLS = frozenset("ul ol dl table body html div section article".split())
#: Elements that the end tag of an inline element does not reach beyond.
_BLOCK_WALLS = _CLOSES_P | frozenset("html body li dt dd tr td th table tbody thead tfoot caption option button legend".split())

#: Weights of the block classifier, as log odds for content.
_TAG_ODDS = {"nav": -9, "footer": -9, "aside": -9, "form": -9, "menu": -9, "dialog": -9, "button": -9, "fieldset": -9, "article": 2.5, "main": 2.0}
_BLOCK_ODDS = {"p": 1.0, "blockquote": 1.0, "pre": 1.0, "h1": 0.8, "h2": 0.3, "h3": 0.3, "h4": 0.3, "h5": 0.2, "h6": 0.2, "li": -0.3, "dd": 0.0, "td": -0.3, "figcaption": 0.2, "label": -8, "legend": -8, "option": -9, "caption": 0.0, "html": 0.2, "body": 0.2, "article": 0.2, "main": 0.2, "section": 0.0}
_ROLE_ODDS = {"navigation": -9, "banner": -8, "contentinfo": -9, "complementary": -9, "search": -9, "dialog": -9, "alertdialog": -9, "alert": -8, "status": -8, "form": -9, "menu": -9, "menubar": -9, "main": 2.0, "article": 2.0}
_BAD_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising banner banners sponsor sponsored promo promotion promoted nav
    navbar navigation menu menus breadcrumb breadcrumbs header masthead topbar footer sidebar aside cookie cookies consent
    gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup share sharing social
    related recommended recommendations recirculation comment comments commentlist disqus reply replies respond widget
    widgets pagination pager toolbar login search skip copyright legal disclaimer alert paywall outbrain taboola popular
    trending adbox adslot adunit adwrap adcontainer adsbygoogle adsense googleads topnav sidenav subnav mainnav crumbs
    feedback survey poll donate donation discussion""".split()
)
_GOOD_NAMES = frozenset("article articlebody body content entry main post story text prose".split())
_NAME_ODDS = -8.0
_CUE = re.compile(r"©|\bcookies?\b|all rights reserved|\bsubscribe\b|\bsign up\b|\blog in\b", re.I)

#: Cuts between blocks cost: next to each other, and in one parent; both shrink with the steps between them in the tree.
ADJACENT, SIBLING = 2.4, 1.6
SCALE = 1000
#: Elements below this depth hang on the last one above it, so that climbing to an ancestor takes bounded time.
MAX_DEPTH = 512
#: Pages that are Python strings at a time.
BATCH = 64


@dataclass
class Element:
    tag: str
    parent: Element | None
    odds: float = 0.0
    names_odds: float = 0.0
    depth: int = 0
    chars: int = 0
    has_title: bool = False
    in_article: bool = False
    good: float = 0.0  # the best odds above 0, and the sum of the others, of the element and those it is in
    bad: float = 0.0


@dataclass
class Block:
    parent: Element
    parts: list[str] = field(default_factory=list)
    link_chars: int = 0
    text: str = ""


def _attributes(raw: str) -> dict[str, str]:
    return {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTRIBUTE.findall(raw)}


def _open(tag: str, raw: str, parent: Element | None) -> Element:
    e = Element(tag, parent, _TAG_ODDS.get(tag, 0.0), 0.0, parent.depth + 1 if parent else 0)
    e.in_article = tag in ("article", "main") or (parent is not None and parent.in_article)
    if tag == "header":
        e.odds = -0.5 if e.in_article else -8
    if raw.strip() and tag not in ("html", "body"):
        known = _attributes(raw)
        e.odds += _ROLE_ODDS.get(known.get("role", "").lower(), 0.0)
        style = known.get("style", "").replace(" ", "").lower()
        if "hidden" in known or known.get("aria-hidden") == "true" or "display:none" in style:
            e.odds -= 9
        names = f"{known.get('class', '')} {known.get('id', '')} {known.get('itemprop', '')}"
        words = {w.lower() for w in _WORD.findall(names)}
        if _GOOD_NAMES.intersection(names.lower().split()):  # one of the names, whole
            e.odds += 1.0
        elif words & _BAD_NAMES:
            e.names_odds = _NAME_ODDS
        elif words & _GOOD_NAMES:
            e.odds += 0.5
    return e


class Tags:
    """The tags of a page, one after the other, in time that grows with its length, whatever is left open."""

    _START = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--|[!?])")
    _NEXT = re.compile(r"[>\"']")
    _VALUE = re.compile(r"=\s*\Z")

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in (">", '"', "'")}
        self.ends: dict[str, list[int]] = {}

    def _close(self, at: int) -> int:
        """The place of the > that ends the tag at `at`, -1 for none; quoted values may hold others, but a quote that is never closed is a character like others."""
        while True:
            if at > self.last[">"]:
                return -1
            m = self._NEXT.search(self.page, at)
            if m[0] == ">":
                return m.start()
            at = m.end()
            if at <= self.last[m[0]] and self._VALUE.search(self.page, max(0, at - 40), at - 1):
                at = self.page.index(m[0], at) + 1

    def find(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """Start, end, name ("" for comments and declarations), whether an end tag, attributes of the first tag from `at`; None for no more."""
        while m := self._START.search(self.page, at):
            if m[0] == "<!--":
                end = self.page.find("-->", m.end())
                return m.start(), len(self.page) if end < 0 else end + 3, "", False, ""
            if (end := self._close(m.end())) < 0:
                return None
            return m.start(), end + 1, (m[2] or "").lower(), bool(m[1]), self.page[m.end() : end]
        return None

    def after(self, tag: str, at: int) -> int:
        """The place after the first end tag of `tag` from `at`, -1 if there is none."""
        if tag not in self.ends:
            self.ends[tag] = [m.start() for m in re.finditer(rf"</{re.escape(tag)}[\s/>]", self.page, re.I)]
        ends = self.ends[tag]
        k = bisect_left(ends, at)
        return -1 if k == len(ends) else self.page.find(">", ends[k]) + 1 or len(self.page)


def blocks_of(page: str) -> list[Block]:
    """Runs of text that no block-level tag interrupts, in page order, with their place in the tree; those without a word are left out."""
    here = Element("html", None)
    elements, opened = [here], Counter()
    found: list[Block] = []
    block: Block | None = None
    links, at, n, tags = 0, 0, len(page), Tags(page)

    def text(raw: str) -> None:
        nonlocal block
        if raw:
            if block is None:
                if not raw.strip():
                    return
                block = Block(here)
                found.append(block)
            block.parts.append(raw)
            if links:
                block.link_chars += len(raw.strip())

    def go_in(tag: str, raw: str) -> None:
        nonlocal here
        if here.depth >= MAX_DEPTH and here.parent is not None:
            go_up(here.parent)
        here = _open(tag, raw, here)
        elements.append(here)
        opened[tag] += 1

    def go_up(to: Element) -> None:
        nonlocal here
        while here is not to:
            opened[here.tag] -= 1
            here = here.parent

    def close(kinds: frozenset[str] | set[str], walls: frozenset[str]) -> None:
        """Closes the innermost open element of one of these kinds, if no wall is further in."""
        if any(opened[k] for k in kinds):
            e: Element | None = here
            while e is not None and e.tag not in kinds and e.tag not in walls:
                e = e.parent
            if e is not None and e.tag in kinds and e.parent is not None:
                go_up(e.parent)

    while at < n:
        if (m := tags.find(at)) is None:
            text(html.unescape(page[at:]))
            break
        start, end, tag, is_end, raw = m
        if start > at:
            text(html.unescape(page[at:start]))
        at = end
        if not tag:
            continue
        if is_end:
            close({tag}, frozenset() if tag not in _INLINE else _BLOCK_WALLS)
            if tag == "a":
                links = max(0, links - 1)
            if tag not in _INLINE:
                block = None
            continue
        if tag in _DROPPED:
            if not raw.endswith("/") or tag in _RAW:
                past = tags.after(tag, at)
                at = past if past >= 0 else n if tag in _RAW else at
            if tag in ("select", "datalist", "svg", "math"):
                text(" ")
            continue
        if tag in _VOID:
            if tag == "br":
                text(" ")
            elif tag not in _INLINE:
                block = None
            continue
        if tag in _INLINE:
            links += tag == "a"
            if tag == "label":
                block = None
                go_in(tag, raw)
            elif raw.strip():
                e = _open(tag, raw, here)
                if e.odds < 0 or e.names_odds:
                    block = None
                    go_in(tag, raw)
            continue
        block = None
        if tag in _CLOSES_P:
            close({"p"}, _WALLS)
        if tag in _SIBLINGS:
            close(_SIBLINGS[tag], _WALLS)
        if tag == "main":  # stands in none of these, so they were left open
            close({"nav", "aside", "header", "footer"}, frozenset())
        if tag in ("html", "body", "head") and here.tag in ("html", "body", "head"):
            if tag == "body":
                go_in("body", "")
            continue
        links = 0
        go_in(tag, raw)
        if raw.endswith("/") and here.parent is not None:
            go_up(here.parent)
    for b in found:
        b.text = " ".join("".join(b.parts).split())
    found = [b for b in found if b.text]
    for b in found:
        b.parent.chars += len(b.text)
        b.parent.has_title |= b.parent.tag == "h1"
    for e in reversed(elements):
        if e.parent is not None:
            e.parent.chars += e.chars
            e.parent.has_title |= e.has_title
    total = elements[0].chars
    for e in elements:  # bad names of an element that holds the page's title and most of its text (a wrapper) do not count
        e.good, e.bad = (e.parent.good, e.parent.bad) if e.parent is not None else (0.0, 0.0)
        e.good, e.bad = max(e.good, e.odds), e.bad + min(0.0, e.odds)
        if not (e.has_title and e.chars > 0.4 * total):
            e.bad += e.names_odds
    return found


def content_odds(block: Block) -> float:
    """Log odds that a block is content, from its ancestors, its length, its share of links and its wording."""
    odds = _BLOCK_ODDS.get(block.parent.tag, -0.3) + block.parent.bad + block.parent.good
    words = block.text.count(" ") + 1
    odds += min(1.5, 0.05 * words) - 4.0 * min(1.0, block.link_chars / len(block.text))
    if block.text[-1] in ".!?…:;\"”»":
        odds += 0.5
    if words < 25 and _CUE.search(block.text):
        odds -= 2.0
    return odds


def _steps(a: Element, b: Element) -> int:
    """Steps between two elements in the tree."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a, n = a.parent, n + 1
        else:
            b, n = b.parent, n + 1
    return n


def minimum_cut(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """For each node, whether it stands on the source's side of the least cut with the fewest source-side nodes.

    source, sink: capacities from the source to each node and from it to the sink; edges: (i, j, capacity) both ways.
    What a node can pass straight from source to sink is taken off first. The rest flows in phases: distances from all
    nodes that have something left, then every path along them, each edge looked at once a phase. Flow between blocks
    is local, as edges carry less than most blocks have, so phases are few.
    """
    n = len(source)
    spare = [a - b for a, b in zip(source, sink, strict=True)]  # above 0: left from the source; below: left to the sink
    room: list[dict[int, int]] = [{} for _ in range(n)]
    for i, j, c in edges:
        if i != j and c > 0:
            room[i][j] = room[i].get(j, 0) + c
            room[j][i] = room[j].get(i, 0) + c
    near = [list(r) for r in room]
    while True:
        far = [-1] * n
        queue = [i for i in range(n) if spare[i] > 0]
        for i in queue:
            far[i] = 0
        reached = False
        for i in queue:
            if spare[i] < 0:
                reached = True
                continue
            for j in near[i]:
                if far[j] < 0 and room[i][j] > 0:
                    far[j] = far[i] + 1
                    queue.append(j)
        if not reached:
            return [d >= 0 for d in far]
        tried = [0] * n
        for first in queue:
            if far[first]:
                break
            path = [first]
            while path and spare[first] > 0:
                i = path[-1]
                if spare[i] < 0:
                    push = min(spare[first], -spare[i], *(room[a][b] for a, b in zip(path, path[1:], strict=False)))
                    spare[first] -= push
                    spare[i] += push
                    full = 0
                    for k in range(len(path) - 1, 0, -1):
                        a, b = path[k - 1], path[k]
                        room[a][b] -= push
                        room[b][a] += push
                        if not room[a][b]:
                            full = k
                    path = path[:full] if full else path[:-1] if not spare[i] else path
                    continue
                while tried[i] < len(near[i]) and not (far[near[i][tried[i]]] == far[i] + 1 and room[i][near[i][tried[i]]] > 0):
                    tried[i] += 1
                if tried[i] < len(near[i]):
                    path.append(near[i][tried[i]])
                else:
                    far[i] = -2  # a dead end for this phase
                    path.pop()


def cut_blocks(blocks: list[Block]) -> tuple[list[float], list[bool]]:
    """Log odds of each block by itself, and whether the cut calls it content."""
    odds = [max(-30.0, min(30.0, content_odds(b))) for b in blocks]
    keep_cost = [int(SCALE * math.log1p(math.exp(-z))) for z in odds]  # paid by a block that is called content
    drop_cost = [int(SCALE * math.log1p(math.exp(z))) for z in odds]
    edges = []
    last_in: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, int(SCALE * ADJACENT / (1 + _steps(blocks[i - 1].parent, b.parent)))))
        up = b.parent.parent or b.parent
        if (j := last_in.get(id(up))) is not None:
            edges.append((j, i, int(SCALE * SIBLING / (1 + _steps(blocks[j].parent, b.parent)))))
        last_in[id(up)] = i
    return odds, minimum_cut(drop_cost, keep_cost, edges)


def main_text(page: str | None) -> str:
    """The content blocks' texts, joined by one space."""
    if not page:
        return ""
    blocks = blocks_of(page)
    return " ".join(b.text for b, c in zip(blocks, cut_blocks(blocks)[1], strict=True) if c)


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) for every row.

    NULL and empty pages, and pages without content blocks, have the empty text. Repeated rows are extracted each;
    other columns, whatever their names, are not looked at; an empty table gives no rows. Blocks whose two labels cost
    the same are boilerplate. One narrow pass; a page of any length is one graph of its blocks.
    """

    @F.arrow_udf("string")
    def texts(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in pages:
            yield pa.array([main_text(p) for at in range(0, len(batch), BATCH) for p in batch.slice(at, BATCH).to_pylist()], pa.string())

    found = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), texts(html_col).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
