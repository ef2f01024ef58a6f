"""Main text of web pages by minimum cut.

A page becomes a row of blocks: the runs of text between block-level tags.  A linear classifier (word lists
and weights that are set by hand) gives each block the log odds of being content from its tags, class names,
links, length and punctuation; they are the capacities from the source (content) or to the sink
(boilerplate).  Neighbouring blocks, and the nearest blocks of one parent, are joined by edges that are the
heavier the nearer the two are in the DOM and the more alike their shares of links.  The minimum cut, found
by maximum flow, labels the blocks with the least sum of classifier costs and of cut edges.

Time is about linear in the page: open elements are indexed by tag, blocks know their place by parent
pointers, blocks whose odds outweigh all their edges are labelled beforehand (they have that label in every
minimum cut), and flow is sent through what is left, one connected part at a time.

Inside a block character references are decoded and white space becomes one space; the blocks that are
content are joined by line feeds in page order.

Edge cases: null counts as an empty page and gives an empty text; broken markup (unclosed or stray tags,
cut-off pages) is read on; a page with boilerplate only gives an empty text; blocks of any length are
kept whole; repeated rows get equal texts.
"""

from __future__ import annotations

import html as html_module
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arglake.llm.common import strings

# Tags and words of class names, by what they mean for the text inside.
BLOCK_TAGS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = frozenset("script style noscript template svg math iframe object canvas audio video head select textarea button datalist map".split())
CLOSED_BY = {"p": BLOCK_TAGS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "option": frozenset(["option", "optgroup"])}
TAG_ODDS = {"nav": -6.0, "footer": -6.0, "aside": -6.0, "form": -6.0, "menu": -5.0, "dialog": -5.0, "header": -4.0, "fieldset": -4.0, "search": -6.0, "label": -4.0, "legend": -4.0, "article": 4.0, "main": 3.0, "blockquote": 1.0, "pre": 1.0}
WORD_ODDS = {w: -5.0 for w in "ad ads advert advertisement advertising adverts advertorial sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay toast newsletter subscribe subscription signup login signin register sidebar widget menu navbar nav navigation breadcrumb breadcrumbs pagination pager toc share sharing social follow related recommended recommendations trending popular comment comments commentlist disqus reply replies respond reader footer masthead topbar toolbar copyright legal disclaimer tags taglist hidden skip skiplink print".split()}
WORD_ODDS |= {w: 3.0 for w in "article articlebody entry post story content body text main maintext prose".split()}
PAIR = 0.6  # weight of an edge between two blocks of one parent

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe")}
_STOPS = re.compile(r"[.!?…。！？:;,]")


class Block:
    """A run of text: its element among the block-level ones (``node`` of ``Tree``), the evidence of the elements that it is
    in as a chain (odds, outer ones), innermost first, and the share of its characters that are in links."""

    __slots__ = ("evidence", "in_link", "node", "tag", "text")

    def __init__(self, text, tag, node, evidence, in_link):
        self.text, self.tag, self.node, self.evidence, self.in_link = text, tag, node, evidence, in_link


class Tree:
    """Parents and depths of the block-level elements; 0 is the page."""

    def __init__(self):
        self.parent, self.depth = [0], [0]

    def add(self, parent: int) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        return len(self.parent) - 1

    def distance(self, a: int, b: int) -> int:
        n = 0
        while a != b:
            if self.depth[a] < self.depth[b]:
                a, b = b, a
            a = self.parent[a]
            n += 1
        return n

    def home(self, b: Block) -> int:
        """The element that holds a block: its own one, or the one around a paragraph, a heading, an item."""
        return self.parent[b.node] if b.tag in _LEAVES else b.node


def _odds_of(tag: str, attributes: str, inside_article: bool) -> float:
    """Evidence of one element for (positive) or against its text."""
    odds = TAG_ODDS.get(tag, 0.0)
    if tag == "header" and inside_article:
        odds = 0.0
    if attributes and tag not in ("html", "body"):
        for name, value in _ATTRIBUTE.findall(attributes):
            name = name.lower()
            if name in ("class", "id", "role"):
                parts = [w.lower() for w in _NAME_PART.findall(value)]
                found = [WORD_ODDS[w] for w in parts if w in WORD_ODDS]
                if found:
                    odds += min(found) if min(found) < 0 else max(found)
            elif name == "hidden" or name == "aria-hidden" and "true" in value or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                odds -= 6.0
    return max(-8.0, min(8.0, odds))


_BARRIERS = frozenset(["table", "article", "main", "body"])


def blocks(page: str) -> tuple[list[Block], Tree]:
    """The text blocks of a page in order, and the tree of its elements."""
    out: list[Block] = []
    tree = Tree()
    # an open element: tag, node of the block-level element that it is or is in, evidence, silent, article, link
    stack: list[tuple[str, int, tuple | None, bool, bool, bool]] = []
    places: dict[str, list[int]] = {}  # of the open elements of each tag
    block_places: list[int] = []
    barriers: list[int] = []
    parts: list[str] = []
    linked = 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(html_module.unescape("".join(parts)).split())
            if text:
                tag = stack[block_places[-1]][0] if block_places else ""
                node, evidence = (stack[-1][1], stack[-1][2]) if stack else (0, None)
                out.append(Block(text, tag, node, evidence, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def add(text):
        nonlocal linked
        if text and not (stack and stack[-1][3]):
            parts.append(text)
            if stack and stack[-1][5]:
                linked += len(text.strip())

    def close_to(i):
        if block_places and block_places[-1] >= i:
            flush()
        while len(stack) > i:
            tag = stack.pop()[0]
            places[tag].pop()
            for found in (block_places, barriers):
                if found and found[-1] == len(stack):
                    found.pop()

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if places.get(tag):
                i = places[tag][-1]
                if tag in BLOCK_TAGS or not barriers or barriers[-1] <= i:  # an inline end tag does not leave these
                    close_to(i)
            elif tag == "p":
                flush()
            continue
        if tag in VOID_TAGS:
            if tag == "hr":
                flush()
            elif tag in ("br", "wbr", "img", "input"):
                add(" ")
            continue
        if tag in BLOCK_TAGS:
            if block_places and tag in CLOSED_BY.get(stack[block_places[-1]][0], ()):
                close_to(block_places[-1])
            flush()
        attributes = m[3] or ""
        if attributes.endswith("/") and tag not in BLOCK_TAGS:
            continue
        above = stack[-1] if stack else ("", 0, None, False, False, False)
        own = _odds_of(tag, attributes, above[4])
        node = tree.add(above[1]) if tag in BLOCK_TAGS else above[1]
        places.setdefault(tag, []).append(len(stack))
        if tag in BLOCK_TAGS:
            block_places.append(len(stack))
        if tag in _BARRIERS:
            barriers.append(len(stack))
        stack.append((tag, node, (own, above[2]) if own else above[2], above[3] or tag in SILENT_TAGS, above[4] or tag in ("article", "main"), above[5] or tag == "a"))
        if tag in _RAW_END:
            e = _RAW_END[tag].search(page, at)
            if tag not in SILENT_TAGS and not stack[-1][3]:
                add(page[at : e.start() if e else n])
            at = e.end() if e else n
            close_to(len(stack) - 1)
    flush()
    return out, tree


def log_odds(b: Block) -> float:
    """The classifier: log odds of content."""
    odds, weight, chain = 0.0, 1.0, b.evidence
    while chain and abs(odds) < 6 and weight > 1e-6:  # the innermost evidence first
        odds += weight * chain[0]
        weight *= 0.5
        chain = chain[1]
    n = b.text.count(" ") + 1
    odds += -0.8 + min(n, 40) / 20 + (0.5 if n >= 4 and _STOPS.search(b.text) else 0.0) - 4.0 * b.in_link
    if b.tag in ("p", "pre", "blockquote"):
        odds += 1.0
    elif b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        odds += 1.0 if b.in_link < 0.5 else 0.0
    elif b.tag == "title":
        odds -= 8.0
    if n < 30 and re.search(r"©|\(c\)|copyright|all rights reserved|cookie", b.text, re.I):
        odds -= 2.5
    return max(-9.0, min(9.0, odds))


_LEAVES = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 pre blockquote td th figcaption address".split())


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of the minimum cut: True on the source's side.

    ``odds[i]`` > 0 is a capacity from the source, < 0 one to the sink; ``edges`` are undirected.  A node whose capacity
    exceeds those of all its edges is on its terminal's side in every minimum cut: it is merged with the terminal, so
    that its edges add to its neighbours' capacities, which may decide these in turn.
    """
    n = len(odds)
    odds = list(odds)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        if w > 0 and i != j:
            near[i][j] = near[i].get(j, 0.0) + w
            near[j][i] = near[j].get(i, 0.0) + w
    label: list[bool | None] = [None] * n
    waiting = list(range(n))
    while waiting:
        i = waiting.pop()
        if label[i] is None and abs(odds[i]) > sum(near[i].values()) + 1e-9:
            label[i] = odds[i] > 0
            for j, w in near[i].items():
                odds[j] += w if label[i] else -w
                del near[j][i]
                waiting.append(j)
            near[i] = {}
    for i in range(n):
        if label[i] is None:
            part, at = [i], 0
            label[i] = False
            while at < len(part):
                for j in near[part[at]]:
                    if label[j] is None:
                        label[j] = False
                        part.append(j)
                at += 1
            for j in _source_side(part, odds, near):
                label[j] = True
    return label


def _source_side(part: list[int], odds: list[float], residual: list[dict[int, float]]) -> list[int]:
    """What the source still reaches in a connected part once no more flow can be sent; ``residual`` is used up.

    Flow is sent in phases: a breadth-first search gives all nodes their distance from the source, then paths that go
    one step farther at each node are filled until none is left.
    """
    supply = {i: max(0.0, odds[i]) for i in part}
    demand = {i: max(0.0, -odds[i]) for i in part}
    tiny = 1e-12
    while True:
        level = {i: 0 for i in part if supply[i] > tiny}
        queue, reached = deque(level), False
        while queue:
            i = queue.popleft()
            reached = reached or demand[i] > tiny
            for j, w in residual[i].items():
                if w > tiny and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not reached:
            return list(level)
        left = {i: list(residual[i]) for i in level}  # neighbours that a path may still go to
        for s in [i for i in level if level[i] == 0]:
            path = [s]
            while path and supply[s] > tiny:
                i = path[-1]
                if demand[i] > tiny:
                    flow = min(supply[s], demand[i], *(residual[x][y] for x, y in zip(path, path[1:])))
                    supply[s] -= flow
                    demand[i] -= flow
                    full = len(path) - 1
                    for k in range(len(path) - 2, -1, -1):
                        x, y = path[k], path[k + 1]
                        residual[x][y] -= flow
                        residual[y][x] += flow
                        if residual[x][y] <= tiny:
                            full = k
                    del path[full + 1 :]  # back to where the path is filled
                    continue
                while left[i] and not (level[left[i][-1]] == level[i] + 1 and residual[i][left[i][-1]] > tiny if left[i][-1] in level else False):
                    left[i].pop()
                if left[i]:
                    path.append(left[i][-1])
                else:
                    path.pop()
                    if path:
                        left[path[-1]].pop()


def edges_of(found: list[Block], tree: Tree) -> list[tuple[int, int, float]]:
    """Edges between neighbours (PAIR for blocks of one parent, less for each element between them), and between a block
    and the last one before its neighbour that has the same parent; the lighter, the less alike their shares of links."""
    edges, last = [], {}
    homes = [tree.home(b) for b in found]
    for i, b in enumerate(found):
        alike = lambda j: 1 - abs(found[j].in_link - b.in_link)  # noqa: B023, E731
        if i:
            edges.append((i - 1, i, PAIR * alike(i - 1) / (1 + tree.distance(homes[i - 1], homes[i]))))
        j = last.get(homes[i])
        if j is not None and j < i - 1:
            edges.append((j, i, PAIR / 2 * alike(j)))
        last[homes[i]] = i
    return edges


def main_text(page: str) -> str:
    found, tree = blocks(page)
    if not found:
        return ""
    labels = minimum_cut([log_odds(b) for b in found], edges_of(found, tree))
    return "\n".join(b.text for b, content in zip(found, labels) if content)


def extract(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages``."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in strings(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=schema)

    return pages.select(F.col(id_column).cast("long").alias("page_id"), F.col("url").cast("string"), html_column).mapInArrow(work, "page_id long, url string, text string, n_chars long")
