"""Main-text extraction from HTML by minimum cut.

A page becomes blocks: runs of text between block-level tags, in page order, with the elements that hold them. The core
of a page is the article or main element with the most plain text (else the parent with most), preferring one that lies
in nothing called a menu, comments or the like. A linear classifier turns what a block says of itself (the best and the
worst of the elements that hold it, by tag, role, class and id words; whether the core holds it; how much of it is link
text; its length and stops) into a cost of calling it content or boilerplate: the capacities to the two terminals.
What an element is called does not count against it if it holds the core, so a wrapper named after its layout condemns
nothing. Smoothness edges join blocks that follow each other and, more strongly, blocks with the same parent or
grandparent; together they weigh at most 16, so a block whose own cost is below that goes with its neighbours and one
named plainly (30) does not. The minimum cut, found by maximum flow, is the labelling of least cost; the content side is
the text.

A page is one row and its graph has at most three edges per block, so memory is bounded by the page.

Defined cases: null or empty html gives an empty text; text outside any element counts, as does that of a page without
any sign of either kind; unclosed and stray tags are
put right as browsers do for paragraphs and list items; the insides of script, style and the like, comments and the
head never count; null ids and repeated rows are extracted like any other; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML by their role.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "select", "svg", "iframe", "object", "math", "title", "button", "canvas", "audio", "video")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTENT_TAGS = {"article": 10, "main": 6}
BOILER_TAGS = {"nav": 30, "footer": 30, "aside": 30, "form": 30, "menu": 30, "dialog": 30, "fieldset": 20, "header": 30, "address": 4}
GOOD_WORDS = frozenset("article articlebody content post entry main story body text prose".split())
BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promoted nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead "
    "cookie cookies consent notice gdpr popup modal overlay comment comments reply replies disqus respond thread threads discussion share sharing social related recommended widget "
    "newsletter subscribe signup login search pagination pager copyright legal disclaimer toolbar skip hidden".split()
)
#: In one name with a word of the list above they tell of a state or a layout, not of what the element is.
STATES = frozenset("has with without no not is open opened closed layout overflow enabled disabled".split())
GOOD_ROLES = frozenset(("main", "article"))
BAD_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"))
BAD, GOOD_WORD, PARAGRAPH, HEADING, STOP, LINKS = 30, 4, 3, 2, 1, 14
OUTSIDE_ARTICLE, OUTSIDE = 8, 2  # of a core that is marked up as such, and of one that is only the largest
NEXT, SAME_PARENT, SAME_GRANDPARENT = 2, 4, 2

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
_RAW_END = {t: re.compile(rf"</{t}\s*>|\Z", re.I) for t in RAW}
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: An open element of the left kind ends where one of the right kind starts.
_CLOSES = {"p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr",)), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "option": frozenset(("option",))}


class Node:
    """An element: what speaks for and against it by its own tag and attributes, its plain text with all it holds."""

    __slots__ = ("tag", "up", "good", "bad", "marked", "size", "index", "last", "bads", "best", "worst", "inside")

    def __init__(self, tag: str, up: Node | None, attrs: str, index: int):
        self.tag, self.up, self.index, self.last, self.size = tag, up, index, index, 0
        self.good, self.bad, self.marked = _evidence(tag, attrs)


def _evidence(tag: str, attrs: str) -> tuple[int, int, bool]:
    good, bad, marked = CONTENT_TAGS.get(tag, 0), BOILER_TAGS.get(tag, 0), tag in CONTENT_TAGS
    if attrs and tag not in ("html", "body"):
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'")
            if name == "role":
                marked |= value.lower() in GOOD_ROLES
                good = max(good, CONTENT_TAGS["main"] * (value.lower() in GOOD_ROLES))
                bad = max(bad, BAD * (value.lower() in BAD_ROLES))
            elif name == "hidden" or name == "aria-hidden":
                bad = max(bad, BAD * (value.lower() != "false"))
            else:
                for called in value.split():
                    words = set(_SPLIT.split(_CAMEL.sub(" ", called).lower()))
                    if words & BAD_WORDS and not words & STATES:
                        bad = BAD
                    elif words & GOOD_WORDS:
                        good = max(good, GOOD_WORD)
    return good, bad, marked


class Block:
    __slots__ = ("text", "link", "node")

    def __init__(self, text: str, link: int, node: Node):
        self.text, self.link, self.node = text, link, node


def blocks(page: str) -> tuple[list[Block], list[Node]]:
    """Blocks and elements, both in page order."""
    out: list[Block] = []
    root = node = Node("", None, "", 0)
    nodes = [root]
    parts: list[str] = []
    link, anchors, pos, n = 0, 0, 0, len(page)

    def end() -> None:
        nonlocal link
        if parts:
            raw = "".join(parts)
            text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append(Block(text, link, node))
            parts.clear()
        link = 0

    while pos < n:
        m = _TOKEN.match(page, pos)
        pos = m.end()
        tag = m[2]
        if tag is None:
            s = m[0]
            if s[0] != "<" or len(s) == 1:
                parts.append(s)
                if anchors:
                    link += len(s)
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                anchors = max(0, anchors - 1)
            elif tag not in INLINE and tag not in VOID:
                end()
                at = node
                while at is not root and at.tag != tag:
                    at = at.up
                if at is not root:
                    node = at.up
            continue
        if tag in _RAW_END and not m[3].endswith("/"):
            stop = _RAW_END[tag].search(page, pos)
            pos = stop.end()
            if tag not in ("button", "svg", "math"):
                end()
            continue
        if tag == "a":
            anchors += 1
        elif tag == "br":
            parts.append(" ")
        elif tag not in INLINE:
            end()
            anchors = 0
            if node.tag in _CLOSES and tag in _CLOSES[node.tag]:
                node = node.up
            if tag not in VOID:
                node = Node(tag, node, m[3], len(nodes))
                nodes.append(node)
    end()
    return out, nodes


def core_of(found: list[Block], nodes: list[Node]) -> Node:
    """The element that holds the main text, as far as elements tell. Sets sizes and how many elements called something
    that is boilerplate hold each element."""
    own = [0] * len(nodes)
    for b in found:
        b.node.size += (plain := max(0, len(b.text) - b.link))
        own[b.node.up.index if b.node.tag in ("p", "li", *HEADINGS) and b.node.up else b.node.index] += plain
    for x in reversed(nodes[1:]):
        x.up.size += x.size
        x.up.last = max(x.up.last, x.last)
    for x in nodes:
        x.bads = (x.up.bads if x.up else 0) + (x.bad >= BOILER_TAGS["fieldset"])
    marked = [x for x in nodes if x.marked and x.bad < BOILER_TAGS["fieldset"] and x.size]
    if not marked:
        return min(nodes, key=lambda x: (x.bads, -own[x.index], x.index) if own[x.index] else (len(nodes), 0, x.index))
    core = min(marked, key=lambda x: (x.bads, -x.size, x.index))
    for x in marked:  # the innermost that has most of it
        if core.index < x.index <= core.last and x.bads == core.bads and 2 * x.size >= core.size:
            core = x
    return core


def costs(found: list[Block], nodes: list[Node]) -> list[tuple[int, int]]:
    """(cost of boilerplate, cost of content) of each block."""
    if not found:
        return []
    core = core_of(found, nodes)
    away = OUTSIDE_ARTICLE if core.marked else OUTSIDE
    for x in nodes:
        around = x.index <= core.index <= x.last
        x.inside = core.index <= x.index <= core.last
        bad = 0 if around else x.bad if x.tag != "header" or not x.inside else 4
        x.best = max(x.up.best if x.up else 0, x.good)
        x.worst = max(x.up.worst if x.up else 0, bad)
    out = []
    for b in found:
        x, words, dense = b.node, b.text.count(" ") + 1, min(1.0, b.link / max(1, len(b.text)))
        score = 1 + x.best - x.worst - away * (not x.inside) + min(6, words // 8) - int(LINKS * dense)
        score += PARAGRAPH * (x.tag in ("p", "pre", "blockquote")) + HEADING * (x.tag in HEADINGS) + STOP * (b.text[-1] in ".!?:;…\"”")
        out.append((score, 0) if score > 0 else (0, -score))
    return out


class Flow:
    """Maximum flow by level graphs and blocking paths, without recursion."""

    def __init__(self, n: int):
        self.to: list[int] = []
        self.room: list[int] = []
        self.out: list[list[int]] = [[] for _ in range(n)]

    def edge(self, a: int, b: int, there: int, back: int) -> None:
        self.out[a].append(len(self.to))
        self.to.append(b)
        self.room.append(there)
        self.out[b].append(len(self.to))
        self.to.append(a)
        self.room.append(back)

    def levels(self, s: int) -> list[int]:
        level = [-1] * len(self.out)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in self.out[a]:
                if self.room[e] and level[self.to[e]] < 0:
                    level[self.to[e]] = level[a] + 1
                    queue.append(self.to[e])
        return level

    def source_side(self, s: int, t: int) -> list[bool]:
        while (level := self.levels(s))[t] >= 0:
            at = [0] * len(self.out)
            path: list[int] = []
            a = s
            while True:
                if a == t:
                    least = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    first = next(i for i, e in enumerate(path) if not self.room[e])
                    a = self.to[path[first] ^ 1]
                    del path[first:]
                    continue
                while at[a] < len(self.out[a]):
                    e = self.out[a][at[a]]
                    if self.room[e] and level[self.to[e]] == level[a] + 1:
                        break
                    at[a] += 1
                else:
                    if a == s:
                        break
                    e = path.pop()
                    a = self.to[e ^ 1]
                    at[a] += 1
                    continue
                path.append(e)
                a = self.to[e]
        return [x >= 0 for x in level]


def label(found: list[Block], nodes: list[Node]) -> list[bool]:
    """Content or not, by minimum cut. Where all blocks lean one way, that is the cut."""
    terms = costs(found, nodes)
    if all(a > 0 for a, _ in terms) or not any(a > 0 for a, _ in terms):
        return [a > 0 for a, _ in terms]
    n = len(found)
    g = Flow(n + 2)
    s, t = n, n + 1
    last_in: dict[tuple[int, int], int] = {}
    for i, (b, (content, boiler)) in enumerate(zip(found, terms, strict=True)):
        if content:
            g.edge(s, i, content, 0)
        if boiler:
            g.edge(i, t, boiler, 0)
        if i:
            g.edge(i - 1, i, NEXT, NEXT)
        for depth, weight in ((1, SAME_PARENT), (2, SAME_GRANDPARENT)):
            up = b.node
            for _ in range(depth):
                up = up.up if up is not None else None
            if up is not None and up.tag not in ("", "html", "body"):
                j = last_in.get((depth, id(up)))
                if j is not None:
                    g.edge(j, i, weight, weight)
                last_in[depth, id(up)] = i
    return g.source_side(s, t)[:n]


def extract_text(page: str | None) -> str:
    if not page:
        return ""
    found, nodes = blocks(page)
    return "\n".join(b.text for b, keep in zip(found, label(found, nodes), strict=True) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: (page_id, url, text, n_chars)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["_id", "_url", "text", "n_chars"])

    rows = pages.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{url_col}`").alias("_url"), F.col(f"`{html_col}`").cast("string").alias("_html"))
    types = dict(rows.dtypes)
    made = rows.mapInArrow(run, f"_id {types['_id']}, _url {types['_url']}, text string, n_chars bigint")
    return made.withColumnRenamed("_id", id_col).withColumnRenamed("_url", url_col)
