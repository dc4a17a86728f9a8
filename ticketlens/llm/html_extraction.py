"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read into blocks (runs of text between block-level tags) with their open elements. A
linear classifier gives every block a score from its own text and its ancestors. The labelling
then minimises the sum of

* terminal costs: a block with a positive score pays it for being called boilerplate, one with a
  negative score pays its size for being called content, and
* smoothness costs: neighbours in page order, and blocks under the same parent, pay for having
  different labels, more the closer they are in the element tree, nothing across the border of
  a landmark such as a navigation bar.

This is a minimum cut: terminal costs are capacities from the source and to the sink, smoothness
costs are capacities between blocks, and the blocks that stay connected to the source after a
maximum flow are the content. Blocks whose own cost exceeds all their edges have that label in
every minimum cut; they are settled first, and the flow runs on what is left.

Defined results: null counts as the empty page, with the empty text; broken mark-up (open tags
at the end, stray closing tags, a lone ``<``) never raises; equal pages have equal texts; an
empty table gives no rows. Pages of any length are read whole.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from math import log1p

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import slices, text_of

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)"
    r"(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*>)",
    re.S,
)
ATTRIBUTE = re.compile(r"(class|id|role|style|aria-hidden|hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
NAME_PART = re.compile(r"[a-z]+")

# Names of the HTML standard.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby "
    "s samp small span strike strong sub sup time tt u var wbr br img svg object "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mspace semantics".split()
)
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW = frozenset("script style noscript textarea title iframe".split())
#: What stands in drawings only.
DRAWN = frozenset("g path rect circle ellipse line polyline polygon text tspan defs use desc".split())
UNSEEN = RAW | frozenset("head template select option button datalist canvas audio video".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SELF_NESTING = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr"}, "th": {"tr"}}
LANDMARKS = frozenset("article main nav header footer aside form dialog".split())

# Words in class, id and role that speak for or against content.
GOOD_NAMES = frozenset("article body content entry main post story text".split())
BAD_NAMES = frozenset(
    "ad ads advert adverts advertisement alert banner breadcrumb breadcrumbs byline comment comments "
    "consent cookie cookies copyright disclaimer dialog disqus footer gdpr header hidden legal links login masthead "
    "menu modal nav navbar navigation newsletter notice outbrain overlay pager pagination popup promo "
    "promoted recommended related replies reply reviews search share sharing sidebar signup skip social sponsor "
    "sponsored subscribe subscription taboola tags toolbar widget".split()
)

#: Weights of the block classifier: plain numbers, chosen by hand and kept in one place.
WEIGHTS = {
    "bias": -0.6,
    "inside_article": 3.0,
    "inside_main": 2.0,
    "good_name": 1.2,
    "bad_name": -6.0,
    "nav": -7.0,
    "page_header": -5.0,
    "footer": -7.0,
    "aside": -6.0,
    "form": -6.0,
    "hidden": -8.0,
    "paragraph": 1.0,
    "heading": 0.4,
    "log_words": 0.45,
    "sentence": 0.5,
    "link_share": -3.5,
    "mark": -2.0,
}
ADJACENT, SIBLING = 0.8, 0.6


class Element:
    """An open element with what it inherits from those around it."""

    __slots__ = ("tag", "parent", "depth", "landmark", "unseen", "score", "article", "inline")

    def __init__(self, tag: str, attrs: str, parent: Element | None):
        good, bad, hidden = _hints(attrs)
        self.tag = tag
        self.parent = parent
        self.depth = parent.depth + 1 if parent else 1
        self.inline = tag in INLINE and not bad and not hidden
        self.landmark = self if tag in LANDMARKS or bad else parent.landmark if parent else None
        self.unseen = tag in UNSEEN or (parent is not None and parent.unseen)
        self.article = tag == "article" or (parent is not None and parent.article)
        # Each kind of evidence counts once, wherever on the way up it was found.
        seen = parent.score if parent else frozenset()
        own = {
            name
            for name, there in (
                ("inside_article", tag == "article"),
                ("inside_main", tag == "main"),
                ("good_name", good),
                ("bad_name", bad),
                ("hidden", hidden),
                (tag, tag in ("nav", "footer", "aside", "form")),
                ("page_header", tag == "header" and not self.article),
            )
            if there
        }
        self.score = seen | own if own else seen


class Block:
    __slots__ = ("parts", "linked", "parent", "text")

    def __init__(self, parent: Element | None):
        self.parts: list[str] = []
        self.linked = 0
        self.parent = parent
        self.text = ""


def _hints(attrs: str) -> tuple[bool, bool, bool]:
    """Whether class, id and role speak for content or for boilerplate; whether it is hidden."""
    names: set[str] = set()
    hidden = False
    if "=" in attrs or "hidden" in attrs:
        for m in ATTRIBUTE.finditer(attrs):
            key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if key == "style":
                flat = value.replace(" ", "")
                hidden |= "display:none" in flat or "visibility:hidden" in flat
            elif key == "aria-hidden":
                hidden |= value == "true"
            elif key == "hidden":
                hidden = True
            else:
                names.update(NAME_PART.findall(value))
    bad = not names.isdisjoint(BAD_NAMES)
    return not bad and not names.isdisjoint(GOOD_NAMES), bad, hidden


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks in page order, with white space folded and references decoded."""
    stack: list[Element] = []
    opened: dict[str, int] = {}
    blocks: list[Block] = []
    current: Block | None = None

    def add(raw: str) -> None:
        nonlocal current
        # Labels of a drawing inside a sentence are no text of it.
        if opened.get("svg"):
            return
        if current is None:
            if not raw or raw.isspace():
                return
            # Open inline elements are not part of a block's place in the tree.
            parent = stack[-1] if stack else None
            while parent is not None and parent.inline:
                parent = parent.parent
            if parent is not None and parent.unseen:
                return
            current = Block(parent)
            blocks.append(current)
        text = entities.unescape(raw) if "&" in raw else raw
        current.parts.append(text)
        if opened.get("a"):
            current.linked += len(text)

    def close(tag: str) -> None:
        if opened.get(tag):
            while True:
                top = stack.pop()
                opened[top.tag] -= 1
                if top.tag == tag:
                    return

    # Behind the last > no tag can end, so nothing is searched there.
    pos, size, last = 0, len(page), page.rfind(">")
    while pos < size:
        m = TOKEN.search(page, pos) if pos <= last else None
        if m is None:
            add(page[pos:])
            break
        if m.start() > pos:
            add(page[pos : m.start()])
        pos = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        # Parts of a drawing don't end the block that it stands in.
        inline = tag in INLINE or tag in DRAWN
        if not inline:
            current = None
        if m["end"]:
            close(tag)
            continue
        attrs = m["attrs"]
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, pos)
            pos = end.end() if end else size
            continue
        if tag == "br":
            if current is not None:
                current.parts.append(" ")
            continue
        if not inline:
            # A block ends a drawing or formula that was left open, as browsers have it.
            if tag in CLOSES_P:
                close("svg")
                close("math")
            if tag in CLOSES_P and opened.get("p"):
                close("p")
            around = SELF_NESTING.get(tag)
            if around and opened.get(tag):
                for e in reversed(stack):
                    if e.tag in around:
                        break
                    if e.tag == tag:
                        close(tag)
                        break
        if tag not in VOID and not attrs.endswith("/>"):
            stack.append(Element(tag, attrs, stack[-1] if stack else None))
            opened[tag] = opened.get(tag, 0) + 1
    for b in blocks:
        b.text = " ".join("".join(b.parts).split())
    return [b for b in blocks if b.text]


def score(block: Block) -> float:
    """Positive: content; negative: boilerplate."""
    w, parent, text = WEIGHTS, block.parent, block.text
    tag = parent.tag if parent else ""
    z = w["bias"]
    if parent:
        for name in parent.score:
            z += w[name]
    if tag in ("p", "blockquote", "pre"):
        z += w["paragraph"]
    elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        z += w["heading"]
    z += w["log_words"] * log1p(text.count(" ") + 1)
    if text[-1] in ".!?…»”\"":
        z += w["sentence"]
    z += w["link_share"] * min(1.0, block.linked / len(text))
    if text[0] == "©":
        z += w["mark"]
    return z


def _steps_apart(a: Element | None, b: Element | None) -> int:
    steps = 0
    while a is not b:
        if a is None or (b is not None and b.depth >= a.depth):
            b = b.parent
        else:
            a = a.parent
        steps += 1
    return steps


def smoothness(blocks: Sequence[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours in page order and between consecutive children of one parent."""
    edges = []
    last_child: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            x, y = blocks[i - 1].parent, b.parent
            if (x and x.landmark) is (y and y.landmark):
                edges.append((i - 1, i, ADJACENT / (1 + _steps_apart(x, y) / 2)))
        # A paragraph's element is its own; the parent that paragraphs share is one up.
        group = id(b.parent.parent) if b.parent and b.parent.parent else 0
        j = last_child.get(group)
        if j is not None and j != i - 1:
            edges.append((j, i, SIBLING))
        last_child[group] = i
    return edges


def min_cut(scores: Sequence[float], edges: Sequence[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the source's side of a minimum cut (the smallest such side)."""
    n = len(scores)
    links: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    around = [0.0] * n
    for a, b, c in edges:
        links[a].append((b, c))
        links[b].append((a, c))
        around[a] += c
        around[b] += c
    # Persistency: a node whose own cost outweighs its edges is settled, and its edges become
    # terminal costs of its neighbours.
    own, settled = list(scores), [None] * n
    todo = deque(i for i in range(n) if abs(own[i]) > around[i])
    while todo:
        i = todo.popleft()
        if settled[i] is not None:
            continue
        settled[i] = own[i] > 0
        for j, c in links[i]:
            if settled[j] is None:
                own[j] += c if settled[i] else -c
                around[j] -= c
                if abs(own[j]) > around[j]:
                    todo.append(j)
    rest = [i for i in range(n) if settled[i] is None]
    if rest:
        place = {node: k for k, node in enumerate(rest)}
        inner = [(place[a], place[b], c) for a, b, c in edges if a in place and b in place]
        for node, side in zip(rest, _max_flow([own[i] for i in rest], inner), strict=True):
            settled[node] = side
    return settled


def _max_flow(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Dinic's algorithm: source -> positive nodes, negative nodes -> sink, edges both ways."""
    n = len(scores)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def arc(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(forth)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, z in enumerate(scores):
        if z > 0:
            arc(source, i, z, 0.0)
        elif z < 0:
            arc(i, sink, -z, 0.0)
    for a, b, c in edges:
        arc(a, b, c, c)
    tiny = 1e-12
    while True:
        depth = [-1] * (n + 2)
        depth[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > tiny and depth[to[e]] < 0:
                    depth[to[e]] = depth[a] + 1
                    queue.append(to[e])
        if depth[sink] < 0:
            return [d >= 0 for d in depth[:n]]
        turn = [0] * (n + 2)
        path: list[int] = []
        at = source
        while True:
            if at == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                path, at = [], source
                continue
            while turn[at] < len(out[at]):
                e = out[at][turn[at]]
                if room[e] > tiny and depth[to[e]] == depth[at] + 1:
                    break
                turn[at] += 1
            if turn[at] < len(out[at]):
                path.append(out[at][turn[at]])
                at = to[path[-1]]
            elif at == source:
                break
            else:
                at = to[path.pop() ^ 1]
                turn[at] += 1


def extract(page: str) -> str:
    blocks = blocks_of(page)
    keep = min_cut([score(b) for b in blocks], smoothness(blocks))
    return "\n".join(b.text for b, content in zip(blocks, keep, strict=True) if content)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html"):
            texts = [extract(page) for page in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string())],
                ["page_id", "url", "text"],
            )


def extract_pages(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text_of(F.col(html_col)).alias("html")
    )
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = rows.mapInArrow(
        _extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string"
    )
    return out.withColumn("n_chars", F.char_length("text").cast("bigint"))
