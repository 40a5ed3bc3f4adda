"""Main text of HTML pages by minimum-cut labelling.

A page is cut into blocks, the stretches of text between block-level tags. For each block a fixed linear
classifier (enclosing elements, names of their classes, length, link share, sentence ends) weighs content against
boilerplate; its two costs are the capacities from the source and to the sink. Neighbouring blocks and
consecutive blocks of one parent are joined by edges that are the stronger the closer the blocks are in
the document tree. The minimum cut, found by augmenting paths, gives the cheapest labelling as a whole, so
a short line between paragraphs stays with them and a long teaser between links does not.

Before the flow, blocks whose cost difference outweighs all their edges are settled, which leaves few.

Each page is one row's work and no row needs another: nothing is shuffled, memory is that of one page.

Cases: a NULL or empty page and a page without content give an empty text; repeated rows are extracted
each; unclosed, stray and odd tags do no harm; very long pages are read whole; an empty table gives an
empty result; other columns are carried along.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import map_arrow, whole_text

# Attributes by their grammar: a quote counts only where it begins a value, and only if it is closed before white space or the
# end of the tag; a quote left open ends with the white space or ">" that comes next.
_VALUE = r"(?:\"[^\"]*+\"(?=[\s/>]|\Z)|'[^']*+'(?=[\s/>]|\Z)|[^\s>]*+)"
_ATTRS = rf"(?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+{_VALUE})?+|=)*+"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>script|style|noscript|textarea|iframe|title)(?=[\s/>]){_ATTRS}(?:>|\Z)"
    rf".*?(?:</(?P=raw)(?=[\s/>])[^>]*+>|\Z)|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*+)(?P<attrs>{_ATTRS})(?:>|\Z)|<[!?/][^>]*+>?",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|[\"']?([^\s>]+)))?", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
# What a wrapper says of its layout: "has-sidebar", "page-with-ads".
_LAYOUT = re.compile(r"(?<![a-z0-9])(?:has|no|with|without)[^a-z0-9].*", re.S)
_SPACE = re.compile(r"\s+")

BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul button".split()
)
# Elements whose inside is no text of the page, but elements: one that is not closed ends with the element around it or where a block begins.
EMBEDDED = set("svg object canvas video audio select template annotation annotation-xml".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NOISE_TAGS = set("nav footer aside form menu dialog button fieldset search head".split())
MAIN_TAGS = {"article", "main"}
NOISE_WORDS = set(
    "ad ads advert adverts advertisement advertising banner banners sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr notice notices "
    "notification notifications alert popup modal overlay newsletter subscribe subscription signup share sharing social sidebar sidebars widget widgets menu menus nav navbar "
    "navigation breadcrumb breadcrumbs footer masthead comment comments disqus reply replies respond related recommended recommendations pagination pager login "
    "register search toolbar topbar skip tags taglist byline disclaimer copyright".split()
)
# A main element does not win over these when they enclose it: comments and teasers are articles of their own.
OUTER_NOISE = set("comment comments disqus replies respond related recommended recommendations sidebar".split())
MAIN_WORDS = set("article content post entry story main body text".split())
ROLES = {"navigation": -1, "banner": -1, "contentinfo": -1, "complementary": -1, "search": -1, "form": -1, "alert": -1, "dialog": -1, "main": 1, "article": 1}
# A start tag that ends an open element of these kinds.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = {"ul", "ol", "dl", "table", "select", "menu"}
ITEMS = LISTS.union(*CLOSES.values())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

# Weights of the classifier, in nats of log-odds for content.
BIAS, IN_MAIN, OUTSIDE_MAIN, IN_NOISE, LENGTH, LINKS, SENTENCE, HEADING, NAMED_MAIN = -1.0, 4.0, -3.0, -9.0, 0.9, -4.0, 0.8, 0.6, 1.5
NEXT_TO, SAME_PARENT = 1.0, 0.8


@dataclass
class Element:
    """An open block-level element; ``kind`` is 1 inside main content, -1 inside noise, 0 elsewhere (the innermost says)."""

    tag: str
    number: int
    depth: int
    kind: int
    outer: bool
    named: bool
    parent: Element | None
    item: Element | None = None  # the innermost list or table part at or above it


@dataclass
class Block:
    parent: Element
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _element(tag: str, attrs: str, parent: Element | None, number: int) -> Element:
    kind, outer, named = (parent.kind, parent.outer, parent.named) if parent else (0, False, False)
    own = 0
    if tag in MAIN_TAGS:
        own = 1
    elif tag in NOISE_TAGS or (tag == "header" and kind != 1):
        own = -1
    role, main, noise, hidden = 0, False, False, False
    if attrs:
        for name, *values in _ATTRIBUTE.findall(attrs):
            value, name = "".join(values).lower(), name.lower()
            if name in ("class", "id"):
                whole = set(value.split())
                words = set(_SPLIT.split(value))
                if whole & OUTER_NOISE or (words & OUTER_NOISE and tag in MAIN_TAGS):
                    outer = True
                for one in whole:
                    words = set(_SPLIT.split(_LAYOUT.sub("", one)))
                    noise = noise or bool(words & NOISE_WORDS)
                    # "post-comments" are comments, "post" beside another name stays a post.
                    main = main or bool(words & MAIN_WORDS and (tag in MAIN_TAGS or not words & NOISE_WORDS))
            elif name == "role":
                role = ROLES.get(value.strip(), role)
            elif (name == "hidden" and tag != "body") or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
                hidden = True
    if noise and not main and tag not in ("body", "html", "main"):
        own = -1
    elif main and (not noise or tag in MAIN_TAGS or tag in ("body", "html")):
        named = True
    own = -1 if hidden else role or own
    made = Element(tag, number, parent.depth + 1 if parent else 0, own or kind, outer, named, parent)
    made.item = made if tag in ITEMS else parent and parent.item
    return made


def _ends(tokens: list[re.Match]) -> dict[int, int]:
    """For each embedded element that is closed inside the element around it, by the number of its start tag: that of its end tag."""
    ends, stack, count = {}, [], Counter()
    for i, m in enumerate(tokens):
        tag = (m["tag"] or "").lower()
        if tag not in EMBEDDED and (tag not in BLOCK or tag in VOID):
            continue
        if not m["close"]:
            if tag != "svg" or not m["attrs"].endswith("/"):
                stack.append((tag, i))
                count[tag] += 1
        elif count[tag]:
            while True:
                name, at = stack.pop()
                count[name] -= 1
                if name == tag:
                    break
            if tag in EMBEDDED:
                ends[at] = i
    return ends


def blocks_of(html: str) -> list[Block]:
    """Blocks with text, in page order."""
    root = top = Element("", 0, 0, 0, False, False, None)
    opened: Counter[str] = Counter()  # open elements by tag: an end tag without one is not looked for
    number, links, at = 0, 0, 0
    found, current, muted = [], None, False

    def add(raw: str) -> None:
        nonlocal current
        if not raw or muted:
            return
        if current is None:
            if raw.isspace():
                return
            current = Block(top)
            found.append(current)
        text = unescape(raw) if "&" in raw else raw
        current.pieces.append(text)
        if links:
            current.linked += len(text)

    def leave(last: Callable[[Element], bool]) -> Element:
        """End open elements up to the first that is ``last``; what is around it."""
        e = top
        while True:
            opened[e.tag] -= 1
            if last(e):
                return e.parent
            e = e.parent

    tokens = list(_TOKEN.finditer(html))
    ends, skipped = _ends(tokens), -1
    for i, m in enumerate(tokens):
        if i <= skipped:
            at = m.end()
            continue
        add(html[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:  # comment, declaration or an element whose inside is no text
            continue
        tag = tag.lower()
        if tag == "a":
            links = 0 if m["close"] else 1
        elif tag == "br":
            add(" ")
        elif tag in EMBEDDED:
            if i in ends:
                skipped = ends[i]
            else:
                muted = not m["close"] and not m["attrs"].endswith("/")
        elif tag in BLOCK or tag in NOISE_TAGS:
            current = None
            muted = muted and tag == "option"
            if m["close"]:
                if opened[tag]:
                    top = leave(lambda e, tag=tag: e.tag == tag)
                    links = 0
            elif tag not in VOID:
                links = 0
                if top.tag == "p" or (top.tag in HEADINGS and tag in HEADINGS):
                    top = leave(lambda e: True)
                closing = CLOSES.get(tag)
                if closing:
                    item = top.item
                    while item is not None and item.tag not in closing and item.tag not in LISTS:
                        item = item.parent.item
                    if item is not None and item.tag in closing:
                        top = leave(lambda e, item=item: e is item)
                number += 1
                top = _element(tag, m["attrs"], top, number)
                opened[tag] += 1
    add(html[at:])
    out = []
    for b in found:
        b.text = _SPACE.sub(" ", "".join(b.pieces)).strip()
        if b.text:
            out.append(b)
    return out


def classify(b: Block, has_main: bool) -> float:
    """Log-odds for content; ``has_main``: some block of the page stands inside a main element."""
    e, n = b.parent, len(b.text)
    s = BIAS + LENGTH * math.log1p(n / 25) + LINKS * min(1.0, b.linked / max(n, 1))
    if b.text[-1] in ".!?…\"”»":
        s += SENTENCE
    if e.tag in HEADINGS:
        s += HEADING
    if e.named:
        s += NAMED_MAIN
    if e.kind < 0 or e.outer:
        s += IN_NOISE
    elif e.kind > 0:
        s += IN_MAIN
    elif has_main:
        s += OUTSIDE_MAIN
    return s


def _distance(a: Element, b: Element) -> int:
    """Steps between two elements in the document tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth and a.parent is not None:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def edges_of(blocks: list[Block]) -> list[dict[int, float]]:
    """Smoothness edges, for each block its neighbours and weights."""
    near: list[dict[int, float]] = [{} for _ in blocks]

    def join(i: int, j: int, weight: float) -> None:
        near[i][j] = near[i].get(j, 0.0) + weight
        near[j][i] = near[j].get(i, 0.0) + weight

    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            join(i - 1, i, NEXT_TO / (1 + _distance(blocks[i - 1].parent, b.parent)))
        above = (b.parent.parent or b.parent).number
        if above in last:
            join(last[above], i, SAME_PARENT)
        last[above] = i
    return near


def minimum_cut(gain: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Labels (True: content) of least cost: a block labelled against its gain costs its size, an edge that is cut its weight."""
    n = len(gain)
    label: list[bool | None] = [None] * n
    gain, near = list(gain), [dict(x) for x in near]
    waiting = deque(range(n))
    while waiting:  # settle what no edge can turn; its edges then pull at the others
        i = waiting.popleft()
        if label[i] is not None or abs(gain[i]) < sum(near[i].values()):
            continue
        label[i] = gain[i] >= 0
        for j, w in near[i].items():
            if label[j] is None:
                gain[j] += w if label[i] else -w
                del near[j][i]
                waiting.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        reached = _source_side(rest, gain, near)
        for i in rest:
            label[i] = i in reached
    return [bool(x) for x in label]


def _source_side(rest: list[int], gain: list[float], near: list[dict[int, float]]) -> set[int]:
    """Blocks on the source's side of a minimum cut, by augmenting paths along shortest distances, all of one length in one go."""
    place = {b: k for k, b in enumerate(rest)}
    source, sink = len(rest), len(rest) + 1
    ends: list[int] = []
    left: list[float] = []  # edge e and its twin e ^ 1
    out: list[list[int]] = [[] for _ in range(len(rest) + 2)]

    def join(u: int, v: int, there: float, back: float) -> None:
        out[u].append(len(ends))
        out[v].append(len(ends) + 1)
        ends.extend((v, u))
        left.extend((there, back))

    for k, i in enumerate(rest):
        if gain[i] > 0:
            join(source, k, gain[i], 0.0)
        else:
            join(k, sink, -gain[i], 0.0)
        for j, w in near[i].items():
            if i < j:
                join(k, place[j], w, w)
    while True:
        level = [-1] * len(out)
        level[source], queue = 0, deque([source])
        while queue:
            u = queue.popleft()
            for e in out[u]:
                if left[e] > 1e-12 and level[ends[e]] < 0:
                    level[ends[e]] = level[u] + 1
                    queue.append(ends[e])
        if level[sink] < 0:
            return {i for i, k in place.items() if level[k] >= 0}
        tried = [0] * len(out)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                flow = min(left[e] for e in path)
                first = None
                for n, e in enumerate(path):
                    left[e] -= flow
                    left[e ^ 1] += flow
                    if first is None and left[e] <= 1e-12:
                        first = n
                u = ends[path[first] ^ 1]  # go on from where the path is used up
                del path[first:]
                continue
            while tried[u] < len(out[u]):
                e = out[u][tried[u]]
                if left[e] > 1e-12 and level[ends[e]] == level[u] + 1:
                    break
                tried[u] += 1
            if tried[u] < len(out[u]):
                path.append(out[u][tried[u]])
                u = ends[path[-1]]
            elif path:  # a dead end
                u = ends[path.pop() ^ 1]
                tried[u] += 1
            else:
                break


def main_text(html: str) -> str:
    """Content blocks in page order, joined by an empty line."""
    blocks = blocks_of(html)
    has_main = any(b.parent.kind > 0 and not b.parent.outer for b in blocks)
    labels = minimum_cut([classify(b, has_main) for b in blocks], edges_of(blocks))
    return "\n\n".join(b.text for b, yes in zip(blocks, labels, strict=True) if yes)


def extract_text(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``page`` (struct of ``keep``, or of all columns) and ``text``."""
    columns = pages.columns if keep is None else keep
    source = pages.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("page"), whole_text(F.col(f"`{html}`")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(h) for h in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["page", "text"])

    return map_arrow(source, run, f"page {source.schema['page'].dataType.simpleString()}, text string")
