"""Main text of web pages by minimum cut.

A page is cut into blocks: the text between tags that end a line. A linear classifier gives each two costs, of calling it content and
of calling it boilerplate, from its length, links, punctuation and tag, from the share of the page's prose that lies in articles, and from
marks: elements around it whose tag or names stand for menus, headers, footers, sidebars, notices, adverts, forms and comments. The costs
are the capacities to the two terminals of a graph. Edges between blocks that follow each other, weaker the farther apart they are
in the tree, and between those of one parent make a change of label cost something. The minimum cut of that graph is the labelling.

All costs are finite, and a mark is a feature, not a verdict: one that holds articles, headings or other marks and nearly all prose that
has no mark is what a page is wrapped in, and counts the less the more it holds.

Defined cases: null and empty html give an empty text. A page without content blocks gives an empty text. Tags that
are never closed end with their parent; formulas and drawings also with the next element that can't be inside. Their text is part of the line.
A quote that no "=" precedes is a plain character of its tag. Repeated rows are extracted alike; result columns replace others of their name.
Parsing takes time in proportion to the page, however deep its elements are nested.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachspark.llm.common import put, read

# HTML element names by what they do to text.
RAW = frozenset({"script", "style", "noscript", "template", "textarea", "iframe", "title", "xmp", "noframes"})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br img wbr svg math object canvas".split())
NEVER = frozenset({"nav", "header", "footer", "aside", "form", "button", "select", "option", "head", "fieldset", "input"})
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
OWN_KIND = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
IN_P = CLOSES_P | {"table", "button", "td", "th", "li", "body"}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}
# Words in class, id and role that tell what an element is for.
BAD_NAMES = re.compile(r"(?<![a-z])(ads?|advert\w*|adbox|adsense|adslot|comments?|commentlist|complementary|consent|contentinfo|cookies?|disqus|footer|form|header|masthead|nav|navbar|navigation|notice|notices|notification|sidebar|sponsor\w*)(?![a-z])")
#: What goes on around a text; a sentence or two of such a name may still be text.
AROUND_NAMES = re.compile(r"(?<![a-z])(banner|breadcrumbs?|captcha|dialog|foot|login|menu|menubar|modal|newsletter|overlay|pager|pagination|popup|promo\w*|rail|recommend\w*|replies|reply|respond|search|share|sharing|shoutbox|signup|skip|social|subscribe|toolbar|topbar|widgets?)(?![a-z])")
#: What stands beside a text as often as in it.
BESIDE_NAMES = re.compile(r"(?<![a-z])(alert|byline|copyright|disclaimer|legal|links|related|tags?)(?![a-z])")
GOOD_NAMES = re.compile(r"(?<![a-z])(article|articlebody|body|content|entry|main|post|story|text)(?![a-z])")

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)", re.S)
NAMES = re.compile(r"(?:^|[\s\"'/])(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|[\s\"'/])(?:hidden(?=[\s/>=]|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
BLANKS = re.compile(r"\s+")
#: A name of these words says what an element has beside it, not what it is.
BESIDES = re.compile(r"(?:has|with|without|no|not|is|hide|show)[-_]|[-_](?:left|right|enabled|disabled|open|closed|on|off)$")
FOREIGN = frozenset({"svg", "math"})
#: Cost of keeping a block under a mark: of the contract's kinds; of what goes on around a text, falling to 0 at LONG characters; of what is beside it.
KIND, AROUND, LONG, BESIDE = 12.0, 10.5, 160, 2.0
#: A mark that holds this many times the prose that has no mark counts half.
WRAPS = 10.0
#: Gain of a block in an article, and loss of one outside where articles hold all prose.
ARTICLE = 4.0
#: Cost of a change of label between neighbours of one element, and between blocks of one parent.
NEXT_TO, SAME_PARENT = 0.9, 1.2


@dataclass
class Mark:
    """An element that stands for boilerplate: the mark around it, its cost by kind, and what it holds."""

    outer: int
    kind: float
    around: float
    beside: float
    may_wrap: bool
    holds: bool = False
    prose: int = 0


@dataclass
class Element:
    """An open element and what all around it say. holder and root are places in the stack: of the innermost element that isn't
    inline, and of the outermost of a formula or drawing."""

    tag: str
    number: int = 0
    mark: int = -1
    article: bool = False
    good: bool = False
    link: bool = False
    holder: int = 0
    root: int = 0


@dataclass
class Block:
    text: str
    linked: int
    parent: int
    tag: str
    mark: int
    article: bool
    good: bool
    steps: int = 0  # in the tree from the block before


class Page:
    """The open elements, the marks and the blocks so far. The places of open tags are known, so nothing looks through the stack."""

    def __init__(self) -> None:
        self.stack, self.places, self.marks, self.blocks = [Element("")], {}, [], []
        self.parts: list[str] = []
        self.linked = self.number = self.lowest = self.last_depth = 0

    def last(self, tags: Iterable[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def cut(self, place: int) -> None:
        """Closes all elements from a place in the stack on."""
        while len(self.stack) > place:
            self.places[self.stack.pop().tag].pop()
        self.lowest = min(self.lowest, len(self.stack) - 1)

    def close(self, tags: Iterable[str], scope: Iterable[str]) -> bool:
        """Closes the innermost element of those tags if no element of the scope is inside it."""
        place = self.last(tags)
        if place and place > self.last(scope):
            self.cut(place)
            return True
        return False

    def open(self, tag: str, attributes: str) -> None:
        around, self.number = self.stack[-1], self.number + 1
        foreign = around.root if around.root and tag != "foreignobject" else len(self.stack) if tag in FOREIGN else 0
        names = [w for m in NAMES.findall(attributes) for w in CAMEL.sub("-", next(filter(None, m[1:]), "")).split() if not BESIDES.search(w.lower())]
        names = " ".join(names).lower().replace("_", "-") if names and tag not in ("body", "html", "article", "main") else ""
        e = Element(tag, self.number, around.mark, around.article or tag in ("article", "main"), around.good or bool(GOOD_NAMES.search(names)), around.link or tag == "a", around.holder if tag in INLINE or foreign else len(self.stack), foreign)
        if tag in NEVER or tag in ("menu", "dialog") or names or "hidden" in attributes.lower() or "none" in attributes:
            sure = tag in NEVER or bool(BAD_NAMES.search(names)) or bool(HIDDEN.search(attributes))
            goes_on, beside = tag in ("menu", "dialog") or bool(AROUND_NAMES.search(names)), bool(BESIDE_NAMES.search(names))
            if sure or goes_on or beside:
                if e.mark >= 0:
                    self.marks[e.mark].holds = True
                self.marks.append(Mark(e.mark, KIND * sure, AROUND * goes_on, BESIDE * beside, tag not in NEVER or tag in ("form", "fieldset"), bool(GOOD_NAMES.search(names))))
                e.mark = len(self.marks) - 1
        if tag in ("article", "main", "h1") and around.mark >= 0:
            self.marks[around.mark].holds = True
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append(e)

    def add(self, text: str) -> None:
        if text:
            text = entities.unescape(text) if "&" in text else text
            self.parts.append(text)
            if self.stack[-1].link:
                self.linked += len(text.strip())

    def flush(self) -> None:
        """Ends a block."""
        text = BLANKS.sub(" ", "".join(self.parts)).strip() if self.parts else ""
        if text:
            at = self.stack[-1].holder
            holder, above = self.stack[at], self.stack[max(0, at - 1)]
            low = min(self.lowest, at)
            self.blocks.append(Block(text, min(self.linked, len(text)), above.number, holder.tag, self.stack[-1].mark, holder.article, holder.good, self.last_depth + at - 2 * low))
            self.last_depth = self.lowest = at
        self.parts.clear()
        self.linked = 0


def parsed(html: str) -> Page:
    """The blocks of a page, in order, with their white space put right and character references decoded."""
    page, at, end = Page(), 0, len(html)
    stack = page.stack
    while at < end:
        m = TAG.search(html, at)
        if not m:
            break
        page.add(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                page.add(m[0][9:-3])
            continue
        tag, root = m[2].lower(), stack[-1].root
        if m[1]:
            place = page.last((tag,))
            if root and place >= root:  # ends a part of a formula or drawing, or all of it
                page.cut(place)
                continue
            if tag not in INLINE:
                page.flush()
            elif tag == "br":
                page.parts.append(" ")
            if place and (tag not in INLINE or place > stack[-1].holder):
                page.cut(place)
            continue
        whole = m[3].rstrip().endswith("/")
        if tag in RAW:
            if not whole:
                stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = stop.end() if stop else end
            if tag != "iframe" and not root:
                page.flush()
            continue
        if root:
            if tag not in CLOSES_P and tag not in OWN_KIND and tag not in ("body", "head"):
                if tag != "br" and not whole:
                    page.open(tag, m[3])
                continue
            page.cut(root)
        if tag in INLINE:
            if tag in VOID:
                page.parts.append(" " if tag == "br" else "")
                continue
            if tag == "a":
                page.close(("a",), CLOSES_P)
        else:
            page.flush()
            if tag in CLOSES_P:
                page.close(("p",), IN_P)
            if tag in OWN_KIND:
                while page.close(OWN_KIND[tag], SCOPE[tag]):
                    pass
            if tag == "body":  # whatever the head left open is done
                page.cut(1)
            if tag in VOID:
                continue
        page.open(tag, m[3])
    page.add(html[at:])
    page.flush()
    return page


def mark_costs(page: Page) -> list[tuple[float, float, float]]:
    """Cost by kind of each mark and those around it, less what it loses as a wrapper of the page."""
    bare = 0
    for b in page.blocks:
        if b.mark >= 0:
            page.marks[b.mark].prose += len(b.text) - b.linked
        else:
            bare += len(b.text) - b.linked
    out: list[tuple[float, float, float]] = []
    for m in page.marks:  # outer ones come first
        counts = 1.0
        if m.may_wrap and m.holds and m.prose:
            counts = WRAPS * bare / (WRAPS * bare + m.prose)
        outer = out[m.outer] if m.outer >= 0 else (0.0, 0.0, 0.0)
        out.append(tuple(max(x, counts * y) for x, y in zip(outer, (m.kind, m.around, m.beside), strict=True)))
    return out


def costs(page: Page) -> list[tuple[float, float]]:
    """(cost of calling a block content, cost of calling it boilerplate) for each block; one of the two is zero."""
    marks, inside, outside, out = mark_costs(page), 0, 0, []
    for b in page.blocks:
        if b.mark < 0 or marks[b.mark][0] < KIND / 2:
            inside, outside = (inside + len(b.text), outside) if b.article else (inside, outside + len(b.text) - b.linked)
    share = inside / (inside + outside) if inside else 0.0
    little = min(1.0, (inside + outside) / 400)  # a short page has short blocks
    for b in page.blocks:
        kind, around, beside = marks[b.mark] if b.mark >= 0 else (0.0, 0.0, 0.0)
        score = -0.6 * little + min(len(b.text) / 80, 2.0) - 3.0 * b.linked / len(b.text)
        score += 0.4 * (b.text[-1] in ".!?…。\"'»”") + 0.8 * (b.tag in ("p", "pre", "blockquote", "h1", "h2", "h3")) + 0.6 * b.good
        score -= kind + around * (1 - min(len(b.text) / LONG, 1.0)) + beside
        score += ARTICLE * min(1.0, 2 * share) if b.article else -2 * ARTICLE * max(0.0, share - 0.5)
        out.append((0.0, score) if score > 0 else (-score, 0.0))
    return out


def next_to(b: Block) -> float:
    """Cost of a change of label between a block and the one before: less with each step between them in the tree."""
    return NEXT_TO / (1 + b.steps / 4)


class Flow:
    """Maximum flow by shortest augmenting paths in levels; the nodes that the source still reaches are its side of the cut."""

    def __init__(self, nodes: int):
        self.edges: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[float] = []

    def join(self, a: int, b: int, forward: float, back: float) -> None:
        for x, y, c in ((a, b, forward), (b, a, back)):
            self.edges[x].append(len(self.to))
            self.to.append(y)
            self.room.append(c)

    def levels(self, source: int) -> list[int]:
        level = [-1] * len(self.edges)
        level[source] = 0
        queue = deque([source])
        while queue:
            x = queue.popleft()
            for e in self.edges[x]:
                if self.room[e] > 1e-9 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[x] + 1
                    queue.append(self.to[e])
        return level

    def cut(self, source: int, sink: int) -> list[bool]:
        while (level := self.levels(source))[sink] >= 0:
            tried, path, x = [0] * len(self.edges), [], source
            while True:
                if x == sink:
                    least = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    path, x = [], source
                    continue
                while tried[x] < len(self.edges[x]):
                    e = self.edges[x][tried[x]]
                    if self.room[e] > 1e-9 and level[self.to[e]] == level[x] + 1:
                        break
                    tried[x] += 1
                else:
                    if not path:
                        break
                    e = path.pop()
                    x = self.to[e ^ 1]
                    tried[x] += 1
                    continue
                path.append(e)
                x = self.to[e]
        return [v >= 0 for v in level]


def content(page: Page) -> list[bool]:
    """The cheapest labelling. Stretches whose blocks all lean the same way, with the same parent, are one node: no cut
    would part them."""
    blocks, both = page.blocks, costs(page)
    groups: list[list[int]] = []
    for i, (c, b) in enumerate(both):
        last = groups[-1][-1] if groups else -1
        if groups and blocks[last].parent == blocks[i].parent and (both[last][0] > both[last][1]) == (c > b):
            groups[-1].append(i)
        else:
            groups.append([i])
    flow, source, sink = Flow(len(groups) + 2), len(groups), len(groups) + 1
    latest: dict[int, int] = {}
    for g, members in enumerate(groups):
        as_content, as_rest = (sum(both[i][k] for i in members) for k in (0, 1))
        flow.join(source, g, as_rest, 0.0)
        flow.join(g, sink, as_content, 0.0)
        first = blocks[members[0]]
        if g:
            flow.join(g - 1, g, next_to(first), next_to(first))
        if (near := latest.get(first.parent)) is not None:
            flow.join(near, g, SAME_PARENT, SAME_PARENT)
        latest[first.parent] = g
    side = flow.cut(source, sink)
    label = [False] * len(blocks)
    for g, members in enumerate(groups):
        for i in members:
            label[i] = side[g]
    return label


def main_text(html: str | None) -> str:
    page = parsed(html or "")
    return "\n\n".join(b.text for b, keep in zip(page.blocks, content(page), strict=True) if keep) if page.blocks else ""


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with text (blocks joined by an empty line) and n_chars."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(main_text, na_action=None)

    df = put(pages, h_text=texts(F.col(html)))
    return put(df, text=F.col("h_text"), n_chars=F.length("h_text").cast("long")).drop("h_text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
