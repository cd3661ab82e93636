"""Main text of HTML pages by a minimum cut over their blocks.

A page is cut into blocks of text at its block elements. A logistic classifier on a
block's place (elements and names around it), length, links and marks gives its
costs of being content or boilerplate, the capacities to the two terminals. Smoothness
edges join blocks next to each other, blocks of one enclosing element, and the items of a
list or table with the block that introduces it. The minimum cut separates content from the rest.

The classifier's weights are fitted (fit) on blocks of at most PAGES pages that mark their
main text themselves with one article or main element, around stated weights, which stay where
the pages say nothing. These bounds concern the fit only; every page is extracted whole.

The edges of a page never cross, so some block always has at most two undecided neighbours. It
is replaced by the terminal and edge capacities that let the same flow through (series
reduction), which keeps the value of the cut; labels are read back in reverse. A block whose own
cost outweighs its edges is decided at once. A page of any length takes linear time. For graphs
that do not reduce so, what is left is solved by augmenting paths.

Defined results: a null, empty or textless page has the empty text; repeated rows
are extracted each; clashing columns are replaced; an empty table has no rows. The contents of
template elements, which no reader sees, are left out with scripts and styles.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from math import exp, log1p
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.hashed import few, mapped, tidied

# Element names of the HTML standard.
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr "
    # embedded objects and fallbacks, whose text is kept, drawings and formulas
    "object audio video canvas source track param embed noscript iframe svg "
    "math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup "
    "mtable mtd mtext mtr munder munderover semantics annotation annotation-xml".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style template textarea title select option button".split())
LISTS = set("ul ol dl table thead tbody tr".split())
BOILER = set("nav footer aside form menu dialog fieldset".split())
MAIN = set("article main".split())
#: Words in class, id and role that tell of boilerplate.
BOILER_WORDS = set(
    "ad ads advert adverts advertisement advertising banner bar breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disqus "
    "footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pagination popup promo promoted "
    "promotion related reply replies responses search share sharing sidebar signup social sponsor sponsored subscribe subscription tags toolbar widget".split()
)
MAIN_WORDS = set("article body content entry main post result results story text".split())
HIDDEN = re.compile("hidden|display", re.I)
NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s<>"'][^\s<>]*+|)))?""")
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# a quote opens a value only after "=", whatever its length; one that nothing closes is a character like others
TOKEN = re.compile(r"""<!--(?:.*?-->|.*)|<(/?)([A-Za-z][^\s/>]*)((?:[^<>=]|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s<>"'][^\s<>]*+|))*+)>|<[!?][^>]*>""", re.S)

#: Joins of neighbours in page order, of neighbours in one element, and of an item with what introduces its list.
NEXT, SIBLING, ITEM = 0.2, 0.8, 1.4
#: Pages and blocks of each for the fit, and how firmly the stated weights are held.
PAGES, BLOCKS, HOLD = 400, 50, 10.0
#: Stated weights of: one, length, main element, boilerplate elements, share of links, shortness, heading, copyright sign.
WEIGHTS = (-1.0, 0.9, 3.5, -6.0, -3.5, -0.3, 1.5, -2.5)


@dataclass
class Block:
    text: str
    parent: int
    boiler: int
    main: bool
    linked: int
    heading: bool = False
    intro: int | None = None


@dataclass
class Element:
    tag: str
    number: int
    boiler: int
    main: bool
    hidden: bool
    link: bool
    #: nearest element around it that is not inline, itself included, and the one around that
    block: Element | None = None
    outer: Element | None = None
    #: block that introduces it (of a list), last block right in it, whether it holds block elements
    intro: int | None = None
    last: int | None = None
    parted: bool = False

    def __post_init__(self) -> None:
        self.block = self.block or self


@dataclass
class Page:
    """Blocks of a page, read tag by tag."""

    blocks: list[Block] = field(default_factory=list)

    @classmethod
    def read(cls, source: str) -> Page:
        page, stack, opened = cls(), [Element("", 0, 0, False, False, False)], Counter()
        held: list[tuple[str, bool]] = []
        number, at, heading, endless = 0, 0, False, set()

        def close() -> None:
            nonlocal heading
            text = " ".join(html.unescape("".join(t for t, _ in held)).split())
            if text:
                top = stack[-1].block
                # text is a part of the element around its own, unless it stands between block elements of its own
                home = top if top.parted or top.tag in LISTS or not top.outer else top.outer
                linked = sum(len(t) for t, link in held if link)
                page.blocks.append(Block(text, home.number, top.boiler, top.main, min(100, 100 * linked // max(1, len(text))), heading, home.intro))
                home.last = len(page.blocks) - 1
            held.clear()
            heading = False

        def add(text: str) -> None:
            if text and not stack[-1].hidden:
                held.append((text, stack[-1].link))

        while m := TOKEN.search(source, at):
            add(source[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag not in INLINE:
                    close()
                if opened[tag]:
                    while stack[-1].tag != tag:
                        opened[stack.pop().tag] -= 1
                    opened[stack.pop().tag] -= 1
                continue
            if tag in RAW:
                close()
                end = None if tag in endless else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                if not end:
                    endless.add(tag)
                at = end.end() if end else len(source) if tag in ("script", "style", "textarea", "title") else at
                continue
            if tag == "br":
                add(" ")
            if tag not in INLINE:
                # a paragraph or item ends where the next begins
                item = stack[-1].tag in ("p", "li", "dt", "dd", "td", "th", "option") and (tag == stack[-1].tag or stack[-1].tag == "p")
                swept = not item and opened["p"] and all(e.tag in INLINE or e.tag == "p" for e in stack[-opened["p"] - 3 :] if e.tag)
                if not item and not swept:
                    stack[-1].block.parted = True
                close()
                heading = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
                if item:
                    opened[stack.pop().tag] -= 1
                while swept and opened["p"]:
                    opened[stack.pop().tag] -= 1
                stack[-1].block.parted = True
            if tag in VOID:
                continue
            number += 1
            stack.append(child(stack[-1], tag, m[3], number))
            opened[tag] += 1
        add(source[at:])
        close()
        return page


def concealed(attributes: str) -> bool:
    """Whether the attributes hide an element: hidden, aria-hidden=true, or display:none as its style."""
    if not HIDDEN.search(attributes):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and NO_DISPLAY.search(value):
            return True
    return False


def child(parent: Element, tag: str, attributes: str, number: int) -> Element:
    words = {w for found in NAMES.findall(attributes) for w in re.split(r"[^a-z]+", "".join(found).lower())} if "=" in attributes else set()
    boiler = parent.boiler + (tag in BOILER) + bool(words & BOILER_WORDS and tag not in ("body", "html") and not words & MAIN_WORDS - {"text", "body"})
    boiler += tag == "header" and not parent.main
    main = parent.main or tag in MAIN or bool(words & {"article", "main", "entry", "story", "post", "content"} and not words & BOILER_WORDS)
    hidden = parent.hidden or tag == "head" or concealed(attributes)
    around, inline = parent.block, tag in INLINE
    intro = None
    if tag in LISTS:
        intro = around.last if around.last is not None else around.intro
    return Element(tag, number, boiler, main, hidden, parent.link or tag == "a", around if inline else None, None if inline else around, intro)


def features(block: Block) -> tuple[float, ...]:
    """What the classifier knows of a block, in the order of WEIGHTS."""
    words = block.text.count(" ") + 1
    short = words < 4 and not block.main
    return 1.0, log1p(words) ** 0.9, float(block.main), float(min(2, block.boiler)), block.linked / 100, float(short), float(block.heading), float(block.text[0] == "©")


def score(block: Block, weights: tuple[float, ...] = WEIGHTS) -> float:
    """Log odds of content."""
    return sum(x * w for x, w in zip(features(block), weights))


def examples(source: str | None) -> list[tuple[tuple[float, ...], bool]]:
    """Features and label of blocks of a page that marks its main text with one article or main element, at most BLOCKS chosen by hash."""
    marks = re.findall(r"<(?:article|main)\b", source or "", re.I)
    if len(marks) != 1:
        return []
    blocks = sorted(Page.read(source).blocks, key=lambda b: crc32(b.text.encode("utf-8", "replace")))[:BLOCKS]
    return [(features(b), b.main and not b.boiler) for b in blocks]


def fit(pages: DataFrame, source: str = "html") -> tuple[float, ...]:
    """Weights of a logistic classifier of blocks, learned on at most PAGES pages chosen by hash, around the stated ones.

    Whether a block lies in a main element is the label here, so that weight stays as stated, and
    the others are learned without it.
    """
    chosen = pages.select(F.col(source).alias("s")).where(F.col("s").isNotNull())
    n = chosen.count()
    if not n:
        return WEIGHTS
    at = F.pmod(F.xxhash64("s"), F.lit(1_000_003)) < max(1, 1_000_003 * PAGES // n)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(rows, 64):
            found = [e for x in batch.column(0).to_pylist() for e in examples(x)]
            yield pa.RecordBatch.from_arrays([pa.array([list(x) for x, _ in found], pa.list_(pa.float64())), pa.array([y for _, y in found], pa.bool_())], ["x", "y"])

    found = chosen.where(at).distinct().mapInArrow(lambda rows: tidied(batches(rows)), "x array<double>, y boolean").limit(2 * PAGES * BLOCKS).toArrow()
    if not found.num_rows:
        return WEIGHTS
    x = np.array(found["x"].to_pylist())
    return learned(x, np.array(found["y"].to_pylist(), float))


def learned(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Newton steps for the mean log loss over the examples, held to the stated weights by HOLD blocks' worth of evidence."""
    stated = np.array(WEIGHTS)
    free = np.arange(len(stated)) != 2
    x, w, known = x[:, free], stated[free].copy(), stated[free]
    hold = HOLD / len(y) * np.eye(len(w))
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) / len(y) + hold, x.T @ (p - y) / len(y) + hold @ (w - known))
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    stated[free] = w
    return tuple(stated.tolist())


def costs(s: float) -> tuple[float, float]:
    """What it costs to call a block boilerplate, and to call it content."""
    bound = max(-30.0, min(30.0, s))
    return log1p(exp(bound)), log1p(exp(-bound))


def minimum_cut(sides: list[tuple[float, float]], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each node whether it is on the source's side of a minimum cut. sides: capacities from the source and to the sink."""
    n = len(sides)
    left = [a - b for a, b in sides]
    joined: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b:
            joined[a][b] = joined[a].get(b, 0.0) + w
            joined[b][a] = joined[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    weight = [sum(j.values()) for j in joined]
    reduced: list[tuple[int, list[tuple[int, float]]]] = []
    gone = [False] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if gone[i]:
            continue
        if abs(left[i]) >= weight[i]:
            label[i] = left[i] > 0
            for j, w in joined[i].items():
                left[j] += w if label[i] else -w
        elif len(joined[i]) <= 2:
            reduced.append((i, list(joined[i].items())))
            reduce(i, left, joined, weight)
        else:
            continue
        gone[i] = True
        for j in joined[i]:
            weight[j] -= joined[j].pop(i)
            todo.append(j)
    rest = [i for i in range(n) if not gone[i]]
    if rest:
        for i, side in zip(rest, max_flow(rest, left, joined)):
            label[i] = side
    for i, around in reversed(reduced):
        label[i] = left[i] + sum(w if label[j] else -w for j, w in around) > 0
    return [bool(x) for x in label]


def reduce(i: int, left: list[float], joined: list[dict[int, float]], weight: list[float]) -> None:
    """Give a node's one or two neighbours the capacities that replace it: the least cost of the node for each of their sides, written as two terminals and an edge."""
    (a, u), (b, v) = (*joined[i].items(), (None, 0.0))[:2]
    c = left[i]
    none, both = min(0.0, u + v - c), min(u + v, -c)
    only_a, only_b = min(u, v - c), min(v, u - c)
    if b is None:
        left[a] += none - both
        return
    edge = max(0.0, (only_a + only_b - none - both) / 2)
    left[a] += none + edge - only_a
    left[b] += none + edge - only_b
    if edge:
        for x, y in ((a, b), (b, a)):
            joined[x][y] = joined[x].get(y, 0.0) + edge
            weight[x] += edge


def max_flow(rest: list[int], left: list[float], joined: list[dict[int, float]]) -> list[bool]:
    """Source sides of the undecided nodes, by shortest augmenting paths."""
    s, t = len(rest), len(rest) + 1
    place = {i: k for k, i in enumerate(rest)}
    cap: list[dict[int, float]] = [{} for _ in range(len(rest) + 2)]
    for i, k in place.items():
        for j, w in joined[i].items():
            cap[k][place[j]] = w
        a, b = (s, k) if left[i] > 0 else (k, t)
        cap[a][b] = abs(left[i])
        cap[b].setdefault(a, 0.0)
    while True:
        before, queue = {s: s}, deque([s])
        while queue and t not in before:
            a = queue.popleft()
            for b, c in cap[a].items():
                if c > 1e-12 and b not in before:
                    before[b] = a
                    queue.append(b)
        if t not in before:
            return [k in before for k in range(len(rest))]
        path = [t]
        while path[-1] != s:
            path.append(before[path[-1]])
        flow = min(cap[a][b] for b, a in zip(path, path[1:]))
        for b, a in zip(path, path[1:]):
            cap[a][b] -= flow
            cap[b][a] = cap[b].get(a, 0.0) + flow


def edges(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges of a page. None crosses another."""
    made, last = [], {}
    for i, block in enumerate(blocks):
        if i:
            made.append((i - 1, i, NEXT))
        if block.parent in last:
            made.append((last[block.parent], i, SIBLING))
        # a list of links, or one in another kind of element, says little about the text before it
        if block.intro is not None and block.linked < 100 and block.boiler == blocks[block.intro].boiler:
            made.append((block.intro, i, ITEM * (1 - block.linked / 100)))
        last[block.parent] = i
    return made


def main_text(source: str | None, weights: tuple[float, ...] = WEIGHTS) -> str:
    """Content blocks of a whole page, one to a line."""
    if not source:
        return ""
    blocks = Page.read(source).blocks
    kept = minimum_cut([costs(score(b, weights)) for b in blocks], edges(blocks))
    return "\n".join(b.text for b, k in zip(blocks, kept) if k)


def extract(pages: DataFrame, source: str = "html", weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """pages with the main text of every whole page, and its number of characters, in place of the source."""

    def run(sources: list[str | None]) -> dict[str, list]:
        texts = list(map(partial(main_text, weights=weights), sources))
        return {"text": texts, "n_chars": [len(t) for t in texts]}

    return mapped(pages, source, {"text": ("string", pa.string()), "n_chars": ("long", pa.int64())}, run).drop(source)
