"""Main text of HTML pages by minimum-cut labelling.

A page is read into elements and blocks: a block is the text between boundaries of block elements. A
logistic classifier, fitted on pages that mark their article, gives each block a cost of calling it content
and one of calling it boilerplate from its length, links, sentences, element and surroundings; these are its
capacities to the two terminals. Elements that hold blocks are nodes too: what they hold in all, or that
they are an article, is their capacity. Edges join a block to the element that holds it, to its article and
to the block before it, and an element to the one around it; a labelling pays for each edge it separates.
The minimum cut, found by maximum flow, is the labelling of least total cost: a one-word paragraph among
others stays, a lone sentence between menus goes.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.text import slices, task

#: Elements that end a block, those whose content is no text, and those never closed.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style noscript template textarea iframe object svg math canvas audio video".split())
#: Those of RAW that are markup: without an end tag only their tag is skipped.
MARKUP_RAW = frozenset("noscript template object svg math canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end an open one of their own kind.
ITEMS = frozenset("li option dt dd tr td th".split())
#: Elements and name parts that speak for content, and against it.
GOOD_TAGS, BAD_TAGS = frozenset("article main".split()), frozenset("nav header footer aside form menu dialog head button select label fieldset".split())
BAD_NAMES = frozenset(
    "ad ads adv advert advertisement banner sponsor sponsored promo cookie cookies consent notice notification alert sidebar side menu nav navbar navigation "
    "header masthead footer foot breadcrumb breadcrumbs comment comments reply replies disqus respond discussion related recommended share sharing social "
    "subscribe subscription newsletter signup login popup modal overlay widget pagination pager tags toolbar copyright legal form search hidden".split()
)
GOOD_NAMES = frozenset("article content main post entry story body text".split())
#: Elements that are no nodes: they hold all.
TOP = frozenset(["", "html", "body"])
#: Parts of a class name that say how a page is laid out, not what an element is.
LAYOUT = frozenset("has no not with without is open closed enabled disabled page single layout template theme".split())

#: The features of a block, and the weights that the fitted ones are drawn to.
FEATURES = ("bias", "length", "links", "sentence", "paragraph", "item", "heading", "rights", "bad_tag", "bad_name", "outside")
PRIOR = np.array([-1.4, 0.45, -4.0, 0.9, 1.0, -0.4, 0.8, -2.0, -6.0, -5.0, -2.5])
#: Those of FEATURES that are hidden in the second copy of each block that is fitted on.
CONTEXT = [8, 9, 10]
#: Pages that are fitted on at most, blocks of each, and how many blocks the sample counts as against the prior.
FIT_PAGES, FIT_BLOCKS, FIT_WEIGHT = 1000, 200, 25.0
#: Capacities: article elements, and elements of a good name, to the content side; block to its element,
#: element to the one around it, block to its article, and block to block before within one element and across.
ARTICLE, NAMED, HOLDS, AROUND, IN_ARTICLE, NEXT, ACROSS = 1000.0, 2.0, 1.2, 1.2, 3.0, 0.5, 0.1

#: A tag whose attributes are well-formed and hold no "<"; others are read attribute by attribute.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^\"'<>]++|\"[^\"<]*+\"|'[^'<]*+')*+)>")
_START = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_NEXT_ATTRIBUTE = re.compile(r"[\s/]*+(?:(>)|([^\s/>=][^\s/>=]*+|=[^\s/>=]*+)(?:\s*+(=)\s*+)?)")
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|style|aria-hidden)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?(?![^\s/>])", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)\]]*(?:\s|$)")
_RIGHTS = re.compile(r"©|\(c\)\s*\d{4}|copyright|all rights reserved", re.I)
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Page:
    """The elements and blocks of a page. parent, tag, good, bad_tag, bad_name, named (well): by element,
    0 being the root. texts, links, element: by block, its text, its share of linked text, and the element it is in."""

    def __init__(self):
        self.parent, self.tag, self.good, self.bad_tag, self.bad_name, self.named = [0], [""], [False], [False], [False], [False]
        self.texts: list[str] = []
        self.links: list[float] = []
        self.element: list[int] = []

    def open(self, parent: int, tag: str, attributes: str) -> int:
        good, bad = _names(attributes) if attributes and tag not in TOP else (False, False)
        self.parent.append(parent)
        self.tag.append(tag)
        self.good.append(tag in GOOD_TAGS and not bad)
        self.bad_tag.append(tag in BAD_TAGS)
        self.bad_name.append(bad)
        self.named.append(good and not bad)
        return len(self.tag) - 1


def _names(attributes: str) -> tuple[bool, bool]:
    """Whether an element's names speak for content, and whether they, or its being hidden, speak against it."""
    good = False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDES.search(value):
            return good, True
        if name in ("class", "id", "role"):
            for word in value.split():
                parts = set(_WORD.findall(word))
                if not parts & LAYOUT:
                    if parts & BAD_NAMES:
                        return good, True
                    good = good or bool(parts & GOOD_NAMES)
    return good, False


def _tag_end(page: str, at: int, missing: set[str]) -> int:
    """Where a tag whose name ends at `at` ends, behind its ">"; -1 if the page ends first. missing: quotes
    that do not occur any more; a value that such a quote opens is read as if without quotes."""
    while True:
        m = _NEXT_ATTRIBUTE.match(page, at)
        if not m:
            return -1
        at = m.end()
        if m[1]:
            return at
        if m[3] and at < len(page):
            quote = page[at]
            if quote in "\"'" and quote not in missing:
                end = page.find(quote, at + 1)
                if end >= 0:
                    at = end + 1
                    continue
                missing.add(quote)
            while at < len(page) and page[at] != ">" and not page[at].isspace():
                at += 1


def read(page: str) -> Page:
    """A page's elements and blocks, in one pass; white space collapsed and references decoded.

    Unclosed and stray tags are read as far as they go: a comment, script or tag without an end hides what
    follows it, other elements without an end hide nothing."""
    out, stack, opened = Page(), [0], Counter()
    parts: list[str] = []
    linked, link, at = 0, False, 0
    unclosed: set[str] = set()
    missing: set[str] = set()

    def flush() -> None:
        nonlocal linked
        text = "".join(parts)
        parts.clear()
        if text and not text.isspace():
            text = _SPACE.sub(" ", html.unescape(text) if "&" in text else text).strip()
            if text:
                out.texts.append(text)
                out.links.append(min(1.0, linked / len(text)))
                out.element.append(stack[-1])
        linked = 0

    while at < len(page):
        begin = page.find("<", at)
        text = page[at:] if begin < 0 else page[at:begin]
        if text:
            parts.append(text)
            if link:
                linked += len(text)
        if begin < 0:
            break
        m = _TAG.match(page, begin)
        if m:
            at, closing, tag, attributes = m.end(), m[1] == "/", m[2].lower(), m[3]
        elif m := _START.match(page, begin):
            at = _tag_end(page, m.end(), missing)
            if at < 0:
                break
            closing, tag, attributes = m[1] == "/", m[2].lower(), page[m.end() : at - 1]
        elif page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            if end < 0:
                break
            at = end + 3
            continue
        elif page[begin + 1 : begin + 2] in ("!", "?", "/"):
            end = page.find(">", begin)
            if end < 0:
                break
            at = end + 1
            continue
        else:
            parts.append("<")
            at = begin + 1
            continue
        if tag in RAW and not closing:
            if tag in ("svg", "math") and attributes.endswith("/") or tag in unclosed:
                continue
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if not end and tag in MARKUP_RAW:
                unclosed.add(tag)
                continue
            at = end.end() if end else len(page)
            if tag not in ("script", "style", "svg"):
                parts.append(" ")
        elif tag == "a":
            link = not closing
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCKS or tag in BAD_TAGS:
            flush()
            link = False
            if closing:
                if opened[tag]:
                    while True:
                        ended = out.tag[stack.pop()]
                        opened[ended] -= 1
                        if ended == tag:
                            break
            elif tag not in VOID:
                last = out.tag[stack[-1]]
                if last == "p" or last == tag and tag in ITEMS:
                    opened[last] -= 1
                    stack.pop()
                stack.append(out.open(stack[-1], tag, attributes))
                opened[tag] += 1
    flush()
    return out


def _surroundings(p: Page):
    """By element: whether it or one around it is a bad element, has a bad name, the article it is in (0:
    none), and the length of the text in it. A bad name or a form counts for nothing where more than half
    of the page's unlinked text and its article, main part or first heading are in it."""
    n = len(p.tag)
    held, whole = [0] * n, [False] * n
    for e, text, links in zip(p.element, p.texts, p.links):
        held[e] += int(len(text) * (1 - links))
    for e in range(n - 1, 0, -1):
        held[p.parent[e]] += held[e]
        if whole[e] or p.good[e] or p.tag[e] == "h1":
            whole[p.parent[e]] = True
    tag, name, article = [False] * n, [False] * n, [0] * n
    for e in range(1, n):
        up = p.parent[e]
        wraps = whole[e] and 2 * held[e] > held[0]
        tag[e] = tag[up] or p.bad_tag[e] and not (wraps and p.tag[e] == "form")
        name[e] = name[up] or p.bad_name[e] and not wraps
        article[e] = e if p.good[e] and not tag[e] and not name[e] else article[up]
    return tag, name, article, held


def features(p: Page) -> np.ndarray:
    """A row of FEATURES for each block."""
    tag, name, article, _ = _surroundings(p)
    marked = any(article)
    out = np.zeros((len(p.texts), len(FEATURES)))
    for row, e, text, links in zip(out, p.element, p.texts, p.links):
        kind = p.tag[e]
        row[:] = (
            1.0, max(-2.0, min(4.0, math.log(len(text) / 40))), links, bool(_SENTENCE.search(text)), kind == "p", kind in ITEMS,
            len(kind) == 2 and kind[0] == "h" and kind[1].isdigit(), bool(_RIGHTS.search(text)), tag[e], name[e], marked and not article[e],
        )
    return out


def _two(z: float) -> tuple[float, float]:
    """(cost of calling it boilerplate, cost of calling it content) for log-odds z of being content."""
    return (math.log1p(math.exp(z)) if z < 30 else z), (math.log1p(math.exp(-z)) if z > -30 else -z)


def minimum_cut(to_source: list[float], to_sink: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Which nodes are on the source's side of a minimum cut; edges hold for both directions. By maximum
    flow in phases: nodes are levelled by their distance from what the source can still reach, and paths
    that go up one level at a time are filled until none is left."""
    tiny, n = 1e-9, len(to_source)
    out: list[list[int]] = [[] for _ in range(n)]  # edges from each node; edge e and e ^ 1 are each other's reverse
    head, rest = [], []
    for (a, b), c in edges.items():
        if a != b and c > 0:
            out[a].append(len(head))
            out[b].append(len(head) + 1)
            head += (b, a)
            rest += (c, c)
    # What flows straight from source to sink is spent; one side's capacity remains at each node.
    left = [s - t for s, t in zip(to_source, to_sink)]
    while True:
        level = [0 if x > tiny else -1 for x in left]
        queue, reached = [i for i in range(n) if level[i] == 0], False
        for i in queue:
            for e in out[i]:
                j = head[e]
                if level[j] < 0 and rest[e] > tiny:
                    level[j] = level[i] + 1
                    reached = reached or left[j] < -tiny
                    queue.append(j)
        if not reached:
            return [x >= 0 for x in level]
        turn = [0] * n
        for source in [i for i in range(n) if left[i] > tiny]:
            path: list[int] = []
            i = source
            while left[source] > tiny:
                if left[i] < -tiny:
                    flow = min(left[source], -left[i], *(rest[e] for e in path))
                    left[source] -= flow
                    left[i] += flow
                    for e in path:
                        rest[e] -= flow
                        rest[e ^ 1] += flow
                    path, i = [], source
                    continue
                for k in range(turn[i], len(out[i])):
                    e = out[i][k]
                    if rest[e] > tiny and level[head[e]] == level[i] + 1:
                        turn[i] = k
                        path.append(e)
                        i = head[e]
                        break
                else:
                    turn[i] = len(out[i])
                    if not path:
                        break
                    i = head[path.pop() ^ 1]
                    turn[i] += 1


def graph(p: Page, weights: np.ndarray):
    """(log-odds of each node, edges) of a page: its blocks, then the elements that are nodes."""
    z = (features(p) @ weights).tolist() if p.texts else []
    tag, name, article, held = _surroundings(p)
    node: dict[int, int] = {}
    edges: dict[tuple[int, int], float] = {}

    def add(a: int, b: int, c: float) -> None:
        edges[a, b] = edges.get((a, b), 0.0) + c

    def of(e: int) -> int:
        """The node of an element; those around it get theirs, the page's root and body none."""
        todo = []
        while e not in node and p.tag[e] not in TOP:
            todo.append(e)
            e = p.parent[e]
        up = node.get(e, -1)
        for e in reversed(todo):
            node[e] = len(z)
            if article[e] == e:
                z.append(ARTICLE)
            else:
                size = 1.5 * max(-1.0, min(2.0, math.log((1 + held[e]) / 150)))
                z.append(-3.0 if tag[e] or name[e] else size + NAMED * p.named[e])
            if up >= 0:
                add(up, node[e], AROUND)
            up = node[e]
        return up

    branches = set(p.parent[1:])
    before = -1
    for i, e in enumerate(p.element):
        # A leaf is the block's own element; what holds it is around it, unless that is the page itself.
        holder = e if p.tag[e] not in ITEMS and (e in branches or p.tag[p.parent[e]] in TOP) else p.parent[e]
        up = of(holder)
        if up >= 0:
            add(i, up, HOLDS)
        if article[e]:
            add(i, of(article[e]), IN_ARTICLE)
        if i:
            add(i - 1, i, NEXT if holder == before else ACROSS)
        before = holder
    return z, edges


def label(p: Page, weights: np.ndarray = PRIOR) -> list[bool]:
    """Which blocks are content."""
    z, edges = graph(p, weights)
    priced = [_two(x) for x in z]
    return minimum_cut([c[0] for c in priced], [c[1] for c in priced], edges)[: len(p.texts)]


def main_text(page: str | None, weights: np.ndarray = PRIOR) -> str:
    p = read(page or "")
    return "\n".join(text for text, content in zip(p.texts, label(p, weights)) if content)


@task
def _examples(batches):
    """Features and label of blocks of pages that mark an article or main part; its blocks are content."""
    for batch in slices(batches, "html"):
        rows, content = [], []
        for page in batch.column("html").to_pylist():
            p = read(page or "")
            article = _surroundings(p)[2]
            if any(article):
                step = -(-len(p.texts) // FIT_BLOCKS) or 1
                x = features(p)
                tag_or_name = x[:, 8:10].any(axis=1)
                rows.append(x[::step])
                content += [bool(article[e]) and not b for e, b in zip(p.element, tag_or_name)][::step]
        if content:
            x = pa.array(np.concatenate(rows).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(content) + 1, dtype=np.int32) * len(FEATURES)), x)
            yield pa.RecordBatch.from_arrays([lists, pa.array(content)], ["x", "content"])


def fit(pages: DataFrame) -> np.ndarray:
    """Weights of FEATURES from at most FIT_PAGES pages, those of least hash, and FIT_BLOCKS blocks of each.

    Labels are weak: in a page that marks its article the blocks in it, menus and the like aside, are
    content. Each block counts twice, once with its surroundings hidden, so that its shape must tell too.
    The sample counts as FIT_WEIGHT blocks against a normal prior around PRIOR; without one, PRIOR it is."""
    key = F.xxhash64("page_id", "url")
    chosen = pages.select(key.alias("h")).distinct().orderBy("h").limit(FIT_PAGES)
    rows = pages.select(key.alias("h"), "html").join(F.broadcast(chosen), "h").select("html").limit(FIT_PAGES)
    found = rows.mapInArrow(_examples, "x array<double>, content boolean").toArrow()  # FIT_PAGES * FIT_BLOCKS rows at most
    if not found.num_rows:
        return PRIOR
    x = np.array(found.column("x").to_pylist())
    y = found.column("content").to_numpy().astype(float)
    hidden = x.copy()
    hidden[:, CONTEXT] = 0
    return solve(np.concatenate([x, hidden]), np.concatenate([y, y]))


def solve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The most probable weights, by Newton's method; the order of rows does not matter beyond rounding."""
    share, w = FIT_WEIGHT / len(y), PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = share * (x.T @ (p - y)) + (w - PRIOR)
        hessian = share * ((x * (p * (1 - p))[:, None]).T @ x) + np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return np.round(w, 6)


def extract(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """(page_id, url, text) per row of pages, of the whole html; without weights they are fitted on the pages.

    Null, empty and textless pages give the empty text; equal rows give equal rows; a null page_id or url
    stays null; an empty table gives no rows. Other columns are not read."""
    w = fit(pages) if weights is None else weights

    @task
    def run(batches):
        for batch in slices(batches, "html"):
            texts = [main_text(page, w) for page in batch.column("html").to_pylist()]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text"])

    return pages.selectExpr("cast(page_id as bigint) as page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")
