"""HTML extraction: blocks of a page are labelled content or boilerplate by a minimum cut.

A classifier's costs are the capacities to the two terminals; smoothness edges join neighbouring blocks and
blocks of the same parent element, the stronger the closer they are in the DOM. Maximum flow separates them.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import map_batches

#: Pages, at most, on which the classifier is fitted: those of smallest hash of page_id.
SAMPLE_PAGES = 2000
#: Strength of smoothness edges: between neighbours, and between blocks of one parent.
NEIGHBOUR, SIBLING = 1.0, 0.5
_UNIT = 10_000
#: Comments, elements without text, and tags. A tag ends before the next "<" outside quotes, and nothing is matched
#: twice (possessive), so that broken markup is read in linear time.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|head)\b[^<>]*+>.*?(?:</\1\s*+>|\Z)|<!?(/?)([a-zA-Z][a-zA-Z0-9-]*+)((?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+)>", re.S | re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i img input ins kbd label mark meta nobr q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_CONTENT = frozenset(("article", "main"))
_FRAME = frozenset(("nav", "footer", "aside", "header", "form", "menu"))
_NAMES = re.compile(r"""\b(?:class|id)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)""", re.I)
_AD = re.compile(r"\b(?:ad|ads|advert|banner|menu|sidebar|cookie|share|promo|breadcrumbs?|navbar|footer)\b", re.I)


class Block:
    """``depth`` counts the enclosing elements, ``common`` those shared with the block before; ``parent`` numbers the one around the innermost."""

    __slots__ = ("text", "links", "tag", "depth", "parent", "common", "hint")

    def __init__(self, text: str, links: int, tag: str, depth: int, parent: int, common: int, hint: int | None) -> None:
        self.text, self.links, self.tag, self.depth, self.parent, self.common, self.hint = text, links, tag, depth, parent, common, hint


def blocks(page: str) -> list[Block]:
    """Text blocks in page order. ``hint`` is 1 inside semantic content elements, 0 inside frames and
    advertisements, else None. Unclosed and stray tags are tolerated; the time is linear in the page."""
    out: list[Block] = []
    stack: list[tuple[str, int, int | None]] = []
    opened: Counter = Counter()
    pieces: list[str] = []
    links = anchors = number = at = 0
    # the least depth since the last block: so much of its path is this one's too
    least = 0

    def flush() -> None:
        nonlocal links, least
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                out.append(Block(text, min(links, len(text)), stack[-1][0] if stack else "", len(stack), stack[-2][1] if len(stack) > 1 else 0, least, stack[-1][2] if stack else None))
                least = len(stack)
            pieces.clear()
        links = 0

    def close(k: int) -> None:
        nonlocal least
        opened.subtract(x for x, *_ in stack[k:])
        del stack[k:]
        least = min(least, k)

    for m in _TAG.finditer(page):
        if m.start() > at:
            raw = page[at : m.start()]
            pieces.append(raw)
            if anchors:
                links += len(raw)
        at = m.end()
        name = m[3]
        if not name:
            continue
        name = name.lower()
        if name == "a":
            anchors = 0 if m[2] else 1
        if name in _INLINE:
            continue
        flush()
        if name in _VOID:
            continue
        if m[2]:
            if opened[name]:
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
            anchors = 0
        else:
            closes = _CLOSES.get(name)
            if closes and stack and stack[-1][0] in closes:
                close(len(stack) - 1)
            number += 1
            hint = stack[-1][2] if stack else None
            if name in _CONTENT and hint != 0:
                hint = 1
            elif name in _FRAME or (m[4] and any(_AD.search(x) for x in _NAMES.findall(m[4]))):
                hint = 0
            stack.append((name, number, hint))
            opened[name] += 1
    pieces.append(page[at:])
    flush()
    return out


_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def features(page: list[Block]) -> np.ndarray:
    """What the classifier sees of each block: nothing of its ancestors."""
    rows = []
    last = max(1, len(page) - 1)
    for k, b in enumerate(page):
        words = b.text.count(" ") + 1
        stops = b.text.count(".") + b.text.count(",") + b.text.count("?") + b.text.count("!")
        rows.append((1.0, math.log1p(words), b.links / len(b.text), stops / words, b.tag in _HEADINGS, b.tag == "li", b.tag == "p", "©" in b.text, k / last, abs(2 * k / last - 1)))
    return np.array(rows, float)


#: Used where a sample holds no page with both kinds of hints.
DEFAULT = np.array([-1.0, 0.6, -4.0, 1.0, 0.5, -1.0, 1.0, -3.0, 0.0, -0.5])


def fit(pages: list[str], steps: int = 25, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression, by Newton's method, on blocks whose semantic elements say what they are."""
    xs, ys = [], []
    for page in pages:
        found = blocks(page)
        if found:
            x = features(found)
            known = [k for k, b in enumerate(found) if b.hint is not None]
            xs.append(x[known])
            ys.extend(found[k].hint for k in known)
    y = np.array(ys, float)
    if not len(y) or y.min() == y.max():
        return DEFAULT
    x = np.vstack(xs)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - ridge * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def edges(page: list[Block], neighbour: float = NEIGHBOUR, sibling: float = SIBLING) -> list[tuple[int, int, int]]:
    """(i, j, capacity): each block with the next one, weaker by the DOM steps between them, and with the next
    block that has the same parent element, if that is another."""
    out: list[tuple[int, int, int]] = []
    seen: dict[int, int] = {}
    for k, b in enumerate(page):
        if k:
            out.append((k - 1, k, int(_UNIT * neighbour / (1 + page[k - 1].depth + b.depth - 2 * b.common))))
        parent = b.parent
        if parent in seen and seen[parent] < k - 1:
            out.append((seen[parent], k, int(_UNIT * sibling)))
        seen[parent] = k
    return out


def minimum_cut(source: list[int], sink: list[int], links: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each node is on the source's side of a minimum cut (the smallest such side).

    ``source`` and ``sink`` are capacities to the terminals, ``links`` undirected edges. Flow straight through
    a node is sent first; shortest augmenting paths over the residual graph carry the rest.
    """
    n = len(source)
    supply = [s - min(s, t) for s, t in zip(source, sink)]
    demand = [t - min(s, t) for s, t in zip(source, sink)]
    to: list[int] = []
    room: list[int] = []
    of: list[list[int]] = [[] for _ in range(n)]
    for i, j, c in links:
        of[i].append(len(to))
        of[j].append(len(to) + 1)
        to += [j, i]
        room += [c, c]
    while True:
        # all shortest ways from nodes with supply, then augment along each tree path that ends at a demand
        via = [-2] * n
        queue = deque()
        for k in range(n):
            if supply[k] > 0:
                via[k] = -1
                queue.append(k)
        found = []
        while queue:
            k = queue.popleft()
            if demand[k] > 0:
                found.append(k)
                continue
            for e in of[k]:
                if room[e] > 0 and via[to[e]] == -2:
                    via[to[e]] = e
                    queue.append(to[e])
        if not found:
            return [v != -2 for v in via]
        for end in found:
            path, k = [], end
            while via[k] >= 0:
                path.append(via[k])
                k = to[via[k] ^ 1]
            push = min([supply[k], demand[end], *(room[e] for e in path)])
            if push > 0:
                supply[k] -= push
                demand[end] -= push
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push


def label(page: list[Block], weights: np.ndarray, neighbour: float = NEIGHBOUR, sibling: float = SIBLING) -> list[bool]:
    """Whether each block is content."""
    if not page:
        return []
    z = np.clip(features(page) @ weights, -8, 8)
    # cost of calling a block boilerplate is cut from the source, that of calling it content from the sink
    source = (np.log1p(np.exp(z)) * _UNIT).astype(np.int64).tolist()
    sink = (np.log1p(np.exp(-z)) * _UNIT).astype(np.int64).tolist()
    return minimum_cut(source, sink, edges(page, neighbour, sibling))


def fitted(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> np.ndarray:
    known = pages.where("html is not null")
    chosen = known.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(sample_pages)
    # one page of each id, picked by hash, so that repeated ids don't add to the sample
    one = known.join(F.broadcast(chosen.distinct()), "page_id").groupBy("page_id").agg(F.min_by("html", F.struct(F.xxhash64("html"), "html")).alias("html"))
    return fit([r.html for r in one.orderBy("page_id").collect()])


def extract_html(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, neighbour: float = NEIGHBOUR, sibling: float = SIBLING, weights: np.ndarray | None = None) -> DataFrame:
    """(page_id, text, n_blocks, n_content) of every page: its content blocks, one a line.

    The classifier is fitted on at most ``sample_pages`` pages, unless ``weights`` are given. A null page has
    null results; an empty page, or one without text, an empty text. Broken markup is read as far as it goes, and
    pages of any length whole. Of equally cheap cuts the one with least content counts.
    Repeated rows and null ids are kept, other columns are ignored, and an empty table gives no rows.
    """
    w = fitted(pages, sample_pages) if weights is None else weights

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], []]
        for page in batch.column("html").to_pylist():
            if page is None:
                row = (None, None, None)
            else:
                found = blocks(page)
                content = label(found, w, neighbour, sibling)
                row = ("\n".join(b.text for b, c in zip(found, content) if c), len(found), sum(content))
            for column, value in zip(out, row):
                column.append(value)
        return pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32())], ["page_id", "text", "n_blocks", "n_content"])

    return map_batches(pages.select("page_id", "html"), run, "page_id bigint, text string, n_blocks int, n_content int")
