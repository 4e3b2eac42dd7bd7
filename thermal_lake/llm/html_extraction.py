"""Main text of web pages by minimum-cut labelling.

A page becomes blocks: the texts between block-level tags, in page order. Explicit marks (``article``, ``nav``, a class that
says ``sidebar`` and so on; the innermost counts) label many blocks. A logistic model is trained on the shapes of these blocks, so that
unmarked blocks have a probability too. Each block is tied to the source with the cost of calling it boilerplate and to the
sink with the cost of calling it content; neighbours in the page and blocks of one parent are tied to each other, more
strongly the nearer they are in the tree. The minimum cut of that graph is the labelling of least total cost. Blocks whose own
costs exceed all their ties are settled first, which changes no minimum cut and leaves most pages without a flow to compute.

Cases: a null or empty page has an empty text. Broken markup is read as far as it goes: unclosed elements end with their
parents, an unfinished tag is dropped. Repeated rows each get a row. Pages of any size are read whole; nothing is cut from the
text. If no page of the sample is marked, only marks and ties decide. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy

SAMPLE = 2000  # pages, about, that the model is trained on
MARK = 8.0  # cost of going against a mark
MOST = 4.0  # largest cost that the model alone can set
TIE = 0.6  # cost of parting two neighbours of one parent; divided by their distance in the tree

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
MARKED = re.compile(r"""\b(class|id|role|itemprop|aria-hidden|hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td template textarea tfoot th thead title tr ul".split())
CLOSES_P = BLOCKS - set("caption td th tr tbody thead tfoot option optgroup legend summary title head html body".split())
SAME = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCE = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}

#: Marks: tags and words of classes and ids.
GOOD_TAGS = set("article main".split())
BAD_TAGS = set("nav footer aside form head noscript template iframe object svg select button textarea dialog menu title canvas audio video".split())
BAD_WORDS = set("nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside widget related recommended promo promotion ad ads advert adverts advertisement advertising banner sponsor sponsored cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments disqus reply replies respond form search pagination pager copyright legal toolbar skip teaser outbrain taboola".split())
TOP_WORDS = set("header masthead topbar".split())  # boilerplate unless inside the article
GOOD_WORDS = set("article articlebody post entry story content main text".split())
FEATURES = ("one", "length", "links", "words", "stops", "commas", "paragraph", "item", "heading", "named", "outside", "place")


@dataclass
class Element:
    tag: str
    mark: int  # 1 content, -1 boilerplate, 0 unmarked; the innermost mark of its ancestors counts
    parent: "Element | None"
    depth: int
    named: bool = False


@dataclass
class Block:
    parent: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _mark(tag: str, attributes: str, inside: int) -> tuple[int, bool]:
    mark = 1 if tag in GOOD_TAGS else -1 if tag in BAD_TAGS or tag == "header" and inside != 1 else 0
    named = False
    if attributes and mark >= 0:
        for key, value in MARKED.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                return -1, False
            if key in ("class", "id", "role", "itemprop") and tag not in ("html", "body"):
                words = {w.lower() for w in NAME.findall(value)}
                if words & BAD_WORDS or inside != 1 and words & TOP_WORDS:
                    return -1, False
                if key in ("role", "itemprop") and value.lower() in ("main", "article", "articlebody"):
                    mark = 1
                named = named or bool(words & GOOD_WORDS)
    return mark, named


def blocks_of(page: str) -> list[Block]:
    """Blocks with a text, in page order."""
    root = Element("", 0, None, 0)
    stack, out, now, link = [root], [], None, 0
    at, size = 0, len(page)

    def shut(k: int) -> None:
        nonlocal now, link
        for e in stack[k:]:
            if e.tag == "a":
                link -= 1
            if e.tag in BLOCKS:
                now = None
        del stack[k:]

    def say(raw: str) -> None:
        nonlocal now
        if "&" in raw:
            raw = html.unescape(raw)
        if now is None:
            if raw.isspace():
                return
            now = Block(stack[-1])
            out.append(now)
        now.parts.append(raw)
        if link:
            now.linked += len(raw)

    while at < size:
        m = TOKEN.search(page, at)
        end = m.start() if m else size
        if end > at:
            say(page[at:end])
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, closing, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    shut(k)
                    break
            if tag in BLOCKS:
                now = None
            continue
        if tag in RAW:
            found = re.compile(f"</{tag}", re.I).search(page, at)
            at = found.start() if found else size
            continue
        if tag == "br":
            if now is not None:
                now.parts.append(" ")
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    shut(k)
                    break
                if stack[k].tag in BLOCKS:
                    break
        if tag in SAME:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in SAME[tag]:
                    shut(k)
                    break
                if stack[k].tag in FENCE[tag]:
                    break
        if tag in BLOCKS:
            now = None
        if tag in VOID:
            continue
        if tag == "body":
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "head":
                    shut(k)
                    break
        top = stack[-1]
        mark, named = _mark(tag, attributes, top.mark)
        stack.append(Element(tag, mark or top.mark, top, top.depth + 1, named or top.named))
        if tag == "a":
            link += 1
    for b in out:
        b.text = " ".join("".join(b.parts).split())
    return [b for b in out if b.text]


def shape(blocks: list[Block]) -> np.ndarray:
    """FEATURES of every block."""
    article = any(b.parent.mark == 1 for b in blocks)
    rows = []
    for i, b in enumerate(blocks):
        n, t = len(b.text), b.text
        e = b.parent
        while e.parent is not None and e.tag not in BLOCKS:
            e = e.parent
        words = t.count(" ") + 1
        rows.append((1.0, math.log1p(n), min(1.0, b.linked / n), math.log1p(words), min(1.0, (t.count(".") + t.count("!") + t.count("?")) / words * 5), min(1.0, t.count(",") / words * 5), float(e.tag == "p"), float(e.tag == "li"), float(e.tag[:1] == "h" and e.tag[1:].isdigit()), float(b.parent.named), float(article and b.parent.mark != 1), i / len(blocks)))
    return np.array(rows).reshape(len(blocks), len(FEATURES))


def steps_between(a: Element, b: Element) -> int:
    """Edges between two elements of the tree."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def ties(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: neighbours in the page, and each block with the last one of its parent."""
    out, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            out.append((i - 1, i, TIE / (1 + steps_between(blocks[i - 1].parent, b.parent))))
        own = b.parent.parent or b.parent
        j = last.get(id(own))
        if j is not None and j != i - 1:
            out.append((j, i, TIE / 3))
        last[id(own)] = i
    return out


def minimum_cut(costs: np.ndarray, edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node stays with the source. costs[i]: what the sink side costs node i more than the source side."""
    n = len(costs)
    label: list[bool | None] = [None] * n
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    own, pull = [float(c) for c in costs], [sum(w for _, w in x) for x in near]
    work = deque(range(n))
    while work:  # a node whose own cost exceeds what its undecided neighbours can add is settled
        i = work.popleft()
        if label[i] is not None or abs(own[i]) <= pull[i]:
            continue
        label[i] = own[i] > 0
        for j, w in near[i]:
            if label[j] is None:
                own[j] += w if label[i] else -w
                pull[j] -= w
                work.append(j)
    left = [i for i in range(n) if label[i] is None]
    if left:
        keep = _flow(left, own, near, label)
        for i in left:
            label[i] = i in keep
    return [bool(x) for x in label]


def _flow(nodes: list[int], own: list[float], near: list[list[tuple[int, float]]], label: list) -> set[int]:
    """Nodes on the source side of a minimum cut, by shortest augmenting paths."""
    room: dict[int, dict[int, float]] = {-1: {}, -2: {}}
    for i in nodes:
        room[i] = {}
    for i in nodes:
        a, b = (-1, i) if own[i] > 0 else (i, -2)
        room[a][b] = room[a].get(b, 0.0) + abs(own[i])
        room[b].setdefault(a, 0.0)
        for j, w in near[i]:
            if label[j] is None:
                room[i][j] = room[i].get(j, 0.0) + w
                room[j].setdefault(i, 0.0)
    while True:
        came, queue = {-1: -1}, deque([-1])
        while queue and -2 not in came:
            x = queue.popleft()
            for y, c in room[x].items():
                if c > 1e-12 and y not in came:
                    came[y] = x
                    queue.append(y)
        if -2 not in came:
            return {x for x in came if x >= 0}
        path, y = [], -2
        while y != -1:
            path.append((came[y], y))
            y = came[y]
        flow = min(room[a][b] for a, b in path)
        for a, b in path:
            room[a][b] -= flow
            room[b][a] += flow


def extract(page: str | None, weights: np.ndarray) -> str:
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    score = np.clip(shape(blocks) @ weights, -MOST, MOST)
    costs = np.array([MARK * b.parent.mark for b in blocks]) + score
    return "\n\n".join(b.text for b, keep in zip(blocks, minimum_cut(costs, ties(blocks))) if keep)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Logistic weights by Newton's method with a quadratic penalty; zero without both kinds of rows."""
    w = np.zeros(len(FEATURES))
    if not len(y) or y.min() == y.max():
        return w
    share = np.where(y > 0, 0.5 / (y > 0).mean(), 0.5 / (y <= 0).mean())  # both kinds weigh the same
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (share * (p - y)) + ridge * w
        h = (x * (share * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(pages: DataFrame, key: str = "page_id", page: str = "html", sample: int = SAMPLE) -> np.ndarray:
    """Weights of FEATURES from the marked blocks of about ``sample`` pages, chosen by a hash of their key.

    The sample bounds what reaches the driver, whatever the number of pages; all pages are labelled with its result.
    """
    width = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                blocks = blocks_of(text or "")
                rows = [(i, r) for i, r in enumerate(shape(blocks)) if blocks[i].parent.mark]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([blocks[i].parent.mark for i, _ in rows], pa.int32()), pa.array([r.tolist() for _, r in rows], pa.list_(pa.float64()))], names=["mark", "x"])

    every = max(1, pages.count() // sample)
    rows = pages.where(F.pmod(F.xxhash64(key), F.lit(every)) == 0).select(page).mapInArrow(run, "mark int, x array<double>").collect()
    x = np.array([r.x for r in rows]).reshape(len(rows), width)
    outside = FEATURES.index("outside")  # follows from the marks themselves, so the model must not learn from it
    x[:, outside] = 0
    w = fit(x, np.array([float(r.mark > 0) for r in rows]))
    w[outside] = -2 * MOST
    return w


def label(pages: DataFrame, weights: np.ndarray, keep: list[str], page: str = "html") -> DataFrame:
    """``keep`` columns, text and n_chars of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            for part in slices(batch, "_html"):
                texts = [extract(x, weights) for x in part.column(len(names)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*names, "text", "n_chars"])

    names = [f"_k{i}" for i in range(len(keep))]
    src = pages.select(*(F.col(c).alias(n) for c, n in zip(keep, names)), F.col(page).alias("_html"))
    out = src.mapInArrow(run, ", ".join([*(f"{n} {t}" for n, t in src.dtypes[:-1]), "text string, n_chars long"]))
    return out.withColumnsRenamed(dict(zip(names, keep)))
