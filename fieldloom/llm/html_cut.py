"""Main text of web pages by minimum-cut labelling of their text blocks.

A page becomes a row of blocks. A classifier gives each block a cost of being boilerplate and a cost of being content
(the terminal capacities); blocks that are neighbours on the page or close in the DOM tree are tied by smoothness
edges. The maximum flow separates content from boilerplate. The classifier is a logistic regression over features of
text and markup, fitted on a bounded sample of pages whose own semantic markup labels their blocks. Each block is learnt
from twice, with its markup and without, so that both kinds of features get weights of one scale: text, neighbours and
markup decide together, and text and neighbours alone where a page marks nothing.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of the HTML standard and common class words.
BLOCK_TAGS = frozenset(
    "html body main article section nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption"
    " thead tbody tfoot tr td th blockquote pre form fieldset figure figcaption address details summary hr center"
    " noscript dialog menu hgroup".split()
)
CLOSE_P = BLOCK_TAGS - {"html", "body"}
SKIPPED = frozenset("head script style template noscript svg iframe object select textarea button canvas math".split())
RAW = frozenset(("script", "style", "textarea", "title", "iframe", "noscript"))
CONTENT_TAGS = frozenset(("article", "main"))
BOILER_TAGS = frozenset(("nav", "header", "footer", "aside", "form", "menu", "dialog"))
BOILER_WORDS = frozenset(
    "ad ads advert advertisement advertising banner promo sponsor sponsored sidebar nav navbar navigation menu footer"
    " header masthead breadcrumb breadcrumbs comment comments reply replies disqus cookie cookies consent notice alert"
    " popup modal share sharing social related recommended newsletter subscribe subscription signup login pagination"
    " pager toolbar widget".split()
)
CONTENT_WORDS = frozenset("article content post entry story main".split())
SELF_CLOSING = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z",
    re.S,
)
CLASS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORDS = re.compile(r"[a-z0-9]+")

#: The least share of the page's text that makes an element with boilerplate marks a wrapper of the main part.
WRAPPER_SHARE = 1 / 3
#: Smoothness of neighbours on the page and of siblings further apart, divided by their distance in the tree.
ADJACENT, SIBLING = 3.0, 2.0


@dataclass(slots=True)
class Block:
    text: str
    path: tuple[int, ...]
    tag: str
    link_chars: int
    content: bool
    boiler: bool
    wrapped: bool = False  # boilerplate marks stand on a wrapper only
    outside: bool = False  # the page marks its content, and not here


@dataclass(slots=True)
class Node:
    tag: str
    content: bool  # by its own tag or words
    named: bool  # by its own words boilerplate
    chars: int = 0  # text of the whole element outside boilerplate tags


def _words_of(attributes: str) -> set[str]:
    found: set[str] = set()
    for m in CLASS.finditer(attributes):
        found.update(WORDS.findall((m[1] or m[2] or m[3] or "").lower()))
    return found


def wrappers(nodes: list[Node], blocks: list[Block]) -> set[int]:
    """Elements with boilerplate marks that hold the page's main part, so that the marks can't tell of all their text.

    The main part is the content element with most text (the first one on ties) and those in it that hold most of its
    text, or any element with the share where the page marks no content. Boilerplate tags around the main part are
    wrappers where it is most of the page's text.
    """
    whole = everything = 0
    leads: dict[int, tuple[int, ...]] = {}
    for b in blocks:
        plain = True  # no boilerplate tag from here on inwards
        for at in range(len(b.path) - 1, -1, -1):
            k = b.path[at]
            if plain and nodes[k].tag in BOILER_TAGS:
                plain = False
            if plain:
                nodes[k].chars += len(b.text)
                if nodes[k].content:
                    leads[k] = b.path[: at + 1]
        whole += len(b.text) * plain
        everything += len(b.text)
    lead = max(leads, key=lambda k: (nodes[k].chars, -k), default=None)
    if lead is None:
        return {k for k, n in enumerate(nodes) if n.named and n.chars and n.chars >= WRAPPER_SHARE * whole}
    around = {k for k in leads[lead] if nodes[k].tag in BOILER_TAGS} if 2 * nodes[lead].chars > everything else set()
    if not around and any(nodes[k].tag in BOILER_TAGS for k in leads[lead]):
        free = {k: p for k, p in leads.items() if not any(nodes[j].tag in BOILER_TAGS for j in p)}
        lead = max(free, key=lambda k: (nodes[k].chars, -k), default=lead)
    main = {k for k, path in leads.items() if lead in path and 2 * nodes[k].chars > nodes[lead].chars}
    named = {k for lone in main for k in leads[lone] if nodes[k].named}
    least = WRAPPER_SHARE * (everything if around else whole)
    return around | {k for k in named if nodes[k].chars >= least or k in main and nodes[k].tag in CONTENT_TAGS or around & set(leads[lead])}


def blocks_of(page: str | None) -> list[Block]:
    """The text blocks of a page in page order; unclosed and badly nested tags are closed as browsers do."""
    out: list[Block] = []
    stack: list[tuple[str, int, bool, bool]] = []  # tag, node, in content, skipped
    nodes: list[Node] = []
    text: list[str] = []
    state = {"link": 0, "chars": 0}

    def flush() -> None:
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                top = stack[-1] if stack else ("", 0, False, False)
                out.append(Block(joined, tuple(s[1] for s in stack), top[0], min(state["chars"], len(joined)), top[2], False))
            text.clear()
        state["chars"] = 0

    def close(at: int) -> None:
        flush()
        del stack[at:]

    page, at = page or "", 0
    while at < len(page):
        m = TOKEN.search(page, at)
        end = m.start() if m else len(page)
        if end > at and not (stack and stack[-1][3]):
            text.append(page[at:end])
            if state["link"]:
                state["chars"] += end - at
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:  # an end tag
            if tag == "a":
                state["link"] = 0
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            continue
        if tag in ("br", "wbr"):
            text.append(" " if tag == "br" else "")
            continue
        if tag == "a":
            state["link"] = 1
        if tag not in BLOCK_TAGS and tag not in SKIPPED:
            continue
        if tag in CLOSE_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] not in CLOSE_P:
                    break
        if tag in SELF_CLOSING:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in SELF_CLOSING[tag]:
                    break
                if stack[k][0] == tag or tag in ("dt", "dd") and stack[k][0] in ("dt", "dd"):
                    close(k)
                    break
        if tag == "body":
            for k, s in enumerate(stack):
                if s[0] == "head":  # a head that nothing closed
                    close(k)
                    break
        flush()
        if tag == "hr" or m[3].endswith("/") and tag in SKIPPED:
            continue
        words = _words_of(m[3]) if m[3] and tag not in ("html", "body") else set()
        _, _, inside, skipped = stack[-1] if stack else ("", 0, False, False)
        content = tag in CONTENT_TAGS or bool(words & CONTENT_WORDS)
        stack.append((tag, len(nodes), inside or content, skipped or tag in SKIPPED))
        nodes.append(Node(tag, content, bool(words & BOILER_WORDS)))
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b", re.I).search(page, at)
            at = stop.start() if stop else len(page)
    flush()
    wide = wrappers(nodes, out)
    for b in out:
        b.boiler = any((nodes[k].tag in BOILER_TAGS or nodes[k].named) and k not in wide for k in b.path)
        b.wrapped = any(k in wide for k in b.path)
        b.content = b.content and not b.boiler
    if any(b.content for b in out):
        for b in out:
            b.outside = not b.content
    return out


def features(blocks: list[Block]) -> np.ndarray:
    """Features of each block: TEXT_FEATURES of its text and place, then those of its markup."""
    rows = []
    for i, b in enumerate(blocks):
        n, words = len(b.text), b.text.count(" ") + 1
        stops = sum(b.text.count(c) for c in ".!?;:,")
        rows.append(
            (
                1.0,
                min(np.log1p(words), 6.0) / 3,
                b.link_chars / n,
                min(stops / words, 1.0),
                float(b.text[-1] in ".!?"),
                float(b.tag in ("p", "blockquote", "pre")),
                float(b.tag in ("li", "td", "dd")),
                float(b.tag[:1] == "h" and b.tag[1:].isdigit()),
                float(i == 0),
                float(i == len(blocks) - 1),
                float(b.content),
                float(b.boiler),
                float(b.wrapped),
                float(b.outside),
            )
        )
    return np.array(rows).reshape(-1, len(PLAIN_WEIGHTS))


TEXT_FEATURES = 10
#: Markup is trusted more than the look of the sample's texts, which other sites need not share.
TEXT_RIDGE, MARK_RIDGE, UNMARKED = 3e-3, 1e-5, 0.2  # ridges are for each block
#: Weights where no page of the sample carries semantic markup: long, punctuated, unlinked paragraphs are content.
PLAIN_WEIGHTS = np.array([-2.5, 1.8, -4.0, 1.0, 1.0, 1.5, -1.5, 0.8, -0.5, -1.0, 4.0, -6.0, 0.0, -4.0])


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Ridge logistic regression of weighted rows by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        w += np.linalg.solve(hessian, x.T @ (weight * (y - p)) - ridge * w)
    return w


def fit_blocks(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights from labelled blocks: each as it is, and with UNMARKED weight without its markup."""
    unmarked = x.copy()
    unmarked[:, TEXT_FEATURES:] = 0
    weight = np.repeat([1.0, UNMARKED], len(x))
    ridge = len(x) * np.where(np.arange(x.shape[1]) < TEXT_FEATURES, TEXT_RIDGE, MARK_RIDGE)
    return fit(np.concatenate([x, unmarked]), np.concatenate([y, y]), weight, ridge)


def minimum_cut(to_source: np.ndarray, to_sink: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """True for the nodes on the source side of a minimum cut (blocking flows on level graphs).

    ``to_source[i]`` is what it costs to cut node i off the source, ``to_sink[i]`` off the sink. Of several minimum
    cuts the one with the smallest source side is taken.
    """
    n = len(to_source)
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[float] = []

    def add(u: int, v: int, forth: float, back: float) -> None:
        head[u].append(len(to))
        to.append(v)
        cap.append(forth)
        head[v].append(len(to))
        to.append(u)
        cap.append(back)

    for i in range(n):
        both = min(to_source[i], to_sink[i])  # flows straight through
        if to_source[i] > both:
            add(s, i, to_source[i] - both, 0.0)
        elif to_sink[i] > both:
            add(i, t, to_sink[i] - both, 0.0)
    for u, v, c in edges:
        add(u, v, c, c)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in head[u]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return np.array([x >= 0 for x in level[:n]], bool)
        at = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if cap[e] <= tiny)
                u = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while at[u] < len(head[u]):
                e = head[u][at[u]]
                if cap[e] > tiny and level[to[e]] == level[u] + 1:
                    break
                at[u] += 1
            if at[u] < len(head[u]):
                path.append(head[u][at[u]])
                u = to[path[-1]]
            elif path:
                u = to[path.pop() ^ 1]
                at[u] += 1
            else:
                break


def ties(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: to the next block, and to the last earlier block of the same parent if that is further off."""

    def distance(a: tuple[int, ...], b: tuple[int, ...]) -> int:
        same = 0
        for x, y in zip(a, b):
            if x != y:
                break
            same += 1
        return len(a) + len(b) - 2 * same

    out, seen = [], {}
    for i, b in enumerate(blocks):
        parent = b.path[:-1]
        if i:
            out.append((i - 1, i, ADJACENT / (1 + distance(blocks[i - 1].path, b.path))))
        if parent in seen and seen[parent] < i - 1:
            out.append((seen[parent], i, SIBLING / (1 + distance(blocks[seen[parent]].path, b.path))))
        seen[parent] = i
    return out


def main_text(page: str | None, weights: np.ndarray) -> str:
    """The content blocks of a page, joined by line feeds."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    score = features(blocks) @ weights
    keep = minimum_cut(np.logaddexp(0, score), np.logaddexp(0, -score), ties(blocks))
    return "\n".join(b.text for b, k in zip(blocks, keep) if k)


def fit_weights(pages: DataFrame, page_id: str, markup: str, sample_pages: int) -> np.ndarray:
    """Fit the classifier on at most ``sample_pages`` pages (smallest hash of id and markup)."""
    sample = pages.select(F.col(page_id).alias("page_id"), F.col(markup).alias("html")).orderBy(
        F.xxhash64("page_id", "html"), "page_id"
    ).limit(sample_pages)

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page in batch.column("html"):
                blocks = blocks_of(page.as_py())
                if not any(b.content for b in blocks):
                    continue
                x = features(blocks)
                y = [float(b.content) for b in blocks]
                yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(y)], ["x", "y"])

    rows = sample.mapInArrow(labelled, "x array<double>, y double").collect()  # blocks of the bounded sample
    y = np.array([r.y for r in rows])
    if not len(y) or y.min() == y.max():
        return PLAIN_WEIGHTS
    return fit_blocks(np.array([r.x for r in rows]), y)


def extract_main_text(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", markup: str = "html", sample_pages: int = 400
) -> DataFrame:
    """page_id, url, text, n_chars of every row, null and repeated ids as they are.

    Null, empty or textless markup gives an empty text. Head, scripts, styles, form controls and comments are no
    blocks. White space inside a block, line breaks included, becomes one space. Rows don't depend on each other apart
    from the classifier's weights, so repeated rows give repeated results; other columns are ignored.
    """
    weights = fit_weights(pages, page_id, markup, sample_pages)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py(), weights) for p in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(markup).alias("html")
    ).mapInArrow(extract, "page_id long, url string, text string, n_chars long")
