"""HTML extraction: the main text of pages, by a minimum cut between content and boilerplate.

A page becomes blocks: runs of text between block-level tags, in page order. Each block is a node of a graph. A
classifier's cost of calling it content or boilerplate is its capacity to the two terminals; neighbours in page
order are joined by edges that weaken with their distance in the document tree, and blocks that follow each other under
one parent by one more. The maximum flow between the terminals gives the labelling of least total cost, in
which a short paragraph follows the article around it and a long advert stays outside.

The classifier adds what the containers say (`MARKS`: the tag, role, class and id words of the ancestors) and a logistic
regression over a block's own looks (words, share of link text, kind of tag, punctuation). The regression is
trained here, without labels: blocks inside marked containers teach it what content and boilerplate look like,
so that blocks without any mark can be judged. Training reads about `SAMPLE` pages (those of the smallest seeded hash) and sums
them up as counts by feature bucket, fewer than `BUCKETS` rows whatever the pages; weights are drawn to `PRIOR` where there is
little to learn from. Pages are independent: extraction is one pass without a shuffle.

Defined cases: a null or empty html has no blocks and gives an empty text. Scripts, styles, titles, comments, form fields and
elements marked as hidden are no blocks. Character references are decoded as browsers do, white space (no-break spaces too) becomes one space, br is white
space. Unclosed tags end where a tag that cannot stand inside them begins; a tag cut off by the page's end is dropped. Where no block is
content the text is empty. Repeated rows give equal rows, empty tables none. Extra columns but the html are kept; those of the
result's names are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import slices, utf8

SAMPLE = 20_000
UNIT = 1024
ADJACENT, SIBLING = 1.0, 0.5
MOST_LOGIT = 3.0
MARKS = {2: 6.0, 1: 4.0, 0: 0.0, -1: -5.0, -2: -8.0}
RIDGE, CLASS_WEIGHT, STEPS = 1.0, 200.0, 30

# Element names of HTML, and words that pages use for their containers.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes".split())
HIDDEN = frozenset("button select option optgroup datalist label legend noscript template svg math object canvas audio video map".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre search "
    "section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tr": ("tr", "table tbody thead tfoot")}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
KINDS = {"p": 0, "blockquote": 0, "pre": 0, "li": 2, "dt": 2, "dd": 2, "td": 3, "th": 3, "caption": 3} | dict.fromkeys(HEADINGS, 1)
TAG_MARKS = {"article": 2, "main": 2, "form": -1} | dict.fromkeys("nav header footer aside dialog menu search address".split(), -2)
ROLE_MARKS = {"article": 2, "main": 2, "form": -1} | dict.fromkeys("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar status".split(), -2)
CONTENT_WORDS = frozenset("article body content entry main post prose story text".split())
OTHER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense alert aside banner breadcrumb breadcrumbs byline comment commentlist comments consent cookie cookies copyright credits dialog "
    "disclaimer discussion disqus dropdown feedback footer form gdpr header legal login masthead menu menubar meta modal nav navbar navigation newsletter notice notices notification overlay pager "
    "pagination paging paywall popular popup promo promotion rail recommendations recommended register related replies reply respond search share sharing sidebar signin signup skip social "
    "sponsor sponsored sponsors subscribe subscription tagcloud tags teaser toolbar topbar trending widget widgets".split()
)

_TAG = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>]+))?""")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_ENDS = re.compile(r"""[.!?:;…。！？]["'»”’)]*$""")
_ODD = re.compile(r"[©|»·•]")


class Block(NamedTuple):
    """A run of text: its kind, the mark of its containers, the share of link text, and the serials of its ancestors."""

    text: str
    kind: int
    mark: int
    links: float
    path: tuple[int, ...]


class _Open(NamedTuple):
    """An element that is open: what it is, what its containers say, and whether its text counts."""

    tag: str
    mark: int
    hidden: bool
    path: tuple[int, ...]


def own_mark(tag: str, attributes: str) -> tuple[int, bool]:
    """What an element says about its inside, and whether it is hidden."""
    mark, hidden = TAG_MARKS.get(tag, 0), tag in HIDDEN
    if "=" not in attributes and "hidden" not in attributes:
        return mark, hidden
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            hidden = True
        elif name == "role":
            mark = min(mark, found, key=lambda m: (m >= 0, -abs(m))) if (found := ROLE_MARKS.get(value.lower(), 0)) else mark
        elif name in ("class", "id") and tag not in ("body", "html"):
            for whole in value.split():
                parts = [p.lower() for p in _NAME_PARTS.findall(whole)]
                if any(p in OTHER_WORDS for p in parts) and (tag not in ("article", "main") or len(parts) == 1 or parts[0].startswith("comment")):
                    mark = -2
                elif mark == 0 and any(p in CONTENT_WORDS for p in parts):
                    mark = 1
    return mark, hidden


def inside(outer: int, own: int, tag: str) -> int:
    """The mark of an element in a container: boilerplate keeps what it holds, but for an article inside a form."""
    if own == 0 or outer == -2:
        return outer
    if outer == -1:
        return own if own in (2, -2) else -1
    return own if own < 0 else max(outer, own)


def blocks(html: str) -> list[Block]:
    """The blocks of a page in page order."""
    found: list[Block] = []
    serial = 0
    stack = [_Open("", 0, False, ())]
    open_tags: Counter = Counter()
    parts: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            top = stack[-1]
            if text and not top.hidden:
                found.append(Block(text, KINDS.get(top.tag, 4), top.mark, min(1.0, linked / len(text)), top.path))
            parts.clear()
        linked = 0

    def pop_to(k: int) -> None:
        while len(stack) > k:
            open_tags[stack.pop().tag] -= 1

    def say(text: str) -> None:
        nonlocal linked
        if not stack[-1].hidden:
            text = unescape(text) if "&" in text else text
            parts.append(text)
            if links:
                linked += len(text.strip())

    at, n = 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            say(html[at:])
            break
        if m.start() > at:
            say(html[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if m[2] is None and not m[0].endswith(">"):
            break  # cut off by the page's end
        if closing:
            if tag == "a":
                links = 0
            elif open_tags[tag]:
                flush()
                pop_to(max(k for k in range(len(stack)) if stack[k].tag == tag) if stack[-1].tag != tag else len(stack) - 1)
                links = 0 if tag in BLOCK else links
            elif tag in ("p", "br"):
                flush() if tag == "p" else parts.append(" ")
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE).search(html, at)
            if end is None:
                break
            at = end.start()
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                parts.append(" ")
            continue
        if tag == "a":
            links = 1
            continue
        if tag not in BLOCK and tag not in HIDDEN:
            if "hidden" not in attributes and "none" not in attributes:
                continue  # inline: part of the block around it
            if attributes.endswith("/") or not own_mark(tag, attributes)[1]:
                continue
        flush()
        if tag in BLOCK:
            if stack[-1].tag == "p":
                pop_to(len(stack) - 1)
            if tag in CLOSES:
                ends, bounds = (x.split() for x in CLOSES[tag])
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in bounds:
                        break
                    if stack[k].tag in ends:
                        pop_to(k)
                        break
        top = stack[-1]
        mark, hidden = own_mark(tag, attributes)
        if tag == "header" and top.mark > 0 and mark == -2:
            mark = -3  # an article's own header: its headings are the article's
        serial += 1
        now = -3 if mark == -3 or top.mark == -3 and tag not in HEADINGS else top.mark if mark == 0 else inside(top.mark, mark, tag)
        if top.mark == -3 and tag in HEADINGS:
            now = 2
        stack.append(_Open(tag, now, top.hidden or hidden, (*top.path, serial)))
        open_tags[tag] += 1
    flush()
    return found


BUCKETS = 7 * 4 * 5 * 2 * 2
_SIZES = (7, 4, 5, 2, 2)  # words, link text, kind, punctuation at the end, odd characters
PRIOR = np.array([-1.2, -0.4, 0.0, 0.4, 0.8, 1.2, 1.6] + [0.5, 0.0, -1.5, -3.0] + [1.5, 1.0, -0.3, -0.3, 0.0] + [0.0, 0.7] + [0.0, -2.0] + [-1.0])


def bucket(block: Block) -> int:
    """The number of a block's feature bucket."""
    words = min(7, (block.text.count(" ") + 1).bit_length()) - 1
    link = 0 if block.links == 0 else 1 if block.links <= 0.3 else 2 if block.links <= 0.7 else 3
    tail = block.text[-8:]
    at = (words * 4 + link) * 5 + block.kind
    return (at * 2 + bool(_ENDS.search(tail))) * 2 + bool(_ODD.search(block.text[:200]))


def places(buckets: np.ndarray) -> np.ndarray:
    """For each bucket the weights that it adds, one of each feature and the bias."""
    out, rest, end = [], buckets.astype(np.int64), sum(_SIZES)
    for size in reversed(_SIZES):
        end -= size
        out.append(end + rest % size)
        rest = rest // size
    return np.stack([*out, np.full(len(buckets), len(PRIOR) - 1)], axis=1)


def fit(counts: list[tuple[int, int, int]]) -> np.ndarray:
    """The logit of each bucket, from (bucket, label, count): Newton's steps, both labels weighing the same."""
    w = PRIOR.copy()
    if counts:
        at, label, n = (np.array(x) for x in zip(*counts, strict=True))
        weight = n * CLASS_WEIGHT / np.where(label == 1, max(1, n[label == 1].sum()), max(1, n[label == 0].sum()))
        x = np.zeros((len(at), len(PRIOR)))
        x[np.arange(len(at))[:, None], places(at)] = 1
        for _ in range(STEPS):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
            slope = x.T @ (weight * (label - p)) - RIDGE * (w - PRIOR)
            w = w + np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w)), slope)
    return w[places(np.arange(BUCKETS))].sum(axis=1)


def edges(found: list[Block]) -> list[tuple[int, int, int]]:
    """(block, block, capacity): neighbours in page order, and followers under one parent."""
    out, last = [], {}
    for k, b in enumerate(found):
        parent = b.path[:-1]
        if k:
            other = found[k - 1].path
            same = 0
            for x, y in zip(other, b.path, strict=False):
                if x != y:
                    break
                same += 1
            away = max(0, len(other) + len(b.path) - 2 * same - 2)
            out.append((k - 1, k, round(UNIT * ADJACENT / (1 + away))))
        if parent in last:
            out.append((last[parent], k, round(UNIT * SIBLING)))
        last[parent] = k
    return out


def cut(costs: list[int], joined: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes lie on the source's side of a minimum cut; a positive cost is what a node loses by leaving it.

    Nodes whose own cost outweighs all their edges are settled first and pass their edges on; the rest is a maximum flow
    along shortest paths. Of several minimum cuts the one with the fewest nodes on the source's side.
    """
    n, cost = len(costs), list(costs)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, c in joined:
        if a != b and c:
            near[a][b] = near[a].get(b, 0) + c
            near[b][a] = near[b].get(a, 0) + c
    weight = [sum(x.values()) for x in near]
    side: list[bool | None] = [None] * n
    ready = list(range(n))
    while ready:
        k = ready.pop()
        if side[k] is None and (abs(cost[k]) > weight[k] or weight[k] == 0):
            side[k] = cost[k] > 0
            for j, c in near[k].items():
                if side[j] is None:
                    del near[j][k]
                    weight[j] -= c
                    cost[j] += c if side[k] else -c
                    ready.append(j)
    rest = [k for k in range(n) if side[k] is None]
    if rest:
        reached = _source_side({k: cost[k] for k in rest}, {k: {j: c for j, c in near[k].items() if side[j] is None} for k in rest})
        for k in rest:
            side[k] = k in reached
    return [bool(x) for x in side]


def _source_side(cost: dict[int, int], spare: dict[int, dict[int, int]]) -> set[int]:
    """Nodes that the source still reaches after a maximum flow (Dinic's levels); `spare` are symmetric capacities."""
    source = {k: c for k, c in cost.items() if c > 0}
    sink = {k: -c for k, c in cost.items() if c < 0}
    while True:
        level = {k: 0 for k, c in source.items() if c}
        queue, found = list(level), False
        for k in queue:
            found = found or sink.get(k, 0) > 0
            for j, c in spare[k].items():
                if c and j not in level:
                    level[j] = level[k] + 1
                    queue.append(j)
        if not found:
            return set(level)
        arcs, at = {k: list(spare[k]) for k in level}, dict.fromkeys(level, 0)
        for start in [k for k in level if level[k] == 0]:
            path = [start]
            while path and source[start]:
                k = path[-1]
                if sink.get(k, 0):
                    flow = min(source[start], sink[k], *(spare[a][b] for a, b in zip(path, path[1:], strict=False)))
                    source[start] -= flow
                    sink[k] -= flow
                    for a, b in zip(path, path[1:], strict=False):
                        spare[a][b] -= flow
                        spare[b][a] += flow
                    full = next((i for i, (a, b) in enumerate(zip(path, path[1:], strict=False)) if not spare[a][b]), None)
                    path = path[: full + 1] if full is not None else path
                    continue
                own = arcs[k]
                while at[k] < len(own) and not (spare[k][own[at[k]]] and level.get(own[at[k]]) == level[k] + 1):
                    at[k] += 1
                if at[k] < len(own):
                    path.append(own[at[k]])
                else:
                    path.pop()
                    level[k] = -1


def judged(html: str, logits: np.ndarray) -> list[tuple[Block, int, bool]]:
    """The blocks of a page, their costs, and whether they are content."""
    found = blocks(html)
    mark = lambda b: MARKS[max(-2, b.mark)]
    costs = [round(UNIT * (float(np.clip(logits[bucket(b)], -MOST_LOGIT, MOST_LOGIT)) + mark(b))) for b in found]
    return list(zip(found, costs, cut(costs, edges(found)), strict=True))


def learn(pages: DataFrame, html: str = "html", key: str = "page_id", most: int = SAMPLE) -> np.ndarray:
    """The logits of all buckets, learned from the marked blocks of about `most` pages."""
    n = pages.count()
    h = F.shiftrightunsigned(F.xxhash64(F.lit("pages"), F.col(key)), 11)  # 53 bits
    sample = pages.where(h < F.lit(int(min(1.0, most / max(1, n)) * (1 << 53)))).select(html)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                met.update((bucket(b), int(b.mark > 0)) for b in blocks(page or "") if b.mark)
        at = [x for x, _ in met.items()]
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in at], pa.int32()), pa.array([y for _, y in at], pa.int32()), pa.array(list(met.values()), pa.int64())], names=["bucket", "label", "n"])

    rows = sample.mapInArrow(count, "bucket int, label int, n long").groupBy("bucket", "label").agg(F.sum("n").alias("n"))
    return fit([tuple(r) for r in rows.orderBy("bucket", "label").collect()])  # at most two rows a bucket


def _per_page(pages: DataFrame, kept: list[str], html: str, kind: T.StructType, make) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = utf8(batch.column(len(kept)))
            for i, j in slices(offsets):
                part = batch.slice(i, j - i)
                yield make(part, part.column(len(kept)).to_pylist())

    return pages.select(*kept, html).mapInArrow(run, kind)


def extract(pages: DataFrame, logits: np.ndarray, html: str = "html") -> DataFrame:
    """`pages` without the html, with text (the content blocks, joined by empty lines) and n_chars (its code points)."""
    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    kind = pages.select(*kept).schema.add("text", "string").add("n_chars", "long")

    def make(part: pa.RecordBatch, found: list[str | None]) -> pa.RecordBatch:
        texts = ["\n\n".join([b.text for b, _, content in judged(page, logits) if content]) if page else "" for page in found]
        return pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=kind.names)

    return _per_page(pages, kept, html, kind, make)


def labelled(pages: DataFrame, logits: np.ndarray, html: str = "html", key: str = "page_id") -> DataFrame:
    """One row a block: the page's key, the block's place and text, its cost of leaving the content, and its label."""
    kind = pages.select(key).schema.add("place", T.IntegerType()).add("text", "string").add("cost", "double").add("content", "boolean")

    def make(part: pa.RecordBatch, found: list[str | None]) -> pa.RecordBatch:
        rows = [(i, k, b.text, c / UNIT, content) for i, page in enumerate(found) if page for k, (b, c, content) in enumerate(judged(page, logits))]
        at, place, text, cost, content = zip(*rows, strict=True) if rows else ((),) * 5
        return pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array(place, pa.int32()), pa.array(text, pa.string()), pa.array(cost, pa.float64()), pa.array(content, pa.bool_())], names=kind.names)

    return _per_page(pages, [key], html, kind, make)
