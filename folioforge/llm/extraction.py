"""Main text of HTML pages by minimum-cut labelling.

A page is a graph of its text blocks and the elements around them. What a classifier makes of a block, as a log
odds, is the capacity to one of two terminals, main text and boilerplate; blocks that follow each other, and blocks and
elements with the elements they stand in, are joined by smoothness edges. The cut of least capacity labels
all blocks at once: a short line between paragraphs goes with them, a long one in a menu does not.

The classifier has two parts. Markup speaks by fixed costs: elements for articles or for navigation, and class names
that tell what they hold. Text speaks by a logistic regression over what a block looks like; it is trained on blocks of
a bounded sample of pages whose markup is plain (weak labels), stays near a prior where there are few, and is clipped, so
that it decides where markup is silent and never outvotes it.

Pages are independent: each is labelled inside the task that reads it, and only the classifier's weights travel.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_blocks import Page, read_page
from .memory import lean
from .scratch import smallest
from .words import text_batches

#: Pages the text classifier is trained on at most, and blocks of each.
TRAIN_PAGES = 2_000
TRAIN_BLOCKS = 64

# --- markup ------------------------------------------------------------------------------------------------------

#: Elements and roles, and words of class names and ids, that tell main text or boilerplate.
MAIN_TAGS = frozenset("article main".split())
OTHER_TAGS = frozenset("nav header footer aside form menu dialog search fieldset".split())
MAIN_WORDS = frozenset("article content main post entry story body prose text".split())
OTHER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising advertorial alert alertdialog aside banner breadcrumb breadcrumbs comment commentlist comments complementary consent contentinfo cookie cookies copyright "
    "dialog disclaimer discussion disqus footer form gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices overlay pager pagination paywall popular popup privacy promo promotion "
    "promoted rail recommended related replies reply respond responses search share sharebar sharing sidebar signup skip social sponsor sponsored subscribe subscription tagcloud teaser teasers toolbar topbar trending "
    "widget widgets".split()
)
#: Names that begin so tell what an element has or lacks, not what it is.
_ABOUT = re.compile(r"^(?:has|have|no|not|with|without|is|js)[-_]|(?:layout|wrapper|container|grid)$", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

MAIN_COST, NAME_COST, OUTSIDE_COST, OTHER_COST = 4.0, 2.5, -5.0, -9.0


def _named(names: str) -> tuple[bool, bool]:
    """(main text, boilerplate) by class names, ids and roles; both false where they tell nothing."""
    main = other = False
    for name in names.split():
        if _ABOUT.search(name):
            continue
        words = {w.lower() for w in _WORD.findall(name)}
        told = words & OTHER_WORDS
        if told == {"header"} and words & MAIN_WORDS:
            continue  # an entry's header holds its title
        if told:
            other = True
        elif words & MAIN_WORDS:
            main = True
    return main and not other, other


def markup_costs(page: Page) -> np.ndarray:
    """Log odds of main text for each block by the elements around it."""
    n = len(page.elements)
    kinds = [0] * n  # bits: 1 in main element, 2 in an element named so, 4 boilerplate
    main_seen = False
    for i, e in enumerate(page.elements):
        if not i:
            continue
        kind = kinds[e.parent]
        told, other = _named(e.names) if e.names and e.tag not in ("html", "body") else (False, False)
        if e.tag in MAIN_TAGS and not other:
            kind |= 1
            main_seen = main_seen or (e.size > 0 and not kind & 4)
        elif told:
            kind |= 2
        plain = e.tag in OTHER_TAGS and not (e.tag == "header" and kind & 1)
        if (plain or other) and not (e.title and (e.tag == "form" or other) and e.tag != "header" and not kind & 4):
            kind |= 4
        kinds[i] = kind
    cost = {k: (MAIN_COST if k & 1 else NAME_COST if k & 2 else 0.0) + (OTHER_COST if k & 4 else 0.0) + (OUTSIDE_COST if main_seen and not k & 1 else 0.0) for k in range(8)}
    return np.array([cost[kinds[b.element]] for b in page.blocks], float)


# --- text --------------------------------------------------------------------------------------------------------

FEATURES = ("bias", "words", "linked", "sentence", "stops", "heading", "title", "item", "cell", "paragraph", "rights", "around", "box", "early")
#: Where the weights start from and what few examples leave them at.
PRIOR = np.array([-1.2, 0.6, -3.5, 0.8, 0.4, 0.3, 1.5, -0.4, -0.3, 0.6, -5.0, 0.3, 0.1, -0.8])
#: Examples that the prior counts for.
PRIOR_WEIGHT = 20.0
CLIP = 3.0

_ENDS = frozenset(".!?…。！？\"”»")
_KINDS = {"h1": 2} | {f"h{k}": 1 for k in range(2, 7)} | dict.fromkeys(("li", "dt", "dd"), 3) | dict.fromkeys(("td", "th", "caption"), 4) | dict.fromkeys(("p", "blockquote", "pre"), 5)


def text_features(page: Page) -> np.ndarray:
    """A row of FEATURES for each block; markup other than the block's own element plays no part."""
    blocks, elements = page.blocks, page.elements
    if not blocks:
        return np.zeros((0, len(FEATURES)))
    first = next((k for k, b in enumerate(blocks) if elements[b.element].tag == "h1"), 0)
    rows = []
    for k, b in enumerate(blocks):
        e, text = elements[b.element], b.text
        words, kind = text.count(" ") + 1, _KINDS.get(e.tag, 0)
        rights = False
        if words < 60:
            low = text.lower()
            rights = "©" in text or "copyright" in low or "all rights reserved" in low
        stops = text.count(".") + text.count(",") + text.count("!") + text.count("?") + text.count(";") + text.count(":") + text.count("。") + text.count("、")
        box = elements[e.parent].size if e.parent > 0 else e.size
        rows.append((1, words, b.linked / len(text), text[-1] in _ENDS, min(1.0, 5 * stops / words), kind == 1, kind == 2, kind == 3, kind == 4, kind == 5, rights, 0, box, k < first))
    out = np.array(rows, float)
    out[:, 1] = np.log1p(out[:, 1])
    out[:, 12] = np.log1p(out[:, 12]) / 10
    out[1:, 11] = out[:-1, 1]
    np.maximum(out[:-1, 11], out[1:, 1], out=out[:-1, 11])
    return out


def fit_text(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression held to the prior; both classes weigh the same."""
    w = PRIOR.copy()
    if not len(y) or y.min() == y.max():
        return w
    share = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(30):  # Newton's steps, shortened where they are long
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (y - p)) - PRIOR_WEIGHT * (w - PRIOR)
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + PRIOR_WEIGHT * np.eye(len(w)), slope)
        w += step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, texts in text_batches(batch, "html"):
            rows = []
            for text in texts:
                page = read_page((text or b"").decode())
                cost = markup_costs(page)
                x = text_features(page)[(told := np.abs(cost) >= MAIN_COST)]
                every = max(1, -(-len(x) // TRAIN_BLOCKS))
                rows.append((x[::every].astype(np.float32).tobytes(), (cost[told][::every] > 0).astype(np.int8).tobytes()))
            yield pa.RecordBatch.from_arrays([batch["place"].slice(lo, len(texts)), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["place", "x", "y"])


def train_text(pages: DataFrame) -> np.ndarray:
    """Weights of the text classifier, from blocks of at most TRAIN_PAGES pages whose markup is plain.

    The pages are those with the smallest hashes of id and address; of a page, at most TRAIN_BLOCKS blocks spread
    evenly over it. Without plain markup the weights are the prior.
    """
    placed = pages.select(F.xxhash64("page_id", "url").alias("place"), "html")
    bound = smallest(placed.select("place"), "place", TRAIN_PAGES).agg(F.max("place")).first()[0]
    if bound is None:
        return PRIOR.copy()
    # pages alike in id and address count as one
    found = placed.filter(F.col("place") <= bound).mapInArrow(lean(_examples), "place long, x binary, y binary").groupBy("place").agg(F.min(F.struct("x", "y")).alias("of")).orderBy("place").collect()
    x = np.concatenate([np.empty((0, len(FEATURES)))] + [np.frombuffer(r["of"]["x"], np.float32).reshape(-1, len(FEATURES)) for r in found])
    y = np.concatenate([np.empty(0)] + [np.frombuffer(r["of"]["y"], np.int8) for r in found])
    return fit_text(x, y)


# --- cut ---------------------------------------------------------------------------------------------------------

ADJACENT, INSIDE = 1.2, 0.4
_SCALE = 1000


@dataclass
class Graph:
    """Nodes with a terminal capacity (positive: to main text) and undirected edges, all as integers."""

    terminal: list[int]
    edges: list[dict[int, int]]

    def join(self, a: int, b: int, capacity: int) -> None:
        self.edges[a][b] = self.edges[a].get(b, 0) + capacity
        self.edges[b][a] = self.edges[b].get(a, 0) + capacity


def page_graph(page: Page, costs: np.ndarray) -> Graph:
    """Blocks first, then the elements around them, which have no cost of their own."""
    n, elements = len(page.blocks), page.elements
    number: dict[int, int] = {}
    graph = Graph(np.rint(costs * _SCALE).astype(int).tolist(), [{} for _ in range(n)])

    def node(element: int) -> int:
        if element not in number:
            number[element] = len(graph.terminal)
            graph.terminal.append(0)
            graph.edges.append({})
            if elements[element].parent > 0:
                graph.join(number[element], node_of_parent(element), int(INSIDE * _SCALE / 2))
        return number[element]

    def node_of_parent(element: int) -> int:
        chain = [elements[element].parent]
        while chain[-1] not in number and elements[chain[-1]].parent > 0:
            chain.append(elements[chain[-1]].parent)
        for above in reversed(chain):  # from the outside in, without recursion
            if above not in number:
                number[above] = len(graph.terminal)
                graph.terminal.append(0)
                graph.edges.append({})
                if elements[above].parent > 0:
                    graph.join(number[above], number[elements[above].parent], int(INSIDE * _SCALE / 2))
        return number[chain[0]]

    for k, block in enumerate(page.blocks):
        own = elements[block.element]
        # a block's own element holds it alone as a rule: the box is the one around
        graph.join(k, node(own.parent if own.parent > 0 else block.element), int(INSIDE * _SCALE))
        if k:
            before = elements[page.blocks[k - 1].element]
            near = own.parent == before.parent or own is before
            graph.join(k - 1, k, int(ADJACENT * _SCALE / (1 if near else 3)))
    return graph


def minimum_cut(graph: Graph) -> list[bool]:
    """Whether each node is on the side of main text in a cut of least capacity.

    A node whose terminal outweighs all its edges is on that terminal's side in some least cut, and its edges then
    belong to its neighbours' terminals; this settles most nodes. Maximum flow decides the rest.
    """
    n = len(graph.terminal)
    terminal, free = list(graph.terminal), [sum(e.values()) for e in graph.edges]
    side: list[bool | None] = [None] * n
    waiting = deque(range(n))
    while waiting:
        v = waiting.popleft()
        if side[v] is not None or abs(terminal[v]) < free[v] or (terminal[v] == 0 and graph.edges[v] and free[v]):
            continue
        side[v] = terminal[v] >= 0
        for u, capacity in graph.edges[v].items():
            if side[u] is None:
                terminal[u] += capacity if side[v] else -capacity
                free[u] -= capacity
                waiting.append(u)
    rest = [v for v in range(n) if side[v] is None]
    if rest:
        for v, main in zip(rest, _flow(rest, terminal, graph.edges, side), strict=True):
            side[v] = main
    return [bool(s) for s in side]


def _flow(rest: list[int], terminal: list[int], edges: list[dict[int, int]], side: list[bool | None]) -> list[bool]:
    """Maximum flow by shortest augmenting levels over the nodes left; true where the source still reaches."""
    source, sink = len(rest), len(rest) + 1
    at = {v: k for k, v in enumerate(rest)}
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(len(rest) + 2)]

    def arc(a: int, b: int, forth: int, back: int) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((forth, back))

    for v in rest:
        k = at[v]
        if terminal[v] > 0:
            arc(source, k, terminal[v], 0)
        elif terminal[v] < 0:
            arc(k, sink, -terminal[v], 0)
        for u, capacity in edges[v].items():
            if side[u] is None and u > v:
                arc(k, at[u], capacity, capacity)
    while True:
        level = [-1] * len(out)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for i in out[a]:
                if room[i] and level[to[i]] < 0:
                    level[to[i]] = level[a] + 1
                    queue.append(to[i])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(len(rest))]
        tried = [0] * len(out)
        path: list[int] = []  # arcs from the source
        a = source
        while True:
            if a == sink:
                pushed = min(room[i] for i in path)
                for depth, i in enumerate(path):
                    room[i] -= pushed
                    room[i ^ 1] += pushed
                cut = next(d for d, i in enumerate(path) if not room[i])
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while tried[a] < len(out[a]) and not (room[out[a][tried[a]]] and level[to[out[a][tried[a]]]] == level[a] + 1):
                tried[a] += 1
            if tried[a] < len(out[a]):
                path.append(out[a][tried[a]])
                a = to[path[-1]]
            elif path:
                i = path.pop()
                a = to[i ^ 1]
                tried[a] += 1
            else:
                break


def main_blocks(source: str, weights: np.ndarray = PRIOR) -> list[str]:
    """The blocks of a page that the cut labels as main text, in page order."""
    page = read_page(source)
    if not page.blocks:
        return []
    costs = markup_costs(page) + np.clip(text_features(page) @ weights, -CLIP, CLIP)
    main = minimum_cut(page_graph(page, costs))
    return [b.text for b, keep in zip(page.blocks, main, strict=False) if keep]


def _extracted(weights: np.ndarray, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in text_batches(batch, "html"):
                kept = ["\n".join(main_blocks((t or b"").decode(), weights)) for t in texts]
                own = {"text": pa.array(kept, pa.string()), "n_chars": pa.array([len(t) for t in kept], pa.int64())}
                columns = [own[f.name] if f.name in own else batch[f.name].slice(lo, len(texts)).cast(f.type) for f in schema]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def extract_text(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """The columns of pages but html, with text (the main text, a line for each block) and n_chars (its code points).

    pages has page_id, url and html; columns named text or n_chars are replaced. ``weights`` come from ``train_text``,
    by default from these pages. A null or empty page, or one without main text, has an empty text. Repeated rows
    give a row each. A page is handled whole, by one task, whatever its length.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    weights = train_text(pages) if weights is None else weights
    kept = [f for f in pages.schema if f.name not in ("html", "text", "n_chars")]
    schema = StructType([*kept, StructField("text", StringType()), StructField("n_chars", LongType())])
    return pages.select(*(F.col(f"`{f.name}`") for f in kept), "html").mapInArrow(lean(_extracted(weights, to_arrow_schema(schema))), schema)
