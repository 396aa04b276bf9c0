"""HTML extraction: which blocks of a page are its main text, by a graphical model on the tree of its blocks.

Block elements are the nodes; inline elements count for the block around them. Every node has a hidden label, main text or not. Unary
potentials come from its tag, the words of class, id and role, lengths, link density and place; pair potentials join it
with its parent and depend on its tag. The graph is a tree, so sum-product messages, once upward and once downward, give exact
marginals. Weights are trained by gradient ascent on the likelihood of labelled pages (see html_pages); text of nodes
whose marginal of being main text is over a half is kept, in page order.
"""

from __future__ import annotations

import bisect
import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

# HTML element kinds.
BLOCKS = "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
RAW = "script style title textarea noscript template iframe noembed noframes xmp svg math object audio video canvas select datalist button head".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
CLOSE_P = set(BLOCKS) - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
SAME_ENDS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
STOPS_AT = {"li": {"ul", "ol", "menu", "dir"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}}

_TAG = re.compile(r"<!--(?:.*?--!?>|.*)|<![^>]*+>|<\?[^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^\"'>])*+)>", re.S)
_RAW_TAG = {t: re.compile(rf"<(/?){t}(?=[\s/>])[^>]*+>", re.I) for t in RAW}
#: Raw elements that can hold others of their name.
_NESTED = frozenset("svg math object audio video canvas select datalist noscript button head".split())
_ATTRIBUTE = re.compile(r"(?<![^\s=\"'/])([^\s=\"'/]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++))")
_TURN = re.compile("[>\"']")
#: Elements below this depth become children of the last one above it, as in browsers.
MOST_DEPTH = 512
# Elements that a paragraph's end is not looked for beyond.
SCOPES = {"table", "td", "th", "caption", "html"}
_NAME = re.compile(r"[a-zA-Z][a-z]*")

_BLOCK = {t: i for i, t in enumerate(BLOCKS)}
_RAWS, _VOIDS = frozenset(RAW), frozenset(VOID)


@dataclass
class Tree:
    tags: list[int]
    parents: list[int]
    depths: list[int]
    names: list[list[str]]
    texts: list[tuple[int, str]]  # (node, text as in the page) in page order
    chars: list[int]
    linked: list[int]


class _Scan:
    """Ends of tags and of raw elements in a page. Each is told by one pass over the page at most, whatever is left open in it."""

    def __init__(self, page: str):
        self.page = page
        self.last = page.rfind(">") + 1
        self.turns: list[int] | None = None  # places of > and quotes, and for each the end of a tag that gets there outside of quotes
        self.ends: list[int] = []
        self.raw: dict[str, dict[int, int]] = {}

    def tag(self, at: int) -> re.Match | None:
        """The next tag or comment from a place on. A tag that is never closed is text."""
        while (at := self.page.find("<", at)) >= 0:
            if at >= self.last and not self.page.startswith("<!--", at):
                return None
            sign = self.page[at + 1 : at + 2]
            named = sign == "/" or sign.isalpha()
            if (self.turns is None or not named or self._closed(at)) and (found := _TAG.match(self.page, at)):
                return found
            if self.turns is None and named:
                self._find_ends()
            at += 1
        return None

    def _find_ends(self) -> None:
        self.turns = [m.start() for m in _TURN.finditer(self.page)]
        self.ends = [-1] * (len(self.turns) + 1)
        following = {'"': len(self.turns), "'": len(self.turns)}
        for k in range(len(self.turns) - 1, -1, -1):
            sign = self.page[self.turns[k]]
            if sign == ">":
                self.ends[k] = self.turns[k]
            else:
                self.ends[k] = self.ends[following[sign] + 1] if following[sign] < len(self.turns) else -1
                following[sign] = k

    def _closed(self, at: int) -> bool:
        return self.ends[bisect.bisect_left(self.turns, at)] >= 0

    def raw_end(self, name: str, at: int) -> int:
        """Where the raw element ends whose start tag ends at a place; -1 if it never does."""
        if name not in self.raw:
            tags = [(m.start(), m.end(), bool(m[1])) for m in _RAW_TAG[name].finditer(self.page, 0, self.last)]
            ends, open_tags, following = {}, [], -1
            if name in _NESTED:
                for start, end, closes in tags:
                    if not closes:
                        open_tags.append(start)
                    elif open_tags:
                        ends[open_tags.pop()] = end
            else:
                for start, end, closes in reversed(tags):
                    if closes:
                        following = end
                    else:
                        ends[start] = following
            self.raw[name] = ends
        return self.raw[name].get(at, -1)


def parse(page: str) -> Tree:
    """Node 0 is the page. Missing end tags are supplied as browsers do for paragraphs, list items and table cells. Linear in the page's length."""
    tree = Tree([_BLOCK["html"]], [-1], [0], [[]], [], [0], [0])
    stack = [(0, "html", 0)]  # node, name, place in the stack of the open paragraph that a block ends (0: none)
    places: dict[str, list[int]] = {}  # of each name's elements in the stack
    link = 0
    run: list[str] = []
    scan = _Scan(page)

    def flush() -> None:
        if run:
            tree.texts.append((stack[-1][0], "".join(run)))
            run.clear()

    def add(text: str) -> None:
        if text:
            run.append(text)
            if not text.isspace():
                node = stack[-1][0]
                tree.chars[node] += len(text)
                if link:
                    tree.linked[node] += len(text)

    def cut(k: int) -> None:
        for _, name, _ in stack[k:]:
            places[name].pop()
        del stack[k:]

    def nearest(names: set[str], stops: set[str]) -> int:
        """Place in the stack of the innermost element with one of the names, 0 if one of stops comes before it."""
        last = lambda own: max((places[x][-1] for x in own if places.get(x)), default=0)
        found = last(names)
        return found if found >= last(stops) else 0

    at, size = 0, len(page)
    while at < size:
        tag = scan.tag(at)
        if tag is None:
            add(page[at:])
            break
        add(page[at : tag.start()])
        at = tag.end()
        if tag[2] is None:
            continue
        name = tag[2].lower()
        if name in _RAWS and name != "head":
            if not tag[1]:
                end = scan.raw_end(name, tag.start())
                if end >= 0:
                    at = end
                elif name not in _NESTED:
                    at = size  # of nested ones that are never closed only the tag is dropped
            continue
        if name == "a":
            link = 0 if tag[1] else 1
        elif name == "br" or name in ("img", "hr", "wbr"):
            if name != "wbr":
                run.append(" ")
        elif name in _BLOCK:
            flush()
            if tag[1]:
                if k := nearest({name}, set()):
                    cut(k)
                    link = 0
                continue
            if name in ("html", "body") and places.get(name):
                continue
            if name in CLOSE_P and stack[-1][2]:
                cut(stack[-1][2])
            if name in SAME_ENDS and (k := nearest(SAME_ENDS[name], STOPS_AT[name])):
                cut(k)
            node = len(tree.tags)
            words: list[str] = []
            if tag[3]:
                for key, a, b, c in _ATTRIBUTE.findall(tag[3]):
                    if key.lower() in ("class", "id", "role", "itemprop", "aria-label"):
                        words += [w.lower() for w in _NAME.findall(a or b or c)]
                    elif key.lower() == "hidden":
                        words.append("hidden")
            parent = stack[min(len(stack), MOST_DEPTH) - 1][0]
            tree.tags.append(_BLOCK[name])
            tree.parents.append(parent)
            tree.depths.append(tree.depths[parent] + 1)
            tree.names.append(words)
            tree.chars.append(0)
            tree.linked.append(0)
            stack.append((node, name, len(stack) if name == "p" else 0 if name in SCOPES else stack[-1][2]))
            places.setdefault(name, []).append(len(stack) - 1)
    flush()
    return tree


NAME_BUCKETS = 1024
_SIZES, _LINKS = 10, 5
_N_TAGS = len(BLOCKS)
_AT_NAME = 2 * _N_TAGS
_AT_SIZE = _AT_NAME + NAME_BUCKETS
_AT_LINK = _AT_SIZE + _SIZES * 2
_AT_KIDS = _AT_LINK + _LINKS * 2
_AT_PLACE = _AT_KIDS + 6
_AT_DEPTH = _AT_PLACE + 10
N_FEATURES = _AT_DEPTH + 8 + 1


@dataclass
class Forest:
    """Trees of many pages, one after the other; parents come before their children."""

    parent: np.ndarray
    depth: np.ndarray
    tag: np.ndarray
    node: np.ndarray  # of each feature
    feature: np.ndarray


def levels(depth: np.ndarray) -> list[np.ndarray]:
    """The nodes of each depth."""
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.searchsorted(depth[order], np.arange(1, int(depth.max(initial=-1)) + 1)))


def _log_bin(x: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(x + 1)).astype(np.int64), _SIZES - 1)


def forest(trees: list[Tree]) -> Forest:
    base = np.concatenate([[0], np.cumsum([len(t.tags) for t in trees])])
    n = int(base[-1])
    tag = np.array([x for t in trees for x in t.tags], np.int64)
    shift = np.repeat(base[:-1], np.diff(base))
    parent = np.array([x for t in trees for x in t.parents], np.int64)
    parent = np.where(parent >= 0, parent + shift, -1)
    chars, linked = (np.array([x for t in trees for x in getattr(t, k)], np.int64) for k in ("chars", "linked"))
    depth = np.array([x for t in trees for x in t.depths], np.int64)
    all_chars, all_linked = chars.copy(), linked.copy()
    for own in levels(depth)[:0:-1]:
        np.add.at(all_chars, parent[own], all_chars[own])
        np.add.at(all_linked, parent[own], all_linked[own])
    kids = np.bincount(parent[parent >= 0], minlength=n)
    share = lambda a, b: np.where(b > 0, np.minimum(1 + (a * 3.999 / np.maximum(b, 1)).astype(np.int64), _LINKS - 1), 0)
    place = (np.arange(n) - shift) * 10 // np.maximum(np.repeat(np.diff(base), np.diff(base)), 1)
    every = np.arange(n)
    columns = [
        tag, _N_TAGS + np.where(parent >= 0, tag[parent], _BLOCK["html"]), _AT_SIZE + _log_bin(chars), _AT_SIZE + _SIZES + _log_bin(all_chars),
        _AT_LINK + share(linked, chars), _AT_LINK + _LINKS + share(all_linked, all_chars), _AT_KIDS + np.minimum(kids, 5), _AT_PLACE + place,
        _AT_DEPTH + np.minimum(depth, 7), np.full(n, N_FEATURES - 1),
    ]
    named = [(base[k] + i, _AT_NAME + zlib.crc32(w.encode()) % NAME_BUCKETS) for k, t in enumerate(trees) for i, own in enumerate(t.names) for w in own]
    extra = np.array(named, np.int64).reshape(-1, 2)
    return Forest(parent, depth, tag, np.concatenate([*[every] * len(columns), extra[:, 0]]), np.concatenate([*columns, extra[:, 1]]))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # per feature, for main text against not
    pairs: np.ndarray  # child's tag, parent's label, child's label


def marginals(model: Model, f: Forest) -> tuple[np.ndarray, np.ndarray]:
    """(probability of main text of each node, joint probabilities of parent's and child's labels)."""
    n = len(f.parent)
    unary = np.zeros((n, 2))
    unary[:, 1] = np.bincount(f.node, model.weights[f.feature], n)
    pair = model.pairs[f.tag]
    up, message = unary.copy(), np.zeros((n, 2))
    of_depth = levels(f.depth)
    for own in of_depth[:0:-1]:
        message[own] = np.logaddexp.reduce(pair[own] + up[own][:, None, :], 2)
        np.add.at(up, f.parent[own], message[own])
    down = np.zeros((n, 2))
    joint = np.zeros((n, 2, 2))
    for own in of_depth[1:]:
        parent = f.parent[own]
        rest = up[parent] + down[parent] - message[own]  # what the parent hears from elsewhere
        down[own] = np.logaddexp.reduce(pair[own] + rest[:, :, None], 1)
        both = pair[own] + rest[:, :, None] + up[own][:, None, :]
        both -= both.max((1, 2), keepdims=True)
        joint[own] = np.exp(both) / np.exp(both).sum((1, 2), keepdims=True)
    belief = up + down
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -50, 50))), joint


def fit(trees: list[Tree], labels: list[list[int]], rounds: int = 150) -> Model:
    """labels: 1 or 0 for each node of each tree."""
    f = forest(trees)
    truth = np.array([x for own in labels for x in own], np.int64)
    model = Model(np.zeros(N_FEATURES), np.zeros((_N_TAGS, 2, 2)))
    theta = np.zeros(N_FEATURES + 4 * _N_TAGS)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    kids = np.flatnonzero(f.parent >= 0)
    seen = np.zeros((_N_TAGS, 2, 2))
    np.add.at(seen, (f.tag[kids], truth[f.parent[kids]], truth[kids]), 1)
    for k in range(1, rounds + 1):
        found, joint = marginals(model, f)
        expected = np.zeros((_N_TAGS, 2, 2))
        np.add.at(expected, f.tag[kids], joint[kids])
        slope = np.concatenate([np.bincount(f.feature, (truth - found)[f.node], N_FEATURES), (seen - expected).ravel()]) - 0.5 * theta
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        theta = theta + 0.1 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
        model = Model(theta[:N_FEATURES], theta[N_FEATURES:].reshape(_N_TAGS, 2, 2))
    return model


def train() -> Model:
    from .html_pages import labelled_pages

    pages = [parse(page) for page, _ in labelled_pages()]
    return fit(pages, [label_of(tree, mark) for tree, (_, mark) in zip(pages, labelled_pages(), strict=True)])


def label_of(tree: Tree, mark: str) -> list[int]:
    """1 for nodes with the mark in their class, and their descendants up to nodes marked as not."""
    out = []
    for parent, names in zip(tree.parents, tree.names, strict=True):
        out.append(1 if mark + "yes" in names else 0 if mark + "no" in names else out[parent] if parent >= 0 else 0)
        names[:] = [x for x in names if not x.startswith(mark)]
    return out


_WHITE = re.compile(r"\s+")


def extract(model: Model, pages: list[str | None]) -> list[str]:
    trees = [parse(x or "") for x in pages]
    if not trees:
        return []
    found, _ = marginals(model, forest(trees))
    out, at = [], 0
    for tree in trees:
        blocks = [_WHITE.sub(" ", html.unescape(text)).strip() for node, text in tree.texts if found[at + node] > 0.5]
        out.append(" ".join(x for x in blocks if x))
        at += len(tree.tags)
    return out


def extracted(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """pages with main_text string and main_chars long, replacing columns of these names; all other columns stay.

    Null and empty html give empty texts. Pages are read whole, however long, in time that grows with their length (see parse and MOST_DEPTH). Repeated rows give repeated results; an empty
    table stays empty.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or train())
    pages = pages.drop("main_text", "main_chars")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                texts = extract(shared.value, part.column("html").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*part.schema.names, "main_text", "main_chars"])

    return pages.mapInArrow(each, StructType([*pages.schema.fields]).add("main_text", StringType()).add("main_chars", LongType()))


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html); other columns are ignored.

    Null and empty html, and pages without main text, give the empty text. Pages are read whole; elements nested deeper than MOST_DEPTH join the
    one at that depth, so no text is lost. A node whose marginal is exactly a half is left out. Tags that are never closed are text; of two texts of
    one node the page's order decides. Repeated rows give repeated results; an empty table gives none.
    """
    found = extracted(pages.select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.col("main_chars").alias("n_chars"))
