"""Main text of web pages by a tree-structured graphical model.

Every block element of a page is a binary variable, content or not.  Its tag,
names and text give a node potential, and each pair of parent and child a
potential of their own; sum-product messages, up the tree and down again, give
exact marginals.  All weights are fitted to labelled pages by the gradient of
the likelihood, which takes the same messages.
"""

from __future__ import annotations

import html
import re
from math import exp, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import table, whole_texts
from .html_pages import page

TRAINING_PAGES = 400
STEPS = 150
KEEP = 0.5

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")
#: Elements whose text is never shown as text.
RAW = frozenset("script style noscript template svg iframe textarea select option button title object math canvas audio video datalist head".split())
UNPARSED = frozenset(("script", "style", "textarea", "title", "noscript", "iframe"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var".split())
SPACE = frozenset(("br", "img", "hr", "input", "wbr"))
#: Start tags before which an open element of the set ends.
P_ENDERS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt".split())
ENDS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}}

TAGS = ["article", "main", "section", "div", "p", "h", "li", "list", "nav", "header", "footer", "aside", "form", "table", "quote", "figure", "body", "loose", "other"]
TAG_OF = {"#text": "loose", "h1": "h", "h2": "h", "h3": "h", "h4": "h", "h5": "h", "h6": "h", "ul": "list", "ol": "list", "dl": "list", "menu": "list", "dd": "li", "dt": "li", "tr": "table", "td": "table", "th": "table", "tbody": "table", "thead": "table", "blockquote": "quote", "pre": "quote", "figcaption": "figure", "html": "body"}
GROUPS = {
    "good": "article content main post entry story text body blog news page",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar tabs",
    "edge": "header footer masthead topbar copyright bottom top head foot colophon",
    "side": "sidebar aside widget rail secondary complementary",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner adslot",
    "note": "cookie cookies consent notice gdpr popup modal overlay alert dialog disclaimer notification warning",
    "talk": "comment comments disqus reply replies discussion respond reader feedback",
    "form": "form newsletter subscribe subscription search login signup signin register",
    "more": "related share social recommended recommendations popular trending tags sharing follow",
}
GROUP_OF = {w: f"name:{g}" for g, ws in GROUPS.items() for w in ws.split()}
FEATURES = ["bias"] + [f"tag:{t}" for t in TAGS] + [f"name:{g}" for g in GROUPS] + ["name:other", "text:0", "text:1-3", "text:4-9", "text:10-29", "text:30+", "links", "stops", "depth:1", "depth:2", "depth:3+"]
INDEX = {f: i for i, f in enumerate(FEATURES)}
KINDS = {"body": 0, "div": 1, "section": 1}  # of the parent, for the edge potentials; else 2


class Node:
    __slots__ = ("tag", "names", "parent", "depth", "words", "linked", "stops")

    def __init__(self, tag: str, names: str, parent: int, depth: int):
        self.tag, self.names, self.parent, self.depth = tag, names, parent, depth
        self.words = self.linked = self.stops = 0


def parse(source: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Elements in document order (parents first), and the runs of text (element, text).

    Elements are the blocks; a run of text that lies in the body itself is one of its own.
    """
    nodes, blocks = [Node("body", "", -1, 0)], []
    stack: list[tuple[str, int]] = [("body", 0)]  # open elements, each with its block element
    bases = [0]  # places in the stack of those that aren't inline
    inner: list[dict[str, int]] = [{}]  # inline elements open within each of those
    opened: dict[str, list[int]] = {}  # places of each tag in the stack, so that none is searched for
    run: list[str] = []
    at, hidden, links, loose = 0, 0, 0, 0

    def flush() -> None:
        nonlocal loose
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                blocks.append((loose or stack[-1][1], text))
        loose = 0

    def add(text: str) -> None:
        nonlocal loose
        if not hidden and text:
            text = html.unescape(text) if "&" in text else text
            run.append(text)
            k = len(text.split())
            own = stack[-1][1]
            if not own and k:
                if not loose:
                    nodes.append(Node("#text", "", 0, 1))
                    loose = len(nodes) - 1
                own = loose
            n = nodes[own]
            n.words += k
            if links:
                n.linked += k
            n.stops += text.count(".") + text.count(",")

    def push(tag: str, block: int) -> None:
        opened.setdefault(tag, []).append(len(stack))
        if tag in INLINE:
            inner[-1][tag] = inner[-1].get(tag, 0) + 1
        else:
            bases.append(len(stack))
            inner.append({})
        stack.append((tag, block))

    def last(tags) -> int:
        return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

    def pop(to: int) -> None:
        nonlocal hidden, links
        while len(stack) > to:
            tag = stack[-1][0]
            if tag in INLINE:
                inner[-1][tag] -= 1
            else:
                flush()
                bases.pop()
                inner.pop()
            opened[tag].pop()
            stack.pop()
            hidden -= tag in RAW
            links -= tag == "a"

    find = TOKEN.search
    size = len(source)
    while at < size:
        m = find(source, at)
        if not m:
            add(source[at:])
            break
        if m.start() > at:
            add(source[at : m.start()])
        at = m.end()
        name = m.group(2) or m.group(5)
        if not name:
            if source.startswith("<![CDATA[", m.start()):
                continue
            continue
        tag = name.lower()
        if m.group(1) or m.group(4):
            if tag in INLINE:  # ends only what is open within the same block
                if inner[-1].get(tag):
                    pop(next(k for k in range(len(stack) - 1, bases[-1], -1) if stack[k][0] == tag))
            elif opened.get(tag):
                pop(opened[tag][-1])
            continue
        if tag in VOID:
            if tag in SPACE:
                if tag == "hr":
                    flush()
                elif not hidden:
                    run.append(" ")
            continue
        rest = m.group(3) or m.group(6) or ""
        if rest.endswith("/") and tag in ("path", "use", "circle", "rect"):
            continue
        if tag in UNPARSED:
            end = re.compile(f"</{tag}", re.I).search(source, at)
            close = source.find(">", end.end()) if end else -1
            at = close + 1 if close >= 0 else size
            continue
        if tag in ("html", "body"):
            continue
        if tag in P_ENDERS and not hidden and stack[bases[-1]][0] == "p":
            pop(bases[-1])
        if tag in ENDS:
            place = last(ENDS[tag])
            if place > last(SCOPE.get(tag, ())):
                pop(place)
        if tag in INLINE:
            push(tag, stack[-1][1])
            links += tag == "a"
        elif tag in RAW:
            push(tag, stack[-1][1])
            hidden += 1
        else:
            flush()
            parent = stack[-1][1]
            names = " ".join(a or b or c for a, b, c in NAMES.findall(rest)) if rest else ""
            nodes.append(Node(tag, names, parent, nodes[parent].depth + 1))
            push(tag, len(nodes) - 1)
    pop(1)
    flush()
    return nodes, blocks


_SEEN: dict[str, tuple[int, ...]] = {}


def _named(names: str) -> tuple[int, ...]:
    """Features of class, id and role names, kept for the next element that has them."""
    if names in _SEEN:
        return _SEEN[names]
    if len(_SEEN) > 10_000:
        _SEEN.clear()
    words = {w.lower() for w in SPLIT.split(names) if w}
    hit = {GROUP_OF[w] for w in words if w in GROUP_OF}
    if not hit and words:
        hit = {"name:other"}
    _SEEN[names] = out = tuple(INDEX[h] for h in sorted(hit))
    return out


def features(n: Node) -> list[int]:
    tag = TAG_OF.get(n.tag, n.tag)
    w = n.words
    out = [0, INDEX.get(f"tag:{tag}", INDEX["tag:other"]), INDEX["text:0" if not w else "text:1-3" if w < 4 else "text:4-9" if w < 10 else "text:10-29" if w < 30 else "text:30+"], INDEX["depth:1" if n.depth < 2 else "depth:2" if n.depth == 2 else "depth:3+"]]
    if n.names:
        out += _named(n.names)
    if w and 2 * n.linked > w:
        out.append(INDEX["links"])
    if n.stops:
        out.append(INDEX["stops"])
    return out


def _log_sum(a: float, b: float) -> float:
    return a + log1p(exp(b - a)) if a > b else b + log1p(exp(a - b))


def marginals(local: list[float], parent: list[int], kind: list[int], edge) -> tuple[list[float], list[float], list[float]]:
    """Log odds of every node given the whole tree; what it hears from above, and what it says upward.

    local: log odds of the node potentials; edge[kind][parent value][child
    value]: log potentials.  Nodes come parents first.
    """
    n = len(local)
    belief, up = list(local), [0.0] * n
    for i in range(n - 1, 0, -1):
        e, b = edge[kind[i]], belief[i]
        up[i] = _log_sum(e[1][0], e[1][1] + b) - _log_sum(e[0][0], e[0][1] + b)
        belief[parent[i]] += up[i]
    down = [0.0] * n
    for i in range(1, n):
        e, q = edge[kind[i]], belief[parent[i]] - up[i]
        down[i] = _log_sum(e[0][1], e[1][1] + q) - _log_sum(e[0][0], e[1][0] + q)
        belief[i] += down[i]
    return belief, down, up


def _tree(nodes: list[Node]) -> tuple[list[int], list[int]]:
    parent = [n.parent for n in nodes]
    kind = [0] + [KINDS.get(nodes[p].tag, 2) for p in parent[1:]]
    return parent, kind


def _messages(local: np.ndarray, parent: np.ndarray, kind: np.ndarray, levels: list[np.ndarray], edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What marginals() gives, for all trees of a forest at once, level by level."""
    e = edge[kind]
    belief, up, down = local.copy(), np.zeros_like(local), np.zeros_like(local)
    for i in reversed(levels):
        b = belief[i]
        up[i] = np.logaddexp(e[i, 1, 0], e[i, 1, 1] + b) - np.logaddexp(e[i, 0, 0], e[i, 0, 1] + b)
        np.add.at(belief, parent[i], up[i])
    for i in levels:
        q = belief[parent[i]] - up[i]
        down[i] = np.logaddexp(e[i, 0, 1], e[i, 1, 1] + q) - np.logaddexp(e[i, 0, 0], e[i, 1, 0] + q)
        belief[i] += down[i]
    return belief, down, up


def fit(pages: list[tuple[str, list[int]]], *, steps: int = STEPS, l2: float = 2e-4) -> tuple[list[float], list]:
    """Weights of the features and edge potentials of greatest penalised likelihood.

    pages: (html, labels of its elements below body).  The root is not content.
    """
    at, of, parent, kind, depth, y = [], [], [], [], [], []
    for source, labels in pages:
        nodes, _ = parse(source)
        if len(nodes) == len(labels) + 1:
            first = len(y)
            own, kinds = _tree(nodes)
            for i, n in enumerate(nodes):
                f = features(n)
                at += [first + i] * len(f)
                of += f
            parent += [first + max(p, 0) for p in own]
            kind += kinds
            depth += [n.depth for n in nodes]
            y += [0, *labels]
    at, of, parent, kind, depth, y = (np.array(c, dtype=np.int64) for c in (at, of, parent, kind, depth, y))
    levels = [np.flatnonzero(depth == k) for k in range(1, int(depth.max(initial=0)) + 1)]
    roots, below, size = np.flatnonzero(depth == 0), np.flatnonzero(depth > 0), len(FEATURES)
    edge = np.zeros((3, 2, 2))
    edge[:, 0, 0] = edge[:, 1, 1] = 1.0
    p = np.concatenate([np.zeros(size), edge.ravel()])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        edge = p[size:].reshape(3, 2, 2)
        local = np.bincount(at, p[of], len(y))
        local[roots] = -20.0
        belief, down, up = _messages(local, parent, kind, levels, edge)
        wrong = y - 1 / (1 + np.exp(-np.clip(belief, -700, 700)))
        wrong[roots] = 0
        q, c, e = (belief[parent] - up)[below], (belief - down)[below], edge[kind[below]]
        joint = e + q[:, None, None] * np.array([0, 1])[None, :, None] + c[:, None, None] * np.array([0, 1])[None, None, :]
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        joint = -joint / joint.sum(axis=(1, 2), keepdims=True)
        joint[np.arange(len(below)), y[parent[below]], y[below]] += 1
        by_edge = np.zeros((3, 2, 2))
        np.add.at(by_edge, kind[below], joint)
        grad = np.concatenate([np.bincount(of, wrong[at], size), by_edge.ravel()]) / len(y) - l2 * p / 10
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        p = p + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return p[:size].tolist(), p[size:].reshape(3, 2, 2).tolist()


_MODEL: dict = {}


def model():
    """The model fitted to TRAINING_PAGES generated pages, once a process."""
    if not _MODEL:
        _MODEL["m"] = fit([page(i) for i in range(TRAINING_PAGES)])
    return _MODEL["m"]


def content_odds(nodes: list[Node], weights: list[float], edge) -> list[float]:
    local = [sum([weights[k] for k in features(n)]) for n in nodes]
    local[0] = -20.0
    return marginals(local, *_tree(nodes), edge)[0]


def main_text(source: str, fitted, keep: float = KEEP) -> str:
    """Blocks whose element is content with probability above keep, in page order, one a line."""
    nodes, blocks = parse(source)
    if not blocks:
        return ""
    odds = content_odds(nodes, *fitted)
    least = log(keep / (1 - keep))
    if all(n.tag == "#text" for n in nodes[1:]):  # no block element at all: plain text
        return "\n".join(t for _, t in blocks)
    return "\n".join(t for i, t in blocks if odds[i] > least)


def extract(pages: DataFrame, *, fitted=None) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages(page_id, url, html).

    Narrow: one pass over the whole html, of any length and depth.  Null and
    empty html give an empty text; broken markup is read as far as it makes
    sense; an element as likely content as not (a tie) isn't kept; null ids,
    null urls and repeated rows are rows like others; other columns are not
    read, whatever their names; an empty table gives no rows.
    """
    fitted = fitted or model()
    whole_texts(pages.sparkSession)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                texts = [main_text(h, fitted) if h else "" for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


OP9_SQL = r"""
with a as (
  select page_id, url, coalesce(regexp_extract(html, '(?s)<article[^>]*>(.*)</article>', 1), '') as body from pages
), b as (
  select page_id, url, list_transform(regexp_split_to_array(body, '</?(?:h[1-6]|p)>'), lambda x:
    trim(regexp_replace(replace(replace(replace(regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;', '&'), '&amp', '&'), '[ \t\n\r\v\f]+', ' ', 'g'))) as blocks
  from a
), c as (
  select page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)) as text from b
)
select page_id, url, text, length(text)::bigint as n_chars from c
"""
