"""Main-text extraction by minimum-cut labelling.

A page is cut into text blocks. Markup (landmark elements, roles, names) gives each block a fixed part of its log-odds to be
content, a logistic classifier over the block's own statistics the rest. The classifier is trained on a bounded sample
of the pages, with blocks inside unmistakable landmarks as examples, and shrinks to given weights where there are few.
The odds are the capacities to source and sink. Neighbouring blocks are tied together, the more strongly the nearer they
are in the document tree. The minimum cut is the labelling of least total cost: blocks on the source's side are the main text.

Tags and attributes are read as the HTML tokenizer's states read them, in one pass whose cost is linear in the page.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the HTML language.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe textarea select title xmp noembed noframes annotation annotation-xml desc metadata".split())
_BLOCK = frozenset(
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption legend center".split()
)
_CLOSES_P = _BLOCK - frozenset("body html head".split())
_HEADINGS, _ITEMS = frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset("li dt dd td th tr".split())
_TEXT_LEVEL = _HEADINGS | _ITEMS | frozenset("p blockquote pre figcaption caption".split())

#: Log-odds for content (+) or boilerplate (-) that landmark elements and roles give to all below them.
TAG_WEIGHT = {"article": 4.0, "main": 4.0, "nav": -9.0, "footer": -9.0, "header": -5.0, "aside": -9.0, "form": -9.0, "menu": -9.0, "dialog": -9.0, "button": -9.0, "head": -20.0, "figure": -0.5, "fieldset": -9.0, "label": -6.0, "option": -6.0}
ROLE_WEIGHT = {"main": 4.0, "article": 4.0, "navigation": -9.0, "banner": -6.0, "contentinfo": -9.0, "complementary": -9.0, "search": -9.0, "form": -9.0, "dialog": -9.0, "alert": -9.0, "alertdialog": -9.0, "menu": -9.0, "menubar": -9.0}
#: Whole names of boilerplate, and first and last parts of compound ones; a part in any other place says nothing.
BAD_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies cookiebar consent notice gdpr popup modal overlay newsletter subscribe signup "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar side-bar side widget widgets related recommended header masthead footer copyright share sharing share-bar share-buttons social "
    "social-share comment comments commentlist replies disqus login toolbar pagination pager tags tag-list skip-link hidden alert warning".split()
)
BAD_FIRST = frozenset("ad ads advert advertisement adsense cookie cookies consent gdpr sponsor sponsored promo newsletter breadcrumb breadcrumbs sidebar nav navbar footer comment comments reader disqus social".split())
BAD_LAST = frozenset("ad ads advert adverts advertisement banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead newsletter popup modal widget comments cookies consent notice promo pagination toolbar".split())
BAD_HEADERS = frozenset("site page global top main".split())
GOOD_NAMES = frozenset("article article-body article-content content main main-content post post-body post-content story story-body entry entry-content body-text".split())
NAME_BAD, NAME_DOUBTFUL, NAME_GOOD, HIDDEN = -8.0, -3.0, 2.0, -12.0
#: An element whose own markup says this or less stands for itself: what favours the landmarks around it doesn't reach into it.
APART = -8.0
#: A form around prose is no form: characters in paragraphs of PROSE or more, to each control and one more.
CONTROLS, PROSE, PROSE_A_CONTROL = frozenset("input select textarea button".split()), 80, 100
#: What the classifier's weights are before it has seen a page: constant, length, share of linked text, sentence end, points
#: and commas, paragraph, heading, list item or cell, copyright line, capitalised words.
PRIOR = np.array([-0.5, 2.5, -5.0, 0.3, 0.5, 1.2, 1.0, -0.2, -6.0, -0.2])
#: The sample that the classifier is trained on: pages, and the longest page taken; the weight of PRIOR in examples.
SAMPLE_PAGES, SAMPLE_LONGEST, SHRINK = 256, 100_000, 4.0
#: Blocks above and below these odds by markup alone are examples.
SURE_CONTENT, SURE_OTHER = 3.0, -5.0
SMOOTH = 1.2

_NEXT = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--)|[!?/])")
_ATTRIBUTES = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?+|["'])*+""")
_ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)))?+""")
_SHORT_COMMENT, _COMMENT_END = re.compile("-?>"), re.compile("--!?>")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in _RAW}


class Block:
    __slots__ = ("own", "parts", "node", "links", "weight", "chars", "form")

    def __init__(self, node: int, own: str, weight: float, form: int | None):
        self.node, self.own, self.weight, self.form = node, own, weight, form
        self.parts: list[str] = []
        self.links = self.chars = 0


class Tree:
    """Block elements by number, with their parents and depths; 0 is the page."""

    def __init__(self):
        self.parent, self.depth, self.tag = [0], [0], ["body"]

    def add(self, parent: int, tag: str) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.depth.append(self.depth[parent] + 1)
        return len(self.parent) - 1

    def distance(self, a: int, b: int) -> int:
        """Levels from the deeper of two elements up to the one that holds both."""
        deepest = max(self.depth[a], self.depth[b])
        while a != b:
            if self.depth[a] >= self.depth[b]:
                a = self.parent[a]
            else:
                b = self.parent[b]
        return deepest - self.depth[a]


def _named(value: str, text_level: bool) -> float:
    """What an element's class and id say of it."""
    out = 0.0
    for name in value.lower().split():
        parts = re.split("[-_]+", name)
        if name in BAD_NAMES:
            return NAME_BAD
        if len(parts) > 1 and (parts[0] in BAD_FIRST or parts[-1] in BAD_LAST or parts[-1] == "header" and parts[0] in BAD_HEADERS):
            out = min(out, NAME_DOUBTFUL if text_level else NAME_BAD)
        elif name in GOOD_NAMES and not out:
            out = NAME_GOOD
    return out


def _attributes_weight(tag: str, attributes: str) -> float:
    if tag in ("html", "body"):
        return 0.0
    out, names = 0.0, []
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), _html.unescape(m[2] or m[3] or m[4] or "")
        if key in ("class", "id"):
            names.append(value)
        elif key == "role":
            out += ROLE_WEIGHT.get(value.strip().lower(), 0.0)
        elif key == "hidden" or key == "aria-hidden" and value.strip().lower() == "true" or key == "style" and _HIDDEN_STYLE.search(value):
            out += HIDDEN
    return out + (_named(" ".join(names), tag in _TEXT_LEVEL) if names and (tag in _BLOCK or tag == "span") else 0.0)


def blocks(page: str) -> tuple[list[tuple[str, Block]], Tree]:
    """(text, block) in page order, and their elements; markup, comments, scripts and styles are gone, character references
    decoded. Text of formulas, drawings and fallbacks (math, svg, object, canvas) is text like other."""
    stack: list[tuple[str, int, float]] = []  # tag, block element, weight so far
    forms: list[int] = []  # the open forms
    controls: list[int] = []  # of each form
    opened: dict[str, int] = {}
    tree, out = Tree(), []
    current: Block | None = None
    links, at, n = 0, 0, len(page)

    def text(s: str) -> None:
        nonlocal current
        if "&" in s:
            s = _html.unescape(s)
        if current is None:
            if not s.strip():
                return
            node = stack[-1][1] if stack else 0
            current = Block(node, tree.tag[node], stack[-1][2] if stack else 0.0, forms[-1] if forms else None)
            out.append(current)
        current.parts.append(s)
        size = len(s.strip())
        current.chars += size
        if links:
            current.links += size

    def close(down_to: int) -> None:
        nonlocal links
        for t, _, _ in stack[down_to:]:
            opened[t] -= 1
            links -= t == "a"
            if t == "form":
                forms.pop()
        del stack[down_to:]

    def nearest(tags, barriers) -> int:
        """The place of the innermost open element of ``tags`` within any of ``barriers``; -1 if there is none."""
        if not any(opened.get(t) for t in tags):
            return -1
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                return i
            if stack[i][0] in barriers:
                break
        return -1

    while at < n:
        m = _NEXT.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        if m[3]:
            end = _SHORT_COMMENT.match(page, m.end()) or _COMMENT_END.search(page, m.end())
            at = end.end() if end else n
            continue
        if m[2] is None:
            end = page.find(">", m.end())
            at = n if end < 0 else end + 1
            continue
        rest = _ATTRIBUTES.match(page, m.end())
        if rest.end() >= n:  # the page ends inside the tag, which then says nothing
            break
        at = rest.end() + 1
        closing, tag, attributes = bool(m[1]), m[2].lower(), rest.group()
        if closing:
            if tag in _BLOCK:
                current = None
            if opened.get(tag):
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            continue
        if tag in CONTROLS:
            for form in forms:
                controls[form] += 1
        if tag in _RAW:
            end = _END[tag].search(page, at)
            shut = page.find(">", end.end()) if end else -1
            at = n if shut < 0 else shut + 1
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in _BLOCK:
            current = None
            if tag in _CLOSES_P and (i := nearest(("p",), _BLOCK)) >= 0:
                close(i)
            if tag in _HEADINGS and stack and stack[-1][0] in _HEADINGS:
                close(len(stack) - 1)
            if tag in _ITEMS and (i := nearest((tag,) if tag not in ("dt", "dd") else ("dt", "dd"), ("ul", "ol", "dl", "table", "menu"))) >= 0:
                close(i)
        if tag in _VOID:
            continue
        node, weight = (stack[-1][1], stack[-1][2]) if stack else (0, 0.0)
        own = 0.0
        if tag == "form":  # what it weighs is known when all of it has been read
            forms.append(len(controls))
            controls.append(0)
        else:
            own = TAG_WEIGHT.get(tag, 0.0)
        if attributes:
            own += _attributes_weight(tag, attributes)
        weight = own + (min(0.0, weight) if own <= APART else weight)
        links += tag == "a"
        opened[tag] = opened.get(tag, 0) + 1
        stack.append((tag, tree.add(node, tag) if tag in _BLOCK else node, weight))
    found = []
    for b in out:
        s = " ".join("".join(b.parts).split())
        if s:
            found.append((s, b))
    prose = [0] * len(controls)
    for s, b in found:
        if b.form is not None and len(s) >= PROSE and b.own in ("p", "blockquote"):
            prose[b.form] += len(s)
    for _, b in found:
        if b.form is not None and prose[b.form] <= PROSE_A_CONTROL * (controls[b.form] + 1):
            b.weight = min(0.0, b.weight) + TAG_WEIGHT["form"]
    return found, tree


def statistics(text: str, block: Block) -> list[float]:
    """What the classifier sees of a block: nothing of where it stands."""
    words = text.split(" ")
    n = len(words)
    points = text.count(".") + text.count(",") + text.count(";")
    return [
        1.0, min(1.0, n / 30), block.links / max(1, block.chars), float(text[-1] in ".!?…:”\"'"), min(1.0, 3 * points / n), float(block.own == "p"), float(block.own in _HEADINGS),
        float(block.own in _ITEMS), float(text[:1] == "©" or text[:9].lower() == "copyright"), sum(w[:1].isupper() for w in words) / n,
    ]


def train(pages: list[str], rounds: int = 12) -> tuple[float, ...]:
    """Weights of the logistic classifier from blocks whose markup leaves no doubt, by Newton's rounds with a ridge towards
    PRIOR; both classes weigh the same. Without examples of both they are PRIOR."""
    rows, labels = [], []
    for page in pages:
        for s, b in blocks(page)[0]:
            if not SURE_OTHER < b.weight < SURE_CONTENT:
                rows.append(statistics(s, b))
                labels.append(b.weight > 0)
    x, y = np.array(rows).reshape(-1, len(PRIOR)), np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return tuple(PRIOR.tolist())
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * len(y)
    w, ridge = PRIOR.copy(), SHRINK * np.eye(len(PRIOR))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (share * (y - p)) - ridge @ (w - PRIOR)
        w = w + np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + ridge, gradient)
    return tuple(w.tolist())


def price(text: str, block: Block, weights: tuple[float, ...]) -> float:
    """The log-odds that a block is content: markup's part and the classifier's, both bounded."""
    seen = sum(a * b for a, b in zip(statistics(text, block), weights))
    return max(-16.0, min(16.0, block.weight)) + max(-6.0, min(6.0, seen))


def tie(levels: int) -> float:
    """Smoothness between neighbours: halves with each level of the tree between them."""
    return SMOOTH * 0.5**levels if levels < 60 else 0.0


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: a node pays its odds for the wrong side, an edge its weight if it is cut.

    A node whose odds outweigh all its edges keeps its side in every minimum cut; such nodes are settled
    first and passed on to their neighbours, and Dinic's maximum flow decides the rest. Ties fall to boilerplate.
    """
    n = len(odds)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for u, v, w in edges:
        if u != v and w > 0:
            near[u][v] = near[u].get(v, 0.0) + w
            near[v][u] = near[v].get(u, 0.0) + w
    value, side = list(odds), [None] * n
    queue = deque(range(n))
    while queue:
        u = queue.popleft()
        if side[u] is not None or near[u] and abs(value[u]) <= sum(near[u].values()):
            continue
        side[u] = value[u] > 0
        for v, w in near[u].items():
            value[v] += w if side[u] else -w
            near[v].pop(u)
            queue.append(v)
        near[u] = {}
    left = [u for u in range(n) if side[u] is None]
    if left:
        for u, s in zip(left, _flow(left, value, near)):
            side[u] = s
    return [bool(s) for s in side]


def _flow(nodes: list[int], value: list[float], near: list[dict[int, float]]) -> list[bool]:
    at = {u: i for i, u in enumerate(nodes)}
    source, sink = len(nodes), len(nodes) + 1
    graph: list[list[int]] = [[] for _ in range(len(nodes) + 2)]
    to: list[int] = []
    cap: list[float] = []

    def arc(u: int, v: int, there: float, back: float) -> None:
        for a, b, c in ((u, v, there), (v, u, back)):
            graph[a].append(len(to))
            to.append(b)
            cap.append(c)

    for u in nodes:
        if value[u] > 0:
            arc(source, at[u], value[u], 0.0)
        elif value[u] < 0:
            arc(at[u], sink, -value[u], 0.0)
        for v, w in near[u].items():
            if u < v:
                arc(at[u], at[v], w, w)
    eps = 1e-9
    while True:
        level = [-1] * len(graph)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in graph[u]:
                if cap[e] > eps and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(len(nodes))]
        turn = [0] * len(graph)
        while True:  # augment along level edges, without recursion
            path: list[int] = []
            u = source
            while u != sink:
                while turn[u] < len(graph[u]):
                    e = graph[u][turn[u]]
                    if cap[e] > eps and level[to[e]] == level[u] + 1:
                        break
                    turn[u] += 1
                else:
                    if not path:
                        break
                    u = to[path.pop() ^ 1]
                    turn[u] += 1
                    continue
                path.append(e)
                u = to[e]
            if u != sink:
                break
            push = min(cap[e] for e in path)
            for e in path:
                cap[e] -= push
                cap[e ^ 1] += push


def main_text(page: str | None, weights: tuple[float, ...] = tuple(PRIOR.tolist())) -> str:
    """The main text: content blocks in page order joined by line ends, white space inside each turned into one space."""
    found, tree = blocks(page or "")
    if not found:
        return ""
    edges, last = [], {}
    for i, (_, b) in enumerate(found):
        if i:
            edges.append((i - 1, i, tie(tree.distance(found[i - 1][1].node, b.node))))
        parent = tree.parent[b.node]
        if parent in last and last[parent] != i - 1:  # the nearest earlier block under the same parent
            edges.append((last[parent], i, tie(int(found[last[parent]][1].node != b.node))))
        last[parent] = i
    keep = min_cut([price(s, b, weights) for s, b in found], edges)
    return "\n".join(s for (s, _), k in zip(found, keep) if k)


def sample(rows: DataFrame, most: int = SAMPLE_PAGES, longest: int = SAMPLE_LONGEST) -> list[str]:
    """At most ``most`` pages of at most ``longest`` characters, those of the least hashes of id and url."""
    n = rows.count()
    at = F.xxhash64("page_id", "url")
    part = F.pmod(at, F.lit(1 << 20)) <= int(min(1.0, 8 * most / max(1, n)) * (1 << 20))
    few = rows.where(part & F.octet_length("html").between(1, longest)).select("html", at.alias("at")).orderBy("at", "html").limit(most)
    return [bytes(r.html).decode("utf-8", "replace") for r in few.collect()]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row, from the whole html.

    The block classifier is trained on ``sample``; every page is labelled whole. A null or empty html, or one without content
    blocks, gives an empty text of 0 characters. A very long or deep page costs time in proportion to its length. Repeated
    rows and null ids or urls pass through; other columns are ignored; an empty table gives an empty result. There is no shuffle.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").cast("binary").alias("html"))
    weights = train(sample(rows))

    def run(batches):
        for b in batches:
            found = [main_text((h.as_py() or b"").decode("utf-8", "replace"), weights) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
