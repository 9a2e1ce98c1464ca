"""Main text of web pages by gradient-boosted trees over the nodes of the document tree.

Every block element is a node with features of its subtree (text, links, punctuation, density), of its tag and
attribute tokens, of its depth and of its place among its siblings. Text that stands directly in the page's body, between its
blocks, forms nodes of its own. Boosted trees give each node the log odds that
it belongs to the article. Decoding is hierarchical: nothing is kept under a node that is dropped,
dropping a node under a kept one costs SWITCH, and the best choice for the whole tree is found from
the leaves up, so no node contradicts its ancestors or descendants.

The trees are fitted on SAMPLE pages at most, labelled by their own semantic elements, and on as many made layouts
(which have no such elements or no wrapper at all, other attribute tokens, layout tables, sidebars, notices, forms and comments), whose words come from those pages.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import least_hashed

SAMPLE = 400
#: Pages with more characters are not used for fitting.
SAMPLE_CHARS = 200_000
SWITCH = 2.0
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style template noscript head title iframe object svg math canvas audio video select textarea datalist".split())
BLOCKS = frozenset(
    "html body main article section nav header footer aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th "
    "caption form fieldset legend blockquote pre figure figcaption address details summary dialog menu hgroup search center".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an opening tag closes, up to the element that bounds the search.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
TAGS = [{"article", "main"}, {"section"}, {"div"}, {"p"}, HEADINGS, {"ul", "ol", "dl", "menu"}, {"li", "dt", "dd"}, {"nav"}, {"header", "hgroup"}, {"footer"}, {"aside"}, {"form", "fieldset", "search", "dialog"}, {"table", "tr", "td", "th"}, {"blockquote", "pre"}, {"figure", "figcaption"}]
TOKENS = {
    "content": "content article post entry story body text main maincontent blog page single hentry prose".split(),
    "menu": "nav navbar menu navigation breadcrumb breadcrumbs topnav toc tabs pagination pager links".split(),
    "header": "header masthead banner topbar logo branding".split(),
    "footer": "footer foot copyright legal colophon bottom imprint".split(),
    "side": "sidebar side rail aside related widget widgets recommended popular trending more".split(),
    "advert": "ad ads advert advertisement promo promotion sponsor sponsored adsense dfp outbrain".split(),
    "notice": "notice cookie cookies consent alert newsletter subscribe signup popup modal overlay gdpr paywall message".split(),
    "comment": "comment comments respond reply replies discussion disqus reader feedback".split(),
    "share": "share sharing social follow tags meta byline author print tools".split(),
    "form": "form search login signin register input field contact".split(),
}
GROUPS = {t: i for i, words in enumerate(TOKENS.values()) for t in words}
_SPLIT = re.compile(r"[^a-z]+")
_SPACE = re.compile(r"\s+")
_ENDS = re.compile(r"[.,;:!?]")
#: The tag of a node for text that stands directly in the body.
RUN = "#run"
_ANY_BLOCK = "#block"


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    groups: tuple[int, ...]
    truth: str | None = None
    children: list[int] = field(default_factory=list)
    own: int = 0
    links: int = 0
    marks: int = 0
    elements: int = 1
    controls: int = 0
    headings: int = 0
    items: int = 0
    paragraph: int = 0
    texts: int = 0


class Tree(HTMLParser):
    """Block nodes in document order, and the page's text in pieces: (node, text), with None between blocks."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("html", -1, 0, ())]
        self.stack: list[tuple[str, int]] = []
        #: Where on the stack the open elements of each tag are, so that no tag makes the parser walk through it.
        self.open: dict[str, list[int]] = {}
        self.push("html", 0)
        self.pieces: list[tuple[int, str | None]] = []
        self.run = -1
        self.feed(html)
        self.close()

    def push(self, tag: str, at: int) -> None:
        for name in (tag, _ANY_BLOCK) if tag in BLOCKS else (tag, "#unseen") if tag in UNSEEN else (tag,):
            self.open.setdefault(name, []).append(len(self.stack))
        self.stack.append((tag, at))

    def last(self, tag: str) -> int:
        places = self.open.get(tag)
        return places[-1] if places else -1

    def edge(self, at: int) -> None:
        """Between two blocks; text in the body after it is another run."""
        self.pieces.append((at, None))
        self.run = -1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("html", "body") and self.last(tag) >= 0:
            return
        if tag == "hr":
            self.edge(self.stack[-1][1])
        elif tag == "br":
            self.pieces.append((self.run if self.run >= 0 else self.stack[-1][1], " "))
        if tag in BLOCKS:
            self.pop("p", {"table", "td", "th", "li"})
        if tag in CLOSES:
            for t in CLOSES[tag][0]:
                self.pop(t, CLOSES[tag][1])
        at = self.stack[-1][1]
        node = self.nodes[at]
        if tag in ("input", "button", "select", "textarea", "label"):
            node.controls += 1
        if tag in VOID:
            return
        if tag in BLOCKS:
            values = dict(attrs)
            words = _SPLIT.split(" ".join(values.get(k) or "" for k in ("class", "id", "role", "aria-label")).lower())
            groups = tuple(sorted({GROUPS[w] for w in words if w in GROUPS}))
            at = self.grown(tag, at, groups, values.get("data-truth"))
            self.edge(at)
            if "hidden" in values or "display:none" in (values.get("style") or "").replace(" ", ""):
                self.nodes[at].controls += 5
        else:
            node.elements += 1
        self.push(tag, at)

    def grown(self, tag: str, parent: int, groups: tuple[int, ...] = (), truth: str | None = None) -> int:
        self.nodes.append(Node(tag, parent, self.nodes[parent].depth + 1, groups, truth))
        self.nodes[parent].children.append(len(self.nodes) - 1)
        return len(self.nodes) - 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def pop(self, tag: str, bounds: set[str]) -> None:
        at = self.last(tag)
        if at > 0 and all(self.last(b) < at for b in bounds if b != tag):
            self.cut(at)

    def cut(self, i: int) -> None:
        for tag, at in reversed(self.stack[i:]):
            for name in (tag, _ANY_BLOCK) if tag in BLOCKS else (tag, "#unseen") if tag in UNSEEN else (tag,):
                self.open[name].pop()
            if tag in BLOCKS:
                self.edge(self.nodes[at].parent)
        del self.stack[i:]

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        self.pop(tag, set() if tag in BLOCKS or tag in UNSEEN else {_ANY_BLOCK})

    def handle_data(self, data: str) -> None:
        if self.open.get("#unseen"):
            return
        at = self.stack[-1][1]
        n = len(data.strip())
        if self.nodes[at].tag in ("html", "body"):
            if self.run < 0 and n:
                self.run = self.grown(RUN, at)
            if self.run < 0:
                return
            at = self.run
        self.pieces.append((at, data))
        if n:
            node = self.nodes[at]
            node.own += n
            node.texts += 1
            node.links += n if self.open.get("a") else 0
            node.marks += len(_ENDS.findall(data))

    def features(self) -> np.ndarray:
        nodes = self.nodes
        n = len(nodes)
        total = [v.own for v in nodes]
        links, marks, elements, controls = [v.links for v in nodes], [v.marks for v in nodes], [v.elements for v in nodes], [v.controls for v in nodes]
        heads, items = [int(v.tag in HEADINGS) for v in nodes], [int(v.tag == "li") for v in nodes]
        inside = [v.own if v.tag in ("p", "pre", "blockquote", RUN) else 0 for v in nodes]
        blocks = [1] * n
        for i in range(n - 1, 0, -1):
            p = nodes[i].parent
            for column in (total, links, marks, elements, controls, heads, items, inside, blocks):
                column[p] += column[i]
        out = np.zeros((n, 17 + len(TAGS) + 3 * len(TOKENS) + 7), np.float32)
        place, above = [0] * n, [frozenset()] * n
        #: Whether the page names its article, by element.
        named = any(v.tag in TAGS[0] for v in nodes)
        seen = 0
        page = max(1, total[0])
        begins = [0] * n
        for i, v in enumerate(nodes):
            begins[i] = seen
            seen += v.own
        for v in nodes:
            for k, c in enumerate(v.children):
                place[c] = k
        for i, v in enumerate(nodes):
            t = total[i]
            up = nodes[v.parent] if v.parent >= 0 else v
            kin = max(1, len(up.children))
            if i:
                above[i] = above[v.parent] | frozenset(up.groups) | ({-1 - k for k, s in enumerate(TAGS) if up.tag in s})
            row = out[i]
            row[:17] = (
                v.depth, math.log1p(t), links[i] / max(1, t), math.log1p(elements[i]), t / elements[i], inside[i] / max(1, t), items[i] / blocks[i],
                v.own / max(1, t), place[i] / kin, kin, t / max(1, total[v.parent] if i else t), t / page, 100 * marks[i] / max(1, t),
                t / blocks[i], begins[i] / page, controls[i], heads[i] / blocks[i],
            )
            at = 17
            for k, s in enumerate(TAGS):
                row[at + k] = v.tag in s
            at += len(TAGS)
            for g in v.groups:
                row[at + g] = 1
            at += len(TOKENS)
            for g in above[i]:
                if g >= 0:
                    row[at + g] = 1
            at += len(TOKENS)
            for c in v.children:
                for g in nodes[c].groups:
                    row[at + g] = 1
            at += len(TOKENS)
            row[at : at + 7] = (-1 in above[i], -8 in above[i] or -10 in above[i], -11 in above[i] or -12 in above[i], -9 in above[i], len(v.groups) > 0, v.tag == RUN, named)
        return out

    def decode(self, odds: np.ndarray) -> list[bool]:
        """The best set of nodes that holds every kept node's ancestors."""
        n = len(self.nodes)
        gain = odds.astype(float).tolist()
        for i in range(n - 1, 0, -1):  # children come after their parents
            gain[self.nodes[i].parent] += max(-SWITCH, gain[i])
        keep = [False] * n
        for i in range(n):
            p = self.nodes[i].parent
            keep[i] = any(gain[c] > 0 for c in self.nodes[0].children) if i == 0 else keep[p] and (gain[i] > -SWITCH if self.nodes[p].tag not in ("html", "body") else gain[i] > 0 or self.nodes[i].tag == "body")
        return keep

    def text(self, keep: list[bool]) -> str:
        done, block = [], []

        def flush() -> None:
            if joined := _SPACE.sub(" ", "".join(block)).strip():
                done.append(joined)
            block.clear()

        for at, piece in self.pieces:
            if piece is None:
                flush()
            elif keep[at]:
                block.append(piece)
        flush()
        return " ".join(done)


@dataclass
class BoostedTrees:
    """Trees of one depth: each is an array of features and thresholds in heap order, and its leaves' values."""

    base: float
    features: np.ndarray
    thresholds: np.ndarray
    leaves: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        depth = int(math.log2(self.leaves.shape[1]))
        for f, t, leaf in zip(self.features, self.thresholds, self.leaves):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += leaf[at - len(f)]
        return out


def fit_boosted_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 1.0) -> BoostedTrees:
    """Logistic gradient boosting with second-order gains over quantile bins."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base = math.log(share / (1 - share))
    score = np.full(n, base)
    inner = (1 << depth) - 1
    features, thresholds, leaves = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, 1 << depth))
    for k in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            local = at - first
            best = np.full(width, 1e-6)
            whole_g, whole_h = np.bincount(local, g, width), np.bincount(local, h, width)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                size = len(c) + 1
                cell = local * size + binned[:, j]
                gs = np.bincount(cell, g, width * size).reshape(width, size).cumsum(axis=1)[:, :-1]
                hs = np.bincount(cell, h, width * size).reshape(width, size).cumsum(axis=1)[:, :-1]
                rg, rh = whole_g[:, None] - gs, whole_h[:, None] - hs
                gain = gs**2 / (hs + ridge) + rg**2 / (rh + ridge) - (whole_g**2 / (whole_h + ridge))[:, None]
                gain[(hs < 1) | (rh < 1)] = 0
                top = gain.argmax(axis=1)
                better = gain[np.arange(width), top] > best
                for v in np.flatnonzero(better):
                    best[v] = gain[v, top[v]]
                    features[k, first + v], thresholds[k, first + v] = j, c[top[v]]
            at = 2 * at + 1 + (x[np.arange(n), features[k][at]] > thresholds[k][at])
        leaf = at - inner
        leaves[k] = -rate * np.bincount(leaf, g, 1 << depth) / (np.bincount(leaf, h, 1 << depth) + ridge)
        score += leaves[k][leaf]
    return BoostedTrees(base, features, thresholds, leaves)


def semantic_truth(tree: Tree) -> list[int] | None:
    """1 for what lies in the page's article element and its wrappers, 0 for the rest. None without such an element."""
    named = {"article", "main"}
    if not any(v.tag in named for v in tree.nodes):
        return None
    out = {"nav", "aside", "footer", "form", "header"}
    bad = {k for k, name in enumerate(TOKENS) if name not in ("content", "header", "share")}
    truth = [0] * len(tree.nodes)
    for i, v in enumerate(tree.nodes):
        within = i > 0 and truth[v.parent] == 1
        dropped = v.tag in out or bad & set(v.groups)
        truth[i] = int(not dropped and (v.tag in named or within))
    return wrapped(tree, truth)


def wrapped(tree: Tree, truth: list[int]) -> list[int]:
    for i in range(len(tree.nodes) - 1, 0, -1):
        if truth[i]:
            truth[tree.nodes[i].parent] = 1
    return truth


def made_truth(tree: Tree) -> list[int]:
    plain = all(v.tag in ("html", RUN) for v in tree.nodes)  # a page without any block
    truth = [0] * len(tree.nodes)
    for i, v in enumerate(tree.nodes):
        truth[i] = int(v.truth == "1") if v.truth else truth[v.parent] if i else int(plain)
    return wrapped(tree, truth)


def made_page(words: list[str], draw: random.Random) -> str:
    """A page in one of many layouts; data-truth says what is article."""

    def some(a: int, b: int) -> str:
        return escape(" ".join(draw.choice(words) for _ in range(draw.randint(a, b))))

    def sentence(a: int, b: int) -> str:
        return some(a, b) + draw.choice([".", ".", ".", "!", "?"])

    def named(group: str, tags: list[str], body: str, truth: int) -> str:
        tag = draw.choice(tags)
        word, extra = draw.choice(TOKENS[group]), draw.choice(["", "-wrap", " block", "-inner", " col"])
        attr = "" if draw.random() < 0.3 else f' {draw.choice(["class", "class", "id"])}="{word}{extra}"'
        return f'<{tag}{attr} data-truth="{truth}">{body}</{tag}>'

    def linked(n: int) -> str:
        entries = "".join(f'<li><a href="/{i}">{some(1, 4)}</a></li>' for i in range(n))
        return f"<ul>{entries}</ul>" if draw.random() < 0.7 else " ".join(f'<a href="/{i}">{some(1, 3)}</a>' for i in range(n))

    def noise(kind: str) -> str:
        if kind == "menu":
            return named("menu", ["nav", "div", "ul", "div"], linked(draw.randint(3, 9)), 0)
        if kind == "header":
            return named("header", ["header", "div", "header"], f"<div>{some(1, 4)}</div>" + (linked(3) if draw.random() < 0.5 else ""), 0)
        if kind == "footer":
            return named("footer", ["footer", "div", "footer"], draw.choice([f"<p>&copy; {some(2, 8)}</p>", f"&copy; {sentence(2, 12)}", linked(4) + f"<p>{some(2, 6)}</p>"]), 0)
        if kind == "side":
            return named("side", ["aside", "div", "section"], f"<h3>{some(1, 4)}</h3>" + linked(draw.randint(2, 7)) + (f"<p>{sentence(4, 12)}</p>" if draw.random() < 0.4 else ""), 0)
        if kind == "advert":
            return named("advert", ["div", "div", "aside", "section"], draw.choice([sentence(3, 14), f"<p>{sentence(3, 14)}</p>", f'<a href="#">{some(2, 8)}</a>']), 0)
        if kind == "notice":
            return named("notice", ["div", "div", "section", "dialog"], f"<p>{sentence(4, 18)}</p>" + draw.choice(["", "<button>OK</button>", '<a href="#">x</a>']), 0)
        if kind == "comment":
            rows = "".join(f'<div class="{draw.choice(["comment", "reply", "comment-item"])}"><b>{some(1, 2)}</b><p>{sentence(4, 30)}</p></div>' for _ in range(draw.randint(1, 5)))
            return named("comment", ["section", "div", "ol", "div"], f"<h3>{some(1, 2)}</h3>{rows}", 0)
        if kind == "form":
            return named("form", ["form", "form", "div"], f'<label>{some(1, 3)}</label><input type="text"><button>{some(1, 2)}</button>', 0)
        return named("share", ["div", "ul"], linked(draw.randint(2, 4)), 0)

    def table() -> str:
        rows = ["".join(f"<{cell}>{some(1, 4)}</{cell}>" for _ in range(draw.randint(2, 4))) for cell in ["th", *["td"] * draw.randint(1, 5)]]
        return "<table>" + "".join(f"<tr>{r}</tr>" for r in rows) + "</table>"

    def bare() -> str:
        """Text that no block holds."""
        lines = [sentence(3, 24) if draw.random() < 0.8 else f"<{t}>{some(1, 6)}</{t}>" for t in draw.choices(["b", "span", "i", "font", "x-text"], k=draw.randint(1, 8))]
        return draw.choice(["<br>", "<br><br>", " ", "\n"]).join(lines)

    def part() -> str:
        kind = draw.random()
        if kind < 0.7:
            return f"<p>{' '.join(sentence(1, 24) for _ in range(draw.randint(1, 6)))}</p>"
        if kind < 0.77:
            return f"<h{(level := draw.randint(2, 4))}>{some(1, 6)}</h{level}>"
        if kind < 0.83:
            return f"<ul><li>{sentence(2, 9)}</li><li>{sentence(2, 9)}</li></ul>"
        if kind < 0.87:
            return f"<blockquote>{sentence(5, 20)}</blockquote>"
        if kind < 0.91:
            return f"<div>{sentence(4, 24)}</div>"
        if kind < 0.96:
            return table()
        return f"<pre>{some(4, 30)}</pre>" if kind < 0.98 else f"<dl><dt>{some(1, 3)}</dt><dd>{sentence(3, 12)}</dd></dl>"

    layout = draw.random()
    body = "" if draw.random() < 0.15 else f"<h1>{some(2, 10)}</h1>"
    for _ in range(draw.randint(1, 14)):
        body += bare() if layout < 0.3 and draw.random() < 0.5 else part()
    if draw.random() < 0.3:
        body = body.replace("</p>", "</p>" + noise(draw.choice(["advert", "share", "side", "form"])), 1)
    if draw.random() < 0.2:
        body += noise("comment")
    before = [noise(k) for k in ("header", "menu", "notice", "advert", "form") if draw.random() < 0.55]
    after = [noise(k) for k in ("share", "comment", "side", "advert", "notice", "footer", "form") if draw.random() < 0.5]
    draw.shuffle(before)
    if layout < 0.04:
        return bare()
    if layout < 0.3:
        # The article stands directly in the body.
        return f'<html><head><title>{some(2, 6)}</title></head><body data-truth="1">{"".join(before)}{body}{"".join(after)}</body></html>'
    if layout < 0.4:
        cells = [f'<td data-truth="0">{"".join(before)}</td>', f'<td data-truth="1">{body}</td>', *([f'<td data-truth="0">{"".join(after)}</td>'] if draw.random() < 0.5 else [])]
        content = f"<table><tr>{''.join(cells)}</tr></table>"
        return f"<html><head><title>{some(2, 6)}</title></head><body>{content}</body></html>"
    content = named("content", ["div", "div", "section", "article", "main"], body, 1)
    if draw.random() < 0.5:
        content = f"<div{draw.choice(['', ' class=wrapper', ' id=layout'])}>{''.join(before)}{content}{''.join(after)}</div>"
    else:
        content = "".join(before) + content + "".join(after)
    if draw.random() < 0.2:
        content = draw.choice([f'<a href="#">{some(1, 3)}</a>{content}', f"{content}&copy; {some(1, 4)}"])
    return f"<html><head><title>{some(2, 6)}</title></head><body>{content}</body></html>"


def fit(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE, seed: int = 9) -> BoostedTrees:
    """Fits the trees on at most sample pages, by the least seeded hash, and as many made ones."""
    texts = pages.where(F.length(html_col).between(1, SAMPLE_CHARS)).select(F.col(html_col).alias("html"))
    rows = least_hashed(texts, ["html"], sample, seed).collect()  # bounded by sample
    examples, words = [], []
    for r in rows:
        tree = Tree(r.html)
        words += [w for at, piece in tree.pieces if piece for w in piece.split()][:200]
        if truth := semantic_truth(tree):
            examples.append((tree, truth))
    draw = random.Random(seed)
    words = sorted(set(words)) or ["the", "of", "and", "a", "to", "in"]
    for _ in range(max(200, len(rows))):
        tree = Tree(made_page(words, draw))
        examples.append((tree, made_truth(tree)))
    x = np.concatenate([t.features()[1:] for t, _ in examples])
    y = np.concatenate([np.array(truth[1:], float) for _, truth in examples])
    return fit_boosted_trees(x, y)


def extract(html: str | None, trees: BoostedTrees) -> str:
    tree = Tree(html or "")
    return tree.text(tree.decode(trees(tree.features())))


def main_texts(pages: DataFrame, trees: BoostedTrees, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: a row for each row of pages.

    Null and empty pages and pages without an article give the empty text. Null ids and urls stay null. An
    empty table gives an empty one. Other columns are not looked at.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                made = [Tree(h.as_py() or "") for h in part.column("html")]
                found = [t.features() for t in made]
                odds = np.split(model(np.concatenate(found)), np.cumsum([len(f) for f in found])[:-1])
                texts = [t.text(t.decode(o)) for t, o in zip(made, odds)]
                yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    held = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = dict(held.dtypes)
    return held.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
