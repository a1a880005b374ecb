"""Main text of web pages from a tree-structured graphical model over the DOM.

A page becomes a tree of its block elements and text runs (inline markup is folded into the run it stands in). Each node
is content or not: its own features give its potential, and parent-child potentials, which depend on the kind of the
child, tie it to its parent. Sum-product messages go up the tree and down again, a whole level of all pages at a time,
and give each node's content marginal. The text of the runs whose marginal reaches the threshold is the page's main
text. Weights are trained by gradient ascent on the exact likelihood of labelled pages.

The pages table has no labels, so the operator's default training pages are made by ``labelled_pages``: layouts of
invented words in which the article's nodes are known. ``train`` takes any labelled pages of that form.

Defined cases: null and empty html give the empty text; broken markup is read as browsers do in the main (elements left
open end with their parent, a paragraph ends where the next block starts, an unfinished tag is dropped, quotes count
only where an attribute's value starts); a value whose quote never closes ends with its tag at the next ``>``; scripts,
styles, comments and forms' controls are never text; elements may be nested to any depth; repeated rows are each
extracted; an empty table gives an empty result; other columns pass through untouched where they are asked for.

Reading a page takes time in proportion to its length, whatever its markup.
"""

from __future__ import annotations

import html
import random
import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeline.llm.common import ship

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SILENT = {"script", "style", "noscript", "template", "svg", "iframe", "object", "head", "title", "select", "textarea", "button", "canvas"}
#: Elements whose content is raw until their own end tag.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}
INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
}
BLOCKS = [
    "html", "body", "article", "main", "section", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "tr", "td", "th", "tbody", "thead", "blockquote", "pre", "figure", "figcaption",
    "header", "footer", "nav", "aside", "form", "fieldset", "address", "details", "summary",
]
_TAG = {t: i for i, t in enumerate(BLOCKS)}
#: An open element of these ends where one of the others starts.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
#: They reach no farther than the innermost of these.
HOLDERS = ("ul", "ol", "dl", "table")
HINTS = [
    re.compile(p)
    for p in (
        r"\b(nav|menu|breadcrumbs?|toc|tabs?|pagination|pager)", r"\b(ads?|advert|sponsor|promo|banner)", r"foot|copyright|legal", r"\b(header|masthead|topbar|logo)", r"side|related|widget|recommend|popular",
        r"comment|reply|disqus|discussion", r"cookie|consent|notice|popup|modal|alert|subscribe|newsletter|share|social", r"content|article|post|entry|story|main|body|text",
    )
]
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_GAP = re.compile(r"[\s/]*")
_KEY = re.compile(r"=?[^\s/>=]*")
_IS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_SPACES = re.compile(r"\s+")
KINDS = 5  # of child for parent-child potentials: run, paragraph-like, list-like, section-like, other
OWN = 34


@dataclass
class Tree:
    """Nodes of one page in page order; a parent stands before its children."""

    parent: list[int] = field(default_factory=list)
    tag: list[int] = field(default_factory=list)  # index in BLOCKS; -1: text run, -2: any other block
    hint: list[int] = field(default_factory=list)  # bits of HINTS found in class, id and role
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)  # characters of the run inside links
    label: list[int] = field(default_factory=list)

    def add(self, parent: int, tag: int, hint: int = 0, text: str = "", linked: int = 0, label: int = 0) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.hint.append(hint)
        self.text.append(text)
        self.linked.append(linked)
        self.label.append(label)
        return len(self.parent) - 1


class _Reader:
    """Tags of a page, in one pass. What was once looked for in vain is not looked for again."""

    def __init__(self, page: str):
        self.page, self.size = page, len(page)
        self.lacking: set[str] = set()

    def find(self, what: str, at: int) -> int:
        """Where ``what`` is next, or -1."""
        if what in self.lacking:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.lacking.add(what)
        return found

    def end_of(self, name: str, at: int) -> int:
        """Where the next end tag of ``name`` ends, or -1."""
        if "</" + name in self.lacking:
            return -1
        found = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(self.page, at)
        if not found:
            self.lacking.add("</" + name)
            return -1
        return found.end()

    def attributes(self, at: int) -> tuple[int, list[tuple[str, str]], bool]:
        """(where the tag ends, or -1 if it never does; attributes with values; whether it closes itself)."""
        page, out = self.page, []
        while True:
            gap = _GAP.match(page, at)
            at = gap.end()
            if at >= self.size:
                return -1, out, False
            if page[at] == ">":
                return at + 1, out, gap[0].endswith("/")
            key = _KEY.match(page, at)
            sign = _IS.match(page, key.end())
            if not sign:
                at = key.end()
                continue
            at = sign.end()
            quote = page[at : at + 1]
            if quote in ("'", '"'):
                end = self.find(quote, at + 1)
                if end < 0:
                    end = self.find(">", at)
                    return end + 1 if end >= 0 else -1, out, False
                value, at = page[at + 1 : end], end + 1
            else:
                bare = _BARE.match(page, at)
                value, at = bare[0], bare.end()
            out.append((key[0].lower(), value))

    def tags(self):
        """(start, end, "/" of an end tag or "", name, attributes, closes itself); a comment has no name."""
        page, at = self.page, 0
        while (start := page.find("<", at)) >= 0:
            mark = page[start + 1 : start + 2]
            close = "/" if mark == "/" else ""
            name = _NAME.match(page, start + 1 + len(close))
            if name:
                at, attrs, alone = self.attributes(name.end())
                at = self.size if at < 0 else at
                # What a tag's element holds may be skipped by whoever reads it.
                to = yield start, at, close, name[0].lower() if at < self.size or page.endswith(">") else None, attrs, alone
                at = to if to is not None else at
            elif mark in ("!", "?", "/") and mark:
                comment = page.startswith("<!--", start)
                end = self.find("-->", start + 2) if comment else self.find(">", start)
                at = self.size if end < 0 else end + (3 if comment else 1)
                yield start, at, close, None, (), False
            else:
                at = start + 1


def parse(page: str) -> Tree:
    """The tree of a page. An attribute ``data-label="1"`` marks content in training pages."""
    tree, reader = Tree(), _Reader(page)
    stack: list[tuple[str, int, int]] = []
    places: dict[str, list[int]] = defaultdict(list)  # of each open block's name, where in the stack it stands
    inline: list[str] = []
    inside: dict[str, int] = defaultdict(int)  # open inline elements by name
    run: list[str] = []
    linked = 0

    def say(text: str):
        nonlocal linked
        if text:
            run.append(html.unescape(text) if "&" in text else text)
            linked += len(text) * (inside["a"] > 0)

    def flush():
        nonlocal linked
        if run:
            text = _SPACES.sub(" ", "".join(run)).strip()
            if text:
                tree.add(stack[-1][1], -1, 0, text, min(linked, len(text)), stack[-1][2])
            run.clear()
        linked = 0

    def push(name: str, hint: int = 0, label: int = 0):
        places[name].append(len(stack))
        stack.append((name, tree.add(stack[-1][1] if stack else -1, _TAG.get(name, -2), hint, label=label), label))

    def close_to(n: int):
        flush()
        while len(stack) > n:
            places[stack.pop()[0]].pop()
        inline.clear()
        inside.clear()

    push("html")
    at, tags = 0, reader.tags()
    to = None
    while (tag := _next(tags, to)) is not None:
        start, end, close, name, attrs, alone = tag
        to = None
        say(page[at:start])
        at = end
        if name is None:
            continue
        if close:
            if name in INLINE:
                while inside[name]:
                    last = inline.pop()
                    inside[last] -= 1
                    if last == name:
                        break
            elif places[name] and places[name][-1] > 0:
                close_to(places[name][-1])
            continue
        if name in SILENT:
            if name in RAW or name in ("svg", "template", "select", "object", "button", "canvas"):
                to = reader.end_of(name, end)
                if to < 0:
                    to = len(page) if name in RAW else None
                at = end if to is None else to
            run.append(" ")
            continue
        if name in VOID:
            run.append(" ")
            if name == "hr":
                flush()
            continue
        if name in INLINE:
            if not alone:
                inline.append(name)
                inside[name] += 1
            continue
        close_to(len(stack))
        if name in ("html", "body"):
            if name == "body" and len(stack) == 1:
                push("body")
            continue
        if stack[-1][0] == "p" or (stack[-1][0][0] == "h" and stack[-1][0][1:].isdigit()):
            close_to(len(stack) - 1)
        if name in CLOSES:
            k = max((places[t][-1] for t in CLOSES[name] if places[t]), default=0)
            if k > max((places[t][-1] for t in HOLDERS if places[t]), default=0):
                close_to(k)
        hint, label = 0, stack[-1][2]
        for key, value in attrs:
            if key in ("class", "id", "role"):
                value = value.lower()
                for i, h in enumerate(HINTS):
                    if h.search(value):
                        hint |= 1 << i
            elif key == "data-label":
                label = int(value == "1")
        push(name, hint, label)
    say(page[at:])
    flush()
    return tree


def _next(tags, to: int | None):
    """The next tag, read from ``to`` on where that is given; None at the end."""
    try:
        return tags.send(to)
    except StopIteration:
        return None


@dataclass
class Forest:
    """The trees of many pages side by side."""

    parent: np.ndarray
    depth: np.ndarray
    kind: np.ndarray
    x: np.ndarray
    starts: np.ndarray  # first node of each page, and one more


_GROUPS = {
    "run": {-1},
    "para": {_TAG[t] for t in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figure", "figcaption")},
    "list": {_TAG[t] for t in ("ul", "ol", "li", "dl", "dt", "dd", "table", "tr", "td", "th", "tbody", "thead")},
    "part": {_TAG[t] for t in ("article", "main", "section", "div", "body", "html")},
}
_KIND = np.full(len(BLOCKS) + 2, 4)
for _k, _tags in enumerate(_GROUPS.values()):
    for _t in _tags:
        _KIND[_t] = _k
#: Tags with a feature of their own; -1 and -2 wrap to the last two places.
_OWN_TAGS = ["article", "main", "section", "div", "p", "h1", "h2", "ul", "li", "header", "footer", "nav", "aside", "form", "table"]


def by_level(depth: np.ndarray) -> list[np.ndarray]:
    """The nodes of each depth, in page order."""
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.searchsorted(depth[order], np.arange(1, int(depth.max(initial=0)) + 1)))


def forest(trees: list[Tree]) -> Forest:
    sizes = [len(t.parent) for t in trees]
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    flat = lambda name: np.array([v for t in trees for v in getattr(t, name)], np.int64)
    parent = flat("parent")
    parent = np.where(parent >= 0, parent + np.repeat(starts[:-1], sizes), -1)
    tag, hint, linked = flat("tag"), flat("hint"), flat("linked").astype(float)
    chars = np.array([len(s) for t in trees for s in t.text], float)
    closed = np.array([s[-1:] in ".!?\"'" and bool(s) for t in trees for s in t.text], float)
    n = len(parent)
    depth = np.zeros(n, np.int64)
    for i, p in enumerate(parent.tolist()):
        if p >= 0:
            depth[i] = depth[p] + 1
    total, links, runs, ends, kids = chars.copy(), linked.copy(), (tag == -1).astype(float), closed.copy(), np.zeros(n)
    above = np.where(parent >= 0, hint[parent], 0)
    levels = by_level(depth)
    for at in reversed(levels[1:]):
        for a in (total, links, runs, ends):
            np.add.at(a, parent[at], a[at])
    np.add.at(kids, parent[parent >= 0], 1)
    for at in levels[1:]:
        above[at] |= above[parent[at]]
    page = np.repeat(np.arange(len(trees)), sizes)
    whole = np.maximum(1, total[starts[:-1]])[page] if n else total
    some = np.maximum(total, 1)
    place = (np.arange(n) - np.repeat(starts[:-1], sizes)) / np.maximum(1, np.repeat(sizes, sizes))
    own = [np.ones(n), np.log1p(total) / 6, links / some, total / whole, ends / np.maximum(runs, 1), np.minimum(runs, 20) / 20, place, np.minimum(depth, 12) / 12, np.log1p(kids) / 3, (total == 0) * 1.0]
    own += [(tag == _TAG[t]) * 1.0 for t in _OWN_TAGS]
    own += [(tag == -1) * 1.0]
    own += [(hint >> i & 1) * 1.0 for i in range(len(HINTS))]
    return Forest(parent, depth, _KIND[tag], np.stack(own, axis=1) if n else np.zeros((0, OWN)), starts)


@dataclass
class TreeModel:
    weights: np.ndarray  # own features -> log odds of content
    pairs: np.ndarray  # [kind of child, label of parent, label of child]

    def messages(self, f: Forest):
        """Beliefs below each node (log odds), messages up to the parent, and marginals (log odds)."""
        e = f.x @ self.weights
        up, below = np.zeros_like(e), e.copy()
        levels = by_level(f.depth)
        t = self.pairs[f.kind]
        for at in reversed(levels[1:]):
            b = below[at]
            up[at] = np.logaddexp(t[at, 1, 1] + b, t[at, 1, 0]) - np.logaddexp(t[at, 0, 1] + b, t[at, 0, 0])
            np.add.at(below, f.parent[at], up[at])
        whole = below.copy()
        for at in levels[1:]:
            above = whole[f.parent[at]] - up[at]
            whole[at] = below[at] + np.logaddexp(t[at, 1, 1] + above, t[at, 0, 1]) - np.logaddexp(t[at, 1, 0] + above, t[at, 0, 0])
        return below, up, whole

    def marginals(self, f: Forest) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.messages(f)[2], -500, 500)))


def train(pages: list[str], rounds: int = 300, ridge: float = 1e-5) -> TreeModel:
    """From pages whose elements carry ``data-label="1"`` (content) or ``"0"``; children inherit."""
    trees = [parse(p) for p in pages]
    f = forest(trees)
    y = np.array([v for t in trees for v in t.label], np.int64)
    child = np.flatnonzero(f.parent >= 0)
    seen = np.zeros((KINDS, 2, 2))
    np.add.at(seen, (f.kind[child], y[f.parent[child]], y[child]), 1)
    size = f.x.shape[1]
    theta = np.zeros(size + KINDS * 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        model = TreeModel(theta[:size], theta[size:].reshape(KINDS, 2, 2))
        below, up, whole = model.messages(f)
        p = 1 / (1 + np.exp(-np.clip(whole, -500, 500)))
        above, b, t = whole[f.parent[child]] - up[child], below[child], model.pairs[f.kind[child]]
        joint = np.stack([t[:, 0, 0], t[:, 0, 1] + b, t[:, 1, 0] + above, t[:, 1, 1] + above + b], axis=1)
        joint = np.exp(joint - joint.max(axis=1, keepdims=True))
        joint /= joint.sum(axis=1, keepdims=True)
        expected = np.stack([np.bincount(f.kind[child], joint[:, c], KINDS) for c in range(4)], axis=1)
        grad = np.concatenate([f.x.T @ (y - p), (seen.reshape(KINDS, 4) - expected).ravel()]) / len(y) - ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return TreeModel(theta[:size], theta[size:].reshape(KINDS, 2, 2))


def labelled_pages(n: int = 240, seed: int = 11) -> list[str]:
    """Training pages in several layouts, of invented words, with the article's nodes marked."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice(["ka", "lo", "mi", "ter", "en", "su", "ra", "on", "di", "ve"]) for _ in range(rnd.randint(1, 4))) for _ in range(300)]

    def say(a: int, b: int, stop: str = ".") -> str:
        return " ".join(rnd.choice(words) for _ in range(rnd.randint(a, b))).capitalize() + stop

    def text(a: int = 1, b: int = 8) -> str:
        out = " ".join(say(1, 25) for _ in range(rnd.randint(a, b)))
        if rnd.random() < 0.2:
            out = " ".join(w + rnd.choice(["###", "!!", " |", "&amp;&amp;", "***"]) for w in out.split())
        if rnd.random() < 0.1:
            out = out.upper()
        if rnd.random() < 0.25:
            cut = len(out) // 2
            out = f"{out[:cut]}<a href='/x'>{say(1, 3, '')}</a>{out[cut:]}"
        return out

    def links(k: int, tag: str = "li") -> str:
        return "".join(f"<{tag}><a href='/{i}'>{say(1, 3, '')}</a></{tag}>" for i in range(k))

    def noise(kind: str) -> str:
        body = {
            "nav": lambda: f"<nav><ul>{links(rnd.randint(2, 8))}</ul></nav>",
            "menu": lambda: f"<div class='{rnd.choice(['menu', 'nav-bar', 'breadcrumb', 'top-menu'])}'>{links(rnd.randint(2, 8), rnd.choice(['li', 'span']))}</div>",
            "ad": lambda: f"<div class='{rnd.choice(['ad', 'advert', 'sponsored', 'promo-box', 'banner', 'ads top'])}'>{rnd.choice(['', '<p>'])}{text(1, 3)}</div>",
            "header": lambda: f"<header>{rnd.choice(['<div class=logo>', '<h1>', '<p>', '<h2>'])}{say(1, 3, '')}{rnd.choice(['', '</h1>', '</div>'])}{rnd.choice(['', say(3, 9), '<nav>' + links(3) + '</nav>'])}</header>",
            "footer": lambda: f"<footer>{rnd.choice(['<p>', '', '&copy; '])}{say(2, 12)} &middot; {say(1, 10)}</footer>",
            "foot": lambda: f"<div id='{rnd.choice(['footer', 'page-foot', 'legal'])}'><p>{say(4, 15)}</p>{links(3, 'span')}</div>",
            "aside": lambda: f"<aside>{rnd.choice(['<h3>' + say(1, 3, '') + '</h3>', ''])}{rnd.choice(['<ul>' + links(4) + '</ul>', '<p>' + text(1, 2) + '</p>'])}</aside>",
            "side": lambda: f"<div class='{rnd.choice(['sidebar', 'related', 'widget', 'popular-posts'])}'><h3>{say(1, 3, '')}</h3><ul>{links(4)}</ul><p>{say(3, 12)}</p></div>",
            "notice": lambda: f"<div class='{rnd.choice(['cookie-notice', 'consent', 'newsletter', 'alert', 'share-bar'])}'><p>{text(1, 2)}</p><button>ok</button></div>",
            "form": lambda: f"<form><label>{say(1, 3, '')}</label><input name='q'>{say(1, 4)}<button>go</button></form>",
            "comments": lambda: "<" + rnd.choice(["div", "section"]) + f" class='{rnd.choice(['comments', 'comment-list', 'replies', 'disqus'])}'>" + "".join(f"<div class='comment'><b>{say(1, 2, '')}</b><p>{text(1, 3)}</p></div>" for _ in range(rnd.randint(1, 5))) + "</div>",
        }[kind]()
        return f"<div data-label=\"0\">{body}</div>" if rnd.random() < 0.1 else re.sub(r"^<(\w+)", r'<\1 data-label="0"', body)

    def article() -> str:
        head = f"<h1>{say(3, 10, rnd.choice(['', '.']))}</h1>"
        out = [rnd.choice([head, head, head, f"<header>{head}</header>", ""])]
        for _ in range(max(1, int(rnd.expovariate(0.15)))):
            roll = rnd.random()
            if roll < 0.7:
                out.append(f"<p>{text()}</p>")
            elif roll < 0.78:
                out.append(f"<p><b>{text()}<br>")
            elif roll < 0.84:
                out.append(f"<p>{say(1, 4)}</p>")
            elif roll < 0.89:
                out.append(f"<h2>{say(1, 6, '')}</h2>")
            elif roll < 0.93:
                out.append("<ul>" + "".join(f"<li>{say(2, 14)}" for _ in range(rnd.randint(2, 6))) + "</ul>")
            elif roll < 0.96:
                out.append(f"<blockquote><p>{text(1, 3)}</p></blockquote>")
            else:
                out.append(f"<table><tr><td>{say(1, 5, '')}<td>{say(1, 5, '')}</table>")
            if rnd.random() < 0.06:
                out.append(noise(rnd.choice(["ad", "notice", "side", "form", "ad"])))
        if rnd.random() < 0.15:
            out.append(noise(rnd.choice(["footer", "comments", "notice"])))
        return "".join(out)

    before = ["nav", "menu", "ad", "header", "notice", "form"]
    after = ["footer", "foot", "aside", "side", "comments", "ad", "notice", "form", "nav"]
    pages = []
    for _ in range(n):
        tag, attrs = rnd.choice([("article", ""), ("article", ""), ("main", ""), ("div", " class='content'"), ("div", " id='post-body'"), ("div", ""), ("section", " class='entry'"), ("article", " class='post'")])
        inner = f"<{tag}{attrs} data-label=\"1\">{article()}</{tag}>"
        if rnd.random() < 0.3:
            inner = f"<div>{inner}</div>"
        top = "".join(noise(k) for k in rnd.sample(before, rnd.randint(0, 4)))
        tail = "".join(noise(k) for k in rnd.sample(after, rnd.randint(0, 4)))
        page = f"<!DOCTYPE html><html><head><title>{say(1, 5, '')}</title><style>p{{}}</style></head><body>{top}{inner}{tail}</body></html>"
        pages.append(page if rnd.random() < 0.93 else page[: int(len(page) * rnd.uniform(0.5, 0.99))])
    return pages


_default: list[TreeModel] = []


def default_model() -> TreeModel:
    """The model of the built-in training pages, trained once in the driver."""
    if not _default:
        _default.append(train(labelled_pages()))
    return _default[0]


def texts(pages: list[str], model: TreeModel, threshold: float = 0.5) -> list[str]:
    trees = [parse(p) for p in pages]
    f = forest(trees)
    p = model.marginals(f) if len(f.parent) else np.zeros(0)
    out = []
    for t, a in zip(trees, f.starts[:-1].tolist(), strict=True):
        out.append("\n".join(s for s, q in zip(t.text, p[a : a + len(t.text)].tolist(), strict=True) if s and q >= threshold))
    return out


def extract(pages: DataFrame, model: TreeModel | None = None, keep: list[str] | None = None, threshold: float = 0.5, at_once: int = 1 << 20) -> DataFrame:
    """``keep`` columns of each row of ``pages`` with text; ``at_once``: characters of html taken together."""
    ship(pages.sparkSession)
    model = model or default_model()
    keep = ["page_id", "url"] if keep is None else keep
    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField("text", T.StringType())])
    k = len(keep)

    def run(batches):
        for batch in batches:
            rows = [h or "" for h in batch.column(k).to_pylist()]
            done: list[str] = []
            while len(done) < len(rows):
                end, size = len(done), 0
                while end < len(rows) and (size == 0 or size + len(rows[end]) <= at_once):
                    size += len(rows[end]) + 1
                    end += 1
                done += texts(rows[len(done) : end], model, threshold)
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(done, pa.string())], [*batch.schema.names[:k], "text"])

    return pages.select(*[F.col(f"`{c}`") for c in keep], F.col("html").alias("_html")).mapInArrow(run, schema)


def op8_html_text(spark, sf_dir: str) -> DataFrame:
    """Whole ``pages``."""
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
