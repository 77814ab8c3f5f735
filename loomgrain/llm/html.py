"""Main text of web pages by a tree-structured graphical model.

A page is parsed into its element tree. Every element is a node with two states, content
or not; what wraps the content counts as content. A node's potential is linear in its features (kind of element, words in class
and id, length, link share and punctuation of its subtree); each parent-child pair has a
2 x 2 potential that depends on the child's kind. Messages go up from the leaves and down
from the root, and give each node's exact marginal. Text belongs to the element that
directly holds it and is kept if that element's content marginal exceeds one half.

The weights maximise the conditional likelihood of labelled pages, by gradients from the
same marginals. The labelled pages are made here from a seeded grammar of page layouts
(menus, headers, footers, sidebars, notices, adverts, forms and reader comments around
and inside an article, with and without telling element names), so training is
repeatable and needs no data.

Text: character references are decoded, white space inside a block becomes one space,
ends are trimmed, and blocks are joined by line feeds; nothing else is cut. Elements that
hold no text for readers (title, script, style, template and the like) are skipped in
parsing, where they are closed; of an unclosed one only the tag is skipped (an unclosed
script or style holds the rest of the page, as in browsers).

Defined cases: null and empty html and pages without content give empty text; unclosed
and stray tags are repaired as browsers do in the common cases (`</>` is nothing, `</`
before another character than a letter is a comment, `<` before one is text, and a tag
that the page's end cuts off is dropped); nesting of any depth is
walked without recursion; repeated rows each get their result; an empty table gives no
rows; other columns pass through, and columns named like the results are replaced.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomgrain.llm.batches import arrow_map, pieces

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>")
_LABELS = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_STOPS = re.compile(r"[.,;:!?]")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
_CODE = frozenset("script style".split())  # never closed, they hold the rest of the page, as in browsers
_SKIP = frozenset("template svg math canvas audio video object select datalist".split())
_SKIP_TAG = re.compile(rf"<(/?)({'|'.join(sorted(_SKIP))})(?=[\s/>])([^>]*)>", re.I)
_NAMED = re.compile("</?[a-zA-Z]")
_WALLS = frozenset("table td th button".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var".split()
)
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3"
    " h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
#: What an opening tag closes first, and the elements beyond which it doesn't look.
_SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
}
_KINDS = [
    ("article", "article main"),
    ("nav", "nav menu"),
    ("header", "header"),
    ("footer", "footer"),
    ("aside", "aside"),
    ("form", "form button fieldset input label legend option output dialog"),
    ("paragraph", "p"),
    ("heading", "h1 h2 h3 h4 h5 h6 hgroup"),
    ("item", "li dt dd"),
    ("list", "ul ol dl dir"),
    ("box", "div section center"),
    ("table", "table tr td th tbody thead tfoot caption"),
    ("link", "a"),
    ("quote", "blockquote pre figure figcaption details summary address"),
    ("root", "html body"),
]
_KIND = {tag: i for i, (_, tags) in enumerate(_KINDS) for tag in tags.split()}
_PLAIN = len(_KINDS)  # inline and unknown elements
_BAD = frozenset(
    "nav navbar navigation menu sidebar side ad ads adv advert adverts advertisement banner sponsor sponsored promo"
    " cookie cookies consent notice alert gdpr popup modal overlay comment comments reply replies respond discussion"
    " disqus footer header masthead breadcrumb breadcrumbs share social subscribe newsletter signup login form search"
    " widget related recommended pagination pager toolbar copyright legal skip toc".split()
)
_GOOD = frozenset("article content post entry story main body text blog prose".split())
ROOT = 5.0
_N_FEATURES = _PLAIN + 1 + 2 + 6 + 5 + 3 + 1


@dataclass
class Page:
    """Elements in the order they open; events are (element, text), or (-1, '') where a block begins or ends."""

    parent: list[int] = field(default_factory=lambda: [-1])
    kind: list[int] = field(default_factory=lambda: [_KIND["body"]])
    bad: list[bool] = field(default_factory=lambda: [False])
    good: list[bool] = field(default_factory=lambda: [False])
    depth: list[int] = field(default_factory=lambda: [0])
    events: list[tuple[int, str]] = field(default_factory=list)


class _Open:
    """The open elements: nodes and names from the page down, with what the rules ask of them at hand."""

    def __init__(self) -> None:
        self.nodes, self.names = [0], [""]
        self.count: Counter[str] = Counter()
        self.paragraphs: list[int] = []
        self.walls: list[int] = []  # beyond these no paragraph is closed

    def push(self, node: int, name: str) -> None:
        if name == "p":
            self.paragraphs.append(len(self.names))
        elif name in _WALLS:
            self.walls.append(len(self.names))
        self.nodes.append(node)
        self.names.append(name)
        self.count[name] += 1

    def close(self, to: int) -> None:
        self.count.subtract(self.names[to:])
        del self.nodes[to:], self.names[to:]
        for held in (self.paragraphs, self.walls):
            while held and held[-1] >= to:
                held.pop()

    def end(self, name: str, block: bool) -> None:
        """An end tag: closes the last open element of its name; an inline one doesn't close blocks."""
        if self.count[name]:
            for i in range(len(self.names) - 1, 0, -1):
                if self.names[i] == name:
                    return self.close(i)
                if not block and self.names[i] not in _INLINE:
                    return None
        return None

    def before(self, name: str) -> None:
        """What the opening tag of a block closes first."""
        if name in _CLOSES_P and self.paragraphs and (not self.walls or self.walls[-1] < self.paragraphs[-1]):
            self.close(self.paragraphs[-1])
        mine, beyond = _SIBLINGS.get(name, ((), ()))
        if any(self.count[x] for x in mine):
            for i in range(len(self.names) - 1, 0, -1):
                if self.names[i] in beyond:
                    break
                if self.names[i] in mine:
                    self.close(i)
                    if name in ("dt", "dd", "li"):
                        break


def _skipped(html: str) -> dict[int, int]:
    """For each element of _SKIP that is closed: where its tag begins, and where its end tag ends. An unclosed one is not there."""
    found, open_ = {}, {}
    for m in _SKIP_TAG.finditer(html):
        name, held = m[2].lower(), open_.setdefault(m[2].lower(), [])
        if not m[1]:
            if not m[3].endswith("/"):
                held.append(m.start())
        elif held:
            found[held.pop()] = m.end()
    return found


def parse(html: str) -> Page:
    """The element tree of a page; its first node stands for the page."""
    page, open_ = Page(), _Open()
    at, size = 0, len(html)
    ends = _skipped(html)
    closers: dict[str, list[int]] = {}
    while at < size:
        lt = html.find("<", at)
        lt = size if lt < 0 else lt
        if lt > at:
            page.events.append((open_.nodes[-1], unescape(html[at:lt])))
        if lt == size:
            break
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = end + 3 if end >= 0 else size
            continue
        m = _TAG.match(html, lt)
        if m is None:
            if html.startswith("</>", lt):
                at = lt + 3
            elif _NAMED.match(html, lt):
                break  # a tag that the page's end cuts off
            elif html.startswith(("<!", "<?", "</"), lt):  # a comment of its own kind
                end = html.find(">", lt)
                at = end + 1 if end >= 0 else size
            else:
                page.events.append((open_.nodes[-1], "<"))
                at = lt + 1
            continue
        at = m.end()
        name, closing = m[2].lower(), bool(m[1])
        if name in _SKIP:
            at = ends.get(lt, at)  # never closed: only the tag
            continue
        if name in _RAW and not closing:
            if name not in closers:
                closers[name] = [x.start() for x in re.finditer(f"</{name}(?=[\\s/>])", html, re.I)]
            i = bisect_left(closers[name], at)
            if i < len(closers[name]):
                end = html.find(">", closers[name][i])
                at = end + 1 if end >= 0 else size
            elif name in _CODE:
                break
            continue
        if name == "br":
            page.events.append((open_.nodes[-1], " "))
            continue
        block = name not in _INLINE
        if block:
            page.events.append((-1, ""))
        if closing:
            open_.end(name, block)
            continue
        open_.before(name)
        if name in ("html", "head", "body"):
            continue
        bad, good = name == "noscript", False  # a notice to readers without scripts, most often
        if m[3]:
            for x in _LABELS.findall(m[3]):
                found = _WORDS.findall(_CAMEL.sub(" ", x).lower())
                bad = bad or not _BAD.isdisjoint(found)
                good = good or not _GOOD.isdisjoint(found)
        page.parent.append(open_.nodes[-1])
        page.kind.append(_KIND.get(name, _PLAIN))
        page.bad.append(bad)
        page.good.append(good)
        page.depth.append(len(open_.nodes))
        if name not in _VOID and not m[3].endswith("/"):
            open_.push(len(page.parent) - 1, name)
    return page


@dataclass
class Forest:
    """Pages' nodes one after another: parents (-1 for roots), depth, features, and the kind of the edge to the parent."""

    parent: np.ndarray
    levels: list[np.ndarray]
    x: np.ndarray
    edge: np.ndarray
    first: np.ndarray


def forest(pages: list[Page]) -> Forest:
    sizes = np.array([len(p.parent) for p in pages])
    first = np.concatenate([[0], np.cumsum(sizes)])
    parent = np.concatenate([np.array(p.parent) + (np.array(p.parent) >= 0) * f for p, f in zip(pages, first)])
    cat = lambda name: np.concatenate([np.array(getattr(p, name)) for p in pages])
    kind, bad, good, depth = cat("kind"), cat("bad").astype(bool), cat("good").astype(bool), cat("depth")
    n = len(parent)
    chars, stops = np.zeros(n), np.zeros(n)
    for p, f in zip(pages, first[:-1].tolist()):
        for node, text in p.events:
            if node >= 0:
                size = len(text.strip())
                if size:
                    chars[f + node] += size
                    stops[f + node] += len(_STOPS.findall(text))
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
    link = np.where(kind == _KIND["a"], chars, 0.0)
    own = chars.copy()
    inside = kind == _KIND["a"]
    for level in levels[1:]:
        inside[level] |= inside[parent[level]]
    link = np.where(inside, chars, 0.0)
    for level in reversed(levels[1:]):
        for total in (chars, stops, link):
            np.add.at(total, parent[level], total[level])
    share = link / np.maximum(chars, 1)
    x = np.zeros((n, _N_FEATURES))
    x[np.arange(n), kind] = 1
    at = _PLAIN + 1
    x[:, at], x[:, at + 1] = bad, good
    x[np.arange(n), at + 2 + np.digitize(chars, [1, 25, 80, 200, 600])] = 1
    x[np.arange(n), at + 8 + np.digitize(share, [0.01, 0.2, 0.5, 0.9])] = 1
    x[np.arange(n), at + 13 + np.digitize(stops / np.maximum(chars, 1), [0.005, 0.02])] = 1
    x[:, at + 16] = own > 0
    # Edge kinds: named as no content, named as content, a landmark, inline, a plain block.
    landmark = np.isin(kind, [_KIND[t] for t in ("article", "nav", "header", "footer", "aside", "form")])
    edge = np.select([bad, landmark & (kind != _KIND["article"]), kind == _KIND["article"], good, (kind == _PLAIN) | (kind == _KIND["a"])], [0, 1, 2, 3, 4], 5)
    return Forest(parent, levels, x, edge, first)


_EDGES = 6


def marginals(f: Forest, node: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact marginals by messages up and down. node: features x 1 weights of content; edge: kinds x 2 x 2 (parent, child).

    Gives P(content) of each node, and P(parent state, child state) of each edge.
    """
    n = len(f.parent)
    belief = np.zeros((n, 2))
    belief[:, 1] = f.x @ node
    belief[f.levels[0], 1] += ROOT  # the page as a whole wraps its content
    up = np.zeros((n, 2))
    for level in reversed(f.levels[1:]):
        joint = edge[f.edge[level]] + belief[level][:, None, :]
        up[level] = np.logaddexp(joint[:, :, 0], joint[:, :, 1])
        np.add.at(belief, f.parent[level], up[level])
    pair = np.zeros((n, 2, 2))
    for level in f.levels[1:]:
        rest = belief[f.parent[level]] - up[level]  # all that the parent knows but for this child
        joint = rest[:, :, None] + edge[f.edge[level]] + belief[level][:, None, :]
        total = np.logaddexp.reduce(joint.reshape(len(level), 4), axis=1)
        pair[level] = np.exp(joint - total[:, None, None])
        belief[level] += np.logaddexp(rest[:, 0, None] + edge[f.edge[level]][:, 0], rest[:, 1, None] + edge[f.edge[level]][:, 1])
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), pair


def fit(f: Forest, y: np.ndarray, steps: int = 250, rate: float = 0.15, decay: float = 0.0003) -> tuple[np.ndarray, np.ndarray]:
    """Weights that maximise the conditional likelihood of labels y (0 or 1 for each node), by Adam."""
    node, edge = np.zeros(f.x.shape[1]), np.zeros((_EDGES, 2, 2))
    child = np.flatnonzero(f.parent >= 0)
    seen = np.zeros_like(edge)
    np.add.at(seen, (f.edge[child], y[f.parent[child]], y[child]), 1.0)
    moments = [np.zeros_like(w) for w in (node, edge, node, edge)]
    for step in range(1, steps + 1):
        p, pair = marginals(f, node, edge)
        expected = np.zeros_like(edge)
        np.add.at(expected, f.edge[child], pair[child])
        slopes = (f.x.T @ (y - p)) / len(y) - decay * node, (seen - expected) / len(y) - decay * edge
        for i, (w, g) in enumerate(zip((node, edge), slopes, strict=True)):
            moments[i] = 0.9 * moments[i] + 0.1 * g
            moments[i + 2] = 0.99 * moments[i + 2] + 0.01 * g * g
            w += rate * (moments[i] / (1 - 0.9**step)) / (np.sqrt(moments[i + 2] / (1 - 0.99**step)) + 1e-8)
    return node, edge


class _Grammar:
    """Random labelled pages: a node is (tag, attributes, content or not, children); a child may be text."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int, stop: bool = True) -> str:
        r = self.r
        out = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 9))) for _ in range(r.randint(low, high))]
        for i in range(len(out)):
            if stop and r.random() < 0.12:
                out[i] += r.choice(",.;")
        return " ".join(out).capitalize() + ("." if stop else "")

    def paragraph(self, y: int, low: int = 4, high: int = 90) -> tuple:
        kids: list = [self.words(low, high)]
        if self.r.random() < 0.25:
            tag = self.r.choice(["b", "i", "em", "a", "span", "strong", "code"])
            kids += [(tag, "href='/x'" if tag == "a" else "", y, [self.words(1, 5, False)]), " " + self.words(2, 20)]
        return ("p", "", y, kids)

    def links(self, tag: str, attrs: str) -> tuple:
        items = [("li", "", 0, [("a", "href='/y'", 0, [self.words(1, 3, False)])]) for _ in range(self.r.randint(2, 8))]
        return (tag, attrs, 0, [("ul", "", 0, items)])

    def named(self, *names: str) -> str:
        return f"{self.r.choice(['class', 'class', 'id'])}=\"{self.r.choice(names)}{self.r.choice(['', '', '-box', '_1', ' wide'])}\""

    def junk(self) -> tuple:
        r = self.r
        box = r.choice(["div", "div", "section", "aside"])
        some = lambda low, high: [self.paragraph(0, low, high) for _ in range(r.randint(1, 3))]
        plain = lambda: [self.words(2, 40)]
        return r.choice(
            [
                lambda: self.links("nav", r.choice(["", self.named("menu", "nav")])),
                lambda: self.links("div", self.named("menu", "navbar", "breadcrumbs", "sidebar", "related")),
                lambda: ("header", "", 0, [r.choice([("h1", "", 0, [self.words(1, 4, False)]), self.links("nav", "")])]),
                lambda: ("footer", "", 0, r.choice([plain(), some(3, 30)])),
                lambda: ("aside", r.choice(["", self.named("sidebar")]), 0, r.choice([plain(), some(3, 50)])),
                lambda: (box, self.named("ad", "ads", "advert", "banner", "sponsored", "promo"), 0, r.choice([plain(), some(2, 50)])),
                lambda: (box, self.named("cookie-notice", "notice", "consent", "alert", "popup"), 0, r.choice([plain(), some(4, 40)])),
                lambda: ("form", "", 0, [("label", "", 0, [self.words(1, 4, False)]), ("p", "", 0, plain()), ("button", "", 0, ["Send"])]),
                lambda: (box, self.named("newsletter", "subscribe", "share", "social", "widget"), 0, plain()),
                self.comments,
            ]
        )()

    def comments(self) -> tuple:
        r = self.r
        each = [
            (r.choice(["div", "li", "article", "p"]), r.choice(["", self.named("comment", "reply")]), 0, r.choice([[self.words(3, 60)], [self.paragraph(0, 3, 60)]]))
            for _ in range(r.randint(1, 5))
        ]
        return (r.choice(["section", "div", "ul"]), self.named("comments", "discussion", "replies"), 0, [("h3", "", 0, [self.words(1, 2, False)]), *each])

    def article(self) -> tuple:
        r = self.r
        kids: list = [("h1", "", 1, [self.words(2, 12, False)])] if r.random() < 0.85 else []
        if r.random() < 0.2:  # a very short one
            kids += [("p", "", 1, [self.words(1, 6, r.random() < 0.5)]) for _ in range(r.randint(1, 2))]
        for _ in range(0 if len(kids) > 1 and r.random() < 0.7 else r.randint(1, 9)):
            kids.append(
                r.choice(
                    [self.paragraph] * 6
                    + [lambda y: ("p", "", y, [self.words(1, 12, r.random() < 0.5)])]
                    + [
                        lambda y: ("h2", "", y, [self.words(1, 8, False)]),
                        lambda y: (r.choice(["ul", "ol"]), "", y, [("li", "", y, [self.words(2, 25)]) for _ in range(r.randint(1, 5))]),
                        lambda y: ("blockquote", "", y, r.choice([[self.words(4, 40)], [self.paragraph(y)]])),
                        lambda y: ("pre", "", y, [self.words(2, 30, False)]),
                        lambda y: ("table", "", y, [("tr", "", y, [("td", "", y, [self.words(1, 6, False)]) for _ in range(3)]) for _ in range(2)]),
                        lambda y: ("figure", "", y, [("figcaption", "", y, [self.words(2, 12)])]),
                        lambda y: ("div", "", y, [self.paragraph(y) for _ in range(r.randint(1, 3))]),
                    ]
                )(1)
            )
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            kids.insert(r.randint(0, len(kids)), self.junk())
        tag, attrs = r.choice(
            [("article", ""), ("article", ""), ("article", self.named("post", "entry")), ("main", ""), ("div", self.named("content", "post", "article-body", "story", "main")), ("section", self.named("entry", "content")), ("div", "")]
        )
        return (tag, attrs, 1, kids)

    def page(self) -> tuple:
        r = self.r
        kids = [*(self.junk() for _ in range(r.randint(0, 4))), self.article(), *(self.junk() for _ in range(r.randint(0, 4)))]
        if r.random() < 0.3:
            kids = [("div", r.choice(["", "id='wrap'", "class='container'"]), 1, kids)]
        return ("body", "", 1, kids)


def render(node: tuple | str, labels: list[int]) -> str:
    """HTML of a labelled tree; labels gets one entry for each element as it opens."""
    if isinstance(node, str):
        return node
    tag, attrs, y, kids = node
    labels.append(y)
    return f"<{tag}{' ' + attrs if attrs else ''}>" + "".join(render(k, labels) for k in kids) + f"</{tag}>"


def labelled(count: int, seed: int) -> tuple[Forest, np.ndarray]:
    grammar, pages, y = _Grammar(seed), [], []
    for _ in range(count):
        labels: list[int] = []
        page = parse(render(grammar.page(), labels))
        if len(page.parent) == len(labels):  # the parser repairs some random nestings; their labels no longer fit
            pages.append(page)
            y += labels
    return forest(pages), np.array(y)


@lru_cache(maxsize=1)
def trained(count: int = 250, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    return fit(*labelled(count, seed))


def texts_of(htmls: list[str], node: np.ndarray, edge: np.ndarray) -> list[str]:
    pages = [parse(h) for h in htmls]
    if not pages:
        return []
    f = forest(pages)
    p, _ = marginals(f, node, edge)
    out = []
    for page, first in zip(pages, f.first[:-1].tolist()):
        keep = (p[first : first + len(page.parent)] > 0.5).tolist()
        blocks, now = [], []
        for element, text in [*page.events, (-1, "")]:
            if element < 0:
                if now:
                    blocks.append(" ".join("".join(now).split()))
                    now = []
            elif keep[element]:
                now.append(text)
        out.append("\n".join(b for b in blocks if b))
    return out


def extract(rows: DataFrame, html: str = "html", weights: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """rows with text and n_chars."""
    rows = rows.drop(*({"text", "n_chars"} - {html}))
    held = rows.sparkSession.sparkContext.broadcast(weights or trained())
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + ["text string, n_chars long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, html):
                found = texts_of([x or "" for x in piece.column(html).to_pylist()], *held.value)
                arrays = [pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([*piece.columns, *arrays], [*piece.schema.names, "text", "n_chars"])

    return arrow_map(rows, run, schema)
