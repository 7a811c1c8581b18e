"""HTML extraction: boosted trees score DOM nodes, a tree decoding picks the article's text.

The parser is tolerant: open paragraphs and list items close by themselves, stray end tags are
ignored, cut pages end everything; its work grows with the page alone, however deep elements nest. Each
node gets features of its subtree (text and link density), its attribute tokens (hashed), depth, siblings,
and its place beside the node with the most prose. A node is then *in*, *out* or *mixed*; below an *out*
node all is out, below an *in* node nothing is mixed, so no choice contradicts one above it.
"""

from __future__ import annotations

import bisect
import html as entities
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ampliframe.llm.common import map_rows

#: Bound of the training sample: so many pages at most, chosen by a hash of their id.
MAX_TRAINING_PAGES = 300
TREES, DEPTH, BINS, RATE, L2 = 60, 4, 32, 0.2, 1.0

# Element names by role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea xmp iframe noembed noframes".split())
SILENT = RAW | set("head noscript template select option datalist button object canvas svg math audio video map".split())
BLOCK = set("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption "
            "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary "
            "table caption tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - set("html body dd dt li caption tbody td tfoot th thead tr".split()) | {"dl", "li", "dd", "dt"}
P_LIMIT = set("html body table td th caption button object template".split())
#: A start tag closes these open ones, up to the nearest of the second set.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "body": ({"head"}, {"html"}),
}
CONTENT_TAGS = {"article", "main"}
PARAGRAPH_TAGS = set("p pre blockquote h1 h2 h3 h4 h5 h6 figcaption dd dt".split())
FRAME_TAGS = {"nav", "header", "footer", "aside", "menu", "dialog", "search"}
FORM_TAGS = {"form", "fieldset"}
CONTROLS = {"input", "select", "textarea", "button", "label"}
#: Odds that an element inside the article must lose by to be left out, and that a piece of the article
#: must win by where its surroundings are mixed.
SWITCH, ENTER = 1.5, 0.5
#: Buckets of hashed attribute tokens, of a node and of all above it.
TOKENS = 32

_MARK, _FRAME = "data-own-part", "data-own-frame"  # set in training pages only: the article, an added frame

_tag = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/](?![a-zA-Z])[^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)"""
                  r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
_attribute = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_split_word = re.compile(r"[a-z]+")
_hump = re.compile(r"(?<=[a-z])(?=[A-Z])")
_stops = re.compile(r"[.,;:!?]")


@dataclass
class Page:
    """Nodes in page order (a parent before its children) and the text segments under them."""
    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    tokens: list[int] = field(default_factory=list)  # a bit per bucket
    hidden: list[int] = field(default_factory=list)
    marked: list[int] = field(default_factory=list)  # for training only: 1 the article, 2 a frame
    tags_below: list[int] = field(default_factory=list)
    controls: list[int] = field(default_factory=list)
    segments: list[tuple[int, int, bool, str]] = field(default_factory=list)  # node, block, in a link, text


_PLAIN = (0, 0, 0)


def _attributes(source: str) -> tuple[int, int, int]:
    """Buckets of the tokens in class, id, role and the like, whether the element is hidden, and what
    training marked it as."""
    tokens = hidden = marked = 0
    for name, a, b, c in _attribute.findall(source):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role", "itemprop", "aria-label", "data-role", "data-component"):
            for word in _split_word.findall(_hump.sub(" ", value).lower()):
                tokens |= 1 << zlib.crc32(word.encode()) % TOKENS
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(
                r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = 1
        elif name in (_MARK, _FRAME):
            marked = 1 if name == _MARK else 2
    return tokens, hidden, marked


class _Open:
    """The open elements, with the places of each tag and of blocks, so that no tag walks through them all."""

    def __init__(self):
        self.stack: list[tuple[str, int, bool]] = [("#root", 0, False)]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, tag: str, node: int, silent: bool) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, node, silent))

    def cut(self, at: int) -> bool:
        """Close all from ``at`` on; whether a block was among them."""
        blocked = bool(self.blocks) and self.blocks[-1] >= at
        while len(self.stack) > at:
            tag = self.stack.pop()[0]
            self.places[tag].pop()
        while self.blocks and self.blocks[-1] >= at:
            self.blocks.pop()
        return blocked

    def last(self, tags: set[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def outermost(self, wanted: set[str], limit: set[str]) -> int | None:
        """The first open element of ``wanted`` behind the last one of ``limit``."""
        found = [self.places[t] for t in wanted if self.places.get(t)]
        if not found:
            return None
        least = self.last(limit)
        return min((p[bisect.bisect(p, least)] for p in found if p[-1] > least), default=None)


def parse(source: str) -> Page:
    page, opened, block = Page(), _Open(), 0
    stack = opened.stack

    def node(tag: str, parent: int, attributes: tuple[int, int, int]) -> int:
        for column, value in zip((page.tag, page.parent, page.tokens, page.hidden, page.marked, page.tags_below, page.controls),
                                 (tag, parent, *attributes, 0, 0)):
            column.append(value)
        return len(page.tag) - 1

    def close(at: int | None) -> None:
        nonlocal block
        if at is not None:
            block += opened.cut(at)

    def text(raw: str) -> None:
        tag, at, silent = stack[-1]
        if not silent and raw:
            raw = entities.unescape(raw) if "&" in raw else raw
            page.segments.append((at, block, any(t == "a" for t, _, _ in stack[-4:]), raw))

    node("#root", -1, _PLAIN)
    at = 0
    while at < len(source):
        found = _tag.search(source, at)
        if not found:
            text(source[at:])
            break
        text(source[at:found.start()])
        at = found.end()
        name = found[2] or found[5]
        if not name:
            if found[0].startswith("<![CDATA["):
                text(found[0][9:].removesuffix("]]>"))
            continue
        tag, ending = name.lower(), found[1] or found[4]
        if ending:
            own = opened.places.get(tag)
            # An inline end tag does not reach through a block.
            if own and (tag in BLOCK or not opened.blocks or own[-1] > opened.blocks[-1]):
                close(own[-1])
            continue
        if tag in CLOSES_P:
            close(opened.outermost({"p"}, P_LIMIT))
        if tag in IMPLIED:
            close(opened.outermost(*IMPLIED[tag]))
        _, parent, silent = stack[-1]
        page.tags_below[parent] += 1
        page.controls[parent] += tag in CONTROLS
        attributes = _attributes(found[3] or found[6]) if found[3] or found[6] else _PLAIN
        if tag in BLOCK:
            block += 1
        if tag in VOID:
            if tag == "br" and not silent:
                page.segments.append((parent, block, False, " "))
            continue
        own = node(tag, parent, attributes) if tag in BLOCK or any(attributes) else parent
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*[^>]*>", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        if not (found[3] or found[6] or "").rstrip().endswith("/") or tag in BLOCK:
            opened.push(tag, own, silent or tag in SILENT)
    return page


def measure(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """Features of each node, and the length of the text directly under it."""
    n = len(page.tag)
    own, link, stops = np.zeros(n), np.zeros(n), np.zeros(n)
    start, seen = np.full(n, -1.0), 0.0
    for at, _, linked, text in page.segments:
        size = len(text) if not text.isspace() else 0
        if start[at] < 0:
            start[at] = seen
        own[at] += size
        stops[at] += len(_stops.findall(text))
        if linked:
            link[at] += size
        seen += size
    parent, t = page.parent, page.tag
    depth, same, index, siblings = [0] * n, [1] * n, [0] * n, [1] * n
    above, above_frame, above_main, above_hidden = [0] * n, [0] * n, [0] * n, [0] * n
    per_parent: dict[int, list[int]] = {}
    for i in range(1, n):
        p = parent[i]
        depth[i] = depth[p] + 1
        above[i] = above[p] | page.tokens[p]
        above_frame[i] = above_frame[p] + (t[p] in FRAME_TAGS or t[p] in FORM_TAGS)
        above_main[i] = above_main[p] + (t[p] in CONTENT_TAGS)
        above_hidden[i] = above_hidden[p] + page.hidden[p]
        per_parent.setdefault(p, []).append(i)
    for children in per_parent.values():
        tags: dict[str, int] = {}
        for c in children:
            tags[t[c]] = tags.get(t[c], 0) + 1
        for k, c in enumerate(children):
            index[c], siblings[c], same[c] = k, len(children), tags[t[c]]
    total, linked, marks = own.copy(), link.copy(), stops.copy()
    tags, controls, widest = np.array(page.tags_below, float), np.array(page.controls, float), own.copy()
    # Text of paragraphs directly under a node: the densest node is the heaviest by this.
    prose, direct = np.zeros(n), np.zeros(n)
    paragraphs = np.array([float(x in PARAGRAPH_TAGS) for x in t])
    framed = [f or x in FRAME_TAGS or x in FORM_TAGS or h for f, x, h in zip(above_frame, t, page.hidden)]
    for i in range(n - 1, 0, -1):
        p = parent[i]
        if t[i] in PARAGRAPH_TAGS and not framed[i]:
            direct[p] += max(0.0, total[i] - 2 * linked[i])
        total[p] += total[i]
        linked[p] += linked[i]
        marks[p] += marks[i]
        tags[p] += tags[i]
        controls[p] += controls[i]
        paragraphs[p] += paragraphs[i]
        widest[p] = max(widest[p], widest[i])
        if start[i] >= 0 and (start[p] < 0 or start[i] < start[p]):
            start[p] = start[i]
    heaviest = int(direct.argmax())
    inside, holds, behind, last = np.zeros(n), np.zeros(n), np.zeros(n), heaviest
    inside[heaviest] = 1
    for i in range(heaviest + 1, n):
        if inside[parent[i]]:
            inside[i], last = 1, i
    at = parent[heaviest]
    while at >= 0:
        holds[at], at = 1, parent[at]
    behind[last + 1:] = 1
    size, size_above = np.maximum(total, 1), np.maximum(total[np.maximum(parent, 0)], 1)
    largest = np.zeros(n)
    for p, children in per_parent.items():
        sizes = np.sort(total[children])
        top, second = sizes[-1], sizes[-2] if len(children) > 1 else 0.0
        for c in children:
            largest[c] = total[c] / max(second if total[c] == top else top, 1)
    has_main = any(x in CONTENT_TAGS for x in t)
    outside = [float(has_main and not m and x not in CONTENT_TAGS) for m, x in zip(above_main, t)]
    bits = np.arange(TOKENS)
    columns = [
        np.array(depth), np.log1p(total), linked / size, np.log1p(tags), total / (tags + 1), np.array(index) / np.array(siblings),
        np.log1p(siblings), np.array(same) / np.array(siblings), np.log1p(own), marks / size, np.maximum(start, 0) / max(seen, 1),
        total / max(seen, 1), np.log1p(widest), controls, np.log1p(paragraphs), total / (paragraphs + 1), total / size_above,
        np.log1p(largest), np.log1p(direct), inside, holds, behind, total / max(total[heaviest], 1),
        np.array([x in CONTENT_TAGS for x in t]), np.array([x in PARAGRAPH_TAGS for x in t]), np.array([x in FRAME_TAGS for x in t]),
        np.array([x in FORM_TAGS for x in t]), np.array([x in ("ul", "ol", "li", "dl", "menu") for x in t]),
        np.array([x in ("div", "section", "span") for x in t]), np.array([x in ("table", "tr", "td", "th", "tbody") for x in t]),
        np.array(page.hidden), np.array(above_hidden), np.array(above_frame), np.array(above_main), np.full(n, float(has_main)), np.array(outside),
        np.array([x in ("#root", "html", "body") for x in t])]
    buckets = [(np.array(words, np.int64)[:, None] >> bits) & 1 for words in (page.tokens, above)]
    return np.concatenate([np.column_stack(columns), *buckets], axis=1).astype(np.float32), own


class Trees:
    """Gradient-boosted trees of fixed depth on binned features, logistic loss."""

    def __init__(self):
        self.cuts: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)]).astype(np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(x.shape[1])]
        binned, features = self._bins(x), x.shape[1]
        flat = binned + np.arange(features) * BINS
        rate = np.clip(y.mean(), 0.01, 0.99)
        self.start = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            slope, bend = p - y, p * (1 - p)
            leaf = np.zeros(len(y), np.int64)
            split_on, split_at = np.zeros(2 ** DEPTH - 1, np.int64), np.full(2 ** DEPTH - 1, BINS, np.int64)
            for level in range(DEPTH):
                width = 2 ** level
                place = ((leaf * features)[:, None] * BINS + flat).ravel()
                g, h = (np.bincount(place, np.repeat(v, features), width * features * BINS).reshape(width, features, BINS) for v in (slope, bend))
                gl, hl = np.cumsum(g, 2), np.cumsum(h, 2)
                ga, ha = gl[:, :, -1:], hl[:, :, -1:]
                found = gl ** 2 / (hl + L2) + (ga - gl) ** 2 / (ha - hl + L2) - ga ** 2 / (ha + L2)
                gain = np.where((hl > 1) & (ha - hl > 1), found, -np.inf)
                best = gain.reshape(width, -1).argmax(axis=1)
                worth = gain.reshape(width, -1).max(axis=1) > 1e-6
                at = width - 1 + np.arange(width)
                split_on[at], split_at[at] = best // BINS, np.where(worth, best % BINS, BINS)
                leaf = 2 * leaf + (binned[np.arange(len(y)), split_on[at][leaf]] > split_at[at][leaf])
            value = -np.bincount(leaf, slope, 2 ** DEPTH) / (np.bincount(leaf, bend, 2 ** DEPTH) + L2) * RATE
            self.trees.append((split_on, split_at, value))
            score += value[leaf]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row; without trees the start score."""
        if not self.trees:
            return np.full(len(x), self.start)
        binned, rows = self._bins(x), np.arange(len(x))
        score = np.full(len(x), self.start)
        for split_on, split_at, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (binned[rows, split_on[node]] > split_at[node])
            score += value[node - (2 ** DEPTH - 1)]
        return score


def decode(page: Page, odds: np.ndarray, own: np.ndarray) -> list[bool]:
    """The best consistent choice: whether the text directly under each node is in."""
    odds = np.clip(odds, -6, 6)
    by_text = (odds * own / 100).tolist()
    whole = (odds + odds * own / 100).tolist()
    n = len(odds)
    inside, outside, mixed = whole[:], [-w for w in whole], [-t for t in by_text]
    for i in range(n - 1, 0, -1):  # children come behind their parents
        p = page.parent[i]
        inside[p] += max(inside[i], outside[i] - SWITCH)
        outside[p] += outside[i]
        mixed[p] += max(mixed[i], inside[i] - ENTER, outside[i])
    state = [""] * n
    for i in range(n):
        above = state[page.parent[i]] if i else "mixed"
        if above == "outside":
            state[i] = "outside"
        elif above == "inside":
            state[i] = "inside" if inside[i] >= outside[i] - SWITCH else "outside"
        else:
            enter = ENTER if i else 0.0
            state[i] = max(("inside", inside[i] - enter), ("outside", outside[i]), ("mixed", mixed[i]), key=lambda x: x[1])[0]
    return [s == "inside" for s in state]


def blocks(page: Page, wanted: list[bool]) -> str:
    """The wanted text: white space inside a block as one space, blocks joined by line feeds."""
    out, current, parts = [], None, []
    for at, block, _, text in page.segments:
        if block != current:
            out.append(parts)
            current, parts = block, []
        if wanted[at]:
            parts.append(text)
    out.append(parts)
    lines = (" ".join("".join(p).split()) for p in out)
    return "\n".join(line for line in lines if line)


# --------------------------------------------------------------------------- training

_CONTENT = ("article", "main", "div", "section", "div")  # elements that can hold the article
_CONTENT_NAMES = ("post-content", "entry", "content", "story body", "main text", "article-body")
# Frame parts: how often each may stand in a page is left to chance, its names are drawn.
_EXTRAS = ('<header@><p>%s</p></header>', '<aside@><h3>%s</h3><p>%s</p></aside>', '<div@><p>%s</p><ul><li><a href="/">%s</a></li></ul></div>',
           '<aside@><p>%s</p><p>%s</p></aside>', '<div@><p>%s</p><button>OK</button></div>', '<div role="alert"@>%s</div>',
           '<form action="/s"@><label>%s</label><input name="q"><p>%s</p></form>', '<div@><p>%s</p></div>', '<div@>%s</div>', '<p@>%s</p>',
           '<section@><h2>%s</h2><div@><p>%s</p><p>%s</p></div></section>', '<div@><ol><li@><p>%s</p></li><li><p>%s</p></li></ol></div>',
           '<div@><div@><p>%s</p></div><div@><p>%s</p></div><div@><p>%s</p></div></div>', '<div@><a href="/">%s</a><a href="/">%s</a></div>',
           '<nav@><a href="/">%s</a></nav>', '<footer@><p>%s</p><p>%s</p></footer>', '<div@><h4>%s</h4><p>%s</p></div>', '<section@><p>%s</p></section>')
_EXTRA_NAMES = ("site-header", "sidebar", "cookie-notice", "advert", "comments", "comment", "related", "newsletter", "promo", "breadcrumb", "footer",
                "share", "notice", "menu", "topbar", "copyright")
# What may also stand in an article, and frame parts inside one that their elements give away.
_INSIDE = ('<ul><li>%s</li><li>%s</li></ul>', '<table><tr><td>%s</td><td>%s</td></tr><tr><td>%s</td></tr></table>',
           '<blockquote><p>%s</p></blockquote>', '<h2>%s</h2><p>%s</p>', '<ol><li><p>%s</p></li><li>%s</li></ol>',
           '<figure><img src="a"><figcaption>%s</figcaption></figure>', '<pre>%s</pre>', '<div@><p>%s</p><p>%s</p></div>', '<div@>%s</div>',
           '<p>See <a href="/">%s</a> and %s</p>', '<dl><dt>%s</dt><dd>%s</dd></dl>', '<section@><h3>%s</h3><p>%s</p><p>%s</p></section>')
_INSIDE_FRAMES = ('<footer@><p>%s</p></footer>', '<aside@><p>%s</p></aside>', '<nav@><a href="/">%s</a></nav>', '<form@><p>%s</p><input></form>')


class _Variants:
    """A training page marked up in other ways: elements and their names are drawn, so that density, links and
    place must tell the article from what is added around it. Half of the names are usual ones."""

    def __init__(self, source: str, number: int):
        self.source, self.draw = source, np.random.default_rng(number)
        self.words = re.sub(r"<[^>]*>", " ", source).replace("<", " ").split() or ["text"]

    def name(self, usual: tuple[str, ...]) -> str:
        if self.draw.random() < 0.3:
            return ""
        if self.draw.random() < 0.4:
            value = usual[self.draw.integers(len(usual))]
        else:
            syllables = ("ka", "lo", "mer", "zon", "vi", "tra", "bel", "qu", "ost", "nim", "du", "fex")
            value = "-".join("".join(syllables[i] for i in self.draw.integers(0, len(syllables), self.draw.integers(1, 4)))
                             for _ in range(self.draw.integers(1, 3)))
        return f' {("class", "id")[self.draw.integers(2)]}="{value}"'

    def some_words(self, least: int, most: int) -> str:
        begin = int(self.draw.integers(len(self.words)))
        return " ".join(self.words[begin:begin + int(self.draw.integers(least, most))]) or self.words[0]

    def filled(self, pattern: str, frame: bool) -> str:
        mark = f' {_FRAME}="1"' if frame else ""
        out = re.sub("@", lambda m: self.name(_EXTRA_NAMES if frame else _CONTENT_NAMES) + mark, pattern)
        most = int(self.draw.choice([8, 20, 60]))
        return re.sub("%s", lambda m: self.some_words(2, most).replace("\\", " "), out)

    def page(self) -> str:
        draw, page = self.draw, self.source
        if draw.random() < 0.15:  # a very short article
            short = f"<h1>{self.words[0]}</h1><p>{self.some_words(1, 10)}</p>"
            page = re.sub(r"(<article\b[^>]*>).*?(</article>)", lambda m: m[1] + short + m[2], page, flags=re.S | re.I)
        more = "".join(self.filled(_INSIDE[draw.integers(len(_INSIDE))], False) for _ in range(draw.integers(0, 3)))
        if draw.random() < 0.3:
            more += self.filled(_INSIDE_FRAMES[draw.integers(len(_INSIDE_FRAMES))], True)
        page = re.sub(r"</article>", lambda m: more + "</article>", page, flags=re.I)
        tag = _CONTENT[draw.integers(len(_CONTENT))]
        before, behind, top, end = ("".join(self.filled(_EXTRAS[draw.integers(len(_EXTRAS))], True) for _ in range(draw.integers(0, 3))) for _ in range(4))
        opening = f"<{tag}{self.name(_CONTENT_NAMES)} {_MARK}=\"1\">"
        wrap = draw.random() < 0.4  # the article and some of its neighbours in one more element
        page = re.sub(r"<article\b[^>]*>", lambda m: (f"<div{self.name(_CONTENT_NAMES)}>" if wrap else "") + before + opening, page, flags=re.I)
        page = re.sub(r"</article>", lambda m: f"</{tag}>" + behind + ("</div>" if wrap else ""), page, flags=re.I)
        for old in ("nav", "footer"):
            if draw.random() < 0.4:
                page = re.sub(rf"<{old}\b", f'<div{self.name(_EXTRA_NAMES)} {_FRAME}="1"', page, flags=re.I)
                page = re.sub(rf"</{old}>", "</div>", page, flags=re.I)
        page = re.sub(r"(<body[^>]*>)", lambda m: m[1] + top, page, count=1)
        return page.replace("</body>", end + "</body>", 1)


#: Variants of each training page, and of all pages together, at least.
VARIANTS, ALL_VARIANTS = 4, 300


def _variants(source: str, number: int, n: int) -> list[str]:
    """The page as it is and marked up otherwise; the article's element and added frames carry marks
    that no feature sees."""
    make = _Variants(source, number)
    own = re.sub(r"<article\b", f'<article {_MARK}="1"', source, flags=re.I)
    return [own, *(make.page() for _ in range(n)), " ".join(make.words[:10 + number])]  # the last without markup: all of it


def _truth(page: Page) -> np.ndarray:
    """1: all text of the node is the article's, 0: none, -1: both or no text. The article is the
    marked element less the frames in it that were added or that their elements name."""
    n = len(page.tag)
    kept, own = [n == 1] * n, [0] * n
    for at, _, _, text in page.segments:
        own[at] += len(text.strip())
    for i in range(1, n):
        p = page.parent[i]
        frame = page.tag[i] in FRAME_TAGS or page.tag[i] in FORM_TAGS or page.marked[i] == 2 or page.hidden[i]
        kept[i] = (kept[p] or page.marked[i] == 1) and not frame
    wanted, total = [o * k for o, k in zip(own, kept)], own[:]
    for i in range(n - 1, 0, -1):
        wanted[page.parent[i]] += wanted[i]
        total[page.parent[i]] += total[i]
    return np.array([-1 if not t else 1 if w == t else 0 if not w else -1 for w, t in zip(wanted, total)])


def train(sources: list[str]) -> Trees:
    """Fit on pages whose article element is known, each also marked up in other ways."""
    xs, ys = [], [np.zeros(0)]
    sources = [s for s in sources if re.search(r"<article\b", s, re.I)]
    for number, source in enumerate(sources):
        for variant in _variants(source, number, max(VARIANTS, ALL_VARIANTS // len(sources))):
            page = parse(variant)
            truth = _truth(page)
            x, _ = measure(page)
            xs.append(x[truth >= 0])
            ys.append(truth[truth >= 0])
    y = np.concatenate(ys).astype(float)
    return Trees().fit(np.concatenate(xs), y) if len(y) else Trees()


def extract(sources: list[str], trees: Trees) -> list[str]:
    """The main text of each page."""
    pages = [parse(s) for s in sources]
    measured = [measure(p) for p in pages]
    if not pages:
        return []
    odds = trees.predict(np.concatenate([x for x, _ in measured]))
    out, at = [], 0
    for page, (x, own) in zip(pages, measured):
        out.append(blocks(page, decode(page, odds[at:at + len(x)], own)))
        at += len(x)
    return out


def fit(pages: DataFrame, key: str = "page_id", source: str = "html", max_pages: int = MAX_TRAINING_PAGES) -> Trees:
    """Trees fitted on at most ``max_pages`` pages with a marked-up article, which alone go to the driver.
    They are chosen by two numbers a page (hashes of id and html); only then are their texts fetched."""
    numbered = (pages.select(F.xxhash64(F.col(key)).alias("_k"), F.col(source).alias("html"))
                .filter(F.col("html").rlike("(?i)<article\\b")).withColumn("_h", F.xxhash64("html")))
    chosen = numbered.select("_k", "_h").orderBy("_k", "_h").limit(max_pages).collect()
    if not chosen:
        return Trees()
    wanted = numbered.filter(F.col("_h").isin([r["_h"] for r in chosen])).dropDuplicates(["_h"])
    return train([r["html"] for r in sorted(wanted.select("_h", "html").collect())])


def extract_pages(pages: DataFrame, trees: Trees, key: str = "page_id", source: str = "html",
                  url: str = "url") -> DataFrame:
    """``page_id, url, text, n_chars``, one row per input row, from the whole html.

    Null or empty html gives an empty text, as does a page without main text; text without any
    markup is judged as one node. Trees that no page could train (none has an article element) tell
    nothing apart, so the result is then all visible text of a page. Repeated rows and equal pages give equal texts. A map without
    a shuffle: a page is held as a whole in one task, a bounded number of pages at a time. Deep nesting
    costs no more than as many tags side by side. Where no element names its part, the densest part is the
    article: a few words beside longer comments in the same plain elements may be taken for the frame.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trees)

    def work(rows):
        texts = extract(rows["html"], shared.value)
        return {"page_id": rows["page_id"], "url": rows["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    chosen = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                          F.coalesce(F.col(source), F.lit("")).alias("html"))
    return map_rows(chosen, work, "page_id long, url string, text string, n_chars long")
