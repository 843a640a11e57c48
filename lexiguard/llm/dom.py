"""Web pages as trees of blocks, and what can be measured on each node.

A tree has a node for every block element and for every stretch of text that
has block siblings; an element that holds nothing but text is one node with
that text. Parents come before children, and texts are in page order. Inline
elements make no nodes. Scripts, styles, titles, form fields and embedded
objects have no text. Unclosed paragraphs, list items and table cells end where
the next one begins; stray and missing end tags, unclosed quotes and comments
do no harm. The time is linear in the page, however it is nested: elements
deeper than DEEPEST become siblings, as in browsers, and no text is lost.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np

DEEPEST = 512
MARK = "data-mark"

# Elements by what they are.
BLOCKS = frozenset(
    "address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HIDDEN = frozenset("noscript template svg math object select button canvas audio video datalist map".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
TRANSPARENT = frozenset("html head body".split())
#: What a start tag closes, up to which elements it is looked for.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table",)), "tbody": (("tbody", "thead", "tfoot"), ("table",)), "thead": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
}
TABLE_PARTS = frozenset("table caption tbody thead tfoot tr td th".split())
# Words of classes, ids and roles, by what they tell of an element.
FAMILIES = {
    "text": "article articlebody body content entry main post prose story text",
    "menu": "breadcrumb breadcrumbs crumbs header masthead menu menubar nav navbar navigation pager pagination skip tabs toc toolbar topbar",
    "advert": "ad ads adslot advert advertisement advertising adverts banner partner promo promoted promotion sponsor sponsored taboola outbrain",
    "notice": "alert banner consent cookie cookies dialog gdpr modal notice notification overlay paywall popup privacy toast",
    "beside": "aside complementary more popular recommended related rail recent side sidebar teaser trending widget widgets",
    "reply": "comment commentlist comments discussion disqus feedback replies reply respond responses reviews thread",
    "foot": "bottom colophon contentinfo copyright credits footer legal meta byline tags",
    "form": "contact form login newsletter search share sharing signin signup social subscribe subscription",
}
TAGS = {"text": "article main", "menu": "nav menu", "head": "header hgroup", "foot": "footer", "beside": "aside", "form": "form fieldset dialog details search legend"}
KINDS = {"heading": "h1 h2 h3 h4 h5 h6", "paragraph": "p blockquote pre", "list": "ul ol li dl dt dd dir", "table": "table caption tbody thead tfoot tr td th", "figure": "figure figcaption", "stretch": "#text"}

_bit: dict[str, int] = {t: 1 << i for i, names in enumerate(TAGS.values()) for t in names.split()}
_family: dict[str, int] = {}
for _i, _names in enumerate(FAMILIES.values()):
    for _t in _names.split():
        _family[_t] = _family.get(_t, 0) | 1 << (len(TAGS) + _i)
_kind: dict[str, int] = {t: i + 1 for i, names in enumerate(KINDS.values()) for t in names.split()}
N_HINTS = len(TAGS) + len(FAMILIES)

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_TAG_END = re.compile(r"[\s/]*>")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {t: re.compile(f"</{t}(?=[\\s/>])", re.I) for t in RAW}
_STOPS = re.compile(r"[.,;:!?。、，！？]")
_DIGITS = re.compile(r"\d")


def decoded(text: str) -> str:
    """Character references as characters; numbers beyond all characters as U+FFFD, however long."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = re.sub(r"&#0+(?=[0-9])", "&#", text)
        text = re.sub(r"&#[0-9]{8,};?", "�", text)
    return html.unescape(text)


def hints_of(tag: str, attributes: dict[str, str]) -> int:
    """Bits for the element's kind and for the families of words in its class, id and role."""
    bits = _bit.get(tag, 0)
    for name in ("class", "id", "role"):
        for t in _TOKEN.findall(attributes.get(name, "")):
            bits |= _family.get(t.lower(), 0)
    return bits


@dataclass
class Tree:
    tag: list[str] = field(default_factory=lambda: ["#page"])
    parent: list[int] = field(default_factory=lambda: [-1])
    hints: list[int] = field(default_factory=lambda: [0])
    text: list[str] = field(default_factory=lambda: [""])
    link_share: list[float] = field(default_factory=lambda: [0.0])
    n_links: list[int] = field(default_factory=lambda: [0])
    mark: list[str] = field(default_factory=lambda: [""])
    closed: list[bool] = field(default_factory=lambda: [False])

    def node(self, tag: str, parent: int, hints: int = 0, mark: str = "") -> int:
        self._has_children(parent)
        return self._add(tag, parent, hints, "", 0.0, 0, mark)

    def _add(self, tag: str, parent: int, hints: int, text: str, share: float, n_links: int, mark: str) -> int:
        for column, x in ((self.tag, tag), (self.parent, parent), (self.hints, hints), (self.text, text), (self.link_share, share), (self.n_links, n_links), (self.mark, mark), (self.closed, False)):
            column.append(x)
        return len(self.tag) - 1

    def _has_children(self, i: int) -> None:
        """From now on i has children; a text that it had becomes the first."""
        self.closed[i] = True
        if self.text[i]:
            self._add("#text", i, 0, self.text[i], self.link_share[i], self.n_links[i], "")
            self.text[i], self.link_share[i], self.n_links[i] = "", 0.0, 0

    def put(self, i: int, text: str, share: float, n_links: int) -> None:
        """One more text of element i."""
        if self.closed[i] or self.text[i]:
            self._has_children(i)
            self._add("#text", i, 0, text, share, n_links, "")
        else:
            self.text[i], self.link_share[i], self.n_links[i] = text, share, n_links


class _Reader:
    def __init__(self, page: str) -> None:
        self.page, self.tree = page, Tree()
        # (element, its node, or -1 for one without text)
        self.stack: list[tuple[str, int]] = [("#page", 0)]
        self.n_open: dict[str, int] = {}
        self.pieces: list[str] = []
        self.sizes = [0, 0]
        self.link_depth, self.n_links = 0, 0

    def piece(self, text: str) -> None:
        if text and self.stack[-1][1] >= 0:
            self.pieces.append(text)
            self.sizes[0] += len(text)
            if self.link_depth:
                self.sizes[1] += len(text)

    def flush(self) -> None:
        """End the current text."""
        if self.pieces:
            text = " ".join(decoded("".join(self.pieces)).split())
            if text:
                self.tree.put(next(node for _, node in reversed(self.stack) if node >= 0), text, self.sizes[1] / self.sizes[0], self.n_links)
            self.pieces = []
        self.sizes, self.n_links = [0, 0], 0

    def pop(self) -> None:
        if self.stack[-1][1] >= 0:
            self.flush()
        tag, _ = self.stack.pop()
        self.n_open[tag] -= 1
        if self.link_depth > len(self.stack):
            self.link_depth = 0

    def close(self, tags: tuple[str, ...], barriers: tuple[str, ...] | frozenset[str]) -> None:
        """End the innermost of these elements, with all in it, unless a barrier is met first."""
        if not any(self.n_open.get(t) for t in tags):
            return
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at][0] in tags:
                while len(self.stack) > at:
                    self.pop()
                return
            if self.stack[at][0] in barriers:
                return

    def attributes(self, at: int) -> tuple[dict[str, str], int]:
        """The attributes from there on, and where the tag ends; -1 if it never does."""
        found: dict[str, str] = {}
        while not (end := _TAG_END.match(self.page, at)):
            m = _ATTRIBUTE.match(self.page, at)
            if not m or m.end() == at:
                return found, -1
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
            at = m.end()
        return found, end.end()

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        if tag == "br":
            self.piece(" ")
        elif tag == "a":
            self.link_depth = len(self.stack)
            self.n_links += 1
        elif tag in BLOCKS or tag in HIDDEN:
            # What is in a hidden element, or is one, is no boundary of the text around it.
            shown = tag in BLOCKS and self.stack[-1][1] >= 0
            if shown:
                self.flush()
                if self.stack[-1][0] == "p":
                    self.pop()
                if tag in CLOSES:
                    self.close(*CLOSES[tag])
            if tag == "hr":
                return
            if len(self.stack) >= DEEPEST:
                self.pop()
            node = self.tree.node(tag, self.stack[-1][1], hints_of(tag, attributes), attributes.get(MARK, "")) if shown and self.stack[-1][1] >= 0 else -1
            self.stack.append((tag, node))
            self.n_open[tag] = self.n_open.get(tag, 0) + 1

    def end(self, tag: str) -> None:
        if tag == "a":
            self.link_depth = 0
        elif tag in BLOCKS or tag in HIDDEN:
            self.close((tag,), () if tag in TABLE_PARTS else ("td", "th", "caption"))

    def read(self) -> Tree:
        page, at = self.page, 0
        while at < len(page):
            lt = page.find("<", at)
            if lt < 0:
                self.piece(page[at:])
                break
            self.piece(page[at:lt])
            after = page[lt + 1 : lt + 2]
            name = _NAME.match(page, lt + (2 if after == "/" else 1))
            if name:
                tag = name[0].lower()
                attributes, at = self.attributes(name.end())
                if at < 0:
                    break
                if after == "/":
                    self.end(tag)
                elif tag in RAW:
                    stop = _RAW_END[tag].search(page, at)
                    at = stop.start() if stop else len(page)
                elif tag not in TRANSPARENT and (tag not in VOID or tag in ("br", "hr")):
                    self.start(tag, attributes)
            elif after in ("!", "?", "/"):
                mark = "-->" if page.startswith("<!--", lt) else ">"
                # <!--> and <!---> are whole comments.
                end = page.find(mark, lt + 2)
                at = end + len(mark) if end >= 0 else len(page)
            else:
                self.piece("<")
                at = lt + 1
        self.flush()
        return self.tree


def read_page(page: str | None) -> Tree:
    return _Reader(page or "").read()


class Batch:
    """Trees side by side, with arrays over all their nodes, and sums over subtrees taken level by level."""

    def __init__(self, trees: list[Tree]) -> None:
        self.trees = trees
        self.first = np.cumsum([0, *(len(t.tag) for t in trees)])
        offsets = np.repeat(self.first[:-1], np.diff(self.first))
        flat = lambda name: [x for t in trees for x in getattr(t, name)]
        parent = np.array(flat("parent"), np.int64)
        self.parent = np.where(parent >= 0, parent + offsets, -1)
        self.root = offsets
        self.text = flat("text")
        self.mark = flat("mark")
        self.hints = np.array(flat("hints"), np.int64)
        self.kind = np.array([_kind.get(t, 0) for t in flat("tag")], np.int64)
        self.link_share = np.array(flat("link_share"))
        self.n_links = np.array(flat("n_links"), float)
        depth = [0] * len(parent)
        for i, p in enumerate(self.parent.tolist()):
            if p >= 0:
                depth[i] = depth[p] + 1
        self.depth = np.array(depth, np.int64)
        order = np.argsort(self.depth, kind="stable")
        cuts = np.searchsorted(self.depth[order], np.arange(1, (max(depth) if depth else 0) + 2))
        self.levels = np.split(order, cuts[:-1]) if len(order) else []

    def summed(self, x: np.ndarray) -> np.ndarray:
        """For each node, the sum of x over its subtree."""
        out = np.array(x, float)
        for level in self.levels[:0:-1]:
            np.add.at(out, self.parent[level], out[level])
        return out

    def greatest(self, x: np.ndarray) -> np.ndarray:
        out = np.array(x, float)
        for level in self.levels[:0:-1]:
            np.maximum.at(out, self.parent[level], out[level])
        return out

    def features(self) -> np.ndarray:
        """A row for each node; see FEATURES for the columns."""
        n = len(self.parent)
        own = np.array([(len(t), t.count(" ") + 1 if t else 0, len(_STOPS.findall(t)), len(_DIGITS.findall(t)), "©" in t) for t in self.text], float).reshape(n, 5)
        chars, words, stops, digits, rights = (self.summed(c) for c in own.T)
        safe = lambda a, b: np.divide(a, b, out=np.zeros(n), where=b > 0)
        links = self.summed(self.link_share * own[:, 0])
        n_links, n_nodes = self.summed(self.n_links), self.summed(np.ones(n))
        texts = self.summed(own[:, 0] > 0)
        longest = self.greatest(own[:, 1])
        headings, paragraphs = self.summed(self.kind == 1), self.summed(self.kind == 2)
        all_chars = chars[self.root]
        before = np.cumsum(own[:, 0]) - own[:, 0]
        before -= before[self.root]
        # Siblings in page order lie side by side once nodes are sorted by parent; roots are their own.
        parent = np.where(self.parent >= 0, self.parent, np.arange(n))
        group = np.where(self.parent >= 0, self.parent, n + np.arange(n))
        order = np.argsort(group, kind="stable")
        begins = np.flatnonzero(np.concatenate([[True], np.diff(group[order]) != 0])) if n else np.zeros(0, int)
        sizes = np.diff(np.concatenate([begins, [n]]))
        at, size = np.empty(n), np.empty(n)
        at[order] = np.arange(n) - np.repeat(begins, sizes)
        size[order] = np.repeat(sizes, sizes)
        earlier, later = np.zeros(n), np.zeros(n)
        if n > 1:
            same = group[order][1:] == group[order][:-1]
            earlier[order[1:]] = chars[order[:-1]] * same
            later[order[:-1]] = chars[order[1:]] * same
        share = safe(links, chars)
        mean_share, alike = np.empty(n), np.empty(n)
        if n:
            mean_share[order] = np.repeat(np.add.reduceat(share[order], begins) / sizes, sizes)
            pair = group * 16 + self.kind
            _, inverse, counts = np.unique(pair, return_inverse=True, return_counts=True)
            alike = counts[inverse] / size
        above = np.zeros(n, np.int64)
        for level in self.levels[1:]:
            p = self.parent[level]
            above[level] = above[p] | self.hints[p]
        bits = lambda x: (x[:, None] >> np.arange(N_HINTS)) & 1
        measures = [
            self.depth, np.log1p(chars), np.log1p(words), share, np.log1p(n_nodes), np.log1p(safe(chars, n_nodes)), safe(stops, words), np.log1p(safe(words, texts)), np.log1p(longest), safe(chars, all_chars), safe(before, all_chars),
            safe(at, size), np.log1p(size), alike, np.log1p(earlier), np.log1p(later), mean_share, safe(chars, chars[parent]), np.log1p(headings), np.log1p(paragraphs), np.log1p(n_links), rights > 0, safe(digits, chars),
        ]
        return np.column_stack([*measures, *(self.kind == k for k in range(1, len(KINDS) + 1)), bits(self.hints), bits(above)]).astype(float)

    def decoded(self, p: np.ndarray, mixed: float) -> np.ndarray:
        """Which nodes are main text, given each node's probability: the choice of least cost, where a node is all main text, all not, or mixed, and what is not mixed decides for all below it."""
        p = np.clip(p, 1e-6, 1 - 1e-6)
        yes, no = self.summed(-np.log(p)), self.summed(-np.log1p(-p))
        apart = np.full(len(p), mixed)
        has_children = np.zeros(len(p), bool)
        has_children[self.parent[self.parent >= 0]] = True
        best = np.minimum(yes, no)
        for level in reversed(self.levels):
            inner = level[has_children[level]]
            best[inner] = np.minimum(best[inner], apart[inner])
            below = level[self.parent[level] >= 0]
            np.add.at(apart, self.parent[below], best[below])
        # 1: all main text, 0: none, -1: mixed.
        choice = np.where(has_children & (apart < np.minimum(yes, no)), -1, (yes < no).astype(int))
        for level in self.levels[1:]:
            p_choice = choice[self.parent[level]]
            choice[level] = np.where(p_choice >= 0, p_choice, choice[level])
        return choice == 1

    def texts(self, chosen: np.ndarray) -> list[str]:
        """The chosen texts of each page, a line each."""
        out = []
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True):
            out.append("\n".join(self.text[i] for i in range(a, b) if chosen[i] and self.text[i]))
        return out


#: The columns of features(): measures, kinds of the element, its hints, hints of the elements around it.
FEATURES = [
    *"depth chars words link_share nodes chars_per_node stops_per_word words_per_text longest_text page_share place sibling siblings alike_siblings chars_before chars_after siblings_link_share parent_share headings paragraphs links rights digit_share".split(),
    *(f"is_{k}" for k in KINDS), *(f"own_{k}" for k in [*TAGS, *FAMILIES]), *(f"in_{k}" for k in [*TAGS, *FAMILIES]),
]
