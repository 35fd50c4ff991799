"""HTML pages as forests: a node for each element that can matter, a leaf for each stretch of text.

The parser is lenient: end tags may lack, attributes may be unquoted, comments, scripts, styles and other elements without text of
their own are passed over.  Inline elements without class or id are no nodes and bring no space, links neither (their words are counted);
every other element's edge, and a line break, parts blocks.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import numpy as np

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_LETTERS = re.compile(r"[a-z]+")
_SENTENCE = re.compile(r"[.!?…。]")

#: Elements whose text isn't part of a page's text, and those without an end tag (fixed values).
RAW = frozenset("script style textarea title iframe noembed noframes xmp template svg math select button object canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: An open element at the head of a list ends at the start tags behind it (fixed values).
CLOSES = {
    "p": frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset("tr thead tbody tfoot".split()), "td": frozenset("td th tr tbody tfoot".split()), "th": frozenset("td th tr tbody tfoot".split()),
    "thead": frozenset("tbody tfoot".split()), "tbody": frozenset("tbody tfoot".split()), "head": frozenset(["body"]),
}
#: What an end or start tag doesn't reach beyond (fixed values).
SCOPE = frozenset("table td th caption".split())
HOLDS = {"li": frozenset("ul ol menu".split()), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["table"]), "th": frozenset(["table"]), "thead": frozenset(["table"]), "tbody": frozenset(["table"])}

KINDS = ("text", "root", "main", "nav", "header", "footer", "aside", "form", "paragraph", "heading", "list", "item", "table", "cell", "inline", "section", "block")
_KIND = {t: k for k, tags in {
    1: "html body", 2: "article main", 3: "nav menu", 4: "header", 5: "footer", 6: "aside", 7: "form fieldset legend label noscript dialog", 8: "p pre blockquote", 9: "h1 h2 h3 h4 h5 h6",
    10: "ul ol dl", 11: "li dt dd", 12: "table thead tbody tfoot", 13: "tr td th caption", 15: "section",
}.items() for t in tags.split()}

#: Words in class, id and role that tell what an element is for (fixed values).
CATEGORIES = {
    "body": "article articlebody content entry post story body main text prose",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc skip",
    "top": "header masthead topbar branding logo",
    "foot": "footer foot copyright colophon legal contentinfo",
    "side": "sidebar side rail widget widgets aside secondary complementary",
    "notice": "cookie cookies consent gdpr notice banner alert popup modal overlay toast newsletter subscribe subscription signup paywall login disclaimer",
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion commercial",
    "share": "share sharing social follow",
    "comment": "comment comments reply replies respond discussion feedback",
    "related": "related recommended recommendations popular trending latest teaser teasers",
    "form": "search form",
}
_KNOWN: dict[str, tuple[tuple[int, ...], bool]] = {}
_CATEGORY = {w: k for k, words in enumerate(CATEGORIES.values(), 1) for w in words.split()}
#: Kinds and categories that mark text which isn't the page's own in pages that declare their main text.
_OTHER_KINDS, _OTHER = frozenset((3, 5, 6, 7)), frozenset(range(2, len(CATEGORIES) + 1))


def _told(attributes: str) -> tuple[tuple[int, ...], bool]:
    """Categories that class, id and role name, and whether they declare the main text."""
    if attributes in _KNOWN:
        return _KNOWN[attributes]
    found, declared = set(), False
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        name = name.lower()
        declared |= name == "itemprop" and "articlebody" in value or name == "role" and value in ("main", "article")
        if name != "itemprop":
            found |= {_CATEGORY[w] for w in _LETTERS.findall(value) if w in _CATEGORY}
    if len(_KNOWN) > 8192:
        _KNOWN.clear()
    _KNOWN[attributes] = tuple(sorted(found)), declared
    return _KNOWN[attributes]


@dataclass
class Forest:
    """Columns of nodes; parents precede children.  linked: words of a leaf within links; mark: 1 below a declared main text, 2 below something else, 0 unmarked."""

    page: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    kind: list[int] = field(default_factory=list)
    told: list[tuple[int, ...]] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    mark: list[int] = field(default_factory=list)
    gap: list[bool] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    declared: list[int] = field(default_factory=list)

    def node(self, parent: int, kind: int, told: tuple[int, ...], mark: int, linked: int = 0, gap: bool = False, text: str | None = None) -> int:
        self.page.append(len(self.declared) - 1)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.kind.append(kind)
        self.told.append(told)
        self.linked.append(linked)
        self.mark.append(mark)
        self.gap.append(gap)
        self.text.append(text)
        return len(self.kind) - 1

    def add(self, source: str | None) -> None:
        """Parse a page (null: an empty one) into nodes of its own."""
        source = source or ""
        self.declared.append(0)
        root = self.node(-1, 1, (), 0)
        stack: list[tuple[str, int]] = [("", root)]
        opened: dict[str, int] = {}
        part: list[str] = []
        gap, at, link, linked = True, 0, False, 0

        def leaf() -> None:
            nonlocal gap, linked
            if part:
                raw = "".join(part)
                part.clear()
                text = entities.unescape(raw) if "&" in raw else raw
                if text.strip():
                    v = stack[-1][1]
                    self.node(v, 0, (), self.mark[v], linked, gap, text)
                    gap = False
                else:
                    gap = True
            linked = 0

        def end(depth: int) -> None:
            """Close the stack's elements from `depth` on."""
            for name, _ in stack[depth:]:
                opened[name] -= 1
            del stack[depth:]

        while True:
            m = _TOKEN.search(source, at)
            upto = m.start() if m else len(source)
            if upto > at:
                part.append(source[at:upto])
                if link:
                    linked += len(part[-1].split())
            if not m:
                leaf()
                return
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            inline = name in INLINE
            if name == "a":
                link = not m[1]
            if m[1]:
                if opened.get(name):
                    barrier = HOLDS.get(name, SCOPE)
                    for depth in range(len(stack) - 1, 0, -1):
                        other = stack[depth][0]
                        if other == name:
                            leaf()
                            end(depth)
                            break
                        if other in barrier or inline and other not in INLINE:
                            break
                if not inline:
                    leaf()
                    gap, link = True, False
                continue
            if name in RAW:
                close = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*(?:>|\\Z)", re.I).search(source, at)
                if not m[3].endswith("/"):
                    at = close.end() if close else len(source)
                if name not in ("script", "style", "template"):
                    leaf()
                    gap = True
                continue
            attributes = m[3]
            told, declares = _told(attributes) if "=" in attributes and _ATTRIBUTE.search(attributes) else ((), False)
            if inline and not told:
                continue
            leaf()
            if not inline:
                gap = True
                self._implied(stack, opened, name, end)
            if name in VOID:
                continue
            v = stack[-1][1]
            kind = _KIND.get(name, 14 if inline else 16)
            mark = self.mark[v]
            if kind == 2 or declares:
                self.declared[-1] += mark != 1
                mark = 1
            elif kind in _OTHER_KINDS or not _OTHER.isdisjoint(told):
                mark = 2
            stack.append((name, self.node(v, kind, told, mark)))
            opened[name] = opened.get(name, 0) + 1

    @staticmethod
    def _implied(stack, opened, name, end) -> None:
        """Close what the start tag `name` ends without an end tag."""
        closing = [x for x, starts in CLOSES.items() if name in starts and opened.get(x)]
        for x in closing:
            barrier = HOLDS.get(x, SCOPE)
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == x:
                    end(depth)
                    break
                if stack[depth][0] in barrier:
                    break


class Columns:
    """A forest's columns as arrays, with the sums of words, sentence marks, linked words and leaves below each node."""

    def __init__(self, forest: Forest) -> None:
        self.page, self.parent, self.depth, self.kind = (np.array(x, np.int64) for x in (forest.page, forest.parent, forest.depth, forest.kind))
        self.leaf = np.array([t is not None for t in forest.text], bool)
        words = np.array([0 if t is None else len(t.split()) for t in forest.text], np.float64)
        stops = np.array([0 if t is None else len(_SENTENCE.findall(t)) for t in forest.text], np.float64)
        order = np.argsort(self.depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(self.depth[order])) + 1) if len(order) else []
        sums = np.column_stack([words, stops, np.minimum(words, np.array(forest.linked, np.float64)), self.leaf.astype(np.float64)])
        self.words, self.stops, self.linked, self.leaves = self.upward(sums).T
        self.cell = [(v, c) for v, told in enumerate(forest.told) for c in told]

    def upward(self, own: np.ndarray) -> np.ndarray:
        """Sums over each node and all below it."""
        out = own.copy()
        for level in self.levels[:0:-1]:
            np.add.at(out, self.parent[level], out[level])
        return out
