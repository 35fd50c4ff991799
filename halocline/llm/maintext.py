"""Main text of web pages (operator 12): a tree-structured graphical model over the nodes of a page.

A node is in one of four states: B (no main text below), C (main text only), A (both, at or below the node where all of
the page's main text meets) and O (both, above it).  Leaves, the stretches of text, are B or C.  Evidence of a node, given its
state, are its kind of element, the words in its class, id and role, and how many words, sentence marks and links it holds; the
potential of a parent and child is the child's chance given the parent's state.  Sum-product messages up and then
down the tree give each leaf's marginal; a leaf is main text if that of C is one half at least.

All tables are counts over labelled pages: the layouts below, and of the pages table a sample of those that declare their main text
by one article, main, role or itemprop.  Each counts a second time with what declares it hidden, so that evidence is learned for pages that
declare nothing.  The table's pages are often of one make, so they weigh no more than the layouts.

Defined results: a null or empty page has the empty text; every page is read whole, whatever its size or depth; repeated rows and rows
without an id are judged one by one; without labelled pages the layouts alone decide; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .pagetree import CATEGORIES, KINDS, Columns, Forest

STATES = "OACB"
O, A, C, B = range(4)
#: Labelled pages of the table that are counted at most, those of least md5 of their url and id.
SAMPLE = 2000
#: Characters of pages judged at once.
CHUNK = 4_000_000
SEED, SMOOTH = 5.0, 0.5
#: Weight of the table's pages: theirs together count so many times the layouts' at most.
TRUST = 0.5
#: Nodes by which a state's table leans to that of all states, and share of it that is even.
LEAN, EVEN = 0.2, 1e-3
#: Children of B hold no main text, of C nothing else; main text meets but once, so below A and C there is no O.
MAY = np.array([[1, 1, 1, 1], [0, 1, 1, 1], [0, 0, 1, 0], [0, 0, 0, 1]], bool)
#: Features of a node and how many values each has: element's kind (a list's or item's differs where links fill it), words, sentence
#: marks, share of linked words, category.
SIZES = (len(KINDS) + 2, 6, 4, 4, len(CATEGORIES) + 1)

_MENU = "<ul><li><a href=/>Home</a></li><li><a href=/n>News from here</a></li><li><a href=/a>About us</a></li></ul>"
_LINKS = "<p><a href=/i>Imprint</a> | <a href=/c>Contact</a></p>"
_SHORT, _LONG = "<p>It rained again.</p>", "<p>The river rose through the night, and by morning the lower road was closed. Farmers moved their cattle uphill. Nobody was hurt.</p>"
_NEAR = "<p>A <a href=/g>gauge</a> near the bridge showed five metres, which is more than in any year since records began.</p>"
_LIST = "<ul><li>Roads stay closed until Monday.</li><li>Schools open late.</li><li>Boats</li></ul>"
_RICH = "<h2>What comes next</h2><ol><li>Dry the cellar.</li><li>Call <a href=/o>the office</a> before noon.</li></ol><blockquote><p>We were lucky.</p></blockquote><table><tr><th>Day</th><th>Metres</th></tr><tr><td>Monday</td><td>5.1</td></tr></table><pre>level = 5.1</pre><figure><img src=w.png><figcaption>The bridge at noon.</figcaption></figure>"
_BODY = f"<h1>High water in the valley</h1>{_LONG}{_NEAR}{_SHORT}<h2>What comes next</h2>{_LONG}{_LIST}"
_TALK = "<div class=comment><b class=user>mo</b><p>Thanks for this. We saw the same thing at our place, and the cellar is still full of water!</p></div>"
_SAID = "<li class=comment><p>I was there too.</p><p>It will happen again. Who is going to pay for the new wall? Not them, as always.</p></li>"
_MAIL = "<form><h3>Stay in touch</h3><p>Get our letter each week. You may leave at any time.</p><label>Your mail</label></form>"
#: Labelled layouts: main text stands between {{ and }}.
LAYOUTS = (
    f"<body><header><a href=/>The Valley Post</a><p>News since 1950.</p></header><nav>{_MENU}</nav><main><article>{{{{{_BODY}}}}}</article></main><footer><p>© 2020 Valley Post. All rights reserved.</p>{_LINKS}</footer></body>",
    f"<body><div id=header><div class=logo>Valley Post</div><div class=menu>{_MENU}</div></div><div id=content>{{{{{_BODY}{_RICH}}}}}</div><div id=sidebar><h3>Popular</h3>{_MENU}<p>Weather for today: rain.</p></div><div id=footer><p>Imprint and contact</p></div></body>",
    f"<body><div class=cookie-banner><p>We use cookies to make this site better. You can read more in our policy.</p></div><div class=wrap><div class=post>{{{{<h1>High water</h1>{_LONG}}}}}<div class=ad>Buy new boots, now half the price.</div>{{{{{_LIST}{_LONG}{_SHORT}}}}}</div><section id=comments><h3>2 comments</h3>{_TALK}{_TALK}</section></div><footer>Imprint</footer></body>",
    f"<body><nav>{_MENU}</nav><article>{{{{<header><h1>High water</h1></header>{_LONG}{_LONG}}}}}<aside><h4>Read too</h4>{_MENU}</aside>{{{{{_LONG}{_RICH}}}}}<div class=share>Share this</div><footer><p>Filed under weather.</p></footer></article>{_MAIL}</body>",
    f"<body><table><tr><td class=nav>{_MENU}</td><td>{{{{{_BODY}}}}}</td></tr></table>{_LINKS}</body>",
    f"<body>{{{{{_SHORT}{_LONG}}}}}</body>",
    f"<body><div class=page><div>{_MENU}</div><div><div>{{{{{_BODY}{_LONG}}}}}</div><div class=related><h3>More stories</h3>{_MENU}</div></div><div>© Valley Post</div></div></body>",
    f"<body><div role=banner>Valley Post</div><div role=main><div class=alert><p>Delivery is late today.</p></div>{{{{{_BODY}}}}}<div class=newsletter><p>Subscribe to our weekly letter and never miss a story.</p></div><div id=respond>{_TALK}</div></div><div class=widget>{_MENU}</div></body>",
    f"<body><nav>{_MENU}</nav><main>{{{{<h1>High water</h1>{_NEAR}{_RICH}{_SHORT}}}}}<section class=comments><h2>Comments</h2><ul>{_SAID}{_SAID}{_SAID}</ul>{_MAIL}</section></main><aside><p>Sponsored: a new pump for your cellar. Order today!</p></aside><footer><div><h5>Company</h5>{_MENU}</div></footer></body>",
    f"<body><div class=notice><p>This site needs scripts. Please switch them on.</p></div><div class=advert><p>Winter sale: all coats must go. Visit our shop.</p></div><article>{{{{{_BODY}{_LIST}{_LONG}}}}}</article><div class=social><a href=/f>Follow us</a></div></body>",
    f"<body><header><h1>Valley Post</h1>{_MENU}</header><div id=main><div class=entry>{{{{<h2>High water</h2>{_LIST}{_NEAR}{_SHORT}{_LIST}}}}}</div><div class=pagination><a href=/2>Older</a> <a href=/3>Newer</a></div></div><footer>{_MENU}<p>Made with care. All rights reserved.</p></footer></body>",
)


def features(columns: Columns) -> np.ndarray:
    """The values of the first four features of each node."""
    words = np.digitize(columns.words, [2, 6, 21, 81, 301])
    stops = np.digitize(columns.stops, [1, 3, 9])
    linked = np.digitize(columns.linked / np.maximum(columns.words, 1), [0.02, 0.34, 0.75])
    lists = np.isin(columns.kind, [KINDS.index("list"), KINDS.index("item")]) & (linked > 1)
    kind = np.where(lists, len(KINDS) + (columns.kind == KINDS.index("item")), columns.kind)
    return np.column_stack([kind, words, stops, linked])


def states(columns: Columns, main: np.ndarray) -> np.ndarray:
    """State of each node (-1 without text below), from the leaves that are main text."""
    own = columns.upward((main & columns.leaf).astype(np.float64)[:, None])[:, 0]
    root = np.zeros(len(own), bool)
    root[columns.parent < 0] = True
    total = np.zeros(int(columns.page.max(initial=-1)) + 1)
    total[columns.page[root]] = own[root]
    whole = (own > 0) & (own == total[columns.page])
    below = np.zeros(len(own), bool)  # a child has all of the main text
    below[columns.parent[whole & ~root]] = True
    out = np.where(own == columns.leaves, C, np.where(below, O, A))
    return np.where(columns.leaves == 0, -1, np.where(own == 0, B, out))


def tables() -> tuple[list[np.ndarray], np.ndarray]:
    """Empty counts: values of a feature by state, and child by parent state with the root's in a last row."""
    return [np.zeros((n, 4)) for n in SIZES], np.zeros((5, 4))


def count(columns: Columns, state: np.ndarray, into: tuple[list[np.ndarray], np.ndarray], weight: float = 1.0, hidden: bool = False) -> None:
    """Add a forest's nodes to the counts; hidden: what declares the main text shows as a plain block."""
    seen = state >= 0
    value = features(columns)
    if hidden:
        value[columns.kind == KINDS.index("main"), 0] = KINDS.index("block")
    for k in range(4):
        np.add.at(into[0][k], (value[seen, k], state[seen]), weight)
    plain = seen & ~columns.leaf
    cell = [(v, c) for v, c in columns.cell if plain[v] and not (hidden and c == 1)]
    for v, c in cell:
        into[0][4][c, state[v]] += weight
    plain[[v for v, _ in cell]] = False
    np.add.at(into[0][4], (np.zeros(plain.sum(), np.int64), state[plain]), weight)
    above = np.where(columns.parent >= 0, state[columns.parent], 4)
    np.add.at(into[1], (above[seen], state[seen]), weight)


class Model:
    """Log potentials: values of features by state, child by parent, and the root's."""

    def __init__(self, counts: tuple[list[np.ndarray], np.ndarray]) -> None:
        self.evidence = [np.log((c + LEAN * _share(c.sum(axis=1))[:, None]) / (c.sum(axis=0) + LEAN)) for c in counts[0]]
        edges = np.where(np.vstack([MAY, np.ones((1, 4), bool)]), counts[1] + SMOOTH, 1e-9)
        edges = np.log(edges / edges.sum(axis=1, keepdims=True))
        self.edges, self.root = edges[:4], edges[4]

    def marginals(self, columns: Columns) -> np.ndarray:
        """Each node's chances of the four states, by messages from the leaves up and from the roots down."""
        value = features(columns)
        own = sum(self.evidence[k][value[:, k]] for k in range(4))
        lone = ~columns.leaf
        lone[[v for v, _ in columns.cell]] = False
        own[lone] += self.evidence[4][0]
        for v, c in columns.cell:
            own[v] += self.evidence[4][c]
        own[columns.leaf, :2] = -1e9
        own[columns.leaves == 0] = 0.0
        up = np.zeros_like(own)  # a node's message to its parent, by the parent's state
        for level in columns.levels[:0:-1]:
            up[level] = _log_sum(own[level][:, None, :] + self.edges[None], 2)
            np.add.at(own, columns.parent[level], up[level])
        # own now holds all evidence at and below a node; with what comes from above it's the marginal
        out = own.copy()
        for level in columns.levels[:1]:
            out[level] += self.root
        for level in columns.levels[1:]:
            above = out[columns.parent[level]] - up[level]
            out[level] += _log_sum(above[:, :, None] + self.edges[None], 1)
        out -= out.max(axis=1, keepdims=True)
        out = np.exp(out)
        return out / out.sum(axis=1, keepdims=True)


def _share(counts: np.ndarray) -> np.ndarray:
    return EVEN / len(counts) + (1 - EVEN) * counts / max(1.0, counts.sum())


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def seeded() -> tuple[list[np.ndarray], np.ndarray]:
    """Counts of the layouts, with what declares the main text shown and hidden."""
    counts = tables()
    for layout in LAYOUTS:
        forest = Forest()
        forest.add(re.sub(r"\{\{|\}\}", lambda m: "<hr>" + ("\x02" if m[0] == "{{" else "\x03") + "<hr>", layout))
        inside, main, gone = False, np.zeros(len(forest.text), bool), []
        for v, text in enumerate(forest.text):
            if text in ("\x02", "\x03"):
                inside = text == "\x02"
                gone.append(v)
            main[v] = inside and text is not None and v not in gone
        for v in gone:
            forest.text[v] = None
        columns = Columns(forest)
        for hidden in (False, True):
            count(columns, states(columns, main), counts, SEED, hidden)
    return counts


def _declared(batches):
    """Counts over the pages that declare their main text once."""
    counts = tables()
    for pdf in batches:
        for source in pdf["html"]:
            forest = Forest()
            forest.add(source)
            mark = np.array(forest.mark)
            if forest.declared[0] != 1:
                continue
            columns = Columns(forest)
            state = states(columns, mark == 1)
            for hidden in (False, True):
                count(columns, state, counts, 1.0, hidden)
    rows = [(k, int(i), int(j), float(t[i, j])) for k, t in enumerate([*counts[0], counts[1]]) for i, j in zip(*np.nonzero(t))]
    yield pd.DataFrame(rows, columns=["feature", "value", "state", "n"])


def train(pages: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of the layouts and of at most `sample` pages that may declare their main text."""
    counts = seeded()
    told = pages.where("html is not null").select("html", F.md5(F.concat_ws(" ", F.col("url"), F.col("page_id").cast("string")).cast("binary")).alias("key"))
    told = told.where("html rlike '(?i)<(article|main)[ >]|role=.?(main|article)|itemprop=.?articlebody'")
    least = told.select("key").distinct().orderBy("key").limit(sample)  # keys first, so that no task gathers pages
    own = told.join(F.broadcast(least), "key").groupBy("key").agg(F.min("html").alias("html"))
    rows = own.select("html").repartition(8).mapInPandas(_declared, "feature int, value int, state int, n double")
    found = rows.groupBy("feature", "value", "state").agg(F.sum("n").alias("n")).collect()  # as many as the tables have cells, at most
    return Model(mixed(counts, [tuple(r) for r in found]))


def mixed(counts: tuple[list[np.ndarray], np.ndarray], found: list[tuple[int, int, int, float]]) -> tuple[list[np.ndarray], np.ndarray]:
    """The layouts' counts and those of the table's pages, (feature, value, state, n), which weigh TRUST times the layouts' at most."""
    nodes = sum(n for k, _, _, n in found if k == 0)
    weight = min(1.0, TRUST * counts[0][0].sum() / nodes) if nodes else 0.0
    for k, value, state, n in found:
        (counts[0][k] if k < len(SIZES) else counts[1])[value, state] += weight * n
    return counts


def texts(sources: list[str | None], model: Model) -> list[str]:
    """Main text of each page."""
    forest = Forest()
    for source in sources:
        forest.add(source)
    columns = Columns(forest)
    kept = columns.leaf & (model.marginals(columns)[:, C] >= 0.5)
    parts: list[list[str]] = [[] for _ in sources]
    gap = [False] * len(sources)
    for v in np.flatnonzero(columns.leaf).tolist():
        page = forest.page[v]
        gap[page] |= forest.gap[v]
        if kept[v]:
            parts[page].append(" " + forest.text[v] if gap[page] else forest.text[v])
            gap[page] = False
    return [" ".join("".join(p).split()) for p in parts]


def _chunks(sources: list[str | None]):
    at = 0
    while at < len(sources):
        to, size = at, 0
        while to < len(sources) and (to == at or size < CHUNK):
            size += len(sources[to] or "")
            to += 1
        yield at, to
        at = to


def extracted(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """Per page: page_id, url, text (its main text), n_chars (code points)."""
    model = model or train(pages)  # a few hundred numbers, which go with the function

    def extract(batches):
        for pdf in batches:
            sources = pdf["html"].tolist()
            for at, to in _chunks(sources):
                yield pd.DataFrame({"page_id": pdf["page_id"].iloc[at:to].array, "url": pdf["url"].iloc[at:to].array, "text": texts(sources[at:to], model)})

    # ids as text, since a column of whole numbers with nulls would turn to doubles on its way
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html").mapInPandas(extract, "page_id string, url string, text string")
    return rows.select(F.col("page_id").cast("long").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
