"""Operator 12: held-out layouts, the given pages, messages against enumeration, edge cases."""

import html as entities
import itertools
import re

import numpy as np
import pytest

from halocline.llm import maintext, pagetree, queries
from halocline.llm.pagetree import Columns, Forest

EDGE = re.compile(r"</?(?:p|h\d|br|li|ul|ol|div|section|blockquote)\b[^>]*>")


def plain(part):
    return " ".join(entities.unescape(re.sub(r"</?(?:b|i|a)\b[^>]*>", "", EDGE.sub(" ", part))).split())


def article(source):
    return plain(re.search(r"<article>(.*?)</article>", source, re.S)[1])


def test_query_gives_the_article_of_every_page(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op12_main_text(spark, sf).collect()
    assert len(got) == len(pages) == len({r["page_id"] for r in got})
    for r in got:
        page = pages[r["page_id"]]
        assert (r["url"], r["text"]) == (page["url"], article(page["html"]))
        assert r["n_chars"] == len(r["text"])


def test_articles_are_found_where_nothing_declares_them(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = maintext.train(pages)
    rows = pages.collect()
    hidden = maintext.texts([re.sub(r"(</?)article", r"\1div", r["html"]) for r in rows], model)
    assert np.mean([t == article(r["html"]) for t, r in zip(hidden, rows)]) > 0.98


#: Pages of other makes than the layouts; main text stands between {{ and }}.
HELD_OUT = [
    '<html><body><div class="site-header"><span class="brand">My Blog</span><ul class="main-menu"><li><a href="#">Start</a></li><li><a href="#">Archive</a></li></ul></div><div class="blog-post">{{<h1>How to bake bread</h1><p>First you need flour, water and time. I use rye, since it keeps longer.</p><p>Knead.</p><ul><li>500 g of flour</li><li>salt</li></ul><p>Bake it for an hour at <b>200</b> degrees, and let it <a href="/c">cool</a> down.</p>}}</div><div class="comments-area"><h2>3 thoughts on bread</h2><ol class="comment-list"><li><p>Great recipe, thank you very much! I baked it twice.</p></li></ol></div><div class="footer-widgets"><p>Copyright 2021</p></div></body></html>',
    '<body><div id="cookie-consent"><p>This website uses cookies. By going on you accept them.</p><button>Accept</button></div><header><a>Shop</a></header><article>{{<h1>Sea ice in May</h1><p>Ice extent was low. The record goes back to 1979.</p>}}<div class="advertisement"><p>Cheap flights to the south!</p></div>{{<p>In the east it was a little higher than the year before.</p>}}<section class="reader-comments"><h3>Comments</h3><p>I do not believe this at all. Who measured it?</p></section></article><aside class="sidebar"><h3>Latest</h3><ul><li><a href=1>Sun</a></li><li><a href=2>Moon</a></li></ul></aside><form><input><p>Search the site</p></form></body>',
    "<div class=navbar><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div><div><div>{{<p>Plain old page with a paragraph of some length, in which a story is told about a fox. It ran.</p><p>Then it slept. The hounds went home, and the night was quiet again.</p>}}</div></div><div class=copyright>© me</div>",
    "{{<p>Only one paragraph, nothing else.}}",
    "{{Just text &amp; no tags at all, but a full sentence or two. Here is the second.}}",
    '<body><nav class="top"><a href=/>Home</a></nav><main>{{<h1>Tides</h1><p>The moon pulls the sea. So does the sun.</p><section><h2>Springs</h2><p>Both pull as one.</p></section>}}</main><div class="sponsored-box"><p>Our partner sells fine clocks. Have a look!</p></div><footer><p>Tide Club, all rights reserved.</p></footer></body>',
]


@pytest.mark.parametrize("page", HELD_OUT)
@pytest.mark.parametrize("trained", [False, True])
def test_held_out_layouts(spark, page, trained):
    model = maintext.train(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")) if trained else maintext.Model(maintext.seeded())
    want = plain(" ".join(re.findall(r"\{\{(.*?)\}\}", page)))
    assert maintext.texts([re.sub(r"\{\{|\}\}", "", page)], model) == [want]


def test_messages_equal_enumeration():
    model = maintext.Model(maintext.seeded())
    page = "<body><nav><a href=/>Home</a></nav><div><p>A full sentence here.</p><div class=ad>Buy</div></div></body>"
    forest = Forest()
    forest.add(page)
    columns = Columns(forest)
    value = maintext.features(columns)
    n, told = len(columns.kind), dict(columns.cell)
    seen = [v for v in range(n) if columns.leaves[v]]
    total, by = 0.0, np.zeros((n, 4))
    for states in itertools.product(range(4), repeat=len(seen)):
        of = dict(zip(seen, states))
        if any(columns.leaf[v] and of[v] < 2 for v in seen):
            continue
        score = 0.0
        for v in seen:
            score += model.root[of[v]] if columns.parent[v] < 0 else model.edges[of[columns.parent[v]], of[v]]
            score += sum(model.evidence[k][value[v, k], of[v]] for k in range(4))
            if not columns.leaf[v]:
                score += model.evidence[4][told.get(v, 0), of[v]]
        weight = np.exp(score)
        total += weight
        for v in seen:
            by[v, of[v]] += weight
    got = model.marginals(columns)
    assert np.allclose(got[seen], by[seen] / total, atol=1e-9)


def test_states_of_labelled_nodes():
    forest = Forest()
    forest.add("<body><nav>n</nav><div><div><p>a</p><i class=ad>x</i></div><p>b</p></div></body>")
    columns = Columns(forest)
    main = np.array([t in ("a", "b") for t in forest.text])
    names = dict(zip(((forest.text[v] or pagetree.KINDS[forest.kind[v]]) + str(forest.depth[v]) for v in range(len(main))), (maintext.STATES[s] for s in maintext.states(columns, main))))
    assert names == {"root0": "O", "root1": "O", "nav2": "B", "n3": "B", "block2": "A", "block3": "A", "paragraph4": "C", "a5": "C", "inline4": "B", "x5": "B", "paragraph3": "C", "b4": "C"}


@pytest.mark.parametrize(("source", "texts"), [
    ("<p>a<p>b<li>c", ["a", "b", "c"]), ("<ul><li>a<ul><li>b</ul><li>c</ul>d", ["a", "b", "c", "d"]), ("a<!-- x -->b<script>'<p>'</script>c", ["abc"]), ("a<br>b", ["a", "b"]),
    ("<b>a</b>b <a href=x>c</a>", ["ab c"]), ("x &lt; y &amp z &am; &#233;&nbsp;&zzz;", ["x < y & z &am; é\xa0&zzz;"]), ("<p title='>'>a</p>b < c <3", ["a", "b < c <3"]),
    ("<div class=a\"b>x</div>", ["x"]), ("<title>t</title><textarea><p>q</textarea>r", ["r"]), ("<p>a</div></b></p>b", ["a", "b"]), ("<![CDATA[x]]><?p q?><!doctype html>y", ["y"]), ("a<", ["a<"]), ("a<b", ["a"]),
    ("<table><tr><td>a<td>b<tr><td><p>c</table>d", ["a", "b", "c", "d"]), ("<script>never ends <p>a", []), ("<P CLASS=Ad>a</P>", ["a"]),
])
def test_parsing(source, texts):
    forest = Forest()
    forest.add(source)
    assert [t.strip() for t in forest.text if t is not None] == texts


def test_edges(spark):
    deep = "<div>" * 3000 + "<p>Down here it is dark. But it is quiet.</p>"
    long = "<article>" + "<p>Again and again it is said. It is true.</p>" * 20_000 + "</article>"
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<article><p>It holds. It does.</p></article>", "x"), (None, "u", "<article><p>It holds. It does.</p></article>", "x"), (2**60 + 1, "u", deep, "x"), (3, "u", long, "x"), (4, "u", "<p> \n\t &#32; </p>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r["page_id"] or 0, r["url"], r["text"], r["n_chars"]) for r in maintext.extracted(pages).collect() if r["page_id"] != 2)
    assert got[:2] == [(0, "u", "It holds. It does.", 18)] * 2
    assert got[2] == (1, "u", "", 0) and got[4] == (4, "u", "", 0)
    assert got[3][2] == " ".join(["Again and again it is said. It is true."] * 20_000)
    assert got[5] == (2**60 + 1, "u", "Down here it is dark. But it is quiet.", 38)
    assert maintext.extracted(pages.where("page_id = 2")).collect()[0]["text"] == ""
    assert maintext.extracted(pages.where("false")).count() == 0
