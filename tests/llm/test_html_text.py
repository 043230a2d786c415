"""Main text of pages: against the plain cut of the known layout, hand-written pages of others, and the cut against all labellings."""

import html as entities
import itertools
import random
import re
import time

import pytest

from tallyloom.llm import html_text, queries

DIR = "/root/testdata/sf0.01"


def plain(page):
    """What stands in the page's article, told by its tags alone."""
    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    found = [" ".join(entities.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?p>|</?h1>", inner)]
    return "\n\n".join(b for b in found if b)


def test_whole_table(spark):
    want = {r.page_id: (r.url, plain(r.html)) for r in spark.read.parquet(f"{DIR}/pages.parquet").collect()}
    got = queries.queries()["op12_html_text"](spark, DIR).collect()
    assert len(got) == len(want) and {r.page_id: (r.url, r.text) for r in got} == want
    assert all(r.n_chars == len(r.text) > 0 for r in got)


MARKED = """<!DOCTYPE html><html><body class="has-sidebar single"><header class="page-header"><h1>The Site</h1><a href=/>Home</a></header><nav><ul><li><a href="/a">A</a></ul></nav>
<div id="cookie-notice" class="visible">We use cookies to make this site better, and you may accept all of them, please.</div>
<div class="layout-with-sidebar"><div class="content overflow-hidden"><h1>The&nbsp;story</h1><p>First part of it, long enough to look like one &amp; more.</p><div class="ad">Buy now! The best offers of this year are all here.</div>
<p>Second<br>part.<ul><li>one item<li>two items</ul><blockquote>Words of <i>some</i>body.</blockquote><h2>Why</h2><p>It ends here.</p><p hidden>Not to be seen by anybody at all.</p></div></div>
<div class="left-sidebar"><article class="teaser"><p>A teaser in an article element, which is long enough to look like content as well.</p></article></div>
<aside><h3>Popular</h3><p>A teaser that is long enough to look like content to any classifier of texts.</p></aside>
<section id="comments"><h3>Comments</h3><article class="comment"><p>I disagree with all of it, and have many words to say why it is so.</p></article></section>
<form action="/s"><p>Type here what you are looking for.</p></form><footer><p>&copy; The Site. All rights reserved.</p></footer></body></html>"""
BARE = """<div><table><tr><td><a href=1>Home</a> <a href=2>News</a></td></tr></table></div><div><div>Long plain text without any marks at all, as it was on old pages, but which is the article
and goes on for a while.</div><div>Another part of the same text, that says more of what was said, and again goes on for a while.</div><div>Short end.</div></div>
<div><a href=3>Next</a> | <a href=4>Previous</a></div><div>Copyright 1999</div>"""
WRAPPED = """<form id="all"><div class="wrapper"><main><h1>T</h1><p>Hi.</p><p>A<b>B</b>C</p><pre>x  y
z</pre><script>if (a < b) document.write("<p>no</p>")</script><noscript><p>no</p></noscript></main></div></form>"""
BROKEN = "<article><h1>A</h1><p>one &lt;b&gt; &#233; 3 < 4 and 5 > 2<p>two<!-- > <p>no</p> --></b></article><!-- unclosed <p>no"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (MARKED, ["The story", "First part of it, long enough to look like one & more.", "Second part.", "one item", "two items", "Words of somebody.", "Why", "It ends here."]),
        (BARE, ["Long plain text without any marks at all, as it was on old pages, but which is the article and goes on for a while.", "Another part of the same text, that says more of what was said, and again goes on for a while.", "Short end."]),
        (WRAPPED, ["T", "Hi.", "ABC", "x y z"]),
        (BROKEN, ["A", "one <b> é 3 < 4 and 5 > 2", "two"]),
    ],
)
def test_other_layouts(page, want):
    assert html_text.main_text(page).split("\n\n") == want


def test_smoothness_decides_short_blocks():
    """A short block amid an article is content, the same words far from it are not."""
    assert "Short end." in html_text.main_text(BARE) and html_text.main_text("<div>Short end.</div>") == ""


def test_cut_is_the_least_of_all_labellings():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(1, 9)
        terminals = [rng.randint(-9, 9) for _ in range(n)]
        edges = [(i, j, rng.randint(0, 6)) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.5]

        def cost(side, terminals=terminals, edges=edges):
            return sum(t for t, s in zip(terminals, side, strict=True) if t > 0 and not s) - sum(t for t, s in zip(terminals, side, strict=True) if t < 0 and s) + sum(c for i, j, c in edges if side[i] != side[j])

        assert cost(html_text.cut(terminals, edges)) == min(map(cost, itertools.product([True, False], repeat=n)))


def test_nulls_repeats_and_empty_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [(1, "u", None, "x", "y"), (None, None, "", "x", "y"), (2, "v", BROKEN, "x", "y"), (2, "v", BROKEN, "x", "y"), (3, None, "<", None, None), (4, "w", "<nav>a</nav>", None, None)]
    got = html_text.extract(spark.createDataFrame(rows, schema)).collect()
    told = html_text.main_text(BROKEN)
    assert sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in got) == [(0, "", "", 0), (1, "u", "", 0), (2, "v", told, len(told)), (2, "v", told, len(told)), (3, "", "", 0), (4, "w", "", 0)]
    assert html_text.extract(spark.createDataFrame([], schema)).count() == 0
    shown = html_text.block_labels(spark.createDataFrame(rows, schema)).where("page_id = 2").collect()
    assert len(shown) == 6 and all(r.content for r in shown)


@pytest.mark.parametrize("page", ["<p>word word. " * 100_000, "<div>" * 30_000 + "x", "<a " * 100_000, '<a href="' * 100_000, "<script>" * 50_000, "<p><a href=x>l</a>" * 30_000 + "<main>" + "<p>Some text here. " * 30_000, "&" * 200_000])
def test_long_odd_pages_take_linear_time(page):
    began = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - began < 20
