from __future__ import annotations

import itertools
import random
import time
from html.parser import HTMLParser

import pytest

from hemiciclo.llm.html_mincut import blocks_of, content_odds, cut_blocks, extract_main_text, main_text, minimum_cut
from hemiciclo.llm.queries import op1_html_text
from llm_helpers import SF2

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header class="site-header"><a href=/>Site</a><p>The best site of all the sites in town.</p></header>
<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div id="cookie-banner" class="cookie"><p>We use cookies to improve your experience on this website. <button>OK</button></p></div>
<div class="content post-with-comments"><h1>Big story &amp; more</h1><p>First long paragraph of the story, with <a href=x>a link</a> inside and many more words to read.</p><p>Short.</p>
<div class="ad-slot">Buy now! Great offers on all products, only this week in our shop.</div><ul><li>Point one of the list.</li><li>Point two</li></ul><blockquote>A quote</blockquote>
<aside><h3>Related</h3><ul><li><a href=q>Another story</a></li></ul></aside><p>Last&nbsp;paragraph ends
here.</p><form action=s><label>Mail</label><input name=m><button>Send</button></form></div>
<section id="comments"><h2>Comments</h2><article class="comment"><p>I think this is a very great article, thank you for writing it all down.</p></article></section>
<div class="sidebar"><h3>Popular</h3><p>Something popular that is long enough to look like a paragraph of text.</p></div>
<footer><p>&copy; 2024 Site. All rights reserved.</p></footer><script>var x="<p>no</p>"</script></body></html>"""


def test_article_without_the_rest():
    assert main_text(PAGE) == "Big story & more First long paragraph of the story, with a link inside and many more words to read. Short. Point one of the list. Point two A quote Last paragraph ends here."


@pytest.mark.parametrize(("page", "expected"), [(None, ""), ("", ""), ("<p>a<b>b</b>c<br>d <i>e</i></p>", "abc d e"), ("plain words only, no markup", "plain words only, no markup"), ("<article><p>x &lt;b&gt; &#233;&eacute;</p></article>", "x <b> éé"), ("<article><p>one<p>two<p><b>three</article>", "one two three"), ("<article>1 < 2 words <!-- no --> here</article>", "1 < 2 words here"), ("<article><p>cut <script>no", "cut")])
def test_small_pages(page, expected):
    assert main_text(page) == expected


def test_text_after_embed_stays():
    assert main_text("<article><p>a</p><embed src=x><p>b</p></article>") == "a b"
    assert main_text("<article><p>a<embed src=x></embed>b<embed src=y />c</p><p>d</p></article>") == "abc d"


@pytest.mark.parametrize("left_open", ["svg", "object data=x", "canvas", "video src=y", "noscript", "select", "math", "audio"])
def test_text_after_elements_that_are_never_closed_stays(left_open):
    assert main_text(f"<article><p>one one.</p><{left_open}><p>two two.</p></article>").endswith("two two.")


def test_unclosed_quotes_and_signs():
    assert main_text('<article><p class="a>one.</p><p>two.</p></article>') == "one. two."
    assert main_text("<article><p title='it's'>one.</p><p>a < b and \"c\" > d</p></article>") == 'one. a < b and "c" > d'
    assert main_text('<article><p title="a > b">one.</p><p data-x = \'>\'>two.</p></article>') == "one. two."


def test_the_cut_changes_labels():
    """A weak block amid a text is content, a good one amid menu entries is not: the edges outweigh the block's own odds."""
    weak = blocks_of("<div><p>The council met on Monday evening to talk about the new road through the old town.</p><p><a href=x>Map of the road</a> (PDF)</p><p>Most people who spoke were against it, as it would take the last of the green space.</p></div>")
    assert content_odds(weak[1]) < -1 and cut_blocks(weak)[1] == [True, True, True]
    good = blocks_of("<div><p>The council met on Monday evening to talk about the new road.</p></div><ul><li><a href=1>One</a><li><a href=2>Two</a><li>Read the story of the road.<li><a href=3>Three</a><li><a href=4>Four</a></ul>")
    assert content_odds(good[3]) > 0.3 and cut_blocks(good)[1] == [True, False, False, False, False, False]


@pytest.mark.parametrize("page", ["<article>" + "".join(f"<p>Word {i} of the text.</p><nav>Menu {i}</nav>" for i in range(20_000)) + "</article>", '<a href="x>link ' * 60_001, "<div>x" * 150_000, "<li>x" * 180_000, "<p>a<svg>" * 100_000, "<div>" * 20_000 + "</p></section>" * 60_000, "a < b " * 160_000, "<b '" * 200_000, "<!-- " * 200_000])
def test_pages_of_a_megabyte_take_seconds(page):
    start = time.process_time()
    text = main_text(page)
    assert time.process_time() - start < 15 and "Menu" not in text


def test_no_text_is_lost_in_blocks():
    assert " ".join(b.text for b in blocks_of("<div>a<ul><li>b<li>c</ul>d</div>e")) == "a b c d e"


def test_cut_is_minimal():
    rng = random.Random(3)
    for _ in range(400):
        n = rng.randint(1, 7)
        source, sink = [rng.randint(0, 9) for _ in range(n)], [rng.randint(0, 9) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.randint(0, 6)) for _ in range(rng.randint(0, 12))]
        cost = lambda side: sum(b if s else a for s, a, b in zip(side, source, sink, strict=True)) + sum(c for i, j, c in edges if side[i] != side[j])  # noqa: B023, E731
        assert cost(minimum_cut(source, sink, edges)) == min(map(cost, itertools.product([False, True], repeat=n)))


class Article(HTMLParser):
    """Characters inside <article>, with a space where a block or a line begins or ends."""

    def __init__(self):
        super().__init__()
        self.depth, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.out.append("" if tag in ("b", "a") else " ")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.out.append("" if tag in ("b", "a") else " ")

    def handle_data(self, data):
        if self.depth:
            self.out.append(data)


def test_query_equals_a_plain_reading(spark):
    """op1 over the whole table, whose pages keep their text in one article element."""
    rows = {r.page_id: r for r in op1_html_text(spark, SF2).collect()}
    pages = spark.read.parquet(f"{SF2}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for page in pages:
        plain = Article()
        plain.feed(page.html)
        text = " ".join("".join(plain.out).split())
        assert (rows[page.page_id].url, rows[page.page_id].text, rows[page.page_id].n_chars) == (page.url, text, len(text))


def test_table(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "v", ""), (3, "w", "<article>" + "<p>w</p>" * 5000 + "</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    out = extract_main_text(df).collect()
    assert [r.n_chars for r in out] == [len(r.text) for r in out] and out[4].n_chars == 9999 and out[2].text == "" == out[3].text
    assert extract_main_text(df.where("false")).count() == 0
