import html
import re

import pytest
from pyspark.sql import functions as F

from galvanite.llm.html_extraction import blocks_of, extract, main_text, stop_share
from galvanite.llm.queries import op13_html_extraction

LONG = "It was in the year that the house was built by the river, and they have lived in it with their friends for as long as there was water, which is a long time for a house of that kind, as you will know."
MORE = "The people of the town said that it would not be there for more than ten years, but it has been there for two hundred of them, and from the hill you can see what it was like when it was new and the paint was on it."
COMMENT = "I have read this with joy and it is the best that was written about the house, and I would like to know if there is more of it in the archive of the town or if that is all that they have about it."


def plain(page):
    """The article of a generated page, by cutting its text."""
    inner = page[page.index("<article>") :].split("</article>")[0].replace("<br>", " ")
    inner = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:h1|p|article)>", "\0", inner))
    return "\n\n".join(x for x in (" ".join(html.unescape(y).split()) for y in inner.split("\0")) if x)


def test_given_pages_give_their_articles(spark):
    sf_dir = "/root/testdata/sf0.01"
    found = {(r.page_id, r.url): (r.text, r.n_chars) for r in op13_html_extraction(spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(found) == len(pages) == 250
    for page in pages:
        wanted = plain(page.html)
        assert found[page.page_id, page.url] == (wanted, len(wanted))


BOILER = {
    "menu": f'<div class="main-menu"><a href="/">Home</a> {LONG}</div>',
    "nav": f"<nav><p>{LONG}</p></nav>",
    "header": f"<header><h1>Site of the town</h1><p>{LONG}</p></header>",
    "footer": f"<footer><div><p>{LONG}</p></div></footer>",
    "sidebar": f'<div id="sidebarLeft"><div><p>{LONG}</p></div></div>',
    "notice": f'<div role="dialog"><p>{LONG}</p></div>',
    "cookies": f'<section class="cookie_notice"><p>{LONG}</p></section>',
    "advert": f'<div class="ad"><p>{LONG}</p></div>',
    "form": f"<form><label>Name</label><p>{LONG}</p><button>Send</button></form>",
    "script": f'<script>var t = "</p><p>{LONG}";</script>',
    "style": f"<style>p {{ content: '{LONG}' }}</style>",
    "comments": f'<section id="comments"><article class="comment"><p>{COMMENT}</p></article></section>',
    "hidden": f'<div style="display: none"><p>{LONG}</p></div>',
    "markup": f"<!-- <p>{LONG}</p> --><noscript><p>{LONG}</p></noscript>",
}


@pytest.mark.parametrize("kind", BOILER)
@pytest.mark.parametrize("container", ["article", "main", 'div class="post-content"', "div"])
def test_boilerplate_goes_and_the_article_stays(kind, container):
    tag = container.split()[0]
    around = f"<!DOCTYPE html><html><head><title>T</title></head><body>{BOILER[kind]}<{container}><h1>The old house</h1><p>{LONG}</p><p>A short one.</p><p>{MORE}</p></{tag}>{BOILER[kind]}</body></html>"
    assert main_text(around).split("\n\n") == ["The old house", LONG, "A short one.", MORE]
    if kind == "header":  # inside an article its headings stay
        return
    inside = f"<body><{container}><h2>The old house</h2><p>{LONG}</p>{BOILER[kind]}<p>{MORE}</p></{tag}></body>"
    assert main_text(inside).split("\n\n") == ["The old house", LONG, MORE]


def test_link_lists_and_short_blocks():
    links = "<ul>" + "".join(f'<li><a href="/{i}">Link number {i} of the page</a></li>' for i in range(5)) + "</ul>"
    page = f"<body>{links}<div>Top</div><h1>Title</h1><p>{LONG}</p><p>Short.</p><p>{MORE}</p>{links}<div>Bottom</div></body>"
    assert main_text(page).split("\n\n") == ["Title", LONG, "Short.", MORE]
    assert main_text(f"<article><p>{LONG}</p>{links}<p>Between.</p>{links}<p>End.</p></article>").split("\n\n") == [LONG, "End."]
    assert main_text("<article><h1>Only</h1><p>Few words.</p></article>") == "Only\n\nFew words."
    assert main_text(f"<div>© 2024 {LONG[:90]}</div><p>{LONG}</p>") == LONG


def test_markup_of_all_kinds():
    assert main_text("<ARTICLE><P CLASS=x>1 &lt; 2 &amp;amp; 3&nbsp;&#228;&#xe4; a<b\n\t c</P  ></ARTICLE>") == "1 < 2 &amp; 3 ää a"  # an open tag runs to the next >
    assert main_text("<article>a < b <p title='x > y'>c<i>d</i>e<br/>f<td>g<td>h</article>") == "a < b\n\ncde f g h"
    assert main_text('<article><p title="5" tall">x</p><a href="y">z</a> and more text</article>') == "x\n\nz and more text"
    assert main_text("<article><ul><li>one<li>two<ul><li>inner</ul><li>three</ul>") == "one\n\ntwo\n\ninner\n\nthree"
    assert main_text("<article><p>one<nav>no<p>no</nav><p>two</article>") == "one\n\ntwo"
    assert main_text("<article><p>one<script>never closed <p>two") == "one"
    assert main_text("<article>one<!-- never closed <p>two") == "one"
    assert main_text("<article></div></p></b>one</section>two</article>") == "one\n\ntwo"
    assert main_text('<form action="/"><article><p>one</p><form><p>no</p></form></article></form>') == "one"
    assert main_text("<article><header><h1>one</h1><p>by no one</p></header><p>two</article>") == "one\n\ntwo"
    assert [main_text(x) for x in ("", "plain", "<", "<>", "</", "<p", "<article>", "&amp")] == [""] * 8


def test_other_scripts_are_judged_by_length_and_links():
    text = "これは長い文章です。" * 30
    assert stop_share(text) is None and stop_share("the cat of the town") == 0.6
    assert main_text(f"<body><div>メニュー</div><p>{text}</p><div>終</div></body>") == text


def test_deep_and_long_pages_take_linear_time():
    deep = "<div>" * 100_000 + LONG + "</div>" * 100_000
    assert main_text(f"<article>{deep}</article>") == LONG
    many = "".join(f"<p>{LONG}</p></span></i></section>" for _ in range(20_000))
    assert main_text(f"<article>{many}</article>").count(LONG) == 20_000
    for odd in ('<a "', "<p =", "<!-", "<a href='", "&#", "<li>", "<script>", "</p", "<<"):
        assert isinstance(blocks_of(odd * 50_000), list)


def test_odd_rows(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", 7), (1, "u", f"<article><p>{LONG}</p></article>", 7), (None, None, None, None), (2, "v", "", 1)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int").withColumn("text", F.lit("x"))
    found = extract(frame)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in found.collect()) == [("1", LONG, len(LONG))] * 2 + [("2", "", 0), ("None", "", 0)]
    assert extract(frame.limit(0)).collect() == []
    assert extract(frame, carry=["text", "n_chars"]).columns == ["text", "n_chars", "text", "n_chars"]
