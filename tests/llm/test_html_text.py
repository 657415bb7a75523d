"""Operator 8 against the article of every page, hand-made layouts, and its defined edge cases."""

import html
import re
import time

import pytest

from conftest import SF01
from tidemark.llm.html_text import densities, extract_text, main_text, op8_html_extraction, parse


def article(page):
    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", body))).split())


def test_whole_table_equals_the_articles(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF01}/pages.parquet").collect()}
    rows = op8_html_extraction(spark, SF01).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == article(pages[r.page_id]) and r.n_chars == len(r.text)


P = "<p>Long enough a paragraph of running text, with a <a href=x>link</a> in it and more words after it.</p>"


@pytest.mark.parametrize("page", [
    f"<body><div class='menu'><a>A</a></div><div id=content><h1>Head</h1>{P}{P}</div><div class=footer>Foot</div></body>",
    f"<html><body><header><h1>Site</h1></header><main><h1>Head</h1><div class=text>{P}{P}</div></main><div id='comments'><p>Nice!</p></div>",
    f"<body><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul><h1>Head</h1>{P}{P}<form><p>Name</p><input></form></body>",
    f"<body><div class='cookie-notice'><p>We use cookies, a great many of them, in all of our pages.</p></div><article><h1>Head</h1>{P}"
    f"<aside>Related: x</aside><script>if (a < b) '<p>no</p>'</script>{P}</article></body>",
])
def test_layouts(page):
    text = "Long enough a paragraph of running text, with a link in it and more words after it."
    assert main_text(page) == f"Head {text} {text}"


def test_broken_markup_and_references():
    assert main_text(None) == main_text("") == main_text("<html><body></body></html>") == main_text("<!-- x") == ""
    assert main_text("plain &lt;b&gt; &amp;amp; \n\t text&nbsp;x") == "plain <b> &amp; text x"
    assert main_text("<article><p>one<p><b>two</b>three<br>four</article>") == "one twothree four"
    assert main_text("<article><p title='a > b'>x</p><p>a < b</p></div></article>tail") .startswith("x a < b")
    assert main_text("<body><nav><div>menu</body><article><p>never closed nav") in ("", "never closed nav")
    deep = "<div>" * 5000 + "<p>deep</p>" + "</div>" * 5000
    assert main_text(deep) == "deep"
    assert main_text("<article><p>" + "word " * 200_000 + "</p></article>").count("word") == 200_000
    order = densities(parse("<body><div><p>abc</p></div><ul><li><a>abc</a></li></ul></body>"))
    assert {n.name for n in order} == {"body", "div", "p", "ul", "li"}


def test_rows_pass_one_by_one(spark):
    rows = [(1, None, None), (1, None, None), (None, "u", "<p>x</p>"), (2, "u", "")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    out = extract_text(df)
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in out.collect()) == [(0, "x", 1), (1, "", 0), (1, "", 0), (2, "", 0)]
    assert extract_text(df.limit(0)).count() == 0


TEXT = "Long enough a paragraph of running text, with a link in it and more words after it."


@pytest.mark.parametrize("named", ["layout has-sidebar", "no-sidebar", "container with-nav", "page header-fixed", "two-column right-sidebar",
                                   "sidebar"])
def test_wrappers_with_boilerplate_names_keep_the_article(named):
    page = f"<body><div class='{named}'><div><h1>Head</h1>{P}{P}</div><div class=sidebar><p>Aside text</p></div></div></body>"
    assert main_text(page) == f"Head {TEXT} {TEXT}"


def test_names_of_parts_of_an_article_stay():
    page = f"<article><h1>Head</h1>{P}<section id='legal-basis'>{P}</section><h2 id='related-work'>Work</h2>{P}<div class='share-box'>x</div></article>"
    assert main_text(page) == f"Head {TEXT} {TEXT} Work {TEXT}"


@pytest.mark.parametrize("page", [
    f"<body><div><h1>Head</h1><p class='notice'>Small note{P}{P}</div></body>",
    f"<body><div><h1>Head</h1><p role=alert>Small note<div>{P}{P}</div></div></body>",
    f"<body><div><h1>Head</h1><ul><li class='share'>Share</ul>{P}{P}</div></body>",
    f"<body><section><nav><a href=1>One</a></section><div><h1>Head</h1>{P}{P}</div></body>",
    f"<html><body><nav><a href=1>One</a></body><article><h1>Head</h1>{P}{P}</article></html>",
])
def test_dropped_elements_without_an_end_tag(page):
    assert main_text(page) == f"Head {TEXT} {TEXT}"


def test_an_item_ends_a_dropped_item():
    assert main_text("<article><p>Before</p><ul><li class=share>Share<li>Item one<li>Item two</ul><p>After</p></article>") \
        == "Before Item one Item two After"


def test_quotes_open_values_only_after_an_equals_sign():
    page = f"<body><div id=content><h1>Head</h1>{P}<p><a title=it's href=x>link</a> words</p><p>That's it</p>{P}</div></body>"
    text = "Long enough a paragraph of running text, with a link in it and more words after it."
    assert main_text(page) == f"Head {text} link words That's it {text}"
    assert main_text("<article><p title = 'a > b' x=\"c > d\" y=1>x</p></article>") == "x"
    assert main_text("<article><p title='never closed>x</p><p>y</p></article>") == "x y"


@pytest.mark.parametrize("page", [
    f"<body><div class=head><h1>Head</h1></div><div class=text>{P}{P}</div></body>",
    f"<body><article><header><h1>Head</h1></header>{P}{P}</article></body>",
    f"<body><div id=page><h1>Head</h1>{P}{P}<div class='post-comments'><p>A reader says so, and in a great many words.</p></div></div></body>",
    f"<body><div id=page><h1>Head</h1>{P}{P}<div id='user_comments'><p>A reader says so, and in a great many words.</p></div></div></body>",
    f"<body><main><div class='entry-header'><h1>Head</h1></div>{P}{P}<section class='comments-section'><p>Me too.</p></section></main></body>",
])
def test_nested_titles_and_reader_comments(page):
    text = "Long enough a paragraph of running text, with a link in it and more words after it."
    assert main_text(page) == f"Head {text} {text}"


def test_a_list_of_sources_in_an_article_stays():
    page = f"<article><h1>Head</h1>{P}<ul><li><a href=1>First source</a></li><li><a href=2>Second source</a></li></ul></article>"
    assert main_text(page).endswith("after it. First source Second source")


@pytest.mark.parametrize("part", ['<a "x ', "<a x='", '<a x="', "<b>", "</i>", "<h1>", "<p>", "<div>", "<div></div>", "<aside></aside>", "<li>",
                                  "<nav>x</nav>", "<a x='>\"", "<!-- ", "<![CDATA[", "<script>", "</script ", "<!x ", "<", "&", "='"])
def test_hostile_pages_take_linear_time(part):
    at = time.perf_counter()
    for page in (part * (1_000_000 // len(part)), "<b>" * 50_000 + part * 50_000, "<b><nav>" + "<i>" * 50_000 + "</b>" * 50_000 + part * 50_000,
                 "<p>x</p>" + part * 100_000 + ">"):
        main_text(page)
    assert time.perf_counter() - at < 30
