import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larder.llm.html import extract, main_text

PAGE = """<html><body class="has-sidebar home"><header class="site-header"><h1>Site</h1><nav><a href=x>a</a></nav></header>
<div id="cookie-notice"><p>We use cookies, and more, and more.</p></div><div class="wrap"><div class="post-body"><h2>My title</h2>
<p>First paragraph, with commas, and a <a href="#">link</a> &amp; more&nbsp;text.<p>Second   one<br>goes on.
<ul><li>one<li>two</ul><script>if (a<b) { "</p>" }</script><div class="ad-box">Buy now, buy!</div>
<blockquote>Quoted &lt;b&gt; &#233;</blockquote></div><div class="sidebar"><p>Popular, things, here, now, a long text that scores
high, really, yes, it, is.</p></div></div><section id="comments"><article class="comment"><p>I like this, a lot, really, this is
great, wow, such a comment, amazing.</p></article></section><form><p>Sign up, please</p></form><footer>(c)</footer></body></html>"""


def test_article_alone():
    assert main_text(PAGE) == "My title\nFirst paragraph, with commas, and a link & more text.\nSecond one goes on.\none\ntwo\nQuoted <b> é"


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain words", "plain words"), ("<p>a<p>b", "a\nb"), ("<div>x<br><br>y</div>", "x\ny"),
    ("<nav>menu</nav>", ""), ("<article><p>Only <b>this<br></article><footer>no</footer>", "Only this"),
    ('<article><p title="a>b">in</p></article>', "in"), ("<main><h1>T</h1><p>b &amp c</p></main><aside>no, no, no</aside>", "T\nb & c"),
    ("<div><h1>T</h1><div class=content><p>Some text, with a comma.</p></div></div>", "T\nSome text, with a comma."),
    ("<body><div class=menu><a href=1>a</a></div><p>1 < 2, so it goes.</p>", "1 < 2, so it goes."),
    ("<article><p>x</p><ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul></article>", "x"),
    ("<div class='main-content sidebar-right'><p>Text, here.</p></div><ul class=main-menu><li>Home, a, b, c, d, e</ul>", "Text, here."),
    ("<div class=content><p>Text, of it.</p><div class=content-ad><p>Buy, buy, buy, buy.</p></div></div><div class=article-footer>f, g</div>", "Text, of it."),
    ("<body class=comments-open><div class=post><div class=post-header><h2>T</h2></div><p>Text, it is.</p></div><div id=page-header>x, y</div>", "T\nText, it is."),
    ("<article class='post comments-closed'><p>Text.</p></article><div role=alert>No, no, no, no.</div><p hidden>No, no.</p>", "Text."),
    ("<article><header><h1>Head</h1></header><p>Text.</p><div class='comments'><p>No.</p></div></article>", "Head\nText."),
])
def test_pages(page, text):
    assert main_text(page) == text


LONG = "A long text, with commas, that goes on, and on, and on, so that it is, beyond doubt, the article of the page."


@pytest.mark.parametrize("page, text", [
    ("<article><p>a <svg width=1 /> b</p><p>c</p></article>", "a b\nc"), ("<article><p>a</p><object data=x><p>b</p><p>c</p></article>", "a\nb\nc"),
    ("<article><p>a</p><select name=x><p>b <b>c</b></p></article><p>d</p>", "a\nb c"),
    ("<article><p>a<object><object>no</object>no</object> b</p></article>", "a b"), ("<article><p>a<svg><g><title/><text>no</text></g></svg> b</p><p>c</p></article>", "a b\nc"),
    ("<article><p>a</p><canvas><p>b</p><select><option>no</select><p>c</p></article>", "a\nb\nc"), ("<article><p>a<video><p>no</p>no<br></video> b</p></article>", "a b"),
    (f"<body><p>So it begins.</p><div><p>{LONG}</p></div><pre>x = 1</pre><ul><li>one<li>two</ul><p>End.</p><ul><li><a href=x>More</a></ul>", f"So it begins.\n{LONG}\nx = 1\none\ntwo\nEnd."),
    ("<form><p>A short text, all in a form.</p></form>", "A short text, all in a form."), ("<div class=banner><p>Short.</p></div>", "Short."),
    ("<nav><ul><li>Home<li>News</ul></nav>", ""), ("<form hidden><p>No.</p></form>", ""),
])
def test_nothing_of_the_article_is_dropped(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("page, text", [
    (f"<main><h1>T</h1><p>{LONG}</p><section class=related-work><h2>Related</h2><p>Others did, too.</p></section></main>", f"T\n{LONG}\nRelated\nOthers did, too."),
    (f"<div class=post><h2>T</h2><div class=legal-guide><p>{LONG}</p><ul><li>one</ul></div></div><div class=related-links><p>{LONG}</p></div>", f"T\n{LONG}\none"),
    ("<article><p>In.</p><div class=share-price><p>Shares rose 5 percent, to 20.</p></div><div class=share-buttons><p>Tweet this.</p></div></article>", "In.\nShares rose 5 percent, to 20."),
    ("<article><p>In.</p><div class=notice-of-meeting><p>Meet at noon.</p></div><div class=cookie-notice><p>We use cookies.</p></div></article>", "In.\nMeet at noon."),
    ("<article><p>In.</p><div class=promo-spring><p>Buy now</p></div><div id=related-reads><p><a href=x>Another, longer text to read.</a></p></div></article>", "In."),
    (f"<div class=story><p>{LONG}</p></div><div class=promo-spring><p>Buy now, or later, or never.</p></div><div class='sidebar-x9 comment-list'><p>No, no, no.</p></div>", LONG),
    (f"<div class=story><p>{LONG}</p></div><div id=reader-comments><p>{LONG}</p><p>{LONG}</p></div>", LONG),
])
def test_names_with_other_words_hide_no_article(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("part", ["<b>x<br><br>", "<div><p>x, y", "<a href=x>x<h2>", "<ul><li>x", "<table><tr><td>x", "<b><div>x", "<i><p>x</p>", "<nav><p>x", '<div class="related-work">x'])
def test_time_grows_with_the_page(part):
    """Eight times the page takes far less than sixty-four times as long."""
    took = []
    for n in (2500, 20000):
        start = time.process_time()
        main_text(part * n)
        took.append(time.process_time() - start)
    assert took[1] < 24 * took[0] + 0.5


@pytest.mark.parametrize("page", ["<svg>" * 50000, "<object><p>" * 30000 + "x", "<svg></p>" * 30000, "<select></div>" * 30000 + "</select>" * 30000])
def test_embedded_elements_stay_linear(page):
    main_text(page)


@pytest.mark.parametrize("page", ["<" * 50000, "<b>" * 50000, "<div>" * 50000 + "x", "<!--" * 50000, '<a href="' * 50000, "<p>x</b>" * 50000])
def test_bad_markup_stays_linear(page):
    main_text(page)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<a href=x>", "</a>", "<ul>", "<li>", "x, y ", "&amp;", "<b", '"', "<!--", "-->", "<td>", "</ul>", "<script>", "</script>"])))
def test_any_markup_gives_clean_blocks(parts):
    text = main_text("".join(parts))
    assert all(line and line == " ".join(line.split()) for line in text.split("\n")) or text == ""


def test_rows_of_pages(spark):
    rows = [(2**60 + 1, "u", PAGE), (None, None, None), (2**60 + 1, "u", PAGE), (3, "v", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = extract(pages).collect()
    assert sorted((r.page_id or 0, r.url, r.n_chars) for r in got if r.n_chars) == [(2**60 + 1, "u", len(main_text(PAGE)))] * 2
    assert sorted((r.page_id or 0, r.text) for r in got if not r.n_chars) == [(0, ""), (3, "")]
    assert extract(pages.limit(0)).count() == 0


def test_table_equals_its_articles(table):
    import re
    from html import unescape

    pages = table("pages")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:h1|p)>", article)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)
