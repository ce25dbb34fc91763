import os
import re
import time
from html import unescape

import pyarrow.parquet as pq
import pytest

from quillmill.llm.html_extract import extract_main_text, main_text

P1 = "The river, wide and slow, carried the boats past the mill, the church, and the old market square."
P2 = "Nobody in the village remembered who had built the bridge, or why it had been left unfinished."


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{margin:0}}</style><script>var t='</p>';</script>{head}</head><body>{body}</body></html>"


def test_article_with_furniture():
    html = page(f"<nav><ul><li><a href='/a'>Home</a></li></ul></nav><div class=ad>Buy, buy, buy now and save a lot.</div><article><h1>Title &amp; more</h1><p><b>{P1}<br><p>{P2} &eacute;&#x41;</p></article><footer>&copy; x</footer>")
    assert main_text(html) == f"Title & more\n\n{P1}\n\n{P2} éA"


def test_divs_sidebars_comments_cookies_forms():
    html = page(f"""<div id="cookie-notice"><p>We use cookies, and more cookies, and partners, and so on, to improve your experience.</p></div>
    <header class="site-header"><h1>Site</h1></header>
    <div class="wrap"><div class="sidebar"><p>Popular, trending, and hot posts, all the time, every day.</p></div>
    <div class="post-content"><h2>Head</h2><p>{P1}</p>\n<ul><li>One   item</li><li>Two items</li></ul><p>{P2}</p><form><p>Name, mail, password, and so on.</p></form>
    <div class="share"><a href=x>Share</a> <a href=y>Tweet</a></div></div>
    <div id="comments"><h3>Comments</h3><p>I, for one, agree, and so does my cat, who, by the way, says hello to everyone here.</p></div></div><footer><p>All rights, reserved.</p></footer>""")
    assert main_text(html) == f"Head\n\n{P1}\n\nOne item\n\nTwo items\n\n{P2}"


def test_short_article_beats_longer_footer():
    html = page("<nav><a href=1>One</a><a href=2>Two</a></nav><article><h1>Re.</h1><p><b>Re.</article><footer>&copy; example &middot; A long sentence, with commas, in the footer, that goes on.</footer>")
    assert main_text(html) == "Re.\n\nRe."


def test_odd_input():
    assert [main_text(x) for x in (None, "", "   ", "<script>x", "<p", "</p></div>", "<!-- x")] == [""] * 7
    assert main_text("<>") == "<>"  # no tag: it is text
    assert main_text("plain words only") == "plain words only"
    deep = "<div>" * 20000 + P1 + "</div>" * 20000
    assert main_text(deep) == P1
    start = time.time()
    main_text("<" * 200_000)
    main_text("<a " + "x='" * 60_000)
    main_text("<p>" + P1 * 20_000)
    assert time.time() - start < 20


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", page(f"<article><p>{P1}</p></article>"), "t"), (1, None, None, "t"), (None, "v", "", "t")], "page_id long, url string, html string, text string")
    out = sorted(map(tuple, extract_main_text(df).collect()), key=str)
    assert out == sorted([(1, "u", P1, len(P1)), (1, None, "", 0), (None, "v", "", 0)], key=str)
    assert extract_main_text(df.limit(0)).count() == 0


PAGES = "/root/testdata/sf0.01/pages.parquet"


def gold(html):
    """The blocks of a page's only article, by its own tags: an independent reading of pages whose article is marked."""
    inside = re.search(r"<article[^>]*>(.*?)</article>", html, re.S)[1]
    parts = re.split(r"</?(?:p|h1)\b[^>]*>", re.sub(r"<br[^>]*>", " ", inside))
    blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts]
    return "\n\n".join(b for b in blocks if b)


@pytest.mark.skipif(not os.path.exists(PAGES), reason="no test data here")
def test_marked_articles_come_out_whole_and_alone():
    rows = pq.read_table(PAGES, columns=["html"]).column("html").to_pylist()
    assert len(rows) > 100
    assert [main_text(h) for h in rows] == [gold(h) for h in rows]


@pytest.mark.skipif(not os.path.exists(PAGES), reason="no test data here")
def test_articles_without_their_mark_come_out_too():
    """The same pages with the article as a div: most of it, and nothing of what stands around it."""
    rows = pq.read_table(PAGES, columns=["html"]).column("html").to_pylist()
    whole = 0
    for h in rows:
        got = main_text(h.replace("<article>", "<div>").replace("</article>", "</div>")).split("\n\n")
        want = gold(h).split("\n\n")
        assert set(got) <= set(want)
        whole += got == want
    assert whole >= 0.95 * len(rows)


def test_ties_go_to_the_first_container_and_long_pages_are_read_whole():
    two = f"<div><p>{P1}</p></div>"
    assert main_text(page(f"<section>{two}</section><footer>x</footer>")) == P1
    many = "".join(f"<p>{P1} {i}</p>" for i in range(20_000))
    assert main_text(page(f"<article>{many}</article>")).count("\n\n") == 19_999
