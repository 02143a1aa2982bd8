"""HTML extraction: cases, and the query against a plain reading of whole pages."""

import html
import re
import time

import pytest

from quillon.llm import html_text
from quillon.runtime import table

SF = "/root/testdata/sf0.001"
LONG = "The end of the story is that it was as good as any of those. " * 3


@pytest.mark.parametrize(
    "before",
    ["<html><head><title>t</title><script>'<p>'</script><meta charset=x>", "<head>", "<svg viewBox='0 0 1 1'/>", "<math/>", "<iframe src='x'/>", "<iframe src='x'>", "<object data='x'>", "<canvas>", "<body><svg>"],
)
def test_raw_elements_without_end_do_not_swallow_the_page(before):
    text = "It was the best of times and it was the worst of times, and we had all of it before us as they say in the book."
    assert html_text.main_text(f"{before}<p>{text}</p>") == text
    assert html_text.main_text(f"{before}<p>{text}</p><svg><text>no</text></svg>").startswith(text) or before in ("<body><svg>",)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>if (a<b) "</p>"</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=x>One</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy the best of all of it now.</div>
<article><header><h1>Title &amp; more</h1></header><p>The  first\n of&nbsp;the <b>paragraphs</b>.<br>Next line &eacute;&#233;&#xe9;.<p>x</p><ul><li>a point</li></ul>
<div id="comments"><p>The reader said that it was one of the best.</p></div><aside>side</aside></article>
<form><label>Name</label></form><footer>&copy; the owner of the site</footer></body></html>"""


def test_html():
    assert html_text.main_text(PAGE) == "Title & more\n\nThe first of the paragraphs. Next line ééé.\n\nx\n\na point"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    assert html_text.main_text("<article><p>cut &am") == "cut &am" and html_text.main_text("<article><p>text</p><p") == "text"
    assert html_text.main_text("<article>1 < 2 and 3 > 2</article>") == "1 < 2 and 3 > 2"
    long = "The end of the story is that it was as good as any. " * 3
    mixed = f"<div><p>{long}</p><p>short</p><p>{long}</p></div><div><a href=x>{long}</a></div><p>tail</p>"
    assert html_text.main_text(mixed).split("\n\n") == [long.strip(), "short", long.strip()]
    assert len(html_text.main_text("<article>" + "<p>the word of it</p>" * 50_000).split("\n\n")) == 50_000


def test_html_frames(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "old"), (2, None, None, "old"), (2, None, None, "old")], "page_id long, url string, html string, text string")
    rows = html_text.extract(df).collect()
    assert [r["n_chars"] for r in rows] == [len(r["text"]) for r in rows] and rows[1]["text"] == "" and len(rows) == 3


def test_scripts_do_not_hide_what_follows():
    assert html_text.main_text("<article><script>x = \"<a href='\";</script><p>it's the text</p></article>") == "it's the text"


def plain(page):
    """The article of a generated page, cut at its headings and paragraphs."""
    m = re.search(r"<article>(.*?)(</article>|$)", page, re.S)
    parts = re.split(r"</?(?:h1|p)>", m[1]) if m else []
    parts = [" ".join(html.unescape(re.sub(r"</?b>", "", p.replace("<br>", " "))).split()) for p in parts]
    return "\n\n".join(p for p in parts if p)


def test_query_against_plain_reading(spark):
    rows = {r["page_id"]: r for r in html_text.op2_html_text(spark, SF).collect()}
    pages = table(spark, SF, "pages").collect()
    assert len(rows) == len(pages)
    for p in pages:
        want = plain(p["html"] or "")
        assert (rows[p["page_id"]]["url"], rows[p["page_id"]]["text"], rows[p["page_id"]]["n_chars"]) == (p["url"], want, len(want))


def test_rules_decide_inside_articles():
    text = LONG.strip()
    ends = f"<article><p>{LONG}</p><p>Buy cheap shoes now at half price</p><p><a href=x>Read next</a></p><p>Share on Twitter</p></article>"
    assert html_text.main_text(ends) == text
    between = f"<article><p>{LONG}</p><p>Buy cheap shoes now at half price</p><p>{LONG}</p><p><a href=x>Read next</a></p><p>Be.</p><p>{LONG}</p><div>Share on Twitter</div></article>"
    assert html_text.main_text(between) == "\n\n".join([text, text, text]) or html_text.main_text(between) == "\n\n".join([text, text, "Be.", text])
    short = "<article><h1>Name</h1><p>Be.</p><p>Few words.</p></article><footer>x</footer>"
    assert html_text.main_text(short) == "Name\n\nBe.\n\nFew words."


def test_opaque_names():
    page = f"""<body><div class=x1><a href=a>Home</a> <a href=b>About</a></div><div class=q><h1>A title</h1><p>{LONG}</p><p>Short.</p>
    <p>{LONG}</p></div><div class=z9>Subscribe to our newsletter and get the best stories of the week in your inbox</div>
    <div class=z8>We use cookies to improve your experience on our site and to show you content that is of use.</div></body>"""
    assert html_text.main_text(page).split("\n\n") == ["A title", LONG.strip(), "Short.", LONG.strip()]


def test_names_weigh():
    """A weak name tips a short block and not a long one of many stop words; a name of foreign prose outweighs both."""
    page = "<div><p>{0}</p><div class='{1}'>{2}</div><p>{0}</p></div>"
    assert "Some words" not in html_text.main_text(page.format(LONG, "promo", "Some words"))
    assert html_text.main_text(page.format(LONG, "promo", LONG)).count("story") == 9
    assert html_text.main_text(page.format(LONG, "comments", LONG)).count("story") == 6


def test_neighbours():
    blocks = [html_text.Block(t, 0, "p", False, 0) for t in (LONG, "x", "y", "no 1 2 3 4")]
    blocks[3].linked = len(blocks[3].text)
    html_text.label(blocks)
    assert [b.label for b in blocks] == [1, 1, 0, 0]


@pytest.mark.parametrize("part", [f"<p>{LONG}</p><p>x</p>", "<span>a<p>some words of it</p>", "<svg><object>", '<p><a href="x>b</p>', "<div><p>a", "</b></i><b>", "<article><p>x", "<p><a href=x>y</a></p>"])
def test_time_is_linear(part):
    def seconds(n):
        began = time.perf_counter()
        html_text.main_text(part * n)
        return time.perf_counter() - began

    seconds(100)
    assert seconds(16_000) < 40 * seconds(2_000) + 0.5
