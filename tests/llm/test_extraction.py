from __future__ import annotations

import html
import re

import pytest

from tonegap.llm import extraction
from tonegap.llm.queries import QUERIES


def plain(source):
    article = re.search(r"<article>(.*?)(</article>|$)", source, re.S)[1]
    parts = (re.sub(r"</?b>", "", p.replace("<br>", " ")) for p in re.split(r"</?(?:p|h1)>", article))
    return "\n".join(x for p in parts if (x := " ".join(html.unescape(p).split())))


def test_same_as_a_plain_parse(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.page_id: (r.text, r.n_chars) for r in QUERIES["op8_main_text"].build(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        assert got[r.page_id] == (plain(r.html), len(plain(r.html)))


PAGE = """<html><body><header class="site-header"><a href=/>Home</a></header><div class="cookie-notice">We use cookies everywhere, accept them all please</div>
<div class="content"><div class="post-{n}"><h1>Title &amp; more</h1><p>First   para with <a href=x>link</a> text.<p>Second<br>line <i>x</i>
<ul><li>one<li>two</ul><form><input value=1>Search</form></div><div class="comments"><p>Reader says very long things about it, longer than the text itself is</p></div></div>
<aside>side</aside><div id="ad-7">Buy this now</div><footer>foot</footer><script>var a = "<p>no</p>";</script></body></html>"""


def test_other_layouts():
    text = "Title & more\nFirst para with link text.\nSecond line x\none\ntwo"
    path, score = extraction.best_path(PAGE.replace("{n}", "12"))
    assert path == "html/body/div.content/div.post-#" and score > 0
    assert extraction.main_text(PAGE.replace("{n}", "9"), path) == text
    assert extraction.main_text("<main><nav>n</nav><p>a</p><p hidden>b</p><p>c</main>", None) == "a\nc"
    assert extraction.main_text("<article><header><h1>T</h1></header><p>a</p><footer>x</footer></article>", None) == "T\na"
    assert extraction.main_text("<table><tr><td>a<td>b<tr><td>c</table>", None) == "a\nb\nc"


def test_parts_around_the_longest_container():
    page = "<html><body><div class=links><a href=1>One place</a> <a href=2>Other place</a></div><div class=content><h1>T</h1><p>lead</p><div class=body><p>{}</p></div><div class=more><p>{}</p></div></div></body></html>"
    long, more = "long text " * 30, "more text " * 9
    whole = "\n".join(("T", "lead", long.strip(), more.strip()))
    path, _ = extraction.best_path(page.format(long, more))
    assert path == "html/body/div.content"
    assert extraction.main_text(page.format(long, more), path) == extraction.main_text(page.format(long, more), None) == whole
    assert extraction.main_text(page.format("short", more * 5), "html/body/div.content/div.body").startswith("T\nlead\nshort\nmore")
    listed = "<body><div class=wrap><div class=list><a href=1>A linked line of text</a></div><div class=body><p>The text</p></div></div></body>"
    assert extraction.main_text(listed, None) == "The text"


@pytest.mark.parametrize(("source", "text"), [(None, ""), ("", ""), ("<", "<"), ("a<b>c", "ac"), ("<p>x</p", "x"), ("</p></p>", ""), ("<script>alert", ""), ("&am &amp; &#65;", "&am & A"), ("<!-- x", ""), ("<a " * 2000, ""), ("<div>" * 20_000 + "x", "x"), ("<p>" + "y " * 50_000, ("y " * 50_000).strip())])
def test_broken_pages(source, text):
    assert extraction.main_text(source, None) == text
    assert extraction.main_text(source, "html/body") == text


def test_the_host_decides(spark):
    """A page whose longest container is an insertion follows the path of its host's other pages."""
    usual = '<body><div class="story"><p>{} some text of the story goes here</p></div><div class="promoted"><p>{}</p></div></body>'
    rows = [(k, f"http://h.org/{k}", usual.format(k, "short")) for k in range(4)] + [(9, "http://h.org/9", usual.format(9, "insertion " * 60)), (10, None, None), (None, "x", "<p>t</p>"), (9, "http://h.org/9", usual.format(9, "insertion " * 60))]
    pages = spark.createDataFrame([(*r, "p", "h") for r in rows], "page_id long, url string, html string, path string, host string")
    got = sorted(map(tuple, extraction.extract_text(pages).collect()), key=str)
    assert [r[2] for r in got if r[0] == 9] == ["9 some text of the story goes here"] * 2
    assert (10, None, "", 0) in got and (None, "x", "t", 1) in got and len(got) == len(rows)
    assert extraction.extract_text(pages.limit(0)).count() == 0
