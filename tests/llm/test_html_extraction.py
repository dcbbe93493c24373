import html
import re

import pytest

from subgrade.llm import maintext
from subgrade.llm.maintext import main_text
from tests.conftest import DATA

A = "The first paragraph of the story tells, at some length, what happened in the town on that day, and why."
B = "A second one follows; it has commas, points and all that prose has, so that it looks like prose."
C = "Short end."
MENU = '<ul><li><a href="/a">Home</a></li><li><a href="/b">News, today.</a></li><li><a href="/c">About us</a></li></ul>'


def plain(source):
    """The text of the given table's pages by plain patterns."""
    inner = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    parts = [re.sub(r"</?b>", "", x).replace("<br>", " ") for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(t for t in (" ".join(html.unescape(x).split()) for x in parts) if t)


def test_query_against_plain_patterns(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    rows = maintext.op13_html_extraction(spark, str(DATA)).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, plain(pages[r.page_id].html), len(r.text))


@pytest.mark.parametrize("page", [
    f"<html><body><header><h1>Site</h1>{MENU}</header><main><h1>T</h1><p>{A}</p><p>{B}</p><p>{C}</p></main><footer>Imprint, all rights.</footer></body></html>",
    f"<body><div id=top>{MENU}</div><div id=content><h1>T</h1><p>{A}<p>{B}<p>{C}</div><div class=sidebar><p>{A}</p><p>{B}</p></div></body>",
    f"<body><div class='nav-bar'>{MENU}</div><div class='post'><div class='post-body'><h1>T</h1><p>{A}</p><div><p>{B}</p></div><p>{C}</p></div></div><div id='comments'><p>{A} I agree.</p></div>",
    f"<article><header class='article-header'><h1>T</h1><p class=share>Share this, please.</p></header><p>{A}</p><aside><p>{B} {B}</p></aside><p>{B}</p><p>{C}</p><footer>By someone.</footer></article>",
    f"<body class='has-sidebar'><div class='cookie-notice'><p>{A}</p></div><form><p>{B}</p></form><article><h1>T</h1><p>{A}</p><p>{B}</p><p>{C}</p></article><article class='comment'><p>{B}</p></article></body>",
    f"<table><tr><td class=menu>{MENU}<td><h1>T</h1><p>{A}</p><p>{B}</p><p>{C}</p></table>",
    f"<article><h1>T</h1><p>{A}</p><div style='display: none'>{B}</div><p hidden>{B}</p><p>{B}</p><section role=complementary>{A}</section><p>{C}</p>",
    f"<div class='content-with-sidebar'><div class='main-text'><h1>T</h1><p>{A}</p><p>{B}</p><p>{C}</p></div><div class='right sidebarBox related'><p>{A}</p></div></div>",
])
def test_layouts(page):
    assert main_text(page) == f"T\n{A}\n{B}\n{C}"


@pytest.mark.parametrize("page, text", [
    ("", ""),
    (None, ""),
    (MENU, ""),
    ("just words, no markup.", "just words, no markup."),
    ("<article><p>a &lt;b&gt; &amp;amp; &#8212; &eacute;&nbsp;x.</p></article>", "a <b> &amp; — é x."),
    ("<article><p>one\n\t two<br>three, <i>fo</i>ur<b>.</b></p></article>", "one two three, four."),
    ("<article><p>1 < 2, 3 > 2.</p></article>", "1 < 2, 3 > 2."),
    ("<article><p title='a > b'>in, it.</p><!-- <p>no</p> --><script>'</p>'</script><p>end.</p>", "in, it.\nend."),
    ("<article><p>whole, yes.</p><p>cut <a hre", "whole, yes.\ncut"),
    ("<article><p>whole, yes.</p><script>var x = '<p>no</p>'", "whole, yes."),
    ("<article><ul><li>one, a.<li>two, b.<ul><li>inner, c.</ul><li>three, d.</ul><pre>x\n  y.</pre></article>", "one, a.\ntwo, b.\ninner, c.\nthree, d.\nx y."),
    ("<article><p>See <a href=x>this long link</a>, and more text here.</p><p><a href=y>Only a link</a></p></article>", "See this long link, and more text here.\nOnly a link"),
    ("<article><p>a <button>Press</button> b, c.</p></b></i></div></article>", "a b, c."),
    ("<ARTICLE><P>Upper, case.</ARTICLE>", "Upper, case."),
])
def test_markup(page, text):
    assert main_text(page) == text


def test_nulls_repeats_a_long_page_clashing_columns_and_an_empty_table(spark):
    long = "<article>" + "".join(f"<p>{A} {i}.</p>" for i in range(20_000)) + "</article>"
    page = f"<article><p>{A}</p></article>"
    rows = [(1, "u", page), (1, "u", page), (None, None, None), (2, None, ""), (3, "v", long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "'x' AS n_chars")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in maintext.extract_main_text(df).collect()), key=repr)
    whole = "\n".join(f"{A} {i}." for i in range(20_000))
    assert got == sorted([(1, "u", A, len(A)), (1, "u", A, len(A)), (None, None, "", 0), (2, None, "", 0), (3, "v", whole, len(whole))], key=repr)
    assert maintext.extract_main_text(df.limit(0)).count() == 0
