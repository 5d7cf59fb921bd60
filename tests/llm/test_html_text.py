"""Main text extraction on small pages of several layouts."""

import pytest

from skiff.llm import html_text as H

LONG = "The committee met for a long time and agreed on all the points of the plan that was put before it."


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}<style>p{{}}</style><script>var a='</p>';</script></head><body>{body}</body></html>"


NAV = "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>"
FOOT = "<footer>&copy; Site 2020</footer>"


@pytest.mark.parametrize(
    "html, want",
    [
        (None, ""),
        ("", ""),
        ("plain", "plain"),
        (page(f"{NAV}<article><h1>Title</h1><p>{LONG}</p><p>Be.</p></article>{FOOT}"), f"Title\n{LONG}\nBe."),
        # unclosed elements and a page that stops early
        (page(f"{NAV}<article><h1>A</h1><p><b>One.<br><p>{LONG}<p>Two.")[:-14], f"A\nOne.\n{LONG}\nTwo."),
        # references, white space, inline elements
        (page("<article><p>a &amp; b&nbsp;&#233;\n\t <i>c</i>d<br>e &lt;x&gt;</p></article>"), "a & b é cd e <x>"),
        # what is never article text
        (
            page(
                f"<header><h1>Site</h1></header>{NAV}<div class='ad'>Buy now {LONG}</div><div class=cookie-notice>We use cookies</div><main><h1>Head</h1><p>{LONG}</p>"
                f"<aside>Aside</aside><form><p>Mail me</p><input></form><div id=comments><p>First! {LONG}</p></div><noscript>JS</noscript></main><div class='sidebar'>Side</div>{FOOT}"
            ),
            f"Head\n{LONG}",
        ),
        # no article element: the container that holds the text
        (page(f"<div id=top><a href=/>Home</a> <a href=/x>X</a></div><div class=content><h2>Head</h2><p>{LONG}</p><p>{LONG}</p><p>Ok.</p><p>{LONG}</p></div><div id=foot><a href=/i>Imprint</a></div>"), None),
        # an article's own header keeps its headings
        (page(f"<article><header><h1>Head</h1><p>By me</p></header><p>{LONG}</p><footer>x</footer></article>"), f"Head\n{LONG}"),
        (page(f"<article><!-- a <p>comment</p> --><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table><pre>x  y\nz</pre><p hidden>no</p><p style='display:none'>no</p><p>{LONG}</p></article>"), f"one\ntwo\nc1\nc2\nx y z\n{LONG}"),
        (page("<article></article>"), ""),
    ],
)
def test_layouts(html, want):
    got = H.main_text(html)
    if want is None:
        lines = got.split("\n")
        assert lines.count(LONG) == 3 and "Ok." in lines and "Imprint" not in got and "Home" not in got
    else:
        assert got == want


def test_smoothing_keeps_a_constant():
    assert H.smooth([2.0] * 5) == pytest.approx([2.0] * 5)
    assert H.smooth([]) == []


def test_long_page_and_odd_markup():
    many = "<article>" + "<p>word " * 5000 + "</article>"
    assert H.main_text(many) == "\n".join(["word"] * 5000)
    for odd in ("<", "<!", "<![CDATA[x", "</", "<p", "&#xFFFFFFFF; x", "<a" * 1000, "<div>" * 3000 + "x"):
        assert isinstance(H.main_text(odd), str)


def test_query_on_pages(spark):
    got = H.op1_html_extraction(spark, "/root/testdata/sf0.001").collect()
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    docs = {r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(got) == len(pages) and {r.page_id for r in got} == {r.page_id for r in pages}
    assert all(r.n_chars == len(r.text) for r in got)
    # the pages' articles are a title and a document's text
    assert sum("\n".join(r.text.split("\n")[1:]) in docs for r in got) == len(got)


def test_columns_nulls_repeats(spark):
    d = spark.createDataFrame([(1, None, 3), (None, "<p>x</p>", 4), (None, "<p>x</p>", 4)], "page_id long, html string, text int")
    got = sorted((r.page_id or 0, r.text) for r in H.extract_main_text(d).collect())
    assert got == [(0, "x"), (0, "x"), (1, "")]
    assert H.extract_main_text(d.limit(0)).collect() == []


TALK = "".join(
    f"<div><a href=/u{k}><b>Ann{k}</b></a> <i>{k} May</i> <small>at <b>noon</b></small> <a href=#r><i>answer</i></a><p><b>So</b> <i>true</i>, <a href=/x>thanks</a>!</p></div>" for k in range(1, 6)
)


@pytest.mark.parametrize(
    "html, want",
    [
        # a name that holds a mark among words of its own, around the article and inside it
        (page(f"<div><a href=/>Home</a> <a href=/x>X</a></div><div id='post-header-story'><h1>Head</h1><p>{LONG}</p><p>Ok.</p><p>{LONG}</p></div>"), f"Head\n{LONG}\nOk.\n{LONG}"),
        (page(f"<article><h1>Head</h1><p>{LONG}</p><div class='related-work'><p>{LONG}</p><p>{LONG}</p></div><p>{LONG}</p></article>"), "\n".join(["Head"] + [LONG] * 4)),
        # plain marks, also in other languages
        (page(f"<article><h1>Head</h1><p>{LONG}</p><div class='publicite'>{LONG}</div><div id='commentaires'><p>{LONG}</p></div><section class='reader-comments'>{LONG}</section></article>"), f"Head\n{LONG}"),
        # readers' comments without any name, in an article and without semantic elements
        (page(f"<article><h1>Head</h1><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><div>{TALK}</div></article>"), "\n".join(["Head"] + [LONG] * 3)),
        (page(f"<div><h1>Head</h1><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><div>{TALK}</div></div>"), "\n".join(["Head"] + [LONG] * 3)),
        # a short part between paragraphs stays
        (page(f"<article><h1>Head</h1><p>{LONG}</p><div><p>Ok.</p></div><p>{LONG}</p></article>"), f"Head\n{LONG}\nOk.\n{LONG}"),
    ],
)
def test_clusters_decide(html, want):
    assert H.main_text(html) == want


def test_smoothing_and_threshold_change_results(monkeypatch):
    """Pages without semantic elements or telling names; each step of the method matters."""
    short = f"<div><h2>Part</h2><p>{LONG}</p><div><p>Yes.</p><p>{LONG}</p><p>No.</p></div><p>{LONG}</p></div>"
    talk = f"<div><h1>Head</h1><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><div>{TALK}</div></div>"
    want = [H.main_text(h) for h in (short, talk)]
    assert "Yes.\n" in want[0] and "No.\n" in want[0] and "thanks" not in want[1]
    with monkeypatch.context() as m:
        m.setattr(H, "smooth", lambda values: values)
        assert H.main_text(short) != want[0]
    with monkeypatch.context() as m:
        m.setattr(H, "THRESHOLD", 0.0)
        assert H.main_text(talk) != want[1]
