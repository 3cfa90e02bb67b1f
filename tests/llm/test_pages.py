"""Main text of pages."""

from shelfmark.llm import pages
from tests.llm.helpers import table

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href=x>Home</a></li><li><a>About us and more</a></li></ul></nav><div class="ad">Buy now, it is cheap.</div>
{body}<aside>Read this as well</aside><form>Name <input></form><footer>&copy; somebody</footer></body></html>"""
LONG = "The quick brown fox jumps over the lazy dog and goes on with its day as if nothing were. " * 3


def test_article_and_nothing_else():
    body = (
        f"<article><h1>Head &amp; line</h1><p><b>{LONG}<br><p>Short.</p><p>one <i>two</i>three&nbsp;&eacute;</p>"
        "<div class='share-buttons'>Tweet</div><ul><li>a<li>b</ul></article><section id=comments><p>I do not agree "
        f"at all {LONG}</p></section>"
    )
    want = f"Head & line {' '.join(LONG.split())} Short. one twothree é a b"
    assert pages.extract(PAGE.format(body=body)) == want


def test_region_without_article():
    body = f"<div class=menu>Menu here</div><div id=post><h2>Title</h2><p>{LONG}</p><p>Tiny.</p><p>{LONG}</p></div>"
    assert pages.extract(PAGE.format(body=body)) == " ".join(f"Title {LONG} Tiny. {LONG}".split())


def test_nothing_else_is_dropped_without_article():
    text = " ".join(LONG.split())
    assert pages.extract(f"<div><p>Intro</p><blockquote>{LONG}</blockquote><p>End</p></div>") == f"Intro {text} End"
    body = f"<div><p>{LONG * 6}</p></div><div><p>{LONG}</p></div>"
    assert pages.extract(PAGE.format(body=body)) == " ".join([text] * 7)


def test_class_words_of_wrappers():
    text = " ".join(LONG.split())
    for wrapper in ("class='layout has-sidebar'", "id=page class='no-sidebar'"):
        inside = f"<article><h1>Head</h1><p>one <i>two</i>three {LONG}</p><div class=ad>Buy</div></article>"
        readers = f"<div class=comments><article><p>I do not agree {LONG * 3}</p></article></div>"
        want = f"Head one twothree {text}"
        assert pages.extract(PAGE.format(body=f"<div {wrapper}>{inside}{readers}<div class=sidebar>Side</div></div>")) == want
        assert pages.extract(f"<div {wrapper}><h1>Head</h1><p>one <i>two</i>three {LONG}</p></div><div class=ad>Buy</div>") == want
        assert pages.extract(f"<article><div {wrapper}><h1>Head</h1><p>one <i>two</i>three {LONG}</p></div></article>") == want
    assert pages.extract(f"<div id=post><p>{LONG}</p></div><div id=comments><p>{LONG}</p></div>") == text


def test_broken_markup():
    assert pages.extract("<p>x<br>y") == "x y"
    assert pages.extract("plain &lt;b") == "plain <b"
    assert pages.extract("<script>only</script>") == ""
    assert "zz" in pages.extract("<![foo bar>zz")
    assert pages.extract("</p></div><p>a<p>b</table>c") == "a b c"
    assert pages.extract("<p>" * 3000 + "deep") == "deep"


def test_long_page_is_whole():
    words = [f"w{i}" for i in range(200_000)]
    html = "<article>" + "".join(f"<p>{' '.join(words[i : i + 50])}</p>" for i in range(0, len(words), 50)) + "</article>"
    assert pages.extract(html) == " ".join(words)


def test_rows(spark):
    rows = [(1, "u", f"<p>{LONG}</p>", "old", "z"), (1, "u", f"<p>{LONG}</p>", "old", "z"), (None, None, None, "t", "z"), (2, "v", "", "t", "z")]
    df = table(spark, rows, "page_id long, url string, html string, text string, `c.d` string")
    got = pages.main_text(df).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars, r["c.d"]) for r in got) == sorted(
        [(1, LONG.strip(), len(LONG.strip()), "z")] * 2 + [(0, "", 0, "z"), (2, "", 0, "z")]
    )
    assert pages.main_text(df.limit(0)).collect() == []
