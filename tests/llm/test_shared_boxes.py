"""Nearest-URL differencing of pages that mark an article."""

from millrace.llm import html_text


def test_boxes_inside_articles_that_near_pages_share_go(spark):
    """A box goes if all its lines are shared; a sentence that two articles share stays, and menus count as template."""
    page = "<nav>home</nav><article><h1>story {0}</h1><p>words of {0}</p><p>as all know</p><div><p>Read in our app</p><p>Version {1}</p></div></article><p>tail {0}</p>"
    rows = [(i, f"http://a.example/news/{i}", page.format("abcd"[i] * 9, "1" if i < 2 else i)) for i in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"].split("\n\n")[2:], r["n_template"]) for r in html_text.extract(pages).collect()}
    assert got[0] == got[1] == (["as all know"], 3)
    assert got[2] == (["as all know", "Read in our app", "Version 2"], 1)
