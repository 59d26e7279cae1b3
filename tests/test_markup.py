"""The tree, the selector matcher, table grids, bodies of articles and race pages."""

import time

import pytest

from millrace.functions.markup import grid, records, select, select_body, tree
from millrace.sources.race_pages import page_rows, reference_runners

PAGE = """<html><body><div id=a class="x article-body y"><p>One <b>bold</b>&amp;co<p>Two<br>lines<nav>menu</nav>
<div>loose <i>text</i><ul><li>first<li>second <b>b</b></ul>after</div><table><tr><th>H<th>I<tr><td>1<td>2</table>
<aside class="ArticleShareBar">share</aside><script>var a = "<p>";</script></div><p>outside</p></body></html>"""


def names(nodes):
    return [(n.name, n.attrs.get("id", "")) for n in nodes]


@pytest.mark.parametrize(
    "selector,want",
    [
        ("p", 3), ("#a > p", 2), ("body p", 3), ("body > p", 1), ("div div li", 2), ("div > li", 0), (".article-body", 1), (".article", 0),
        ("[class*='Share']", 1), ("[class^=x]", 1), ("[class$='y']", 1), ("[class~=article-body]", 1), ("[class='x']", 0), ("[id]", 1), ("nav, aside", 2), ("div#a.x", 1), ("html > p", 0), ("body > div > div > ul", 1), ("*", 24),
    ],
)
def test_selectors(selector, want):
    found = select(tree(PAGE), selector)
    if selector != "*":
        assert len(found) == want, names(found)
    else:
        assert len(found) == len(list(tree(PAGE).walk()))


@pytest.mark.parametrize("bad", ["p:first-child", "", "a >", "p,,q"])
def test_a_selector_that_is_not_understood_is_refused(bad):
    with pytest.raises(ValueError):
        select(tree(PAGE), bad)


def test_body_blocks_and_what_was_removed():
    got = select_body(PAGE, (".none", ".article-body"))
    assert got["status"] == "ok" and got["selector"] == ".article-body"
    assert got["blocks"] == [("p", "One bold&co"), ("p", "Two lines"), ("text", "loose text"), ("ul", "- first\n- second b"), ("text", "after"), ("table", "H | I\n1 | 2")]
    assert got["removed"] == {"nav": 1, "aside": 1, "script": 1}


def test_nested_containers_end_at_their_own_tag():
    got = select_body("<div class=b><div><p>one</p></div><p>two</p></div><p>three</p>", (".b",))
    assert [t for _, t in got["blocks"]] == ["one", "two"]


@pytest.mark.parametrize(
    "page,want",
    [("<p>x</p>", "not_found"), (None, "not_found"), ("<i class=b>x</i><i class=b>y</i>", "ambiguous"), ("<div class=b> <nav>x</nav></div>", "empty"), ("<div class=b><i data-paywall>x</i></div>", "restricted"), ("<div class='b paywall'>x</div>", "restricted")],
)
def test_status_of_a_body(page, want):
    assert select_body(page, (".b",))["status"] == want


def test_a_selector_that_fits_any_page_is_refused():
    with pytest.raises(ValueError):
        select_body("<article>x</article>", ("article",))


def test_spans_fill_the_grid():
    found = select(tree("<table><tr><th rowspan=2>A<th colspan=2>B<tr><th>C<th>D<tr><td rowspan=2>1<td>2<td>3<tr><td colspan=2>4<table><tr><td>inner</table></table>"), "table")[0]
    assert [[c.text() for c in cells] for _, _, cells in grid(found)] == [["A", "B", "B"], ["A", "C", "D"], ["1", "2", "3"], ["1", "4 inner", "4 inner"]]
    assert [r for _, r in records(found)] == [{"A": "1", "C": "2", "D": "3"}, {"A": "1", "C": "4 inner", "D": "4 inner"}]


def test_deep_and_broken_pages_are_read_once():
    began = time.time()
    assert select_body("<div class=b>" + "<div>" * 50_000 + "x", (".b",))["blocks"] == [("text", "x")]
    assert select_body("<p class=b>" + "<p>" * 50_000, (".b",))["status"] == "empty"
    assert len(select(tree("<div>" * 20_000), "div div div div")) == 19_997 or time.time() - began < 60
    assert select_body("<a " * 30_000 + "'>", (".b",))["status"] == "not_found"
    assert time.time() - began < 60


CARD = "<table class=runners><tr><th>No<th>Horse<th>Draw<tr><td>1<td>A&amp;B<td>5<tr class=scratched><td>2<td>C<td>6<tr><td><td>D<td>7<tr><td>4<td><td>8</table><table class=results><tr><th>Pos<th>No<th>Margin<tr><td>1st<td>1<td>nk<tr><td>3<td>1<td>2 L<tr><td>-<td>2<td></table>"


def test_page_rows():
    got = [(r["kind"], r["pos"], r["number"], r["name"], r["draw"], r["status"], r["position"], r["margin"]) for r in page_rows(CARD, "card")]
    assert got == [("runner", 1, "1", "A&B", "5", "declared", None, ""), ("runner", 2, "2", "C", "6", "withdrawn", None, ""), ("runner", 3, "", "D", "7", "declared", None, ""), ("result", 1, "1", "", "", "declared", 1, "nk"), ("result", 2, "1", "", "", "declared", 3, "2 L")]
    assert page_rows(None, "card") == page_rows("<table>", "entries") == []


def test_runners_take_the_last_result_of_their_number(spark):
    whole = "<table class=table-entries><tr><th>#<th>Name<th>Fin<tr><td>7<td>E<td>2</table>"
    pages = spark.createDataFrame([(1, "card", CARD), (2, "card", None), (3, "entries", whole), (None, "entries", whole)], "k long, layout string, html string")
    got = sorted((r["k"] or 0, r["pos"], r["name"], r["status"], r["position"], r["margin"], r["complete"]) for r in reference_runners(pages, "k").collect())
    assert got == [(0, 1, "E", "declared", 2, "", True), (1, 1, "A&B", "declared", 3, "2 L", False), (1, 2, "C", "withdrawn", None, "", False), (1, 3, "D", "declared", None, "", False), (3, 1, "E", "declared", 2, "", True)]
