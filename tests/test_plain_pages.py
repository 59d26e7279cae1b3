"""Pages of plain tags are read without Python's parser (SRC-06), and give the tree that it gives."""

import random

import pytest

from millrace.functions import markup
from millrace.sources import race_pages


def by_parser(page):
    builder = markup._Builder()
    builder.feed(page)
    builder.close()
    return builder.root


def shape(node):
    """Elements with their texts, whichever pieces a text came in."""
    out, text = [], ""
    for c in [*node.children, None]:
        if isinstance(c, str):
            text += c
            continue
        if text:
            out.append(text)
        text = ""
        if c is not None:
            out.append((c.name, c.attrs, shape(c)))
    return out


PIECES = ["<p>", "</p>", "<td>", "<td rowspan=2>", "</td>", "<tr class=\"a b\">", "<tr class=''>", "</tr>", "<table id=x>", "</table>", "<br>", "<hr class='y'>", "<b data-x1=\"1\" b>", "</b >", "<li\n a=b\tc=d>", "a & b &amp; &eacute c", "x > y", " ", "é\n", "<div hidden id='q' id=r>", "</div>", "&#x41;", "&lt"]
ODD = ["<br/>", "<!-- <p> -->", "<script>a<b</script>", "<a href=x&amp;y>", "<P>", "< p>", "<p a='<'>", "</b x>", "<title>a<b></title>", "<", "<p", "<?x>", "<!DOCTYPE html>", "<p a=\"&amp;\">", "<p\x0ca=b>", "<a b = c>", "<style>", "<p a=>", "<td colspan=2/>", "<plaintext>", "</>"]


@pytest.mark.parametrize("pieces", [PIECES, PIECES * 4 + ODD])
def test_plain_trees_are_those_of_the_parser(pieces):
    rng, plain = random.Random(len(pieces)), 0
    for _ in range(3000):
        page = "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
        found = markup._plain_tree(page)
        plain += found is not None
        assert shape(markup.tree(page)) == shape(by_parser(page)), page
    assert plain == 3000 if pieces is PIECES else 300 < plain < 2700


def test_race_pages_need_no_parser(monkeypatch):
    """Before, each page went through the parser, and each of its tables was searched once a row."""

    def refused(*_):
        raise AssertionError("a plain page was given to the parser")

    monkeypatch.setattr(markup.HTMLParser, "feed", refused)
    row = lambda i: f'<tr class="{"scr" if i == 2 else ""}"><td>{i}</td><td>Horse &amp; {i}</td><td>4</td><td>50</td><td>{"-" if i == 2 else i}</td><td></td></tr>'
    searched = []
    monkeypatch.setattr(race_pages, "select", lambda *a, f=markup.select: searched.append(a) or f(*a))
    got = race_pages.page_rows("<table class=table-entries><tr><th>#</th><th>Name</th><th>PP</th><th>Wgt</th><th>Fin</th><th>Beaten</th></tr>" + "".join(map(row, range(1, 51))) + "</table>", "entries")
    assert len(searched) <= 2 and [r["name"] for r in got if r["kind"] == "runner"] == [f"Horse & {i}" for i in range(1, 51)]
    assert [r["number"] for r in got if r["status"] == "withdrawn"] == ["2"] and [r["position"] for r in got if r["kind"] == "result"] == [1, *range(3, 51)]
