"""HTML as a tree: a selector matcher, table grids, and the main body of an article by ordered selectors."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.catalog import query, table

# Elements of the HTML standard.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SCOPES = {"table", "td", "th", "caption", "button", "object", "template", "html"}
ENDS_PARAGRAPH = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
ENDS_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
BOUNDARIES = ENDS_PARAGRAPH | {"br", "li", "tr", "td", "th", "dt", "dd", "figcaption"}
# Blocks of a body, selectors of what is no part of it, and selectors that are no boundary.
BLOCKS = {"p", "blockquote", "table", "ul", "ol", "h2", "h3", "h4", "h5", "figcaption", "pre"}
NOISE = ("nav", "footer", "aside", "form", "script", "style", "noscript", "[class*='ShareBlock']", "[class*='ArticleShare']", "[class*='ArticleSocialMediaButtons__StyledInnerContainer']", "[class*='SocialShare']")
TOO_BROAD = {"html", "body", "main", "article", ".content", ".region-content", "*"}


WALL = ".paywall, [data-paywall], .subscription-required"


class Node:
    __slots__ = ("name", "attrs", "children", "parent")

    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None):
        self.name, self.attrs, self.parent = name, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """Elements below this one, in document order."""
        left = [c for c in reversed(self.children) if type(c) is not str]
        while left:
            node = left.pop()
            yield node
            if node.children:
                left += [c for c in reversed(node.children) if type(c) is not str]

    def text(self) -> str:
        """Text below, scripts and styles left out; blocks set apart by a space, white space squeezed."""
        if len(self.children) == 1 and type(self.children[0]) is str:
            return " ".join(self.children[0].split())
        out, left = [], list(reversed(self.children))
        while left:
            c = left.pop()
            if isinstance(c, str):
                out.append(c)
            elif c.name not in ("script", "style"):
                if c.name in BOUNDARIES:
                    out.append(" ")
                    left.append(" ")
                left += reversed(c.children)
        return " ".join("".join(out).split())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__()
        self.root = Node("", {}, None)
        self.stack, self.open = [self.root], Counter()
        self.paragraphs = [0]  # open ones by scope

    def _pop(self) -> str:
        name = self.stack.pop().name
        self.open[name] -= 1
        if name == "p":
            self.paragraphs[-1] -= 1
        elif name in SCOPES:
            self.paragraphs.pop()
        return name

    def handle_starttag(self, tag, attrs):
        while self.stack[-1].name in ENDS_SIBLING.get(tag, ()):
            self._pop()
        if tag in ENDS_PARAGRAPH and self.paragraphs[-1]:
            while self._pop() != "p":
                pass
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)} if attrs else {}, self.stack[-1])
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)
            self.open[tag] += 1
            if tag == "p":
                self.paragraphs[-1] += 1
            elif tag in SCOPES:
                self.paragraphs.append(0)

    def handle_endtag(self, tag):
        if self.open[tag]:
            while self.stack[-1].name != tag:
                self._pop()
            self._pop()

    def handle_data(self, data):
        self.stack[-1].children.append(data)


# Elements whose content a parser reads in a mode of its own.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext", "template", "svg", "math", "select"}
#: Plain tags and text, which need no parser: any other `<` is odd.
PLAIN = re.compile(r"""<(/?)([a-z][a-z0-9]*)((?:[ \t\n]+[a-z][a-z0-9-]*(?:=(?:"[^"<>&]*"|'[^'<>&]*'|[\w-]+))?)*)[ \t\n]*>|([^<]+)|(<)""")
ATTRIBUTE = re.compile(r"""([a-z][a-z0-9-]*)(?:=(?:"([^"]*)"|'([^']*)'|([\w-]+)))?""")


def _plain_tree(page: str) -> Node | None:
    """tree() of a page of plain tags and text; null where anything else is found, which Python's parser has to read."""
    builder = _Builder()
    opened, ended = builder.handle_starttag, builder.handle_endtag
    stack = builder.stack
    for slash, tag, attrs, text, odd in PLAIN.findall(page):
        if text:
            stack[-1].children.append(unescape(text) if "&" in text else text)
        elif odd or tag in RAW or slash and attrs:
            return None
        elif slash:
            ended(tag)
        else:
            opened(tag, [(k, x or y or z) for k, x, y, z in ATTRIBUTE.findall(attrs)] if attrs else ())
    return builder.root


def tree(page: str | None) -> Node:
    """The root over a page's elements. A missing end tag ends where a sibling, a block or the parent ends it; a stray one is ignored."""
    plain = _plain_tree(page or "")
    if plain is not None:
        return plain
    builder = _Builder()
    builder.feed(page or "")
    builder.close()
    return builder.root


PART = re.compile(r"""\s*(>)\s*|(\s+)|([\w-]+|\*)|\#([\w-]+)|\.([\w-]+)|\[\s*([\w-]+)\s*(?:([*^$~]?=)\s*(?:'([^']*)'|"([^"]*)"|([^\]\s]+))\s*)?\]""")


@lru_cache(1024)
def compiled(selector: str) -> list[list[tuple[str, list]]]:
    """Alternatives of a selector: steps, each (how it hangs on the step before, tests)."""
    out = []
    for alternative in re.split(r",(?![^\[]*\])", selector):
        text, at, steps, link = alternative.strip(), 0, [], ""
        tests: list = []
        while at < len(text):
            m = PART.match(text, at)
            if not m:
                raise ValueError(f"selector {selector!r} isn't understood at {text[at:]!r}")
            at = m.end()
            if m[1] or m[2]:
                steps.append((link, tests))
                link, tests = m[1] or " ", []
            elif m[3]:
                tests.append(("tag", m[3].lower(), ""))
            elif m[4]:
                tests.append(("=", "id", m[4]))
            elif m[5]:
                tests.append(("~=", "class", m[5]))
            else:
                tests.append((m[7] or "has", m[6].lower(), next((v for v in (m[8], m[9], m[10]) if v is not None), "")))
        steps.append((link, tests))
        if not all(t for _, t in steps):
            raise ValueError(f"selector {selector!r} has an empty step")
        out.append(steps)
    return out


def _fits(node: Node, tests: list) -> bool:
    for how, key, wanted in tests:
        if how == "tag":
            if key not in ("*", node.name):
                return False
            continue
        held = node.attrs.get(key)
        if held is None:
            return False
        if how == "=" and held != wanted or how == "~=" and wanted not in held.split():
            return False
        if how in ("*=", "^=", "$=") and not (wanted and {"*=": held.__contains__, "^=": held.startswith, "$=": held.endswith}[how](wanted)):
            return False
    return True


def _fitting(root: Node, alternatives: list[list]) -> Iterator[Node]:
    if len(alternatives) == 1:
        return (node for node in root.walk() if _fits(node, alternatives[0]))
    return (node for node in root.walk() if any(_fits(node, tests) for tests in alternatives))


def first(root: Node, selector: str) -> Node | None:
    """The first element that select() gives; a selector of one step looks no further."""
    alternatives = compiled(selector)
    if all(len(steps) == 1 for steps in alternatives):
        return next(_fitting(root, [steps[0][1] for steps in alternatives]), None)
    return next(iter(select(root, selector)), None)


def select(root: Node, selector: str) -> list[Node]:
    """Elements below root that the selector finds, in document order. Each step looks no higher than root, and at each element once."""
    alternatives, out = compiled(selector), []
    if all(len(steps) == 1 for steps in alternatives):
        tests = [steps[0][1] for steps in alternatives]
        return list(_fitting(root, tests))
    start = [(frozenset(), frozenset())] * len(alternatives)
    held: dict[int, list[tuple[frozenset, frozenset]]] = {id(root): start}  # by alternative: steps found here, steps found here or above
    for node in root.walk():
        above, mine = held[id(node.parent)], []
        for steps, (parent, ancestors) in zip(alternatives, above, strict=True):
            own = frozenset(i for i, (link, tests) in enumerate(steps) if (not i or i - 1 in (parent if link == ">" else ancestors)) and _fits(node, tests))
            mine.append((own, ancestors | own if own else ancestors))
        held[id(node)] = mine
        if any(len(steps) - 1 in own for steps, (own, _) in zip(alternatives, mine, strict=True)):
            out.append(node)
    return out


def grid(table_node: Node) -> list[tuple[Node, bool, list[Node | None]]]:
    """Rows of a table as (row, all cells are headers, cells by column). A cell with a span lies in each place that it covers."""
    rows = [n for n in table_node.walk() if n.name == "tr" and _table_of(n) is table_node]
    held: dict[int, tuple[int, Node]] = {}  # column: rows left, cell
    out = []
    for row in rows:
        cells: dict[int, Node] = {}
        for column, (_, cell) in held.items():
            cells[column] = cell
        held = {c: (n - 1, cell) for c, (n, cell) in held.items() if n > 1}
        column, own = 0, [c for c in row.children if isinstance(c, Node) and c.name in ("td", "th")]
        for cell in own:
            while column in cells:
                column += 1
            wide, high = _span(cell, "colspan", 1000), _span(cell, "rowspan", 65534)
            for c in range(column, column + wide):
                if c not in cells:
                    cells[c] = cell
                    if high > 1:
                        held[c] = (high - 1, cell)
            column += wide
        if cells:
            out.append((row, all(c.name == "th" for c in cells.values()), [cells.get(c) for c in range(max(cells) + 1)]))
    return out


def _table_of(node: Node) -> Node | None:
    while node is not None and node.name != "table":
        node = node.parent
    return node


def _span(cell: Node, key: str, most: int) -> int:
    said = cell.attrs.get(key)
    if said is None:
        return 1
    return min(most, max(1, int(said))) if re.fullmatch("[0-9]{1,9}", said) else 1


def records(table_node: Node) -> list[tuple[Node, dict[str, str]]]:
    """(row, label: text) of each data row; a column's label is its lowest header's text."""
    labels: list[str] = []
    out = []
    for row, header, cells in grid(table_node):
        if header:
            labels += [""] * (len(cells) - len(labels))
            labels = [c.text() if c is not None else label for c, label in zip([*cells, *[None] * len(labels)], labels, strict=False)]
        else:
            out.append((row, {label: c.text() for label, c in zip(labels, cells, strict=False) if label and c is not None}))
    return out


def _rendered(node: Node) -> str:
    if node.name == "table":
        return "\n".join(" | ".join(c.text() for c in row.children if isinstance(c, Node) and c.name in ("td", "th")) for row in node.walk() if row.name == "tr")
    if node.name in ("ul", "ol"):
        return "\n".join("- " + c.text() for c in node.children if isinstance(c, Node) and c.name == "li")
    return node.text()


def _with_blocks(root: Node) -> set[int]:
    """Ids of the elements that hold a block somewhere below."""
    out: set[int] = set()
    for n in root.walk():
        if n.name in BLOCKS:
            up = n.parent
            while up is not None and id(up) not in out:
                out.add(id(up))
                up = up.parent
    return out


def body_blocks(root: Node) -> list[tuple[str, str]]:
    """(element, text) of a body's blocks in page order; text between blocks is one of its own."""
    out: list[tuple[str, str]] = []
    inline: list[str] = []
    holders = _with_blocks(root)

    def flush() -> None:
        if said := " ".join("".join(inline).split()):
            out.append(("text", said))
        inline.clear()

    left: list = list(reversed(root.children))
    while left:
        c = left.pop()
        if c is None:
            flush()
        elif isinstance(c, str):
            inline.append(c)
        elif c.name in BLOCKS:
            flush()
            if said := _rendered(c).strip():
                out.append((c.name, said))
        elif id(c) in holders:
            flush()
            left.append(None)
            left += reversed(c.children)
        elif c.name not in ("script", "style"):
            inline.append(f" {c.text()} " if c.name in BOUNDARIES else _inline(c))
    flush()
    return out


def _inline(node: Node) -> str:
    """Text of an inline element, with the white space at its edges kept as one space."""
    raw, left = [], list(reversed(node.children))
    while left:
        c = left.pop()
        if isinstance(c, str):
            raw.append(c)
        elif c.name not in ("script", "style"):
            if c.name in BOUNDARIES:
                raw.append(" ")
                left.append(" ")
            left += reversed(c.children)
    return "".join(raw)


def select_body(page: str | None, selectors: tuple[str, ...], noise: tuple[str, ...] = NOISE) -> dict:
    """status, selector, blocks and the numbers of removed elements by noise selector.

    The first selector that finds anything decides: `ambiguous` if it finds several elements, else its element is the body.
    `not_found` if none finds one, `restricted` where a pay wall is marked, `empty` without text. A selector that fits any page
    is refused (ValueError).
    """
    if broad := TOO_BROAD & {s.strip() for s in selectors}:
        raise ValueError(f"no boundary of a body: {sorted(broad)}")
    root, out = tree(page), {"status": "not_found", "selector": None, "blocks": [], "removed": {}}
    for selector in selectors:
        found = select(root, selector)
        if found:
            out["selector"] = selector
            if len(found) > 1:
                return out | {"status": "ambiguous"}
            break
    else:
        return out
    body = found[0]
    if any(_fits(body, steps[-1][1]) for steps in compiled(WALL)) or select(body, WALL):
        return out | {"status": "restricted"}
    for selector in noise:
        gone = select(body, selector)
        for n in gone:
            n.parent.children = [c for c in n.parent.children if c is not n]
        if gone:
            out["removed"][selector] = len(gone)
    out["blocks"] = body_blocks(body)
    return out | {"status": "ok" if out["blocks"] else "empty"}


BODY = "struct<status:string,selector:string,blocks:array<struct<tag:string,text:string>>,removed:map<string,long>>"


def body_of(page: str | Column, *selectors: str) -> Column:
    """select_body as a column."""

    def run(pages: pd.Series) -> pd.DataFrame:
        found = [select_body(p, selectors) for p in pages]
        return pd.DataFrame({"status": [x["status"] for x in found], "selector": [x["selector"] for x in found], "blocks": [[{"tag": t, "text": s} for t, s in x["blocks"]] for x in found], "removed": [x["removed"] for x in found]})

    return F.pandas_udf(run, BODY)(page)


@query("str19_body_selection")
def str19(spark: SparkSession, sf: str) -> DataFrame:
    """The body of every page by ordered selectors: status, the selector that found it, its text, blocks and removed elements."""
    b = table(spark, sf, "pages").select("page_id", body_of("html", "[itemprop='articleBody']", ".article-body", "body > article").alias("b"))
    text = F.array_join(F.transform("b.blocks", lambda x: x["text"]), "\n\n")
    removed = F.aggregate(F.map_values("b.removed"), F.lit(0).cast("long"), lambda a, x: a + x)
    return b.select("page_id", "b.status", "b.selector", text.alias("text"), F.size("b.blocks").cast("long").alias("n_blocks"), removed.alias("n_removed"))
