"""Main text of web pages: nearest-URL page differencing on top of block markup.

1. A page is cut into text blocks at block-level tags. Text in scripts, styles, comments, the head and other
   elements that show no text is never a block.
2. Each block gets a role from its open elements: `body` inside article or main, `chrome` inside elements
   or classes made for menus, headers, footers, sidebars, notices, adverts, forms or reader comments, else
   `open`.
3. Pages of a host with the same blocks are one class, at the place of its least URL path; what is found for
   the class goes for all its pages. Classes of a host are sorted by path. A class's partner is, among the AROUND
   classes before and after it, the one with the longest common path prefix (then the nearer path length, then the
   nearer place) that isn't mostly the same text: near copies of a page say nothing about its template.
4. The block lines of every page and its partner are aligned by longest common subsequence; lines they share are
   template and are deleted from `open` and `chrome` blocks, and from `body` where all lines of a box (the innermost
   div or section in the article, of two lines at least) are shared.
5. Of what is left markup deletes the `chrome` blocks; if a page has `body` blocks, its `open` blocks are deleted
   too, as the author marked where the article lies.

Other shared lines stay in `body`: articles quote and repeat each other, and a line that two articles share is
part of both; README has the figures that led to this.

Differencing works on 64-bit hashes of lines, so that the shuffle by URL carries hashes, not pages; every
row takes part. Classes near the borders of range partitions are compared again in groups of bounded size, one a
border, and the nearer partner counts.

Edge cases: null or empty html gives an empty text; a null url counts as an empty host and path; repeated
rows are copies and so no partner for each other; unclosed tags, cut-off pages and unknown references are
read as browsers read them (a quote that never closes doesn't hide what follows); a page of any length, however deep or
broken, is read whole and once; extra columns are ignored.
"""

from __future__ import annotations

import html as references
import os.path
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, read_table, row_key
from .url_filter import _split

# Element names of the HTML standard.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody tfoot thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template iframe object svg canvas head title textarea button select datalist audio video math".split())
RAW = frozenset("script style textarea title noscript iframe".split())
CHROME_TAGS = frozenset("nav header footer aside form menu dialog search".split())
BODY_TAGS = frozenset("article main".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id names that mark chrome.
CHROME_NAMES = frozenset("ad ads advert adverts advertisement adsense banner sponsor sponsored promo promoted nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments respond disqus replies pagination pager toolbar skip copyright".split())
# closing tags that browsers imply: a new element of the key closes an open one of the values
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = BLOCKS - {"body", "html"}
#: A quote protects `>` only as an attribute's value; a tag that the page's end cuts off ends there. Each alternative matches wherever
#: it starts and gives nothing back, so that a page is read once however broken it is.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|\Z)""", re.I)
PART = re.compile(r"[A-Za-z]+")
#: Those of them that mark chrome inside an article or main, too: what the text has to be without, as words may be part of an article's name.
INNER_NAMES = CHROME_NAMES - frozenset("widget signup login share sharing social related recommended pagination pager toolbar skip copyright modal overlay masthead".split())
HOLDERS = frozenset("ul ol table dl select tbody".split())
OPEN, BODY, CHROME = 0, 1, 2
#: Classes before and after a page, in the order of paths, among which its partner is sought.
AROUND = 8
BOXES = frozenset("div section".split())
INNER = ["key", "host", "path", "lines", "lengths", "opened", "boxes", "far", "deleted", "side", "part"]


def _role(tag: str, attributes: str, names: frozenset = CHROME_NAMES) -> tuple[int, bool]:
    """The role that an element gives its content, and whether it hides it; `names` in classes and ids mark chrome."""
    role = CHROME if tag in CHROME_TAGS else BODY if tag in BODY_TAGS else OPEN
    hidden = tag in HIDDEN
    if attributes and not attributes.isspace():
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                hidden = True
            elif name == "role":
                role = CHROME if value in CHROME_ROLES else BODY if value in ("main", "article") else role
            elif name in ("class", "id") and tag not in ("html", "body", "article", "main") and names.intersection(PART.findall(value)):
                role = CHROME
    return role, hidden


class _Open:
    """The open elements: tag, role with all that is around it, hidden, box. Where the elements of a tag lie is kept beside them."""

    def __init__(self):
        self.stack: list[tuple[str, int, bool, int]] = []
        self.places: dict[str, list[int]] = {}
        self.block_places: list[int] = []

    def last(self, tag: str) -> int:
        """The place of the innermost element of that tag, or -1."""
        found = self.places.get(tag)
        return found[-1] if found else -1

    def last_block(self) -> int:
        return self.block_places[-1] if self.block_places else -1

    def push(self, tag: str, role: int, hidden: bool, box: int) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCKS:
            self.block_places.append(len(self.stack))
        self.stack.append((tag, role, hidden, box))

    def cut(self, k: int) -> None:
        """Closes the elements from place k on."""
        while len(self.stack) > k:
            tag = self.stack.pop()[0]
            self.places[tag].pop()
            if tag in BLOCKS:
                self.block_places.pop()

    def inner(self) -> tuple[str, int, bool, int]:
        return self.stack[-1] if self.stack else ("", OPEN, False, -1)


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(role, text) of the page's text blocks, in page order; white space is one space, and no block is empty."""
    return [(role, text) for role, text, _ in boxed_blocks(page)]


def boxed_blocks(page: str | None) -> list[tuple[int, str, int]]:
    """blocks() with the number of the box inside an article or main in which each lies, or -1."""
    out: list[tuple[int, str, int]] = []
    boxes = 0
    opened = _Open()
    held: list[str] = []
    at, page = 0, page or ""

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            out.append((opened.inner()[1], text, opened.inner()[3]))

    while at < len(page):
        found = TOKEN.search(page, at)
        if not opened.inner()[2]:
            held.append(references.unescape(page[at : found.start() if found else len(page)]))  # a reference ends at a tag
        if not found:
            break
        at = found.end()
        closing, tag, attributes = found.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br" or (tag in ("td", "th") and not opened.inner()[2]):
            held.append(" ")
        if closing:
            k = opened.last(tag)
            if k >= 0:
                if opened.last_block() >= k:
                    if tag not in BLOCKS:  # an inline end tag doesn't end the blocks in it
                        continue
                    flush()
                opened.cut(k)
            continue
        if tag in BLOCKS:
            flush()
            if tag in ENDS_P and (k := opened.last("p")) >= 0:
                opened.cut(k)
        implied = CLOSES.get(tag, frozenset())
        for other in implied:
            k = opened.last(other)
            if k > max(opened.last(h) for h in HOLDERS - implied):
                opened.cut(k)
        if tag in VOID:
            continue
        _, around, hiding, box = opened.inner()
        role, hidden = _role(tag, attributes, INNER_NAMES if around == BODY else CHROME_NAMES)
        # inside chrome all is chrome; an article inside an article is a reader's comment or a teaser of another
        role = CHROME if around == CHROME else role if role != OPEN else around
        if role == BODY and around == BODY and tag == "article" and opened.last("article") >= 0:
            role = CHROME
        if tag in RAW:  # text up to the end tag, whatever it holds
            end = re.compile(rf"</{tag}\s*>|\Z", re.I).search(page, at)
            at = end.end()
            continue
        if tag in BOXES and role == BODY and around == BODY:
            box, boxes = boxes, boxes + 1
        opened.push(tag, role, hidden or hiding, box)
    flush()
    return out


def hashes(found: list[tuple[int, str]]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(t) for _, t in found], np.uint64).view(np.int64)


def _row_ends(a: list[int], b: list[int]) -> list[int]:
    """After each line of b, the bit-vector of Hyyro's method: zeros below i count the LCS of a[:i] and the lines so far."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v, out = full, []
    for y in b:
        u = v & where.get(y, 0)
        v = ((v + u) | (v - u)) & full
        out.append(v)
    return out


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """LCS lengths of b with every prefix of a."""
    v = _row_ends(a, b)[-1] if b else (1 << len(a)) - 1
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(a)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _aligned(a: list[int], b: list[int], most: int = 1 << 30) -> list[int]:
    """Places in a of a longest common subsequence, by bit-parallel rows; sequences too long for `most` bits are halved (Hirschberg)."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = list(range(head))
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if x and y and len(x) * len(y) > most and len(y) > 1:
        mid = len(y) // 2
        cut = int(np.argmax(_lengths(x, y[:mid]) + _lengths(x[::-1], y[mid:][::-1])[::-1]))
        out += [head + i for i in _aligned(x[:cut], y[:mid], most)] + [head + cut + i for i in _aligned(x[cut:], y[mid:], most)]
    elif x and y:
        rows = _row_ends(x, y)
        i, j, found = len(x), len(y), []
        while i and j:
            if rows[j - 1] >> (i - 1) & 1:
                i -= 1
                continue
            j -= 1
            if not j or rows[j - 1] >> (i - 1) & 1:
                i -= 1
                found.append(head + i)
        out += found[::-1]
    return out + list(range(len(a) - tail, len(a)))


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which lines of a are in a longest common subsequence of a and b."""
    out = np.zeros(len(a), bool)
    out[_aligned(a.tolist(), b.tolist())] = True
    return out


def _common(a: str, b: str) -> int:
    return len(os.path.commonprefix((a, b)))


class Row(NamedTuple):
    """A class of pages; lines are hashes with their texts' lengths, opened are those that may be template, boxes their boxes."""

    key: bytes
    host: str
    path: str
    lines: np.ndarray
    lengths: np.ndarray
    opened: list[int]
    boxes: list[int]


def _difference(rows: list[Row], at: int) -> tuple[int, int, int, list[int]] | None:
    """How far the partner of rows[at] is, smaller being nearer (common path, path length, places), and the open lines they share."""
    own = rows[at]
    around = [(-_common(o.path, own.path), abs(len(o.path) - len(own.path)), abs(i - at), i) for i in range(max(0, at - AROUND), min(len(rows), at + AROUND + 1)) if i != at and (o := rows[i]).host == own.host]
    size = max(1, int(own.lengths.sum()))
    for *far, i in sorted(around):
        same = shared(own.lines, rows[i].lines)
        if own.lengths[same].sum() < 0.8 * size:
            split = {box for k, box in zip(own.opened, own.boxes, strict=True) if box >= 0 and not same[k]}
            return *far, [int(k) for k, box in zip(own.opened, own.boxes, strict=True) if same[k] and box not in split]
    return None


LINES = "key binary, host string, path string, lines array<long>, lengths array<int>, opened array<int>, boxes array<int>"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Row]:
    for batch in batches:
        for key, host, path, lines, lengths, opened, boxes in zip(*(batch.column(f).to_pylist() for f in Row._fields), strict=True):
            yield Row(key, host, path, np.array(lines, np.int64), np.array(lengths, np.int64), opened, boxes)


def _answers(found: list[tuple]) -> pa.RecordBatch:
    """(key, far, deleted)"""
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.binary()), pa.array([list(x[:3]) for _, x in found], pa.list_(pa.int32())), pa.array([x[3] for _, x in found], pa.list_(pa.int32()))], ["key", "far", "deleted"])


def differences(pages: DataFrame, work: Workspace) -> DataFrame:
    """(key, deleted): template lines to delete, of the pages that have any. pages: key, url, html."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for key, url, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = boxed_blocks(page)
                host, path = _split(url)
                sizes = Counter(box for _, _, box in found)
                opened = [i for i, (r, _, box) in enumerate(found) if r != BODY or (box >= 0 and sizes[box] > 1)]
                boxes = [found[i][2] if found[i][0] == BODY else -1 for i in opened]
                found = [(r, t) for r, t, _ in found]
                for column, value in zip(out, (key, host, path, hashes(found), [len(t) for _, t in found], opened, boxes), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), pa.array(out[3], pa.list_(pa.int64())), pa.array(out[4], pa.list_(pa.int32())), pa.array(out[5], pa.list_(pa.int32())), pa.array(out[6], pa.list_(pa.int32()))], list(Row._fields))

    parsed = work.save(pages.select("key", "url", "html").mapInArrow(parse, LINES).withColumn("class", row_key("host", "lines", "opened", "boxes")), "lines")
    # one page of each class, chosen map-side; from here on the class is the key
    one = parsed.groupBy("class").agg(F.min(F.struct("path", "key", "host", "lines", "lengths", "opened", "boxes")).alias("page"))
    classes = one.select(F.col("class").alias("key"), "page.host", "page.path", "page.lines", "page.lengths", "page.opened", "page.boxes")

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What neighbours in the partition tell; the outer 2 * AROUND rows at both ends go on with their side and partition."""
        part = TaskContext.get().partitionId()
        rows, first, n = [], [], 0  # rows: those around the one that is due
        for row in _rows(batches):
            rows.append(row)
            n += 1
            if len(first) < 2 * AROUND:
                first.append(row)
            if len(rows) > AROUND:  # the row AROUND places back has all its neighbours
                yield from answer(rows, [len(rows) - 1 - AROUND], part)
            if len(rows) > 3 * AROUND:
                rows.pop(0)
        yield from answer(rows, range(max(0, len(rows) - AROUND), len(rows)), part)
        yield sides(first, "first", part)
        yield sides(rows[-2 * AROUND :], "last", part)

    def answer(rows: list[Row], places, part: int) -> Iterator[pa.RecordBatch]:
        found = [(rows[at].key, x) for at in places if rows[at].opened and (x := _difference(rows, at))]
        if found:
            got = _answers(found)
            n = len(found)
            yield pa.RecordBatch.from_arrays([got.column(0), *[pa.nulls(n, t) for t in (pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()))], got.column(1), got.column(2), pa.nulls(n, pa.string()), pa.array([part] * n, pa.int64())], INNER)

    def sides(rows: list[Row], side: str, part: int) -> pa.RecordBatch:
        n = len(rows)
        kinds = (pa.binary(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([*[pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.int32())), pa.array([side] * n, pa.string()), pa.array([part] * n, pa.int64())], INNER)

    def border(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows at one border, 4 * AROUND at most, lie together in order."""
        for batch in by_border(batches):
            rows = list(_rows([batch]))
            yield _answers([(r.key, x) for at, r in enumerate(rows) if r.opened and (x := _difference(rows, at))])

    def by_border(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            grp = table.column("border").to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(grp[1:] != grp[:-1]) + 1)) if len(grp) else [0]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                yield from table.slice(i, j - i).combine_chunks().to_batches()
            held = table.slice(cuts[-1])
        if held is not None and held.num_rows:
            yield from held.combine_chunks().to_batches()

    laid = classes.repartitionByRange("host", "path", "key").sortWithinPartitions("host", "path", "key")
    once = work.save(laid.mapInArrow(inner, LINES + ", far array<int>, deleted array<int>, side string, part long"), "inner")
    edges = once.filter("side is not null").drop("far", "deleted")
    # borders lie between partitions that have rows; their numbers are one row a partition
    parts = edges.select("part").distinct().withColumn("border", F.row_number().over(Window.orderBy("part")))
    edges = edges.join(F.broadcast(parts), "part").withColumn("border", F.col("border") - F.when(F.col("side") == "first", 1).otherwise(0))
    dealt = edges.dropDuplicates(["border", "key"]).repartition("border").sortWithinPartitions("border", "host", "path", "key").select(*Row._fields, "border")
    outside = dealt.mapInArrow(border, "key binary, far array<int>, deleted array<int>")
    both = once.filter("side is null").select("key", "far", "deleted").unionByName(outside)
    of_class = both.groupBy(F.col("key").alias("class")).agg(F.min_by("deleted", "far").alias("deleted")).filter("size(deleted) > 0")
    return work.save(parsed.filter("size(opened) > 0").select("key", "class").distinct().join(of_class, "class").select("key", "deleted"), "deleted")


def main_text(page: str | None, deleted: list[int] | None) -> str:
    found = blocks(page)
    wanted = BODY if any(r == BODY for r, _ in found) else OPEN
    gone = set(deleted or ())
    return "\n\n".join(t for i, (r, t) in enumerate(found) if r == wanted and i not in gone)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and n_template (lines that the nearest page shares and that are deleted so) of every row of pages."""
    work = Workspace(pages.sparkSession, "html")
    keyed = pages.select("page_id", "url", "html", row_key("page_id", "url", "html").alias("key"))
    gone = differences(keyed, work)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, d) for h, d in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(d or ()) for d in batch.column(3).to_pylist()], pa.int64())], ["page_id", "url", "text", "n_chars", "n_template"])

    return keyed.join(gone, "key", "left").select("page_id", "url", "html", "deleted").mapInArrow(write, "page_id long, url string, text string, n_chars long, n_template long")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
