"""Race pages of four layouts (SRC-06): tables to rows of runners and results, which a join merges by number."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.markup import Node, first, records, select, tree
from millrace.plans.catalog import query, table

#: By layout: selectors of the tables of runners and results, what marks a withdrawn runner, and fields by header.
LAYOUTS: dict[str, dict] = {
    "card": {"runners": "table.runners", "results": "table.results", "withdrawn": ".scratched", "fields": {"No": "number", "Horse": "name", "Draw": "draw", "Weight": "weight", "Pos": "position", "Margin": "margin"}},
    "partants": {"runners": "table.table-runners", "results": "#arrivee table", "withdrawn": ".non-partant", "fields": {"N°": "number", "Cheval": "name", "Corde": "draw", "Poids": "weight", "Place": "position", "Écart": "margin"}},
    "shutsuba": {"runners": "table.shutsuba", "results": "table.result", "withdrawn": ".cancel", "fields": {"馬番": "number", "馬名": "name", "枠番": "draw", "斤量": "weight", "着順": "position", "着差": "margin"}},
    "entries": {"runners": "table.table-entries", "results": "table.table-entries", "withdrawn": ".scr", "fields": {"#": "number", "Name": "name", "PP": "draw", "Wgt": "weight", "Fin": "position", "Beaten": "margin"}},
}
ROW = "kind string, pos long, number string, name string, draw string, weight string, status string, position int, margin string"
TYPES = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[c.split()[1]] for c in ROW.split(", ")]
#: Rows that a task holds before it hands them on.
ROWS = 20_000


def _marked(found: Node, selector: str) -> set[int]:
    """Ids of the elements that the selector finds below a table, and of those around them."""
    out: set[int] = set()
    for node in select(found, selector):
        while node is not None and id(node) not in out:
            out.add(id(node))
            node = node.parent
    return out


def page_rows(page: str | None, layout: str) -> list[dict]:
    """Runners with a name, in page order, and results with a number and a position from 1. An unknown layout is a KeyError."""
    rule, root, out = LAYOUTS[layout], tree(page), []
    tables = [first(root, rule[kind + "s"]) for kind in ("runner", "result")]
    read = {id(t): (records(t), _marked(t, rule["withdrawn"])) for t in {id(t): t for t in tables if t is not None}.values()}
    for kind, found in zip(("runner", "result"), tables, strict=True):
        pos = 0
        if found is not None:
            rows, marked = read[id(found)]
            for row, held in rows:
                f = {rule["fields"][k]: v for k, v in held.items() if k in rule["fields"]}
                place = re.search("[0-9]{1,6}", f.get("position", ""))
                position = int(place[0]) if place and int(place[0]) else None
                if kind == "result" and (position is None or not f.get("number")) or kind == "runner" and not f.get("name"):
                    continue
                gone = id(row) in marked
                pos += 1
                out.append({"kind": kind, "pos": pos, "number": f.get("number", ""), "name": f.get("name", ""), "draw": f.get("draw", ""), "weight": f.get("weight", ""), "status": "withdrawn" if gone else "declared", "position": position, "margin": f.get("margin", "")})
    return out


def reference_runners(pages: DataFrame, key: str) -> DataFrame:
    """Runners of landed pages (key, layout, html) merged with results of their number.

    Gives key, pos (from 1), number, name, draw, weight, status, position (null without a result), margin, and complete: whether
    all of the page's declared runners have a position. Of several results of one number the last counts; a runner without
    a number has no result. A page without runners gives no row. Pages may share a key: they are merged as one page each.
    """
    names = [c.split()[0] for c in ROW.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, held = [], []
            for i, (layout, html) in enumerate(zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                rows = page_rows(html, layout)
                held += rows
                at += [i] * len(rows)
                if len(held) >= ROWS:
                    yield rows_of(batch, at, held)
                    at, held = [], []
            yield rows_of(batch, at, held)

    def rows_of(batch: pa.RecordBatch, at: list[int], held: list[dict]) -> pa.RecordBatch:
        own = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(3).take(own), *[pa.array([r[n] for r in held], t) for n, t in zip(names, TYPES, strict=True)]], [key, "page_row", *names])

    sent = pages.select(key, F.coalesce("html", F.lit("")).alias("html"), "layout", F.xxhash64(F.coalesce("html", F.lit("")), "layout").alias("page_row"))
    rows = sent.mapInArrow(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, page_row long, {ROW}")
    # one shuffle by page, which the merge and the count of placed runners share; a page is parsed once
    page = Window.partitionBy(key, "page_row")
    same = Window.partitionBy(key, "page_row", "number").orderBy("kind", "pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    result = lambda c: F.when(F.col("number") != "", F.last(F.when(F.col("kind") == "result", F.col(c)), ignorenulls=True).over(same))
    merged = rows.repartition(key, "page_row").withColumns({"placed": result("position"), "beaten": result("margin")}).filter("kind = 'runner'")
    declared, placed = F.count_if(F.col("status") != "withdrawn").over(page), F.count_if((F.col("status") != "withdrawn") & F.col("placed").isNotNull()).over(page)
    return merged.select(key, "pos", "number", "name", "draw", "weight", "status", F.col("placed").alias("position"), F.coalesce("beaten", F.lit("")).alias("margin"), ((declared > 0) & (declared == placed)).alias("complete"))


def _tr(cells: list, tag: str = "td", css: Column | None = None) -> Column:
    opened = F.lit("<tr>") if css is None else F.concat(F.lit('<tr class="'), css, F.lit('">'))
    return F.concat(opened, *[x for c in cells for x in (F.lit(f"<{tag}>"), c if isinstance(c, Column) else F.lit(c), F.lit(f"</{tag}>"))], F.lit("</tr>"))


def race_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A page of one of the layouts for each order with lines: its lines are the runners, finished ones in reverse order."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").cast("long").alias("quantity"), (F.col("l_returnflag") == "R").alias("gone"), (F.col("l_linestatus") == "F").alias("done"))
    o = table(spark, sf, "lineitem").filter("l_orderkey is not null").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    number = lambda i: (i + 1).cast("string")
    name = lambda x: F.concat(F.lit("Horse &amp; "), x["l_partkey"].cast("string"))
    draw = lambda x: x["l_linenumber"].cast("string")
    weight = lambda x: x["quantity"].cast("string")
    place = lambda i: (F.size("lines") - i).cast("string")
    beaten = lambda i: F.concat((i + 1).cast("string"), F.lit(" L"))
    counts = lambda x: x["done"] & ~x["gone"]
    css = lambda x, name: F.when(x["gone"], name).otherwise("")
    every = lambda f: F.array_join(F.transform("lines", f), "")
    runners = lambda mark: every(lambda x, i: _tr([number(i), name(x), draw(x), weight(x)], css=css(x, mark)))
    results = every(lambda x, i: F.when(counts(x), _tr([place(i), number(i), beaten(i)])).otherwise(""))
    head = lambda *labels: _tr(list(labels), "th")
    card = F.concat(F.lit("<table class='runners'><thead>"), head("No", "Horse", "Draw", "Weight"), F.lit("</thead><tbody>"), runners("scratched"), F.lit("</table><table class='results'>"), head("Pos", "No", "Margin"), results, F.lit("</table>"))
    partants = F.concat(F.lit("<table class='x table-runners'>"), head("N°", "Cheval", "Corde", "Poids"), runners("non-partant"), F.lit("</table><div id=arrivee><p>Arrivée<table>"), head("Place", "N°", "Écart"), every(lambda x, i: F.when(counts(x), F.concat(F.lit("<tr><td>"), place(i), F.lit("e<td>"), number(i), F.lit("<td>"), beaten(i)))), F.lit("</table></div>"))
    shutsuba = F.concat(
        F.lit("<table class=shutsuba><tr><th rowspan=2>馬番</th><th colspan=2>馬</th><th rowspan=2>斤量</th></tr><tr><th>馬名</th><th>枠番</th></tr>"),
        every(lambda x, i: F.concat(F.lit("<tr><td>"), number(i), F.lit("<td>"), name(x), F.when(x["gone"], "<span class=cancel></span>").otherwise(""), F.lit("<td>"), draw(x), F.lit("<td>"), weight(x))),
        F.lit("</table><table class=result>"), head("着順", "馬番", "着差"), results, F.lit("</table>"),
    )
    entries = F.concat(F.lit("<table class=table-entries>"), head("#", "Name", "PP", "Wgt", "Fin", "Beaten"), every(lambda x, i: _tr([number(i), name(x), draw(x), weight(x), F.when(counts(x), place(i)).otherwise("-"), F.when(counts(x), beaten(i)).otherwise("")], css=css(x, "scr"))), F.lit("</table>"))
    kind = F.pmod("l_orderkey", F.lit(4))
    html = F.when(kind == 0, card).when(kind == 1, partants).when(kind == 2, shutsuba).otherwise(entries)
    return o.select("l_orderkey", F.element_at(F.array(*map(F.lit, LAYOUTS)), (kind + 1).cast("int")).alias("layout"), html.alias("html"))


@query(
    "src06_reference_runners",
    """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity::BIGINT, l_returnflag = 'R', l_linestatus = 'F') AS pos, count(*) OVER (PARTITION BY l_orderkey) AS n, l_returnflag = 'R' AS gone, l_linestatus = 'F' AND l_returnflag <> 'R' AS counts FROM lineitem WHERE l_orderkey IS NOT NULL)
SELECT l_orderkey, pos, pos::VARCHAR AS number, 'Horse & ' || l_partkey AS name, l_linenumber::VARCHAR AS draw, (l_quantity::BIGINT)::VARCHAR AS weight,
CASE WHEN gone THEN 'withdrawn' ELSE 'declared' END AS status, CASE WHEN counts THEN (n - pos + 1)::INT END AS position, CASE WHEN counts THEN pos || ' L' ELSE '' END AS margin,
count(*) FILTER (WHERE NOT gone) OVER (PARTITION BY l_orderkey) > 0 AND count(*) FILTER (WHERE NOT gone) OVER (PARTITION BY l_orderkey) = count(*) FILTER (WHERE counts) OVER (PARTITION BY l_orderkey) AS complete
FROM r
""",
)
def src06(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of all orders, parsed and merged again."""
    return reference_runners(race_pages(spark, sf), "l_orderkey")
