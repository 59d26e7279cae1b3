"""Set operations (SET) and graphs (GRAPH)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.catalog import query, table

from .ordering import stored


@query("set01_union", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' UNION SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def set01(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).union(table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")).distinct()


@query("set02_channels", "WITH u AS (SELECT doc_id, 'long' AS channel FROM documents WHERE n_chars > 1500 UNION ALL SELECT doc_id, 'english' FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 'labelled' FROM labels) SELECT doc_id, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels FROM u GROUP BY 1")
def set02(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    own = d.select("doc_id", F.explode(F.array_compact(F.array(F.when(F.col("n_chars") > 1500, "long"), F.when(F.col("lang") == "en", "english")))).alias("channel"))
    both = own.unionByName(table(spark, sf, "labels").select("doc_id", F.lit("labelled").alias("channel")))
    return both.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("channel")), ",").alias("channels"))


@query("set03_intersect_except", "(SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels WHERE quality = 1) EXCEPT SELECT doc_id FROM labels WHERE toxic = 1")
def set03(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "labels")
    return table(spark, sf, "documents").select("doc_id").intersect(m.filter("quality = 1").select("doc_id")).subtract(m.filter("toxic = 1").select("doc_id"))


@query("set04_distinct", "SELECT DISTINCT user_id, event_type FROM events")
def set04(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("user_id", "event_type").distinct()


@query("graph01_descendants", "WITH RECURSIVE d(root, k, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION ALL SELECT d.root, p.p_partkey, depth + 1 FROM d JOIN part p ON p.p_partkey // 2 = d.k AND p.p_partkey <> d.k WHERE depth < 4) SELECT root, k, min(depth)::INTEGER AS depth FROM d WHERE depth > 0 GROUP BY 1, 2")
def graph01(spark: SparkSession, sf: str) -> DataFrame:
    """Descendants to a depth of 4, level by level; each level joins only its newly reached nodes."""
    edges = table(spark, sf, "part").select((F.col("p_partkey") / 2).cast("long").alias("k"), F.col("p_partkey").alias("child")).filter("child <> k")
    level = table(spark, sf, "part").select(F.col("p_partkey").alias("root"), F.col("p_partkey").alias("k"))
    return descendants(level, edges, 4)


def descendants(roots: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(root, k, depth) below roots (root, k) along edges (k, child); a node counts at its first level."""
    level, found = roots, None
    for d in range(1, depth + 1):
        level = level.join(edges, "k").select("root", F.col("child").alias("k")).distinct()
        if found is not None:
            level = level.join(found.select("root", "k"), ["root", "k"], "left_anti")
        step = level.withColumn("depth", F.lit(d))
        found = step if found is None else found.unionByName(step)
    return found


@query("graph02_cycle_paths", "WITH RECURSIVE e AS (SELECT p_partkey AS a, (p_partkey * 7 + 3) % 50 AS b FROM part WHERE p_partkey < 50), w(start, k, path, n) AS (SELECT a, b, a::VARCHAR || '>' || b::VARCHAR, 1 FROM e UNION ALL SELECT w.start, e.b, path || '>' || e.b::VARCHAR, n + 1 FROM w JOIN e ON e.a = w.k WHERE w.k <> w.start AND n < 12) SELECT start, min(path) AS path FROM w WHERE k = start GROUP BY 1")
def graph02(spark: SparkSession, sf: str) -> DataFrame:
    """Ways back over the edges of all parts; as no edge leads to a part from 50 on, the SQL's cut has the same rows."""
    found = shortest_cycles(table(spark, sf, "part").select(F.col("p_partkey").alias("a"), ((F.col("p_partkey") * 7 + 3) % 50).alias("b")))
    return found.select("start", F.array_join(F.transform("path", lambda k: k.cast("string")), ">").alias("path"))


def shortest_cycles(edges: DataFrame) -> DataFrame:
    """(start, path): the shortest way by edges (a, b) from each node back to itself, as an array from start to start.

    All starts are searched at once, a level of edges in each step, until none has new nodes. Each start's nodes are visited
    once, with the node they were reached from, the least of several; a start that has closed isn't searched further. Paths
    are put together backwards from those predecessors. An edge from a node to itself is the path [a, a].
    """
    e = stored(edges.filter("a is not null and b is not null").distinct())
    levels: list[DataFrame] = []
    level = e.filter("a <> b").select(F.col("a").alias("start"), F.col("b").alias("node"), F.col("a").alias("before"))
    closed = e.filter("a = b").select(F.col("a").alias("start"), F.col("a").alias("last"))
    level = stored(level.join(closed.select("start"), "start", "left_anti"))
    while not level.isEmpty():
        levels.append(level)
        back = level.join(e, (F.col("node") == F.col("a")) & (F.col("start") == F.col("b"))).groupBy("start").agg(F.min("node").alias("last"))
        closed = stored(closed.unionByName(back))
        ahead = level.join(closed.select("start"), "start", "left_anti").join(e, F.col("node") == F.col("a")).groupBy("start", F.col("b").alias("node")).agg(F.min("a").alias("before"))
        for seen in levels:
            ahead = ahead.join(seen.select("start", "node"), ["start", "node"], "left_anti")
        level = stored(ahead)
    reached = closed.select("start", F.col("last").alias("node"), F.array("start").alias("path"))
    for seen in reversed(levels):  # a node's predecessor lies one level before; shorter cycles end at an earlier level
        step = reached.join(seen, ["start", "node"], "left")
        reached = stored(step.select("start", F.coalesce("before", "node").alias("node"), F.when(F.col("before").isNotNull(), F.concat(F.array("node"), "path")).otherwise(F.col("path")).alias("path")))
    return reached.select("start", F.concat(F.array("start"), "path").alias("path"))


@query("graph02_relation_cycles")
def graph02_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Shortest cycles among all parts, each with two relations into its block of 50 keys."""
    k, block = F.col("p_partkey"), F.floor(F.col("p_partkey") / 50) * 50
    p = table(spark, sf, "part")
    edges = p.select(k.alias("a"), ((k * 7 + 3) % 50 + block).alias("b")).unionByName(p.select(k.alias("a"), ((k * 3 + F.col("p_size")) % 50 + block).alias("b")))
    found = shortest_cycles(edges)
    return found.select("start", (F.size("path") - 1).cast("long").alias("n_edges"), F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("graph03_follow_expansion", "WITH RECURSIVE f AS (SELECT c_custkey AS who, c_custkey % 100 + 1 AS k FROM customer), d(who, k, n) AS (SELECT who, k, 0 FROM f UNION ALL SELECT who, p.p_partkey, n + 1 FROM d JOIN part p ON p.p_partkey // 2 = d.k AND p.p_partkey <> d.k WHERE n < 2) SELECT who, count(DISTINCT l.l_orderkey) AS n_items FROM d JOIN lineitem l ON l.l_partkey = d.k GROUP BY 1")
def graph03(spark: SparkSession, sf: str) -> DataFrame:
    edges = table(spark, sf, "part").select((F.col("p_partkey") / 2).cast("long").alias("k"), F.col("p_partkey").alias("child")).filter("child <> k")
    follows = table(spark, sf, "customer").select(F.col("c_custkey").alias("root"), (F.col("c_custkey") % 100 + 1).alias("k"))
    reached = follows.unionByName(descendants(follows, edges, 2).select("root", "k")).distinct()
    items = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("k"), "l_orderkey")
    return reached.join(items, "k").groupBy(F.col("root").alias("who")).agg(F.count_distinct("l_orderkey").alias("n_items"))
