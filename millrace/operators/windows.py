"""Ranking and analytic operators (WIN), sorting and paging (SORT)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.plans.catalog import query, table

from .filters import PRIORITY_SQL, priority_rank
from .ordering import neighbours, quantiles, ranked


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key: the first in the given total order."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__k = 1").drop("__k")


@query("win01_latest_per_key", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def win01(spark: SparkSession, sf: str) -> DataFrame:
    return latest(table(spark, sf, "events").select("user_id", "ts", "event_id"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id")


@query("win02_first_per_key", "SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def win02(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("win03_rank_in_window", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank, CASE WHEN n_chars >= 1000 THEN 'selected' ELSE 'below' END AS reason FROM documents")
def win03(spark: SparkSession, sf: str) -> DataFrame:
    """A source may hold a large part of all documents, so that its rows are ranked by ranges."""
    d = ranked(table(spark, sf, "documents").select("doc_id", "source", "n_chars"), ["source"], [F.desc("n_chars"), F.col("doc_id")])
    return d.select("doc_id", F.col("rank").cast("long").alias("rank"), F.when(F.col("n_chars") >= 1000, "selected").otherwise("below").alias("reason"))


@query("win04_best_ties", f"SELECT o_custkey, o_orderkey FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY {PRIORITY_SQL}) AS r FROM orders) WHERE r = 1")
def win04(spark: SparkSession, sf: str) -> DataFrame:
    r = F.rank().over(Window.partitionBy("o_custkey").orderBy(priority_rank(F.col("o_orderpriority"))))
    return table(spark, sf, "orders").withColumn("r", r).filter("r = 1").select("o_custkey", "o_orderkey")


@query("win05_keep_first_copy", "SELECT doc_id, first_value(doc_id) OVER w AS winner, row_number() OVER w = 1 AS kept FROM documents WINDOW w AS (PARTITION BY sha256(text) ORDER BY n_chars DESC, doc_id)")
def win05(spark: SparkSession, sf: str) -> DataFrame:
    """Losers point at the winner. The winner comes from a map-side aggregate, so that many copies fill no task."""
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("fp"), "n_chars")
    first = d.groupBy("fp").agg(F.min_by("doc_id", F.struct(-F.col("n_chars"), "doc_id")).alias("winner"))
    return d.join(first, "fp").select("doc_id", "winner", (F.col("doc_id") == F.col("winner")).alias("kept"))


FEED = """WITH q AS (SELECT doc_id, lang, n_chars >= 3000 AS major, row_number() OVER (PARTITION BY lang ORDER BY (n_chars >= 3000)::INT DESC, n_chars DESC, doc_id DESC) AS k FROM documents),
t AS (SELECT * FROM q WHERE k <= 100), s AS (SELECT lang, CAST(sum(n_chars) AS BIGINT) AS served FROM documents GROUP BY lang), r AS (SELECT lang, row_number() OVER (ORDER BY served, lang) AS place FROM s),
m AS (SELECT t.doc_id, t.lang, t.major, CASE WHEN major THEN 0 ELSE row_number() OVER (PARTITION BY t.lang, major ORDER BY k) END AS round, r.place, t.k FROM t JOIN r ON r.lang = t.lang)
SELECT doc_id, lang, row_number() OVER (ORDER BY major::INT DESC, round, CASE WHEN major THEN 0 ELSE place END, k, doc_id) AS position FROM m"""


def balanced_feed(rows: DataFrame, served: DataFrame, region: str, ident: str, per_region: int = 100) -> DataFrame:
    """rows (region, ident, major, weight): each region's best, majors first, then round robin by least-served region.

    The final order is over at most regions * per_region rows; everything before is partitioned by region and
    cut by rank (WindowGroupLimit) before its shuffle.
    """
    order = Window.partitionBy(region).orderBy(F.desc("major"), F.desc("weight"), F.desc(ident))
    top = rows.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= per_region)
    place = served.withColumn("place", F.row_number().over(Window.orderBy("served", region)))
    top = top.join(place.select(region, "place"), region)
    turn = F.when(F.col("major"), 0).otherwise(F.row_number().over(Window.partitionBy(region, "major").orderBy("k")))
    top = top.withColumn("round", turn)
    position = F.row_number().over(Window.orderBy(F.desc("major"), "round", F.when(F.col("major"), 0).otherwise(F.col("place")), "k", ident))
    return top.withColumn("position", position.cast("long"))


@query("win06_round_robin", FEED)
def win06(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    rows = d.select("doc_id", "lang", (F.col("n_chars") >= 3000).alias("major"), F.col("n_chars").alias("weight"))
    served = d.groupBy("lang").agg(F.sum("n_chars").alias("served"))
    return balanced_feed(rows, served, "lang", "doc_id").select("doc_id", "lang", "position")


@query("win07_top_n_per_group", "SELECT lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 10")
def win07(spark: SparkSession, sf: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id"))
    return table(spark, sf, "documents").withColumn("k", k).filter("k <= 10").select("lang", "doc_id")


@query("win08_lead_lag", "SELECT event_id, lead(value) OVER w AS next_value, lag(event_type) OVER w AS previous_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def win08(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("event_id", F.lead("value").over(w).alias("next_value"), F.lag("event_type").over(w).alias("previous_type"))


@query("win09_balanced_dates", "WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), r AS (SELECT day, CASE WHEN day < DATE '2024-01-04' THEN row_number() OVER (PARTITION BY day < DATE '2024-01-04' ORDER BY day DESC) END AS b, CASE WHEN day > DATE '2024-01-04' THEN row_number() OVER (PARTITION BY day > DATE '2024-01-04' ORDER BY day) END AS a FROM d), n AS (SELECT count(b) AS nb, count(a) AS na FROM r) SELECT day FROM r, n WHERE (b IS NULL AND a IS NULL) OR b <= 5 + greatest(0, 5 - na) OR a <= 5 + greatest(0, 5 - nb)")
def win09(spark: SparkSession, sf: str) -> DataFrame:
    """Five days before and after an anchor; a side that is short lends its places to the other."""
    anchor, side = F.lit("2024-01-04").cast("date"), 5
    d = table(spark, sf, "events").select(F.col("ts").cast("date").alias("day")).distinct().withColumn("before", F.col("day") < anchor).withColumn("after", F.col("day") > anchor)
    one = Window.partitionBy()
    d = d.withColumn("b", F.when(F.col("before"), F.row_number().over(Window.partitionBy("before").orderBy(F.desc("day"))))).withColumn("a", F.when(F.col("after"), F.row_number().over(Window.partitionBy("after").orderBy("day"))))
    d = d.withColumn("nb", F.count("b").over(one)).withColumn("na", F.count("a").over(one))
    lent = lambda n: side + F.greatest(F.lit(0), side - F.col(n))
    return d.filter((~F.col("before") & ~F.col("after")) | (F.col("b") <= lent("na")) | (F.col("a") <= lent("nb"))).select("day")


def streaks(df: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """Consecutive failures up to each row: gaps and islands."""
    w = Window.partitionBy(key).orderBy(*order)
    resets = df.withColumn("__failed", failed).withColumn("__island", F.sum(F.when(F.col("__failed"), 0).otherwise(1)).over(w))
    return resets.withColumn("streak", F.sum(F.col("__failed").cast("long")).over(Window.partitionBy(key, "__island").orderBy(*order))).drop("__failed", "__island")


@query("win10_backoff", "WITH i AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events), s AS (SELECT event_id, CAST(sum((event_type = 'error')::INT) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS BIGINT) AS streak FROM i) SELECT event_id, streak, CAST(least(300 * pow(2, least(streak, 6)), 21600) AS BIGINT) AS backoff FROM s")
def win10(spark: SparkSession, sf: str) -> DataFrame:
    s = streaks(table(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    return s.select("event_id", "streak", F.least(300 * F.pow(F.lit(2), F.least(F.col("streak"), F.lit(6))), F.lit(21600)).cast("long").alias("backoff"))


@query("win11_second_slot", "WITH r AS (SELECT *, row_number() OVER w AS slot, first_value(ts) OVER w AS t1, first_value(event_type) OVER w AS a1 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, CASE WHEN slot = 1 THEN 'active' WHEN event_type = a1 OR event_type = 'error' OR a1 = 'error' THEN 'same_angle' WHEN ts >= t1 + INTERVAL 1 DAY THEN 'active' ELSE 'waiting' END AS state FROM r WHERE slot <= 2")
def win11(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    r = table(spark, sf, "events").withColumn("slot", F.row_number().over(w)).withColumn("t1", F.first("ts").over(w)).withColumn("a1", F.first("event_type").over(w)).filter("slot <= 2")
    other = (F.col("event_type") == F.col("a1")) | (F.col("event_type") == "error") | (F.col("a1") == "error")
    return r.select("event_id", F.when(F.col("slot") == 1, "active").when(other, "same_angle").when(F.expr("ts >= t1 + INTERVAL 1 DAY"), "active").otherwise("waiting").alias("state"))


@query("win12_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def win12(spark: SparkSession, sf: str) -> DataFrame:
    """Order statistics from ranks: no task buffers a type's values."""
    found = quantiles(table(spark, sf, "events"), ["event_type"], "value", "event_id", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return found.select("event_type", *[F.round(p, 6).alias(p) for p in ("p50", "p95", "p99")])


@query("win13_legal_ranking", "WITH r AS (SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS legal, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS same FROM lineitem) SELECT l_orderkey, bool_and(l_linenumber = legal) AS complete, bool_or(same > 1) AS dead_heat FROM r GROUP BY 1")
def win13(spark: SparkSession, sf: str) -> DataFrame:
    """Competition ranking: each position is one more than the number of better ones."""
    w = Window.partitionBy("l_orderkey")
    r = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.rank().over(w.orderBy("l_linenumber")).alias("legal"), F.count("*").over(Window.partitionBy("l_orderkey", "l_linenumber")).alias("same"))
    return r.groupBy("l_orderkey").agg(F.bool_and(F.col("l_linenumber") == F.col("legal")).alias("complete"), F.bool_or(F.col("same") > 1).alias("dead_heat"))


@query("win14_fallback_tiers", "WITH t AS (SELECT user_id, event_id, value, CASE WHEN ts > TIMESTAMP '2024-01-27 12:00:00' THEN 0 WHEN ts > TIMESTAMP '2024-01-23 12:00:00' THEN 1 ELSE 2 END AS tier FROM events WHERE ts <= TIMESTAMP '2024-01-30 12:00:00' AND event_type = 'purchase') SELECT user_id, event_id, tier FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tier, value DESC, event_id) AS k FROM t) WHERE k = 1")
def win14(spark: SparkSession, sf: str) -> DataFrame:
    """The best row of the last 72 hours, else of 7 days, else of all."""
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    e = table(spark, sf, "events").filter((F.col("ts") <= at("2024-01-30 12:00:00")) & (F.col("event_type") == "purchase"))
    e = e.withColumn("tier", F.when(F.col("ts") > at("2024-01-27 12:00:00"), 0).when(F.col("ts") > at("2024-01-23 12:00:00"), 1).otherwise(2))
    return e.groupBy("user_id").agg(F.min_by(F.struct("event_id", "tier"), F.struct("tier", -F.col("value"), "event_id")).alias("b")).select("user_id", "b.event_id", "b.tier")


@query("win15_due_sources", "WITH s AS (SELECT user_id, max(ts) AS seen, max(ts) FILTER (WHERE event_type = 'purchase') AS done FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY done NULLS FIRST, user_id) AS k FROM s WHERE seen <= TIMESTAMP '2024-01-30' ) SELECT s.user_id, CASE WHEN r.user_id IS NULL THEN 'skipped' WHEN k <= 20 THEN 'selected' ELSE 'deferred' END AS state FROM s LEFT JOIN r ON r.user_id = s.user_id")
def win15(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("seen"), F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("done"))
    due = F.col("seen") <= F.lit("2024-01-30").cast("timestamp_ntz")
    chosen = s.filter(due).orderBy(F.col("done").asc_nulls_first(), "user_id").limit(20).select("user_id", F.lit(True).alias("chosen"))
    return s.join(chosen, "user_id", "left").select("user_id", F.when(~due, "skipped").when(F.col("chosen"), "selected").otherwise("deferred").alias("state"))


@query("sort01_mixed_order", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderdate NULLS LAST, o_orderkey) AS place FROM orders QUALIFY place <= 200")
def sort01(spark: SparkSession, sf: str) -> DataFrame:
    top = table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), F.col("o_orderdate").asc_nulls_last(), "o_orderkey").limit(200)
    return top.select("o_orderkey", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), F.col("o_orderdate").asc_nulls_last(), "o_orderkey")).cast("long").alias("place"))


@query("sort02_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def sort02(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


@query("sort03_case_priority", f"SELECT o_orderkey FROM orders ORDER BY {PRIORITY_SQL}, o_orderdate, o_orderkey LIMIT 100")
def sort03(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").orderBy(priority_rank(F.col("o_orderpriority")), "o_orderdate", "o_orderkey").select("o_orderkey").limit(100)


def keyset_page(df: DataFrame, keys: list[str], cursor: tuple, size: int, descending: bool = True) -> DataFrame:
    """The size + 1 rows after a cursor, in the total order of keys; the last tells whether there is more."""
    after, equal = F.lit(False), F.lit(True)
    for k, v in zip(keys, cursor, strict=True):
        bound = F.lit(v).cast(df.schema[k].dataType)
        after = after | (equal & ((F.col(k) < bound) if descending else (F.col(k) > bound)))
        equal = equal & (F.col(k) == bound)
    return df.filter(after).orderBy(*[F.desc(k) if descending else F.asc(k) for k in keys]).limit(size + 1)


@query("sort04_keyset_page", "SELECT event_id, ts FROM events WHERE event_id <= 9000 AND (ts < TIMESTAMP '2024-01-20' OR (ts = TIMESTAMP '2024-01-20' AND event_id < 500)) ORDER BY ts DESC, event_id DESC LIMIT 26")
def sort04(spark: SparkSession, sf: str) -> DataFrame:
    return keyset_page(table(spark, sf, "events").filter("event_id <= 9000").select("event_id", "ts"), ["ts", "event_id"], ("2024-01-20", 500), 25)


@query("sort05_nullable_keyset", "WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE n_chars END AS k FROM documents) SELECT doc_id, k FROM d WHERE (k IS NOT NULL AND k > 2000) OR (k = 2000 AND doc_id > 10) OR k IS NULL ORDER BY k NULLS LAST, doc_id LIMIT 51")
def sort05(spark: SparkSession, sf: str) -> DataFrame:
    """Nulls last on a nullable key: the null flag is a key of its own."""
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("n_chars")).alias("k"))
    after = (F.col("k") > 2000) | ((F.col("k") == 2000) & (F.col("doc_id") > 10)) | F.col("k").isNull()
    return d.filter(after).orderBy(F.col("k").asc_nulls_last(), "doc_id").limit(51)


@query("sort06_offset_page", "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20 OFFSET 40")
def sort06(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").orderBy("o_orderdate", "o_orderkey").offset(40).limit(20).select("o_orderkey")


@query("sort07_frozen_replay", "WITH f AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS pos FROM documents QUALIFY pos <= 300) SELECT f.doc_id, pos FROM f WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = f.doc_id AND l.toxic = 1) ORDER BY pos LIMIT 50")
def sort07(spark: SparkSession, sf: str) -> DataFrame:
    """A stored order is replayed; rows withdrawn since are skipped and the page is filled up."""
    d = table(spark, sf, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(300)
    frozen = d.select("doc_id", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")).cast("long").alias("pos"))
    gone = table(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    return frozen.join(gone, "doc_id", "left_anti").orderBy("pos").limit(50)


@query("sort08_neighbours", "SELECT event_id, lag(event_id) OVER w AS previous_id, lead(event_id) OVER w AS next_id FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)")
def sort08(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "event_type", "ts")
    return neighbours(e, ["event_type"], [F.col("ts"), F.col("event_id")], "event_id", "previous_id", "next_id").select("event_id", "previous_id", "next_id")
