"""Aggregations (AGG). Counts are exact; every aggregate is partial before its shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.plans.catalog import query, table

from .filters import coverage_bucket


def count_if(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


@query("agg02_empty_input", "SELECT coalesce(max(event_id), 0) AS top, count(*) AS n FROM events WHERE event_type = 'nothing'")
def agg02(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").filter("event_type = 'nothing'").agg(F.coalesce(F.max("event_id"), F.lit(0).cast("long")).alias("top"), F.count("*").alias("n"))


@query("agg03_filtered", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS big, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1")
def agg03(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(count_if(F.col("o_totalprice") > 100000).alias("big"), count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))


@query("agg04_conditional_money", "SELECT l_linestatus, CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS DECIMAL(28,2)) AS returned FROM lineitem GROUP BY 1")
def agg04(spark: SparkSession, sf: str) -> DataFrame:
    money = F.col("l_extendedprice").cast("decimal(18,2)")
    return table(spark, sf, "lineitem").groupBy("l_linestatus").agg(F.sum(F.when(F.col("l_returnflag") == "R", money).otherwise(0)).cast("decimal(28,2)").alias("returned"))


@query("agg05_count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1")
def agg05(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("agg06_representative", "SELECT user_id, min(event_id) AS first_id, max(ts) AS last_ts, arg_max(event_type, event_id) AS last_type FROM events GROUP BY 1")
def agg06(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id").agg(F.min("event_id").alias("first_id"), F.max("ts").alias("last_ts"), F.max_by("event_type", "event_id").alias("last_type"))


@query("agg07_evidence_rollup", "SELECT user_id, round(sum(value), 4) AS total, count(DISTINCT event_type) AS kinds, max(value) AS top, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1")
def agg07(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("total"), F.count_distinct("event_type").alias("kinds"), F.max("value").alias("top"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


@query("agg08_first_five_distinct", "WITH f AS (SELECT user_id, props, min(event_id) AS pos FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS k FROM f) SELECT user_id, string_agg(props, '|' ORDER BY pos) AS contexts FROM r WHERE k <= 5 GROUP BY 1")
def agg08(spark: SparkSession, sf: str) -> DataFrame:
    """First five distinct values in order; the window is cut before rows are collected, so lists stay short."""
    first = table(spark, sf, "events").groupBy("user_id", "props").agg(F.min("event_id").alias("at"))
    top = first.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("at"))).filter("k <= 5")
    return top.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "props"))), lambda x: x["props"]), "|").alias("contexts"))


@query("agg09_funnel_cube", "SELECT lang, source, n_chars > 1000 AS long_text, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, min(n_chars) AS lo, max(n_chars) AS hi, round(avg(n_chars), 4) AS mean FROM documents GROUP BY 1, 2, 3")
def agg09(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("lang", "source", (F.col("n_chars") > 1000).alias("long_text")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"), F.round(F.avg("n_chars"), 4).alias("mean"))


@query("agg10_duplicate_groups", "SELECT sha256(text) AS fp, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def agg10(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("fp")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query("agg11_many_dimensions", "SELECT o_orderstatus AS status, CAST(floor(year(o_orderdate) / 10) * 10 AS INTEGER) AS decade, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (CAST(floor(year(o_orderdate) / 10) * 10 AS INTEGER)), (o_orderpriority))")
def agg11(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), (F.floor(F.year("o_orderdate") / 10) * 10).cast("int").alias("decade"), F.col("o_orderpriority").alias("priority"))
    return o.groupingSets([["status"], ["decade"], ["priority"]], "status", "decade", "priority").agg(F.count("*").alias("n"))


def rate(part: Column, whole: Column, empty: float | None = 1.0) -> Column:
    return F.when(whole == 0, F.lit(empty)).otherwise(part / whole)


@query("agg12_rate_of_nothing", "SELECT o_orderpriority, CASE WHEN count(*) FILTER (WHERE o_totalprice < 0) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS negative_rate, round(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 6) AS finished_rate FROM orders GROUP BY 1")
def agg12(spark: SparkSession, sf: str) -> DataFrame:
    below = count_if(F.col("o_totalprice") < 0)
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(rate(F.lit(0.0), below).alias("negative_rate"), F.round(rate(count_if(F.col("o_orderstatus") == "F"), F.count("*")), 6).alias("finished_rate"))


@query("agg13_conserved_tiers", "SELECT year(o_orderdate) AS y, count(*) FILTER (WHERE o_orderstatus = 'F') AS complete, count(*) FILTER (WHERE o_orderstatus = 'O') AS awaiting, count(*) FILTER (WHERE o_orderstatus = 'P') AS incomplete, count(*) AS total, count(*) FILTER (WHERE o_orderstatus IN ('F','O','P')) = count(*) AS conserved FROM orders GROUP BY 1")
def agg13(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("tier", F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "awaiting").when(F.col("o_orderstatus") == "P", "incomplete"))
    tiers = ["complete", "awaiting", "incomplete"]
    by = o.groupBy(F.year("o_orderdate").alias("y")).agg(*[count_if(F.col("tier") == t).alias(t) for t in tiers], F.count("*").alias("total"))
    return by.withColumn("conserved", sum((F.col(t) for t in tiers), F.lit(0)) == F.col("total"))


def newest_issues(spark: SparkSession, sf: str) -> DataFrame:
    newest = table(spark, sf, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(500)
    odd = F.get_json_object("props", "$.k").cast("long") % 2 == 1
    issues = F.array_compact(F.array(F.struct(F.col("event_type").alias("code"), (F.col("value") > 50).alias("blocker")), F.when(odd, F.struct(F.lit("odd").alias("code"), F.lit(True).alias("blocker")))))
    return newest.select("ts", "event_id", issues.alias("issues"))


@query("agg14_issue_examples", "WITH r AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 500), i AS (SELECT ts, event_id, 0 AS pos, event_type AS code, value > 50 AS blocker FROM r UNION ALL SELECT ts, event_id, 1, 'odd', true FROM r WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 1) SELECT event_id, code, blocker FROM i WHERE code IN ('error', 'odd') ORDER BY ts DESC, event_id DESC, pos LIMIT 20")
def agg14_examples(spark: SparkSession, sf: str) -> DataFrame:
    """The first 20 issues of two codes, of the newest rows first and in each row's own order."""
    i = newest_issues(spark, sf).select("ts", "event_id", F.posexplode("issues").alias("pos", "i")).filter(F.col("i.code").isin("error", "odd"))
    return i.orderBy(F.desc("ts"), F.desc("event_id"), "pos").limit(20).select("event_id", "i.code", "i.blocker")


@query("agg14_issue_summary", "WITH r AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 500), i AS (SELECT event_id, event_type AS code, value > 50 AS blocker FROM r UNION ALL SELECT event_id, 'odd', true FROM r WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 1) SELECT code, count(*) AS n, count(*) FILTER (WHERE blocker) AS blockers FROM i GROUP BY 1")
def agg14(spark: SparkSession, sf: str) -> DataFrame:
    """Issues of the 500 newest rows (a top-k report) by code."""
    return newest_issues(spark, sf).select(F.explode("issues").alias("i")).groupBy("i.code").agg(F.count("*").alias("n"), count_if(F.col("i.blocker")).alias("blockers"))


@query("agg15_time_weighted", "WITH s AS (SELECT user_id, ts, least(coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), TIMESTAMP '2024-01-31'), ts + INTERVAL 1 DAY, TIMESTAMP '2024-01-28') AS stop, value FROM events) SELECT user_id, round(sum(greatest(0, date_diff('microsecond', greatest(ts, TIMESTAMP '2024-01-21'), stop)) / 1e6 * value), 3) AS served FROM s GROUP BY 1")
def agg15(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds times value between snapshots, clipped to the window and each snapshot's expiry."""
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = table(spark, sf, "events").withColumn("stop", F.least(F.coalesce(F.lead("ts").over(order), at("2024-01-31")), F.expr("ts + INTERVAL 1 DAY"), at("2024-01-28"))).withColumn("start", F.greatest("ts", at("2024-01-21")))
    seconds = F.greatest(F.lit(0), F.expr("timestampdiff(MICROSECOND, start, stop)")) / 1e6
    return s.groupBy("user_id").agg(F.round(F.sum(seconds * F.col("value")), 3).alias("served"))


@query("agg16_longest_gap", "WITH e AS (SELECT user_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' UNION ALL SELECT DISTINCT user_id, t FROM events, (VALUES (TIMESTAMP '2024-01-05'), (TIMESTAMP '2024-01-25')) v(t)), g AS (SELECT user_id, date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts), ts) AS gap FROM e) SELECT user_id, max(gap) AS longest_us FROM g GROUP BY 1")
def agg16(spark: SparkSession, sf: str) -> DataFrame:
    """Longest time without an observation, the window's edges included."""
    lo, hi = (F.lit(s).cast("timestamp_ntz") for s in ("2024-01-05", "2024-01-25"))
    e = table(spark, sf, "events").select("user_id", "ts")
    edges = e.select("user_id").distinct().select("user_id", F.explode(F.array(lo, hi)).alias("ts"))
    lagged = e.filter(F.col("ts").between(lo, hi)).unionByName(edges).withColumn("before", F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts")))
    return lagged.groupBy("user_id").agg(F.max(F.expr("timestampdiff(MICROSECOND, before, ts)")).alias("longest_us"))


@query("agg17_covered", "WITH i AS (SELECT user_id, ts AS s, ts + INTERVAL 30 HOUR AS e, max(ts + INTERVAL 30 HOUR) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events) SELECT user_id, min(s) <= TIMESTAMP '2024-01-02' AND max(e) >= TIMESTAMP '2024-01-30' AND bool_and(before IS NULL OR s <= before) AS covered FROM i GROUP BY 1")
def agg17(spark: SparkSession, sf: str) -> DataFrame:
    """Whether sorted intervals cover [start, end] without a hole; touching intervals do."""
    i = table(spark, sf, "events").select("user_id", "event_id", F.col("ts").alias("s"), F.expr("ts + INTERVAL 30 HOURS").alias("e"))
    before = F.max("e").over(Window.partitionBy("user_id").orderBy("s", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    i = i.withColumn("joined", before.isNull() | (F.col("s") <= before))
    return i.groupBy("user_id").agg((F.min("s") <= F.lit("2024-01-02").cast("timestamp_ntz")).alias("a"), (F.max("e") >= F.lit("2024-01-30").cast("timestamp_ntz")).alias("b"), F.bool_and("joined").alias("c")).select("user_id", (F.col("a") & F.col("b") & F.col("c")).alias("covered"))


CONFUSION = "WITH j AS (SELECT d.lang, l.quality AS gold, CASE WHEN d.n_chars >= 400 THEN 1 ELSE 0 END AS pred FROM labels l JOIN documents d USING (doc_id)), c AS (SELECT lang, count(*) FILTER (WHERE gold = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE gold = 0 AND pred = 1) AS fp, count(*) FILTER (WHERE gold = 1 AND pred = 0) AS fn FROM j GROUP BY 1)"


def metrics(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; 1 where there is nothing to find or to be wrong about."""
    p, r = rate(tp, tp + fp), rate(tp, tp + fn)
    return p, r, F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


@query("agg18_precision_recall", CONFUSION + " SELECT lang, tp, fp, fn, round(CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 1 ELSE tp / (tp + fn) END, 6) AS recall, round(CASE WHEN tp = 0 AND fp + fn > 0 THEN 0 WHEN 2 * tp + fp + fn = 0 THEN 1 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM c")
def agg18(spark: SparkSession, sf: str) -> DataFrame:
    d, m = table(spark, sf, "documents").select("doc_id", "lang", (F.col("n_chars") >= 400).alias("pred")), table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("gold"))
    c = m.join(d, "doc_id").groupBy("lang").agg(count_if(F.col("gold") & F.col("pred")).alias("tp"), count_if(~F.col("gold") & F.col("pred")).alias("fp"), count_if(F.col("gold") & ~F.col("pred")).alias("fn"))
    p, r, f1 = metrics(F.col("tp"), F.col("fp"), F.col("fn"))
    return c.select("lang", "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p, zz = k / n, z * z
    centre, half = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    low, high = F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)
    return F.when(n == 0, F.lit(0.0)).otherwise(low), F.when(n == 0, F.lit(0.0)).otherwise(high)


@query("agg19_wilson", "WITH c AS (SELECT quality, sum(toxic)::DOUBLE AS k, count(*)::DOUBLE AS n FROM labels GROUP BY 1) SELECT quality, round(greatest(0, ((k/n + 3.8416/(2*n)) - 1.96*sqrt((k/n)*(1-k/n)/n + 3.8416/(4*n*n))) / (1 + 3.8416/n)), 6) AS low, round(least(1, ((k/n + 3.8416/(2*n)) + 1.96*sqrt((k/n)*(1-k/n)/n + 3.8416/(4*n*n))) / (1 + 3.8416/n)), 6) AS high FROM c")
def agg19(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "labels").groupBy("quality").agg(F.sum("toxic").cast("double").alias("k"), F.count("*").cast("double").alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return c.select("quality", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("agg20_health_snapshot", "SELECT event_type, count(*) AS n, arg_min(event_id, ts) AS first_id, arg_max(event_id, ts) AS last_id, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-30 10:00:00' AND ts <= TIMESTAMP '2024-01-30 12:00:00') AS short_n, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-29 12:00:00' AND ts <= TIMESTAMP '2024-01-30 12:00:00') AS long_n FROM events GROUP BY 1")
def agg20(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    now = at("2024-01-30 12:00:00")
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min_by("event_id", "ts").alias("first_id"), F.max_by("event_id", "ts").alias("last_id"), count_if(F.col("ts").between(at("2024-01-30 10:00:00"), now)).alias("short_n"), count_if(F.col("ts").between(at("2024-01-29 12:00:00"), now)).alias("long_n"))


@query("agg21_set_fingerprint", "SELECT source, sha256(string_agg(fp, ',' ORDER BY cell)) AS fp FROM (SELECT source, doc_id // 1000 AS cell, sha256(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS fp FROM documents GROUP BY 1, 2) GROUP BY 1")
def agg21(spark: SparkSession, sf: str) -> DataFrame:
    """sha256 over the digests of each group's id ranges, in order: ranges of 1,000 ids are fingerprinted first, by all
    tasks, so that no task lists all ids of a group. Two sets are equal if their fingerprints are."""
    ids = F.sort_array(F.collect_list("doc_id"))
    cells = table(spark, sf, "documents").groupBy("source", F.floor(F.col("doc_id") / 1000).alias("cell")).agg(F.sha2(F.array_join(F.transform(ids, lambda x: x.cast("string")), ","), 256).alias("fp"))
    digests = F.sort_array(F.collect_list(F.struct("cell", "fp")))
    return cells.groupBy("source").agg(F.sha2(F.array_join(F.transform(digests, lambda x: x["fp"]), ","), 256).alias("fp"))


@query("agg22_regression_diff", "SELECT CASE WHEN a AND b THEN 'both' WHEN a THEN 'regressed' WHEN b THEN 'fixed' ELSE 'neither' END AS change, count(*) AS n FROM (SELECT coalesce(x.p, false) AS a, coalesce(y.p, false) AS b FROM (SELECT doc_id, quality = 1 AS p FROM labels WHERE doc_id % 10 <> 0) x FULL JOIN (SELECT doc_id, toxic = 0 AS p FROM labels WHERE doc_id % 10 <> 1) y USING (doc_id)) GROUP BY 1")
def agg22(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "labels")
    j = m.filter("doc_id % 10 <> 0").select("doc_id", (F.col("quality") == 1).alias("a")).join(m.filter("doc_id % 10 <> 1").select("doc_id", (F.col("toxic") == 0).alias("b")), "doc_id", "full_outer").fillna(False, ["a", "b"])
    return j.groupBy(F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "regressed").when(F.col("b"), "fixed").otherwise("neither").alias("change")).agg(F.count("*").alias("n"))


@query("agg23_budget_totals", "SELECT l_suppkey, l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,8))) AS DECIMAL(28,8)) AS spent, count(*) AS n FROM lineitem GROUP BY 1, 2")
def agg23(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,8)")).cast("decimal(28,8)").alias("spent"), F.count("*").alias("n"))


@query("agg24_eligibility_census", "WITH d AS (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2) SELECT o_orderkey, concat_ws(',', CASE WHEN n > 1 THEN 'duplicate_year' END, CASE WHEN o_orderstatus = 'P' THEN 'not_settled' END, CASE WHEN o_totalprice < 1000 THEN 'too_small' END) AS reasons FROM orders JOIN d ON d.o_custkey = orders.o_custkey AND d.y = year(o_orderdate)")
def agg24(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("y", F.year("o_orderdate"))
    n = F.count("*").over(Window.partitionBy("o_custkey", "y"))
    reasons = F.array_compact(F.array(F.when(n > 1, "duplicate_year"), F.when(F.col("o_orderstatus") == "P", "not_settled"), F.when(F.col("o_totalprice") < 1000, "too_small")))
    return o.select("o_orderkey", F.array_join(reasons, ",").alias("reasons"))


@query("agg25_career_completeness", "SELECT o_custkey, count(*) AS collected, count(*) FILTER (WHERE o_orderstatus = 'F') AS linked, count(*) FILTER (WHERE o_orderstatus <> 'F') AS unlinked, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'F') = count(*) THEN 'complete' WHEN count(*) FILTER (WHERE o_orderstatus = 'F') * 2 >= count(*) THEN 'partial' ELSE 'sparse' END AS tier FROM orders GROUP BY 1")
def agg25(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("collected"), count_if(F.col("o_orderstatus") == "F").alias("linked"), count_if(F.col("o_orderstatus") != "F").alias("unlinked"))
    return c.withColumn("tier", F.when(F.col("linked") == F.col("collected"), "complete").when(F.col("linked") * 2 >= F.col("collected"), "partial").otherwise("sparse"))


@query("agg26_funnel_losses", "WITH c AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS v, count(*) FILTER (WHERE event_type = 'click') AS c, count(*) FILTER (WHERE event_type = 'purchase') AS p FROM events GROUP BY 1) SELECT user_id, greatest(0, v - c) AS lost_before_click, greatest(0, c - p) AS lost_before_purchase, concat_ws(',', CASE WHEN v > c THEN 'click' END, CASE WHEN c > p THEN 'purchase' END) AS reasons FROM c")
def agg26(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda k: count_if(F.col("event_type") == k)
    c = table(spark, sf, "events").groupBy("user_id").agg(n("view").alias("v"), n("click").alias("c"), n("purchase").alias("p"))
    lost = lambda a, b: F.greatest(F.lit(0).cast("long"), F.col(a) - F.col(b))
    reasons = F.array_compact(F.array(F.when(lost("v", "c") > 0, "click"), F.when(lost("c", "p") > 0, "purchase")))
    return c.select("user_id", lost("v", "c").alias("lost_before_click"), lost("c", "p").alias("lost_before_purchase"), F.array_join(reasons, ",").alias("reasons"))


@query("agg27_balanced_batch", "SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS k FROM orders WHERE o_orderstatus = 'O') WHERE k <= 25")
def agg27(spark: SparkSession, sf: str) -> DataFrame:
    """A batch with at most 25 rows a group (WindowGroupLimit cuts before the shuffle)."""
    k = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, sf, "orders").filter("o_orderstatus = 'O'").withColumn("k", k).filter("k <= 25").select("o_orderpriority", "o_orderkey")


@query("agg28_snapshot_comparison", "SELECT CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.s <> b.s THEN 'reclassified' ELSE 'same' END AS change, count(*) AS n FROM (SELECT c_custkey AS k, c_mktsegment AS s FROM customer WHERE c_custkey % 9 <> 0) a FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 'NONE' ELSE c_mktsegment END AS s FROM customer WHERE c_custkey % 8 <> 0) b ON a.k = b.k GROUP BY 1")
def agg28(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("s"))
    new = c.filter("k % 8 <> 0").select("k", F.when(F.col("k") % 4 == 0, "NONE").otherwise(F.col("s")).alias("s2"))
    j = c.filter("k % 9 <> 0").join(new, "k", "full_outer")
    return j.groupBy(F.when(F.col("s").isNull(), "added").when(F.col("s2").isNull(), "removed").when(F.col("s") != F.col("s2"), "reclassified").otherwise("same").alias("change")).agg(F.count("*").alias("n"))


@query("agg13_layered_coverage", "SELECT bucket, year(o_orderdate) <= 1998 AS historical, count(*) AS n FROM (SELECT *, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 0 THEN 'confirmed' WHEN o_orderpriority = '5-LOW' THEN 'manual_pause' WHEN o_orderdate > TIMESTAMP '2001-01-01' THEN 'awaiting_window' WHEN o_orderstatus = 'P' THEN 'enrolled' ELSE 'missing' END AS bucket FROM orders) GROUP BY 1, 2")
def agg13b(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy(coverage_bucket().alias("bucket"), (F.year("o_orderdate") <= 1998).alias("historical")).agg(F.count("*").alias("n"))
