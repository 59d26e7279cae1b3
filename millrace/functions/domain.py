"""Decision rules (DOM): one row in, one conserved decision out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.plans.catalog import query, table

from .values import SCORE, scored


@query("dom01_attribution", "SELECT doc_id, CASE WHEN contains(lower(substr(text, 1, 400)), ' the ') AND contains(lower(substr(text, 1, 400)), ' der ') THEN 'needs_review' WHEN contains(lower(substr(text, 1, 400)), ' der ') THEN 'de' WHEN contains(lower(substr(text, 1, 400)), ' the ') THEN 'en' WHEN lang IN ('fr','es') THEN lang ELSE 'fallback' END AS region, CASE WHEN contains(lower(substr(text, 1, 400)), ' the ') <> contains(lower(substr(text, 1, 400)), ' der ') THEN 90 WHEN lang IN ('fr','es') THEN 80 ELSE 40 END AS confidence FROM documents")
def dom01(spark: SparkSession, sf: str) -> DataFrame:
    """Lead evidence over source evidence over fallback; contradicting leads go to review."""
    lead = F.lower(F.substring("text", 1, 400))
    en, de, local = lead.contains(" the "), lead.contains(" der "), F.col("lang").isin("fr", "es")
    region = F.when(en & de, "needs_review").when(de, "de").when(en, "en").when(local, F.col("lang")).otherwise("fallback")
    return table(spark, sf, "documents").select("doc_id", region.alias("region"), F.when(en != de, 90).when(local, 80).otherwise(40).alias("confidence"))


def lifecycle(status: Column, start: Column, now: Column) -> Column:
    """struct(action, reason): done stays done, a due start runs, running waits for an observed winner."""
    due = start.isNotNull() & (now >= start)
    action = F.when((status == "O") & due, "run").otherwise("noop")
    reason = F.when(status == "F", "finished").when(start.isNull(), "no_start").when(status == "P", "awaiting_winner").when(due, "due").otherwise("scheduled")
    return F.struct(action.alias("action"), reason.alias("reason"))


@query("dom02_lifecycle", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '2000-01-01' THEN 'run' ELSE 'noop' END AS action, CASE WHEN o_orderstatus = 'F' THEN 'finished' WHEN o_orderstatus = 'P' THEN 'awaiting_winner' WHEN o_orderdate <= TIMESTAMP '2000-01-01' THEN 'due' ELSE 'scheduled' END AS reason FROM orders")
def dom02(spark: SparkSession, sf: str) -> DataFrame:
    d = lifecycle(F.col("o_orderstatus"), F.col("o_orderdate"), F.lit("2000-01-01").cast("timestamp_ntz"))
    return table(spark, sf, "orders").select("o_orderkey", d.alias("d")).select("o_orderkey", "d.action", "d.reason")


def review_mode(score: Column, hard: Column) -> Column:
    return F.when(hard, "ignored").when(score >= 75, "auto").when(score >= 45, "manual").otherwise("ignored")


@query("dom03_review_mode", f"SELECT doc_id, CASE WHEN n_chars < 80 THEN 'ignored' WHEN score >= 75 THEN 'auto' WHEN score >= 45 THEN 'manual' ELSE 'ignored' END AS mode FROM (SELECT d.doc_id, n_chars, {SCORE} AS score FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)")
def dom03(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("doc_id", review_mode(F.col("score"), F.col("n_chars") < 80).alias("mode"))


@query("dom04_hard_duplicate", "WITH g AS (SELECT doc_id, source, n_chars, first_value(doc_id) OVER w AS first_id, first_value(source) OVER w AS first_source FROM documents WINDOW w AS (PARTITION BY sha256(text) ORDER BY doc_id)) SELECT doc_id, first_id, CASE WHEN source = first_source THEN 'same_source_copy' ELSE 'cross_source_copy' END AS rule FROM g WHERE doc_id <> first_id")
def dom04(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("fp"))
    first = d.groupBy("fp").agg(F.min_by(F.struct(F.col("doc_id").alias("first_id"), F.col("source").alias("first_source")), "doc_id").alias("f")).select("fp", "f.*")
    return d.join(first, "fp").filter("doc_id <> first_id").select("doc_id", "first_id", F.when(F.col("source") == F.col("first_source"), "same_source_copy").otherwise("cross_source_copy").alias("rule"))


@query("dom05_gate_issues", "SELECT doc_id, concat_ws(',', CASE WHEN n_chars < 80 THEN 'B:too_short' END, CASE WHEN contains(text, '!!') THEN 'W:shouting' END, CASE WHEN regexp_matches(text, '[0-9]{16}') THEN 'B:card_number' END, CASE WHEN lang IS NULL THEN 'W:no_language' END) AS issues, n_chars < 80 OR regexp_matches(text, '[0-9]{16}') AS blocked FROM documents")
def dom05(spark: SparkSession, sf: str) -> DataFrame:
    """All rules of a row as one array of issues; blockers decide."""
    issue = lambda c, kind, code: F.when(c, F.struct(F.lit(kind).alias("kind"), F.lit(code).alias("code")))
    found = F.array_compact(F.array(issue(F.col("n_chars") < 80, "B", "too_short"), issue(F.col("text").contains("!!"), "W", "shouting"), issue(F.col("text").rlike("[0-9]{16}"), "B", "card_number"), issue(F.col("lang").isNull(), "W", "no_language")))
    d = table(spark, sf, "documents").select("doc_id", found.alias("i"))
    return d.select("doc_id", F.array_join(F.transform("i", lambda x: F.concat_ws(":", x["kind"], x["code"])), ",").alias("issues"), F.exists("i", lambda x: x["kind"] == "B").alias("blocked"))


SELECTION = f"WITH s AS (SELECT d.doc_id, d.lang, sha256(d.text) AS fp, {SCORE} AS score FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id), u AS (SELECT *, row_number() OVER (PARTITION BY lang, fp ORDER BY score DESC, doc_id) AS copy FROM s), r AS (SELECT *, CASE WHEN copy = 1 THEN row_number() OVER (PARTITION BY lang, copy = 1 ORDER BY (score >= 60)::INT DESC, score DESC, doc_id) END AS rank, count(*) FILTER (WHERE copy = 1 AND score >= 60) OVER (PARTITION BY lang) AS normal FROM u) SELECT doc_id, CASE WHEN copy > 1 THEN 'duplicate' WHEN score >= 60 AND rank <= 5 THEN 'selected' WHEN score >= 60 THEN 'over_quota' WHEN score >= 45 AND rank <= greatest(1, least(normal, 5)) THEN 'soft_fill' ELSE 'below' END AS reason FROM r"


@query("dom06_select_candidates", SELECTION)
def dom06(spark: SparkSession, sf: str) -> DataFrame:
    """Gate, keep-first by fingerprint, best five by region, soft fill up to one; losers keep their reason."""
    s = scored(spark, sf).join(table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("fp")), "doc_id")
    first = s.groupBy("lang", "fp").agg(F.min_by("doc_id", F.struct(-F.col("score"), "doc_id")).alias("winner"))
    s = s.alias("s").join(first.alias("f"), F.expr("s.fp = f.fp and s.lang <=> f.lang")).select("doc_id", "s.lang", "score", (F.col("doc_id") == F.col("winner")).alias("kept"))
    # only the best five of a region take part in the choice: each task keeps its own five first
    order = Window.partitionBy("lang").orderBy(F.desc(F.col("score") >= 60), F.desc("score"), "doc_id")
    top = s.filter("kept").withColumn("rank", F.row_number().over(order)).filter("rank <= 5").select(F.col("doc_id").alias("top_id"), "rank")
    normal = s.filter(F.col("kept") & (F.col("score") >= 60)).groupBy(F.col("lang").alias("of_lang")).agg(F.count("*").alias("normal"))
    r = s.join(top, F.col("doc_id") == F.col("top_id"), "left").join(normal, F.col("lang").eqNullSafe(F.col("of_lang")), "left").fillna({"normal": 0, "rank": 6})
    fill = F.greatest(F.lit(1), F.least("normal", F.lit(5)))
    return r.select("doc_id", F.when(~F.col("kept"), "duplicate").when((F.col("score") >= 60) & (F.col("rank") <= 5), "selected").when(F.col("score") >= 60, "over_quota").when((F.col("score") >= 45) & (F.col("rank") <= fill), "soft_fill").otherwise("below").alias("reason"))


@query("dom07_public_year", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 5 > 0 THEN year(o_orderdate) END, 1995)::INTEGER AS y FROM orders")
def dom07(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", F.coalesce(F.when(F.col("o_orderkey") % 5 > 0, F.year("o_orderdate")), F.lit(1995)).alias("y"))


@query("dom08_auto_publish_policy", "WITH b AS (SELECT source, count(*) AS backlog FROM documents WHERE n_chars < 500 GROUP BY 1) SELECT d.doc_id, CASE WHEN d.lang NOT IN ('en','de') THEN 'not_eligible' WHEN coalesce(backlog, 0) > 25 THEN 'backlog' ELSE 'allowed' END AS policy FROM documents d LEFT JOIN b ON b.source = d.source")
def dom08(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    backlog = d.filter("n_chars < 500").groupBy("source").agg(F.count("*").alias("backlog"))
    return d.join(backlog, "source", "left").select("doc_id", F.when(~F.col("lang").isin("en", "de"), "not_eligible").when(F.coalesce("backlog", F.lit(0)) > 25, "backlog").otherwise("allowed").alias("policy"))


@query("dom09_rerun_diff", "SELECT doc_id, lang AS old_region, CASE WHEN contains(text, 'ß') THEN 'de' ELSE lang END AS new_region FROM documents WHERE lang IS DISTINCT FROM CASE WHEN contains(text, 'ß') THEN 'de' ELSE lang END")
def dom09(spark: SparkSession, sf: str) -> DataFrame:
    """A dry run lists only rows whose outcome would change."""
    new = F.when(F.col("text").contains("ß"), "de").otherwise(F.col("lang"))
    return table(spark, sf, "documents").filter(~F.col("lang").eqNullSafe(new)).select("doc_id", F.col("lang").alias("old_region"), new.alias("new_region"))


@query("dom10_new_facts", "WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]{7,}')) AS facts FROM conversations), l AS (SELECT conv_id, turn, facts, lag(facts) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM t) SELECT conv_id, turn, len(list_filter(facts, lambda f: before IS NULL OR NOT list_contains(before, f))) AS n_new FROM l")
def dom10(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of a turn that the turn before doesn't have."""
    facts = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{7,}"), F.lit(0)))
    t = table(spark, sf, "conversations").select("conv_id", "turn", facts.alias("facts"))
    before = F.lag("facts").over(Window.partitionBy("conv_id").orderBy("turn"))
    t = t.withColumn("before", F.coalesce(before, F.array().cast("array<string>")))
    return t.select("conv_id", "turn", F.size(F.array_except("facts", "before")).cast("long").alias("n_new"))


@query("dom11_revival", "SELECT d.doc_id, CASE WHEN l.quality = 0 AND d.source IN ('src1','src2','src3') THEN 'revived' WHEN l.quality = 0 THEN 'ignored' ELSE 'active' END AS status FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
def dom11(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    low = F.col("quality") == 0
    return d.select("doc_id", F.when(low & F.col("source").isin("src1", "src2", "src3"), "revived").when(low, "ignored").otherwise("active").alias("status"))
