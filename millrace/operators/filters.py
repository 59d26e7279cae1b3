"""Projections and predicates (FLT): SQL three-valued logic, pushed to the scan where Catalyst can."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.catalog import query, table


def excluding(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that don't meet the condition; rows for which it is unknown stay."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


@query("flt01_predicate_algebra", "SELECT doc_id, lang FROM documents WHERE (lang IN ('en','de') OR n_chars > 3000) AND NOT coalesce(source = 'src0' AND lang = 'en', false)")
def flt01(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    kept = d.filter(F.col("lang").isin("en", "de") | (F.col("n_chars") > 3000))
    return excluding(kept, (F.col("source") == "src0") & (F.col("lang") == "en")).select("doc_id", "lang")


@query("flt02_closed_range", "SELECT event_id, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12' AND value >= 10")
def flt02(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.filter(F.col("ts").between(F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-12").cast("timestamp_ntz")) & (F.col("value") >= 10)).select("event_id", "value")


@query("flt03_in_list_and_subquery", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F','P') AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def flt03(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    wanted = c.filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return o.filter(F.col("o_orderstatus").isin("F", "P")).join(wanted, "o_custkey", "left_semi").select("o_orderkey")


@query("flt04_blank_tests", "SELECT doc_id, (nullif(trim(text), '') IS NULL) AS blank, (source > '') AS has_source FROM documents WHERE text IS NOT NULL")
def flt04(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").filter("text is not null")
    return d.select("doc_id", F.nullif(F.trim("text"), F.lit("")).isNull().alias("blank"), (F.col("source") > "").alias("has_source"))


@query("flt05_search_any_column", "SELECT doc_id FROM documents WHERE contains(lower(text), 'secret') OR contains(lower(source), 'src1')")
def flt05(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.filter(F.lower("text").contains("secret") | F.lower("source").contains("src1")).select("doc_id")


@query("flt06_equal_ignoring_case", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = lower('Building')")
def flt06(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").filter(F.lower("c_mktsegment") == "building").select("c_custkey")


@query("flt07_regex", "SELECT doc_id, CASE WHEN regexp_matches(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'date' WHEN regexp_matches(text, '[0-9]{9,}') THEN 'number' ELSE 'none' END AS kind FROM documents")
def flt07(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("text").rlike("[0-9]{4}-[0-9]{2}-[0-9]{2}"), "date").when(F.col("text").rlike("[0-9]{9,}"), "number").otherwise("none")
    return table(spark, sf, "documents").select("doc_id", kind.alias("kind"))


@query("flt08_json_key", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL AND json_extract_string(props, '$.missing') IS NULL")
def flt08(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").filter(k.isNotNull() & F.get_json_object("props", "$.missing").isNull()).select("event_id", k.cast("long").alias("k"))


@query("flt09_exists_in_json_array", "SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 = 0 OR event_type = 'error'")
def flt09(spark: SparkSession, sf: str) -> DataFrame:
    """Issue arrays built from props, then tested element by element without exploding."""
    k = F.get_json_object("props", "$.k").cast("long")
    raw = F.to_json(F.array(F.struct(F.lit("k3").alias("code"), (k % 3 == 0).alias("core")), F.struct(F.lit("type").alias("code"), (F.col("event_type") == "error").alias("core"))))
    issues = F.from_json(raw, "array<struct<code:string,core:boolean>>")
    return table(spark, sf, "events").filter(F.exists(issues, lambda i: i["core"])).select("event_id")


@query("flt10_projection", "SELECT o_orderkey, o_totalprice * 2 AS doubled, upper(o_orderpriority) AS priority FROM orders")
def flt10(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") * 2).alias("doubled"), F.upper("o_orderpriority").alias("priority"))


PRIORITY_SQL = "CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 9 END"


def priority_rank(priority: Column) -> Column:
    return F.when(priority == "1-URGENT", 0).when(priority == "2-HIGH", 1).when(priority == "3-MEDIUM", 2).otherwise(9)


@query("flt11_case_projection", f"SELECT o_orderkey, {PRIORITY_SQL} AS rank FROM orders")
def flt11(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", priority_rank(F.col("o_orderpriority")).alias("rank"))


@query("flt12_coalesce_cast_bound", "SELECT event_id, substr(coalesce(props, '{}'), 1, 6) AS head, coalesce(try_cast(json_extract_string(props, '$.k') AS INTEGER), -1) AS k FROM events")
def flt12(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.substring(F.coalesce("props", F.lit("{}")), 1, 6).alias("head"), F.coalesce(F.expr("try_cast(get_json_object(props, '$.k') AS INT)"), F.lit(-1)).alias("k"))


@query("flt13_visible_either_way", "SELECT DISTINCT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 1 OR (l.doc_id IS NULL AND d.lang = 'en' AND d.n_chars >= 500)")
def flt13(spark: SparkSession, sf: str) -> DataFrame:
    d, m = table(spark, sf, "documents"), table(spark, sf, "labels")
    joined = d.select("doc_id", "lang", "n_chars").join(m.select("doc_id", "quality", F.lit(True).alias("labelled")), "doc_id", "left")
    return joined.filter((F.col("quality") == 1) | (F.col("labelled").isNull() & (F.col("lang") == "en") & (F.col("n_chars") >= 500))).select("doc_id").distinct()


COVERAGE_SQL = "CASE WHEN o_orderstatus = 'F' AND o_totalprice > 0 THEN 'confirmed' WHEN o_orderpriority = '5-LOW' THEN 'manual_pause' WHEN o_orderdate > TIMESTAMP '2001-01-01' THEN 'awaiting_window' WHEN o_orderstatus = 'P' THEN 'enrolled' ELSE 'missing' END"


def coverage_bucket() -> Column:
    """First match wins, so that every row lies in exactly one bucket."""
    return F.when((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 0), "confirmed").when(F.col("o_orderpriority") == "5-LOW", "manual_pause").when(F.col("o_orderdate") > F.lit("2001-01-01").cast("timestamp_ntz"), "awaiting_window").when(F.col("o_orderstatus") == "P", "enrolled").otherwise("missing")


@query("flt14_exactly_one_bucket", f"SELECT bucket, count(*) AS n, sum(count(*)) OVER () = (SELECT count(*) FROM orders) AS conserved FROM (SELECT {COVERAGE_SQL} AS bucket FROM orders) GROUP BY bucket")
def flt14(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    by = o.groupBy(coverage_bucket().alias("bucket")).agg(F.count("*").alias("n"))
    total = o.agg(F.count("*").alias("total"))
    kept = by.agg(F.sum("n").alias("all")).withColumn("one", F.lit(1)).join(total.withColumn("one", F.lit(1)), "one").select((F.col("all") == F.col("total")).alias("conserved"), "one")
    return by.withColumn("one", F.lit(1)).join(kept, "one").select("bucket", "n", "conserved")
