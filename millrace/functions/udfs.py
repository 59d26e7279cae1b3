"""User-defined functions (UDF): scalar, grouped aggregate and table functions, with their native twins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.catalog import query, table

from .timeops import ZONES
from .values import grade


def _shifted(ts: pd.Series, hours: pd.Series) -> pd.Series:
    return ts + pd.to_timedelta(hours, unit="h")


@query("udf01_public_instant", "SELECT event_id, ts + INTERVAL 8 HOUR AS public_ts FROM events")
def udf01(spark: SparkSession, sf: str) -> DataFrame:
    """The scalar form, in Arrow batches; dt01_public_instant is the native one."""
    shifted = F.pandas_udf(_shifted, "timestamp_ntz")
    return table(spark, sf, "events").select("event_id", shifted("ts", F.lit(8)).alias("public_ts"))


@query("udf02_grade_code", "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'G1' WHEN o_orderpriority = '2-HIGH' THEN 'G2' WHEN o_orderpriority = '3-MEDIUM' THEN 'G3' END AS grade FROM orders")
def udf02(spark: SparkSession, sf: str) -> DataFrame:
    """A function named in SQL; its body is a native expression, so that Catalyst inlines it."""
    said = F.concat(F.lit("Grade "), F.regexp_extract("o_orderpriority", "^[0-9]", 0))
    return table(spark, sf, "orders").select("o_orderkey", grade(said).alias("grade"))


@query("udf03_hoisted_catalog", "SELECT zone, count(*) AS n FROM (SELECT list_value('UTC','Asia/Shanghai','Europe/London','America/New_York','Not/AZone')[(event_id % 5)::INT + 1] AS zone FROM events) WHERE zone <> 'Not/AZone' GROUP BY 1")
def udf03(spark: SparkSession, sf: str) -> DataFrame:
    """The zone catalogue as one common table expression that every branch of a statement reads."""
    zones = ", ".join(f"('{z}')" for z in ZONES[:4])
    table(spark, sf, "events").createOrReplaceTempView("udf03_events")
    named = ", ".join(f"'{z}'" for z in ZONES)
    return spark.sql(f"WITH catalog AS (SELECT * FROM VALUES {zones} AS v(zone)), e AS (SELECT element_at(array({named}), CAST(event_id % 5 + 1 AS INT)) AS zone FROM udf03_events) SELECT zone, count(*) AS n FROM e JOIN catalog USING (zone) GROUP BY zone")


@query("udf05_grouped_aggregate", "SELECT event_type, round(max(value) - min(value), 6) AS spread FROM events GROUP BY 1")
def udf05(spark: SparkSession, sf: str) -> DataFrame:
    """A grouped aggregate written in Python. Groups must fit a task: use built-in aggregates for hot keys."""
    reduced = table(spark, sf, "events").groupBy("event_type", F.pmod(F.xxhash64("event_id"), F.lit(64)).alias("cell")).agg(F.max("value").alias("hi"), F.min("value").alias("lo"))
    both = reduced.select("event_type", F.explode(F.array("hi", "lo")).alias("value"))
    spread = F.pandas_udf(_spread, "double")
    return both.groupBy("event_type").agg(F.round(spread("value"), 6).alias("spread"))


def _spread(values: pd.Series) -> float:
    return float(values.max() - values.min())


@query("udf05_table_function", "SELECT item_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM benchmark")
def udf05b(spark: SparkSession, sf: str) -> DataFrame:
    """A table function of a text: one row a word, with its place."""

    @F.udtf(returnType="word string, pos long")
    class Words:
        def eval(self, text: str):
            for i, word in enumerate((text or "").split(" ")):
                yield word, i

    spark.udtf.register("millrace_words", Words)
    table(spark, sf, "benchmark").createOrReplaceTempView("udf05_items")
    return spark.sql("SELECT item_id, w.word, w.pos FROM udf05_items, LATERAL millrace_words(text) w")
