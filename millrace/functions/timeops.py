"""Date and time functions (DT). `now` is always a parameter; timestamps are zoneless UTC unless a zone is named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.catalog import query, table

ZONES = ("UTC", "Asia/Shanghai", "Europe/London", "America/New_York", "Not/AZone")
NOW = "2024-01-30 12:00:00"


def at(value: str) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def in_zone(ts: Column, zone: str | Column) -> Column:
    """The wall clock in a zone of a zoneless UTC instant."""
    return F.convert_timezone(F.lit("UTC"), zone if isinstance(zone, Column) else F.lit(zone), ts)


def from_zone(ts: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), ts)


@query("dt01_public_instant", "SELECT event_id, CASE WHEN zone = 'Not/AZone' THEN NULL ELSE ts + INTERVAL 8 HOUR END AS public_ts, CASE WHEN zone = 'Not/AZone' THEN 'invalid_zone' WHEN CAST(ts + INTERVAL 8 HOUR AS DATE) <> CAST(ts AS DATE) THEN 'time_conflict' ELSE 'ok' END AS state FROM (SELECT *, list_value('UTC','Asia/Shanghai','Europe/London','America/New_York','Not/AZone')[(event_id % 5)::INT + 1] AS zone FROM events)")
def dt01(spark: SparkSession, sf: str) -> DataFrame:
    """Public wall clock of rows with a valid zone. Unknown zones are found by a lookup, as Spark raises on them."""
    e = table(spark, sf, "events").withColumn("zone", F.element_at(F.array(*[F.lit(z) for z in ZONES]), (F.col("event_id") % 5 + 1).cast("int")))
    known = spark.createDataFrame([(z,) for z in ZONES[:4]], "zone string").withColumn("valid", F.lit(True))
    e = e.join(F.broadcast(known), "zone", "left")  # the zone catalogue: a few hundred names at most
    public = F.when(F.col("valid"), in_zone(F.col("ts"), "Asia/Shanghai"))
    return e.select("event_id", public.alias("public_ts"), F.when(F.col("valid").isNull(), "invalid_zone").when(F.to_date(public) != F.to_date("ts"), "time_conflict").otherwise("ok").alias("state"))


@query("dt02_local_day_and_clock", "SELECT event_id, CAST(ts + INTERVAL 9 HOUR AS DATE) AS day, strftime(ts + INTERVAL 9 HOUR, '%H:%M:%S') AS clock FROM events")
def dt02(spark: SparkSession, sf: str) -> DataFrame:
    local = in_zone(F.col("ts"), "Asia/Tokyo")
    return table(spark, sf, "events").select("event_id", F.to_date(local).alias("day"), F.date_format(local, "HH:mm:ss").alias("clock"))


@query("dt03_year_decade", "SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, (year(o_orderdate) // 10 * 10)::INTEGER AS decade FROM orders")
def dt03(spark: SparkSession, sf: str) -> DataFrame:
    y = F.year("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", y.alias("y"), (F.floor(y / 10) * 10).cast("int").alias("decade"))


@query("dt04_tumbling", "SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS start, count(*) AS n FROM events GROUP BY 1")
def dt04(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.window("ts", "15 minutes").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


@query("dt05_due_windows", "WITH l AS (SELECT user_id, greatest(time_bucket(INTERVAL 30 MINUTE, max(ts)) + INTERVAL 30 MINUTE, TIMESTAMP '2024-01-30 06:00:00') AS lo FROM events WHERE ts < TIMESTAMP '2024-01-30 12:00:00' GROUP BY 1) SELECT user_id, unnest(generate_series(lo, TIMESTAMP '2024-01-30 11:30:00', INTERVAL 30 MINUTE)) AS start FROM l")
def dt05(spark: SparkSession, sf: str) -> DataFrame:
    """Window starts since the last one, with a bounded look-back of six hours."""
    last = table(spark, sf, "events").filter(F.col("ts") < at(NOW)).groupBy("user_id").agg(F.max("ts").alias("ts"))
    floor = F.timestamp_seconds(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 1800) * 1800 + 1800).cast("timestamp_ntz")
    low = F.greatest(floor, at("2024-01-30 06:00:00"))
    due = last.withColumn("low", low).filter(F.col("low") <= at("2024-01-30 11:30:00"))
    return due.select("user_id", F.explode(F.sequence("low", at("2024-01-30 11:30:00"), F.expr("INTERVAL 30 MINUTES"))).alias("start"))


@query("dt06_boost_interval", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 12 HOUR - INTERVAL 3 HOUR ELSE o_orderdate END AS lo, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 13 HOUR ELSE o_orderdate + INTERVAL 1 DAY END AS hi FROM orders")
def dt06(spark: SparkSession, sf: str) -> DataFrame:
    """Three hours before to one hour after a known start (noon here), else the whole day."""
    timed = F.col("o_orderkey") % 2 == 0
    return table(spark, sf, "orders").select("o_orderkey", F.when(timed, F.expr("o_orderdate + INTERVAL 9 HOURS")).otherwise(F.col("o_orderdate")).alias("lo"), F.when(timed, F.expr("o_orderdate + INTERVAL 13 HOURS")).otherwise(F.expr("o_orderdate + INTERVAL 1 DAY")).alias("hi"))


@query("dt07_timeliness", "WITH e AS (SELECT event_id, event_type, ts, CASE WHEN event_id % 4 > 0 THEN ts + to_minutes((event_id % 2000)::INT) END AS pub, CASE WHEN event_type = 'error' THEN ts + INTERVAL 1 HOUR ELSE date_trunc('day', ts + INTERVAL 8 HOUR) + INTERVAL 16 HOUR END AS due FROM events) SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'unknown' WHEN pub IS NOT NULL THEN CASE WHEN (event_type = 'error' AND pub <= due) OR (event_type <> 'error' AND pub < due) THEN 'on_time' ELSE 'late' END WHEN due <= TIMESTAMP '2024-01-30 12:00:00' THEN 'unpublished_overdue' ELSE 'awaiting' END AS state FROM e")
def dt07(spark: SparkSession, sf: str) -> DataFrame:
    """Urgent rows have an hour (inclusive), others until the next Shanghai midnight (exclusive)."""
    e = table(spark, sf, "events").withColumn("pub", F.when(F.col("event_id") % 4 > 0, F.expr("timestampadd(MINUTE, CAST(event_id % 2000 AS INT), ts)"))).withColumn("urgent", F.col("event_type") == "error")
    midnight = from_zone(F.date_add(F.to_date(in_zone(F.col("ts"), "Asia/Shanghai")), 1).cast("timestamp_ntz"), "Asia/Shanghai")
    e = e.withColumn("due", F.when(F.col("urgent"), F.expr("ts + INTERVAL 1 HOUR")).otherwise(midnight))
    met = F.when(F.col("urgent"), F.col("pub") <= F.col("due")).otherwise(F.col("pub") < F.col("due"))
    state = F.when(F.col("event_id") % 10 == 0, "unknown").when(F.col("pub").isNotNull(), F.when(met, "on_time").otherwise("late")).when(F.col("due") <= at(NOW), "unpublished_overdue").otherwise("awaiting")
    return e.select("event_id", state.alias("state"))


@query("dt08_next_local_midnight", "SELECT o_orderkey, o_orderdate + INTERVAL 15 HOUR AS instant FROM orders")
def dt08(spark: SparkSession, sf: str) -> DataFrame:
    """UTC instant at which the local day ends in Tokyo."""
    return table(spark, sf, "orders").select("o_orderkey", from_zone(F.date_add(F.to_date("o_orderdate"), 1).cast("timestamp_ntz"), "Asia/Tokyo").alias("instant"))


@query("dt09_age_buckets", "SELECT CASE WHEN ts > TIMESTAMP '2024-01-30 12:00:00' THEN 'missing' WHEN ts > TIMESTAMP '2024-01-29 12:00:00' THEN '0-24h' WHEN ts > TIMESTAMP '2024-01-27 12:00:00' THEN '24-72h' ELSE '>72h' END AS age, count(*) AS n FROM events GROUP BY 1")
def dt09(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("ts")
    age = F.when(ts > at(NOW), "missing").when(ts > at("2024-01-29 12:00:00"), "0-24h").when(ts > at("2024-01-27 12:00:00"), "24-72h").otherwise(">72h")
    return table(spark, sf, "events").groupBy(age.alias("age")).agg(F.count("*").alias("n"))


@query("dt10_expectation", "SELECT o_orderkey, CASE WHEN o_orderdate IS NULL THEN 'unknown' WHEN o_orderdate > TIMESTAMP '2001-01-01' THEN 'expected' WHEN o_orderdate + INTERVAL 7 DAY > TIMESTAMP '2001-01-01' THEN 'grace' ELSE 'due' END AS state FROM orders")
def dt10(spark: SparkSession, sf: str) -> DataFrame:
    d, today = F.col("o_orderdate"), at("2001-01-01")
    return table(spark, sf, "orders").select("o_orderkey", F.when(d.isNull(), "unknown").when(d > today, "expected").when(F.expr("o_orderdate + INTERVAL 7 DAYS") > today, "grace").otherwise("due").alias("state"))


@query("dt11_many_formats", "WITH s AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y年%m月%d日') WHEN 2 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE '2024-02-31' END AS raw, o_orderdate FROM orders) SELECT o_orderkey, CASE WHEN raw = '2024-02-31' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM s")
def dt11(spark: SparkSession, sf: str) -> DataFrame:
    """ISO, CJK and day-first dates; what no format fits, or isn't a day of the calendar, is null."""
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    raw = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "yyyy年MM月dd日")).when(k == 2, F.date_format(d, "dd/MM/yyyy")).otherwise("2024-02-31")
    return table(spark, sf, "orders").select("o_orderkey", parsed_date(raw).alias("day"))


def parsed_date(raw: Column) -> Column:
    return F.coalesce(*[F.try_to_date(raw, f) for f in ("yyyy-MM-dd", "yyyy年MM月dd日", "dd/MM/yyyy")])


@query("dt12_recency_score", "SELECT event_id, CASE WHEN date_diff('microsecond', ts, TIMESTAMP '2024-01-30 12:00:00') // 3600000000 <= 12 THEN 10 WHEN date_diff('microsecond', ts, TIMESTAMP '2024-01-30 12:00:00') // 3600000000 <= 48 THEN 6 ELSE 2 END AS score FROM events WHERE ts <= TIMESTAMP '2024-01-30 12:00:00'")
def dt12(spark: SparkSession, sf: str) -> DataFrame:
    """10, 6 or 2 by whole hours of age: up to 12, up to 48, older."""
    hours = F.expr(f"timestampdiff(HOUR, ts, TIMESTAMP_NTZ '{NOW}')")
    return table(spark, sf, "events").filter(F.col("ts") <= at(NOW)).select("event_id", F.when(hours <= 12, 10).when(hours <= 48, 6).otherwise(2).alias("score"))
