"""Streaming operators (STR-S): Structured Streaming over the event table, and their batch twins.

Every streaming query reads files with an `availableNow` trigger into a table of the session's memory sink or
a parquet sink, so that a run ends when its input does; the same functions serve an endless source.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.windows import streaks
from millrace.plans.catalog import query, table


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a stream with an event-time column `at` (UTC)."""
    schema = table(spark, sf, "events").schema
    folder = f"{sf.rstrip('/')}/"
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "false")
    return source.parquet(folder).withColumn("at", F.col("ts").cast("timestamp"))


def checkpoint_dir(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="millrace-stream-")


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs the stream over all input that is there and returns what it wrote."""
    spark, root = stream.sparkSession, checkpoint_dir(stream.sparkSession)
    if mode == "append":
        sink = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        sink.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{root}/out")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/epoch={epoch}")

    sink = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    sink.awaitTermination()
    found = spark.read.parquet(f"{root}/out")
    return found.filter(F.col("epoch") == found.agg(F.max("epoch")).first()[0]).drop("epoch")


@query("str_s1_tumbling_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def s1(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly windows, kept complete in state."""
    e = event_stream(spark, sf).withWatermark("at", "2 days")
    w = e.groupBy(F.window("at", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return run_to_end(w.select(F.col("w.start").alias("s"), "n", "total"), "complete").select(F.col("s").cast("timestamp_ntz").alias("start"), "n", "total")


@query("str_s2_due_claims", "SELECT user_id, row_number() OVER (ORDER BY last, user_id) AS claim FROM (SELECT user_id, max(ts) AS last FROM events GROUP BY 1 HAVING max(ts) <= TIMESTAMP '2024-01-30 12:00:00') QUALIFY claim <= 20")
def s2(spark: SparkSession, sf: str) -> DataFrame:
    last = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("last")).filter(F.col("last") <= F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"))
    due = last.orderBy("last", "user_id").limit(20)
    return due.select("user_id", F.row_number().over(Window.orderBy("last", "user_id")).cast("long").alias("claim"))


@query("str_s3_idempotent_append", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, props FROM events) GROUP BY 1, 2")
def s3(spark: SparkSession, sf: str) -> DataFrame:
    """A stream that drops repeats of a dedupe key, then counted. Keys are forgotten 400 days after their event, so the state is bounded."""
    e = event_stream(spark, sf).select("at", "user_id", "event_type", "props").withWatermark("at", "400 days")
    e = e.dropDuplicatesWithinWatermark(["user_id", "event_type", "props"]).select("user_id", "event_type", "props")
    return run_to_end(e).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("str_s4_frozen_watermark", "SELECT event_type, count(*) AS n, max(event_id) AS top FROM events WHERE event_id <= 7500 GROUP BY 1")
def s4(spark: SparkSession, sf: str) -> DataFrame:
    """Rows up to a frozen sequence number: later appends don't change the page."""
    return table(spark, sf, "events").filter("event_id <= 7500").groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("top"))


@query("str_s5_change_detection", "SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE event_type IS DISTINCT FROM before")
def s5(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").withColumn("before", F.lag("event_type").over(w)).filter(~F.col("event_type").eqNullSafe(F.col("before"))).select("event_id")


def lifecycle_step(state: str, kind: str) -> str:
    """scheduled -> running on a signup, running -> finished on a purchase; finished stays."""
    if state == "scheduled" and kind == "signup":
        return "running"
    if state == "running" and kind == "purchase":
        return "finished"
    return state


def _transitions(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = state.get[0] if state.exists else "scheduled"
    rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
    out = []
    for event_id, kind in zip(rows["event_id"], rows["event_type"], strict=True):
        then = lifecycle_step(now, kind)
        if then != now:
            out.append((key[0], event_id, now, then))
            now = then
    state.update((now,))
    yield pd.DataFrame(out, columns=["user_id", "event_id", "before", "after"]).astype({"user_id": "int64", "event_id": "int64"})


LIFECYCLE = "WITH s AS (SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, min((ts, event_id)) AS at FROM events WHERE event_type = 'signup' GROUP BY 1), p AS (SELECT e.user_id, arg_min(e.event_id, (e.ts, e.event_id)) AS event_id FROM events e JOIN s ON s.user_id = e.user_id AND (e.ts, e.event_id) > s.at WHERE e.event_type = 'purchase' GROUP BY 1) SELECT user_id, event_id, 'scheduled' AS before, 'running' AS after FROM s UNION ALL SELECT user_id, event_id, 'running', 'finished' FROM p"


@query("str_s6_state_machine", LIFECYCLE)
def s6(spark: SparkSession, sf: str) -> DataFrame:
    """Transitions of a state machine kept by entity across micro-batches."""
    e = event_stream(spark, sf).select("user_id", "event_id", "event_type", "at")
    t = e.groupBy("user_id").applyInPandasWithState(_transitions, "user_id long, event_id long, before string, after string", "state string", "append", GroupStateTimeout.NoTimeout)
    return run_to_end(t)


@query("str_s7_overdue_incidents", "SELECT e.event_id FROM events e WHERE e.event_type = 'signup' AND e.ts + INTERVAL 30 MINUTE <= TIMESTAMP '2024-01-30 12:00:00' AND NOT EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts BETWEEN e.ts AND e.ts + INTERVAL 30 MINUTE)")
def s7(spark: SparkSession, sf: str) -> DataFrame:
    """Starts without a result within 30 minutes. The next result is looked ahead in one sort by entity."""
    e = table(spark, sf, "events").filter("event_type in ('signup', 'purchase')")
    ahead = Window.partitionBy("user_id").orderBy("ts", F.col("event_type") == "purchase").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    e = e.withColumn("result", F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(ahead))
    open_ = F.col("result").isNull() | (F.col("result") > F.expr("ts + INTERVAL 30 MINUTES"))
    return e.filter((F.col("event_type") == "signup") & (F.expr("ts + INTERVAL 30 MINUTES") <= F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")) & open_).select("event_id")


@query("str_s8_late_revisions", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS revision, ts < max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS late FROM events WHERE event_type = 'purchase'")
def s8(spark: SparkSession, sf: str) -> DataFrame:
    """Every result is a new revision; one that is older than what is known already is marked late, not dropped."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    late = F.col("ts") < F.max("ts").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return table(spark, sf, "events").filter("event_type = 'purchase'").select("event_id", F.row_number().over(w).cast("long").alias("revision"), late.alias("late"))


@query("str_s9_hourly_quota", "SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) <= 1 AS admitted FROM events")
def s9(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id", F.date_trunc("hour", "ts")).orderBy("ts", "event_id")
    return table(spark, sf, "events").select("event_id", (F.row_number().over(w) <= 1).alias("admitted"))


@query("str_s10_expired_leases", "SELECT user_id, max(ts) + INTERVAL 10 MINUTE <= TIMESTAMP '2024-01-30 12:00:00' AS reclaim FROM events GROUP BY 1")
def s10(spark: SparkSession, sf: str) -> DataFrame:
    last = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("ts"))
    return last.select("user_id", (F.expr("ts + INTERVAL 10 MINUTES") <= F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")).alias("reclaim"))


@query("str_s11_sliding_windows", "SELECT start, event_type, count(*) AS n FROM (SELECT event_type, ts, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS start FROM events) GROUP BY 1, 2")
def s11(spark: SparkSession, sf: str) -> DataFrame:
    e = event_stream(spark, sf).withWatermark("at", "2 days")
    w = e.groupBy(F.window("at", "24 hours", "12 hours").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return run_to_end(w.select(F.col("w.start").alias("s"), "event_type", "n"), "complete").select(F.col("s").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("str_s11_session_windows", "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 4 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def s11b(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "events").groupBy("user_id", F.session_window("ts", "4 hours").alias("w")).agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("w.start").alias("start"), "n")


@query("str_s12_append_only", "SELECT event_type, count(*) AS n, count(DISTINCT event_id) = count(*) AS unique_ids FROM events GROUP BY 1")
def s12(spark: SparkSession, sf: str) -> DataFrame:
    """A ledger that is only appended to: written by a stream in append mode and read back."""
    kept = run_to_end(event_stream(spark, sf).select("event_id", "event_type"))
    return kept.groupBy("event_type").agg(F.count("*").alias("n"), (F.count_distinct("event_id") == F.count("*")).alias("unique_ids"))


@query("str_s13_latest_generation", "SELECT conv_id, arg_max(role, turn) AS stage, max(turn) AS generation, count(*) AS attempts FROM conversations GROUP BY 1")
def s13(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.max_by("role", "turn").alias("stage"), F.max("turn").alias("generation"), F.count("*").alias("attempts"))


@query("str_s14_budget_reservation", "SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) <= 1200 AS admitted FROM conversations")
def s14(spark: SparkSession, sf: str) -> DataFrame:
    spent = F.sum(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf, "conversations").select("conv_id", "turn", (spent <= 1200).alias("admitted"))


@query("str_s15_retry_schedule", "WITH i AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events), s AS (SELECT event_id, ts, event_type, CAST(sum((event_type = 'error')::INT) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS BIGINT) AS k FROM i) SELECT event_id, ts + to_seconds(CASE k WHEN 1 THEN 60 WHEN 2 THEN 300 ELSE 1800 END) AS retry_at FROM s WHERE event_type = 'error'")
def s15(spark: SparkSession, sf: str) -> DataFrame:
    """The next try after 1, 5 or 30 minutes, by consecutive failures."""
    s = streaks(table(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error").filter("event_type = 'error'")
    return s.withColumn("wait", F.when(F.col("streak") == 1, 60).when(F.col("streak") == 2, 300).otherwise(1800)).select("event_id", F.expr("timestampadd(SECOND, wait, ts)").alias("retry_at"))


def deterministic_provider(step: Callable[[str], str]):
    """A pluggable provider: any function of a text, applied in Arrow batches."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else step(v))

    return lambda c: F.pandas_udf(run, "string")(c)


@query("udf04_provider", "SELECT item_id, '[xx] ' || text AS translated FROM benchmark")
def udf04(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", deterministic_provider(lambda v: f"[xx] {v}")("text").alias("translated"))
