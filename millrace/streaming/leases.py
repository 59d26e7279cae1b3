"""Leases with fencing tokens and incidents with timers (STR-S2, S7, S10): state kept by entity in event time.

Rows of an entity wait in its state until the watermark has passed them, then they are taken in the order of their
instants, whatever micro-batch brought them. Timers do what no row triggers: a lease that isn't given back lapses, an expected
result that doesn't come opens an incident. What has ended leaves the state: a lease its holder's deadline, a result all
incidents that it answers; an entity without rows, leases or incidents keeps one number (its last token) or nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from millrace.plans.catalog import query, table

from .replay import checkpoint_dir, run_to_end

#: Seconds that a claim holds, and seconds from a start until its result is overdue.
LEASE_S, RESULT_S = 6 * 3600, 30 * 60
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Hands each entity's rows (instant, event_id, kind, token) to `step` in order, once the watermark has passed them."""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "instant long, event_id long, kind string, token long")
        self.begin(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(r) for frame in rows for r in frame[["instant", "event_id", "kind", "token"]].itertuples(index=False)]
        if new:
            self.waiting.appendList([(int(a), int(b), str(c), int(d)) for a, b, c, d in new])
            self.handle.registerTimer(max(int(r[0]) for r in new) // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs()  # all rows up to here have come; timers set below fire in a later batch
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted(r for r in rows if r[0] // 1000 <= until)
        left = [r for r in rows if r[0] // 1000 > until]
        if left:
            self.waiting.put(left)
        elif rows:
            self.waiting.clear()
        found = self.step(ready, until)
        if found:
            yield pd.DataFrame([(key[0], *f) for f in found], columns=["user_id", *self.COLUMNS]).astype({"user_id": "int64"})

    def close(self) -> None:
        pass


class Leases(InOrder):
    """A claim gets the next token unless a live lease holds the entity; work is accepted under the live lease's token only.

    kind `claim`: granted or held. kind `commit` with a token: committed, which ends the lease, or refused as stale. A
    lease that isn't ended by its deadline is expired at it.
    """

    COLUMNS = ["event_id", "verdict", "token", "instant"]
    OUTPUT = "user_id long, event_id long, verdict string, token long, instant long"

    def begin(self, handle) -> None:
        self.lease = handle.getValueState("lease", "token long, until long")

    def step(self, rows: list[tuple], until: int) -> list[tuple]:
        token, end = tuple(self.lease.get()) if self.lease.exists() else (0, 0)  # an end of 0: nobody holds it
        before, out = end, []
        for instant, event_id, kind, shown in rows:
            if end and end <= instant:
                out.append((-1, "expired", token, end))
                end = 0
            if kind == "claim":
                if end:
                    out.append((event_id, "held", token, instant))
                else:
                    token, end = token + 1, instant + LEASE_S * 1_000_000
                    out.append((event_id, "granted", token, instant))
            elif end and shown == token:
                out.append((event_id, "committed", token, instant))
                end = 0
            else:
                out.append((event_id, "stale", shown, instant))
        if end and -(-end // 1000) <= until:
            out.append((-1, "expired", token, end))
            end = 0
        if end and end != before:
            self.handle.registerTimer(-(-end // 1000))
        if rows or end != before:
            self.lease.update((token, end))
        return out


class Incidents(InOrder):
    """A `start` without a `result` within RESULT_S opens an incident at that moment; the next result resolves it."""

    COLUMNS = ["event_id", "verdict", "instant"]
    OUTPUT = "user_id long, event_id long, verdict string, instant long"

    def begin(self, handle) -> None:
        self.awaited = handle.getListState("awaited", "due long, event_id long, opened boolean")

    def step(self, rows: list[tuple], until: int) -> list[tuple]:
        awaited = [tuple(r) for r in self.awaited.get()] if self.awaited.exists() else []
        before, out = list(awaited), []

        def overdue(now: int) -> None:
            for i, (due, event_id, opened) in enumerate(awaited):
                if not opened and due < now:
                    out.append((event_id, "opened", due))
                    awaited[i] = (due, event_id, True)

        for instant, event_id, kind, _ in rows:
            overdue(instant)
            if kind == "start":
                due = instant + RESULT_S * 1_000_000
                awaited.append((due, event_id, False))
                self.handle.registerTimer(due // 1000 + 1)
            else:
                out += [(e, "resolved", instant) for _, e, opened in awaited if opened]
                awaited.clear()
        overdue(until * 1000)
        if awaited != before:
            self.awaited.put(awaited) if awaited else self.awaited.clear()
        return out


def kept_by_entity(rows: DataFrame, processor: InOrder, late: str = "0 seconds") -> DataFrame:
    """Rows (user_id, at, event_id, kind, token) of a stream through a processor; rows later than `late` behind the newest are dropped."""
    rows = rows.withWatermark("at", late).select("user_id", "at", F.unix_micros("at").alias("instant"), "event_id", "kind", "token")
    return rows.groupBy("user_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=processor.OUTPUT, outputMode="Append", timeMode="eventTime")


def run_with_state(stream: DataFrame) -> DataFrame:
    """run_to_end with the state store that timers need."""
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return run_to_end(stream)
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def by_days(spark: SparkSession, sf: str, days: int) -> DataFrame:
    """The events table as a stream of files of some days each, one file a micro-batch, in order of time."""
    events = table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    folder = f"{checkpoint_dir(spark)}/days"
    first = F.lit("2024-01-01").cast("timestamp")
    period = F.floor((F.unix_timestamp("at") - F.unix_timestamp(first)) / (days * 86400))
    events = events.withColumn("period", period)
    for p in sorted(r[0] for r in events.select("period").distinct().collect()):  # a few periods
        events.filter(F.col("period") == p).drop("period").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(events.drop("period").schema).option("maxFilesPerTrigger", 1).parquet(folder)


CLAIMS = "CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'claim' ELSE 'commit' END"
LEASES = f"""
WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, {CLAIMS} AS kind, 1 + CAST(json_extract_string(props, '$.k') AS BIGINT) % 20 AS shown FROM events),
s AS (SELECT user_id, 0::BIGINT AS k, NULL::TIMESTAMP AS ts, NULL::BIGINT AS event_id, NULL::VARCHAR AS verdict, NULL::BIGINT AS shown, 0::BIGINT AS token, NULL::TIMESTAMP AS until, NULL::TIMESTAMP AS lapsed, 0::BIGINT AS old FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT user_id, k, ts, event_id, verdict, shown, CASE WHEN verdict = 'granted' THEN token + 1 ELSE token END, CASE verdict WHEN 'granted' THEN ts + INTERVAL 6 HOUR WHEN 'committed' THEN NULL ELSE live END, lapsed, token
  FROM (SELECT *, CASE WHEN kind = 'claim' THEN CASE WHEN live IS NULL THEN 'granted' ELSE 'held' END WHEN live IS NOT NULL AND shown = token THEN 'committed' ELSE 'stale' END AS verdict
        FROM (SELECT e.user_id, e.k, e.ts, e.event_id, e.kind, e.shown, s.token, CASE WHEN s.until > e.ts THEN s.until END AS live, CASE WHEN s.until <= e.ts THEN s.until END AS lapsed FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1))),
last AS (SELECT user_id, arg_max(token, k) AS token, max(until) FILTER (k = n) AS until FROM (SELECT *, max(k) OVER (PARTITION BY user_id) AS n FROM s) GROUP BY user_id)
SELECT user_id, event_id, verdict, CASE verdict WHEN 'stale' THEN shown ELSE token END AS token FROM s WHERE k > 0
UNION ALL SELECT user_id, -1, 'expired', old FROM s WHERE lapsed IS NOT NULL
UNION ALL SELECT user_id, -1, 'expired', token FROM last WHERE until <= (SELECT date_trunc('milliseconds', max(ts)) FROM events)
"""


@query("str_s2_leases", LEASES)
def s2_leases(spark: SparkSession, sf: str) -> DataFrame:
    """Claims of entities under leases that lapse, and work refused under a token that has been passed on (S2, S10)."""
    rows = by_days(spark, sf, 5).select("user_id", "at", "event_id", F.expr(CLAIMS).alias("kind"), (1 + F.get_json_object("props", "$.k").cast("long") % 20).alias("token"))
    return run_with_state(kept_by_entity(rows, Leases())).select("user_id", "event_id", "verdict", "token")


INCIDENTS = """
WITH r AS (SELECT e.event_id, e.user_id, e.ts + INTERVAL 30 MINUTE AS due, (SELECT min(p.ts) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND (p.ts, p.event_id) > (e.ts, e.event_id)) AS result FROM events e WHERE event_type = 'signup'),
o AS (SELECT * FROM r WHERE (result IS NULL OR result > due) AND due < (SELECT date_trunc('milliseconds', max(ts)) FROM events WHERE event_type IN ('signup', 'purchase')))
SELECT user_id, event_id, 'opened' AS verdict, due AS at FROM o UNION ALL SELECT user_id, event_id, 'resolved', result FROM o WHERE result IS NOT NULL
"""


@query("str_s7_incidents", INCIDENTS)
def s7_incidents(spark: SparkSession, sf: str) -> DataFrame:
    """Overdue results open incidents by event-time timers; late results resolve them, micro-batches later."""
    rows = by_days(spark, sf, 5).filter("event_type in ('signup', 'purchase')")
    rows = rows.select("user_id", "at", "event_id", F.when(F.col("event_type") == "signup", "start").otherwise("result").alias("kind"), F.lit(0).cast("long").alias("token"))
    found = run_with_state(kept_by_entity(rows, Incidents()))
    return found.select("user_id", "event_id", "verdict", F.timestamp_micros("instant").cast("timestamp_ntz").alias("at"))
