"""Ledgers kept by entity across micro-batches: observations, circuit breakers, budgets (STR-S5, S9, S14).

Each is a pure step (state, row) -> (state, verdict), folded over an entity's rows in order; every row gets one verdict.
A state is a few numbers an entity. Rows of a micro-batch are sorted; those of later batches follow.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.plans.catalog import query

from .replay import event_stream, run_to_end


def folded(rows: DataFrame, key: str, order: list[str], step: Callable, start: tuple, state: str) -> DataFrame:
    """(event_id, verdict) of every row of a stream; `state` is the schema of the tuple kept by key."""

    def run(_: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(kept.get) if kept.exists else start
        ids, verdicts = [], []
        for row in pd.concat(list(frames)).sort_values(order).itertuples(index=False):
            now, verdict = step(now, row)
            ids.append(row.event_id)
            verdicts.append(verdict)
        kept.update(now)
        yield pd.DataFrame({"event_id": pd.Series(ids, dtype="int64"), "verdict": pd.Series(verdicts, dtype=object)})

    return rows.groupBy(key).applyInPandasWithState(run, "event_id long, verdict string", state, "append", GroupStateTimeout.NoTimeout)


def observe(state: tuple, row) -> tuple[tuple, str]:
    """state: content hash and instant of the newest observation. An older one is stale, whatever it says."""
    digest, at = state
    if row.instant < at:
        return state, "stale"
    return (row.digest, row.instant), "unchanged" if row.digest == digest else "changed"


OBSERVED = "WITH e AS (SELECT event_id, user_id, lower(trim(event_type)) AS content, ts, ts < max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS TRUE AS stale FROM events), n AS (SELECT *, lag(content) OVER (PARTITION BY user_id, stale ORDER BY event_id) AS before FROM e) SELECT event_id, CASE WHEN stale THEN 'stale' WHEN content IS DISTINCT FROM before THEN 'changed' ELSE 'unchanged' END AS verdict FROM n"


@query("str_s5_observations", OBSERVED)
def s5_observations(spark: SparkSession, sf: str) -> DataFrame:
    """Observations in order of arrival: changed by a hash of their normal form, or refused as older than what is known."""
    digest = F.sha2(F.lower(F.trim("event_type")), 256)
    rows = event_stream(spark, sf).select("user_id", "event_id", digest.alias("digest"), F.unix_micros("at").alias("instant"))
    return run_to_end(folded(rows, "user_id", ["event_id"], observe, ("", -(1 << 62)), "digest string, instant long"))


# Parameters of the breaker: failures in a row that open it, and seconds until it lets one probe through.
FAILURES, COOL_DOWN = 2, 6 * 3600


def breaker(state: tuple, row) -> tuple[tuple, str]:
    """state: failures in a row and when the last was. Open, it denies; after its cool-down one probe decides."""
    failures, since = state
    if failures >= FAILURES and row.second < since + COOL_DOWN:
        return state, "denied"
    verdict = "probe" if failures >= FAILURES else "admitted"
    return ((failures + 1, row.second) if row.event_type == "error" else (0, row.second)), verdict


@query("str_s9_circuit_breaker")
def s9_breaker(spark: SparkSession, sf: str) -> DataFrame:
    rows = event_stream(spark, sf).select("user_id", "event_id", "event_type", F.unix_seconds("at").alias("second"))
    return run_to_end(folded(rows, "user_id", ["second", "event_id"], breaker, (0, 0), "failures int, since long"))


# Parameters of the budgets, in hundredths: of an article, of a day, of a month.
ARTICLE_CAP, DAY_CAP, MONTH_CAP = 40_000, 7_500, 60_000


def reserve(state: tuple, row) -> tuple[tuple, str]:
    """state: blocked, day, its sum, month, its sum, and sums of the account's articles (JSON).

    A bill of unknown amount (an error) stops the account until one is settled (a purchase). Refused amounts take nothing.
    """
    blocked, day, by_day, month, by_month, articles = state
    blocked = blocked and row.event_type != "purchase"
    by_day, by_month = by_day if row.day == day else 0, by_month if row.month == month else 0
    held = json.loads(articles)
    own = held.get(row.event_type, 0)
    if blocked:
        verdict = "unreconciled_bill"
    elif own + row.amount > ARTICLE_CAP:
        verdict = "article_budget_exhausted"
    elif by_month + row.amount > MONTH_CAP:
        verdict = "budget_exhausted_month"
    elif by_day + row.amount > DAY_CAP:
        verdict = "budget_exhausted_day"
    else:
        verdict, blocked = "reserved", row.event_type == "error"
        by_day, by_month, held[row.event_type] = by_day + row.amount, by_month + row.amount, own + row.amount
    return (blocked, row.day, by_day, row.month, by_month, json.dumps(held, sort_keys=True)), verdict


@query("str_s14_period_caps")
def s14_caps(spark: SparkSession, sf: str) -> DataFrame:
    """Reservations by account in order of time, under caps of article, month and day, and the stop by an open bill."""
    amount = F.round(F.coalesce(F.col("value"), F.lit(0.0)) * 100).cast("long")
    rows = event_stream(spark, sf).select("user_id", "event_id", "event_type", F.unix_micros("at").alias("instant"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "yyyy-MM").alias("month"), amount.alias("amount"))
    kept = "blocked boolean, day string, by_day long, month string, by_month long, articles string"
    return run_to_end(folded(rows, "user_id", ["instant", "event_id"], reserve, (False, "", 0, "", 0, "{}"), kept))
