"""Leases and incidents over several micro-batches with rows out of order, against plain loops in order of time."""

import random
from datetime import datetime, timedelta, timezone

from millrace.streaming import leases

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
ROWS = "user_id long, at timestamp, event_id long, kind string, token long"


def stream(spark, folder, batches):
    """One file a micro-batch."""
    for rows in batches:
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(folder)


def shuffled(rng, rows, n):
    """Batches in which rows arrive up to some hours late."""
    late = sorted(rows, key=lambda r: r[1] + timedelta(minutes=rng.randrange(200)))
    size = -(-len(late) // n)
    return [late[i : i + size] for i in range(0, len(late), size)]


def micros(at):
    return (at - START) // timedelta(microseconds=1) + int(START.timestamp()) * 1_000_000


def plain_leases(rows, end):
    out = []
    for user in {r[0] for r in rows}:
        token, until = 0, None
        for _, at, event_id, kind, shown in sorted((r for r in rows if r[0] == user), key=lambda r: (r[1], r[2])):
            if until and until <= at:
                out.append((user, -1, "expired", token))
                until = None
            if kind == "claim" and until is None:
                token, until = token + 1, at + timedelta(seconds=leases.LEASE_S)
                out.append((user, event_id, "granted", token))
            elif kind == "claim":
                out.append((user, event_id, "held", token))
            elif until and shown == token:
                until = None
                out.append((user, event_id, "committed", token))
            else:
                out.append((user, event_id, "stale", shown))
        if until and until <= end:
            out.append((user, -1, "expired", token))
    return sorted(out)


def test_leases_across_batches(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(5), START + timedelta(minutes=rng.randrange(9_000), milliseconds=i), i, rng.choice(["claim", "claim", "commit"]), rng.randrange(1, 12)) for i in range(300)]
    # an expired lease is claimed again, and the first holder's token is refused afterwards
    rows += [(9, START + timedelta(hours=h), 900 + h, kind, token) for h, kind, token in ((1, "claim", 0), (2, "claim", 0), (8, "claim", 0), (9, "commit", 1), (10, "commit", 2), (11, "commit", 2))]
    closing = START + timedelta(days=30)  # takes the watermark past all others
    batches = [*shuffled(rng, rows, 5), [(99, closing, 9_999, "claim", 0)]]
    found = leases.run_with_state(leases.kept_by_entity(stream(spark, f"{tmp_path}/in", batches), leases.Leases(), "12 hours"))
    got = sorted((r["user_id"], r["event_id"], r["verdict"], r["token"]) for r in found.collect())
    assert got == plain_leases(rows, closing - timedelta(hours=12))
    mine = [(e, v) for u, e, v, _ in got if u == 9]
    assert mine == [(-1, "expired"), (901, "granted"), (902, "held"), (908, "granted"), (909, "stale"), (910, "committed"), (911, "stale")]


def test_incidents_across_batches(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randrange(6), START + timedelta(minutes=rng.randrange(4_000), milliseconds=i), i, rng.choice(["start", "result"]), 0) for i in range(250)]
    closing = START + timedelta(days=30)
    batches = [*shuffled(rng, rows, 4), [(99, closing, 9_999, "result", 0)]]
    found = leases.run_with_state(leases.kept_by_entity(stream(spark, f"{tmp_path}/in", batches), leases.Incidents(), "12 hours"))
    want = []
    for user, at, event_id, kind, _ in rows:
        if kind == "start":
            result = min((r[1] for r in rows if r[0] == user and r[3] == "result" and (r[1], r[2]) > (at, event_id)), default=None)
            due = at + timedelta(seconds=leases.RESULT_S)
            if result is None or result > due:
                want.append((user, event_id, "opened", micros(due)))
                want += [(user, event_id, "resolved", micros(result))] if result else []
    assert sorted((r["user_id"], r["event_id"], r["verdict"], r["instant"]) for r in found.collect()) == sorted(want) and len(want) > 50

