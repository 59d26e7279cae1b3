"""Two-level ranks, neighbours and quantiles against the plain windows, with large groups, null keys and few rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import ordering

ROWS = "g string, x double, id long"


def rows(n, seed):
    rng = random.Random(seed)
    return [(rng.choice(["big"] * 8 + ["a", "b", None]), rng.choice([None, float(rng.randrange(9)), rng.random()]), i) for i in range(n)]


def groups(data, order):
    out = {}
    for r in sorted(data, key=order):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("n", [0, 1, 3, 700])
def test_ranks_and_neighbours(spark, n):
    data = rows(n, n)
    df = spark.createDataFrame(data, ROWS).repartition(3)
    order = [F.col("x").desc_nulls_last(), F.col("id")]
    want = groups(data, lambda r: (r[1] is None, -(r[1] or 0), r[2]))
    got = {r["id"]: r["rank"] for r in ordering.ranked(df, ["g"], order).collect()}
    assert got == {r[2]: k for g in want.values() for k, r in enumerate(g, 1)}
    got = {r["id"]: r["place"] for r in ordering.ranked(df, [], order, "place").collect()}
    assert got == {r[2]: k for k, r in enumerate(sorted(data, key=lambda r: (r[1] is None, -(r[1] or 0), r[2])), 1)}
    near = {r["id"]: (r["before"], r["after"]) for r in ordering.neighbours(df, ["g"], order, "x", "before", "after").collect()}
    assert near == {r[2]: (g[k - 1][1] if k else None, g[k + 1][1] if k + 1 < len(g) else None) for g in want.values() for k, r in enumerate(g)}


def test_quantiles(spark):
    data = rows(500, 9)
    found = ordering.quantiles(spark.createDataFrame(data, ROWS), ["g"], "x", "id", {"p0": 0.0, "p50": 0.5, "p99": 0.99, "p100": 1.0}).collect()
    for r in found:
        own = [x for g, x, _ in data if g == r["g"] and x is not None]
        assert [r["p0"], r["p50"], r["p99"], r["p100"]] == pytest.approx(list(np.quantile(own, [0, 0.5, 0.99, 1])))
    assert len(found) == 4


def test_no_window_without_ranges(spark):
    df = spark.createDataFrame(rows(50, 1), ROWS)
    plan = ordering.ranked(df, [], [F.col("id")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window ") == 1 and "__n" in plan.split("Window ")[1].split("\n")[0]  # over the counts of partitions, not over rows
