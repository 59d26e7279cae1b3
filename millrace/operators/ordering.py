"""Ranks, neighbours and order statistics of large groups, in two levels.

Rows are dealt to partitions by ranges of (keys, order) and sorted there, and that table is kept by a reliable checkpoint, so
that a row's place is given once. A row's place in its group is its place in its partition plus the rows of that
group in the partitions before: a few numbers for each partition and group. So no task holds more than a range of
a group, however large it is. The order should be total, as equal rows can't be parted.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stored(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder of spark.checkpoint.dir; only a local session without that gets a temporary one."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or "file://" + tempfile.mkdtemp(prefix="millrace-order-"))
    return df.checkpoint()


def in_ranges(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """df sorted by ranges, with __part and __place, a row's number in its partition."""
    by = [*[F.col(k) for k in keys], *order]
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by)
    at = F.monotonically_increasing_id()
    return stored(dealt.withColumn("__at", at)).withColumn("__part", F.shiftright("__at", 33)).withColumn("__place", F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at")


def _beside(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with few, one row for each partition and group; null keys are groups like others."""
    few = few.select(F.col("__part").alias("__p"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[c for c in few.columns if c != "__part" and c not in keys])
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return rows.join(few, same).drop("__p", *[f"__k{i}" for i in range(len(keys))])


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """df with each row's number from 1 within its group, in the given order; no keys: of all rows."""
    rows = in_ranges(df, keys, order)
    few = rows.groupBy("__part", *keys).agg(F.min("__place").alias("__first"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    few = few.withColumn("__before", before).drop("__n")
    return _beside(rows, few, keys).withColumn(name, F.col("__before") + F.col("__place") - F.col("__first") + 1).drop("__part", "__place", "__first", "__before")


def neighbours(df: DataFrame, keys: list[str], order: list[Column], column: str, before: str, after: str) -> DataFrame:
    """df with `column` of the row before and the row after within the group."""
    rows = in_ranges(df, keys, order)
    inside = Window.partitionBy("__part", *keys).orderBy("__place")
    rows = rows.withColumn("__v", F.struct(F.col(column).alias("v"))).withColumn("__l", F.lag("__v").over(inside)).withColumn("__r", F.lead("__v").over(inside))
    few = rows.groupBy("__part", *keys).agg(F.min_by("__v", "__place").alias("__head"), F.max_by("__v", "__place").alias("__tail"))
    along = Window.partitionBy(*keys).orderBy("__part")
    few = few.select("__part", *keys, F.lag("__tail").over(along).alias("__pl"), F.lead("__head").over(along).alias("__nr"))
    found = _beside(rows, few, keys)
    return found.withColumn(before, F.coalesce("__l", "__pl")["v"]).withColumn(after, F.coalesce("__r", "__nr")["v"]).drop("__part", "__place", "__v", "__l", "__r", "__pl", "__nr")


def quantiles(df: DataFrame, keys: list[str], value: str, unique: str, shares: dict[str, float]) -> DataFrame:
    """keys and one column a share: the continuous quantile of the non-null values of each group, from the two rows around it."""
    rows = ranked(df.filter(F.col(value).isNotNull()).select(*keys, value, unique), keys, [F.col(value), F.col(unique)], "__rank")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("__n")).select("__n", *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    rows = rows.join(sizes, same)
    out = []
    for name, share in shares.items():
        at = 1 + (F.col("__n") - 1) * F.lit(float(share))
        weight = F.greatest(1 - F.abs(F.col("__rank") - at), F.lit(0.0))
        out.append(F.sum(F.when(weight > 0, weight * F.col(value))).alias(name))
    return rows.groupBy(*keys).agg(*out)
