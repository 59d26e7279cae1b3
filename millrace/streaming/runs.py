"""Frozen catalogs and fenced runs (STR-S4, S13): a table as an append log of snapshots.

A commit of generation g adds the rows of one run to what generation g - 1 holds. Spark writes the rows to a folder of the
run's own; a manifest that names the folder is then renamed into place as number g, which fails if that number is
taken. So of several attempts that started from one generation one commits, and the others are refused and leave nothing that
a reader sees. A reader takes a generation and reads the folders named up to it: later commits don't change its pages.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.catalog import query, table

from .replay import checkpoint_dir


class StaleGeneration(Exception):
    """Another attempt has committed since this one started."""


class Log:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("log").getFileSystem(self._conf)

    def _manifest(self, generation: int):
        return self._path(f"log/{generation:012d}.json")

    def generation(self) -> int:
        """The newest generation, 0 before any commit."""
        if not self._fs().exists(self._path("log")):
            return 0
        return max((int(s.getPath().getName()[:-5]) for s in self._fs().listStatus(self._path("log")) if s.getPath().getName().endswith(".json")), default=0)

    def commit(self, rows: DataFrame, base: int, run: str) -> int:
        """Appends rows as generation base + 1; refused if another attempt took that number, or as soon as that is known."""
        if self.generation() != base:
            raise StaleGeneration(f"{run} started from generation {base}, but {self.generation()} is committed")
        folder = f"data/{base + 1:012d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{folder}")
        fs, own = self._fs(), self._path(f"tmp/{uuid.uuid4().hex}")
        out = fs.create(own, False)
        out.write(bytearray(json.dumps({"generation": base + 1, "run": run, "folder": folder}).encode()))
        out.close()
        fs.mkdirs(self._path("log"))
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(options, 1)
        how[0] = options.NONE
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(own.toUri(), self._conf).rename(own, self._manifest(base + 1), how)
        except Exception as e:
            fs.delete(own, False)
            fs.delete(self._path(folder), True)
            if "FileAlreadyExists" in str(e):
                raise StaleGeneration(f"{run} started from generation {base}, but {base + 1} is committed") from None
            raise
        return base + 1

    def manifests(self, generation: int) -> list[dict]:
        found = []
        for g in range(1, generation + 1):
            stream = self._fs().open(self._manifest(g))
            found.append(json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()))
            stream.close()
        return found

    def snapshot(self, generation: int, schema) -> DataFrame:
        """All rows committed up to a generation."""
        if not 0 <= generation <= self.generation():
            raise ValueError(f"no generation {generation}")
        folders = [f"{self.root}/{m['folder']}" for m in self.manifests(generation)]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)


def page(rows: DataFrame, order: list[str], after: tuple | None, size: int) -> DataFrame:
    """The next `size` rows after a key, ascending by a total order: each task keeps its own first ones."""
    if after is not None:
        rows = rows.filter(later_than(order, after))
    return rows.orderBy(*order).limit(size)


def later_than(order: list[str], after: tuple) -> Column:
    out = F.lit(False)
    for name, value in reversed(list(zip(order, after, strict=True))):
        out = (F.col(name) > F.lit(value)) | ((F.col(name) == F.lit(value)) & out)
    return out


def weekly_runs(spark: SparkSession, sf: str) -> tuple[Log, DataFrame]:
    """Events committed week by week, each run tried twice from one generation; the second attempt is refused."""
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    log = Log(spark, f"{checkpoint_dir(spark)}/catalog")
    week = F.floor((F.dayofmonth("ts") - 1) / 7)
    for w in range(5):
        base = log.generation()
        log.commit(events.filter(week == w), base, f"week {w}")
        try:
            log.commit(events, base, f"week {w}, late attempt")
        except StaleGeneration:
            continue
        raise AssertionError("a stale attempt has committed")
    return log, events


@query("str_s13_fenced_runs", "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS n_ids, 5 AS generation FROM events WHERE day(ts) <= 35 GROUP BY 1")
def s13_fenced(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of runs that committed under their generation; those of stale attempts are nowhere."""
    log, events = weekly_runs(spark, sf)
    return log.snapshot(log.generation(), events.schema).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_ids")).withColumn("generation", F.lit(log.generation()))


@query("str_s4_frozen_pages", "WITH f AS (SELECT user_id, event_id, row_number() OVER (ORDER BY user_id, event_id) AS k FROM events WHERE day(ts) <= 14) SELECT user_id, event_id FROM f WHERE k <= 200")
def s4_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Two pages of the catalog as it was after two runs; the runs that follow between the pages don't change the second."""
    log, events = weekly_runs(spark, sf)
    first = page(log.snapshot(2, events.schema).select("user_id", "event_id"), ["user_id", "event_id"], None, 100)
    last = first.orderBy(F.desc("user_id"), F.desc("event_id")).first()
    second = page(log.snapshot(2, events.schema).select("user_id", "event_id"), ["user_id", "event_id"], tuple(last), 100) if last else first
    return first.unionByName(second)
