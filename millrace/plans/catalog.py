"""Registry of named queries and the ANSI SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "win06_round_robin"


def query(name: str, sql: str | None = None):
    """Registers a query under `name`; `sql` is its oracle over the same tables."""

    def keep(f):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("agg01_group_count", "SELECT lang, count(*) AS n_docs FROM documents GROUP BY lang")
def agg01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by language: partial and final hash aggregation over one pruned column."""
    return table(spark, sf_dir, "documents").groupBy("lang").count().withColumnRenamed("count", "n_docs")
