"""Fenced commits, frozen pages and bounded scans."""

import pytest
from pyspark.sql import functions as F

from millrace.sources import files
from millrace.streaming import runs


def test_stale_attempts_are_refused(spark, tmp_path):
    log = runs.Log(spark, f"file://{tmp_path}/catalog")
    rows = lambda a, b: spark.range(a, b).withColumn("k", F.col("id") % 3)
    schema = "id long, k long"
    assert log.generation() == 0 and log.snapshot(0, schema).count() == 0
    assert log.commit(rows(0, 10), 0, "first") == 1
    with pytest.raises(runs.StaleGeneration):
        log.commit(rows(10, 20), 0, "started before the first ended")
    frozen = log.snapshot(1, schema)
    before = [tuple(r) for r in runs.page(frozen, ["k", "id"], (0, 6), 4).collect()]
    assert before == [(9, 0), (1, 1), (4, 1), (7, 1)]
    assert log.commit(rows(10, 30), 1, "second") == 2
    assert [tuple(r) for r in runs.page(log.snapshot(1, schema), ["k", "id"], (0, 6), 4).collect()] == before
    assert log.snapshot(2, schema).count() == 30 and [m["run"] for m in log.manifests(2)] == ["first", "second"]
    with pytest.raises(ValueError):
        log.snapshot(3, schema)


def test_of_two_attempts_at_once_one_commits(spark, tmp_path, monkeypatch):
    log = runs.Log(spark, f"file://{tmp_path}/catalog")
    other = runs.Log(spark, f"file://{tmp_path}/catalog")
    monkeypatch.setattr(other, "generation", lambda: 0)  # it looked before the first commit, and renames after it
    log.commit(spark.range(5).toDF("id"), 0, "first")
    with pytest.raises(runs.StaleGeneration):
        other.commit(spark.range(50).toDF("id"), 0, "second")
    assert log.snapshot(1, "id long").count() == 5
    assert len([s for s in log._fs().listStatus(log._path("data"))]) == 1


def test_bounded_scan_reads_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = lambda n, parts: spark.range(0, n, 1, parts).mapInArrow(count, "id long")
    kept = files.bounded(rows(100, 4), 100)
    assert sorted(r["id"] for r in kept.collect()) == list(range(100)) and kept.count() == 100 and seen.value == 100
    for parts in (1, 4):  # more than the bound in one task, and in all together
        with pytest.raises(ValueError, match="more than 99 rows"):
            files.bounded(rows(100, parts), 99)
    assert files.bounded(spark.range(0), 0).count() == 0
