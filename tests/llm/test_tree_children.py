"""Rows that op5's trees make."""

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import near_duplicates
from millrace.llm.common import Workspace, row_key


def test_trees_make_children_once(spark):
    """A group of alike classes: the tokens are read twice for the roots and once for each further level."""
    rng = np.random.default_rng(2)
    base = rng.integers(1 << 30, size=near_duplicates.COORDS)
    rows = [(i, [int(x) if k else int(y) for x, y, k in zip(base, rng.integers(1 << 30, size=len(base)), rng.random(len(base)) < 0.7, strict=True)]) for i in range(700)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    classes = spark.createDataFrame(rows, "set_id long, tokens array<int>").mapInArrow(counted, "set_id long, tokens array<int>")
    saved = []

    class Kept(Workspace):
        def save(self, df, name):
            saved.append(name)
            return super().save(df, name)

    near_duplicates.grow(classes, 0.85, 3, Kept(spark, "trees"))
    levels = sum(x.startswith("level") for x in saved)
    assert levels > 2 and read.value <= (levels + 1) * len(rows)


def test_texts_stay_out_of_python_where_wanted_ones_are_chosen(spark):
    work = Workspace(spark, "texts")
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)] + [(None, None)], "doc_id long, text string")
    keyed = docs.select("doc_id", row_key("doc_id", "text").alias("doc_key"))
    classes = work.save(keyed.filter("doc_id is not null").select(F.col("doc_id").alias("set_id"), "doc_key"), "classes")
    found = near_duplicates.texts_of(work.save(classes.filter("set_id % 7 = 0").select("set_id"), "wanted"), classes, docs)
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(i, f"text {i}") for i in range(0, 50, 7)]
