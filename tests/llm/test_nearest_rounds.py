"""Rows that op10's cells make."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.llm import nearest


def test_cells_name_only_what_reaches_the_floor():
    vectors = np.eye(4)[[0, 1, 2, 3]] * np.array([[4.0], [3.0], [2.0], [1.0]])
    cell = nearest._Cell(pa.table({"v": pa.array(vectors.tolist()), "leaf": pa.array([0, 0, 1, 1]), "ids": pa.array([[7], [5, 6], [3], [2]])}))
    asked = lambda floor: pa.RecordBatch.from_arrays([pa.array([9]), pa.array([[1.0] * 4]), pa.array([[0, 1]]), pa.array([floor])], ["q", "v", "ids", "floor"])
    named = lambda floor: cell.best(asked(floor), 10).column(1).to_pylist()
    assert named(float("-inf")) == [7, 5, 6, 3, 2]
    assert named(3.0) == [7, 5, 6] and named(4.5) == []


def test_rounds_of_cells_give_the_lists_of_all_cells(spark):
    """Small cells, so that there are several layers: with every leaf asked, lists are those of brute force."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 8)).round(2)
    x[700:760] = x[5]  # copies
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = nearest.search(table, lambda key: F.pmod(key, F.lit(50)) == 0, target=1.0, leaf=16, cell=64, fit_vectors=512).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for q in range(0, 1500, 50):
        scores = (x * x[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(len(x)), -scores)) if i != q][:20]
        assert [i for i, _ in got[q]] == order and np.allclose([s for _, s in got[q]], scores[order])
