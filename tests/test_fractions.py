"""Fractions (MATH-02): exact beyond 2^53, and each different text of a batch read once."""

import pyarrow as pa
from pyspark.sql import functions as F

from millrace.functions import measures


def test_fractions_stay_integers(spark):
    """Before, a quotient of doubles was cast: the second to last digits of long numbers were lost."""
    texts = ["123456789.987654321", "999999999 999999998/999999999", "0.50", "6/4", "0/7", "3/0", "0/0", "1 0/5", "1/2/3", "", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", measures.rational(F.col("t")).alias("r")).collect()
    got = [None if r["r"] is None else tuple(r["r"]) for r in sorted(got)]
    assert got == [(123456789987654321, 1000000000), (999999998999999999, 999999999), (1, 2), (3, 2), (0, 1), None, None, (1, 1), None, None, None]


def test_each_text_is_read_once_a_batch():
    """Before, Euclid's steps were 90 for every row and evaluated again at each use of a number."""
    read = []

    def f(text, unit):
        read.append((text, unit))
        return measures.length(text, unit)

    texts, units = ["1½l", "2", None, "2", "1½l", "", None] * 1000, ["", "length", "length", "", None, "x", None] * 1000
    out = measures._each_once(f)(pa.array(texts, pa.string()), pa.array(units, pa.string())).to_pylist()
    assert sorted(map(repr, read)) == sorted(map(repr, set(zip(texts, units, strict=True))))
    assert out == [measures.length(t, u) for t, u in zip(texts, units, strict=True)] and out[:4] == [{"num": 3, "den": 2}, {"num": 2, "den": 1}, None, None]
    assert measures._each_once(f)(pa.array([], pa.string()), pa.array([], pa.string())).to_pylist() == []
    assert measures._each_once(f)(pa.array([None], pa.string()), pa.array([None], pa.string())).to_pylist() == [None]
