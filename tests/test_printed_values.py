"""Distances, places and grades as printed."""

import pytest
from pyspark.sql import functions as F

from millrace.functions.values import distance, finish_position, grade_priority, race_grade


def test_printed_distances(spark):
    wanted = {
        "1600": (1600.0, "official_metric", "m"), "芝2400m": (2400.0, "official_metric", "m"), "6f": (1207.008, "exact_conversion", "f"), "approx 6 F": (1207.008, "approximate_conversion", "f"), "1m2f110y3ft": (2113.1784, "exact_conversion", "m+f+y"),
        "1 1/16M": (1709.928, "exact_conversion", "M"), "8.5f": (1709.928, "exact_conversion", "f"), "1m 4f": (2414.016, "exact_conversion", "f+m"), "4f 213y 0ft": (999.4392, "exact_conversion", "f+ft+y"), "2m": (3218.688, "exact_conversion", "m"),
        "1 1/0M": (None, "unknown", ""), "99米": (None, "unknown", ""), "": (None, "unknown", ""), "a mile": (None, "unknown", ""), None: (None, "unknown", ""),
    }
    rows = spark.createDataFrame([(k,) for k in wanted], "raw string").select("raw", distance(F.col("raw")).alias("d")).collect()
    for r in rows:
        metres, precision, unit = wanted[r["raw"]]
        assert (r["d"]["precision"], r["d"]["unit"]) == (precision, unit), r
        assert r["d"]["metres"] == (None if metres is None else pytest.approx(metres)), r


def test_printed_places(spark):
    wanted = {"1": (1, "dead_heat"), "02ND": (2, "dead_heat"), "第3": (3, "dead_heat"), "除外": (None, "scratched"), "失格": (None, "disqualified"), "BD": (None, "brought_down"), "pu": (None, "unknown"), "": (None, "unknown"), None: (None, "unknown")}
    rows = spark.createDataFrame([(k,) for k in wanted], "raw string").select("raw", finish_position(F.col("raw"), F.lit(True)).alias("p")).collect()
    assert {r["raw"]: (r["p"]["position"], r["p"]["status"]) for r in rows} == wanted
    assert {r["raw"] for r in rows if r["p"]["start_status"] == "non_starter"} == {"除外"}


def test_printed_grades(spark):
    wanted = {"G1": ("G1", 0), "ＧⅡ": ("G2", 1), "Derby (G3)": ("G3", 2), "jpnⅠ": ("JPN1", 0), "J-G2": ("JG2", 2), "オープン特別": ("OPEN", 2), "1勝クラス": ("1WIN", 3), "GALLOP 1": ("", None), "": ("", None), None: ("", None)}
    rows = spark.createDataFrame([(k,) for k in wanted], "raw string").select("raw", race_grade(F.col("raw")).alias("g")).select("raw", "g", grade_priority(F.col("g")).alias("p")).collect()
    assert {r["raw"]: (r["g"], r["p"]) for r in rows} == wanted
