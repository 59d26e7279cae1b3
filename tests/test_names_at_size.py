"""Similar names (JOIN-16): best matches against a plain loop, and pairs that meet among numbered names."""

import itertools
import random

import pytest
from plan_rows import made_rows

from millrace.operators import fuzzy, joins


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("seed", [1, 2])
def test_best_names_are_those_of_a_plain_loop(spark, tmp_path, seed):
    """Names of 0 to 60 code points, copies, repeated ids, nulls."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcé1") for _ in range(rng.choice([0, 3, 8, 9, 17, 18, 24, 25, 33, 60]))) for _ in range(12)]
    rows = []
    for i in range(160):
        name = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
            at = rng.randrange(len(name) + 1)
            name[at : at + rng.choice([0, 1])] = rng.choice(["", "x", "y"])
        rows.append((rng.choice([1, 2, None]) if i % 9 == 0 else 1, None if i == 5 else i // 2 if i % 20 == 1 else i, None if i == 7 else "".join(name)))
    spark.createDataFrame(rows, "s_nationkey int, s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    want = {}
    for (n, i, a), (m, j, b) in itertools.product(rows, rows):
        if None in (n, i, a, m, j, b) or n != m or i == j or not a + b:
            continue
        sim = 1 - distance(a, b) / max(len(a), len(b))
        if sim >= 0.88:
            want[i] = max(want.get(i, (0, 0)), (sim, -j))
    assert {r["id_a"]: (r["id_b"], r["sim"]) for r in joins.join16(spark, str(tmp_path)).collect()} == {i: (-j, round(s, 6)) for i, (s, j) in want.items()} and len(want) > 50


def test_numbered_names_meet_few_others(spark, tmp_path):
    """Before, the 2,000 names of one nation met in 4,000,000 pairs."""
    spark.range(2000).selectExpr("1 AS s_nationkey", "id * 37 AS s_suppkey", "format_string('Supplier#%09d', id * 37) AS s_name").write.parquet(f"{tmp_path}/supplier.parquet")
    named = spark.read.parquet(f"{tmp_path}/supplier.parquet").selectExpr("s_nationkey AS region", "s_name AS text")
    asked = named.selectExpr("region", "replace(text, '#0', ' ') AS text")
    for left, level in ((named, 0.94), (asked, 0.88)):
        made = made_rows(fuzzy.near_texts(left, named, level))
        assert max(n for k, n in made.items() if "Join" in k) <= 100_000, made
    assert joins.join16(spark, str(tmp_path)).count() == 2000


def test_questions_are_answered_once(spark):
    """Before, each of 3,000 equal requests met each of 200 series."""
    asked = spark.range(3000).selectExpr("id AS request", "'some  NAME' AS name", "'a' AS region", "if(id % 2 = 0, null, 2000) AS year")
    known = spark.range(200).selectExpr("id AS series", "'a' AS region", "'Some Names' AS name", "if(id < 50, 2001, 1990) AS first_year", "null AS last_year")
    out = fuzzy.proposals(asked, known.selectExpr("series", "region", "name", "int(first_year) AS first_year", "int(last_year) AS last_year"))
    made = made_rows(out)
    assert max(made.values()) <= 10_000, made
    got = out.collect()
    assert len(got) == 3000 and {(r["reason"], len(r["candidates"]), r["request"] % 2) for r in got} == {("fuzzy_match_requires_review", 200, 0), ("fuzzy_match_requires_review", 150, 1)}
