"""Phrases found in texts (JOIN-26): whole results, and no row for each word of a text."""

import random

from plan_rows import made_rows

from millrace.operators import joins


def test_phrases_are_those_of_a_plain_loop(spark):
    rng = random.Random(4)
    draw = lambda n: "".join(rng.choice("ab é") for _ in range(n))
    texts = [(rng.choice([None, *range(60)]), rng.choice([None, draw(30), draw(30), draw(200)])) for _ in range(120)]
    phrases = [*{draw(rng.randrange(1, 7)) for _ in range(60)}, None, "", "a", "a"]
    rows = spark.createDataFrame(texts, "k long, text string")
    for most in (1000, 7):  # one block, and several
        got = joins.containing(rows, "k", spark.createDataFrame([(p,) for p in phrases], "p string"), most).collect()
        assert {tuple(r) for r in got} == {(k, p) for k, t in texts for p in phrases if t and p and p in t}
    assert joins.containing(rows, "k", spark.createDataFrame([], "p string")).count() == 0


def test_words_of_texts_make_no_rows(spark, tmp_path):
    """Before, each text was copied once for each of its 3,000 words."""
    words = " ".join(f"w{i}" for i in range(3000))
    spark.createDataFrame([(i, f"{words} X{i % 7} One two three four Fives") for i in range(40)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "x3 one two Three four"), (2, "one two three four five six"), (3, "w1 w2 w3 w4"), (4, "3 One two three fou"), (5, "one two three four six"), (6, "ONE TWO THREE FOUR FIVE")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = joins.join26(spark, str(tmp_path))
    assert max(made_rows(out).values()) <= 200
    threes = {i for i in range(40) if i % 7 == 3}
    assert {tuple(r) for r in out.collect()} == {(i, k) for i in range(40) for k in (2, 6)} | {(i, k) for i in threes for k in (1, 4)}
