"""Rows that JOIN-15 makes where many terms share a surface."""

from plan_rows import made_rows

from millrace.operators.joins import term_states


def test_a_text_never_meets_all_terms_of_a_surface(spark):
    """300 texts with a surface of 2,000 terms: before, they made 600,000 rows."""
    terms = spark.range(2000).selectExpr("'Red' AS surface", "id AS term_id", "id % 500 = 7 AS registry", "true AS reviewed")
    terms = terms.unionByName(spark.range(2000).selectExpr("'old' AS surface", "id AS term_id", "false AS registry", "true AS reviewed"))
    texts = spark.range(300).selectExpr("id", "'a red old one' AS text")
    evidence = spark.createDataFrame([(1, 7), (2, 7), (2, 507), (3, 8), (4, 7), (4, 8), (4, 9)], "id long, term_id long")
    out = term_states(texts, terms, evidence, [])
    assert max(n for name, n in made_rows(out).items() if "Join" in name) <= 1200
    got = {(r["id"], r["surface"]): (r["term_id"], r["state"]) for r in out.collect()}
    assert len(got) == 600
    # of red, only registry entries are terms: 7, 507, 1007 and 1507
    assert [got[i, "red"] for i in range(6)] == [(None, "conflict"), (7, "confirmed"), (None, "conflict"), (None, "conflict"), (7, "confirmed"), (None, "conflict")]
    assert [got[i, "old"] for i in range(6)] == [(None, "conflict"), (7, "confirmed"), (None, "conflict"), (8, "confirmed"), (None, "conflict"), (None, "conflict")]
