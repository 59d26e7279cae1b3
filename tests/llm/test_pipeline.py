"""The pipeline stage by stage: decisions, columns with clashing names, nulls, repeated rows, long texts and empty tables."""

import os
import random

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
CLASH = ["score", "lang_pred", "overlaps", "uid", "copy", "words", "parts", "size", "key", "doc", "seeds", "label", "doc_key", "a.b"]


@pytest.fixture(scope="module")
def table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter("length(text) > 100").first()["text"]
    rng = random.Random(3)
    english = [r["text"] for r in docs.filter("lang = 'en' and n_chars between 800 and 4000").orderBy("doc_id").limit(3).collect()]
    long = " ".join(rng.choice(english[0].split()) for _ in range(60_000))
    extra = [(900001, None, None, None, None), (900002, "", "en", "a", 0), (900003, "12 !!", "en", "a", 5), (900004, long, "en", "a", len(long)), (900005, english[1], None, None, len(english[1])), (900006, english[1] + " end", "en", "b", len(english[1]) + 4), (900007, f"{english[2]} {item}", "en", "a", 1), (900007, f"{english[2]} {item}", "en", "a", 1)]
    out = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long").select(*[F.col(c).cast(docs.schema[c].dataType) for c in ("doc_id", "text", "lang", "source", "n_chars")]))
    for c in CLASH:
        out = out.withColumn(c, F.lit(1))
    path = os.path.join(spark.conf.get("spark.checkpoint.dir"), "pipeline-input")
    out.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_stages_take_effect_and_keep_columns(spark, table):
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    docs, after = table, {}
    work = pipeline.Workspace(spark, "test")
    for name, stage in pipeline.STAGES:
        found = stage(spark, docs, SF)
        if name != pipeline.STAGES[-1][0]:
            assert found.columns == table.columns
        docs = work.save(found, "stage")
        after[name] = ids(docs)
    lang, near, clean, mixed, tokens = (after[n] for n, _ in pipeline.STAGES)
    assert not {900001, 900002, 900003} & lang and {900004, 900005, 900006, 900007} <= lang
    assert 900006 not in near and len(near & {900005, *ids(table.filter(f"doc_id < 900000"))}) > 0
    assert 900007 not in clean and clean <= near and len(clean) > 0.8 * len(near)
    assert mixed <= clean and tokens == mixed


def test_stages_take_empty_tables(spark, table):
    for name, stage in pipeline.STAGES:
        found = stage(spark, table.limit(0), SF)
        assert found.count() == 0 and (name == pipeline.STAGES[-1][0] or found.columns == table.columns)


def test_later_stages_take_nulls_and_repeated_rows(spark, table):
    odd = table.filter("doc_id > 900000")
    odd = odd.unionByName(odd)
    got = {name: [r["doc_id"] for r in stage(spark, odd, SF).select("doc_id").collect()] for name, stage in pipeline.STAGES[1:]}
    assert sorted(got["MinHash near-dedup"]) == [900001, 900002, 900003, 900004, 900005, 900007]
    assert sorted(got["benchmark decontamination"]) == sorted([*range(900001, 900007)] * 2)
    assert {900003, 900004, 900005, 900006, 900007} == set(got["mixing sources to target weights"])
    assert len(got["token-ID output"]) == 16
