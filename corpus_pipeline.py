"""Corpus pipeline: language ID, near-duplicates, decontamination, mixing, token files.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as
the next stage's docs. All stages but the last return the columns of documents, extra ones with any name included.

Edge cases. Null and empty texts: language ID drops them, as no language is recognised; given to a later stage,
near-dedup keeps one of each repeated row, decontamination keeps them, mixing takes nothing of them, and token output
writes their end id. Null ids, languages and sources are values like others. Very long texts are read whole. Repeated rows:
near-dedup keeps one, the other stages treat each alike. Ties go to the smaller doc_id or name. An empty table gives an
empty table of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, language_id, mixing, near_duplicates, token_files
from millrace.llm.common import Workspace, read_table

#: A document whose language is less certain than this goes.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language; lang becomes the language found. Learns from docs' labels."""
    columns = docs.columns
    model = language_id.Model.fit(docs.filter(F.col("lang").isNotNull() & ~language_id.held_out()))
    # columns lie in a struct, so that none of theirs can clash with those of the prediction
    held = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"))
    kept = language_id.predict(held, model, "doc").filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.select(*[F.col("lang_pred" if c == "lang" else f"doc.`{c}`").alias(c) for c in columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8 or more."""
    return near_duplicates.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of the sources in the ratio 5 : 2 : 1, repeating; a row for each document and pass that takes words of it."""
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix with their index, read back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    return token_files.encode_and_read_back(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("token-ID output", write_tokens),
]

#: SQL can't express language scores, token ids or index permutations: the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    work = Workspace(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = work.save(docs, name.replace(" ", "-"))
    return docs
