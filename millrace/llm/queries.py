"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, decontaminate, html_text, language_id, mixing, near_duplicates, nearest, ngram_join, secret_scan, spelling, token_files, toxicity, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_language_id": language_id.op2_language_id,
        "op3_url_filter": url_filter.op3_url_filter,
        "op4_secret_scan": secret_scan.op4_secret_scan,
        "op5_near_duplicates": near_duplicates.op5_near_duplicates,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_token_files": token_files.op7_token_files,
        "op8_mixing": mixing.op8_mixing,
        "op9_html_text": html_text.op9_html_text,
        "op10_nearest": nearest.op10_nearest,
        "op11_centroids": centroids.op11_centroids,
        "op12_ngram_join": ngram_join.op12_ngram_join,
        "op13_spelling": spelling.op13_spelling,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": url_filter.ORACLE, "op11_centroids": centroids.ORACLE, "op12_ngram_join": ngram_join.ORACLE, "op13_spelling": spelling.ORACLE}
