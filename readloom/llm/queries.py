"""Registry of the corpus queries and of the SQL that some of them are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from readloom.llm import html_extract, license_scan, ngram_join, packing, pii, quality_rules, sentencepiece_codec, spotsigs, suffix_dedup, warc

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_ngram_jaccard_join": ngram_join.join_query,
        "op2_html_extract": html_extract.html_query,
        "op3_suffix_dedup": suffix_dedup.suffix_query,
        "op4_warc": warc.warc_query,
        "op5_best_fit_packing": packing.packing_query,
        "op6_pii_surrogates": pii.pii_query,
        "op7_license_scan": license_scan.license_query,
        "op8_spotsigs": spotsigs.fingerprints_query,
        "op9_sentencepiece": sentencepiece_codec.sentencepiece_query,
        "op10_quality_rules": quality_rules.quality_query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard_join": ngram_join.ORACLE,
        "op4_warc": warc.ORACLE,
        "op7_license_scan": license_scan.ORACLE,
        "op8_spotsigs": spotsigs.ORACLE,
        "op10_quality_rules": quality_rules.ORACLE,
    }
