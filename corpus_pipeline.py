"""The corpus pipeline: each stage gets what the one before it kept and applies one operator of ``readloom.llm``.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir). ``run`` writes each stage's rows as Parquet to
the shared folder and reads them again for the next. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from readloom.llm import ngram_join, packing, pii, quality_rules, suffix_dedup
from readloom.llm.common import remove, scratch_path, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that too many documents of their host share."""
    return quality_rules.apply(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    return ngram_join.apply(docs)


#: A passage of over 50 words: found by strings of 250 bytes (the shortest of 51 words measured has 285), held against its words.
PASSAGE_BYTES, PASSAGE_GRAM, PASSAGE_WORDS = 250, 32, 51


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of over 50 words that repeat in the corpus."""
    return suffix_dedup.apply(docs, min_words=PASSAGE_WORDS, length=PASSAGE_BYTES, gram=PASSAGE_GRAM)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and secrets replaced."""
    return pii.apply(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: where it stands in which sequence, and its ids."""
    return packing.apply(docs)


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("pii", private_data),
    ("best_fit_packing", sequences),
]

#: Shingle components, suffix sorting, keyed surrogates and token ids have no SQL form; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        at = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            remove(spark, before)
        before = at
    return STAGES[-1][1](spark, docs, sf_dir)
